"""accordant: record reconciliation and explainable decisions on Spark DataFrames."""

from accordant.session import get_session, tune

__all__ = ["get_session", "tune"]
__version__ = "0.1.0"
