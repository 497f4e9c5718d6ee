"""Registered queries: every operator bound to the driver's tables."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import all query modules."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
