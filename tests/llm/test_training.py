"""The language model trains on every training text."""

import pytest
from pyspark.sql import functions as F

from accordant.llm import recurrent_lm


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_training_text_is_trained_on(docs, rounds):
    rows = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.fillna(False, ["held_out"])
    found, n, _ = recurrent_lm.vocabulary(recurrent_lm.count_tokens(rows))
    assert recurrent_lm.trained(rows, found, rounds=rounds).trained_tokens == n > 0
