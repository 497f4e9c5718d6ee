import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, repeated rows, and further columns with awkward names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passage, long_text = prose(60), prose(30_000)
    rows = [(k, f"{prose(rng.randint(25, 90))} {passage if k % 5 == 0 else ''}\n{prose(30)}") for k in range(40)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "one two"), (None, rows[3][1]), (None, None)]
    rows += [rows[7], rows[7], (45, rows[7][1]), (46, rows[7][1].upper()), (47, long_text), (48, long_text + " end")]
    rows += [(49, "aa " * 500), (50, f"é😀 {passage}\u3000wide space {prose(40)}"), (-3, prose(50)), (51, None)]
    extra = [(i, t, t, k, k, None, "x", -k, [k]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        extra, "doc_id long, text string, k1 string, id int, fp long, `start` string, `n_words` string, part int, hash array<int>"
    ).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture()
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def sf_rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
