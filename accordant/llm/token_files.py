"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id; each task encodes its range and writes two files into the
output folder:

* part-NNNNN.bin: the ids of its documents, one after another, little-endian, 16 bits wide when
  the vocabulary allows it and 32 otherwise;
* part-NNNNN.idx: MAGIC, the width, the number of documents, then their ids (64-bit), a byte for
  each that says whether the id is null, and n + 1 offsets into the .bin file (64-bit, in ids).

`manifest` (Parquet) has a line for each pair of files with its counts and `base`: the ids in all
files before, a prefix sum over the counts of the files and so over one line for each file. A file is written under a name
of its attempt and renamed when it is whole, so a task that runs twice leaves one whole file.
Readers map both files into memory.

Cases: null and empty texts have only the end id; documents with a null id come first; equal
ids stay in one file, ordered by text, and each row is kept; an empty table gives no file.
Other columns are not read.
"""

from __future__ import annotations

import mmap
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.llm.tokens import encoder
from accordant.llm.words import small_batches

MAGIC = b"TOKENIDX"
LINE = "part long, bin string, idx string, n_docs long, n_tokens long, has_null boolean, first_id long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri)))


def put(system: fs.FileSystem, folder: str, name: str, chunks: list[bytes]) -> None:
    """Write a file that appears only when it is whole."""
    attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(attempt, f"{folder}/{name}")


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = None,
    vocabulary: int = 1 << 16,
    drops_space: bool = True,
) -> DataFrame:
    """Encode `docs` into token files under `folder` (a URI all executors reach); returns the manifest."""
    spark = small_batches(docs.sparkSession)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    end = np.array([] if end_id is None else [end_id], kind).tobytes()
    system, at = open_folder(folder)
    system.create_dir(at, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        system, at = open_folder(folder)
        encode = encoder(tokenizer, drops_space).encode
        name, ids, nulls, sizes = f"part-{part:05d}", [], [], []
        attempt = f"{at}/.{name}.{uuid.uuid4().hex}"
        out = None
        for batch in batches:
            if out is None:
                out = system.open_output_stream(attempt)
            for start in range(0, len(batch), 1000):
                rows = batch.iloc[start : start + 1000]
                found = encode(rows["text"].tolist())
                out.write(b"".join(x.astype(kind).tobytes() + end for x in found))
                ids += rows["id"].tolist()
                nulls += rows["no_id"].tolist()
                sizes += [len(x) + (end_id is not None) for x in found]
        if out is None:
            return
        out.close()
        system.move(attempt, f"{at}/{name}.bin")
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.uint64)]).astype("<u8")
        head = MAGIC + np.array([np.dtype(kind).itemsize, len(ids)], "<u8").tobytes()
        put(system, at, f"{name}.idx", [head, np.array(ids, "<i8").tobytes(), np.array(nulls, "u1").tobytes(), offsets.tobytes()])
        yield pd.DataFrame(
            {
                "part": [part], "bin": [f"{name}.bin"], "idx": [f"{name}.idx"], "n_docs": [len(ids)],
                "n_tokens": [int(offsets[-1])], "has_null": [bool(nulls[0])], "first_id": [ids[0]],
            }
        )

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ranged = rows.repartitionByRange(F.col("no_id").desc(), F.col("id"))
    ordered = ranged.sortWithinPartitions(F.col("no_id").desc(), "id", "text")
    ordered.mapInPandas(write, LINE).write.mode("overwrite").parquet(f"{folder}/counts")
    before = Window.orderBy(F.col("has_null").desc(), "first_id").rowsBetween(Window.unboundedPreceding, -1)
    based = spark.read.parquet(f"{folder}/counts").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    based.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class TokenFile:
    """One pair of files, mapped into memory where the file system is local or mounted."""

    def __init__(self, folder: str, bin_name: str, idx_name: str):
        system, at = open_folder(folder)
        index = self._bytes(system, f"{at}/{idx_name}")
        if bytes(index[:8]) != MAGIC:
            raise ValueError(f"{idx_name} is not an index of token files")
        width, n = (int(x) for x in np.frombuffer(index, "<u8", 2, 8))
        self.ids = np.frombuffer(index, "<i8", n, 24)
        self.nulls = np.frombuffer(index, "u1", n, 24 + 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 24 + 9 * n).astype(np.int64)
        raw = self._bytes(system, f"{at}/{bin_name}") if self.offsets[-1] else b""
        self.tokens = np.frombuffer(raw, f"<u{width}")

    @staticmethod
    def _bytes(system: fs.FileSystem, path: str):
        if isinstance(system, fs.LocalFileSystem):
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        with system.open_input_file(path) as f:
            return f.read()

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> np.ndarray:
        return self.tokens[self.offsets[k] : self.offsets[k + 1]].astype("<u4")


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless with_ids is false, the ids, from the files.

    ids_crc32 is the unsigned CRC-32 of a document's ids as little-endian 32-bit integers.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                file = TokenFile(folder, line["bin"], line["idx"])
                for first in range(0, len(file), 1000):
                    ks = range(first, min(first + 1000, len(file)))
                    rows = [file.document(k) for k in ks]
                    out = {
                        "doc_id": pa.array(file.ids[first : ks.stop], pa.int64(), mask=file.nulls[first : ks.stop]),
                        "start": pa.array(line["base"] + file.offsets[first : ks.stop], pa.int64()),
                        "n_tokens": pa.array([len(r) for r in rows], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([r.astype(np.int64) for r in rows], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)  # about a file for each task
