"""What the text operators share: table access, Arrow text chunks, checkpoints, buckets of ids."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed (a checkout at the same path on each host)."""
    here = str(Path(__file__).resolve().parents[2])
    had = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in had.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, had) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text ''."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors share, which is the cluster's setting;
    only in local mode (tests) one is made where none is set. It can be removed when the application has ended."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{sc.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as a table and go on from there: nothing before it runs again, whatever executors
    are lost, and Spark knows its size, so that small tables are sent instead of shuffled."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_dir() -> str:
    return os.environ.get("MATCHSPARK_TOKENIZERS", "/opt/tokenizers")


class Chunk:
    """Whole texts laid end to end: text i is data[starts[i]:ends[i]]; null texts are empty, with valid False."""

    __slots__ = ("batch", "data", "ends", "raw", "starts", "valid")

    def __init__(self, batch: pa.RecordBatch, column: str) -> None:
        self.batch = batch
        text = batch.column(batch.schema.get_field_index(column))
        self.valid = np.asarray(pc.is_valid(text).to_numpy(zero_copy_only=False), dtype=bool)
        text = pc.fill_null(text.cast(pa.large_binary()), b"")
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        lo, hi = int(at[0]), int(at[-1])
        self.data = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.starts, self.ends = at[:-1] - lo, at[1:] - lo

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def sums(self, values: np.ndarray, dtype: type = np.int64) -> np.ndarray:
        """Sums of values (one for each byte, or a row for each) over each text; 0 for empty texts."""
        return segment_sums(values, self.starts, self.ends, dtype)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, dtype: type = np.int64) -> np.ndarray:
    out = np.zeros((len(starts), *values.shape[1:]), dtype)
    some = np.flatnonzero(ends > starts)
    if len(some):
        out[some] = np.add.reduceat(values, starts[some], axis=0, dtype=dtype) if _adjacent(starts[some], ends[some], len(values)) else np.array([values[a:b].sum(axis=0, dtype=dtype) for a, b in zip(starts[some], ends[some], strict=True)])
    return out


def _adjacent(starts: np.ndarray, ends: np.ndarray, n: int) -> bool:
    return bool((starts[1:] == ends[:-1]).all() and ends[-1] == n)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into runs of rows with at most so many bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
            yield Chunk(batch.slice(a, b - a), column)
            a = b


def docs_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others, whatever they are called, cannot clash with those made here."""
    return docs.select(*names)
