"""Helpers that the training-data operators share: words, hashes, shared folders, packed exchanges."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapengine.functions.shared import shared_dir

#: Words of a text are the runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: Texts are handled in chunks of about so many bytes and at most so many rows (a row number fits 12 bits).
CHUNK_BYTES, CHUNK_ROWS = 6 << 20, 4096
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Scratch:
    """Tables in the shared folder that an operator writes on its way and drops when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """The rows of df as a table in the shared folder, in a folder for each value of parts: its lineage ends here."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
        self.paths[name] = [*self.paths.get(name, []), path]
        self.spark.sparkContext._jvm.System.gc()  # the context cleaner then removes the shuffle files of finished plans
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names."""
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            removed(self.spark, path)


def release(df: DataFrame) -> None:
    """Deletes the tables in the shared folder that an operator's result reads; the result is of no use any more."""
    spark = df.sparkSession
    top = shared_dir(spark)
    folder = top.split(":", 1)[-1].rstrip("/")
    for name in {f.split(folder + "/", 1)[1].split("/", 1)[0] for f in df.inputFiles() if folder + "/" in f}:
        removed(spark, f"{top}/{name}")


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder that stays as long as that folder does: a result reads it."""
    return Scratch(df.sparkSession).written(df, name)


def lean(run: Callable) -> Callable:
    """run, a function of batches; when it ends, the memory that it freed goes back to the system: Python workers live on and would keep it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32(c: Column) -> Column:
    """crc32 of a column's text form."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case. bytes.split() splits at 09-0D and 20 and nowhere else."""
    return text.lower().split() if text else []


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes at most (a longer text is a range of its own) and bounded rows."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size or i + 1 - start >= CHUNK_ROWS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, doc: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words that lie within one document, and where they start."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _K[k % len(_K)] * np.uint64(2 * (k // len(_K)) + 1)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mixed(out[at]), at


def shingles(h: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every 5-word shingle; of a text with fewer words, one hash of its whole sequence."""
    out, at = windows(h, doc)
    docs = doc[at]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[short]
        acc = lengths[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            has = lengths[short] > k
            acc[has] = mixed(acc[has] * _K[0] + h[start[has] + k] * _K[k])
        out, docs = np.concatenate([out, acc]), np.concatenate([docs, short])
    return out, docs


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is emptied, so they don't stay in memory beside it."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def split_by(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of each bucket that occurs, in their old order; of no rows, none."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16 if n < 1 << 16 else np.uint32), kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    for b, i, j in zip(found.tolist(), starts, [*starts[1:], len(order)], strict=True):
        yield b, order[i:j]


def by_id(df: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Each row goes to the partition whose number it names."""
    return df.repartitionById(n, F.col(column).cast("int"))
