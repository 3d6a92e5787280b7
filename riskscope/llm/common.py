"""Shared helpers: raw text of Arrow columns, free column names, shared folder."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.session import ship_package

# Words are runs of anything but the ASCII blanks x20 and x09-x0D; that is
# what bytes.split() splits on.
BATCH_BYTES = 4 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def _libc():
    """The C library, told to give large blocks back to the system when they
    are freed; Arrow uses it too.  Workers live on between tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD, fixed
        return libc
    except (OSError, AttributeError):  # another C library
        return None


def lean() -> None:
    """Give freed memory of this Python worker back to the system."""
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def raw_texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    lean()
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if v is None else v for v in col.cast(kind).to_pylist()]


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes of it at a time."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        if end < len(raw):
            blank = _BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        yield raw[at:end].split()
        at = end


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ship(spark: SparkSession) -> SparkSession:
    """Make a session ready for the operators: Arrow batches of bounded bytes,
    and this package sent to the Python workers, once per context, so that
    functions of its modules can be loaded there without a PYTHONPATH."""
    # Whole texts go to Python: bound a batch by its bytes, not by 10,000 rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package()
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared ``spark.checkpoint.dir``.
    Only a local session without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = own.get() if own.isDefined() else None
    if not base and re.match(r"local(\[|$)", spark.sparkContext.master):
        base = tempfile.mkdtemp(prefix="riskscope-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later reads don't depend on
    executors that may be lost."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "ckpt"))
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint if ``rows`` x ``row_bytes`` is under ``limit``; otherwise
    the join shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one after another."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return np.repeat(starts - first, lens) + np.arange(total, dtype=np.int64)
