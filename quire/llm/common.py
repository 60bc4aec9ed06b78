"""What the operators of this subpackage share: written intermediate tables and hashing of words."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of ``[\x09-\x0D\x20]``; a word is a maximal run of other characters.
SPACES = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = SPACES.decode()
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ONE = np.uint64(1)
#: Odd multipliers of the hashes (the fractional digits of well-known constants).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
POWER = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of an Arrow batch that is sent to a Python worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quire-')}")
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once, its lineage ends there, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Has the session send Python workers Arrow batches of at most BATCH_BYTES (or of fewer, if it says so already).

    The default of 64 MB is held several times over, in the executor's and in the worker's memory, by every task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    digits = re.match(r"\d+", now)
    # Spark prints the value in bytes; what it doesn't print so was set by hand
    if not re.fullmatch(r"\d+b?", now) or digits is None or int(digits[0]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def clear(spark: SparkSession) -> None:
    """Removes every table that :func:`written` left in the shared folder: call it when results are stored and no query of this module is running."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quire")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Removes a table that :func:`written` made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {re.match(r".*/quire/[^/]+", f)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
#: Powers that are kept between calls.
KEPT_POWERS = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (one at least)."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        out = np.full(max(n, min(2 * n, KEPT_POWERS), 1), base, dtype=np.uint64)
        out[0] = 1
        kept = np.multiply.accumulate(out)
        if len(kept) <= KEPT_POWERS:
            _POWERS[int(base)] = kept
    return kept[: max(n, 1)]


#: The inverse of POWER modulo 2**64.
POWER_INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))
#: A random-looking value for each byte, so that byte hashes don't depend on small differences.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * POWER)
