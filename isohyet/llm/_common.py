"""What the training-data operators share: white space, shared scratch tables, batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: U+0020 and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]"
#: A side joined by broadcast has at most this many rows (of bounded width); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder of its own; on a
    cluster it must be set, since no machine-local folder would be visible to all.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="isohyet-"))
    return made


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors.

    A table lives until ``drop`` or the end of the driver's Python, because the
    data frames that operators return read it lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may have ended; what stays is only disk
            pass


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows, counted here; else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class Sieve:
    """A Bloom filter with one hash, built and asked by DataFrame functions: bitmaps of 32,768 bits, one row each.

    It has 16 bits for each of ``n`` members up to 2^27 bits, so at most 16 MB are broadcast; with more members it
    lets more rows through, and the join that follows sorts them out.
    """

    BLOCK = 1 << 15

    def __init__(self, members: DataFrame, key: Column, n: int, scratch: Scratch, name: str):
        bits = self.BLOCK
        while bits < min(16 * n, 1 << 27):
            bits <<= 1
        self.modulus = bits - 1
        at = members.select(self._place(key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("sieve_block"))
        self.blocks = scratch.write(at.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("sieve_bits")), name)

    def _place(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.modulus)) + 1

    def passed(self, df: DataFrame, key: Column) -> DataFrame:
        """The rows of ``df`` whose key may be a member's."""
        place = self._place(key)
        rows = df.withColumn("sieve_at", F.bitmap_bit_position(place)).withColumn("sieve_block", F.bitmap_bucket_number(place)).join(F.broadcast(self.blocks), "sieve_block")
        byte = F.conv(F.hex(F.substr("sieve_bits", (F.shiftright("sieve_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.pow(F.lit(2), F.pmod("sieve_at", F.lit(8))).cast("int")
        return rows.where(byte.bitwiseAND(bit) != 0).drop("sieve_at", "sieve_block", "sieve_bits")


def without_white_space(text: Column) -> Column:
    return F.translate(text, WS_CHARS, "")


#: Bytes of one Arrow batch between Spark and Python: rows are whole texts, and a batch is held on both sides.
BATCH_BYTES = 2 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_BYTES, unless it has set less itself."""
    size = spark.conf.get(BATCH_CONF, None)
    if size is None or not size.isdigit() or int(size) <= 0 or int(size) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


_owner: list[str] = [""]
_kept: dict = {}


def worker_memory(owner: str) -> dict:
    """What a worker keeps between batches of one operator; the memory of the operator before it goes."""
    if _owner[0] != owner:
        _kept.clear()
        _owner[0] = owner
    return _kept


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def slices(n: int, step: int):
    for i in range(0, n, step):
        yield i, min(n, i + step)
