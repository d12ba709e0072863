"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How much larger rows are in memory than in a file: numbers of policies take a byte or two there, as rows of a join 40 and more.
ROWS_TO_FILE = 64
#: Rows of a table that is sent to every executor.
SENT_ROWS = 250_000
#: Code of a method that the JVM compiles.
COMPILED_BYTES = 8000


def estimate_by_rows(spark: SparkSession) -> None:
    """Let Spark estimate tables by their rows in memory, not by the bytes of their files.

    A file of ten megabytes holds millions of short rows; by its bytes alone Spark
    would gather them all in the driver to broadcast them.  A factor set by the user stays.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", ROWS_TO_FILE)


def compile_short(spark: SparkSession) -> None:
    """Let Spark run operator by operator where the code of a whole stage is one method that the JVM would never compile.

    HotSpot interprets methods of more than 8000 bytes of code; Spark's own limit is what a class file can hold.  A limit set by the user stays.
    """
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 65535:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)


def _place(df: DataFrame, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine (tests) uses a temporary
    folder; on a cluster that is an error, as executors don't see the driver's folders.
    """
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_clausework_tables", None)
    if folder is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if folder is None:
        folder = context._clausework_tables = "file://" + tempfile.mkdtemp(prefix="clausework-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back; loops don't grow their plan."""
    path = _place(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, *keys: str, placed: bool = False) -> DataFrame:
    """As ``cut``, with the rows dealt into buckets by ``keys``: aggregates by them and joins of two such tables on them shuffle nothing.

    ``placed`` rows come from tables that are dealt by these keys and are not dealt again.  The table's name is
    needed for writing only and is gone from the catalog afterwards.  Don't join a union of such tables: Spark
    takes it to be dealt as they are, and it is not.
    """
    spark, buckets = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = f"clausework_{uuid.uuid4().hex}"
    (df if placed else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).option("path", _place(df, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def sent(df: DataFrame, name: str, rows: int = SENT_ROWS) -> DataFrame:
    """``df`` written once and broadcast if it has ``rows`` rows at most; a longer one is left to be shuffled."""
    table = cut(df, name)
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table

