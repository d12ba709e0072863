"""Small helpers that all operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python, and its bytes: texts are long, so few of them.
ARROW_ROWS, ARROW_BYTES = 1000, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's reader opens the path, nothing else does."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker and of the JVM's side of it: at most ``ARROW_ROWS`` texts in a batch, and no more once it has ``ARROW_BYTES``."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(setting: str) -> int:
    """A number of Spark's settings, with or without a unit (64m, 2gb)."""
    number = setting.strip().lower().removesuffix("b")
    return int(number[:-1]) << 10 * (1 + "kmgt".index(number[-1])) if number[-1:] in tuple("kmgt") else int(number)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) uses a temporary folder;
    on a cluster that is an error, as executors don't see the driver's folders.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if folder is None:
        folder = getattr(spark.sparkContext, "_clausework_dir", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="clausework-")
            spark.sparkContext._clausework_dir = folder
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor never makes Spark repeat what
    came before, and later steps all see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.cut_path = path
    return written


def spent(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Up to this many ids are broadcast; more are joined by a shuffle.
MOST_IDS = 1 << 20


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (doc_id); rows without doc_id stay.

    ``gone`` is counted first and broadcast only if it is small.
    """
    gone = cut(gone.select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= MOST_IDS else gone
    return docs.join(side, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


#: As many keys that hold a digest are broadcast.
MOST_KEYS = 1 << 18


def text_digest(text: Column) -> Column:
    """SHA-256 of a text's bytes; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def without_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``key`` are not together in ``gone`` (doc_id, key).

    A null doc_id is a value like any other, so every row goes or stays by its own
    ``key``.  ``gone`` is counted first and broadcast only if it is small.
    """
    gone = cut(gone.select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= MOST_KEYS else gone
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (key == F.col("__gone_key")), "left_anti")
