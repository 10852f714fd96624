"""Tables written to the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop)
    is a temporary folder chosen; it is then set as the checkpoint folder, so
    that later calls agree.  A cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="archipelago-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A stored table of more bytes than this is joined by shuffles.
SMALL = 100_000


def store(df: DataFrame, name: str) -> DataFrame:
    """:func:`written`, and never broadcast unless it is small.

    Spark takes a file's compressed size for the table's.  Numbers take a byte or
    two each in the file and some fifty in a hash table, of which a join's chain
    builds several at once on the driver, so all but small tables carry a hint.
    """
    out = written(df, name)
    if _size(out.sparkSession, out._stored_at) <= SMALL:
        return out
    hinted = out.hint("shuffle_merge")
    hinted._stored_at = out._stored_at
    return hinted


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; with a folder
    for each value of ``by``, if that is given.

    The lineage ends at the files, so a lost executor costs one re-read.  The
    shuffle files of the write are of no further use and go with its end, so a
    long job's disk holds the shuffles of one step at a time.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    except BaseException:
        _delete(spark, path)  # nothing of a write that failed or was cancelled stays
        raise
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _size(spark: SparkSession, path: str) -> int:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that nothing needs any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)
