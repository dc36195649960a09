"""Collections on disk: versioned Parquet snapshots, and a change log of immutable batches.

A version is a folder ``v=N`` written whole; Spark's committer marks it with
``_SUCCESS`` when it is complete, so a failed write is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators.replay import committed, live

LOG_SCHEMA = "seq long, tx string, type string, op string, collection string, id string, doc string"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a collection, through Hadoop's file system, so that any store will do."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("v=")]
    done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """All versions that some writer has begun."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return [int(n[2:]) for n in names if n.startswith("v=")]


def save(records: DataFrame, path: str, attempts: int = 20) -> int:
    """Write the next version; the old ones stay until ``expire``.

    A version that another writer has begun, or left unfinished, is never
    touched: the next free number is taken.
    """
    spark = records.sparkSession
    for _ in range(attempts):
        version = max(_numbers(spark, path), default=0) + 1
        try:
            records.write.mode("errorifexists").parquet(f"{path}/v={version}")
            return version
        except AnalysisException as error:
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise
    raise RuntimeError(f"no free version at {path} after {attempts} attempts")


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or the given one; filters and columns reach the scan."""
    have = versions(spark, path)
    if not have or (version is not None and version not in have):
        raise ValueError(f"no such version at {path}")
    return spark.read.parquet(f"{path}/v={version or have[-1]}")


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    jvm = spark._jvm
    for version in versions(spark, path)[:-keep]:
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/v={version}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def backup(spark: SparkSession, path: str, target: str) -> int:
    return save(load(spark, path), target)


def append_log(frames: DataFrame, path: str) -> None:
    """Add one batch of change frames; batches are never changed."""
    frames.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def recovered(snapshot: DataFrame, frames: DataFrame) -> DataFrame:
    """(collection, id, doc): the snapshot with the log's committed operations on top."""
    base = snapshot.select(
        F.lit("put").alias("op"), "collection", "id", "doc",
        F.lit(-1).cast("long").alias("commit_seq"), F.lit(-1).cast("long").alias("seq"),
    )
    ops = committed(frames).select("op", "collection", "id", "doc", "commit_seq", "seq")
    return live(base.unionByName(ops))


def database_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(collections, records, bytes, versions) of a database: a path for each collection's snapshots."""
    jvm = spark._jvm
    rows, size, kept = None, 0, 0
    for path in paths.values():
        have = versions(spark, path)
        kept += len(have)
        if have:
            newest = jvm.org.apache.hadoop.fs.Path(f"{path}/v={have[-1]}")
            size += newest.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(newest).getLength()
            one = spark.read.parquet(newest.toString()).agg(F.count("*").alias("records"))
            rows = one if rows is None else rows.unionByName(one)
    rows = rows if rows is not None else spark.createDataFrame([], "records long")
    return rows.agg(
        F.lit(len(paths)).alias("collections"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.lit(size).cast("long").alias("bytes"),
        F.lit(kept).alias("versions"),
    )


def collection_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, records) for each collection."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count("*").alias("records")).select(F.lit(name).alias("name"), "records")
        out = one if out is None else out.unionByName(one)
    return out
