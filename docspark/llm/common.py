"""Helpers that the operators share: column picking and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, inner="outer")``: the column named exactly ``outer``, as ``inner``.

    Columns are found by position, so other columns whose names clash (in
    another case, or twice the same) do no harm.
    """
    inner = [f"_{i}" for i in range(len(df.columns))]
    missing = [c for c in columns.values() if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} in {df.columns}")
    renamed = df.toDF(*inner)
    return renamed.select(
        *[F.col(inner[df.columns.index(outer)]).alias(name) for name, outer in columns.items()]
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for functions that run in Python there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="docspark-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session with a local master may go without it; it then gets a
    temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="docspark-")
    return _LOCAL_DIRS[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks at hand, not the
    steps before. Later reads see one fixed result.
    """
    path = f"{shared_dir(df.sparkSession)}/docspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def counted(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``written``, and how many rows (that meet the condition) there are, counted while writing.

    A task that runs again can be counted again, so only 0 or not 0 is meant to be used.
    """
    seen = Observation()
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    out = written(df.observe(seen, F.count_if(hit).alias("n")), name)
    return out, seen.get["n"]


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once what was made from them is written itself."""
    for df in tables:
        path = getattr(df, "written_path", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def written_by_key(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like ``written``, in as many buckets of the keys as a shuffle has partitions.

    Joins on the keys then move the other side only.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(n, *keys).option("compression", "zstd").option("path", f"{shared_dir(spark)}/docspark/{name}")
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` is the quick way for pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
