"""Session plumbing that the text operators share: the shared folder, tables that cut lineage, Arrow maps."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all of it runs on this machine (tests, a laptop).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``, with its file system's name: what isn't Spark must not
    take a shared path for a local one. Where it is unset, a local session gets a local folder; a cluster's session is
    refused, since its executors don't see each other's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    if ":" not in found:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(found)
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", found).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/helixloom/{label}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``written`` made; a session that has ended is left alone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


class Tables:
    """The tables of one job. Each is dropped once what reads it has been written, and by then nothing's lineage leads
    to it; the rest goes when the interpreter ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing before it."""
        self.drop(name)
        self.paths[name] = path = fresh_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name, None)
            if path:
                drop_path(self.spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """A table that stays until the interpreter ends: lazy results may read it."""
    return Tables(df.sparkSession).write(label, df)


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = make(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
