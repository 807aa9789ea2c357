"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset and all runs on this machine (tests), a
    temporary folder is made and put into the setting; on a cluster nobody else could read one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master: {master})")
        path = tempfile.mkdtemp(prefix="stoneloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``release_scratch``."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files
    that outlive any executor, and later readers prune columns."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def persist_observed(df: DataFrame, label: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``persist_table``, and aggregates taken while the rows are written; null where there is no row."""
    seen = Observation()
    out = persist_table(df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]), label)
    got = seen.get
    return out, {k: got.get(k) for k in aggregates}


def persist_lines(df: DataFrame, label: str, **options: str) -> str:
    """Path of text files with the only column of ``df``, a line each."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").options(**options).text(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete what was written into the shared folder; call it once results have been stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
