"""Sessions, shared scratch space and table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "32m",
    }
    if "spark.checkpoint.dir" not in conf:
        defaults["spark.checkpoint.dir"] = "file://" + tempfile.mkdtemp(prefix=f"{app}-")  # one machine: its own folder is the shared one
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset (tests), one of our own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):  # executors in other processes share no folder of ours
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Lets a scratch folder go when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder: lineage is cut and a lost executor loses nothing. The folder
    goes when the application ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt out to all cores if it is a plain scan of so few splits that less than half of them would work on
    it: a few files of one row group each, say. Scans of more splits are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*([A-Za-z]+)", line))}
    if nodes <= {"Project", "Filter", "Relation"} and 2 * df.rdd.getNumPartitions() <= cores:
        return df.repartition(cores)
    return df
