"""Session settings that the engine's results rely on, and its own configuration keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Our keys in the Spark configuration and their defaults.
DEFAULTS = {
    "numbra.enabled": "true",  # false: every shape stays with Catalyst
    "numbra.strategy": "auto",  # auto, catalyst or blas
    "numbra.gram.min-width": "17",
    "numbra.neighbour.min-width": "1",
    "numbra.neighbour.max-pairs": "10000000",  # of rows, for the control arm that compares row by row
    "numbra.kmeans.min-width": "64",  # columns times clusters
    "numbra.logistic.min-width": "32",
    "numbra.block.rows": "4096",  # rows of a block of vectors
}


def build_session(app: str = "numbra", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution; `conf` overrides, with _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # a keyword cannot hold dots
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # wide scores make methods that the JVM would not compile; beyond this size operators generate their own, split ones
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()


def setting(spark: SparkSession, key: str) -> str:
    """A configuration value of ours, or its default."""
    return spark.conf.get(key, DEFAULTS[key])


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where none is set, a local master gets a folder of our own;
    on a cluster that would be a folder that other machines do not see, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='numbra-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with files in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/numbra-{what}-{uuid.uuid4().hex}"
