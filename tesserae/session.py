"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans expect; a cluster's own settings win over these.

    UTC pins timestamps, adaptive execution re-plans joins and skew at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints that nothing refers to any more are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One stored table of a data directory."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write df to the reliable checkpoint folder and read it from there: lineage ends here.

    The folder is the one that the session names in ``spark.checkpoint.dir`` (shared by all
    executors). Only where that is unset, as in tests on one machine, a temporary folder is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tesserae-ckpt-"))
    return df.checkpoint(eager)
