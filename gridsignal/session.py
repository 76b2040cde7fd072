"""Session construction and access to the table folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gridsignal", **conf: str) -> SparkSession:
    """The running session, or a new one with UTC time and adaptive execution.

    ``conf`` adds or overrides settings (use ``**{"spark.x.y": "z"}``). A running session keeps its own settings.
    """
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession, fallback: str = "spark-warehouse/checkpoints") -> None:
    """Make ``checkpoint()`` usable.

    The folder named by ``spark.checkpoint.dir`` is taken when the session has one; ``fallback`` (a local folder, for
    single-machine sessions and tests) only when nothing is set. On a cluster, whose machines don't share local folders,
    the setting must be there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or fallback)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, which all executors share.

    Computes it once, cuts the lineage, and later reads take only the columns they need. The table stays until the
    folder is cleaned.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the schema is known: reading footers for it would be a job of its own
    return spark.read.schema(df.schema).parquet(path)
