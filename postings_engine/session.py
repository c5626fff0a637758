"""Session helpers: settings, where scratch data may live, and code shipping."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Temporary folders of local sessions that name no shared folder, by application.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "postings", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs in this package rely on (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may fall back to
    a temporary folder: on a cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="postings-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage; ``options`` are the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(*modules: str) -> None:
    """Send the named modules along with the functions that use them.

    Executors then need no installed copy of this package to run its few Python functions.
    """
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])
