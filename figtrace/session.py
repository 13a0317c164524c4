"""Session settings the operators are tuned for, and the shared folder they stage into."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from figtrace.errors import SourceError

# Adaptive execution sizes the shuffles and splits skewed join partitions; the force flag lets it
# split them even where that costs one more exchange below.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Where local sessions without a shared folder stage, by application.
_LOCAL: dict[str, str] = {}


def build_session(app: str = "figtrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate, in the shared folder of ``spark.checkpoint.dir``.

    Where that is unset a local session, as in tests, stages under a temporary folder of its own and the session's
    settings stay as they are; a cluster session is refused, because its executors do not share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL[app] = _LOCAL.get(app) or tempfile.mkdtemp(prefix="figtrace-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
