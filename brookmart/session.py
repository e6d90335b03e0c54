"""Session settings that the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: One time zone for every text <-> time conversion; adaptive execution for skewed joins and partition sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "brookmart", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Folders of sessions without spark.checkpoint.dir, by application.
_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a session in one process may do
    without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="brookmart-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
