"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "roadweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC wall-clock timestamps and skew handling on.

    Real feeds carry Taipei wall-clock times; pass
    ``**{"spark.sql.session.timeZone": "Asia/Taipei"}`` for them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is taken from the session. Only where it is unset
    and the master is local (tests) is a folder made, once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = tempfile.mkdtemp(prefix="roadweave-")
    return _MADE[app]


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which ``clear_scratch`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove what this application has stored below the shared folder; returns the number of folders.

    Results that were not written elsewhere read from there, so call it when they are used.
    """
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(target.getFileSystem(conf).delete(target, True))
    return gone


def materialize(df, name: str):
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

