"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}
#: Rows of text that go to Python at once.
TEXT_ROWS = 1_000


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recordloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine; on a cluster
    executors could not read each other's files there, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        application = spark.sparkContext.applicationId
        base = _LOCAL.get(application) or _LOCAL.setdefault(application, tempfile.mkdtemp(prefix="recordloom-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, and a session whose Arrow batches have TEXT_ROWS rows at most.

    Texts are long, and a batch is held several times on its way to Python and back. The
    setting is only ever lowered, and results do not depend on it.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df
