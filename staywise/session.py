"""Session helpers: a local session for tests, and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()
# Branches are fitted from threads of one session; an archive may be registered only once.
_SHIPPING = threading.Lock()


def local_session(cores: int | str = "*", name: str = "staywise", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers import it there, wherever the driver was started.
    """
    spark = spark or SparkSession.active()
    application = spark.sparkContext.applicationId
    with _SHIPPING:
        if application not in _SHIPPED:
            package = os.path.dirname(os.path.abspath(__file__))
            archive = os.path.join(tempfile.mkdtemp(prefix="staywise-code-"), os.path.basename(package))
            shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
            spark.sparkContext.addPyFile(f"{archive}.zip")
            _SHIPPED.add(application)


def work_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="staywise-")
        root = _LOCAL_ROOTS[context.applicationId]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the working folder; nothing is created yet."""
    return f"{work_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Iterative jobs read such a table many times. Unlike a cache it survives
    executor loss, and unlike a checkpoint it keeps column and partition pruning.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
