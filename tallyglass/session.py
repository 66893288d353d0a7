"""Session settings the operators rely on, for local runs and tests.

On a cluster the deployment owns these settings; nothing here is needed beyond
what Spark 4 already sets by default except the UTC session time zone.
"""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "tallyglass", memory: str = "8g") -> SparkSession:
    parallelism = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; in local mode, a folder of our own where none is set."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyglass-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it installed."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tallyglass-package-")
    archive = shutil.make_archive(f"{folder}/tallyglass", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for results that are written and read back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
