"""Session builder and the shared folder that jobs may write intermediate data to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


TASK_BYTES = 128 << 20

# Input size in bytes (below), driver memory, executor memory, executors.
SIZING = (
    (500 << 20, "4g", "4g", 2),
    (5 << 30, "8g", "4g", 2),
    (30 << 30, "16g", "8g", 2),
    (None, "16g", "16g", 4),
)


def settings_for(input_bytes: int, cores_per_executor: int = 4) -> dict[str, str]:
    """Memory and executors by input size, and enough shuffle partitions to fit in them.

    The table ends at 4 executors; beyond its last step, executors grow with the input.
    Adaptive execution joins partitions that turn out small.
    """
    driver, executor, count = next(
        (d, e, n) for limit, d, e, n in SIZING if limit is None or input_bytes < limit
    )
    partitions = max(200, -(-input_bytes // TASK_BYTES))
    waves = 200
    return {
        "spark.driver.memory": driver,
        "spark.executor.memory": executor,
        "spark.executor.cores": str(cores_per_executor),
        "spark.executor.instances": str(max(count, -(-partitions // (waves * cores_per_executor)))),
        "spark.sql.shuffle.partitions": str(partitions),
    }


def get_session(app_name: str = "stratiform", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``conf`` keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="stratiform-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python tasks this package, wherever the driver was started from."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId not in _shipped and root.is_dir():
        target = os.path.join(tempfile.mkdtemp(prefix="stratiform-"), root.name)
        context.addPyFile(shutil.make_archive(target, "zip", root.parent, root.name))
        _shipped.add(context.applicationId)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), "stratiform", f"{label}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, and is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
