"""Session helpers.

The library never builds a session by itself on a cluster; ``local_session`` is
for tests, the benchmark and notebooks.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "docketry", shuffle: int = 8,
                  memory: str = "12g", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (as ``--py-files`` would), once per context."""
    context = spark.sparkContext
    if getattr(context, "_docketry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docketry-package-")) / "docketry.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in root.rglob("*.py"):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._docketry_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    On a cluster ``spark.checkpoint.dir`` names it. Only where it is unset (local
    tests) is a machine-local folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="docketry-checkpoint-")
