"""A local session with the settings that tests and benchmarks share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(master: str = "local[*]", shuffle_partitions: int = 8, checkpoint_dir: str | None = None, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tidewheel")
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.adaptive.enabled": "true",
    }
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package's code to the executors' Python workers, once for each application.

    They share no folders with the driver on a cluster, and functions are pickled by their modules' names.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidewheel_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidewheel-")  # served from here as long as the driver lives
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/tidewheel.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._tidewheel_shipped = True


#: Temporary folders of local sessions.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where the session names none, a temporary one, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="tidewheel-shared-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], True)
    return "file://" + _OWN[sc.applicationId]
