"""Session building and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "memloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults; keyword ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: A row group of usual size; a table of fewer bytes a core may sit in fewer row groups than there are cores.
ROW_GROUP_BYTES = 128 << 20


def spread(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """A small stored table dealt out to all cores.

    A file is read by row groups, so a table of few of them keeps few cores busy, however much work a row is. Dealing
    out so little data is cheap; larger tables have more row groups than cores and stay as they are. So do tables of no
    more than ``least`` bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if least < size < cores * ROW_GROUP_BYTES else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="memloom-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "memloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
