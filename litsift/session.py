"""Session helpers: a tuned local session for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale as much as locally: AQE re-plans joins, coalesces small
# shuffle partitions and splits skewed ones (a hot title, author or token may hold a third
# of all rows).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "litsift") -> SparkSession:
    """Build (or reuse) a session with the engine's settings. Neither the master nor the number
    of shuffle partitions is set unless asked for."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.showConsoleProgress", "false")
    if master:  # else whatever the submit command says
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", os.environ.get("LITSIFT_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only when neither
    is set (a test on one machine) do we create one and register it, so that
    ``DataFrame.checkpoint()`` and our written intermediate tables land in the same place.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        d = tempfile.mkdtemp(prefix="litsift-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never a machine-local temp dir)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/litsift/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``litsift`` importable in Python workers (needed by the mapInArrow scorer):
    zip the package once per application and register it with ``addPyFile``, which
    distributes it to every executor."""
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    d = shared_dir(spark)
    local = d[len("file:"):] if d.startswith("file:") else (d if d.startswith("/") else tempfile.mkdtemp())
    target = os.path.join(local, "litsift-pkg", uuid.uuid4().hex[:12])
    os.makedirs(target, exist_ok=True)
    archive = shutil.make_archive(os.path.join(target, "litsift"), "zip", root_dir=root, base_dir="litsift")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
