"""Session helpers: a tuned local session for tests and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "flowspark",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own builder."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    cores = int(master[6:-1]) if master.startswith("local[") and master[6:-1].isdigit() else 8
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders invented for local sessions without spark.checkpoint.dir, one per
# application. (The setting is a core config: it cannot be set at run time.)
_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; invented only on a
    local master where it is unset (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.conf.get("spark.app.id", None) or "local"
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="flowspark-")
    return _LOCAL_ROOTS[app]


def stable_dir(spark: SparkSession, *parts: str) -> str:
    """A fixed folder under the shared root (checkpoints that must survive restarts)."""
    return os.path.join(shared_root(spark), "flowspark", *parts)


def work_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``.

    The cluster names the shared folder; it is only invented here when the
    setting is missing on a local master (tests). Each call gets its own
    sub-folder, so runs never clear or reuse each other's files.
    """
    root = shared_root(spark)
    return os.path.join(root, "flowspark", *parts, uuid.uuid4().hex)
