"""Session construction and the shared scratch folder.

On a cluster the scratch folder is the one the cluster names in
``spark.checkpoint.dir`` (a shared, fault-tolerant file system). Only when the
session has none, as in tests and local runs, do we create one.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# HotSpot leaves a method of more bytecode than this interpreted. A projection with all rules is longer as one fused
# method; beyond the limit Spark evaluates it by many small methods instead, which are compiled.
JIT_METHOD_BYTES = 8000

# Arrow batches to and from Python are bounded by bytes, too: 10,000 long texts are tens of MB, held by the JVM and
# again by the worker, for every core.
ARROW_BATCH_BYTES = 4 << 20

DEFAULT_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
    # the fused validation stage is one large generated method; let HotSpot JIT it
    # (by default methods over 8000 bytecodes stay interpreted)
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def build_session(master: str = "local[*]", app: str = "razonete", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> None:
    """Settings every plan in this package relies on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_BYTES))
    bound_arrow_batches(spark)
    checkpoint_root(spark)


def bound_arrow_batches(spark: SparkSession) -> None:
    """Batches of at most about ``ARROW_BATCH_BYTES`` for the Python workers (idempotent)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint directory).
    Sets a local one only when neither is configured and the master is local.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local context (e.g. a remote client)
        root = _conf_or_none(spark, "spark.checkpoint.dir")
        if not root:
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share") from None
        return root.rstrip("/")
    root = sc.getCheckpointDir()
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None) or _conf_or_none(spark, "spark.checkpoint.dir")
        if not root:
            if not re.fullmatch(r"local(\[[^,\]]+(,[^\]]+)?\])?", sc.master):
                raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="razonete-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


class NoSharedFolder(RuntimeError):
    """On a cluster, intermediate tables need a folder that every executor sees."""


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/razonete/{name}-{uuid.uuid4().hex[:12]}"


def _conf_or_none(spark: SparkSession, key: str):
    try:
        return spark.conf.get(key, None)
    except Exception:  # pragma: no cover - conf lookups never fail in practice
        return None
