"""Session helpers: a tuned SparkSession and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale; all can be overridden by the cluster's
# spark-defaults or by the caller.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "lectern",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is only set when given, so on a cluster the launcher's
    master wins.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3,
    ...) and is used as is. Only a bare local session (tests) gets a fresh
    folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a shared folder is needed "
                "on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="lectern-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/lectern/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes of rows that Spark hands to Python in one Arrow batch, where an
#: operator asks for small ones.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` in this session: a job that
    sends whole texts to Python in several stages holds some batches at once,
    in the JVM and in its workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)([a-z]*)\Z", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit[:1], 0)
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
