"""Spark session defaults and the shared scratch folder.

Everything here is plain configuration a Spark user would set: UTC session zone (all
domain times are wall-clock TIMESTAMP_NTZ), AQE with partition coalescing and skew-join
splitting, and a checkpoint folder that must be shared storage on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults tuned for local[N] tests; a cluster passes its own.
LOCAL_SHUFFLE_PARTITIONS = 8
BROADCAST_THRESHOLD_BYTES = 32 * 1024 * 1024
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
#: Most bytes of files or shuffled rows that one task sorts or hashes. Rows here are narrow and
#: compress to 10 to 40 bytes, so that Spark's 128 and 64 MB are millions of rows a task.
TASK_BYTES = 16 * 1024 * 1024


def build_session(master: str | None = None, app: str = "scorecast",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or LOCAL_SHUFFLE_PARTITIONS),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Static planner and AQE both broadcast only below a measured/estimated size.
        "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_THRESHOLD_BYTES),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_THRESHOLD_BYTES),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Remove RDD checkpoint files once nothing references the checkpointed data.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Pin the settings results depend on (not performance knobs) on a foreign session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def bound_tasks(spark: SparkSession, total_bytes: int) -> None:
    """Let tasks grow in number with the input, not in size, so that their sorts and hash tables
    stay in memory at any size. Smaller settings of the session stay.

    Joins on more than the buckets' columns may use the buckets as they lie: the other side is
    brought to them, and the stored table is not shuffled."""
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        least = 2 * TASK_BYTES if "files" in key else TASK_BYTES
        jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
        if jvm.byteStringAsBytes(spark.conf.get(key)) > least:
            spark.conf.set(key, str(least))
    start = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(total_bytes, TASK_BYTES // 2))
    if int(spark.conf.get(start, None) or 0) < n:
        spark.conf.set(start, str(n))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a local
    session without one gets a private folder under the system temp dir; a cluster
    session without a configured shared folder is an error, never a node-local path.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)  # set on the session after the context started
        if configured.startswith("file:"):
            configured = configured[len("file:"):]
        return configured.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. HDFS/S3) "
                           "before running jobs that cut lineage")
    path = tempfile.mkdtemp(prefix="scorecast-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused sub-folder of this application's part of the scratch dir."""
    return f"{scratch_dir(spark)}/run-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's per-call folders, when its results are no longer read. The
    stored domain tables, which later applications reuse, stay."""
    fs, p = _hadoop_path(spark, f"{scratch_dir(spark)}/run-{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_committed(spark: SparkSession, path: str) -> bool:
    """True when a Spark write to ``path`` finished (its _SUCCESS marker exists)."""
    fs, p = _hadoop_path(spark, path)
    return bool(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def path_signature(spark: SparkSession, path: str) -> str:
    """Length and modification time of a file or folder (changes when the input changes)."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return "missing"
    st = fs.getFileStatus(p)
    if st.isDirectory():
        parts = sorted(f"{c.getPath().getName()}:{c.getLen()}:{c.getModificationTime()}" for c in fs.listStatus(p))
        return "|".join(parts)
    return f"{st.getLen()}:{st.getModificationTime()}"


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Atomically move a finished write into place; if another writer already published
    ``final`` (a concurrent ingest of the same input), keep theirs and drop ours."""
    fs, src = _hadoop_path(spark, staged)
    _, dst = _hadoop_path(spark, final)
    # A rename onto an existing folder would move the copy inside it.
    if path_committed(spark, final) or not fs.rename(src, dst):
        fs.delete(src, True)
        return
    inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dst, src.getName())
    if fs.exists(inside):  # another writer published between the check and the rename
        fs.delete(inside, True)


def materialize(df, name: str):
    """Write ``df`` once to the shared scratch folder and read it back: cuts the lineage,
    evaluates the input once, and gives the planner the result's measured bytes, from
    which it alone decides whether a join broadcasts it."""
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the given files or folders (Hadoop FS content summary)."""
    total = 0
    for path in paths:
        fs, p = _hadoop_path(spark, path)
        if fs.exists(p):
            total += fs.getContentSummary(p).getLength()
    return total


def partitions_for(total_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partitions of about ``target_bytes`` that hold ``total_bytes``; no upper limit."""
    return max(1, -(-total_bytes // target_bytes))


def size_for_input(spark: SparkSession, total_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Size scans and shuffles so partitions stay near ``target_bytes`` (fit in executor
    memory, spill rarely): one shuffle partition per target-sized slice of the input,
    never fewer than the cores, AQE coalescing small ones at runtime. Returns the count."""
    cores = spark.sparkContext.defaultParallelism
    n = max(cores, partitions_for(total_bytes, target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    return n

