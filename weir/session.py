"""Session helpers: where durable intermediate data lives, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "weir", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def plain_unions(spark: SparkSession) -> None:
    """Has unions planned without a claim about how their rows are dealt.

    Spark 4.1 takes a union of inputs that are dealt alike as dealt alike itself, but adaptive execution may still change one of
    the inputs; rows with one key then meet in different tasks, and a window or grouping behind the union gives wrong rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Bytes of rows in one Arrow batch between Spark and its Python workers.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has rows handed to Python workers in batches of bounded size, unless the session names a bound of its own.

    The default of 10,000 rows or 64 MB is held several times over, in the executor's buffers and in each worker, and neither
    gives all of it back while the session lasts.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`, or a local one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing exists there yet."""
    path = f"{shared_dir(spark)}/weir-{label}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this process left in the shared folder; only once no DataFrame needs it any more."""
    count = len(_scratch)
    while _scratch:
        delete_path(spark, _scratch.pop())
    return count


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """The same rows, read back from a table written to the shared folder.

    Nothing is computed twice, lost executors cost nothing, and unlike a checkpointed RDD the files
    have sizes and column statistics, so later joins are planned on facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """The file system that owns `path`, and the path object, for renames and existence tests."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_fs(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_fs(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = hadoop_fs(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, target = hadoop_fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def swap_path(spark: SparkSession, staged: str, final: str) -> None:
    """Puts a finished directory in the place of `final`; the old content is removed last."""
    fs, source = hadoop_fs(spark, staged)
    _, target = hadoop_fs(spark, final)
    _, backup = hadoop_fs(spark, f"{final}.old-{uuid.uuid4().hex[:8]}")
    had_old = fs.exists(target)
    if not had_old and target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if had_old and not fs.rename(target, backup):
        raise RuntimeError(f"could not move {final} aside")
    if not fs.rename(source, target):
        if had_old:
            fs.rename(backup, target)
        raise RuntimeError(f"could not publish {staged} as {final}")
    if had_old:
        fs.delete(backup, True)
