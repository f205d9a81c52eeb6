"""Session settings and the shared scratch area."""
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loadtide", cores: str = "*", **conf) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (SparkSession.builder.appName(app).master(f"local[{cores}]")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", "12g"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="loadtide-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's own folder below the shared one; the folder goes when the application ends."""
    sc = spark.sparkContext
    run = os.path.join(shared_dir(spark), f"run-{sc.applicationId}")
    path = sc._jvm.org.apache.hadoop.fs.Path(run)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path) and fs.mkdirs(path):
        fs.deleteOnExit(path)
    return os.path.join(run, f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, label: str = "cut", by: list[str] = ()) -> DataFrame:
    """Write and read back: survives executor loss, unlike a local checkpoint. ``by`` lays out folders that later filters prune."""
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*frames: DataFrame, shuffles: bool = False) -> None:
    """Delete the folders of tables from ``cut_lineage`` that nothing will read again; other frames are left alone.

    Call it when everything made of them is written. With ``shuffles`` the JVM is asked to collect what finished steps held, so that Spark drops their
    shuffle files too: a loop then needs the disk of its last round, not of all.
    """
    for df in frames:
        path, sc = df.__dict__.get("scratch"), df.sparkSession.sparkContext
        if path:
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
        if shuffles:
            gc.collect()
            sc._jvm.System.gc()
            shuffles = False
