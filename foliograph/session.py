"""Session construction, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest payload an operator may broadcast explicitly, in bytes of its serialised form.
BROADCAST_LIMIT_BYTES = 8 << 20


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "foliograph") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a session on one machine that names none gets a folder of its own,
    which goes with the process; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foliograph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` as a table in the shared folder and forget its lineage.

    The rows come back from files with their schema and real sizes only: over
    iterations of joins, lineage and estimated sizes would grow without bound.
    Any executor can read them again. Rows keep no order.
    """
    spark, path = df.sparkSession, _new_table(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def cut_parts(df: DataFrame, by: str, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """As `cut`, for several tables in one write: all rows, and apart those with 0, 1, ... in the integer column `by`, without it.

    Each plan that runs costs the driver memory for long, its size hardly
    matters: tables of one schema go through one. `release` takes all rows.
    """
    spark, path = df.sparkSession, _new_table(df.sparkSession)
    df.write.partitionBy(by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    rest, apart = T.StructType([f for f in df.schema if f.name != by]), []
    for k in range(parts):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={k}")
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        apart.append(spark.read.schema(rest).parquet(f"{path}/{by}={k}") if there else spark.createDataFrame([], rest))
    return out, apart


def _new_table(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def rows_of(df: DataFrame, enough: int = 1) -> int:
    """Rows of a table that `cut` wrote, by its files' footers, which are read until there are `enough`; no plan runs for it."""
    spark = df.sparkSession
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    folder = jvm.org.apache.hadoop.fs.Path(df._written)
    for f in folder.getFileSystem(conf).listStatus(folder):
        if n < enough and f.getPath().getName().endswith(".parquet"):
            footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(f, conf))
            n += footer.getRecordCount()
            footer.close()
    return n


def cut_in_order(df: DataFrame) -> DataFrame:
    """Materialise `df` by a checkpoint, which keeps partitions and the order of their rows as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame | None) -> None:
    """Delete the tables that `cut` wrote for these frames, and let go of what they kept; nothing may read them afterwards.

    Shuffle files and broadcasts of frames out of reach go only once the
    driver's JVM has collected them, which an iteration of small plans would
    put off for long.
    """
    jvm = None
    for df in frames:
        path = getattr(df, "_written", None)
        if path and (jvm := getattr(df.sparkSession, "_jvm", None)):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    if jvm is not None:
        gc.collect()
        jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Give back to the system what the driver's JVM has freed outside its heap.

    glibc keeps such memory in arenas, one for each of some 64 threads, and the
    driver of many small plans has hundreds of threads. A command of HotSpot on
    Linux; nothing happens where it is missing.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised `df` only after measuring that it fits `limit`.

    Beyond the limit the frame comes back without a hint and Spark shuffles it.
    """
    row = df.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(df) if (row["b"] or 0) <= limit else df


def broadcast_if_few(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """As `broadcast_if_small`, for a table of ids that `cut` wrote, each taken for 16 bytes: its rows are known without a plan."""
    most = limit // (16 * len(df.columns))
    return F.broadcast(df) if rows_of(df, most + 1) <= most else df
