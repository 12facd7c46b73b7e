"""Tables on the folder that driver and executors share, and order numbers that need no single task."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

log = logging.getLogger(__name__)
_BUILT: dict[tuple, tuple[tuple, DataFrame]] = {}
_LOCAL: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without it gets a temporary folder, a cluster without it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """The folder for this application's tables. A local application's folder goes when Python ends; on a cluster release() deletes it."""
    path = f"{shared_root(spark)}/tables-{spark.sparkContext.applicationId}"
    if spark.sparkContext.master.startswith("local") and path not in _LOCAL:
        _LOCAL.add(path)
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; DataFrames that read them are void then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _BUILT if k[0] == spark.sparkContext.applicationId]:
        del _BUILT[key]


def write_shared(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


VECTORED = "parquet.hadoop.vectored.io.enabled"


def plain_reads(spark: SparkSession) -> None:
    """From now on this session reads Parquet without Hadoop's vectored reads, if the shared folder is in a local or mounted file system and
    the session doesn't say otherwise. There, every thread that reads so keeps a buffer outside the heap, as large as the largest column
    chunk it met."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if spark.conf.get(VECTORED, conf.get(VECTORED)) is None and root.getFileSystem(conf).getUri().getScheme() == "file":
        spark.conf.set(VECTORED, "false")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def listing(spark: SparkSession, path: str) -> tuple:
    """Path, size and time of change of each file at or below path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def built(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """The table `name` built from the files at `source` in this application: built and written once, then read, and built anew when the
    files have changed."""
    key, now = (spark.sparkContext.applicationId, name, source), listing(spark, source)
    if key not in _BUILT or _BUILT[key][0] != now:
        log.info("building %s from %s: %d files", name, source, len(now))
        _BUILT[key] = now, write_shared(build(), name)
    return _BUILT[key][1]


def few_values(df: DataFrame, column: str, most: int = 1000) -> list | None:
    """The different values of a column other than null, if there are `most` at most."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    return None if len(rows) > most else sorted(r[0] for r in rows)


def narrowed(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """df, without rows whose value isn't in that column of wanted, if there are few such values: what is sorted by them is read in part."""
    few = few_values(wanted, column)
    return df if few is None else df.where(F.col(column).isin(few)) if few else df.where("false")


def numbered(df: DataFrame, order: list[str], number: str = "line_num", running: Column | None = None) -> DataFrame:
    """Adds a gapless 1-based number in the order of unique columns, or, with running, the sum of that expression over all rows before.

    Rows are dealt by range and written; only one count for each partition meets in one place.
    """
    dealt = write_shared(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    amount = F.lit(1) if running is None else running
    sums = dealt.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(*order)
    if running is None:
        value = F.row_number().over(own) + F.col("_before")
    else:
        value = F.coalesce(F.sum(running).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
    value = value.cast("long") if running is None else value
    return dealt.join(F.broadcast(before), "_part").withColumn(number, value).drop("_part", "_before")  # a row for each partition
