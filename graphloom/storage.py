"""Shared staging storage: every intermediate that must survive a lost executor goes through here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors, as the session names it in spark.checkpoint.dir.

    Where the setting is absent (tests, a laptop) a temporary folder is chosen once and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-stage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths handed out in this driver, for clear_stages().
_staged: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def clear_stages(spark: SparkSession) -> int:
    """Delete all that this driver has staged, and say how many paths there were. Results read staged tables until they are written
    or collected, so this is for the end of a job."""
    paths, _staged[:] = list(_staged), []
    for path in paths:
        fs, target = file_system(spark, path)
        fs.delete(target, True)
    return len(paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and reread it: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the batches in which rows go to Python workers and come back, a little less than the most that an operator works on at once.
BATCH_BYTES = 15 << 19


def bound_batches(spark: SparkSession) -> None:
    """Long rows go to Python workers in batches of BATCH_BYTES, where the session sets no bound of its own: Spark alone counts rows,
    10000 at a time, and holds a batch on both sides."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df: file sizes for scans, products for joins, huge where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """How many hash buckets of about bytes_each to cut df into: between the session's shuffle partitions and 64 times as
    many. Estimates beyond a pebibyte count as unknown, for which it is 4 times as many."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
    size = plan_bytes(df)
    return min(max(size // bytes_each, tasks), 64 * tasks) if size < 1 << 50 else 4 * tasks


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_row_id(df: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with a column name, unique and not null, that rises by id (null last) and then by text: the id itself where ids are
    unique. Only where some are null or repeat is the table sorted and staged; equal rows are told apart by place, so that
    the sort can split them."""
    ids = F.col(id_col).cast("long")
    if df.groupBy(ids.alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null").isEmpty():
        return df.withColumn(name, ids)
    ordered = df.withColumn(name, F.monotonically_increasing_id()).orderBy(ids.asc_nulls_last(), F.col(text_col), name)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()), "row-ids")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path in any store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def put_in_place(spark: SparkSession, fresh: str, path: str) -> None:
    """Rename fresh to path, in place of what is there: a reader sees the old folder or the new one, never a part of one."""
    fs, target = file_system(spark, path)
    old = file_system(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(file_system(spark, fresh)[1], target):
        raise OSError(f"cannot put {fresh} in place")
    if had:
        fs.delete(old, True)


def replace_table(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Write beside path, then put the result in its place."""
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    rows.write.format(kind).save(fresh)
    put_in_place(rows.sparkSession, fresh, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file in any store, in place of what is there."""
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
