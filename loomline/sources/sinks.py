"""Ledger-style writes on plain files: each is a function from tables to the table after it, ready to be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one where all run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def large_dictionaries(spark: SparkSession, *long: str, size: int = 64 << 20) -> None:
    """Let Parquet files that this session writes from now on keep ``size`` bytes of a column's distinct values in a dictionary (1 MB by default).

    Long values that many rows repeat are then written once a file, not once a row. A writer holds that many bytes a column at most;
    a column whose values hardly repeat goes without, as Parquet's first page tells. Columns named in ``long`` get no least and greatest
    value, as these are compared with every row's whole value. Set and left set, as results are lazy.
    """
    spark.conf.set("parquet.dictionary.page.size", str(size))
    for name in long:
        spark.conf.set(f"parquet.column.statistics.enabled#{name}", "false")


def append_pending(table: DataFrame, new: DataFrame, status: str = "status") -> DataFrame:
    """``table`` and the new rows, which are pending; columns they lack are null."""
    return table.unionByName(new.withColumn(status, F.lit("PENDING")), allowMissingColumns=True)


def cache_entries(rows: DataFrame, output: Column, grade: Column, slotted: Column, put: Column, days: int = 30) -> DataFrame:
    """``rows`` with ``l1`` and ``l2``, whether a cache takes them whole or as a template, and ``expires``; a read keeps what hasn't expired."""
    full = F.coalesce(F.trim(output), F.lit("")) != ""
    taken = lambda c: F.coalesce(full & c, F.lit(False))
    return rows.withColumns({"l1": taken(grade != "REJECTED"), "l2": taken((grade == "VERIFIED") & slotted), "expires": put + F.expr(f"interval {days} days")})


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key isn't in ``table``, one a key: what an append would add."""
    return new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key, column by column where they have a value."""
    rest = [c for c in table.columns if c not in keys]
    old, fresh = table.alias("old"), new.alias("new")
    return old.join(fresh, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) if c in new.columns else F.col(f"old.{c}") for c in rest])


def compare_and_set(table: DataFrame, wanted: Column, column: str, expected: list[str], to: str) -> DataFrame:
    """The table with ``column`` set to ``to`` where ``wanted`` holds and the value was an expected one, and ``applied``."""
    hit = F.coalesce(wanted & F.col(column).isin(expected), F.lit(False))
    return table.withColumn("applied", hit).withColumn(column, F.when(hit, F.lit(to)).otherwise(F.col(column)))


def update_from(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set the changes' columns on the rows of their key; a null change leaves the value."""
    cols = [c for c in changes.columns if c != key]
    named = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = table.join(named, key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    return out.select(table.columns)


def resume_append(done_path: str, rows: DataFrame, key: str) -> int:
    """Append as JSON lines the rows whose key the output doesn't have yet; gives back how many."""
    spark = rows.sparkSession
    try:
        done = spark.read.json(done_path).select(F.col(key))
        todo = rows.join(done, key, "left_anti")
    except Exception as e:  # no output yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e) and "UNRESOLVED_COLUMN" not in str(e):
            raise
        todo = rows
    todo = todo.cache()
    n = todo.count()
    todo.write.mode("append").json(done_path)
    todo.unpersist()
    return n


def write_versioned(df: DataFrame, path: str, versions: dict[str, str]) -> None:
    """A cache table partitioned by its versions: a new version is a new partition, and reads prune the others."""
    for k, v in versions.items():
        df = df.withColumn(k, F.lit(v))
    df.write.mode("append").partitionBy(*versions).parquet(path)


def write_report(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def split_dead_letters(rows: DataFrame, error: str = "error_class", message: str = "message", most: int = 400) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, dead letters with their message cut)."""
    dead = rows.filter(F.col(error).isNotNull()).withColumn(message, F.substring(message, 1, most))
    return rows.filter(F.col(error).isNull()), dead
