"""Shared plumbing of the training-data operators: shared-folder tables, Arrow batch sizes, hot-key joins, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.shipping import ship

#: Bytes of a row group in tables whose rows take megabytes.
GROUP_BYTES = 4 << 20
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one, but only if all run on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="loomline-")
    return f"file://{_own_dirs[app]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomline/{label}-{uuid.uuid4().hex}"


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Intermediate tables of one call, written to the shared folder and read back: that cuts the lineage and survives lost executors.

    A table is deleted as soon as it is dropped, the rest when the ``with`` block ends, but for those that were kept
    because a lazy result still reads them.

    Parquet's writer holds a row group, and at least a hundred rows of it; Spark's vectorized reader holds up to 4096 rows of a
    group. ``large`` is for rows that take megabytes: then groups end at ``GROUP_BYTES``, or after a row or two.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame, label: str, large: bool = False) -> DataFrame:
        path = fresh_path(self.spark, label)
        groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1} if large else {}
        df.write.options(compression="zstd", **groups).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.at.pop(id(t))[1])

    def keep(self, table: DataFrame) -> DataFrame:
        del self.at[id(table)]
        return table

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.at.values()])


def saved(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder that stays there, for lazy results to read."""
    return (tables := Tables(df.sparkSession)).keep(tables.save(df, label))


def small_batches(spark: SparkSession, rows: int = 10000, size: str = "4m") -> None:
    """Bound an Arrow batch by bytes, as texts may be very long, and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with ``fn(iterator of dicts of columns) -> iterator of dicts of columns``."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns():
            for b in batches:
                yield {n: b.column(i) for i, n in enumerate(b.schema.names)}

        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give back what Arrow and the C library keep of freed memory: workers and the driver outlive a stage, and the next one's objects lie elsewhere."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Null texts count as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def attach_by_key(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key``, where a key may hold most rows.

    Classes with at least 1/``share`` of all rows number ``share`` at most, whatever the input: these are broadcast,
    so that their rows never meet in one task. All others are shuffled by key.
    """
    least = max(1, -(-total // share))
    hot = classes.filter(F.col(size) >= least)
    cold = classes.filter(F.col(size) < least)
    hot_rows = rows.join(F.broadcast(hot), key, "inner")
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "inner")
    return hot_rows.unionByName(cold_rows)


def _starred(edges: DataFrame) -> bool:
    """Whether each larger node has one edge, and no smaller node has an edge to a smaller one still."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").limit(1).count()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of the edges (a, b) but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while (low[x] != low[y]).any():
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], m)
        np.minimum.at(low, low[y], m)
        while (low[low] != low).any():
            low = low[low]
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[other], nodes[low[other]]


def _contracted(edges: DataFrame, tasks: int, most: int) -> DataFrame:
    """The stars of each of ``tasks`` parts of the edges; nothing is shuffled, and a task holds some ``most`` edges at a time."""

    def run(batches):
        a = b = kind = None
        for batch in batches:
            kind = batch["a"].type
            x, y = (batch[c].to_numpy(zero_copy_only=False) for c in "ab")
            a, b = (x, y) if a is None else (np.concatenate((a, x)), np.concatenate((b, y)))
            if len(a) >= most:
                a, b = stars(a, b)
                if 2 * len(a) > most:
                    yield {"a": pa.array(a, kind), "b": pa.array(b, kind)}
                    a = b = None
        if a is not None:
            a, b = stars(a, b)
            yield {"a": pa.array(a, kind), "b": pa.array(b, kind)}

    return map_batches(edges.coalesce(tasks), run, ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in "ab"))


def connected_components(edges: DataFrame, tables: Tables, most: int = 1 << 16) -> DataFrame:
    """(node, component) of an undirected graph given as columns ``a`` and ``b``; component is the smallest node.

    Tasks of ``most`` edges or fewer contract what they have to stars, in Python (0: none do); a graph of no more edges is done then. Over the stars
    of several tasks, large-star and small-star rounds alternate: each contracts the graph towards stars around the smallest
    node, until all are. Minima are combined before the shuffle, nodes with many edges are split by the adaptive skew join,
    and each round is a table in the shared folder that replaces the one before. Nodes without a partner do not appear.
    """
    edges = tables.save(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        tasks = max(1, -(-edges.count() // most)) if most else 0
        if tasks:
            contracted = _contracted(edges, tasks, max(most, 2))
            before, edges = edges, tables.save(contracted.distinct() if tasks > 1 else contracted, "edges")
            tables.drop(before)
        if tasks == 1 or _starred(edges):
            break
        # large star: each larger neighbour of u points to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, tables.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        tables.drop(before)
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
