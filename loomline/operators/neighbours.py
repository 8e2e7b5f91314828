"""Exact nearest neighbours that leave most of the pool unseen: pivots, the triangle inequality, and blocks of like distance.

Each vector of the pool belongs to its nearest pivot and is stored in order of its distance to it, in blocks. A query's distances
to the pivots bound its distance to all vectors of a block from below; blocks beyond the best distance known are skipped. The
first round looks at the blocks about the query's own place, the second at the blocks that may still hold something nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.shipping import ship
from loomline.plans.registry import load, query
from loomline.sources import sinks

#: Pivots at most; vectors of a block; queries that meet a block in one row.
PIVOTS, BLOCK, GROUP = 64, 256, 256
_SLACK = 1e-9

_BLOCKS = "cell int, block bigint, lo double, hi double, ids binary, vectors binary"


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact to rounding: sums of squared differences, row by row."""
    return np.stack([np.sqrt(((b - x) ** 2).sum(1)) for x in a]) if len(a) else np.zeros((0, len(b)))


def pivots_of(pool: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """At most ``most`` vectors far from one another, among the 16 * ``most`` with the least hash of their id: a bounded sample, which changes cost only."""
    got = pool.orderBy(F.xxhash64("vec_id"), "vec_id").limit(16 * most).select("embedding").collect()
    some = np.array([r[0] for r in got], float)
    if not len(some):
        return some
    chosen, far = [0], _distances(some[:1], some)[0]
    while len(chosen) < min(most, len(some)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(some[chosen[-1:]], some)[0])
    return some[chosen]


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, embedding, the distances to all pivots, the nearest pivot and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column(1)), shared.value)
                near = d.argmin(1)
                far = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.list_(pa.float64())), far, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "embedding", "far", "cell", "r"])

    return df.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id bigint, embedding array<double>, far array<double>, cell int, r double")


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows in order of cell and distance, ``BLOCK`` of a cell at most to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            cell, r, ids, v = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(0).to_numpy(), _matrix(b.column(1))
            edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)) if len(cell) else []
            rows: list[tuple] = []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                for lo in range(a, z, BLOCK):
                    hi = min(z, lo + BLOCK)
                    rows.append((int(cell[lo]), number, float(r[lo]), float(r[hi - 1]), ids[lo:hi].astype("<i8").tobytes(), v[lo:hi].astype("<f8").tobytes()))
                    number += 1
            if rows:
                types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    return placed.select("vec_id", "embedding", "cell", "r").repartitionByRange("cell", "r", "vec_id").sortWithinPartitions("cell", "r", "vec_id").mapInArrow(run, _BLOCKS)


def _search(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(vec_id, near struct<dist, id>, seen): the nearest in the blocks that ``pairs`` (block, vec_id, embedding) ask for, and how many distances that took.

    A block's queries meet it in groups, so a block that all queries ask for is copied and spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(0)[i].as_py(), "<i8")
                v = np.frombuffer(b.column(1)[i].as_py(), "<f8").reshape(len(ids), -1)
                asked = b.column(2).slice(i, 1).flatten()
                own = asked.field(0).to_numpy()
                d = np.round(_distances(_matrix(asked.field(1)), v), 9)
                d[own[:, None] == ids[None, :]] = np.inf
                # ties go to the smaller id
                order = np.argsort(ids, kind="stable")
                at = order[d[:, order].argmin(1)]
                best = d[np.arange(len(own)), at]
                some = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(best[some]), pa.array(ids[at[some]]), pa.array(np.full(int(some.sum()), len(ids)), pa.int64())], names=["vec_id", "dist", "id", "seen"])

    grouped = pairs.groupBy("block", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("g")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    rows = blocks.select("block", "ids", "vectors").join(grouped.hint("merge"), "block").select("ids", "vectors", "q")
    found = rows.mapInArrow(run, "vec_id bigint, dist double, id bigint, seen bigint")
    return found.groupBy("vec_id").agg(F.min(F.struct("dist", "id")).alias("near"), F.sum("seen").alias("seen"))


def nearest_pruned(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(vec_id, nearest, dist, seen): each query's nearest other vector (L2 to 9 places, ties to the smallest id) and how many distances it took.

    Exact: a block is skipped only if the triangle inequality puts all of it farther than a vector already seen. Vectors have one
    length, and vec_id is unique. How much is skipped depends on the data: most of it where vectors form clusters, little where
    all distances are alike.
    """
    spark = pool.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    pivots = pivots_of(pool)
    if not len(pivots):
        return spark.createDataFrame([], "vec_id bigint, nearest bigint, dist double, seen bigint")
    base = sinks.scratch(spark, "pivots")
    _blocks(_placed(pool, pivots)).write.parquet(f"{base}/blocks")
    blocks = spark.read.parquet(f"{base}/blocks")
    _placed(queries, pivots).write.parquet(f"{base}/queries")
    asked = spark.read.parquet(f"{base}/queries")
    index = blocks.select("cell", "block", "lo", "hi")
    # first round: in the own cell the block about the own distance, and those at its sides
    around = asked.join(index, "cell").select("vec_id", "embedding", "block", F.greatest(F.col("lo") - F.col("r"), F.col("r") - F.col("hi"), F.lit(0.0)).alias("gap"))
    first = around.groupBy("vec_id").agg(F.min_by(F.struct("embedding", "block"), F.struct("gap", "block")).alias("m")).select("vec_id", "m.*")
    _search(first, blocks).write.parquet(f"{base}/first")
    known = spark.read.parquet(f"{base}/first")
    limit = F.coalesce(F.col("near.dist"), F.lit(float("inf"))) + _SLACK
    rows = asked.join(known, "vec_id", "left").withColumn("limit", limit).join(first.select("vec_id", F.col("block").alias("seen_block")), "vec_id", "left")
    # second round: cells by the bisecting plane to the own pivot, blocks by their ring about the pivot
    cells = rows.select("vec_id", "embedding", "limit", "r", "seen_block", F.posexplode("far").alias("cell", "d")).filter((F.col("d") - F.col("r")) / 2 <= F.col("limit"))
    ring: Column = (F.col("lo") <= F.col("d") + F.col("limit")) & (F.col("hi") >= F.col("d") - F.col("limit"))
    todo = cells.join(index, "cell").filter(ring & ~F.col("block").eqNullSafe(F.col("seen_block"))).select("vec_id", "embedding", "block")
    both = known.unionByName(_search(todo, blocks))
    out = both.groupBy("vec_id").agg(F.min("near").alias("m"), F.sum("seen").alias("seen"))
    return out.select("vec_id", F.col("m.id").alias("nearest"), F.col("m.dist").alias("dist"), "seen")


@query(
    "nn_pruned",
    """SELECT a.vec_id, (SELECT b.vec_id FROM embeddings b WHERE b.vec_id <> a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id LIMIT 1) AS nearest
    FROM embeddings a WHERE a.vec_id % 50 = 0""",
)
def nn_pruned(spark, d):
    """Nearest other vector of each query, every fiftieth row, against all rows, through pivots."""
    e = load(spark, d, "embeddings")
    return nearest_pruned(e.filter("vec_id % 50 = 0"), e).select("vec_id", "nearest")
