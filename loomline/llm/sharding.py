"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries weights on its leaves; an inner node weighs what its leaves weigh. A row
descends from the root: at each node every child draws an exponential arrival time, ``-ln(u) / weight`` with ``u``
hashed from the row's key and the child's path, and the earliest child wins. A child's draw depends on nothing but the
key, its path and its weight, so a change of weight in one subtree moves rows only into or out of that subtree; two
siblings outside it never exchange rows. A shard that joins as a region of its own thus only takes rows, all into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class Node:
    """A subtree. A leaf has a shard number and a weight; an inner node weighs the sum of its children."""

    path: str
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return self.own_weight if self.shard is not None else sum(c.weight for c in self.children)


def tree(regions: dict[str, dict[str, dict[int, float]]]) -> Node:
    """Build the tree from {region: {rack: {shard: weight}}}."""
    return Node(
        "",
        tuple(
            Node(r, tuple(Node(f"{r}/{k}", tuple(Node(f"{r}/{k}/{s}", (), s, float(w)) for s, w in shards.items())) for k, shards in racks.items()))
            for r, racks in regions.items()
        ),
    )


def even_tree(shards: int = 8, racks: int = 2, regions: int = 2) -> Node:
    """Shards of weight 1, dealt to racks and regions as evenly as possible."""
    out: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        at = s * regions * racks // shards
        out.setdefault(f"region{at // racks}", {}).setdefault(f"rack{at % racks}", {})[s] = 1.0
    return tree(out)


def with_new_region(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree after one more shard joined, in a region of its own."""
    r = f"region-of-{shard}"
    return Node("", (*root.children, Node(r, (Node(f"{r}/rack0", (Node(f"{r}/rack0/{shard}", (), shard, weight),)),))))


def shard_of(key: Column, root: Node) -> Column:
    """The shard that ``key`` descends to. Draws use xxhash64 of the key and the child's path; all built-in expressions."""

    def draw(n: Node) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(n.path)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return -F.log(u) / F.lit(n.weight)

    def descend(n: Node) -> Column:
        if n.shard is not None:
            return F.lit(n.shard)
        alive = [c for c in n.children if c.weight > 0]
        if len(alive) == 1:
            return descend(alive[0])
        won = F.array_min(F.array(*[F.struct(draw(c).alias("t"), F.lit(i).alias("i")) for i, c in enumerate(alive)]))["i"]
        out = F.when(won == 0, descend(alive[0]))
        for i, c in enumerate(alive[1:], 1):
            out = out.when(won == i, descend(c))
        return out

    return descend(root)


def assign_shards(docs: DataFrame, root: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes plus 1; a null text has none), text_crc32, law, shard, slot, grown_shard.

    Only thin rows are shuffled, in key ranges; slots number a shard's rows by key, through per-range counts and their
    running sums, so that no task sees a whole shard. Rows with a null key hash alike, to one shard. Repeated rows get
    the same shard and slots of their own. Very long texts only count by their size. An empty table gives an empty
    result; extra columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    thin = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        shard_of(F.col(key), root).cast("int").alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    dealt = saved(thin.repartitionByRange(F.col(key).asc_nulls_first(), "text_crc32").withColumn("_range", F.spark_partition_id()), "shards")
    counts = dealt.groupBy("_range", "shard").agg(F.count("*").alias("_n"))
    before = counts.select("_range", "shard", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range", "shard").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size"))
    return (
        dealt.withColumn("_rank", rank)
        .join(before, ["_range", "shard"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"), "grown_shard")
    )
