"""Peak concurrency sweep: running counts, sums and highs of open intervals per group, by a distributed Fenwick tree over minutes.

A delta belongs to the cells of its minute's update chain, a moment sums the cells of its prefix chain. The cells of the lowest
``LEAF_BITS`` levels are packed, one row a group and block of 2^10 minutes, so that part of a chain is walked inside the row; the
rest of the chains, over blocks, is exploded and met by an equi join on (group, cell). Cells that combine by maximum instead of
sum give running highs, cells over mirrored positions the next moment, and the root cell a group's peak.

No key grows with the input: deltas are summed per group and minute before and after the shuffle, a block has at most 2^10
minutes, and a cell is copied so that at most 2^12 blocks meet one copy. The driver sees the first and last block's number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, attach_by_key, map_batches

#: Levels of the tree that a packed row holds.
LEAF_BITS = 10
#: Blocks that meet one copy of a cell, as a power of two.
COPY_BITS = 12
#: The group in which every interval counts again, and the one of intervals without a group: fixed values.
EVERYONE, NOBODY = -2, -1

_PACKED = "grp int, block long, pos list, n list, c list, high list, sum_n long, sum_c long, top long, first long"


def minute_of(ts: Column) -> Column:
    """Minutes since 1970 of a timestamp without a zone, rounded down; no session time zone takes part."""
    return F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def _fill(cells: np.ndarray, bits: int, op) -> np.ndarray:
    """Cells 1 to 2^bits of each row from values at their own places: a cell hands its content to the cell that covers it."""
    for level in range(bits):
        step = 1 << level
        at = cells[:, 2 * step :: 2 * step]
        op(at, cells[:, step :: 2 * step][:, : at.shape[1]], out=at)
    return cells


def _prefix(cells: np.ndarray, row: np.ndarray, place: np.ndarray, op, start: int) -> np.ndarray:
    """The combination of all values up to ``place``, by its prefix chain."""
    out, at = np.full(len(place), start, np.int64), place.copy()
    while (open_ := at > 0).any():
        out[open_] = op(out[open_], cells[row[open_], at[open_]])
        at &= at - 1
    return out


_NONE = np.iinfo(np.int64).min


def _pack(batches, bits: int):
    """From the changes of a block in order of time: running values relative to the block's start."""
    width = (1 << bits) + 1
    for b in batches:
        grp, block, changes = b["grp"].to_numpy(), b["block"].to_numpy(), b["changes"]
        for lo in range(0, len(grp), 256):
            some = changes.slice(lo, 256)
            sizes, flat = np.diff(some.offsets.to_numpy()), some.flatten()
            row = np.repeat(np.arange(len(some)), sizes)
            pos, dn, dc = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            place = pos + 1
            trees = []
            for d in (dn, dc):
                cells = np.zeros((len(some), width), np.int64)
                cells[row, place] = d
                trees.append(_prefix(_fill(cells, bits, np.add), row, place, np.add, 0))
            n, c = trees
            cells = np.full((len(some), width), _NONE, np.int64)
            cells[row, place] = n
            high = _prefix(_fill(cells, bits, np.maximum), row, place, np.maximum, _NONE)
            last = np.cumsum(sizes) - 1
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(x, pa.int64())) for x in (pos, n, c, high)]
            yield dict(zip(("pos", "n", "c", "high"), lists, strict=True)) | {
                "grp": pa.array(grp[lo : lo + 256], pa.int32()), "block": pa.array(block[lo : lo + 256], pa.int64()),
                "sum_n": n[last], "sum_c": c[last], "top": high[last], "first": block[lo : lo + 256] * (1 << bits) + pos[last - sizes + 1],
            }


def _low(i: Column) -> Column:
    return i.bitwiseAND(-i)


def _shift(name: str, i: Column, b: Column) -> Column:
    return F.call_function(name, i, b)


def _levels(size: int) -> Column:
    return F.sequence(F.lit(0), F.lit(size.bit_length() - 1))


def _covering(i: Column, size: int) -> Column:
    """The update chain: at each level the cell that ends a run of places with ``i`` in it, where there is one."""
    at = lambda b: _shift("shiftright", i - 1, b)
    cells = F.transform(_levels(size), lambda b: F.when(at(b) % 2 == 0, _shift("shiftleft", at(b) + 1, b)))
    return F.filter(cells, lambda c: c <= size)


def _prefix_cells(i: Column, size: int) -> Column:
    """The prefix chain: for each set bit of ``i`` the number without the bits below it."""
    return F.transform(F.filter(_levels(size), lambda b: _shift("shiftright", i, b) % 2 == 1), lambda b: _shift("shiftleft", _shift("shiftright", i, b), b))


def fenwick_prefix(rows: DataFrame, group: str, place: Column, upto: Column, size: int, values: dict, combine, root: dict | None = None) -> DataFrame:
    """``rows`` with, for each name of ``values`` (name -> column), the combination of that column over the group's rows whose place is at most ``upto``.

    Places are 1 to ``size``, a power of two. Rows update the cells of their place and ask for those of ``upto``; both meet by
    an equi join on group, cell and copy. ``root`` (name -> name of a value) adds the combination over the whole group.
    Results are null where nothing precedes.
    """
    cells = rows.select(group, F.explode(_covering(place, size)).alias("_cell"), *[v.alias(f"_{n}") for n, v in values.items()]).groupBy(group, "_cell").agg(*[combine(f"_{n}").alias(f"_{n}") for n in values])
    copies = F.greatest(F.shiftright(_low(F.col("_cell")), COPY_BITS), F.lit(1))
    cells = cells.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)))
    own = rows.columns
    ask = lambda cell, at, is_root: F.struct(cell.alias("_cell"), F.shiftright(at, COPY_BITS).cast("long").alias("_copy"), F.lit(is_root).alias("_root"))
    asks = F.transform(_prefix_cells(upto, size), lambda c: ask(c, upto - c, False))
    if root:
        asks = F.concat(asks, F.array(ask(F.lit(size).cast("long"), place - 1, True)))
    met = rows.withColumn("_ask", F.explode_outer(asks)).select(*own, "_ask.*").join(cells.hint("merge"), [group, "_cell", "_copy"], "left")
    chain = [combine(F.when(~F.coalesce("_root", F.lit(False)), F.col(f"_{n}"))).alias(n) for n in values]
    whole = [combine(F.when(F.col("_root"), F.col(f"_{v}"))).alias(n) for n, v in (root or {}).items()]
    return met.groupBy(*own).agg(*chain, *whole)


def sweep(deltas: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """(grp, from_s, to_s, n_open, open_cents, high_open, is_peak) from ``deltas`` (grp int, minute long, dn long, dc long).

    A row for each group and minute whose deltas do not cancel out. Deltas may repeat in any number and order, hot groups and
    minutes included; rows with a null group or minute take no part; an empty table gives no rows. Minutes may lie before 1970.
    """
    spark, width = deltas.sparkSession, 1 << leaf_bits
    rows = deltas.filter("grp is not null and minute is not null").groupBy("grp", "minute").agg(F.sum("dn").alias("dn"), F.sum("dc").alias("dc")).filter("dn <> 0 or dc <> 0")
    block = F.floor(F.col("minute") / width)
    changes = F.array_sort(F.collect_list(F.struct((F.col("minute") - block * width).alias("pos"), "dn", "dc")))
    blocks = rows.groupBy("grp", block.alias("block")).agg(changes.alias("changes"))
    schema = _PACKED.replace(" list", " array<long>")
    tables = Tables(spark)
    packed = tables.keep(tables.save(map_batches(blocks, lambda b: _pack(b, leaf_bits), schema), "sweep"))
    lo, hi = packed.agg(F.min("block"), F.max("block")).first()
    lo, span = (lo, hi - lo + 1) if lo is not None else (0, 1)
    size = 1 << (span - 1).bit_length()
    # thin rows, one a block that has changes; places are 1 to size
    thin = packed.select("grp", (F.col("block") - lo + 1).alias("place"), "sum_n", "sum_c", "top", "first")
    p, mirrored = F.col("place"), F.lit(size + 1).cast("long") - F.col("place")
    based = fenwick_prefix(thin, "grp", p, p - 1, size, {"base_n": F.col("sum_n"), "base_c": F.col("sum_c")}, F.sum)
    zero = F.lit(0).cast("long")
    based = based.select("grp", "place", "first", (F.col("top") + F.coalesce("base_n", zero)).alias("top"), F.coalesce("base_n", zero).alias("base_n"), F.coalesce("base_c", zero).alias("base_c"))
    highs = fenwick_prefix(based, "grp", p, p - 1, size, {"before": F.col("top")}, F.max, {"peak": "before"})
    ends = fenwick_prefix(highs, "grp", mirrored, mirrored - 1, size, {"after": F.col("first")}, F.min)
    lists = packed.select(F.col("grp").alias("g"), (F.col("block") - lo + 1).alias("at"), "block", F.arrays_zip("pos", "n", "c", "high").alias("z"))
    rows = lists.join(ends.hint("merge"), (F.col("g") == F.col("grp")) & (F.col("at") == p))
    nexts = F.concat(F.slice(F.col("z")["pos"], F.lit(2), F.size("z")), F.array(F.col("after") - F.col("block") * width))
    each = F.explode(F.arrays_zip("z", nexts.alias("to"))).alias("e")
    at = rows.select("grp", "block", "base_n", "base_c", "before", "peak", each).select("grp", "block", "base_n", "base_c", "before", "peak", "e.z.*", "e.to")
    n = F.col("n") + F.col("base_n")
    second = lambda k: (F.col("block") * width + F.col(k)) * 60
    return at.select(
        "grp", second("pos").alias("from_s"), second("to").alias("to_s"), n.alias("n_open"), (F.col("c") + F.col("base_c")).alias("open_cents"),
        F.greatest(F.col("high") + F.col("base_n"), F.col("before")).alias("high_open"), (n == F.col("peak")).alias("is_peak"),
    )


def sale_deltas(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """The starts and ends of open sales, for their client's nation and for everyone.

    A sale is open from sold_at until seven days after its last shipment, forever without one. Null sold_at or an end not after
    the start: no part. A sale without an id has no lines; repeated sales count each; a client whose rows name several nations
    has the least of them; a total that is null or not finite counts 0. Other columns of any name are ignored.
    """
    shipped = lines.filter("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.max(minute_of(F.col("shipped_at"))).alias("shipped"))
    total = F.col("total")
    cents = F.when(total.isNull() | F.isnan(total) | (F.abs(total) == float("inf")), F.lit(0)).otherwise(F.floor(100 * total + 0.5)).cast("long")
    opened = sales.filter("sold_at is not null").select("sale_id", "client_id", minute_of(F.col("sold_at")).alias("start"), cents.alias("cents"))
    nations = clients.filter("client_id is not null").groupBy("client_id").agg(F.min("nation_id").cast("int").alias("nation"))
    # a client with a thousandth of all sales or more meets its rows where these lie: at most 1000 such clients are broadcast
    tables = Tables(sales.sparkSession)
    named, rest = opened.filter("client_id is not null"), opened.filter("client_id is null")
    sizes = named.groupBy("client_id").agg(F.count("*").alias("size")).join(nations.hint("merge"), "client_id", "left")
    known = attach_by_key(named, tables.keep(tables.save(sizes, "clients")), "client_id", "size", opened.count())
    known = known.select("sale_id", "start", "cents", "nation").unionByName(rest.select("sale_id", "start", "cents", F.lit(None).cast("int").alias("nation")))
    open_ = known.join(shipped.hint("merge"), "sale_id", "left")
    open_ = open_.withColumn("end", F.col("shipped") + 7 * 1440).filter("end is null or end > start")
    one = lambda at, sign: F.struct(at.alias("minute"), F.lit(sign).cast("long").alias("dn"), (sign * F.col("cents")).alias("dc"))
    both = F.filter(F.array(one(F.col("start"), 1), one(F.col("end"), -1)), lambda d: d["minute"].isNotNull())
    groups = F.array(F.coalesce("nation", F.lit(NOBODY)), F.lit(EVERYONE))
    return open_.select(F.explode(both).alias("d"), groups.alias("groups")).select(F.explode("groups").alias("grp"), "d.*")


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """(nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak): see ``sale_deltas`` and ``sweep``."""
    return sweep(sale_deltas(sales, lines, clients)).withColumnRenamed("grp", "nation_id")
