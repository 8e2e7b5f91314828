"""Exact order statistics whose values never meet in one task, however many rows there are."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 4096  # per interval and pass
FEW = 1 << 16  # an interval of so many rows is sorted as one array

#: Where a statistic lies among n sorted values, from 0; between two places it is interpolated.
Place = Callable[[int], float]


def share(p: float) -> Place:
    return lambda n: (n - 1) * p


def index(p: float) -> Place:
    return lambda n: min(int(n * p), n - 1)


def quantiles(df: DataFrame, value: Column, places: dict[str, Place], keys: dict[str, Column] | None = None) -> DataFrame:
    """A row a group (one without ``keys``): the keys, and the statistics of ``value``, finite numbers, nulls left out.

    Each pass counts an interval's rows in bins, combined before the shuffle, and goes on with the bins that hold the
    wanted places, until these have few rows. The driver gets counts per bin only. Groups must be few, as types or stages are.
    A group without values has no row; without keys, a row of nulls.
    """
    keys = keys or {}
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[c.alias(n) for n, c in zip(names, keys.values(), strict=True)], value.cast("double").alias("_v")).filter("_v is not null")
    spark = rows.sparkSession
    groups = {tuple(r[n] for n in names): r for r in rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()}
    at = {(g, i): (r["lo"], r["hi"], 0, r["n"]) for g, r in groups.items() if r["n"] for p in places.values() for i in {math.floor(p(r["n"])), math.ceil(p(r["n"]))}}
    while wide := sorted({(g, s[0], s[1]) for (g, _), s in at.items() if s[3] > FEW and s[0] < s[1]}, key=str):
        cut = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        counted = _within(spark, rows, names, wide).groupBy("span", cut.alias("bin")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
        bins: dict[int, list] = {}
        for r in counted.collect():
            bins.setdefault(r["span"], []).append(r)
        number = {w: i for i, w in enumerate(wide)}
        for (g, i), (lo, hi, below, _) in at.items():
            for b in sorted(bins.get(number.get((g, lo, hi)), []), key=lambda b: b["bin"]):
                if below + b["n"] > i:
                    at[g, i] = (b["lo"], b["hi"], below, b["n"])
                    break
                below += b["n"]
    spans = sorted({(g, s[0], s[1]) for (g, _), s in at.items() if s[0] < s[1]}, key=str)
    found = {(g, i): s[0] for (g, i), s in at.items()}
    if spans:
        lists = _within(spark, rows, names, spans).groupBy("span").agg(F.sort_array(F.collect_list("_v")).alias("values"))
        wanted = [(spans.index((g, s[0], s[1])), i - s[2] + 1, t) for t, ((g, i), s) in enumerate(at.items()) if s[0] < s[1]]
        picked = lists.join(F.broadcast(spark.createDataFrame(wanted, "span int, place int, target int")), "span")
        targets = list(at)
        found |= {targets[r["target"]]: r["v"] for r in picked.select("target", F.element_at("values", F.col("place")).alias("v")).collect()}

    def statistic(g: tuple, p: Place) -> float | None:
        if not (n := groups[g]["n"]):
            return None
        low = math.floor(p(n))
        a, b = found[g, low], found[g, math.ceil(p(n))]
        return a + (b - a) * (p(n) - low)

    types = "".join(f"{k} {rows.schema[n].dataType.simpleString()}, " for k, n in zip(keys, names, strict=True))
    return spark.createDataFrame([(*g, *[statistic(g, p) for p in places.values()]) for g in groups], types + ", ".join(f"{p} double" for p in places))


def _within(spark: SparkSession, rows: DataFrame, names: list[str], spans: list[tuple]) -> DataFrame:
    """Rows of each interval, with its number and ends; intervals of a group don't overlap, or are the same."""
    types = "".join(f"g{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    ends = spark.createDataFrame([(i, *g, lo, hi) for i, (g, lo, hi) in enumerate(spans)], f"span int, {types}lo double, hi double")
    hit = F.col("_v").between(F.col("lo"), F.col("hi"))
    for n in names:
        hit &= F.col(n).eqNullSafe(F.col(f"g{n}"))
    return rows.join(F.broadcast(ends), hit)
