"""Words cut into the cheapest sequence of known pieces: a lattice over a dictionary with costs, and its best path."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def best_path(word: str, costs: dict[str, float], unknown: float, longest: int) -> tuple[list[str], float]:
    """(pieces, cost) of the cheapest cut of ``word`` into dictionary pieces and single unknown characters of cost ``unknown`` each.

    Of equally cheap cuts the one whose last pieces are longer wins.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = (math.inf, end)
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            cost = costs.get(piece, unknown if len(piece) == 1 else math.inf)
            if best[start][0] + cost < found[0]:
                found = (best[start][0] + cost, start)
        best.append(found)
    pieces, end = [], len(word)
    while end:
        start = best[end][1]
        pieces.append(word[start:end])
        end = start
    return pieces[::-1], best[-1][0]


def segmenter(costs: dict[str, float], unknown: float):
    """A column function text -> pieces of its blank-separated words; null stays null. The dictionary travels with it, so it must be small."""
    longest = max(map(len, costs), default=1)

    @F.arrow_udf(ArrayType(StringType()))
    def pieces(texts: pa.Array) -> pa.Array:
        known: dict[str, list[str]] = {}

        def cut(word: str) -> list[str]:
            if word not in known:
                known[word] = best_path(word, costs, unknown, longest)[0]
            return known[word]

        return pa.array([None if t is None else [p for w in t.split() for p in cut(w)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return pieces


def piece_costs(texts: DataFrame, text: str, most: int, ending: int = 3) -> tuple[dict[str, float], float]:
    """(costs, unknown): the ``most`` most frequent words, stems and endings of up to ``ending`` characters, at -ln of their share, and the cost of a letter outside.

    Counts cover all texts; the dictionary's size is the parameter, ties go by the piece.
    """
    words = texts.select(F.explode(F.split(text, r"\s+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(ending)), lambda k: F.when(F.length("w") > k + 1, F.array(F.substr("w", F.lit(1), F.length("w") - k), F.substr("w", F.length("w") - k + 1))).otherwise(F.array().cast("array<string>"))))
    per = words.select(F.explode(F.concat(F.array("w"), cuts)).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    got = per.orderBy(F.desc("n"), "piece").limit(most).collect()
    total = sum(r["n"] for r in got)
    costs = {r["piece"]: -math.log(r["n"] / total) for r in got}
    return costs, 2 * max(costs.values(), default=1.0)
