"""Places in an order over all rows: dense numbers without a global window, and what goes by place: neighbours and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import slots
from loomline.functions import text as T
from loomline.plans.registry import load, query
from loomline.sources import sinks


def dense_order(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with ``name``, the row's place from 0 by the columns ``order`` ascending, nulls first. The rows are saved in the shared folder.

    Rows are dealt by ranges of the order and sorted there; a row's place is its number in its range plus the sizes of the ranges
    before, one row a range. No task sees more than its range, and equal keys are split where ``order`` tells rows apart; rows
    equal in all of ``order`` get successive places in any order.
    """
    spark, path = df.sparkSession, sinks.scratch(df.sparkSession, "ordered")
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of this id number the rows of a partition
    cut.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def misaligned(rows: DataFrame, place: str, names: str, text: str, window: int = 2, reflects=slots.name_reflected) -> DataFrame:
    """The rows whose text lacks some of their names while the text of ONE neighbour, up to ``window`` places off, has all that are missing.

    A suspect row asks each neighbour by place: an equi join, not a window over all rows.
    """
    missing = F.filter(names, lambda n: ~reflects(F.col(text), n))
    suspects = rows.withColumn("_missing", missing).filter(F.size("_missing") > 0)
    asks = suspects.select(F.col(place).alias("_from"), "_missing", F.explode(F.array(*[F.col(place) + k for k in range(-window, window + 1) if k])).alias("_to"))
    beside = rows.select(F.col(place).alias("_to"), F.col(text).alias("_beside"))
    found = asks.join(beside, "_to").filter(F.forall("_missing", lambda n: reflects(F.col("_beside"), n))).select(F.col("_from").alias(place)).distinct()
    return rows.join(found, place, "left_semi")


def prefix_repeats(rows: DataFrame, place: str, key: str, sizes: Column) -> DataFrame:
    """(size, n, repeats): of the first ``size`` rows by place how many repeat the key of an earlier one; null keys are none.

    A row is a repeat unless it is its key's first, so each row is compared with the minimum of its key, and counted per class
    of sizes before the classes are added up; ``sizes`` is an ascending array of few numbers.
    """
    firsts = rows.groupBy(key).agg(F.min(place).alias("_first"))
    per = rows.groupBy(F.size(F.filter(sizes, lambda s: s <= F.col(place))).alias("_class")).agg(F.count(key).alias("n"))
    new = firsts.filter(F.col(key).isNotNull()).groupBy(F.size(F.filter(sizes, lambda s: s <= F.col("_first"))).alias("_class")).agg(F.count("*").alias("new"))
    classes = per.join(new, "_class", "left")
    upto = classes.select(F.explode(F.transform(sizes, lambda s, i: F.when(F.col("_class") <= i, s))).alias("size"), "n", F.coalesce("new", F.lit(0)).alias("new")).filter("size is not null")
    return upto.groupBy("size").agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("new")).alias("repeats"))


# --- queries


_ORDER_ROWS_SQL = """rows_ AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, coalesce(names, []) AS names, coalesce(said, '') AS translation FROM orders LEFT JOIN
(SELECT l_orderkey, list(DISTINCT p_brand) FILTER (l_returnflag <> 'A') AS names, string_agg(DISTINCT p_brand, ' ') FILTER (l_tax > 0.02) AS said FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON o_orderkey = l_orderkey)"""


def _orders_by_date(spark, d) -> DataFrame:
    """Orders in order of date, with the brands they name and a text that mentions some brands."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_tax").join(part, "l_partkey")
    named = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "A", F.col("p_brand"))).alias("names"), F.array_join(F.collect_set(F.when(F.col("l_tax") > 0.02, F.col("p_brand"))), " ").alias("translation"))
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = orders.join(named, orders["o_orderkey"] == named["l_orderkey"], "left").select("o_orderkey", "o_orderdate", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("translation", F.lit("")).alias("translation"))
    return dense_order(rows, ["o_orderdate", "o_orderkey"])


@query("dense_places", "SELECT sale_id, row_number() OVER (ORDER BY sold_at NULLS FIRST, sale_id NULLS FIRST) - 1 AS place FROM sales")
def dense_places(spark, d):
    """Sales numbered by time; some have none."""
    return dense_order(load(spark, d, "sales").select("sale_id", "sold_at"), ["sold_at", "sale_id"]).select("sale_id", "place")


_REFLECTS = "(contains({t}, {n}) OR (length({n}) >= 3 AND contains({t}, substr({n}, 2))))"


@query(
    "misaligned_names",
    f"""WITH {_ORDER_ROWS_SQL}, m AS (SELECT o_orderkey, place, list_filter(names, lambda n: NOT {_REFLECTS.format(t="translation", n="n")}) AS missing FROM rows_)
    SELECT o_orderkey FROM m WHERE len(missing) > 0 AND EXISTS (SELECT 1 FROM rows_ b WHERE b.place IN (m.place - 2, m.place - 1, m.place + 1, m.place + 2) AND len(list_filter(m.missing, lambda n: NOT {_REFLECTS.format(t="b.translation", n="n")})) = 0)""",
)
def misaligned_names(spark, d):
    """Orders whose missing names all stand in one of the two neighbours by date on either side."""
    return misaligned(_orders_by_date(spark, d), "place", "names", "translation").select("o_orderkey")


#: The sizes at which repeats are counted; the whole comes on top.
SIZES = (1000, 2000, 5000, 10000, 20000, 40000)


@query(
    "repeat_curve",
    """WITH p AS (SELECT row_number() OVER (ORDER BY ts NULLS FIRST, click_id NULLS FIRST, props NULLS FIRST) - 1 AS place, sha256(regexp_replace(nfc_normalize(props), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS h FROM clicks), n AS (SELECT count(*) AS n FROM clicks),
    s AS (SELECT size FROM (SELECT unnest([1000, 2000, 5000, 10000, 20000, 40000]) AS size) WHERE size < (SELECT n FROM n) UNION ALL SELECT n FROM n), f AS (SELECT h, min(place) AS first FROM p WHERE h IS NOT NULL GROUP BY h)
    SELECT size, (SELECT count(h) FROM p WHERE place < size) AS n, (SELECT count(h) FROM p WHERE place < size) - (SELECT count(*) FROM f WHERE first < size) AS repeats FROM s""",
)
def repeat_curve(spark, d):
    """Clicks in order of time: how many of the first 1000, 2000, ... and of all repeat an earlier one's properties."""
    c = load(spark, d, "clicks").select("ts", "click_id", "props", T.normalized_hash(F.col("props")).alias("h"))
    rows = dense_order(c, ["ts", "click_id", "props"])
    n = rows.count()
    sizes = F.array(*[F.lit(s).cast("long") for s in (*[s for s in SIZES if s < n], n)])
    return prefix_repeats(rows, "place", "h", sizes)
