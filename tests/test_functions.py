"""Example tables of the text, slot, routing, metric and recognition functions."""

import math
import os
import random
import re
import unicodedata
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomline.functions import metrics, ner, routing, slots
from loomline.functions import text as T
from loomline.functions.shipping import ship
from loomline.operators import joins, replay, textual
from loomline.operators import prompts as p
from loomline.operators import quantiles as q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalized_hash(spark):
    h = one(spark, T.normalized_hash(F.lit("傳于李馨長曰知道")))
    assert h.startswith("33665f04") and h.endswith("828b")
    assert one(spark, T.normalized_hash(F.lit("傳于 李馨長曰\t知道\n"))) == h
    assert one(spark, T.normalized_hash(F.lit(unicodedata.normalize("NFD", "가나")))) == one(spark, T.normalized_hash(F.lit("가나")))
    assert one(spark, T.normalized_hash(F.lit("a b"))) != one(spark, T.normalized_hash(F.lit("ab")))
    assert one(spark, T.normalized_hash(F.lit(None).cast("string"))) is None


def test_name_reflected(spark):
    for text, name, hit in (("김류를 승지로 제수하였다", "김류", True), ("문회가 아뢰기를", "정문회", True), ("공이 아뢰기를", "윤공", False)):
        assert one(spark, slots.name_reflected(F.lit(text), F.lit(name))) is hit


ENTITY = "array<struct<surface:string,type:string,kb_id:string,resolved_name:string,link_stage:string>>"


def slotted(spark, text, persons):
    rows = [{"surface": s, "type": "PER", "kb_id": "p", "resolved_name": n, "link_stage": "SINGLE"} for s, n in persons]
    df = spark.createDataFrame([(text, rows)], f"text string, e {ENTITY}").withColumn("s", slots.confirmed(F.col("text"), F.col("e")))
    return df.withColumn("t", slots.source_template(F.col("text"), F.col("s")))


def test_slots(spark):
    assert slotted(spark, "命金瑬爲都巡檢使", [("金瑬", "김류")]).first()["t"] == "命⟪PER1⟫爲都巡檢使"
    assert slotted(spark, "金自點與自點論事", [("自點", "자점"), ("金自點", "김자점")]).first()["t"] == "⟪PER1⟫與⟪PER2⟫論事"
    assert slotted(spark, "傳曰知道", []).first()["t"] is None


def test_particles(spark):
    for name, text, want in (
        ("김류", "⟪PER1⟫이 말했다", "김류가 말했다"), ("강선", "⟪PER1⟫가 말했다", "강선이 말했다"), ("강선", "⟪PER1⟫를", "강선을"), ("김류", "⟪PER1⟫은.", "김류는."),
        ("강선", "⟪PER1⟫와 함께", "강선과 함께"), ("김류", "⟪PER1⟫이라 하니", "김류라 하니"), ("김류", "⟪PER1⟫이조판서", "김류이조판서"),
    ):
        assert one(spark, slots.fill_slot(F.lit(text), F.lit("⟪PER1⟫"), F.lit(name))) == want


def test_error_classes_and_hints(spark):
    for message, want in (("Request timed out after 5000ms", "TIMEOUT"), ("processed 4290 tokens", "UNKNOWN"), ("[503] overloaded", "SERVER_ERROR"), ("429 PerDay", "QUOTA_DAILY"), (None, "UNKNOWN")):
        assert one(spark, routing.error_class(F.lit(message).cast("string"))) == want
    assert one(spark, routing.retry_hint_ms(F.lit("Please retry in 7.5s"))) == 7500
    assert one(spark, routing.retry_hint_ms(F.lit('"retryDelay": "900s"'))) == 300000
    assert one(spark, routing.retry_hint_ms(F.lit("no hint"))) is None


def test_rule_names(spark):
    import re

    rules = [re.compile(p) for p in ner.NAME_RULES]
    assert [(e["surface"], e["start"]) for e in ner.rule_entities("以姜銑爲副修撰", rules)] == [("姜銑", 1)]
    assert "李元翼" in [e["surface"] for e in ner.rule_entities("領議政李元翼進曰許之", rules)]
    assert ner.rule_entities("傳曰知道", rules) == []
    spans = ner.merge_labels("ab cd ef", ["B-PER", "I-PER", "I-LOC"], [0.9, 0.7, 0.4], [0, 3, 6], [2, 5, 8], 0.5)
    assert spans == [{"surface": "abcd", "type": "PER", "start": 0, "end": 5, "score": 0.8}]


def test_link_stages(spark):
    people = spark.createDataFrame([(1, "강선", 1563, ["좌랑"]), (2, "강선", 1645, ["부수찬(副修撰)"])], "person_id long, name string, active_from int, offices array<string>").withColumn("known", F.lit(True))
    index = spark.createDataFrame([("강선", 0, 1), ("강선", 1, 2), ("하나", 2, 1)], "surface string, pos long, person_id long")
    cases = [(0, "강선", 1600, ""), (1, "강선", 1650, "부수찬으로 삼았다"), (2, "강선", 1650, "以姜銑爲副修撰"), (3, "없음", 1650, ""), (4, "강선", 1650, ""), (5, "하나", 1, ""), (6, "강선", 1500, "")]
    mentions = spark.createDataFrame(cases, "mention_id long, surface string, year int, context string")
    got = {r["mention_id"]: (r["link"]["stage"], r["link"]["ids"]) for r in joins.link_mentions(mentions, index, people).collect()}
    assert got == {0: ("TIME", [1]), 1: ("OFFICE", [2]), 2: ("OFFICE", [2]), 3: ("MISS", []), 4: ("AMBIGUOUS", [1, 2]), 5: ("SINGLE", [1]), 6: ("AMBIGUOUS", [])}


def test_link_stages_match_a_plain_loop(spark):
    """Persons with several titles, contexts that name several, repeated entries, unknown persons, null years and offices."""
    rng = random.Random(4)
    offices = ["판서(判書)", "좌랑", "승지(承旨)", "참판", "()", ""]
    people = [(i, f"p{i}", rng.choice([None, 1500, 1550, 1600]), rng.choice([None, [], rng.sample(offices, rng.randrange(1, 4))])) for i in range(40)]
    index = [(rng.choice("abcd"), k, rng.randrange(45)) for k in range(90)] + [("solo", 99, 3)]
    cases = [(i, rng.choice(["a", "b", "c", "d", "solo", "none", None]), rng.choice([None, 1400, 1520, 1560, 1700]), rng.choice([None, "", "判書", "좌랑 참판", "승지와 判書와 좌랑", "x"])) for i in range(300)]
    known, want = {p[0]: p for p in people}, {}
    for i, surface, year, context in cases:
        entries = [(known.get(p), p) for s, _, p in sorted(index, key=lambda x: x[1]) if s == surface]
        timely = [(k, p) for k, p in entries if k and (k[2] or 0) <= (9999 if year is None else year)]
        fits = []
        for k, p in timely:
            shown = [t for o in k[3] or [] for t in (re.sub(r"\(.*?\)", "", o).strip(), (re.search(r"\(([^)]*)\)", o) or [0, ""])[1]) if t]
            if any(t in (context or "") for t in shown):
                fits.append(p)
        ids = [p for _, p in timely]
        if len(entries) < 2:
            want[i] = ("SINGLE", [entries[0][1]]) if entries else ("MISS", [])
        else:
            want[i] = ("TIME", ids) if len(ids) == 1 else ("OFFICE", fits) if len(fits) == 1 else ("AMBIGUOUS", fits or ids[:3])
    got = joins.link_mentions(
        spark.createDataFrame(cases, "mention_id long, surface string, year int, context string"),
        spark.createDataFrame(index, "surface string, pos long, person_id long"),
        spark.createDataFrame(people, "person_id long, name string, active_from int, offices array<string>").withColumn("known", F.lit(True)),
    )
    assert {r["mention_id"]: (r["link"]["stage"], r["link"]["ids"]) for r in got.collect()} == want


def test_a_written_link_result_holds_a_text_once(spark, tmp_path):
    """2000 mentions repeat 50 texts of up to 90 kB; the texts are over Parquet's usual dictionary of 1 MB."""
    n = 30_000
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("B#1").alias("p_brand"), F.lit("T").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    items = spark.range(2000).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % n).alias("l_partkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag")
    )
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    joins.entity_link(spark, str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.agg(F.count("*"), F.sum(F.length("ids"))).first()[0] == 2000
    row = got.filter("doc_id = 6").first()
    assert row["ids"] == ",".join(str(i) for i in range(0, n, 2) if i % 50 < 7) and row["stage"] == "AMBIGUOUS"
    assert got.agg(F.sum(F.length("ids"))).first()[0] > 50_000_000
    files = list((tmp_path / "out").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 5_000_000
    assert not any(pq.ParquetFile(f).metadata.row_group(0).column(3).is_stats_set for f in files)


def test_chrf_and_bleu(spark):
    df = spark.createDataFrame([("the cat sat on it", "the cat sat on it"), ("abc def", "xyz uvw"), ("the cat sat", "the cat sat on the mat")], "hyp string, ref string")
    rows = df.select(metrics.chrf_stats("hyp", "ref").alias("c"), metrics.bleu_word_stats("hyp", "ref").alias("b")).select("c", metrics.chrf_score(F.col("c")).alias("chrf"), metrics.bleu_score(F.col("b")).alias("bleu")).collect()
    assert math.isclose(rows[0]["chrf"], 100) and math.isclose(rows[0]["bleu"], 100)
    assert rows[1]["chrf"] == 0 and rows[1]["bleu"] == 0
    for r in rows:
        assert math.isclose(r["chrf"], metrics.chrf_of(list(r["c"])), abs_tol=1e-9)


def test_replay_matches_sequential_fold(spark):
    rng = random.Random(5)
    for trial in range(4):
        keys = {k: (rng.choice("ABC") if rng.random() < 0.7 else None) for k in range(12)}
        items = [(i, str(k := rng.randrange(12)), keys[k], rng.choice(["REJECTED", "DEGRADED", "VERIFIED"]), rng.random() < 0.7) for i in range(120)]
        l1, l2, want = set(), {}, {}
        for pos, key, template, grade, stores in items:
            if key in l1:
                want[pos] = "L1"
            elif template and template in l2:
                want[pos] = "L2"
            else:
                want[pos] = "LLM"
                if grade != "REJECTED":
                    l1.add(key)
                if grade == "VERIFIED" and stores and template:
                    l2.setdefault(template, pos)
        df = spark.createDataFrame(items, "pos long, l1_key string, template_hash string, grade string, stores boolean")
        assert {r["pos"]: r["outcome"] for r in replay.replay(df).collect()} == want, trial


def test_quantiles_in_passes(spark, monkeypatch):
    """Ties, one far value, null and single-value groups; small bins force several passes."""
    monkeypatch.setattr(q, "FEW", 3)
    monkeypatch.setattr(q, "BINS", 4)
    rnd = random.Random(5)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(200)] + [1e12], "b": [1.0] * 50 + [2.0] * 3, None: [float(i % 7) for i in range(40)], "one": [4.5], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    places = {"low": q.share(0.25), "mid": q.share(0.5), "late": q.index(0.95), "least": q.share(0), "most": q.share(1)}
    got = {r["g"]: r for r in q.quantiles(df, F.col("v"), places, {"g": F.col("g")}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        s = sorted(groups[g])
        for name, place in places.items():
            h = place(len(s))
            a, b = s[math.floor(h)], s[math.ceil(h)]
            assert math.isclose(r[name], a + (b - a) * (h - math.floor(h)), rel_tol=1e-12)
    assert q.quantiles(df.limit(0), F.col("v"), places).collect()[0].asDict() == dict.fromkeys(places)
    assert q.quantiles(df.limit(0), F.col("v"), places, {"g": F.col("g")}).count() == 0


def test_prompt_sections(spark):
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        p.section("[t]", none).alias("empty"),
        p.section("[t]", F.array(F.lit("a"), F.lit("b"))).alias("two"),
        p.before(F.lit("x\nline"), "line", p.section("[t]", none)).alias("same"),
        p.phrase_rule(F.lit(None).cast("string"), F.lit("n"), F.lit("u")).alias("no_rule"),
        p.brief(F.array(F.struct(F.lit("A").alias("kind"), F.lit("outer").alias("message")), F.struct(F.lit("B").alias("kind"), F.lit("r" * 300).alias("message")))).alias("brief"),
    ).first()
    assert row["empty"] == "" and row["two"] == "[t]\n  · a\n  · b" and row["same"] == "x\nline" and row["no_rule"] == "" and row["brief"] == "B: " + "r" * 200


def _scan_names(text: str) -> list[tuple[int, str]]:
    """The three rules read character by character: tried at each place, longer runs first where the rule is greedy."""
    han = lambda s: s != "" and all("一" <= c <= "鿿" for c in s)
    surnames = ner.NAME_RULES[1].split("]")[0].removeprefix("([")
    offices = ner.NAME_RULES[2].split(")")[0].removeprefix("(?:").split("|")
    speech, kept = "曰啓疏箚辭進退對白", []

    def appointed(i):
        for n in (2, 3):
            if text[i] == "以" and len(name := text[i + 1 : i + 1 + n]) == n and han(name) and text[i + 1 + n : i + 2 + n] == "爲":
                return i + 1, i + 1 + n, i + 2 + n

    def spoke(i):
        for n in (2, 1):
            e = i + 1 + n
            after = text[e + 1 : e + 2] if text[e : e + 1] in (",", "、") and text[e : e + 1] else text[e : e + 1]
            if text[i] in surnames and len(text[i + 1 : e]) == n and han(text[i + 1 : e]) and after and after in speech:
                return i, e, e

    def in_office(i):
        for o in offices:
            if text.startswith(o, i):
                for n in (3, 2):
                    s, e = i + len(o), i + len(o) + n
                    if len(text[s:e]) == n and han(text[s:e]) and (text[e : e + 1] in (",", "、", "。") or e == len(text) or text[e:] == "\n"):
                        return s, e, e

    for rule in (appointed, spoke, in_office):
        i = 0
        while i < len(text):
            hit = rule(i)
            if hit and all(hit[1] <= a or b <= hit[0] for a, b in kept):
                kept.append(hit[:2])
            i = hit[2] if hit else i + 1
    return [(s, text[s:e]) for s, e in sorted(kept)]


def test_rule_names_against_a_scan(spark):
    """The whole query, and random mixtures of the rules' characters."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["以", "爲", "金", "李", "曰", "啓", ",", "、", "。", "承旨", "判書", "銑", "翼", "x", "\n"]) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    ship(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", ner.rule_ner("s").alias("found"))
    for r in df.collect():
        assert [(e["start"], e["surface"]) for e in r["found"]] == _scan_names(texts[r["i"]]), texts[r["i"]]
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        whole = {r["doc_id"]: r["s"] for r in textual.sentences(spark, sf).collect()}
        for r in textual.rule_ner(spark, sf).collect():
            assert r["found"] == ";".join(f"{w}@{s}" for s, w in _scan_names(whole[r["doc_id"]]))


def test_cases_are_solved_by_counts(spark, tmp_path):
    """Counts by stage equal the mentions' own stages; entries that repeat count as often; no plan for counts gathers ids."""
    people = spark.createDataFrame([(k, f"p{k}", k % 3, ["a(b)", "c"] if k % 2 else ["c"]) for k in range(30)], "person_id long, name string, active_from int, offices array<string>").withColumn("known", F.lit(True))
    index = spark.createDataFrame([("x", k // 2, k // 2) for k in range(40)] + [("y", 90, 1)], "surface string, pos long, person_id long")
    cases = [(i, s, y, c) for i, (s, y, c) in enumerate((s, y, c) for s in ("x", "y", "z", None) for y in (None, 0, 1, 2) for c in (None, "", "a", "a c", "b") for _ in range(3))]
    mentions = spark.createDataFrame(cases, "id long, surface string, year int, context string")
    linked = joins.link_mentions(mentions, index, people).collect()
    counts = joins.stage_counts(mentions, index, people)
    assert {r["stage"]: r["n"] for r in counts.collect()} == dict(Counter(r["link"]["stage"] for r in linked))
    no = {(r["surface"], r["year"], r["context"]): (r["no"], len(r["link"]["ids"])) for r in linked}
    assert no["x", 0, "a c"] == (14, 14) and no["x", 0, "a"] == (6, 6) and no["x", 0, ""] == (0, 3) and no["z", 0, "a"] == (0, 0)
    got = joins.link_cases(mentions, index, people, [F.col("no")])
    assert {(r["surface"], r["year"], r["context"]): r["no"] or 0 for r in got.collect()} == {k: v[0] for k, v in no.items()}
    for df in (counts, got, joins.link_stages(mentions, index, people)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lead" not in plan and "collect_list(e" not in plan
