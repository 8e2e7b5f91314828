"""Each stage of the pipeline on odd rows, on its own: what it keeps, its columns, an empty table."""

from collections import Counter

import pytest

import corpus_pipeline

PROSE = "the river ran past the old mill and the children threw stones into the slow brown water until evening came "
ROWS = [
    (0, PROSE), (1, None), (2, ""), (3, " \n\t "), (4, PROSE.replace("stones", "sticks", 1) * 6), (5, PROSE * 6), (6, PROSE * 4000),
    (7, "one two"), (7, "one two"), (None, PROSE), (None, "only without a key"), (8, "one two"), (9, "x" * 300_000), (10, "so this is a question that was set in an exam about rivers"),
]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def corpus(spark, tmp_path):
    spark.createDataFrame([(i, "so this is a question that was set in an exam about rivers") for i in (1, 1)] + [(2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (4, 1, 0), (None, 0, 1), (77, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", None, "d", 3, "g", 1) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, group string, _key int")
    return docs, str(tmp_path)


def kept(out):
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_keeps_columns_and_clean_rows(spark, corpus, name):
    docs, sf_dir = corpus
    out = STAGES[name](spark, docs, sf_dir)
    assert out.columns == docs.columns
    got, every = kept(out), Counter(ROWS)
    assert not got - every
    if name == "toxicity":
        assert got == every
    if name == "exact_dedup":
        texts = Counter(t or "" for _, t in got)
        assert set(texts.values()) == {1} and set(texts) == {t or "" for _, t in ROWS}
        assert (8, "one two") in got and (0, PROSE) in got and (2, "") in got
    if name == "jaccard_join":
        # 4 and 5 differ in five words of some twenty shingles; keys that are null stay
        assert got[None, PROSE] == 1 and got[1, None] == 1 and got[2, ""] == 1 and got[3, " \n\t "] == 1
        assert got[0, PROSE] == 1 and (8, "one two") not in got and (7, "one two") in got
    if name == "decontamination":
        assert got == every - Counter([ROWS[-1]])
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0


def test_packing_covers_every_row(spark, corpus):
    docs, sf_dir = corpus
    out = STAGES["packing"](spark, docs, sf_dir).collect()
    ends = Counter(r["doc_id"] for r in out if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == Counter(i for i, _ in ROWS)
    assert STAGES["packing"](spark, docs.limit(0), sf_dir).count() == 0
