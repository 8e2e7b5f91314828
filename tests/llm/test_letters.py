"""Ids of letters that change when they are composed or lower-cased, beside every mark; a corpus without labels."""

import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import fasttok, toxicity

CHANGING = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalpha() and unicodedata.normalize("NFC", c).lower() != c and not 0xAC00 <= ord(c) <= 0xD7A3]
MARKS = ".,!?;:"


@pytest.mark.parametrize(("file", "dropped"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_equal_the_library_for_letters_that_change(file, dropped):
    path = public_tokenizers.path(file)
    library, own = Tokenizer.from_file(path), fasttok.PieceEncoder(path, dropped)
    rng = random.Random(1)
    odd = [c for c in CHANGING if not unicodedata.normalize("NFC", c).lower()[-1].isalpha()]
    assert "İ" in odd and "क़" in odd and "שׁ" in odd
    some = odd + rng.sample(CHANGING, 400)
    texts = ["TÜRKİ. ANKARADAKİ, क़. ששׁ, གྷ! ok"] + [f"ab{c}{m} {m}{c} x{c}\n{c}{m}{m}y {c}" for c in some for m in MARKS]
    texts += ["".join(rng.choices([*some[:60], *"abC .,\n"], k=40)) for _ in range(400)]
    got = own.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_a_corpus_without_labels_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, ""), (None, "x " * 50000), (1, "you idiot")], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.civil(spark, docs, str(tmp_path)).count() == 5
    model = toxicity.fit([], np.zeros(0))
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}
