import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarterwise.llm import language_id as li

ENGLISH = "the cat and the dog went to the house with their friends and they were happy there"
GERMAN = "der hund und die katze gingen zu dem haus mit ihren freunden und sie waren dort froh"


@pytest.fixture(scope="module")
def model(documents):
    rows = [(i, ENGLISH, "en") for i in range(6)] + [(10 + i, GERMAN, "de") for i in range(4)]
    return li.fit(documents(*rows, (30, None, "fr"), (31, "oui", None)))


def test_known_words_then_shorter_grams(documents, model):
    texts = ["the house", "das freundliche Haus", "HUNDE KATZEN", "they went", "froh!", None, "", "123 ...", "日本", "ⅷ ²"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(documents(*enumerate(texts)), model).collect()}
    assert [got[i][0] for i in range(len(texts))] == ["en", "de", "de", "en", "de", "und", "und", "und", "de", "und"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[5][1] == 0.0 and got[8][1] == 0.5


def _vector(model, rows):
    return np.array([model.total([r], [1.0]) for r in rows])


def test_backoff_takes_the_longest_known_length(model):
    scorer = li.Scorer(model)
    assert "freunden" in model.words and "freundlich" not in model.words
    assert scorer.rows_of_unseen("freundq") == tuple(model.grams[g] for g in ("<fre", "freu", "reun", "eund"))
    assert scorer.rows_of_unseen("qqfreq") == tuple(model.grams[g] for g in ("fre",))
    assert scorer.rows_of_unseen("日") == ()


def test_words_keep_their_marks(documents):
    assert li.words_of("छोटा सा हिन्दी") == ["छोटा", "सा", "हिन्दी"]
    assert li.words_of("தமிழ் ภาษาไทยที่") == ["தமிழ்", "ภาษาไทยที่"]
    assert li.words_of("Cafe\u0301 CAFÉ") == ["café", "café"]
    assert li.words_of("H²O don't x_y 7a \u0301b") == ["h", "o", "don", "t", "x", "y", "a", "b"]
    model = li.fit(documents((1, "छोटा सा हिन्दी घर", "hi"), (2, "cafe\u0301 nai\u0308f", "fr")))
    assert {"हिन्दी", "छोटा", "café", "naïf"} <= set(model.words)
    got = [r.lang_pred for r in li.identify(documents((1, "हिन्दी"), (2, "CAFÉ")), model).sort("doc_id").collect()]
    assert got == ["hi", "fr"]


@pytest.mark.parametrize("text", ["".join(map(chr, range(0x300))), " ".join(chr(c) + "a" for c in range(0x300))])
def test_both_word_patterns_agree_where_both_apply(text):
    assert li._BEYOND.search(text.lower()) is None or "\u0307" in text.lower()
    near = "".join(c for c in text.lower() if ord(c) < 0x300)
    assert unicodedata.normalize("NFC", near) == near
    assert li._NEAR_WORD.findall(near) == li._WORD.findall(near)


def _plain(rows, text):
    """Scores by the definition: counts in dictionaries, languages one by one."""
    words = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", unicodedata.normalize("NFC", (t or "").lower()))
    grams = lambda w, k: [m[i : i + k] for m in [f"<{w}>" if k > 1 else w] for i in range(len(m) - k + 1)]
    languages = sorted({lang for _, lang in rows})
    seen = {k: {lang: Counter() for lang in languages} for k in (0, 4, 3, 2, 1)}
    for t, lang in rows:
        for w in words(t):
            seen[0][lang][w] += 1
            for k in (4, 3, 2, 1):
                seen[k][lang].update(grams(w, k))
    items = {k: set().union(*seen[k].values()) for k in seen}
    log = lambda k, x, lang: math.log((seen[k][lang][x] + 0.5) / (seen[k][lang].total() + 0.5 * len(items[k])))

    def score(text):
        total = dict.fromkeys(languages, 0.0)
        for w in words(text):
            use = [(0, w)] if w in items[0] else next((f for k in (4, 3, 2, 1) if (f := [(k, g) for g in grams(w, k) if g in items[k]])), [])
            for lang in languages:
                total[lang] += sum(log(k, x, lang) for k, x in use) / max(len(use), 1)
        if not words(text):
            return "und", 0.0
        best = max(languages, key=lambda lang: (total[lang], -languages.index(lang)))
        return best, 1 / sum(math.exp(total[x] - total[best]) for x in languages)

    return [score(t) for t in text]


def test_every_document_scores_as_by_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(900_000 + i, t, None) for i, t in enumerate([None, "", "१२३", "हिन्दी cafe\u0301", "ǅungla ſtraße İstanbul", "zz qq"])]
    docs = docs.unionByName(spark.createDataFrame([*odd, odd[3]], docs.schema))
    rows = docs.collect()
    learn = [(r.text, r.lang) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    got = li.identify(docs, li.fit(docs.where(~li.held_out(F.col("doc_id"))))).collect()
    assert len(got) == len(rows)
    want = dict(zip([r.text for r in rows], _plain(learn, [r.text for r in rows])))
    for r in got:
        assert r.lang_pred == want[r.text][0] and r.score == pytest.approx(want[r.text][1], abs=1e-9), r.doc_id


def test_size_of_the_model_is_checked(documents):
    docs = documents((1, "a b", "x"), (2, "b c", "y"))
    with pytest.raises(ValueError, match="fewer documents"):
        li.fit(docs, max_entries=5)


def test_long_texts_and_small_caches(documents, model, monkeypatch):
    monkeypatch.setattr(li, "_PIECE", 100)
    text = " ".join(f"haus{'e' * (i % 50)}" for i in range(5000))
    assert li.Scorer(model)(text)[0] == "de"
    assert sum(map(len, li._pieces(text))) == len(text)


def test_cached_vectors_are_forgotten_safely(model, monkeypatch):
    words = [f"hund{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    whole = li.Scorer(model)(" ".join(words))
    monkeypatch.setattr(li, "_CACHED", 20)
    small = li.Scorer(model)
    assert small(" ".join(words))[0] == whole[0] and small(" ".join(words))[1] == pytest.approx(whole[1])


def test_held_out_rule(documents):
    docs = documents(*[(i, "x") for i in range(50)], (None, "y"))
    got = {r.doc_id: r.h for r in docs.select("doc_id", li.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)} | {None: False}


def test_bounds_and_empty_tables(documents):
    docs = documents((1, "a", "x"), (2, "b", "y"))
    with pytest.raises(ValueError):
        li.fit(docs, max_languages=1)
    nothing = li.fit(docs.limit(0))
    assert [tuple(r)[-2:] for r in li.identify(docs, nothing).collect()] == [("und", 0.0)] * 2
    assert li.identify(docs.limit(0), li.fit(docs)).count() == 0
    small = li.fit(docs, max_words=1, max_grams=1)
    assert len(small.words) == 2 and len(small.languages) == 2


def test_chosen_items_have_their_count_in_every_language(documents):
    small = li.fit(documents((1, "x x x y", "a"), (2, "p p p q q q x x", "b")), max_words=1)
    assert set(small.words) == {"p", "x"} and small.languages == ["a", "b"]
    assert _vector(small, [small.words["x"]])[0] == pytest.approx([math.log(3.5 / 4), math.log(2.5 / 6)])


def test_extra_columns_stay(documents, model):
    docs = documents((1, "the dog")).withColumns({"score": F.lit("mine"), "LANG_PRED": F.lit(7)})
    out = li.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred_", "score_"]
    assert tuple(out.first())[5:8] == ("mine", 7, "en")
