import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

import __spark_entry__ as E
from countframe.llm import language
from countframe.llm import textarrays as ta
from tests.llm.helpers import docs_frame, hostile_rows

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    """Hashed n-grams, one at a time."""
    seq = " "
    for c in (text or "").lower():
        if c.isalpha():
            seq += c
        elif seq[-1] != " ":
            seq += " "
    out = []
    for n in language.ORDERS:
        for i in range(len(seq) - n + 1):
            g = seq[i:i + n]
            if g.strip():
                acc = n * 0x9E3779B1 & 0xFFFFFFFF
                for c in g:
                    acc = (acc ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
                    acc ^= acc >> 15
                out.append((acc * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language.BITS))
    return sorted(out)


def test_grams_equal_brute_force():
    texts = ["Hello, wörld!  42 ok", None, "", "...", "a", "É è", "x\ny", "end "]
    got = []
    for block in ta.blocks(pa.array(texts), 9):
        first, bucket, some = language.grams(block)
        got += [(sorted(bucket[first[r]:first[r + 1]].tolist()), bool(some[r])) for r in range(block.n)]
    assert got == [(brute_grams(t), any(c.isalpha() for c in t or "")) for t in texts]


def peak_mb(model, texts):
    model.predict(pa.array(texts[:1]))         # imports and tables
    tracemalloc.start()
    model.predict(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_scoring_holds_the_ngrams_of_a_small_block():
    model = language.NaiveBayes(["a", "b"], np.ones(2), np.ones((2, 1 << language.BITS)))
    assert peak_mb(model, ["the cat and the dog, " * 100] * 1000) < 25          # 2.1 MB in a batch
    assert peak_mb(model, ["the cat and the dog, " * 50_000]) < 110             # one text of 1.05 MB


def test_scores_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    model = language.NaiveBayes(["a", "b", "c"], np.ones(3), rng.integers(0, 50, (3, 1 << language.BITS)).astype(float))
    texts = ["".join(rng.choice(list("abcdé ñ.,1"), int(n))) for n in rng.integers(0, 90, 300)] + [None, "", "a"]
    whole = model.predict(pa.array(texts))
    monkeypatch.setattr(language, "BLOCK_BYTES", 50)
    assert model.predict(pa.array(texts)) == whole


def test_naive_bayes_equals_brute_force(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "der hund und die katze", "de"), (4, "the end", "en")]
    model = language.train(docs_frame(spark, rows))
    assert model.languages == ["de", "en", "fr"]
    counts = {}
    for _, t, g in rows:
        for b in brute_grams(t):
            counts.setdefault(g, {}).setdefault(b, 0)
            counts[g][b] += 1
    size = 1 << language.BITS
    prior = {"de": 1 / 4, "en": 2 / 4, "fr": 1 / 4}
    for text in ["the hund", "le", "chat chien katze"]:
        fit = {g: math.log(prior[g]) + sum(math.log((c.get(b, 0) + language.SMOOTHING) / (sum(c.values()) + language.SMOOTHING * size))
                                           for b in brute_grams(text)) for g, c in counts.items()}
        best = max(sorted(fit), key=lambda g: fit[g])
        score = 1 / sum(math.exp(v - fit[best]) for v in fit.values())
        langs, scores = model.predict(pa.array([text]))
        assert langs == [best] and abs(scores[0] - score) < 1e-9


def test_edge_cases(spark):
    docs = docs_frame(spark, hostile_rows())
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()]
    assert len(got) == len(hostile_rows())
    assert {g for i, g, _ in got if i in (1, 2, 3, 6)} == {"und"} and all(s == 0 for i, _, s in got if i in (1, 2, 3, 6))
    empty = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", "lang", "'x' AS lang_pred", "7 AS bucket")
    assert language.predict(clash, language.train(clash)).columns == ["doc_id", "text", "lang", "lang_pred", "bucket", "score"]


def test_query_folds_and_accuracy(spark):
    got = E.queries()["op3_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_sample_bound(spark):
    rows = [(i, "aa bb cc", "en") for i in range(400)] + [(1000 + i, "le la les", "fr") for i in range(20)]
    model = language.train(docs_frame(spark, rows), max_docs=50)
    assert model.languages == ["en", "fr"] and model.prior[0] > model.prior[1]
    assert model.predict(pa.array(["les la", "bb aa"]))[0] == ["fr", "en"]
