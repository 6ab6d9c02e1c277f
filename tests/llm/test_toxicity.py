import itertools

import numpy as np
import pyarrow as pa

import __spark_entry__ as E
from countframe.llm import textarrays as ta
from countframe.llm import toxicity as tx
from tests.llm.helpers import docs_frame, hostile_rows


def code(word):
    return bytes(ord(c) - 96 for c in word)


def brute(a, b):
    """Gap-weighted common 3-subsequences of bounded span."""
    def phi(s):
        out = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < tx.SPAN:
                u = s[i] + s[j] + s[k]
                out[u] = out.get(u, 0.0) + tx.DECAY ** (k - i + 1)
        return out

    dot = lambda x, y: sum(v * y.get(u, 0.0) for u, v in x.items())
    x, y = phi(a), phi(b)
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernel_equals_brute_force():
    marks = ["idiot", "pathetic", "scum", "moron"]
    model = tx.Model([code(m) for m in marks])
    for word in ["idiot", "idxiot", "iiddiioott", "pathos", "mum", "ab", "unrelatedwordofsomelength"[:24]]:
        got = model.kernel(np.frombuffer(code(word), np.uint8)[None])[0]
        assert np.allclose(got, [brute(word, m) for m in marks], atol=1e-5)
        model.weight = np.array([0.5, -1.0, 2.0, 0.1], np.float32)
        model.value = (model.table @ model.weight)[model.lut]
        assert np.allclose(model.decide(np.frombuffer(code(word), np.uint8)[None])[0], got @ model.weight, atol=1e-5)


def test_tokens_join_spaced_letters_and_drop_punctuation():
    block = next(ta.blocks(pa.array(["The i d i o t! id*iot a b", None, "", "o'neill"])))
    t = tx.Tokens(block)
    words = [(int(t.row[i]), "".join(chr(96 + c) for c in t.symbols(i))) for i in range(len(t.row))]
    assert words == [(0, "the"), (0, "idiot"), (0, "idiot"), (0, "a"), (0, "b"), (3, "oneill")]


def make(spark, n=240):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abdefghlnorstu"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 60))
        bad = i % 4 == 0
        if bad:
            at = rng.integers(0, len(text))
            text = text[:at] + " " + rng.choice(["moronic", "mor0onic", "m o r o n i c", "mor-onic", "moronixc"]) + " " + text[at:]
        rows.append((i, text))
        labels.append((i, int(bad)))
    return docs_frame(spark, rows + [(-1, None), (-2, ""), (-3, "z" * 5000 + "moronic" + "q" * 5000)]), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_finds_gapped_and_inserted_variants(spark):
    docs, labels = make(spark)
    train = labels.where("doc_id < 180")
    got = {r.doc_id: r for r in tx.score(docs, tx.train(docs, train)).collect()}
    held = [(got[i].predicted, int(i % 4 == 0)) for i in range(180, 240)]
    assert np.mean([p == t for p, t in held]) >= 0.95
    assert got[-1].score == got[-2].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())


def test_edge_cases(spark):
    docs = docs_frame(spark, hostile_rows())
    labels = spark.createDataFrame([(2, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert tx.score(docs, tx.train(docs, labels)).count() == len(hostile_rows())
    none = tx.train(docs, labels.limit(0))
    assert {r.score for r in tx.score(docs, none).collect()} == {0.0}
    assert tx.score(docs.limit(0), none).count() == 0
    assert tx.train(docs, labels.where("toxic = 1")).share == 1.0
    clash = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS k", "3 AS y")
    assert tx.score(clash, tx.train(clash, labels)).columns == ["doc_id", "text", "score", "k", "y", "predicted"]


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = E.queries()["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got[got.toxic == 1].predicted.mean() > 0.85
