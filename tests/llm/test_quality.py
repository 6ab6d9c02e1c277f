import numpy as np

import __spark_entry__ as E
from countframe.llm import quality
from tests.llm.helpers import docs_frame, hostile_rows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = E.queries()["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    majority = max(held.quality.mean(), 1 - held.quality.mean())
    assert (held.predicted == held.quality).mean() > max(0.93, majority)
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    a = (2 * y - 1)[:, None] * [1.5, 0.0] + rng.normal(size=(2000, 2))
    b = (2 * y - 1)[:, None] * [0.0, 1.5] + rng.normal(size=(2000, 2))
    few = slice(0, 20)
    one, two = quality.co_train(y[few].astype(float), a[few], b[few], a[20:], b[20:], 5, 0.9)
    alone, _ = quality.co_train(y[few].astype(float), a[few], b[few], a[:0], b[:0], 5, 0.9)
    right = lambda v, x: np.mean((v.log_odds(x) > 0) == y)
    assert right(one, a) >= right(alone, a) - 0.01 and right(two, b) > 0.9


def test_edge_cases(spark):
    docs = docs_frame(spark, hostile_rows())
    labels = spark.createDataFrame([(2, 0), (4, 1), (4, 0), (None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(hostile_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.0}
    assert quality.score(docs.limit(0), none).count() == 0
    clash = docs.selectExpr("doc_id", "text", "lang", "source", "1 AS score", "2 AS y", "3 AS p", "4 AS k")
    assert quality.score(clash, quality.train(clash, labels)).columns == ["doc_id", "text", "lang", "source", "score", "y", "p", "k", "predicted"]
