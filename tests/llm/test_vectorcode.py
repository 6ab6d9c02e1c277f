import hashlib
from collections import Counter

import numpy as np
import pytest

from countframe.llm import q12_vectorcode
from countframe.llm import vectorcode as vc


def nearest(x, book):
    """(index, squared distance) of the nearest entry, every one measured."""
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def brute(ids, vectors, parts=4, entries=256, rounds=4):
    q = np.floor(np.asarray(vectors, float) * 1024).astype(np.int64)
    w = q.shape[1] // parts
    cut = [q[:, p * w:(p + 1) * w] for p in range(parts)]
    books = [c[np.argsort(ids, kind="stable")[:entries]] for c in cut]
    for _ in range(rounds):
        for p, c in enumerate(cut):
            code, _ = nearest(c, books[p])
            books[p] = np.array([c[code == e].sum(axis=0) // (code == e).sum() if (code == e).any() else books[p][e] for e in range(len(books[p]))])
    found = [nearest(c, b) for c, b in zip(cut, books)]
    codes = ["".join(f"{c:02x}" for c in row) for row in zip(*(f[0].tolist() for f in found))]
    return codes, sum(f[1] for f in found).tolist(), books


def test_orchard_search_finds_the_nearest():
    draw = np.random.default_rng(1)
    for k, width, spread in ((1, 3, 5), (2, 1, 2), (40, 2, 6), (256, 16, 300), (60, 4, 1)):       # few values: many ties and equal entries
        book, x = draw.integers(-spread, spread + 1, (k, width)), draw.integers(-spread, spread + 1, (500, width))
        got, want = vc.Codebook.of(book).nearest(x), nearest(x, book)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    codes, error, books = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    by_label = Counter()
    for r, e in zip(rows, error):
        by_label[r.label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    want = {r.vec_id: (c, e, by_label[r.label], digest) for r, c, e in zip(rows, codes, error)}
    assert {r[0]: tuple(r)[1:] for r in q12_vectorcode.query(spark, sf).collect()} == want


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [0.5, -0.25, 0.1, 0.0], "a"), (5, [0.5, -0.25, 0.1, 0.0], "a"), (None, [0.4, 0.0, -0.1, 0.3], None), (2, [0.0, 0.0, 0.0, -1e-9], ""),
            (3, [9.0, 9.0, 9.0, 9.0], None)]
    bad = [(1, None, "a"), (4, [0.1, None, 0.2, 0.3], "a"), (6, [nan, 0.0, 0.0, 0.0], "b"), (7, [0.0, inf, 0.0, 0.0], None), (8, [0.0, 0.0, -inf, 0.0], "a")]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in good + bad], "vec_id int, embedding array<float>, label string, code int, error int, row int")
    books = vc.learn(frame, entries=3)
    assert [len(b) for b in books] == [3] * 4
    coded = vc.encode(frame, books)
    assert coded.columns == ["vec_id", "embedding", "label", "row", "code", "error"]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0))
    codes, error, want = brute(range(len(order)), np.float32([r[1] for r in order]), entries=3)
    assert all((a == b).all() for a, b in zip(books, want))
    got = vc.with_label_error(coded).collect()
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter((r[0], c, e) for r, c, e in zip(order, codes, error))
    per = Counter()
    for r, e in zip(order, error):
        per[r[2]] += e
    assert all(r.label_error == per[r.label] for r in got)
    whole = np.floor(np.float32(order[0][1]).astype(float) * 1024)
    assert ((vc.decode(codes[0], books) - whole) ** 2).sum() == error[0]
    for none in (frame.limit(0), frame.where("vec_id = 1")):
        empty = vc.learn(none)
        assert [len(b) for b in empty] == [0] * 4 and vc.with_label_error(vc.encode(none, empty)).count() == 0
    with pytest.raises(ValueError):
        vc.learn(spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 8)], "vec_id int, embedding array<double>"))


def test_rare_and_hot_labels(spark):
    rows = [(i, 1 if i % 3 else None if i % 2 else i, i) for i in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id int, label int, error bigint")
    per = Counter()
    for _, label, e in rows:
        per[label] += e
    got = vc.with_label_error(frame).collect()
    assert len(got) == 6000 and all(r.label_error == per[r.label] for r in got)
