import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from countframe.llm import substrings as ss
from tests.llm.helpers import SPACE, docs_frame, hostile_rows


def brute(texts, window=ss.WINDOW):
    """[(n_words, n_removed, kept)]: every window counted as a tuple of words."""
    words = [SPACE.findall(t or "") for t in texts]
    times = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def removed(spark, rows, **how):
    got = ss.remove(docs_frame(spark, rows), **how).collect()
    return Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept) for r in got)


def expected(rows, window=ss.WINDOW):
    return Counter((r[0], r[1], *b) for r, b in zip(rows, brute([r[1] for r in rows], window)))


def corpus(n=120):
    """Shared passages of 34 to 60 words at random places, copies, periodic and short texts."""
    draw = random.Random(11)
    new = lambda k: [f"w{draw.randrange(4000)}" for _ in range(k)]
    passages = [new(k) for k in (34, 35, 36, 50, 60)]
    rows = []
    for i in range(n):
        parts = new(draw.randrange(5, 60))
        for _ in range(draw.randrange(3)):
            parts += draw.choice(passages) + new(draw.randrange(4))
        rows.append((i, draw.choice([" ", "\n", "  "]).join(parts)))
    rows += [(n + 1, rows[0][1]), (n + 2, rows[1][1] + " and more"), (n + 3, "again " * 200), (n + 4, "a b c " * 11 + "a"),
             (n + 5, "a b c " * 12 + "a"), (n + 6, "Again " * 35), (n + 7, "　".join(["x y"] * 17) + " z")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert removed(spark, rows) == expected(rows)
    assert removed(spark, rows, window=6) == expected(rows, 6)


def in_process(rows, twice, monkeypatch, tasks=3):
    """Both steps of the grouping without Spark: {row: removed positions}."""
    monkeypatch.setattr(ss, "BATCH_BYTES", 300)
    texts = [t or "" for _, t in rows]
    whole = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(rows)), pa.int64()), pa.array([7] * len(rows), pa.int64())], ["text", "k1", "k2"])
    send, parts, sent = ss._send(SimpleNamespace(value=twice), 4, ss.WINDOW), 4, []
    for t in range(tasks):
        mine = whole.take(pa.array(range(t, len(rows), tasks)))
        sent += list(send(mine.slice(i, 2) for i in range(0, len(mine), 2)))
    out = {}
    for part in range(parts):
        own = [b.filter(pc.equal(b.column("part"), part)) for b in sent]
        for batch in ss._group(ss.WINDOW)(b for b in own if b.num_rows):
            for k, raw in zip(batch.column("k1").to_pylist(), batch.column("spans").to_pylist()):
                for s, e in np.frombuffer(raw, np.int32).reshape(-1, 2):
                    out.setdefault(k, set()).update(range(s, e))
    return out, len(sent)


def test_full_sketch_and_small_batches_lose_nothing(spark, monkeypatch):
    """All windows estimated repeated, settled in many batches; and a sketch in use."""
    rows = corpus(60)
    want = {i: b[1] for i, b in enumerate(brute([r[1] for r in rows])) if b[1]}
    twice = ss.sketched(docs_frame(spark, rows).select("text"), 1 << 16)
    for estimate in (np.full(ss.CHUNK, 255, np.uint8), twice):
        got, batches = in_process(rows, estimate, monkeypatch)
        assert {i: len(v) for i, v in got.items()} == want and batches > 30


def test_sketch_is_never_too_low():
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 1 << 63, 5000, dtype=np.uint64)
    sent = np.concatenate([keys, keys[:700]])
    for cells in (1 << 15, 1 << 18):
        sketches = [ss.Sketch(cells) for _ in range(4)]
        for sketch, part in zip(sketches, np.array_split(sent, 4)):
            for some in np.array_split(part, 3):
                sketch.add(some)
        rows = [pa.RecordBatch.from_arrays([pa.array(range(cells // 8 // ss.CHUNK), pa.int32()), *(
            pa.array([c.tobytes() for c in bits.reshape(-1, ss.CHUNK)], pa.binary()) for bits in (s.once, s.twice))], ["chunk", "once", "twice"]) for s in sketches]
        twice = np.zeros(cells // 8, np.uint8)
        for batch in ss._merge(rows):
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                twice[c * ss.CHUNK:(c + 1) * ss.CHUNK] = np.frombuffer(t, np.uint8)
        found = ss.perhaps_repeated(keys, twice)
        assert found[:700].all()
        if cells == 1 << 18:
            assert found[700:].mean() < 0.05


def test_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [r[:2] for r in hostile_rows()] + [(None, passage), (8, f"one {passage}"), (8, f"{passage} two"), (9, passage[:-4]), (10, passage), (10, passage)]
    assert removed(spark, rows) == expected(rows)
    docs = docs_frame(spark, rows)
    clash = docs.selectExpr("concat('k', doc_id) AS doc_id", "text", "1 AS k1", "2 AS spans", "3 AS kept", "4 AS row")
    out = ss.remove(clash)
    assert out.columns == ["doc_id", "text", "k1", "spans", "row", "n_words", "n_removed", "kept"]
    assert Counter((r.n_removed, r.k1, r.row) for r in out.collect()) == Counter((b[1], 1, 4) for b in brute([r[1] for r in rows]))
    assert ss.remove(docs.limit(0)).count() == 0
