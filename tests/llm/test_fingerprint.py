import hashlib

import numpy as np
import pyarrow as pa

from countframe.llm import fingerprint as fp
from countframe.llm import textarrays as ta
from tests.llm.helpers import docs_frame, hostile_rows, jaccard, shingle_set

TEXTS = ["", None, "one", "one two three four five six", " ".join(f"a{i}" for i in range(400)), "one", " \n", "x " * 40]


def brute(text):
    """Low bits per bin, one bin at a time; None for the empty set."""
    hashes = [int(h) for _, _, hs in ta.shingle_sets(pa.array([text or ""]), fp.SHINGLE) for h in hs]
    if not hashes:
        return None
    low = {}
    for h in hashes:
        b = h >> 56
        low[b] = min(low.get(b, h), h)
    out = []
    for b in range(fp.BINS):
        attempt, at = 0, b
        while at not in low:
            attempt += 1
            at = int(fp.lender(fp.BINS, np.array([b]), attempt)[0])
        out.append(low[at] & 255)
    return out


def test_equals_brute_force():
    s = fp.Sketches(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert (not s.some[i]) if want is None else s.low[i].tolist() == want
        assert s.hex()[i] == ("" if want is None else bytes(want).hex())
        if want:
            assert fp.unpack(s.hex()[i]).tolist() == want


def test_packing_of_other_widths():
    v = np.arange(256, dtype=np.uint8) % 16
    assert fp.unpack(fp.pack(v, 4), 256, 4).tolist() == v.tolist() and len(fp.pack(v, 4)) == 256
    assert fp.unpack(fp.pack(v % 2, 1), 256, 1).tolist() == (v % 2).tolist()


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(4)
    errors = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10 ** 6, 300)]
        other = list(words)
        for at in rng.integers(0, 300, k):
            other[at] = f"n{at}{k}"
        a, b = " ".join(words), " ".join(other)
        s = fp.Sketches(pa.array([a, b]))
        got = fp.likeness(s.low[:1], s.low[1:], s.some[:1], s.some[1:])[0]
        errors.append(got - jaccard(shingle_set(a), shingle_set(b)))
    assert abs(np.mean(errors)) < 0.015 and np.abs(errors).max() < 0.12


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, r in enumerate(rows):
        t, nxt = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t)
        e = t[:n - n // 2] + nxt[:n // 2]
        out.append((str(r[0]), n, hashlib.sha256(e.encode()).hexdigest(), brute(t) and bytes(brute(t)).hex() or "", brute(e) and bytes(brute(e)).hex() or ""))
    return sorted(out)


def test_next_document_across_ranges(spark):
    rows = [(i * 17 % 1009 - 300, f"text {i} " + "abc é\U0001F600 " * (i % 9)) for i in range(120)] + [r[:2] for r in hostile_rows()]
    got = fp.compare_with_next(docs_frame(spark, rows)).collect()
    have = sorted((str(r.id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got)
    assert have == want(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    alone = fp.compare_with_next(docs_frame(spark, [(1, "abcd")])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone[0].near_next == 1.0


def test_general_interface_and_empty_tables(spark):
    docs = docs_frame(spark, hostile_rows())
    both = fp.fingerprint(fp.fingerprint(docs), out="other").withColumn("alike", fp.packed_likeness("fingerprint", "other")).collect()
    assert all(r.alike == 1.0 and r.fingerprint == r.other for r in both)
    assert fp.fingerprint(docs.limit(0)).count() == 0 and fp.compare_with_next(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS part", "2 AS tail", "3 AS id", "4 AS fingerprint")
    assert fp.compare_with_next(clash).count() == len(hostile_rows())
    assert fp.fingerprint(clash).columns == ["doc_id", "text", "part", "tail", "id", "fingerprint"]
