import hashlib
import random
import zlib

import pyarrow as pa

from countframe.llm import q13_runs, runs
from countframe.llm import textarrays as ta
from tests.llm.helpers import SPACE, docs_frame, hostile_rows


def brute(words, min_length=runs.MIN_LENGTH):
    """Every period, every maximal stretch: [(start, length, period)]."""
    found = {}
    for p in range(1, len(words)):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def in_blocks(texts, min_length=runs.MIN_LENGTH):
    out = {}
    for block in ta.blocks(pa.array(texts)):
        words = ta.Words(block, ta.NON_SPACE, lower=False)
        for s, n, p in runs.block_runs(words, min_length).tolist():
            row = int(words.row[s])
            out.setdefault(block.first + row, []).append((int(s - words.first[row]), n, p))
    return [out.get(i, []) for i in range(len(texts))]


def drawn():
    draw, texts = random.Random(3), []
    for _ in range(300):
        texts.append(" ".join(draw.choice("abcde"[:draw.choice([1, 2, 3, 5])]) for _ in range(draw.randrange(80))))
        unit = [draw.choice("xyz") for _ in range(draw.randrange(1, 9))]
        texts.append(" ".join((unit * 30)[:draw.randrange(1, 90)] + [draw.choice("xq")] + (unit * 9)[:draw.randrange(1, 40)]))
    return texts


def test_equals_brute_force():
    texts = drawn()
    for least in (2, 3, 7, 12):
        assert in_blocks(texts, least) == [brute(t.split(), least) for t in texts]


def test_many_left_words_and_long_stretches_end():
    """One node with thousands of classes, one with one class, both nested."""
    texts = ["a " * 30_000, " ".join(f"x{i} " + "a " * 60 for i in range(500)),
             " ".join(f"one phrase of six words here {i % 4999}" for i in range(10_000))]
    got = in_blocks(texts)
    assert got[0] == [(0, 30_000, 1)]
    assert got[1] == [(61 * i + 1, 60, 1) for i in range(500)]
    assert got[2] == [(0, 70_000, 7 * 4999)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want, marked = {}, 0
    for r in docs:
        words, h = SPACE.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            marked += 1
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 3000:
            continue                             # the brute force is quadratic
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want[r.doc_id] = (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
                          hashlib.sha256(collapsed(words, found).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in q13_runs.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and marked > 5 and sum(w[0] > 0 for w in want.values()) > 5
    assert {i: got[i] for i in want} == want


def test_edge_cases(spark):
    docs = docs_frame(spark, hostile_rows() + [(8, "again " * 20, None, None), (8, "again " * 20, None, None), (9, "\t".join("ab" * 9), None, None)])
    rows = runs.detect(docs.selectExpr("*", "1 AS runs", "2 AS row", "3 AS found")).collect()
    assert len(rows) == docs.count() and rows[0].row == 2
    for r in rows:
        words = SPACE.findall(r.text or "")
        assert r.n_words == len(words)
        if r.doc_id == 5:
            continue
        found = brute(words)
        assert [tuple(x) for x in r.runs] == found and r.collapsed == collapsed(words, found)
    assert [r.collapsed for r in rows if r.doc_id in (8, 9)] == ["again", "again", "a b"]
    assert runs.detect(docs.limit(0)).count() == 0
