import hashlib

import pytest

from countframe.llm import decontaminate
from tests.llm.helpers import ALNUM, LOWER, docs_frame, hostile_rows

W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu".split()
ITEMS = [(1, " ".join(W)), (2, "Short item"), (3, None), (4, ""), (5, " ".join(W)), (None, "nameless passage of text"),
         (2, "Short item"), (6, "ab-ab ab AB ab ab ab ab ab ab ab")]


def brute(text, items, n=10):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = ALNUM.findall((t or "").translate(LOWER))
        if not v:
            continue
        size = min(n, len(v))
        wins = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(item)
    names = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


DOCS = hostile_rows() + [
    (10, "x " + " ".join(W[:10]) + " y"), (11, "x " + " ".join(W[:9])), (12, "a short, ITEM indeed; short item"),
    (13, " ".join(W) + ". " + " ".join(W)), (14, "nameless passage of text"), (15, "ab " * 30), (16, "short\nitem"),
    (17, "short é item")]


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_BYTES, 40])
def test_equals_brute_force_in_one_or_many_blocks(spark, bench, limit):
    docs = docs_frame(spark, DOCS)
    got = decontaminate.scan(docs, bench, max_broadcast_bytes=limit).collect()
    want = sorted(((r[0], r[1]) + brute(r[1], ITEMS) for r in DOCS), key=str)
    have = sorted(((r.doc_id, r.text, r.n_words, r.n_hit, len(r["items"]),
                    hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got), key=str)
    assert have == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_modes(spark, bench):
    docs = docs_frame(spark, DOCS)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    clean = [r for r in DOCS if not brute(r[1], ITEMS)[1]]
    assert sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(str(r[0]) for r in clean)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, mode="span").collect()}
    assert cut[10] == "x  y" and cut[12] == "a  indeed; " and 13 not in cut and cut[17] == "short é item"
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, mode="other")


def test_empty_tables_and_clashing_columns(spark, bench):
    docs = docs_frame(spark, DOCS)
    none = decontaminate.scan(docs, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(DOCS)
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    clash = docs.selectExpr("doc_id", "text", "'a' AS n_hit", "1 AS item_id", "2 AS spans", "3 AS contaminated", "4 AS `a.b`")
    kept = decontaminate.decontaminate(clash, bench)
    assert kept.columns == clash.columns and kept.first().n_hit == "a"
