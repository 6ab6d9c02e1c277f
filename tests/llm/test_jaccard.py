import random

import numpy as np
import pytest

from countframe.llm import jaccard
from countframe.llm.components import connect
from tests.llm.helpers import components, docs_frame, hostile_rows, jaccard as exact, shingle_set


def brute(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    low = components(range(n), links)
    group = {}
    for i in range(n):
        group.setdefault(low[i], []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in group.items()}
    return sorted(((rows[i][0], len(sets[i]), least[low[i]]) for i in range(n)), key=str)


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[at] = f"e{rng.randrange(10 ** 6)}"
        elif kind < 0.7:
            del w[at]
        else:
            w.insert(at, f"i{rng.randrange(10 ** 6)}")
    return w


def corpus(seed, n=420):
    """Families of near copies around the threshold, short texts, and texts
    that share a long passage."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    rows, bases = [], [rng.choices(vocabulary, k=rng.choice([3, 6, 9, 14, 30, 60, 120, 200])) for _ in range(25)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.55:
            b = rng.choice(bases)
            w = edited(rng, b, rng.randrange(0, 1 + len(b) // 12) if len(b) > 8 else rng.randrange(0, 2))
        elif kind < 0.8:
            w = rng.choices(vocabulary, k=30) + passage + rng.choices(vocabulary, k=30)
        else:
            w = rng.choices(vocabulary, k=rng.randrange(0, 12))
        rows.append((i * 3 - 50, " ".join(w)))
    return rows


def result(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,hot", [(1, 64), (2, 3)])
def test_equals_brute_force(spark, seed, hot):
    rows = corpus(seed)
    assert result(jaccard.cluster(docs_frame(spark, rows), hot=hot)) == brute(rows)


def test_one_large_family_with_hot_keys(spark):
    """Hot keys everywhere: deletion neighbourhoods decide the outliers."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 9)))) for i in range(150)]
    assert result(jaccard.cluster(docs_frame(spark, rows), hot=4)) == brute(rows)


def test_pairs_do_not_grow_with_the_square_of_a_family(spark, monkeypatch):
    """Members that are about half alike, each with words of its own: no pigeonhole
    tells them apart, but what each has alone does."""
    rng = random.Random(11)
    passage, count = [f"v{rng.randrange(10 ** 6)}" for _ in range(800)], 120
    rows = [(i, " ".join(passage + [f"o{i}x{rng.randrange(10 ** 6)}" for _ in range(400)])) for i in range(count)]
    rows.append((count, " ".join(passage[:-20] + ["end"])))
    rows.append((count + 1, " ".join(passage[30:])))
    verified, whole = [], jaccard.verify

    def verify(pairs, *rest):
        verified.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(jaccard, "verify", verify)
    assert result(jaccard.cluster(docs_frame(spark, rows))) == brute(rows)
    assert sum(verified[1:]) < count, verified      # after the first stars


def test_prefixes_keep_every_link(spark):
    """All pairs of sets in components of their own, hashes dealt over copies."""
    rng = random.Random(13)
    sets, common = [], rng.sample(range(10 ** 9), 200)
    for i in range(70):
        n = rng.randrange(3, 120)
        at = rng.randrange(0, 200 - n)
        sets.append(sorted(set(common[at:at + n]) | {rng.randrange(10 ** 9) for _ in range(rng.randrange(0, n // 4 + 1))}))
    frame = spark.createDataFrame([(i, len(h), i // 2, np.array(h, np.int64).tobytes()) for i, h in enumerate(sets)],
                                  "node bigint, n bigint, comp bigint, hashes binary")
    linked = {(i, j) for j in range(70) for i in range(j) if i // 2 != j // 2
              and 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    for hot in (4096, 2):
        got = {(r.a, r.b) for r in jaccard.prefix_pairs(frame, 75, hot).collect()}
        assert linked and linked <= got and len(got) < 70 * 69 // 4


def test_edge_cases(spark):
    rows = [r[:2] for r in hostile_rows()]
    assert result(jaccard.cluster(docs_frame(spark, rows))) == brute(rows)
    empty = docs_frame(spark, rows).limit(0)
    assert jaccard.cluster(empty).count() == 0
    clash = docs_frame(spark, rows).selectExpr("doc_id", "text", "1 AS id", "2 AS node", "3 AS key", "4 AS comp")
    assert result(jaccard.cluster(clash)) == brute(rows)


def test_links_count_and_other_thresholds(spark):
    rows = corpus(7, 120)
    got = jaccard.cluster(docs_frame(spark, rows), percent=60)
    assert result(got) == brute(rows, 60)


def test_pigeonhole_bound():
    """Linked sets differ in fewer tokens than their band has segments."""
    for p in (60, 75, 90):
        bands = jaccard.Bands(p, 10 ** 6)
        for n in list(range(3, 400)) + [10 ** 4, 10 ** 5]:
            for which, band, differ in bands.places(np.array([n])):
                assert all(bands.segments[b] > d for b, d in zip(band, differ))
            big = n * 100 // p                        # the largest partner meets it in its own band
            own = int(bands.band(np.array([n]))[0])
            met = {int(b) for _, bb, _ in bands.places(np.array([big])) for b in bb}
            assert n * (100 - p) < p or own in met


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for n in (5, 80, 700):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[: n * 7 // 8], rng.integers(0, 1 << 63, rng.integers(0, n), dtype=np.uint64)])
            differ, common = len(np.setxor1d(a, b)), len(np.intersect1d(a, b))
            narrow = int(np.bitwise_count(jaccard.parity(a, 512) ^ jaccard.parity(b, 512)).sum())
            assert narrow <= differ and jaccard.least_difference(jaccard.wide_parity(a), jaccard.wide_parity(b)) <= differ
            assert jaccard.most_common(jaccard.bucket_counts(a), jaccard.bucket_counts(b), len(a), len(b)) >= common


def test_components(spark):
    rng = random.Random(3)
    links = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(170)]
    links += [(f"9{i:03d}", f"9{i + 1:03d}") for i in range(60)]              # a long chain
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.comp for r in connect(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == components({x for e in links for x in e}, links)


def test_exact_helper():
    assert exact(shingle_set("a b c d e f"), shingle_set("a b c d e g")) == 1 / 3
