"""Indexed nearest neighbours: pivots are exact, inverted lists reach their recall."""

import numpy as np
import pytest

from countframe.operators import knnindex as ki


def exact(q, t, k, exclude_self=False):
    """{query: [(id, distance)]} from every pair; q and t are {id: vector}."""
    out = {}
    for a, x in q.items():
        near = sorted((np.floor(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()) * 1e6 + 0.5) / 1e6, b) for b, y in t.items()
                      if not (exclude_self and a == b))
        out[a] = [(b, d) for d, b in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.ref_id, r.dist))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in rows.items()], "cell_id long, vec array<double>")


def clustered(n, dim=6, seed=1):
    """Half of all rows close together, a third of those one vector, the rest in clusters."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim)) * 8
    rows = {}
    for i in range(n):
        if i % 6 == 0:
            rows[i] = np.full(dim, 0.25)
        elif i % 2 == 0:
            rows[i] = draw.normal(size=dim) * 0.05
        else:
            rows[i] = centres[i % 12] + draw.normal(size=dim)
    return rows


def test_pivots_equal_all_pairs_and_leave_blocks_out(spark):
    rows = clustered(900)
    t = frame(spark, rows)
    q = {i: v for i, v in rows.items() if i % 7 == 0} | {10_000 + j: np.random.default_rng(j).normal(size=6) * 9 for j in range(20)}
    index = ki.PivotIndex.build(t, 10, block_rows=32)
    assert found(index.search(frame(spark, q), 10, block_rows=32)) == exact(q, rows, 10)
    met = index.meetings
    print(f"\n{met.met} of {met.full} (query, block) meetings, {met.row_pairs} of {met.all_row_pairs} row pairs")
    assert met.met < 0.4 * met.full and met.queries == len(q)
    graph = found(index.search(t, 5, exclude_self=True, block_rows=32))
    assert graph == exact(rows, rows, 5, exclude_self=True)
    with pytest.raises(ValueError):
        index.search(t, 11)


def test_pivots_with_few_rows_ties_and_nulls(spark):
    t = {1: [0.0, 0.0], 2: [0.0, 0.0], 3: [3.0, 4.0], -5: [0.0, 0.0]}
    q = {1: [0.0, 0.0], 9: [3.0, 4.0]}
    assert found(ki.knn_pivot(frame(spark, q), frame(spark, t), 15)) == exact(q, t, 15)
    assert found(ki.knn_pivot(frame(spark, q), frame(spark, t), 2, block_rows=1)) == exact(q, t, 2)
    none = spark.createDataFrame([(7, None)], "cell_id long, vec array<double>")
    assert ki.knn_pivot(frame(spark, q), none, 3).count() == 0 and ki.knn_pivot(none, frame(spark, t), 3).count() == 0
    assert ki.knn_approximate(frame(spark, q), none, 3).count() == 0 and ki.knn_approximate(none, frame(spark, t), 3).count() == 0
    same = {i: [1.0, 2.0] for i in range(400)}
    assert found(ki.knn_pivot(frame(spark, same), frame(spark, same), 3, exclude_self=True, block_rows=16)) == exact(same, same, 3, True)
    assert ki.without_spare_copies(frame(spark, same).withColumnRenamed("cell_id", "id"), 3).count() == 4


def test_a_list_with_half_of_all_rows_is_split(spark):
    work = {}
    for n in (600, 2400):
        rows = clustered(n)
        t = frame(spark, rows)
        index = ki.InvertedIndex.build(t, 10, list_rows=25)
        got = ki.recall(index.search(t, 10, probes=8, exclude_self=True), ki.knn_pivot(t, t, 10, exclude_self=True)).first()
        assert got["hit"] >= 0.9 * got["wanted"] and got["wanted"] == 10 * n
        assert index.size.max() <= 3 * 25 and index.size.sum() <= n * 5 / 6 + 11
        assert index.meetings.met == 8 * n
        work[n] = index.meetings.row_pairs
    assert work[2400] < 1.5 * 4 * work[600]              # in proportion to the rows, not their square


def test_a_query_is_sent_once_per_group_and_pieces_are_bounded(spark, monkeypatch):
    """Copies of queries are counted in groups of blocks, not in blocks; groups,
    slices and pieces of any size give the same rows."""
    from countframe.operators import neighbors as nb

    rows = clustered(500)
    t = frame(spark, rows)
    index = ki.PivotIndex.build(t, 10, block_rows=8)
    want = exact(rows, rows, 10, exclude_self=True)
    sent = []
    kept = ki.cut_lineage
    monkeypatch.setattr(ki, "cut_lineage", lambda df: sent.append(kept(df)) or sent[-1])
    assert found(index.search(t, 10, exclude_self=True)) == want
    met = [d for d in sent if "grp" in d.columns]
    assert len(index.size) > 20 and sum(d.count() for d in met) <= 2 * len(rows) < index.meetings.met
    monkeypatch.setattr(ki, "GROUP_ROWS", 50)
    monkeypatch.setattr(ki, "SLICE_ROWS", 64)
    assert found(index.search(t, 10, exclude_self=True)) == want
    x, ids = np.array(list(rows.values())), np.array(list(rows))
    whole = nb.nearest(x, ids, x, ids, 10, True)
    monkeypatch.setattr(nb, "Q_STEP", 7)
    monkeypatch.setattr(nb, "T_STEP", 11)
    small = nb.nearest(x, ids, x, ids, 10, True)
    assert all((a == b).all() for a, b in zip(whole, small))
    same = np.zeros((3000, 4))
    row, col, dist = nb.nearest(same, np.arange(3000), same, np.arange(3000), 3, False)
    assert (col.reshape(-1, 3) == [0, 1, 2]).all() and not dist.any()
    assert found(nb.knn_join(t, t, 10, exclude_self=True, broadcast_bytes=0)) == want == found(nb.knn_join(t, t, 10, exclude_self=True))
