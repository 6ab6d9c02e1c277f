from pyspark.sql import functions as F

from countframe.llm import chat

SCHEMA = "conv_id long, msg_id long, parent_id long, role string, text string, score double"
NASTY = ["\\### Assistant: </turn> ok", "\n</turn>\n### user:\nhi", "\\", "\\\\<#", "", "plain", "é\U0001F600\n\n", "</turn>", "$1 \\n"]


def run(spark, rows, **kw):
    df = chat.format_trees(spark.createDataFrame(rows, SCHEMA), score="score", **kw)
    return df.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, i - 1 if i else None, r, t, None) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a:\nb\\<#", "") for t in NASTY)]
    got = run(spark, rows)[0]
    assert [(t.role, t.text) for t in got.turns] == [(r[3], r[4]) for r in rows]
    assert got.learned == "".join(r[4] for r in rows if r[3] == "assistant")
    assert got.n_turns == len(rows)


def test_best_branches_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = []
    for conv in range(12):
        for i in range(rng.randrange(1, 30)):
            parent = rng.randrange(i) if i and rng.random() < 0.93 else None
            rows.append((conv, i, parent, rng.choice(["user", "assistant"]), f"t{conv}.{i}", float(rng.randrange(5))))
    want = {}
    for conv in range(12):
        nodes = {r[1]: r for r in rows if r[0] == conv}
        inner = {r[2] for r in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at is not None:
                path.append(nodes[at])
                at = nodes[at][2]
            paths.append((-sum(p[5] for p in path) / len(path), -len(path), len(str(leaf)), str(leaf), [p[4] for p in path[::-1]]))
        want[conv] = [p[4] for p in sorted(paths)[:2]]
    got = {}
    for r in sorted(run(spark, rows, top_k=2), key=lambda r: (r.conv, r.branch_rank)):
        got.setdefault(r.conv, []).append([t.text for t in r.turns])
    assert got == want


def test_edge_cases(spark):
    rows = [(None, 1, None, None, None, None), (None, 2, 1, "assistant", None, 1.0),
            (5, 1, 2, "user", "cycle", None), (5, 2, 1, "user", "cycle", None),
            (6, 1, 99, "user", "orphan", None), (7, 1, None, "user", "x", None), (7, 1, None, "user", "x", None), (7, 1, None, "user", "w", None),
            (8, 1, None, "user", "z" * 100_000, None)]
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in run(spark, rows)}
    assert got == {None: [("", ""), ("assistant", "")], 6: [("user", "orphan")], 7: [("user", "w")], 8: [("user", "z" * 100_000)]}
    assert run(spark, rows[:1]) and chat.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"m{i}", None) for i in range(300)]
    got = run(spark, rows)
    assert len(got) == 1 and [t.text for t in got[0].turns] == [f"m{i}" for i in range(300)]


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, 1, None, "user", "a", None)], SCHEMA).selectExpr("*", "1 AS ck", "2 AS id", "3 AS up", "4 AS n", "5 AS place")
    assert [r.n_turns for r in chat.format_trees(df).collect()] == [1]
