from collections import Counter

import __spark_entry__ as E
import corpus_pipeline as cp
from countframe.llm import decontaminate, language, mixing
from tests.llm.helpers import DOC_SCHEMA, components, hostile_rows, shingle_set
from tests.llm.test_linededup import exact as deduped

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = docs.columns, dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "mix"]
    one = cp.cut_lineage(stages["language_id"](spark, docs, SF))
    assert one.columns == names
    kept = {r.doc_id for r in one.collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept == lettered                              # every text with letters is clearly of one language here

    two = cp.cut_lineage(stages["line_dedup"](spark, one, SF))
    want = {i: t for i, t in deduped([(r.doc_id, r.text) for r in one.collect()]).items() if t.strip(" \t\n\r")}
    rows = two.collect()
    assert two.columns == names and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    three = cp.cut_lineage(stages["jaccard_join"](spark, two, SF))
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) and sets[a]]
    low = components(sets, links)
    assert three.columns == names and {r.doc_id for r in three.collect()} == set(low.values())

    four = cp.cut_lineage(stages["decontaminate"](spark, three, SF))
    dirty = decontaminate.scan(three, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
    assert four.columns == names
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - {r.doc_id for r in dirty.collect()}

    five = stages["mix"](spark, four, SF)
    copies = Counter(r.doc_id for r in five.collect())
    assert five.columns == names + ["copy"]
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(four).collect() if r.copies})
    assert E.queries()["pipeline"](spark, SF).count() == sum(copies.values())


def test_stages_take_hostile_rows(spark):
    full = [(r[0], r[1], r[2], r[3], None, "x", 1) for r in hostile_rows()]
    docs = spark.createDataFrame(full, DOC_SCHEMA + ", lang_pred string, node int")
    bench = f"{SF}"
    for frame in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            out = cp.cut_lineage(stage(spark, frame, bench))
            assert out.columns[:7] == docs.columns, name
            if name == "line_dedup":
                assert out.count() == frame.count()
            if name == "jaccard_join" and frame is docs:
                assert Counter(r.doc_id for r in out.collect()) == Counter([1, 2, 3, 4, None, None, 5, 6, 7])
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert dict(cp.STAGES)["language_id"](spark, unlabelled, bench).count() == 0
    assert language.UNKNOWN == "und"
