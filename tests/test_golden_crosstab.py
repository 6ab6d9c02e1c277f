"""Golden pair from the published run: label x batch counts of the labelled
rows -> per-batch proportions (3 decimals) and labels absent from a batch.
Rows are rebuilt from the counts, then A3-A6 run on them."""

from pyspark.sql import functions as F

from countframe.operators import summary

# The published counts (label | batch 1 | 2 | 3 | 4).
COUNTS = """
B cell | 23 | 110 | 33 | 115
CD4+ T cell.1 | 16 | 427 | 175 | 307
CD4+ T cell.2 | 143 | 232 | 109 | 223
CD8+ T cell.1 | 124 | 216 | 168 | 399
CD8+ T cell.2 | 0 | 4 | 0 | 0
CD8+ T cell.4 | 6 | 788 | 206 | 479
CD8+ T cell.5 | 52 | 115 | 192 | 356
CD8+ T cell.6 | 4 | 124 | 184 | 525
CD8+ T cell.7 | 1 | 47 | 0 | 2
CD8+ T cell.8 | 2 | 452 | 26 | 55
CD8+ T cell.9 | 187 | 81 | 302 | 261
CD8+ T cell.10 | 24 | 48 | 78 | 102
CD8+ T cell.11 | 4 | 5 | 7 | 210
CD8+ Tcell.3 | 0 | 128 | 21 | 17
CD141+ DC | 25 | 22 | 16 | 43
Distal convoluted tubule | 23 | 24 | 1 | 37
Immune doublet.1 | 13 | 25 | 74 | 122
Immune doublet.2 | 15 | 31 | 43 | 70
Immune doublet.3 | 4 | 23 | 4 | 21
Mast cell | 16 | 1 | 19 | 8
Myeloid cell.1 | 56 | 112 | 278 | 643
Myeloid cell.2 | 33 | 87 | 127 | 317
Myeloid cell.3 | 49 | 87 | 100 | 191
Myeloid cell.4 | 8 | 5 | 11 | 26
NK cell.1 | 20 | 40 | 260 | 60
NK cell.2 | 98 | 206 | 374 | 189
NK cell.3 | 155 | 150 | 97 | 181
NKT cell | 29 | 48 | 37 | 40
PTPRC- population | 15 | 44 | 14 | 25
Plasma cell | 2 | 3 | 7 | 7
Proximal convoluted tubule | 21 | 42 | 5 | 26
T cell mixed | 2 | 44 | 61 | 28
Treg | 43 | 62 | 63 | 280
Tumor cell.1 | 3 | 7 | 4 | 172
Tumor cell.2 | 0 | 0 | 9 | 2
Tumor cell.3 | 6 | 8 | 36 | 106
Tumor cell.4 | 29 | 10 | 19 | 6
Tumor-immune doublet | 2 | 4 | 1 | 10
pDC | 2 | 24 | 10 | 27
"""

# The published proportions (label | batch 1 | 2 | 3 | 4).
PROPORTIONS = """
B cell | 0.018 | 0.028 | 0.010 | 0.020
CD4+ T cell.1 | 0.013 | 0.110 | 0.055 | 0.054
CD4+ T cell.2 | 0.114 | 0.060 | 0.034 | 0.039
CD8+ T cell.1 | 0.099 | 0.056 | 0.053 | 0.070
CD8+ T cell.2 | 0.000 | 0.001 | 0.000 | 0.000
CD8+ T cell.4 | 0.005 | 0.203 | 0.065 | 0.084
CD8+ T cell.5 | 0.041 | 0.030 | 0.061 | 0.063
CD8+ T cell.6 | 0.003 | 0.032 | 0.058 | 0.092
CD8+ T cell.7 | 0.001 | 0.012 | 0.000 | 0.000
CD8+ T cell.8 | 0.002 | 0.116 | 0.008 | 0.010
CD8+ T cell.9 | 0.149 | 0.021 | 0.095 | 0.046
CD8+ T cell.10 | 0.019 | 0.012 | 0.025 | 0.018
CD8+ T cell.11 | 0.003 | 0.001 | 0.002 | 0.037
CD8+ Tcell.3 | 0.000 | 0.033 | 0.007 | 0.003
CD141+ DC | 0.020 | 0.006 | 0.005 | 0.008
Distal convoluted tubule | 0.018 | 0.006 | 0.000 | 0.007
Immune doublet.1 | 0.010 | 0.006 | 0.023 | 0.021
Immune doublet.2 | 0.012 | 0.008 | 0.014 | 0.012
Immune doublet.3 | 0.003 | 0.006 | 0.001 | 0.004
Mast cell | 0.013 | 0.000 | 0.006 | 0.001
Myeloid cell.1 | 0.045 | 0.029 | 0.088 | 0.113
Myeloid cell.2 | 0.026 | 0.022 | 0.040 | 0.056
Myeloid cell.3 | 0.039 | 0.022 | 0.032 | 0.034
Myeloid cell.4 | 0.006 | 0.001 | 0.003 | 0.005
NK cell.1 | 0.016 | 0.010 | 0.082 | 0.011
NK cell.2 | 0.078 | 0.053 | 0.118 | 0.033
NK cell.3 | 0.124 | 0.039 | 0.031 | 0.032
NKT cell | 0.023 | 0.012 | 0.012 | 0.007
PTPRC- population | 0.012 | 0.011 | 0.004 | 0.004
Plasma cell | 0.002 | 0.001 | 0.002 | 0.001
Proximal convoluted tubule | 0.017 | 0.011 | 0.002 | 0.005
T cell mixed | 0.002 | 0.011 | 0.019 | 0.005
Treg | 0.034 | 0.016 | 0.020 | 0.049
Tumor cell.1 | 0.002 | 0.002 | 0.001 | 0.030
Tumor cell.2 | 0.000 | 0.000 | 0.003 | 0.000
Tumor cell.3 | 0.005 | 0.002 | 0.011 | 0.019
Tumor cell.4 | 0.023 | 0.003 | 0.006 | 0.001
Tumor-immune doublet | 0.002 | 0.001 | 0.000 | 0.002
pDC | 0.002 | 0.006 | 0.003 | 0.005
"""

# The published list of labels absent from at least one batch.
ABSENT = ["CD8+ T cell.2", "CD8+ T cell.7", "CD8+ Tcell.3", "Tumor cell.2"]
BATCHES = ["1", "2", "3", "4"]


def _parse(text, cast):
    out = {}
    for line in text.strip().splitlines():
        parts = [p.strip() for p in line.split("|")]
        out[parts[0]] = [cast(v) for v in parts[1:]]
    return out


def _labelled_rows(spark):
    counts = _parse(COUNTS, int)
    rows = [(lab, b) for lab, ns in counts.items() for b, n in zip(BATCHES, ns) for _ in range(n)]
    return spark.createDataFrame(rows, "label string, batch string")


def test_split_size(spark):
    df = _labelled_rows(spark)
    assert df.count() == 14000
    per_batch = {r["batch"]: r["n"] for r in summary.value_counts(df, "batch").collect()}
    assert per_batch == {"1": 1255, "2": 3886, "3": 3171, "4": 5688}


def test_crosstab_zero_fill(spark):
    ct = summary.crosstab(_labelled_rows(spark), "label", "batch")
    got = {(r["label"], r["batch"]): r["n"] for r in ct.collect()}
    counts = _parse(COUNTS, int)
    assert len(got) == 39 * 4
    for lab, ns in counts.items():
        for b, n in zip(BATCHES, ns):
            assert got[(lab, b)] == n


def test_proportions_match_published(spark):
    ct = summary.crosstab(_labelled_rows(spark), "label", "batch")
    prop = summary.crosstab_prop(ct, "label", "batch")
    got = {(r["label"], r["batch"]): r["prop"] for r in prop.collect()}
    want = _parse(PROPORTIONS, float)
    for lab, ps in want.items():
        for b, p in zip(BATCHES, ps):
            assert abs(got[(lab, b)] - p) < 1e-9, (lab, b, got[(lab, b)], p)
    sums = prop.groupBy("batch").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in sums) == 14000


def test_absent_labels_match_published(spark):
    ct = summary.crosstab(_labelled_rows(spark), "label", "batch")
    got = sorted(r["label"] for r in summary.absent_labels(ct, "label").collect())
    assert got == sorted(ABSENT)
