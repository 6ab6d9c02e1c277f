"""Sources, sinks and the streaming scorer."""

import os

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from countframe.operators import embed, features, normalize
from countframe.sources import describe, fit_or_load, read_counts, read_latent, write_latent, write_report
from countframe.streaming import scoring


def test_read_counts_renames_batch_column(spark, tmpdir_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(f"{tmpdir_path}/obs")
    pq.write_table(pa.table({"cell_id": [1], "Batch": [7], "batch": ["a"]}), f"{tmpdir_path}/obs/part.parquet")
    x = spark.createDataFrame([(1, "g", 3)], "cell_id long, gene_id string, n long")
    x.write.parquet(f"{tmpdir_path}/x")
    cf = read_counts(spark, f"{tmpdir_path}/x", f"{tmpdir_path}/obs")
    assert "batch_src" in cf.obs.columns and cf.obs.select("batch").first()[0] == "a"
    d = describe(cf).first()
    assert (d["n_cells"], d["n_genes"], d["n_entries"], d["total_count"]) == (1, 1, 1, 3)


def test_latent_roundtrip_and_report(spark, tmpdir_path):
    lat = spark.createDataFrame([(1, [0.5, 1.5])], "cell_id long, vec array<double>")
    write_latent(lat, f"{tmpdir_path}/lat", "pca")
    back = read_latent(spark, f"{tmpdir_path}/lat", "pca").first()
    assert back["vec"] == [0.5, 1.5]
    paths = write_report({"t": lat.select("cell_id")}, f"{tmpdir_path}/rep", fmt="csv")
    assert os.path.isdir(paths[0])


def test_fit_or_load(spark, tmpdir_path):
    df = spark.createDataFrame([(0.0, [0.0, 1.0]), (1.0, [1.0, 0.0])] * 5, "label double, v array<double>") \
        .withColumn("features", array_to_vector("v"))
    calls = []

    def fit():
        calls.append(1)
        return LogisticRegression(maxIter=5).fit(df)

    p = f"{tmpdir_path}/m"
    fit_or_load(p, fit, LogisticRegressionModel.load)
    m = fit_or_load(p, fit, LogisticRegressionModel.load)
    assert len(calls) == 1 and isinstance(m, LogisticRegressionModel)


def test_counts_stream_scores_with_frozen_model(spark, tmpdir_path):
    rng = np.random.default_rng(3)
    rows = [(c, f"g{g}", int(rng.integers(1, 9))) for c in range(40) for g in range(6) if rng.random() < 0.7]
    x = spark.createDataFrame(rows, scoring.COUNTS_SCHEMA)
    cells = x.select("cell_id").distinct()
    from countframe.frame import CountFrame

    cf = normalize.log1p(normalize.normalize_total(CountFrame(x, cells)))
    axis = features.index_genes(x.select("gene_id").distinct())
    stats = normalize.gene_stats(cf.x, cells.count())
    vecs = normalize.scale_vectors(cf.x, axis, cells, stats)
    pca = embed.pca(vecs, 2)
    src = f"{tmpdir_path}/in"
    # one cell never spans two files (library-size normalisation needs the whole cell)
    x.where("cell_id < 20").repartition(2, "cell_id").write.parquet(src)
    x.where("cell_id >= 20").repartition(2, "cell_id").write.mode("append").parquet(src)
    stream = spark.readStream.schema(scoring.COUNTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = scoring.score_counts_stream(stream, axis, stats, pca, f"{tmpdir_path}/out", f"{tmpdir_path}/ck",
                                    trigger_once=True)
    q.awaitTermination(120)
    out = {r["cell_id"]: r["vec"] for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    batch = {r["cell_id"]: r["vec"] for r in pca.latent.collect()}
    assert set(out) == set(batch)
    for c in out:
        assert np.allclose(out[c], batch[c], atol=1e-8)


def test_cells_in_pieces_equal_the_batch(spark, tmpdir_path):
    """Every cell comes in three batches, one row too late."""
    import time

    rng = np.random.default_rng(4)
    rows = [(c, f"g{g}", int(rng.integers(1, 9))) for c in range(25) for g in range(7) if rng.random() < 0.8]
    x = spark.createDataFrame(rows, scoring.COUNTS_SCHEMA)
    from countframe.frame import CountFrame

    cells = x.select("cell_id").distinct()
    cf = normalize.log1p(normalize.normalize_total(CountFrame(x, cells)))
    axis = features.index_genes(x.select("gene_id").distinct())
    stats = normalize.gene_stats(cf.x, cells.count())
    pca = embed.pca(normalize.scale_vectors(cf.x, axis, cells, stats), 2)
    src = f"{tmpdir_path}/pieces"

    def arrive(part, minute):
        at = spark.createDataFrame([(*r, f"2024-01-01 10:{minute:02}:00") for r in part], "cell_id long, gene_id string, n long, at string")
        at.selectExpr("cell_id", "gene_id", "n", "cast(at AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)                              # files are read in the order of their times

    for k in range(3):
        arrive([(c, g, n) for c, g, n in rows if k == int(g[1]) % 3 and n == 1] +
               [(c, g, n - 2 if k == 0 else 1) for c, g, n in rows if n > 2] + [(c, g, 1) for c, g, n in rows if n == 2 and k < 2], k)
    for minute in (50, 51):                          # moves the watermark past all cells; it counts from the next batch on
        arrive([(-1, "g0", 1)], minute)
    arrive([(3, "g1", 1000)], 1)                     # too late
    stream = spark.readStream.schema(scoring.PIECES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    scoring.score_pieces_stream(stream, axis, stats, pca, f"{tmpdir_path}/out", f"{tmpdir_path}/ck", trigger_once=True).awaitTermination(180)
    out = [(r.cell_id, r.vec) for r in spark.read.parquet(f"{tmpdir_path}/out").where("cell_id >= 0").collect()]
    batch = {r.cell_id: r.vec for r in pca.latent.collect()}
    assert sorted(c for c, _ in out) == sorted(batch)            # each once
    assert all(np.allclose(v, batch[c], atol=1e-8) for c, v in out)


def test_project_stream_memory_sink(spark, tmpdir_path):
    vec = spark.createDataFrame([(i, [float(i), 1.0, -float(i)]) for i in range(10)], "cell_id long, vec array<double>")
    pca = embed.pca(vec, 1)
    vec.write.parquet(f"{tmpdir_path}/v")
    stream = spark.readStream.schema("cell_id long, vec array<double>").parquet(f"{tmpdir_path}/v")
    q = (scoring.project_stream(stream, pca).writeStream.format("memory").queryName("proj_out")
         .option("checkpointLocation", f"{tmpdir_path}/ck2").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM proj_out").select("cell_id", F.col("vec")[0].alias("z")).collect()
    assert len(got) == 10


def test_checkpoint_dir_from_session_setting(spark, tmpdir_path):
    from countframe.session import cut_lineage, ensure_checkpoint_dir

    current = ensure_checkpoint_dir(spark)
    assert current  # a local session gets one when unset
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
