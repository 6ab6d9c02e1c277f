"""Scoring new rows as they arrive (Structured Streaming).

The reference has no stream; its projection (D2) and batch scoring (M5,
T2) are per-row once the model is frozen, so they run unchanged on a
streaming DataFrame:

* ``project_stream``: vectors in, latent vectors out (row-local Arrow map).
* ``score_counts_stream``: long count rows in; every micro-batch is
  normalised, log-transformed, scaled with the *frozen training*
  statistics, projected with the training PCA and written out.  A cell's
  entries must arrive in one micro-batch (one file per batch of cells), as
  the library-size normalisation needs the whole cell.
* ``complete_cells`` and ``score_pieces_stream``: for cells whose entries
  arrive in pieces.  Rows carry an event time; a cell's pieces form a session
  that stays in Spark's keyed state until the watermark says that nothing of
  it can come any more, and is scored then, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from countframe.frame import CountFrame
from countframe.operators import embed, features, normalize

COUNTS_SCHEMA = "cell_id long, gene_id string, n long"


def project_stream(stream: DataFrame, pca: embed.PcaResult, vec: str = "vec", key: str = "cell_id") -> DataFrame:
    """D2 on a stream of dense vectors."""
    return embed.project_vectors(stream, pca.components, pca.mean, vec, key)


def score_counts_batch(batch: DataFrame, axis: DataFrame, stats: DataFrame, pca: embed.PcaResult) -> DataFrame:
    """The per-micro-batch plan: (cell_id, gene_id, n) -> (cell_id, vec)."""
    cells = batch.select("cell_id").distinct()
    cf = normalize.log1p(normalize.normalize_total(CountFrame(batch, cells)))
    sel = features.select_genes(cf.x, axis)
    vecs = normalize.scale_vectors(sel, axis, cells, stats)
    return embed.project_vectors(vecs, pca.components, pca.mean)


def score_counts_stream(stream: DataFrame, axis: DataFrame, stats: DataFrame, pca: embed.PcaResult,
                        out_path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Run ``score_counts_batch`` on every micro-batch and append the latent
    rows as parquet.  ``checkpoint`` must be a shared folder: the query
    restarts from it after a failure (exactly-once per batch id, since the
    write of a batch id is idempotent: overwrite of its own folder)."""
    axis_c = axis.cache()
    stats_c = stats.cache()

    def run(batch: DataFrame, batch_id: int) -> None:
        out = score_counts_batch(batch, axis_c, stats_c, pca)
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


PIECES_SCHEMA = "cell_id long, gene_id string, n long, ts timestamp"


def complete_cells(stream: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """(cell_id, session, entries): cells that are complete.

    Pieces of a cell that lie less than ``gap`` apart belong together; a cell
    is complete when the watermark, ``delay`` behind the latest event time, is
    past its last piece by ``gap``.  Rows that come later than the watermark
    are dropped by Spark; a cell that goes on after a longer pause is another
    session.  State holds the entries of open cells only."""
    return (stream.withWatermark("ts", delay)
            .groupBy("cell_id", F.session_window("ts", gap).alias("session"))
            .agg(F.collect_list(F.struct("gene_id", "n")).alias("entries")))


def score_pieces_stream(stream: DataFrame, axis: DataFrame, stats: DataFrame, pca: embed.PcaResult, out_path: str, checkpoint: str,
                        gap: str = "10 minutes", delay: str = "10 minutes", trigger_once: bool = False) -> StreamingQuery:
    """D2 and the scoring part of T2 on (cell_id, gene_id, n, ts) rows in any
    split: every cell is scored when it is complete, from all its pieces
    (counts of a gene are added), and appended as (cell_id, vec).
    ``checkpoint`` must be a shared folder; a batch id's write is idempotent."""
    axis_c, stats_c = axis.cache(), stats.cache()

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("cell_id", F.explode("entries").alias("e")).groupBy("cell_id", F.col("e.gene_id").alias("gene_id")).agg(F.sum("e.n").alias("n"))
        out = score_counts_batch(rows, axis_c, stats_c, pca)
        out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = complete_cells(stream, gap, delay).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
