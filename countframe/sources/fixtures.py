"""Count matrices derived from the parquet test tables.

F1  customers x product kinds  (lineitem, orders, part, customer, nation, region)
F2  F1 split into a reference and a query dataset with partly different genes
F3  ready-made vectors          (embeddings)
F4  documents x tokens          (documents): the learnable matrix, label = language
F5  rule-made predictions and class scores over F4's rows
F6  rule-made PCA loadings over F1's genes

Every fixture reads whole tables; the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.functions.hashing import hash16, md5_key
from countframe.sources.tables import spread, table

# Fixed values shared with the SQL oracle ------------------------------------
TOKEN_STRIP = "\n.,"          # characters turned into spaces before splitting
SPLIT_SALT = 3                # F2 split: h(cell, 3) < 13107 (~20 %) is the query
SPLIT_CUT = 13107
PRED_KEEP = 45000             # F5: pred = truth when h(cell, 7) < 45000
QUERY_DROPS_BRAND = "Brand#5"
REFERENCE_DROPS_BRAND = "Brand#3"


# F1 --------------------------------------------------------------------------
def customer_products(spark: SparkSession, sf_dir: str) -> CountFrame:
    # an order has a bounded number of lines: spreading on it cannot skew
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("|"), "p_type").alias("gene_id"))
    # Big-big joins: let the optimizer / AQE choose (sort-merge or broadcast by
    # measured size); no hint on data that grows with the scale factor.
    x = (li.join(orders, li.l_orderkey == orders.o_orderkey)
         .join(part, li.l_partkey == part.p_partkey)
         .groupBy(F.col("o_custkey").alias("cell_id"), "gene_id")
         .agg(F.sum("l_quantity").cast("bigint").alias("n")))
    return CountFrame(x=x.select("cell_id", "gene_id", "n"), obs=customer_obs(spark, sf_dir))


def customer_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation (25 rows) and region (5 rows) have a fixed size by definition
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    region = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.col("c_custkey").alias("cell_id"), F.col("r_name").alias("batch"),
                    F.col("c_mktsegment").alias("label")))


# F2 --------------------------------------------------------------------------
def materialize(cf: CountFrame) -> CountFrame:
    """Write the count matrix once into the shared checkpoint folder, for
    plans that read it several times (statistics, feature axis, vectors)."""
    from countframe.session import cut_lineage

    return CountFrame(cut_lineage(cf.x), cf.obs, cf.var, cf.latent)


def reference_query_pair(spark: SparkSession, sf_dir: str,
                         base: CountFrame | None = None) -> tuple[CountFrame, CountFrame]:
    """F1 split by a seeded hash of the customer: ~20 % query, rest reference.
    The query side lacks one brand, the reference another."""
    f1 = base if base is not None else customer_products(spark, sf_dir)
    is_query = hash16(F.col("cell_id"), SPLIT_SALT) < SPLIT_CUT
    brand = F.split(F.col("gene_id"), r"\|").getItem(0)
    ref_x = f1.x.where(~is_query & (brand != REFERENCE_DROPS_BRAND))
    qry_x = f1.x.where(is_query & (brand != QUERY_DROPS_BRAND))
    ref_obs = f1.obs.where(~is_query)
    qry_obs = f1.obs.where(is_query)
    return CountFrame(ref_x, ref_obs), CountFrame(qry_x, qry_obs)


# F3 --------------------------------------------------------------------------
def embedding_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latent(cell_id, vec ARRAY<DOUBLE>, label STRING) from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("string").alias("label"))


# F4 --------------------------------------------------------------------------
def document_tokens(spark: SparkSession, sf_dir: str) -> CountFrame:
    # doc_id is unique, so spreading on it cannot skew; the per-(doc, token)
    # counts and per-document windows below reuse this partitioning
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    # whole texts: every token of every document is counted
    tok = (docs.select(F.col("doc_id").alias("cell_id"),
                       F.explode(F.split(F.translate(F.lower("text"), TOKEN_STRIP, " " * len(TOKEN_STRIP)),
                                         " ")).alias("gene_id"))
           .where(F.col("gene_id") != ""))
    x = tok.groupBy("cell_id", "gene_id").agg(F.count(F.lit(1)).alias("n"))
    obs = docs.select(F.col("doc_id").alias("cell_id"), F.col("source").alias("batch"),
                      F.col("lang").alias("label"))
    return CountFrame(x=x.select("cell_id", "gene_id", "n"), obs=obs)


# F5 --------------------------------------------------------------------------
def label_index(obs: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_idx) alphabetical from 0.  The label set is small (a
    class list), so the global rank runs over distinct labels only."""
    from pyspark.sql import Window

    return (obs.select(label).where(F.col(label).isNotNull()).distinct()
            .withColumn("label_idx", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int")))


def rule_predictions(obs: DataFrame) -> DataFrame:
    """preds(cell_id, truth, pred): truth kept for ~69 % of rows, else a
    hashed label.  Model-free and identical in DuckDB."""
    labels = label_index(obs)
    n_labels = labels.select(F.count(F.lit(1))).scalar()
    base = obs.select("cell_id", F.col("label").alias("truth")).withColumn(
        "_alt", (hash16(F.col("cell_id"), 8) % n_labels).cast("int"))
    alt = labels.select(F.col("label_idx").alias("_alt"), F.col("label").alias("_alt_label"))
    return (base.join(alt, "_alt", "left")
            .select("cell_id", "truth",
                    F.when(hash16(F.col("cell_id"), 7) < PRED_KEEP, F.col("truth"))
                    .otherwise(F.col("_alt_label")).alias("pred")))


def rule_scores(preds: DataFrame, classes: list[str]) -> DataFrame:
    """scores(cell_id, truth, class, score): one score per (row, class), with
    many ties on purpose.  The class list is a short, driver-side list; each
    row expands it locally (a generator, not a join)."""
    cls = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    rows = preds.select("cell_id", "truth", cls)
    raw = hash16(F.concat(F.col("cell_id").cast("string"), F.lit(":"), F.col("class")), 9) % 100
    score = (raw.cast("double") / 100.0) + F.when(F.col("class") == F.col("truth"), 0.3).otherwise(0.0)
    return rows.withColumn("score", score)


def class_list(obs: DataFrame, label: str = "label", max_classes: int = 100_000) -> list[str]:
    """Distinct labels, sorted, collected with a checked size bound."""
    labels = obs.select(label).where(F.col(label).isNotNull()).distinct()
    got = [r[0] for r in labels.limit(max_classes + 1).collect()]
    if len(got) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    return sorted(got)


# F6 --------------------------------------------------------------------------
def rule_loadings(genes: DataFrame, n_pcs: int = 5) -> DataFrame:
    """loadings(gene_id, pc, w) with w in [-0.5, 0.5) from a seeded hash."""
    g = genes.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(n_pcs - 1))).alias("pc"))
    key = F.concat(F.col("gene_id"), F.lit(":"), F.col("pc").cast("string"))
    return g.withColumn("w", hash16(key, 11).cast("double") / 65536.0 - 0.5)

