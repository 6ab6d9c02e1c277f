"""DuckDB text of the fixtures and helper expressions for the SQL oracle.

These strings are the *checks*: they restate each fixture of
``countframe.sources.fixtures`` in plain SQL over the same parquet tables.
"""

from __future__ import annotations


def h(expr: str, salt) -> str:
    """First 4 hex digits of md5('<salt>:<expr>') as an integer."""
    return f"CAST('0x' || substr(md5('{salt}:' || CAST({expr} AS VARCHAR)), 1, 4) AS BIGINT)"


def md5k(expr: str, seed) -> str:
    return f"md5('{seed}:' || CAST({expr} AS VARCHAR))"


def rnd(expr: str, digits: int = 6) -> str:
    scale = f"{float(10 ** digits)!r}"
    return f"CAST(floor(({expr}) * {scale} + 0.5) / {scale} AS DOUBLE)"


F1 = """
f1_x AS (
  SELECT o.o_custkey AS cell_id, p.p_brand || '|' || p.p_type AS gene_id,
         CAST(sum(l.l_quantity) AS BIGINT) AS n
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2),
f1_obs AS (
  SELECT c.c_custkey AS cell_id, r.r_name AS batch, c.c_mktsegment AS label
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

F1_QC = F1 + """,
f1_qc AS (
  SELECT o.cell_id, o.batch, o.label,
         CAST(coalesce(q.n_genes_by_counts, 0) AS BIGINT) AS n_genes_by_counts,
         CAST(coalesce(q.total_counts, 0) AS BIGINT) AS total_counts
  FROM f1_obs o LEFT JOIN (
    SELECT cell_id, count_if(n > 0) AS n_genes_by_counts, sum(n) AS total_counts
    FROM f1_x GROUP BY cell_id) q ON o.cell_id = q.cell_id)"""

F2 = F1 + f""",
f2_ref_x AS (SELECT * FROM f1_x WHERE {h('cell_id', 3)} >= 13107 AND split_part(gene_id, '|', 1) <> 'Brand#3'),
f2_qry_x AS (SELECT * FROM f1_x WHERE {h('cell_id', 3)} < 13107 AND split_part(gene_id, '|', 1) <> 'Brand#5'),
f2_ref_obs AS (SELECT * FROM f1_obs WHERE {h('cell_id', 3)} >= 13107),
f2_qry_obs AS (SELECT * FROM f1_obs WHERE {h('cell_id', 3)} < 13107)"""

F3 = """
f3 AS (
  SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS VARCHAR) AS label
  FROM embeddings)"""

F4 = """
f4_tok AS (
  SELECT doc_id AS cell_id,
         unnest(string_split(translate(lower(text), chr(10) || '.,', '   '), ' ')) AS gene_id
  FROM documents),
f4_x AS (
  SELECT cell_id, gene_id, count(*) AS n FROM f4_tok WHERE gene_id <> '' GROUP BY 1, 2),
f4_obs AS (SELECT doc_id AS cell_id, source AS batch, lang AS label FROM documents)"""


def exact_k(src: str, k_expr: str, seed=42, key: str = "cell_id", partition: str | None = None,
            flag: str = "selected") -> str:
    """SELECT *, <flag>: first k rows per partition in md5 order, ties by key."""
    part = f"PARTITION BY {partition} " if partition else ""
    return f"""SELECT * EXCLUDE (_r, _n), _r <= ({k_expr.replace('N', '_n')}) AS {flag} FROM (
      SELECT *, row_number() OVER ({part}ORDER BY {md5k(key, seed)}, {key}) AS _r,
             count(*) OVER ({part.strip()}) AS _n
      FROM {src})"""


F4_MASKED = F4 + """,
f4_masked AS (""" + exact_k("f4_obs", "floor(0.3 * N)", flag="masked") + """),
f4_mobs AS (
  SELECT cell_id, batch, label, masked, label AS label_truth,
         CASE WHEN masked THEN 'Unknown' ELSE label END AS label_masked
  FROM f4_masked)"""

# F5 over F4's rows: alphabetical label numbers, rule-made predictions
F5 = F4_MASKED + f""",
f5_labels AS (
  SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
  FROM (SELECT DISTINCT label FROM f4_obs WHERE label IS NOT NULL)),
f5_preds AS (
  SELECT o.cell_id, o.label AS truth,
         CASE WHEN {h('o.cell_id', 7)} < 45000 THEN o.label ELSE l.label END AS pred
  FROM f4_obs o
  LEFT JOIN f5_labels l
    ON l.label_idx = {h('o.cell_id', 8)} % (SELECT count(*) FROM f5_labels)),
f5_scores AS (
  SELECT p.cell_id, p.truth, l.label AS class,
         CAST({h("CAST(p.cell_id AS VARCHAR) || ':' || l.label", 9)} % 100 AS DOUBLE) / 100.0
           + CASE WHEN l.label = p.truth THEN 0.3 ELSE 0.0 END AS score
  FROM f5_preds p, f5_labels l)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# --- preprocessing steps in SQL ---------------------------------------------
def norm_cte(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT cell_id, gene_id,
         CAST(n AS DOUBLE) * 1e4 / CAST(sum(n) OVER (PARTITION BY cell_id) AS DOUBLE) AS value
  FROM {src})"""


def log_cte(src: str, name: str) -> str:
    return f"\n{name} AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM {src})"


def hvg_ctes(src_norm: str, src_obs: str, n_top: int, batch: bool, p: str) -> str:
    """CTEs ending in ``{p}`` (gene_id, n_batches, dispersion_norm, highly_variable, rank)."""
    if batch:
        xb = f"SELECT o.batch, x.gene_id, x.value FROM {src_norm} x JOIN {src_obs} o ON x.cell_id = o.cell_id"
        cells = f"SELECT batch, CAST(count(*) AS DOUBLE) AS nb FROM {src_obs} GROUP BY batch"
        nbat = f"(SELECT count(DISTINCT batch) FROM {src_obs})"
    else:
        xb = f"SELECT 'all' AS batch, gene_id, value FROM {src_norm}"
        cells = f"SELECT 'all' AS batch, CAST(count(*) AS DOUBLE) AS nb FROM {src_obs}"
        nbat = "1"
    return f"""
{p}_xb AS ({xb}),
{p}_cells AS ({cells}),
{p}_per AS (SELECT batch, gene_id, sum(value) AS s1, sum(value * value) AS s2 FROM {p}_xb GROUP BY 1, 2),
{p}_st AS (
  SELECT q.batch, q.gene_id, q.s1 / c.nb AS mean,
         (q.s2 - c.nb * (q.s1 / c.nb) * (q.s1 / c.nb)) / nullif(c.nb - 1, 0) AS var
  FROM {p}_per q JOIN {p}_cells c ON q.batch = c.batch),
{p}_d AS (
  SELECT batch, gene_id, mean,
         CASE WHEN var / nullif(mean, 0) > 0 THEN ln(var / nullif(mean, 0)) END AS log_disp,
         ln(1 + mean) AS log_mean
  FROM {p}_st),
{p}_b AS (
  SELECT *, CAST(least(19, coalesce(floor((log_mean - min(log_mean) OVER w)
             / nullif(max(log_mean) OVER w - min(log_mean) OVER w, 0) * 20), 0)) AS INTEGER) AS bin
  FROM {p}_d WINDOW w AS (PARTITION BY batch)),
{p}_n AS (
  SELECT *, CASE WHEN log_disp IS NULL THEN NULL
                 WHEN stddev_samp(log_disp) OVER wb IS NULL THEN 1.0
                 ELSE (log_disp - avg(log_disp) OVER wb) / nullif(stddev_samp(log_disp) OVER wb, 0) END AS norm
  FROM {p}_b WINDOW wb AS (PARTITION BY batch, bin)),
{p}_f AS (
  SELECT *, norm IS NOT NULL AND rank() OVER (PARTITION BY batch ORDER BY {rnd('norm', 9)} DESC NULLS LAST) <= {n_top}
         AS flag
  FROM {p}_n),
{p}_g AS (
  SELECT gene_id, CAST(count_if(flag) AS BIGINT) AS n_batches, sum(coalesce(norm, 0.0)) / {nbat} AS dispersion_norm
  FROM {p}_f GROUP BY gene_id),
{p} AS (
  SELECT gene_id, n_batches, dispersion_norm, r <= {n_top} AS highly_variable,
         CAST(CASE WHEN r <= {n_top} THEN r END AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (ORDER BY n_batches DESC, {rnd('dispersion_norm', 9)} DESC, gene_id) AS r
    FROM {p}_g))"""


def stats_cte(src: str, n_cells: str, name: str) -> str:
    n = f"CAST({n_cells} AS DOUBLE)"
    return f"""
{name} AS (
  SELECT gene_id, mean, sqrt(greatest(var, 0.0)) AS std FROM (
    SELECT gene_id, sum(value) / {n} AS mean,
           (sum(value * value) - {n} * (sum(value) / {n}) * (sum(value) / {n})) / ({n} - 1) AS var
    FROM {src} GROUP BY gene_id))"""


def scale_cte(src: str, genes: str, cells: str, stats: str, name: str, max_value: float = 10.0) -> str:
    """Dense z for every (cell of ``cells``) x (gene of ``genes``)."""
    return f"""
{name} AS (
  SELECT c.cell_id, g.gene_id,
         greatest(least((coalesce(v.value, 0.0) - coalesce(s.mean, 0.0))
                        / CASE WHEN s.std IS NULL OR s.std = 0 THEN 1.0 ELSE s.std END, {max_value}), -{max_value})
           AS value
  FROM {cells} c CROSS JOIN {genes} g
  LEFT JOIN {src} v ON v.cell_id = c.cell_id AND v.gene_id = g.gene_id
  LEFT JOIN {stats} s ON s.gene_id = g.gene_id)"""
