"""CountFrame: a sparse entity x feature count matrix held as DataFrames.

``x``      (cell_id BIGINT, gene_id STRING, n BIGINT | value DOUBLE)  non-zeros only
``obs``    (cell_id BIGINT, ...)  one row per entity, also entities without counts
``var``    (gene_id STRING, ...)  one row per feature
``latent`` (cell_id BIGINT, vec ARRAY<DOUBLE>)  optional embedding

Rows are always matched by key, never by position.  "cell" and "gene" are
the generic names for entity and feature throughout the library.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"  # in-band "unlabelled" value at the API border


@dataclass(frozen=True)
class CountFrame:
    x: DataFrame
    obs: DataFrame
    var: DataFrame | None = None
    latent: DataFrame | None = None

    @property
    def value_col(self) -> str:
        return "value" if "value" in self.x.columns else "n"

    def with_x(self, x: DataFrame) -> "CountFrame":
        return replace(self, x=x)

    def with_obs(self, obs: DataFrame) -> "CountFrame":
        return replace(self, obs=obs)

    def with_var(self, var: DataFrame) -> "CountFrame":
        return replace(self, var=var)

    def with_latent(self, latent: DataFrame) -> "CountFrame":
        return replace(self, latent=latent)

    def genes(self) -> DataFrame:
        """The feature axis: ``var`` when given, else the distinct genes of x."""
        if self.var is not None:
            return self.var.select("gene_id")
        return self.x.select("gene_id").distinct()

    def values(self) -> DataFrame:
        """x with a DOUBLE ``value`` column (raw counts cast when needed)."""
        if "value" in self.x.columns:
            return self.x.select("cell_id", "gene_id", "value")
        return self.x.select("cell_id", "gene_id", F.col("n").cast("double").alias("value"))
