"""Plan shape guards: no nested-loop / cartesian joins in the relational
queries, and column pruning reaches the parquet scans."""

import pytest

from countframe.plans.catalog import QUERIES, load_all
from tests.conftest import SF_SMALL

load_all()
MODEL_FITS = {"mlp_predict", "ig_mlp", "training_history", "model_comparison", "softmax_predict", "map_query_classifier",
              "map_query_latent", "map_query_semisup", "explain_labels", "ig_softmax", "pca_scores",
              "reconstruction_error", "nb_latent", "map_query_knn"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_FITS))
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(QUERIES["qc_by_batch"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "l_extendedprice" not in plan and "c_acctbal" not in plan
