import duckdb
import pytest

from ashlar.plans import registry

SF = "/root/testdata/sf0.001"
# one of each family; the driver compares them all
NAMES = ["bin_numeric", "grid_quantile_weighted", "target_stat_kfold", "target_stat_auto_smooth", "fisher_bins", "grad_hess_tweedie", "deviance_logistic", "init_poisson", "histogram_subtract", "best_split_missing_dir", "split_l1_clamp", "mvs_sample_topk", "tree_score", "purify_2d", "shap", "rating_score_join", "metric_auc", "metric_gini", "metric_lift", "grid_refill_tied", "grid_rare_collapse", "target_stat_ordered", "split_monotone", "split_budget_prior", "split_noise", "leaf_values", "reanchor_log", "dart_rescore", "bootstrap_weights", "hash_split", "claims_join", "factored_box_score", "sparse_tables", "fit_exact_out_of_bag", "fit_exact_selected", "fit_exact_refined", "fit_exact_ridge", "fit_exact_bootstrap"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna()) if a[c].dtype == object or a[c].dtype.kind not in "f" else (a[c] - b[c]).abs() < 1e-5
        assert same.all(), c
