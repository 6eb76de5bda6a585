"""A part of the catalogue against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__
from ohmsieve.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ("scan_project", "coerce_numeric", "null_tokens", "family_classify", "raw_mirror", "safe_ratio", "tolerance_flags", "bucketize_even", "model_integrity", "row_min_max_mean", "curve_voltwatt", "control_compliance", "enter_service", "freq_droop", "dc_consistency", "rule_audit", "leave_fold_out", "scenario_oof", "threshold_search", "blend_select", "nonconstant_columns", "csv_roundtrip", "row_digest", "observed_counts", "family_table", "feature_frame", "trip_any", "piecewise_interp", "curve_voltvar", "trip_block_lv", "scenario_output_oof", "scenario_apply", "scenario_output_apply", "scenario_hash_fold", "exact_quantiles", "residual_calibration", "calibration_modes", "calibration_ratios")


def table(df):
    names = sorted(df.columns)
    cell = lambda x: None if x is None else float(x) if isinstance(x, (int, float)) else x
    return names, sorted(([cell(v) for v in r] for r in df[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    clean = lambda d: d.astype(object).where(d.notna(), None)
    assert table(clean(a)) == table(clean(b))


def test_every_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 13
