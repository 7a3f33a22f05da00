"""Every registered query runs on the smallest tables, and its SQL gives the same rows."""

from __future__ import annotations

import glob

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.functions import distributions as dist
from rillspark.plans import registry

SAMPLE = ["block_maxima_year", "rfa_gumbel_lmom", "wet_spells", "discharge_events", "eqm", "idw_grid", "pixel_return_period", "kendall_tau", "soil_mode", "discordancy", "nday_events", "pot_peaks", "common_period", "standardised_mean", "complete_maxima", "last_duplicate_monthly_mean", "carried_forward", "depth_variation", "soil_texture", "contour_or", "contour_and", "trivariate_exceedance", "kendall_level", "design_ensemble", "discrete_marginal", "fitted_marginals", "delta_precip", "delta_temperature", "design_standardized", "well_covered", "standardised_maxima", "values_at_steps", "type_medians", "two_sample_t", "quantile_errors", "idf_change", "linear_reservoir", "rating_curve", "flooded_between", "exclusive_zone", "weighted_roughness", "maxima_wide", "pairs_long", "aligned_pairs", "dry_dates", "rdb_listing", "grdc_listing", "nwis_listing", "channel_table", "synop_days", "file_years", "plain_names", "station_degrees", "fixed_blocks", "normal_depth"]


def _key(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    want = c.sql(registry.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(k) for k in cols]
    assert sorted(tuple(_key(r[k]) for k in cols) for r in got.collect()) == sorted(tuple(_key(r[k]) for k in at) for r in want.fetchall())


def test_return_period_beyond_the_support(spark, sf, tmp_path):
    """A region whose fitted upper bound lies below the value; in double precision no exceedance may be left inside the support."""
    d, c = str(tmp_path), duckdb.connect()
    for f in ("region", "nation"):
        c.sql(f"COPY (SELECT * FROM '{sf}/{f}.parquet') TO '{d}/{f}.parquet'")
    c.sql(f"COPY (SELECT n_nationkey AS c_custkey, n_nationkey AS c_nationkey FROM '{d}/nation.parquet') TO '{d}/customer.parquet'")
    c.sql(f"CREATE TABLE place AS SELECT r_regionkey AS r, min(n_nationkey) AS k FROM '{d}/nation.parquet' JOIN '{d}/region.parquet' ON n_regionkey = r_regionkey GROUP BY ALL")
    # yearly maxima by region: skewed to the left; slightly skewed to the right; wide
    c.sql("CREATE TABLE v AS SELECT r, y, CASE r WHEN 0 THEN 1000.0 - y * y WHEN 1 THEN 1000.0 + 3 * y + [0, 5, 2, 1, 7, 3, 9][y + 1] ELSE 1000.0 + r * 100 * (y * 5 % 7) END AS v FROM (SELECT unnest(range(5)) AS r), (SELECT unnest(range(7)) AS y)")
    c.sql(f"COPY (SELECT k AS o_custkey, make_timestamp(1995 + y, 3, 1, 0, 0, 0) AS o_orderdate, v::DOUBLE AS o_totalprice FROM v JOIN place USING (r)) TO '{d}/orders.parquet'")
    for f in ("region", "nation", "customer", "orders"):
        c.sql(f"CREATE VIEW {f} AS SELECT * FROM '{d}/{f}.parquet'")
    want = dict(c.sql(registry.SQL["return_period_of_value"]).fetchall())
    got = {r.series_id: r.return_period for r in registry.QUERIES["return_period_of_value"](spark, d).collect()}
    assert {k: repr(x) for k, x in got.items()} == {k: repr(x) for k, x in want.items()}
    assert "nan" in {repr(x) for x in got.values()} and sum(np.isfinite(list(got.values()))) >= 2
    period = lambda x: spark.range(1).select(dist.gev_period(F.lit(x), F.lit(0.0), F.lit(1.0), F.lit(-0.05)).alias("t")).first().t
    assert period(19.99) == float("inf") and np.isnan(period(20.01)) and 1 < period(1.0) < 10


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 5


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; import rillspark.plans.registry, rillspark.streaming.spells; assert not any(m.startswith('rillspark.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
