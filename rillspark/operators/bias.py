"""Bias correction of (series_id, ts, value): delta change, quantile mapping, distribution mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_delta(raw: DataFrame, hist: DataFrame, future: DataFrame, precipitation: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """raw, changed by the calendar months' difference (or, for precipitation, ratio of totals) of future to hist and
    shifted by whole years. (*by, ts, value), each series of by for itself; months that one side lacks are left out."""
    fold = F.sum if precipitation else F.avg

    def climate(df: DataFrame, name: str) -> DataFrame:
        months = df.groupBy(*by, F.year("ts").alias("y"), F.month("ts").alias("m")).agg(fold("value").alias("v"))
        return months.groupBy(*by, "m").agg(F.avg("v").alias(name))

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, list(by)) if by else a.join(F.broadcast(b))  # one row

    change = climate(hist, "h").join(climate(future, "f"), [*by, "m"])  # twelve rows a series
    factor = F.try_divide("f", "h") if precipitation else F.col("f") - F.col("h")
    years = beside(future.groupBy(*by).agg(F.min(F.year("ts")).alias("fy")), raw.groupBy(*by).agg(F.min(F.year("ts")).alias("ry")))
    out = beside(raw.withColumn("m", F.month("ts")).join(change.select(*by, "m", factor.alias("factor")), [*by, "m"]), years)
    value = F.col("value") * F.col("factor") if precipitation else F.col("value") + F.col("factor")
    moved = F.expr("ts + make_ym_interval(CAST(fy - ry AS INT), 0)")
    return out.select(*by, moved.alias("ts"), value.alias("value"))


def quantile_mapping(obs: DataFrame, mod: DataFrame, sce: DataFrame, multiplicative: bool = False) -> DataFrame:
    """sce with the quantile difference (or ratio) of obs to mod at the probability that mod gives each value; below
    zero becomes zero. Probabilities count mod values up to x; quantiles interpolate linearly.
    (series_id, ts, value, p, corrected), for each series_id by itself.

    The empirical distribution is a merge of both tables by value, and quantiles are joins on rank: no table is
    gathered into an array."""
    both = mod.select("series_id", F.lit(None).cast("timestamp_ntz").alias("ts"), "value", F.lit(1).alias("w")).union(sce.select("series_id", "ts", "value", F.lit(0)))
    upto = Window.partitionBy("series_id").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("series_id")
    p = both.withColumn("p", F.sum("w").over(upto) / F.sum("w").over(whole)).where("w = 0").select("series_id", "ts", "value", "p")

    def at(df: DataFrame, name: str, q: DataFrame) -> DataFrame:
        ranked = df.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("value")) - 1).alias("_i"), F.lead("value").over(Window.partitionBy("series_id").orderBy("value")).alias("_b"), F.col("value").alias("_a"))
        size = df.groupBy("series_id").agg(F.count("*").alias("_n"))
        q = q.join(F.broadcast(size), "series_id").withColumn("_h", (F.col("_n") - 1) * F.col("p")).withColumn("_i", F.floor("_h").cast("int"))  # size: a row for each series
        q = q.join(ranked, ["series_id", "_i"])
        return q.withColumn(name, F.col("_a") + (F.col("_h") - F.col("_i")) * (F.coalesce("_b", "_a") - F.col("_a"))).drop("_h", "_i", "_n", "_a", "_b")

    q = at(mod, "q_mod", at(obs, "q_obs", p))
    value = F.col("value") * F.try_divide("q_obs", "q_mod") if multiplicative else F.col("value") + F.col("q_obs") - F.col("q_mod")
    return q.select("series_id", "ts", "value", "p", F.greatest(value, F.lit(0.0)).alias("corrected"))


def _sdm_gamma(obs, mod, sce, lower_limit: float = 0.1):
    """Scaled distribution mapping of precipitation: gamma fits of wet values, ratios of quantiles, and as many wet days
    as the change in wet frequency asks for; values keep their ranks."""
    import numpy as np

    from ..functions import special

    wet = [np.sort(x[x >= lower_limit]) for x in (obs, mod, sce)]
    if min(map(len, wet)) < 5:
        return sce.copy()
    (ka, sa), (kb, sb), (kc, sc) = (special.gamma_mle(w) for w in wet)
    share = [len(w) / max(len(x), 1) for w, x in zip(wet, (obs, mod, sce))]
    n = min(len(sce), int(round(len(sce) * share[0] * share[2] / share[1])))
    p = np.clip(special.gamma_cdf(wet[2] / sc, kc), 1e-6, 1 - 1e-6)
    scaled = np.sort(wet[2] * (special.gamma_ppf(p, ka) * sa) / (special.gamma_ppf(p, kb) * sb))
    if n != len(scaled) and n > 0:
        scaled = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(scaled)), scaled)
    out = np.zeros(len(sce))
    if n > 0:
        out[np.argsort(sce, kind="stable")[len(sce) - n :]] = scaled
    return out


def _sdm_normal(obs, mod, sce):
    """Scaled distribution mapping of temperature: linear trends out, normal fits, scaled quantile differences, the
    scenario's trend back in."""
    import numpy as np

    from ..functions import special

    def detrend(x):
        t = np.arange(len(x))
        b = np.polyfit(t, x, 1)
        line = np.polyval(b, t)
        return x - line + x.mean(), line - x.mean()

    (o, _), (m, _), (s, trend) = (detrend(x) for x in (obs, mod, sce))
    mu, sd = [x.mean() for x in (o, m, s)], [max(x.std(), 1e-12) for x in (o, m, s)]
    order = np.argsort(s, kind="stable")
    p = np.clip(special.normal_cdf((s[order] - mu[2]) / sd[2]), 1e-6, 1 - 1e-6)
    change = (s[order] - (mu[1] + sd[1] * special.normal_ppf(p))) * sd[0] / sd[1]
    base = mu[0] + sd[0] * special.normal_ppf(p)
    out = np.empty(len(s))
    out[order] = np.sort(base + change)
    return out + trend


def scaled_distribution_mapping(obs: DataFrame, mod: DataFrame, sce: DataFrame, variable: str) -> DataFrame:
    """(series_id, ts, corrected) of sce, for each series by itself; a series' three samples meet in one task.

    variable: ``precipitation`` or ``temperature``. Series without obs or mod give no rows."""
    if variable not in ("precipitation", "temperature"):
        raise NotImplementedError(variable)
    import numpy as np
    import pandas as pd

    both = None
    for k, df in enumerate((obs, mod, sce)):
        part = df.where("value IS NOT NULL").select("series_id", "ts", "value", F.lit(k).alias("role"))
        both = part if both is None else both.union(part)

    def correct(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["role", "ts"], kind="stable")
        parts = [x.loc[x["role"] == k, "value"].to_numpy(float) for k in range(3)]
        own = x[x["role"] == 2]
        if min(map(len, parts)) < 2:
            return pd.DataFrame({"series_id": [], "ts": own["ts"][:0], "corrected": []})
        got = _sdm_gamma(*parts) if variable == "precipitation" else _sdm_normal(*parts)
        return pd.DataFrame({"series_id": own["series_id"], "ts": own["ts"], "corrected": np.asarray(got, float)})

    return both.groupBy("series_id").applyInPandas(correct, "series_id string, ts timestamp_ntz, corrected double")


def correct(obs: DataFrame, hist: DataFrame, future: DataFrame, method: str, variable: str = "temperature") -> DataFrame:
    """One door to all methods: delta, eqm, qdm, sdm."""
    if method == "delta":
        return monthly_delta(obs, hist, future, variable == "precipitation")
    if method in ("eqm", "qdm"):
        return quantile_mapping(obs, hist, future, method == "qdm")
    if method == "sdm":
        return scaled_distribution_mapping(obs, hist, future, variable)
    raise ValueError(f"unknown method {method!r}")
