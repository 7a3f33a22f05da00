"""Design reduction and emulation for uncertainty propagation, over (row_id, features array)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of a simulator that a strategy may ask for; emulators are fitted on the driver on no more.
MOST_RUNS = 2000


def standardize(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """features as z-scores with the reference's population moments; a constant feature is divided by one."""
    ref = df if reference is None else reference
    d = len(ref.select("features").first()[0])
    m = ref.agg(*(F.avg(F.col("features")[k]).alias(f"m{k}") for k in range(d)), *(F.stddev_pop(F.col("features")[k]).alias(f"s{k}") for k in range(d))).first()
    z = [(F.col("features")[k] - m[f"m{k}"]) / (m[f"s{k}"] or 1.0) for k in range(d)]
    return df.withColumn("features", F.array(*z))


def _d2(point: list[float]) -> Column:
    at = F.expr("array(" + ",".join(f"double('{float(v)!r}')" for v in point) + ")")  # one expression, as points are long
    return F.aggregate(F.zip_with("features", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def _kept(df: DataFrame) -> DataFrame:
    """df in the session's shared checkpoint folder without its lineage; df itself where spark.checkpoint.dir is unset."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder:
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def maxdiss(df: DataFrame, k: int, every: int = 8) -> list:
    """The ids of k rows in greedy order: the largest norm first, then the farthest from all chosen; smaller id on ties.

    Each step is one aggregation that brings one row to the driver. Rows carry their least distance to what is chosen,
    which is written anew every few steps, so a step's expression holds at most that many points."""
    best = lambda d: d.agg(F.expr("min_by(struct(row_id, features), struct(-score, row_id))").alias("b")).first()["b"]
    held = _kept(df.select("row_id", "features"))
    first = best(held.withColumn("score", _d2([0.0] * len(held.select("features").first()[0]))))
    chosen, recent = [first["row_id"]], [first]
    held = held.withColumn("score", F.lit(float("inf")))
    while len(chosen) < k:
        rest = held.where(~F.col("row_id").isin([c["row_id"] for c in recent]))
        rest = rest.select("row_id", "features", F.least("score", *(_d2(list(c["features"])) for c in recent)).alias("score"))
        if len(recent) == every:
            rest = held = _kept(rest)
            recent = []
        nxt = best(rest)
        if nxt is None:
            break
        chosen.append(nxt["row_id"])
        recent.append(nxt)
    return chosen


def design_weights(df: DataFrame, chosen: list) -> DataFrame:
    """(row_id, weight): how many rows lie nearest to each chosen one; the first in order wins ties."""
    points = {r.row_id: list(r.features) for r in df.where(F.col("row_id").isin(chosen)).collect()}  # the chosen rows
    d = F.array(*(F.struct(_d2(points[c]).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(chosen)))
    n = df.select(F.array_min(d)["k"].alias("k")).groupBy("k").agg(F.count("*").alias("weight"))
    names = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(chosen)], "k int, row_id long")
    return names.join(n, "k", "left").select("row_id", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


# Emulators of a few hundred runs, on the driver.


def rbf(kind: str = "linear", smoothing: float = 1.0):
    phi: Callable = {"linear": lambda r: -r, "cubic": lambda r: r**3, "thin_plate_spline": lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0)}[kind]

    def fit(x: np.ndarray, y: np.ndarray):
        n, d = x.shape
        r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        p = np.hstack([np.ones((n, 1)), x]) if kind != "linear" else np.ones((n, 1))
        a = np.block([[phi(r) + smoothing * np.eye(n) * (-1 if kind == "linear" else 1), p], [p.T, np.zeros((p.shape[1],) * 2)]])
        w = np.linalg.lstsq(a, np.concatenate([y, np.zeros(p.shape[1])]), rcond=None)[0]

        def predict(q: np.ndarray) -> np.ndarray:
            s = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
            b = np.hstack([np.ones((len(q), 1)), q]) if kind != "linear" else np.ones((len(q), 1))
            return phi(s) @ w[:n] + b @ w[n:]

        return predict

    return fit


def knn(k: int):
    def fit(x: np.ndarray, y: np.ndarray):
        def predict(q: np.ndarray) -> np.ndarray:
            s = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
            near = np.argsort(s, axis=1, kind="stable")[:, : min(k, len(x))]
            w = 1 / np.maximum(np.take_along_axis(s, near, 1), 1e-12)
            return (w * y[near]).sum(1) / w.sum(1)

        return predict

    return fit


def _mean(x: np.ndarray, y: np.ndarray):
    return lambda q: np.full(len(q), y.mean())


def _first_feature(x: np.ndarray, y: np.ndarray):
    u, at = np.unique(x[:, 0], return_index=True)
    return lambda q: np.interp(q[:, 0], u, y[at])


def families() -> dict:
    return {f"rbf_{k}": rbf(k) for k in ("linear", "cubic", "thin_plate_spline")} | {f"knn_{k}": knn(k) for k in (2, 3, 5, 7, 10)} | {"ensemble_mean": _mean, "peak_only": _first_feature}


@dataclass(frozen=True)
class Emulability:
    family: str
    r2: float
    scores: dict


def emulability(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Emulability:
    """The best cross-validated share of variance over families: leave-one-out below 40 runs, else five shuffled folds;
    at most 400 evenly spaced runs; a family that fails is left out."""
    if len(x) > 400:
        at = np.linspace(0, len(x) - 1, 400).round().astype(int)
        x, y = x[at], y[at]
    n = len(x)
    folds = np.arange(n) if n < 40 else np.random.Generator(np.random.PCG64(seed)).permutation(n) % 5
    scores = {}
    for name, fit in families().items():
        try:
            out = np.empty(n)
            for f in np.unique(folds):
                out[folds == f] = fit(x[folds != f], y[folds != f])(x[folds == f])
            total = ((y - y.mean()) ** 2).sum()
            scores[name] = 1 - ((y - out) ** 2).sum() / total if total > 0 else -np.inf
        except np.linalg.LinAlgError:
            continue
    best = max(scores, key=scores.get)
    return Emulability(best, float(scores[best]), scores)


@dataclass(frozen=True)
class Propagation:
    strategy: str
    r2: float
    runs: int
    quantile: float


def propagate(df: DataFrame, simulate: Callable[[np.ndarray], np.ndarray], n_max: int, q: float = 0.9, threshold: float = 0.5, seed: int = 0) -> Propagation:
    """A quantile of the simulated response over df with at most n_max runs: a pilot design decides whether to emulate
    (on the rest of the design) or to draw the remaining runs at random."""
    if n_max > MOST_RUNS:
        raise ValueError(f"at most {MOST_RUNS} runs")
    z = _kept(standardize(df))
    n_pilot = min(30, n_max // 2)
    order = maxdiss(z, n_pilot)
    rows = {r.row_id: list(r.features) for r in z.where(F.col("row_id").isin(order)).collect()}
    x = np.array([rows[k] for k in order])
    y = simulate(x)
    e = emulability(x, y, seed)
    left = z.where(~F.col("row_id").isin(order)).orderBy(F.xxhash64("row_id", F.lit(seed))).limit(n_max - n_pilot).collect()
    more = np.array([list(r.features) for r in left])
    if e.r2 < threshold:
        y = simulate(more) if len(more) else y
        return Propagation("monte_carlo", e.r2, n_pilot + len(more), float(np.quantile(y, q)))
    if len(more):
        x, y = np.vstack([x, more]), np.concatenate([y, simulate(more)])
    predict = families()[e.family](x, y)

    def emulate(batches):
        import pyarrow as pa

        for b in batches:
            v = np.array(b.column(0).to_pylist(), float)
            yield pa.RecordBatch.from_arrays([pa.array(predict(v) if len(v) else np.zeros(0))], ["y"])

    got = z.select("features").mapInArrow(emulate, "y double").agg(F.percentile_approx("y", q, 10000)).first()[0]
    return Propagation("emulate", e.r2, len(x), float(got))


def sequential_design(x: np.ndarray, y: np.ndarray, start: int = 10, delta: int = 5, tolerance: float = 0.05, k: int = 2, family: str = "rbf_linear") -> list[tuple]:
    """(runs, error, state) as runs grow by delta: initial, improving, converged or deteriorating; stops after k
    converged states in a row."""
    out: list[tuple] = []
    fit = families()[family]
    for n in range(start, len(x) + 1, delta):
        left = [fit(np.delete(x[:n], i, 0), np.delete(y[:n], i))(x[i : i + 1])[0] for i in range(n)]
        err = float(np.sqrt(np.mean((np.array(left) - y[:n]) ** 2)))
        rel = (out[-1][1] - err) / out[-1][1] if out and out[-1][1] > 0 else None
        out.append((n, err, "initial" if rel is None else "deteriorating" if rel < 0 else "converged" if rel < tolerance else "improving"))
        if len(out) > k and all(s == "converged" for _, _, s in out[-k:]):
            break
    return out
