"""Kernels over space and time: kriging, Gaussian processes, rainfall pulses, shape classes and regimes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places that one system of equations may hold; with more, each cell has a system of its nearest ones.
MOST_STATIONS = 2000
#: Places in such a neighbourhood.
NEIGHBOURS = 64


def _places(stations: DataFrame) -> DataFrame:
    """(x, y, value): the mean of the values at each place."""
    return stations.where("value IS NOT NULL").groupBy("x", "y").agg(F.avg("value").alias("value"))


def _some(places: DataFrame, most: int) -> tuple[pd.DataFrame, bool]:
    """All places if they are at most most, else that many, the same on every run; and whether these are all."""
    rows = places.orderBy(F.xxhash64("x", "y"), "x", "y").limit(most + 1).toPandas()
    return rows.iloc[:most].sort_values(["x", "y"], ignore_index=True), len(rows) <= most


def _neighbourhoods(cells: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(cell, near): the k nearest places of each cell as structs of distance, x, y, value."""
    from .spatial import nearest

    n = nearest(cells.select("cell", "x", "y"), places.withColumn("station", F.struct("x", "y", "value")), k)
    return n.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("distance", "station.x", "station.y", "station.value"))).alias("near"))


def _arrays(near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.array([(q["distance"], q["x"], q["y"], q["value"]) for q in near])
    return a[:, 0], a[:, 1:3], a[:, 3]


def _apart(p: np.ndarray) -> np.ndarray:
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def _spherical(h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    r = np.minimum(h / reach, 1.0)
    return np.where(h > 0, nugget + sill * (1.5 * r - 0.5 * r**3), 0.0)


def _variogram(p: np.ndarray, v: np.ndarray, lags: int) -> tuple[float, float, float]:
    from .extremes import simplex

    h = _apart(p)
    i, j = np.triu_indices(len(p), 1)
    edge = np.linspace(0, h.max() / 2, lags + 1)
    which = np.digitize(h[i, j], edge)
    half = 0.5 * (v[i] - v[j]) ** 2
    bins = [(h[i, j][which == k].mean(), half[which == k].mean(), (which == k).sum()) for k in range(1, lags + 1) if (which == k).any()]
    x, g, w = map(np.array, zip(*bins))
    var = max(v.var(), 1e-12)
    a, _ = simplex(lambda q: float((w * (_spherical(x, abs(q[0]) * var, abs(q[1]) * var, abs(q[2]) * edge[-1] + 1e-9) - g) ** 2).sum()), np.array([0.1, 0.9, 0.7]))
    return abs(a[0]) * var, abs(a[1]) * var, abs(a[2]) * edge[-1] + 1e-9


def _system(p: np.ndarray, model: tuple) -> np.ndarray:
    n = len(p)
    left = np.ones((n + 1, n + 1))
    left[:n, :n], left[n, n] = _spherical(_apart(p), *model), 0.0
    return np.linalg.pinv(left)


def kriging(cells: DataFrame, stations: DataFrame, lags: int = 6, most: int = MOST_STATIONS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(cell, value, variance): ordinary kriging with a spherical variogram fitted to binned half squared differences.

    Stations of one place count as their mean. With at most most places all of them are in one system; with more, the
    variogram is fitted on that many, chosen by hash, and each cell is estimated from its nearest of all places."""
    places = _places(stations)
    s, whole = _some(places, most)
    p, v = s[["x", "y"]].to_numpy(float), s["value"].to_numpy(float)
    model = _variogram(p, v, lags)
    schema = "cell long, value double, variance double"
    if not whole:

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for cell, near in zip(b["cell"], b["near"]):
                    d, at, value = _arrays(near)
                    right = np.append(_spherical(d, *model), 1.0)
                    w = _system(at, model) @ right
                    out.append((cell, float(w[:-1] @ value), max(float(w @ right), 0.0)))
                yield pd.DataFrame(out, columns=["cell", "value", "variance"])

        return _neighbourhoods(cells, places, neighbours).mapInPandas(local, schema)
    n, inverse = len(p), _system(p, model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.sqrt(((b[["x", "y"]].to_numpy(float)[:, None] - p[None]) ** 2).sum(-1))
            right = np.hstack([_spherical(d, *model), np.ones((len(b), 1))])
            weights = right @ inverse.T
            yield pd.DataFrame({"cell": b["cell"], "value": weights[:, :n] @ v, "variance": np.maximum((weights * right).sum(1), 0.0)})

    return cells.select("cell", "x", "y").mapInPandas(predict, schema)


def gaussian_process(cells: DataFrame, stations: DataFrame, length: float = 0.3, alpha: float = 1.0, noise: float = 0.05, most: int = MOST_STATIONS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(cell, mean, std): rational-quadratic kernel over coordinates scaled to the unit square.

    Stations of one place count as their mean. With at most most places all of them are in one system; with more, each
    cell has a system of its nearest of all places. Scales, mean and deviation are those of all places."""
    places = _places(stations)
    o = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.avg("value"), F.stddev_pop("value")).first()
    low, span, mu, sd = np.array([o[0], o[2]], float), np.maximum(np.array([o[1] - o[0], o[3] - o[2]], float), 1e-12), float(o[4]), max(float(o[5]), 1e-12)
    kernel = lambda d2: (1 + d2 / (2 * alpha * length**2)) ** -alpha
    schema = "cell long, mean double, std double"

    def scaled(df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(float(low[k]))) / F.lit(float(span[k])) for k, c in enumerate("xy")})

    def solved(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = np.linalg.cholesky(kernel(_apart(p) ** 2) + (noise + 1e-9) * np.eye(len(p)))
        return root, np.linalg.solve(root.T, np.linalg.solve(root, (v - mu) / sd))

    s, whole = _some(scaled(places), most)
    if not whole:

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for cell, near in zip(b["cell"], b["near"]):
                    d, at, value = _arrays(near)
                    root, weight = solved(at, value)
                    k = kernel(d * d)
                    u = np.linalg.solve(root, k)
                    out.append((cell, mu + sd * float(k @ weight), sd * max(1 - float(u @ u), 0.0) ** 0.5))
                yield pd.DataFrame(out, columns=["cell", "mean", "std"])

        return _neighbourhoods(scaled(cells), scaled(places), neighbours).mapInPandas(local, schema)
    z = s[["x", "y"]].to_numpy(float)
    root, weight = solved(z, s["value"].to_numpy(float))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = kernel(((b[["x", "y"]].to_numpy(float)[:, None] - z[None]) ** 2).sum(-1))
            u = np.linalg.solve(root, k.T)
            yield pd.DataFrame({"cell": b["cell"], "mean": mu + sd * (k @ weight), "std": sd * np.sqrt(np.maximum(1 - (u * u).sum(0), 0.0))})

    return scaled(cells.select("cell", "x", "y")).mapInPandas(predict, schema)


def nsrp(spark: SparkSession, days: int, storms_per_day: float, cells_per_storm: float, delay_hours: float, duration_hours: float, intensity: float, seed: int = 0) -> DataFrame:
    """(hour, value): Neyman-Scott rectangular pulses. Each day's storms are drawn from a generator of its own; pulses are
    spread over the hours they touch and summed, so any number of days is one shuffle."""

    def pulses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for day in b["id"]:
                g = np.random.Generator(np.random.PCG64([seed, int(day)]))
                for _ in range(g.poisson(storms_per_day)):
                    at = day * 24 + g.uniform(0, 24)
                    m = 1 + g.poisson(max(cells_per_storm - 1, 0))
                    for t, d, i in zip(at + g.exponential(delay_hours, m), g.exponential(duration_hours, m), g.exponential(intensity, m)):
                        h = np.arange(int(t), int(t + d) + 1)
                        out += zip(h.tolist(), (i * (np.minimum(h + 1, t + d) - np.maximum(h, t))).tolist())
            yield pd.DataFrame(out, columns=["hour", "value"]).astype({"hour": "int64", "value": "float64"})

    rain = spark.range(days).mapInPandas(pulses, "hour long, value double").groupBy("hour").agg(F.sum("value").alias("value"))
    return spark.range(days * 24).withColumnRenamed("id", "hour").join(rain, "hour", "left").select("hour", F.coalesce("value", F.lit(0.0)).alias("value"))


def resampled(segments: DataFrame, points: int = 20) -> DataFrame:
    """(event_id, features): each event's values (event_id, pos, value) over its maximum, at evenly spread points."""
    e = segments.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"), F.max("value").alias("top"))
    at = f"k * (size(s) - 1) / {points - 1}.0D"
    low = f"s[CAST(floor({at}) AS INT)].value"
    high = f"s[CAST(least(floor({at}) + 1, size(s) - 1) AS INT)].value"
    x = F.expr(f"transform(sequence(0, {points - 1}), k -> IF(top > 0, ({low} + ({at} - floor({at})) * ({high} - {low})) / top, 0D))")
    return e.select("event_id", x.alias("features"))


def shape_classes(segments: DataFrame, k: int = 4, points: int = 20, seed: int = 0) -> DataFrame:
    """(event_id, shape_type): resampled hydrographs, centred principal components, k-means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    d = resampled(segments, points).withColumn("v", array_to_vector("features"))
    steps = [StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False), PCA(k=min(5, points), inputCol="c", outputCol="p"), KMeans(k=k, seed=seed, featuresCol="p", predictionCol="shape_type")]
    return Pipeline(stages=steps).fit(d).transform(d).select("event_id", "shape_type")


def regimes(df: DataFrame, value: str, k: int = 2, seed: int = 0) -> DataFrame:
    """df with regime: components of a Gaussian mixture over one column, in rising order of their means."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector(F.array(F.col(value).cast("double"))))
    got = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(d).transform(d)
    means = got.groupBy("_c").agg(F.avg(value).alias("_m"))
    ranks = means.withColumn("regime", F.row_number().over(Window.orderBy("_m")) - 1).select("_c", "regime")  # a row for each component
    return got.join(F.broadcast(ranks), "_c").drop("_v", "_c", "probability")
