"""Merging fitted models of clients, what a merge loses, and reports across clients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.functions.frames import correlation, framed

# -- fitted models -------------------------------------------------------------------------------------


def vector_mean(models: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """(keys, n, vector): the weighted mean of parameter vectors, place by place, and the weights' sum."""
    each = models.select(*keys, weight, F.posexplode(vector).alias("i", "x"))
    cells = each.groupBy(*keys, "i").agg((F.sum(F.col("x") * F.col(weight)) / F.sum(weight)).alias("x"), F.sum(weight).alias("n"))
    return cells.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vector))


def subspace_mean(models: DataFrame, keys: list[str], top: int, weight: str = "n") -> DataFrame:
    """(keys, mu, residual): the weighted mean of means, and the projector off the `top` main directions of the mean projector.

    models: keys, weight, mu, residual (row by row) as subspace_models gives them. The mean of projectors has full rank, so it is cut back to `top`.
    """
    mean = vector_mean(models, keys, "mu", weight).select(*keys, "mu").join(vector_mean(models, keys, "residual", weight), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m = len(row.mu)
                _, v = np.linalg.eigh(np.eye(m) - np.asarray(row.residual).reshape(m, m))
                v = v[:, -min(top, m) :]
                out.append((*(getattr(row, k) for k in keys), row.mu, (np.eye(m) - v @ v.T).ravel()))
            yield pd.DataFrame(out, columns=[*keys, "mu", "residual"])

    kinds = ", ".join(f"`{k}` {dict(models.dtypes)[k]}" for k in keys)
    return mean.mapInPandas(run, f"{kinds}, mu array<double>, residual array<double>")


def sum_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The merged statistics (n, s, g) of all clients of a key: their sums, place by place."""
    part = lambda c: (
        stats.select(*keys, F.posexplode(c).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
        .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(c))
    )
    return stats.groupBy(*keys).agg(F.sum("n").alias("n")).join(part("s"), keys).join(part("g"), keys)


def excess_objective(stats: DataFrame, best: DataFrame, other: DataFrame, keys: list[str], ridge: float = 1e-4) -> DataFrame:
    """(keys, optimum, excess, relative): how far `other` models lie above the ridge objective's optimum at `best`.

    stats as of ar_stats, merged by key; best and other: keys, w. A row a key, each of the size of the model.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m = len(row.best) + 1
                full = np.asarray(row.g, float).reshape(m, m)
                gap = np.asarray(row.other) - np.asarray(row.best)
                low = full[-1, -1] - np.asarray(row.best) @ full[:-1, -1]
                high = gap @ full[:-1, :-1] @ gap + ridge * row.n * gap @ gap
                out.append((*(getattr(row, k) for k in keys), low, high, high / low if low else None))
            yield pd.DataFrame(out, columns=[*keys, "optimum", "excess", "relative"])

    kinds = ", ".join(f"`{k}` {dict(stats.dtypes)[k]}" for k in keys)
    met = stats.join(best.select(*keys, F.col("w").alias("best")), keys).join(other.select(*keys, F.col("w").alias("other")), keys)
    return met.mapInPandas(run, f"{kinds}, optimum double, excess double, relative double")


def design_stats(series: DataFrame, keys: list[str], p: int, value: str = "x") -> DataFrame:
    """The same sums as ar_stats by another way: products of lags as plain aggregates over all points of a key, without its clients' sums."""
    lags = [f"__l{k}" for k in range(1, p + 1)] + [value]
    made = framed(series, p, 0, {f"__l{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in range(1, p + 1)}).where(F.col(f"__l{p}").isNotNull())
    square = [F.sum(F.col(a) * F.col(b)) for a in lags for b in lags]
    return made.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(a) for a in lags)).alias("s"), F.array(*square).alias("g"))


def witness(merged: DataFrame, pooled: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, gap, verdict): the relative gap between the merged model and one fitted from the pooled points on its own.

    A gap of exactly zero fails too: two ways that agree bit by bit have shared a result.
    """
    size = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    both = merged.select(*keys, F.col("w").alias("a")).join(pooled.select(*keys, F.col("w").alias("b")), keys)
    gap = F.try_divide(size(F.zip_with("a", "b", lambda x, y: x - y)), size(F.col("b")))
    verdict = F.when(F.col("gap") == 0, "FAIL: exact zero").when(F.col("gap") <= tolerance, "PASS").otherwise("FAIL: above tolerance")
    return both.withColumn("gap", gap).select(*keys, "gap", verdict.alias("verdict"))


def whitening(stats: DataFrame, keys: list[str], ridge: float = 1e-6, alpha: float = 1.0) -> DataFrame:
    """(keys, mu, white, condition): the symmetric whitening matrix of the covariance to the power -alpha / 2, its ridge relative to the mean variance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                mu = np.asarray(row.s, float) / row.n
                m = len(mu)
                cov = np.asarray(row.g, float).reshape(m, m) / row.n - np.outer(mu, mu)
                e, v = np.linalg.eigh(cov + ridge * max(np.trace(cov) / m, 1e-300) * np.eye(m))
                e = np.maximum(e, 1e-300)
                out.append((*(getattr(row, k) for k in keys), mu, ((v * e ** (-alpha / 2)) @ v.T).ravel(), e[-1] / e[0]))
            yield pd.DataFrame(out, columns=[*keys, "mu", "white", "condition"])

    kinds = ", ".join(f"`{k}` {dict(stats.dtypes)[k]}" for k in keys)
    return stats.mapInPandas(run, f"{kinds}, mu array<double>, white array<double>, condition double")


# -- clients side by side ------------------------------------------------------------------------------


def output_gaps(outputs: DataFrame, place: list[str], by: list[str]) -> DataFrame:
    """(by, a, b, n, mae, widest, r) of each two clients' outputs (client, place, by, y) on the same places, a before b.

    A place's outputs number as its clients do: they are paired within it, and added up before the shuffle by pair.
    """
    sets = outputs.groupBy(*place, *by).agg(F.sort_array(F.collect_list(F.struct("client", "y"))).alias("__o"))
    first = sets.select(*by, "__o", F.posexplode("__o").alias("__i", "__a"))
    two = first.select(*by, "__a", F.explode(F.expr("slice(__o, __i + 2, size(__o))")).alias("__b"))
    gap = F.abs(F.col("__a.y") - F.col("__b.y"))
    return two.groupBy(*by, F.col("__a.client").alias("a"), F.col("__b.client").alias("b")).agg(
        F.count("*").alias("n"), F.avg(gap).alias("mae"), F.max(gap).alias("widest"), correlation("__a.y", "__b.y").alias("r")
    )


def hit_table(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(arm, keys, rate, n): each arm's hits by client, and over the clients that have one (keys null)."""
    each = hits.where("hit is not null")
    return each.groupingSets([["arm", *keys], ["arm"]], "arm", *keys).agg(F.avg("hit").alias("rate"), F.count("*").alias("n"))


def relabelled(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """records with arms renamed; an arm that names do not hold keeps its name."""
    made = F.coalesce(*(F.when(F.col("arm") == old, new) for old, new in names.items()), F.col("arm"))
    return records.withColumn("arm", made)
