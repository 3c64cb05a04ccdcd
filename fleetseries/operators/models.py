"""Codebooks, token counts, fleet merges, fusion and reconstruction quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import correlation

# -- codebooks -----------------------------------------------------------------------------------------


def first_codebook(vectors: DataFrame, k: int) -> DataFrame:
    """(code, c): the k vectors of lowest vec_id, as a codebook. k rows."""
    rank = F.row_number().over(W.orderBy("vec_id")) - 1
    return vectors.orderBy("vec_id").limit(k).select(rank.cast("int").alias("code"), F.col("v").alias("c"))


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assign(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """vectors with code and d2 of the nearest code (the lowest of equals) and d2_next of the next.

    A codebook has K rows whatever the data, so it goes to every task as one array; no pair of vector and code is a row.
    """
    book = codebook.agg(F.array_sort(F.collect_list(F.struct("code", "c"))).alias("__book"))
    near = F.array_sort(F.transform("__book", lambda e: F.struct(square_distance(F.col("v"), e["c"]).alias("d2"), e["code"].alias("code"))))
    return (
        vectors.crossJoin(F.broadcast(book))  # one row
        .withColumn("__near", F.slice(near, 1, 2))
        .withColumns({"code": F.col("__near")[0]["code"], "d2": F.col("__near")[0]["d2"], "d2_next": F.get("__near", 1)["d2"]})
        .drop("__book", "__near")
    )


def round_stats(assigned: DataFrame) -> DataFrame:
    """n and sums by client, code and dimension: what a client sends in a round."""
    return assigned.select("client", "code", F.posexplode("v").alias("dim", "x")).groupBy("client", "code", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("m"))


def merge_stats(stats: DataFrame, k: int, eps: float = 1e-5) -> DataFrame:
    """The exact merge: by code and dimension, the sum over clients over the smoothed count."""
    merged = stats.groupBy("code", "dim").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    total = F.sum("n").over(W.partitionBy("dim"))
    smooth = (F.col("n") + eps) / (total + k * eps) * total
    return merged.select("code", "dim", (F.col("m") / smooth).alias("x"))


def merge_uniform(stats: DataFrame) -> DataFrame:
    """One vote a client that uses a code."""
    return stats.groupBy("code", "dim").agg(F.avg(F.col("m") / F.col("n")).alias("x"), F.count("*").alias("n_clients"))


def usage(assigned: DataFrame, k: int) -> DataFrame:
    """Active codes, perplexity and the top code's share."""
    counts = assigned.groupBy("code").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())  # K rows
    return counts.withColumn("p", share).agg(
        F.count("*").alias("active"), (F.lit(k) - F.count("*")).alias("dead"), F.exp(-F.sum(F.col("p") * F.log("p"))).alias("perplexity"), F.max("p").alias("top_share")
    )


def participation_ratio(vectors: DataFrame) -> DataFrame:
    """Squared trace of the covariance over the trace of its square, from centred sums of products."""
    pair = vectors.select(F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y"))
    cov = pair.groupBy("i", "j").agg(F.covar_pop("x", "y").alias("c"))
    return cov.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))), 2) / F.sum(F.col("c") * F.col("c"))).alias("participation"))


# -- token counts --------------------------------------------------------------------------------------


def unigrams(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("entity", "token").agg(F.count("*").alias("n"))


def ngrams(tokens: DataFrame) -> DataFrame:
    """Counts of the token with the two before it in its window (null where there are none)."""
    w = W.partitionBy("entity", "split", "win").orderBy("pos")
    return tokens.withColumns({"b": F.lag("token", 1).over(w), "a": F.lag("token", 2).over(w)}).groupBy("a", "b", "token").agg(F.count("*").alias("n"))


def smoothed(counts: DataFrame, keys: list[str], k: int, alpha: float = 1.0) -> DataFrame:
    """counts with the Laplace probability within keys."""
    total = F.sum("n").over(W.partitionBy(*keys))
    return counts.withColumn("p", (F.col("n") + alpha) / (total + alpha * k))


def leave_one_out(counts: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """Each entity's token probabilities from all other entities: the total minus its own counts."""
    total = counts.groupBy("token").agg(F.sum("n").alias("all_n"))
    grid = counts.select("entity").distinct().join(total.select("token", "all_n"), how="cross")  # entities by tokens, the size of the result
    left = grid.join(counts, ["entity", "token"], "left").withColumn("others", F.col("all_n") - F.coalesce("n", F.lit(0)))
    return left.select("entity", "token", "others", ((F.col("others") + alpha) / (F.sum("others").over(W.partitionBy("entity")) + alpha * k)).alias("p"))


def js_divergence(counts: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """Jensen-Shannon divergence (nats, Laplace over k tokens) and Jaccard overlap of each pair of entities."""
    tokens = counts.select("token").distinct()
    grid = counts.select("entity").distinct().join(tokens, how="cross").join(counts, ["entity", "token"], "left").fillna(0, ["n"])
    p = grid.withColumn("p", (F.col("n") + alpha) / (F.sum("n").over(W.partitionBy("entity")) + alpha * k)).select("entity", "token", "n", "p")
    a, b = (p.select("token", F.col("entity").alias(f"e{s}"), F.col("n").alias(f"n{s}"), F.col("p").alias(f"p{s}")) for s in "ab")
    m = (F.col("pa") + F.col("pb")) / 2
    both = ((F.col("na") > 0) & (F.col("nb") > 0)).cast("long")
    either = ((F.col("na") > 0) | (F.col("nb") > 0)).cast("long")
    return a.join(b, "token").where("ea < eb").groupBy("ea", "eb").agg(
        F.sum(0.5 * (F.col("pa") * F.log(F.col("pa") / m) + F.col("pb") * F.log(F.col("pb") / m))).alias("js"), (F.sum(both) / F.sum(either)).alias("jaccard")
    )


def mutual_information(counts: DataFrame) -> DataFrame:
    """Mutual information of entity and token over the tokens' entropy."""
    total = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))  # one number
    p = total.withColumns({"pe": F.sum("n").over(W.partitionBy("entity")) / F.col("all"), "pt": F.sum("n").over(W.partitionBy("token")) / F.col("all"), "p": F.col("n") / F.col("all")})
    return p.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pe") * F.col("pt")))).alias("mi"), (-F.sum(F.col("p") * F.log("pt"))).alias("h")).select(
        "mi", "h", (F.col("mi") / F.col("h")).alias("normalised")
    )


# -- fleet merges --------------------------------------------------------------------------------------


def pooled_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled mean and variance of (n, mean, var) rows by total variance, clipped at 0; inner ignores what lies between clients."""
    share = F.col("n") / F.sum("n").over(W.partitionBy(*keys))
    w = moments.withColumn("__w", share)
    mean = F.sum(F.col("__w") * F.col("mean"))
    return w.groupBy(*keys).agg(
        mean.alias("mean"), F.greatest(F.sum(F.col("__w") * (F.col("var") + F.col("mean") * F.col("mean"))) - mean * mean, F.lit(0.0)).alias("var"),
        F.sum(F.col("__w") * F.col("var")).alias("inner"),
    )


def weighted_mean(params: DataFrame) -> DataFrame:
    """The weighted mean of parameter vectors, by name and place."""
    return params.groupBy("name", "idx").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))


def robust_rates(rates: DataFrame, keys: list[str], value: str, cut: int = 1) -> DataFrame:
    """Mean, lower median and trimmed mean (the median where nothing is left) of the clients' rates. Clients of a cell are few."""
    s = F.col("s")
    n = F.size(s)
    lower = F.element_at(s, ((n + 1) / 2).cast("int"))
    inner = F.slice(s, cut + 1, n - 2 * cut)
    trimmed = F.when(n > 2 * cut, F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / (n - 2 * cut)).otherwise(lower)
    return rates.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("s"), F.avg(value).alias("mean")).select(*keys, "mean", lower.alias("median"), trimmed.alias("trimmed"))


# -- reconstruction quality ----------------------------------------------------------------------------


def approximation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Errors and agreement of y against x: constant series agree fully if equal, else not at all. Shares of a zero are null."""
    d = F.col("x") - F.col("y")
    flat_x, flat_y = F.stddev_pop("x") < 1e-12, F.stddev_pop("y") < 1e-12
    cosine = F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))))
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), cosine.alias("cosine"),
        F.when(flat_x & flat_y, F.when(F.max(F.abs(d)) < 1e-12, 1.0).otherwise(0.0)).when(flat_x | flat_y, 0.0).otherwise(correlation("x", "y")).alias("pearson"),
        F.try_divide(F.avg(d * d), F.var_pop("x")).alias("nmse"), F.try_divide(F.var_pop("y"), F.var_pop("x")).alias("variance_ratio"),
    )
