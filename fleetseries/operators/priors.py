"""Count priors over tokens: back-off tables, scoring, usage, starvation, transfer. All come from additive counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetseries.functions.frames import dense_index, settled
from fleetseries.operators.faults import uniform


def in_context(tokens: DataFrame) -> DataFrame:
    """tokens with the two before them in their window: b, and a before b; null where there are none."""
    w = W.partitionBy("entity", "split", "win").orderBy("pos")
    return tokens.withColumns({"b": F.lag("token", 1).over(w), "a": F.lag("token", 2).over(w)})


def backoff(train: DataFrame, scored: DataFrame, k: int, alpha: float = 1.0, lam2: float = 0.7, lam3: float = 0.6) -> DataFrame:
    """scored (with a and b) with p: trigram, bigram and unigram estimates interpolated in this order.

    n-grams that training lacks are worked out where they are looked up, so only those seen are kept in tables.
    """
    n1 = train.groupBy("token").agg(F.count("*").alias("n1"))
    n2 = train.where("b is not null").groupBy("b", "token").agg(F.count("*").alias("n2"))
    n3 = train.where("a is not null").groupBy("a", "b", "token").agg(F.count("*").alias("n3"))
    c1 = F.broadcast(n1.agg(F.sum("n1").alias("c1")))  # one row
    c2, c3 = n2.groupBy("b").agg(F.sum("n2").alias("c2")), n3.groupBy("a", "b").agg(F.sum("n3").alias("c3"))
    met = scored.join(n1, "token", "left").join(n2, ["b", "token"], "left").join(c2, "b", "left").join(n3, ["a", "b", "token"], "left").join(c3, ["a", "b"], "left").join(c1)
    share = lambda n, c: (F.coalesce(n, F.lit(0)) + alpha) / (F.coalesce(c, F.lit(0)) + alpha * k)
    p1 = share("n1", "c1")
    p2 = F.when(F.col("b").isNull(), p1).otherwise(lam2 * share("n2", "c2") + (1 - lam2) * p1)
    p3 = F.when(F.col("a").isNull(), p2).otherwise(lam3 * share("n3", "c3") + (1 - lam3) * p2)
    return met.withColumn("p", p3).drop("n1", "n2", "n3", "c1", "c2", "c3")


def position_log_prob(tokens: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """Laplace log-probability of each token seen at a position."""
    n = tokens.groupBy("pos", "token").agg(F.count("*").alias("n"))
    return n.withColumn("logp", F.log((F.col("n") + alpha) / (F.sum("n").over(W.partitionBy("pos")) + alpha * k)))


def mixed_nll(own: Column, other: Column, lam: float) -> Column:
    """-log(lam exp(-own) + (1 - lam) exp(-other)), kept from underflow by the smaller of the two."""
    low = F.least(own, other)
    return low - F.log(lam * F.exp(low - own) + (1 - lam) * F.exp(low - other))


def full_table(counts: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """(entity, token, n, logp) for all k tokens: an entity's tokens fit one row group."""
    grid = counts.select("entity").distinct().withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    known = grid.join(counts, ["entity", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return known.withColumn("logp", F.log((F.col("n") + alpha) / (F.sum("n").over(W.partitionBy("entity")) + alpha * k)))


def usage_aware(counts: DataFrame, k: int, dead_floor: float = 0.01) -> DataFrame:
    """nll of each of k tokens from pooled counts: n + 1, or dead_floor for tokens that nobody emits."""
    pooled = counts.groupBy("token").agg(F.sum("n").alias("n"))
    every = counts.sparkSession.range(k).select(F.col("id").cast("int").alias("token")).join(pooled, "token", "left").fillna(0, ["n"])
    weight = F.when(F.col("n") == 0, F.lit(dead_floor)).otherwise(F.col("n") + 1)
    return every.withColumn("w", weight).withColumn("nll", -F.log(F.col("w") / F.sum("w").over(W.partitionBy(F.lit(0))))).select("token", "n", "nll")


def usage_report(counts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """By entity: active and dead tokens, those dead here but alive elsewhere, mean Jaccard with the others and the nearest of them."""
    alive = F.broadcast(counts.agg(F.count_distinct("token").alias("alive")))  # one row
    own = counts.groupBy("entity").agg(F.count("*").alias("active")).join(alive)
    both = pairs.select(F.col("ea").alias("entity"), F.col("eb").alias("other"), "js", "jaccard").unionByName(
        pairs.select(F.col("eb").alias("entity"), F.col("ea").alias("other"), "js", "jaccard")
    )
    near = both.groupBy("entity").agg(F.avg("jaccard").alias("mean_jaccard"), F.min_by("other", F.struct("js", "other")).alias("nearest"))
    return own.join(near, "entity", "left").select(
        "entity", "active", (k - F.col("active")).alias("dead"), (F.col("alive") - F.col("active")).alias("dead_here_only"), "mean_jaccard", "nearest"
    )


def rarity_weights(counts: DataFrame) -> DataFrame:
    """Inverse square roots of token frequencies, of mean 1 over an entity's active tokens."""
    e = W.partitionBy("entity")
    raw = counts.withColumn("w", F.sqrt(F.sum("n").over(e) / F.col("n")))
    return raw.select("entity", "token", (F.col("w") / F.avg("w").over(e)).alias("weight"))


def starvation(contexts: DataFrame, threshold: int) -> DataFrame:
    """By entity: how thin the counts of tokens and of adjacent pairs are."""
    uni = contexts.groupBy("entity", "token").agg(F.count("*").alias("n")).groupBy("entity").agg(
        F.count("*").alias("active"), F.floor(F.percentile("n", F.lit(0.5))).alias("median"), F.floor(F.percentile("n", F.lit(0.1))).alias("p10"),
        F.count_if(F.col("n") < threshold).alias("starved"),
    )
    bi = contexts.where("b is not null").groupBy("entity", "b", "token").agg(F.count("*").alias("n")).groupBy("entity").agg(
        F.count("*").alias("pairs"), F.avg((F.col("n") == 1).cast("double")).alias("singleton"), F.avg((F.col("n") < threshold).cast("double")).alias("starved_pairs")
    )
    return uni.join(bi, "entity", "left")


def mergeability(contexts: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """Mean divergence, weighted by context, of averaged local conditionals from those of the pooled counts.

    The average over entities is a sum: entities without a context add the uniform share, so no grid of entities is made.
    """
    n = contexts.where("b is not null").groupBy("entity", "b", "token").agg(F.count("*").alias("n"))
    c = n.groupBy("entity", "b").agg(F.sum("n").alias("c"))
    cells = n.join(c, ["entity", "b"]).groupBy("b", "token").agg(F.sum("n").alias("n"), F.sum(F.col("n") / (F.col("c") + alpha * k)).alias("q"))
    seen = c.groupBy("b").agg(F.sum("c").alias("c"), F.sum(1 / (F.col("c") + alpha * k)).alias("s"), F.count("*").alias("m"))
    total = F.broadcast(contexts.agg(F.count_distinct("entity").alias("entities")))  # one row
    grid = seen.join(total).withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(cells, ["b", "token"], "left").fillna(0, ["n", "q"])
    averaged = (F.col("q") + alpha * (F.col("s") + (F.col("entities") - F.col("m")) / (alpha * k))) / F.col("entities")
    pooled = (F.col("n") + alpha) / (F.col("c") + alpha * k)
    kl = grid.withColumns({"p": averaged, "o": pooled}).groupBy("b", "c").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("o"))).alias("kl"))
    return kl.agg((F.sum(F.col("kl") * F.col("c")) / F.sum("c")).alias("kl"), F.count("*").alias("contexts"))


def transfer_grid(priors: DataFrame, counts: DataFrame) -> DataFrame:
    """(source, target, value): mean log-probability of the target's tokens under the source's prior. Tokens are counted before they meet."""
    met = counts.withColumnRenamed("entity", "target").join(priors.select(F.col("entity").alias("source"), "token", "logp"), "token")
    return met.groupBy("source", "target").agg((F.sum(F.col("n") * F.col("logp")) / F.sum("n")).alias("value"))


def reduce_grid(grid: DataFrame, clusters: DataFrame) -> DataFrame:
    """By target: its own value, the mean, best and worst of foreign ones (all, and within its cluster), and the gaps between them."""
    named = grid.join(clusters.select(F.col("entity").alias("source"), F.col("cluster").alias("cs")), "source").join(clusters.select(F.col("entity").alias("target"), F.col("cluster").alias("ct")), "target")
    own, far = F.col("source") == F.col("target"), F.col("source") != F.col("target")
    near = far & (F.col("cs") == F.col("ct"))
    of = lambda agg, cond: agg(F.when(cond, F.col("value")))
    rows = named.groupBy("target", F.col("ct").alias("cluster")).agg(
        of(F.max, own).alias("self_value"), of(F.avg, far).alias("mean_all"), of(F.max, far).alias("best_all"), of(F.min, far).alias("worst_all"),
        of(F.avg, near).alias("mean_within"), of(F.max, near).alias("best_within"),
    )
    return rows.withColumns({
        "tau_all": F.col("self_value") - F.col("mean_all"), "tau_within": F.col("self_value") - F.col("mean_within"),
        "kappa_all": F.col("best_all") - F.col("self_value"), "kappa_within": F.col("best_within") - F.col("self_value"),
    })


def cold_start(tokens: DataFrame, clusters: DataFrame, k: int, fractions: tuple[float, ...] = (0.1, 0.25, 0.5), lam: float = 0.3) -> DataFrame:
    """(entity, fraction, windows, local, assisted, full, neighbour, routed): what a young entity's prior is worth, alone and with help.

    tokens: entity, split, win, pos, token; clusters: entity, cluster. The entity's training windows are ranked by a
    hash, so the windows of a smaller fraction are among those of a larger one: each is counted once, at the smallest
    fraction that holds it, and running sums over fractions give the rest. At least one window is kept.

    Figures are mean negative log-probabilities of the test tokens: under Laplace counts by position of those windows
    (local) and of all (full); mixed, with the weight lam, with the counts of all other entities of the cluster
    (assisted), or with those of its neighbour alone (routed): the other entity of the cluster whose whole counts give
    the windows kept the highest mean log-probability (ties by name). An entity alone in its cluster has no help: the
    three figures are those of local, the neighbour null. Entities without test or training tokens have no row.
    """
    train = settled(tokens.where("split = 'train'").join(clusters.select("entity", "cluster").distinct(), "entity"))
    windows = train.select("entity", "win").distinct().withColumn("u", uniform(F.concat_ws("|", "entity", "win")))
    placed = dense_index(windows, ("entity",), F.floor(F.col("u") * 256), ["u", "win"], "place")
    sizes = windows.groupBy("entity").agg(F.count("*").alias("all"))
    kept = lambda f: F.greatest(F.lit(1), F.bround(F.col("all") * f, 0)).cast("long")
    level = F.coalesce(*(F.when(F.col("place") < kept(f), i) for i, f in enumerate(fractions)), F.lit(len(fractions)))
    dealt = train.join(placed.join(sizes, "entity").select("entity", "win", level.alias("level")), ["entity", "win"])
    at = settled(dealt.groupBy("entity", "cluster", "level", "pos", "token").agg(F.count("*").alias("n")))

    later = F.explode(F.sequence(F.col("level"), F.lit(len(fractions)))).alias("f")  # the last is the whole
    own = settled(at.select("entity", "cluster", "pos", "token", "n", later).groupBy("entity", "cluster", "f", "pos", "token").agg(F.sum("n").alias("n")))
    whole = own.where(F.col("f") == len(fractions)).drop("f")
    rate = lambda n, total: (F.coalesce(n, F.lit(0)) + 1) / (F.coalesce(total, F.lit(0)) + k)
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("total"))

    # the neighbour: the source, of the same cluster, under whose whole counts the kept windows are likeliest
    source = whole.join(sums(whole, "entity", "pos"), ["entity", "pos"]).select(F.col("entity").alias("source"), "cluster", "pos", "token", F.log(rate(F.col("n"), F.col("total"))).alias("seen"))
    unseen = sums(whole, "entity", "cluster", "pos").select(F.col("entity").alias("source"), "cluster", "pos", F.log(1 / (F.col("total") + k)).alias("unseen"))
    base = own.groupBy("entity", "cluster", "f", "pos").agg(F.sum("n").alias("n")).join(unseen, ["cluster", "pos"]).where("source <> entity").groupBy("entity", "f", "source").agg(F.sum(F.col("n") * F.col("unseen")).alias("base"))
    more = own.join(source, ["cluster", "pos", "token"]).where("source <> entity").join(unseen, ["source", "cluster", "pos"]).groupBy("entity", "f", "source").agg(F.sum(F.col("n") * (F.col("seen") - F.col("unseen"))).alias("more"))
    likely = base.join(more, ["entity", "f", "source"], "left").withColumn("fit", F.round(F.col("base") + F.coalesce("more", F.lit(0.0)), 9))
    neighbour = likely.groupBy("entity", "f").agg(F.min_by("source", F.struct(-F.col("fit"), F.col("source"))).alias("neighbour"))

    test = tokens.where("split = 'test'").groupBy("entity", "pos", "token").agg(F.count("*").alias("m"))
    grid = test.join(own.select("entity", "cluster", "f").distinct(), "entity").join(neighbour, ["entity", "f"], "left")
    pool = whole.groupBy("cluster", "pos", "token").agg(F.sum("n").alias("n"))
    members = clusters.groupBy("cluster").agg(F.count_distinct("entity").alias("members"))
    other = lambda df, name, keys: df.select(*keys, F.col("n").alias(f"n_{name}"))
    met = (
        grid.join(other(own, "own", ["entity", "f", "pos", "token"]), ["entity", "f", "pos", "token"], "left").join(sums(own, "entity", "f", "pos").withColumnRenamed("total", "t_own"), ["entity", "f", "pos"], "left")
        .join(other(whole, "all", ["entity", "pos", "token"]), ["entity", "pos", "token"], "left").join(sums(whole, "entity", "pos").withColumnRenamed("total", "t_all"), ["entity", "pos"], "left")
        .join(other(pool, "pool", ["cluster", "pos", "token"]), ["cluster", "pos", "token"], "left").join(sums(pool, "cluster", "pos").withColumnRenamed("total", "t_pool"), ["cluster", "pos"], "left")
        .join(other(whole.withColumnRenamed("entity", "neighbour"), "near", ["neighbour", "pos", "token"]), ["neighbour", "pos", "token"], "left")
        .join(sums(whole.withColumnRenamed("entity", "neighbour"), "neighbour", "pos").withColumnRenamed("total", "t_near"), ["neighbour", "pos"], "left")
        .join(members, "cluster")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    local = rate(F.col("n_own"), F.col("t_own"))
    others = rate(zero("n_pool") - zero("n_all"), zero("t_pool") - zero("t_all"))
    mixed = lambda p: F.when(F.col("members") > 1, (1 - lam) * local + lam * p).otherwise(local)
    mean = lambda p, name: (-F.sum(F.col("m") * F.log(p)) / F.sum("m")).alias(name)
    out = met.groupBy("entity", "f", "neighbour").agg(
        mean(local, "local"), mean(mixed(others), "assisted"), mean(rate(F.col("n_all"), F.col("t_all")), "full"), mean(mixed(rate(F.col("n_near"), F.col("t_near"))), "routed")
    )
    named = F.element_at(F.array(*map(F.lit, fractions)), F.col("f") + 1)
    return out.where(F.col("f") < len(fractions)).join(sizes, "entity").select(
        "entity", named.alias("fraction"), F.greatest(F.lit(1), F.bround(F.col("all") * named, 0)).cast("long").alias("windows"), "local", "assisted", "full", "neighbour", "routed"
    )


def drift(params: DataFrame) -> DataFrame:
    """By entity: distance of its parameter vector from the weighted centre of all, and that over the centre's norm."""
    centre = params.groupBy("idx").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("m"))
    gap = F.col("value") - F.col("m")
    return params.join(centre, "idx").groupBy("entity").agg(
        F.sqrt(F.sum(gap * gap)).alias("drift"), (F.sqrt(F.sum(gap * gap)) / F.sqrt(F.sum(F.col("m") * F.col("m")))).alias("relative")
    )
