"""The best question of each head body: one candidate a head, found by paths that are pruned by what they could still gain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import endpoints
from .tables import kept

#: Edges of a larger weight are confirmed boundaries: no question leads from one of their ends to the other (fixed value).
CONFIRMED_OVER = 1.00001

#: Classes that steps are dealt to by their affinity and by the mass of the target they lead to.
AFFINITIES, MASSES = 8, 4


def head_candidates(edges: DataFrame, heads: DataFrame, targets: DataFrame, gain: Callable[[Column, Column, Column], Column], least: float, hops: int | None = None, accept: float = 0.0, preserve: bool = True) -> DataFrame:
    """(head, id, first, prob, gain): for each of heads(id, mass) the one of targets(id, mass) with the largest gain(prob, mass, target's mass).

    prob is the largest product of affinities 1 - weight over paths of at most `hops` edges (None: any), at
    least `least`; first is the last body on the path that touches the head, which is what a head is asked about. Paths lead over
    bodies that are no targets as well, but to none that shares a confirmed edge with the head, nor, with
    preserve, a preserved one. The gain must grow with prob and with the target's mass: a path whose gain with
    the largest mass of all would stay below `accept` or below the head's best so far is not followed, so
    fronts shrink as heads find candidates. Steps are dealt to classes of affinity and mass, and a path meets those only whose
    upper bounds would do, so most paths that are not followed are not made either. Heads without a gain of at least `accept` give no row.

    Ties: of equal products the fewest edges, then the smallest first body on the way; of equal gains the smallest target.
    """
    flagged = F.coalesce("preserve", F.lit(False)) if preserve and "preserve" in edges.columns else F.lit(False)
    false = F.coalesce("false_edge", F.lit(False)) if "false_edge" in edges.columns else F.lit(False)
    pair = [F.least("node1", "node2").alias("node1"), F.greatest("node1", "node2").alias("node2")]
    rows = edges.select(*pair, F.when(~flagged, F.round(1 - F.col("weight"), 9)).alias("_p"), (flagged | (F.col("weight") > CONFIRMED_OVER)).alias("_barred"), (~false).alias("_asked"))
    pairs = kept(rows.groupBy("node1", "node2").agg(F.max("_p").alias("_p"), F.bool_or("_barred").alias("_barred"), F.bool_or("_asked").alias("_asked")))
    heads = kept(heads.select(F.col("id").alias("head"), F.col("mass").cast("double").alias("_m")))
    targets = kept(targets.select("id", F.col("mass").cast("double").alias("_t")))
    most = targets.agg(F.max("_t")).first()[0]
    worth = lambda p, a, b: F.round(gain(p, a, b), 15)
    # each step with the mass of the target that it leads to, if it is one: the last step is bounded by that
    near = endpoints(pairs, "_p", "_barred").where(F.col("_p") >= max(least, 0.000001))
    near = near.join(targets.withColumnRenamed("id", "other"), "other", "left")
    bounds = [] if most is None else sorted({*targets.approxQuantile("_t", [k / MASSES for k in range(1, MASSES)], 0.01), most})
    heavy = F.lit(len(bounds))  # no target: a class of its own
    for k in reversed(range(len(bounds))):
        heavy = F.when(F.col("_t") <= bounds[k], F.lit(k)).otherwise(heavy)
    near = kept(near.withColumn("_k", heavy * AFFINITIES + F.least(F.greatest(F.ceil(F.col("_p") * AFFINITIES) - 1, F.lit(0)), F.lit(AFFINITIES - 1)).cast("int")))

    def promising(paths: DataFrame, mass: Column) -> DataFrame:
        """paths whose gain with a target of that mass would reach accept and _g, the head's best so far."""
        bound = worth(F.col("prob"), F.col("_m"), mass)
        return paths.where((bound >= accept) & (F.col("_g").isNull() | (bound >= F.col("_g"))))

    def hopeful(prob: Column, mass: Column) -> Column:
        """As promising, without rounding and with more room than rounding takes: what it refuses is refused there."""
        bound = gain(prob * (1 + 1e-7), F.col("_m"), mass) + 1e-13
        return (prob * (1 + 1e-7) >= least) & (bound >= accept) & (F.col("_g").isNull() | (bound >= F.col("_g")))

    seen: list[DataFrame] = []
    best = heads.sparkSession.createDataFrame([], "head long, id long, first long, prob double, gain double")
    if most is None:
        return best
    top = near.agg(F.max("_p")).first()[0] or 1.0
    front = heads.select("head", "_m", F.col("head").alias("id"), F.lit(None).cast("long").alias("first"), F.lit(1.0).alias("prob"))
    done = 0
    while hops is None or done < hops:
        done += 1
        # what the heads have found since bounds the front before it is followed, and each step as it is made
        front = front.drop("_t").join(best.select("head", F.col("gain").alias("_g")), "head", "left") if seen else front.withColumn("_g", F.lit(None).cast("double"))
        last = done == hops
        step = promising(front, F.lit(most))
        if seen:
            # an affinity over 1, which a negative weight gives, is in the last class
            kinds = [(m * AFFINITIES + k, (k + 1) / AFFINITIES if k < AFFINITIES - 1 else max(1.0, top), bounds[m] if last else most) for m in range(len(bounds) + (not last)) for k in range(AFFINITIES)]
            kinds = F.broadcast(heads.sparkSession.createDataFrame(kinds, "_k int, _up double, _ut double"))  # some forty rows
            step = step.join(kinds, hopeful(F.col("prob") * F.col("_up"), F.col("_ut"))).drop("_up", "_ut").join(near, ["id", "_k"])
            step = step.where(hopeful(F.col("prob") * F.col("_p"), F.col("_t") if last else F.lit(most)))
        else:
            step = step.join(near, "id")
        step = step.where("other != head")
        step = step.select("head", "_m", "_g", F.col("other").alias("id"), F.coalesce("first", "other").alias("first"), F.round(F.col("prob") * F.col("_p"), 9).alias("prob"), "_t", "_barred").where(F.col("prob") >= least)
        step = promising(step, F.col("_t") if last else F.lit(most))
        if not seen:  # the first step is the edge itself, one a pair
            step = step.where("not _barred").drop("_barred", "_g")
        else:
            way = F.max(F.struct("prob", (-F.col("first")).alias("f"))).alias("_s")
            step = step.groupBy("head", "id").agg(way, F.max("_m").alias("_m"), F.max("_t").alias("_t")).select("head", "_m", "id", (-F.col("_s.f")).alias("first"), "_s.prob", "_t")
            old = seen[0]
            for s in seen[1:]:
                old = old.unionByName(s)
            old = old.groupBy("head", "id").agg(F.max("prob").alias("_old"))
            step = step.join(old, ["head", "id"], "left").where("_old is null or prob > _old").drop("_old")
            touch = pairs.select("node1", "node2", "_barred", "_asked")
            step = step.withColumns({"node1": F.least("head", "id"), "node2": F.greatest("head", "id")}).join(touch, ["node1", "node2"], "left").where("not coalesce(_barred, false)")
            step = step.withColumn("first", F.when(F.col("_asked"), F.col("id")).otherwise(F.col("first"))).select("head", "_m", "id", "first", "prob", "_t")
        front = kept(step)
        if front.isEmpty():
            break
        seen.append(front.select("head", "id", "prob"))
        found = front.withColumn("gain", worth(F.col("prob"), F.col("_m"), F.col("_t"))).where(F.col("_t").isNotNull() & (F.col("gain") >= accept))
        # a later path to the same target is a better one, so it replaces the earlier
        both = found.select("head", "id", "first", "prob", "gain").unionByName(best)
        ahead = both.groupBy("head").agg(F.max(F.struct("gain", (-F.col("id")).alias("i"), "prob", (-F.col("first")).alias("f"))).alias("_s"))
        best = kept(ahead.select("head", (-F.col("_s.i")).alias("id"), (-F.col("_s.f")).alias("first"), "_s.prob", "_s.gain"))
    return best
