"""Region graphs as two tables, nodes(id, size, ...) and edges(node1, node2, edge_size, weight, ...).

Weight is the probability that an edge is a true boundary: low means merge. node1 < node2. A weight
over 1 marks a confirmed boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept, running_before

CONFIRMED = 1.2


def canonical(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"node1": F.least("node1", "node2"), "node2": F.greatest("node1", "node2")})


def endpoints(edges: DataFrame, *cols: str) -> DataFrame:
    """(id, other, *cols): each edge from both ends."""
    return edges.select(F.col("node1").alias("id"), F.col("node2").alias("other"), *cols).unionAll(edges.select(F.col("node2").alias("id"), F.col("node1").alias("other"), *cols))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, border): incident edges, and the sizes of those that are not false plus the node's open boundary."""
    true = ~F.col("false_edge") if "false_edge" in edges.columns else F.lit(True)
    near = endpoints(edges.withColumn("_e", F.when(true, F.col("edge_size"))), "_e").groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("_e").alias("_s"))
    return nodes.join(near, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("_s", F.lit(0)) + F.col("boundary_size")).alias("border"))


def with_sizes(edges: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    one = nodes.select(F.col("id").alias("node1"), F.col("size").alias("size1"))
    two = nodes.select(F.col("id").alias("node2"), F.col("size").alias("size2"))
    return dealt(dealt(edges, tasks, "node1").join(one, "node1"), tasks, "node2").join(two, "node2")


def valid_edge(synapse_mode: bool = False, size: Column | None = None) -> Column:
    """Edges open to merging: not preserved and not false; in synapse mode only small preserved ones stay out."""
    if synapse_mode:
        return ~F.col("false_edge") & ~((F.col("edge_size") < 625) & F.col("preserve"))
    return ~F.col("preserve") & ~F.col("false_edge")


def dealt(df: DataFrame, tasks: int | None, *cols: str) -> DataFrame:
    """df by cols in that many tasks, which bounds what a task holds; with None Spark settles their number."""
    return df if tasks is None else df.repartition(tasks, *cols)


def constrained(edges: DataFrame, constraints: DataFrame, tasks: int | None = None) -> DataFrame:
    """edges with preserve, false_edge: constraints(node1, node2) preserve an edge or add a false one of weight 1."""
    asked = canonical(constraints).select("node1", "node2").where("node1 != node2 and node1 != 0").distinct().withColumn("_c", F.lit(True))
    both = dealt(edges, tasks, "node1", "node2").join(dealt(asked, tasks, "node1", "node2"), ["node1", "node2"], "full")
    new = F.col("edge_size").isNull()
    return both.select("node1", "node2", F.coalesce("edge_size", F.lit(0)).alias("edge_size"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("_c", F.lit(False)).alias("preserve"), new.alias("false_edge"))


def relabelled(df: DataFrame, mapping: DataFrame, *cols: str, tasks: int | None = None) -> DataFrame:
    """df with each of cols sent through mapping(old, new); ids without an entry stay."""
    for c in cols:
        m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        df = dealt(df, tasks, c).join(m, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return df


def contracted(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, weight: str = "low", tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph after merging nodes by mapping(old, new).

    Sizes add, preserve is OR, false_edge is AND. weight "low" takes the smallest weight unless one
    is over 1 (then the largest); "zero" resets it, as where a classifier scores merged edges anew.
    """
    merged_nodes = relabelled(nodes, mapping, "id").groupBy("id").agg(*[F.sum(c).alias(c) for c in nodes.columns if c != "id"])
    moved = dealt(canonical(relabelled(edges, mapping, "node1", "node2", tasks=tasks)).where("node1 != node2"), tasks, "node1", "node2")
    low = F.when(F.max("weight") > 1, F.max("weight")).otherwise(F.min("weight")) if weight == "low" else F.when(F.count(F.lit(1)) > 1, F.lit(0.0)).otherwise(F.max("weight"))
    how = {"edge_size": F.sum("edge_size"), "weight": low, "preserve": F.bool_or("preserve"), "false_edge": F.bool_and("false_edge")}
    return merged_nodes, moved.groupBy("node1", "node2").agg(*[how.get(c, F.sum(c)).alias(c) for c in edges.columns if c not in ("node1", "node2")])


def components(edges: DataFrame) -> DataFrame:
    """mapping(old, new) of every endpoint to the smallest id it is connected with.

    Each round takes the smallest label among a node's neighbours and then its label's label
    (pointer jumping), so rounds grow with the logarithm of a component's diameter; a hot node is
    combined before its shuffle. Labels are joined by exchanges, not broadcast: they grow with the graph.
    """
    near = kept(endpoints(edges).select("id", "other").distinct())
    label = kept(near.groupBy("id").agg(F.min("other").alias("_m")).select("id", F.least("id", "_m").alias("label")))
    while True:
        other = label.select(F.col("id").alias("other"), F.col("label").alias("_l"))
        least = near.join(other.hint("merge"), "other").groupBy("id").agg(F.min("_l").alias("_m"))
        step = label.join(least.hint("merge"), "id").select("id", "label", F.least("label", "_m").alias("new"))
        roots = label.select(F.col("id").alias("new"), F.col("label").alias("_up"))
        new = kept(step.join(roots.hint("merge"), "new", "left").select("id", "label", F.least("new", F.coalesce("_up", "new")).alias("new")))
        if not new.where("label != new").limit(1).count():
            return new.select(F.col("id").alias("old"), F.col("new").alias("new"))
        label = new.select("id", F.col("new").alias("label"))


def flat_merge(edges: DataFrame, threshold: float) -> DataFrame:
    """mapping(old, new) that merges all edges of weight <= threshold at once."""
    return components(edges.where(F.col("weight") <= threshold))


def best_paths(edges: DataFrame, heads: DataFrame | None, least: float, hops: int | None, affinity: Column | None = None) -> DataFrame:
    """(head, id, prob): the largest product of affinities over paths of at most `hops` edges (None: of any length), at least `least`.

    A frontier join a round: only improved pairs move on, until none is left. Affinity is 1 - weight unless given.
    """
    p = affinity if affinity is not None else 1 - F.col("weight")
    near = kept(endpoints(edges.withColumn("_p", p), "_p").where("_p > 0.000001"))
    if heads is not None:
        start = near.join(heads.select("id"), "id", "left_semi")
    else:
        start = near
    best = kept(start.where(F.col("_p") >= least).select(F.col("id").alias("head"), F.col("other").alias("id"), F.col("_p").alias("prob")))
    front = best
    done = 1
    while hops is None or done < hops:
        done += 1
        step = front.join(near, "id").select("head", F.col("other").alias("id"), (F.col("prob") * F.col("_p")).alias("prob")).where((F.col("prob") >= least) & (F.col("head") != F.col("id")))
        step = step.groupBy("head", "id").agg(F.max("prob").alias("prob"))
        old = best.select("head", "id", F.col("prob").alias("_old"))
        front = kept(step.join(old, ["head", "id"], "left").where("_old is null or prob > _old + 1e-12").select("head", "id", "prob"))
        if not front.limit(1).count():
            break
        best = kept(best.unionByName(front).groupBy("head", "id").agg(F.max("prob").alias("prob")))
    return best


def graph_uncertainty(nodes: DataFrame, edges: DataFrame, hops: int | None = None, least: float = 0.01) -> DataFrame:
    """One row: the global certainty of all pairs' best paths, with weight itself as the affinity."""
    paths = best_paths(edges, None, least, hops, F.least(F.col("weight"), F.lit(1.0))).where("head < id")
    a = nodes.select(F.col("id").alias("head"), F.col("size").cast("double").alias("s1"))
    b = nodes.select("id", F.col("size").cast("double").alias("s2"))
    pairs = paths.join(a, "head").join(b, "id").withColumn("area", F.col("s1") * F.col("s2"))
    sums = pairs.agg(F.coalesce(F.sum(F.col("area") * F.col("prob")), F.lit(0.0)).alias("rp"), F.coalesce(F.sum(F.col("area") * F.col("prob") * (1 - F.col("prob"))), F.lit(0.0)).alias("loss"))
    own = nodes.agg(F.sum(F.col("size").cast("double") * (F.col("size") - 1) / 2).alias("base"), F.sum(F.col("size").cast("double")).alias("total"))
    most = F.col("base") + F.col("rp")
    chance = most * most / (F.col("total") * (F.col("total") - 1) / 2)
    return sums.join(own).select(F.round(((most - F.col("loss")) - chance) / (most - chance) * 100, 6).alias("certainty"))  # two single rows


def coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, color): greedy colours by ascending id, in rounds of nodes whose smaller neighbours are all coloured."""
    before = kept(edges.select(F.col("node2").alias("id"), F.col("node1").alias("_n")))
    done = kept(nodes.select("id").join(before, "id", "left_anti").withColumn("color", F.lit(0)))
    open_ = kept(nodes.select("id").join(before.select("id").distinct(), "id", "left_semi"))
    while open_.limit(1).count():
        seen = before.join(open_, "id").join(done.select(F.col("id").alias("_n"), "color"), "_n", "left")
        ready = seen.groupBy("id").agg(F.count(F.when(F.col("color").isNull(), 1)).alias("_w"), F.collect_set("color").alias("_used")).where("_w = 0")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("_used")), F.col("_used")))
        new = kept(ready.select("id", free.cast("int").alias("color")))
        done = kept(done.unionByName(new))
        open_ = kept(open_.join(new, "id", "left_anti"))
    return done


def uncertainty_histogram(edges: DataFrame, same: str = "same") -> DataFrame:
    """(bin, merges, splits, cumulative_splits) over 101 bins of weight."""
    at = (F.floor(F.col("weight") * 100 + 0.5) % 101).cast("int")
    bins = edges.groupBy(at.alias("bin")).agg(F.sum(F.when(F.col(same), 1).otherwise(0)).alias("merges"), F.sum(F.when(F.col(same), 0).otherwise(1)).alias("splits"))
    return bins.withColumn("cumulative_splits", F.sum("splits").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # 101 rows


def budgeted(rows: DataFrame, value: str, budget: float) -> DataFrame:
    """Bodies in descending value until the sum of those before exceeds the budget."""
    return running_before(rows, value, F.desc(value), F.col("id")).where(F.col("before") <= budget)


def uncertainty_distribution(edges: DataFrame, same: str = "same") -> DataFrame:
    """(bin, merges, splits, cumulative_splits, cumulative_ideal) of all 101 bins of weight, empty ones too.

    The ideal is the number of splits that weights which are true probabilities would give: each edge of bin i counts i / 100.
    """
    at = (F.floor(F.col("weight") * 100 + 0.5) % 101).cast("int")
    bins = edges.groupBy(at.alias("bin")).agg(F.count_if(F.col(same)).alias("merges"), F.count_if(~F.col(same)).alias("splits"))
    every = edges.sparkSession.range(101).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").na.fill(0)
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 101 rows
    ideal = F.sum((F.col("merges") + F.col("splits")) * F.col("bin") / F.lit(100.0)).over(w)
    return every.select("bin", "merges", "splits", F.sum("splits").over(w).alias("cumulative_splits"), ideal.alias("cumulative_ideal"))


def traced_paths(edges: DataFrame, heads: DataFrame, least: float, hops: int | None = None, affinity: Column | None = None) -> DataFrame:
    """(head, id, prob, path): best_paths with the nodes of each path, from head to id.

    Of equal products the path of fewest edges stays, then the one whose nodes are greatest in order.
    A head reaches itself by no path; heads without edges give no rows.
    """
    p = affinity if affinity is not None else 1 - F.col("weight")
    near = kept(endpoints(edges.withColumn("_p", p), "_p").where("_p > 0.000001"))
    first = near.join(heads.select("id").distinct(), "id", "left_semi").where(F.col("_p") >= least)
    best = front = kept(first.select(F.col("id").alias("head"), F.col("other").alias("id"), F.col("_p").alias("prob"), F.array("id", "other").alias("path")))
    done = 1
    while hops is None or done < hops:
        done += 1
        step = front.join(near, "id").where(F.col("head") != F.col("other")).select("head", F.col("other").alias("id"), (F.col("prob") * F.col("_p")).alias("prob"), F.concat("path", F.array("other")).alias("path"))
        step = step.where(F.col("prob") >= least).groupBy("head", "id").agg(F.max(F.struct("prob", "path")).alias("_s")).select("head", "id", "_s.*")
        old = best.select("head", "id", F.col("prob").alias("_old"))
        front = kept(step.join(old, ["head", "id"], "left").where("_old is null or prob > _old + 1e-12").select("head", "id", "prob", "path"))
        if front.isEmpty():
            break
        best = kept(best.join(front, ["head", "id"], "left_anti").unionByName(front))
    return best


def path_affinity(edges: DataFrame, pairs: DataFrame, least: float = 0.01, hops: int | None = None) -> DataFrame:
    """(head, id, prob) of pairs(head, id): the best path's product of affinities; 0 where no path reaches `least`."""
    asked = pairs.select("head", "id").distinct()
    found = best_paths(edges, asked.select(F.col("head").alias("id")).distinct(), least, hops)
    return asked.join(found, ["head", "id"], "left").na.fill(0.0, ["prob"])


def neighbourhood(edges: DataFrame, bodies: DataFrame, tasks: int | None = None) -> DataFrame:
    """The edges that touch one of bodies(id) at either end, each once."""
    ids = bodies.select("id").distinct()
    marks = [ids.select(F.col("id").alias(n), F.lit(True).alias(f"_{n}")) for n in ("node1", "node2")]
    return dealt(dealt(edges, tasks, "node1").join(marks[0], "node1", "left"), tasks, "node2").join(marks[1], "node2", "left").where("_node1 or _node2").select(*edges.columns)


def plane_weights(edges: DataFrame, span: int = 200_000) -> DataFrame:
    """edges between ids composed by plane: weight -1 where both ends are one label of two planes."""
    return edges.withColumn("weight", F.when(F.col("node1") % span == F.col("node2") % span, F.lit(-1.0)).otherwise(F.col("weight")))


def located(edges: DataFrame, locations: DataFrame) -> DataFrame:
    """edges with x, y, z of locations(node1, node2, x, y, z); edges without one, as false ones are, get (0, 0, 0)."""
    at = locations.select("node1", "node2", "x", "y", "z")
    return edges.drop("x", "y", "z").join(at, ["node1", "node2"], "left").na.fill(0, ["x", "y", "z"])


def emitted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a size: what is written when features are handed on."""
    return nodes.where("size > 0"), edges.where("edge_size > 0")
