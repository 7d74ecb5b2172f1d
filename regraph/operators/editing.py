"""Focused proofreading: ranked questions, answers as an event log, undo, and estimates of the work left.

The log, a table events(step, node1, node2, remove), is the state: a session's graph is the base
graph with all answers folded in, so undo is dropping the last event. Ranking is a DataFrame query
over that graph, and only the next question leaves it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import voi_change
from .graph import CONFIRMED, components, contracted, with_sizes
from .heads import head_candidates

#: A large body, bodies too small to gain anything, and the largest 1 - affinity of a path from an orphan (fixed values).
BIG_BODY, SMALL_BODY, ORPHAN_UPPER = 25_000, 1_000, 0.99


@dataclass
class Session:
    """nodes(id, size, boundary_size[, synapses]) and edges(node1, node2, edge_size, weight) under proofreading."""

    nodes: DataFrame
    edges: DataFrame
    mode: str = "edge"
    lower: float = 0.0
    upper: float = 0.9
    start: float = 0.0
    ignore_size: float = 1
    hops: int = 3
    big: float = BIG_BODY
    small: float = SMALL_BODY
    events: list[tuple[int, int, bool]] = field(default_factory=list)

    def set_edge_mode(self, lower: float, upper: float, start: float, ignore_size: float = 1) -> None:
        if not 0 <= lower <= start <= upper <= 1:
            raise ValueError("0 <= lower <= start <= upper <= 1 is needed")
        self.mode, self.lower, self.upper, self.start, self.ignore_size = "edge", lower, upper, start, ignore_size

    def set_body_mode(self, ignore_size: float, hops: int = 3, upper: float = 0.9, big: float = BIG_BODY, small: float = SMALL_BODY) -> None:
        """Heads are bodies of at least ignore_size; a question counts if it could gain as much as a body of size `big` with one of ignore_size.

        Bodies smaller than `small` gain nothing.
        """
        self.mode, self.ignore_size, self.hops, self.upper, self.big, self.small = "body", ignore_size, hops, upper, big, small

    def set_synapse_mode(self, ignore_size: float, hops: int = 0, upper: float = 0.9) -> None:
        """As body mode by numbers of synapses; a question counts if it could gain as much as two bodies of ignore_size synapses. hops=0: any."""
        self.mode, self.ignore_size, self.hops, self.upper = "synapse", ignore_size, hops, upper

    def set_orphan_mode(self, ignore_size: float, hops: int = 0, upper: float = ORPHAN_UPPER) -> None:
        """Heads are bodies without boundary that have synapses or are of at least ignore_size; asked is the way to the boundary."""
        self.mode, self.ignore_size, self.hops, self.upper = "orphan", ignore_size, hops, upper

    def set_result(self, node1: int, node2: int, remove: bool) -> None:
        """remove=True takes the boundary away (merges); False confirms it."""
        self.events.append((min(node1, node2), max(node1, node2), remove))

    def undo(self) -> bool:
        """Take the last answer back; False if there is none."""
        if not self.events:
            return False
        self.events.pop()
        return True

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) with every answer applied."""
        if not self.events:
            return self.nodes, self.edges
        spark = self.nodes.sparkSession
        log = spark.createDataFrame(self.events, "node1 long, node2 long, remove boolean")  # one row an answer
        edges = self.edges.join(log.where("not remove").select("node1", "node2", F.lit(True).alias("_no")), ["node1", "node2"], "left")
        edges = edges.withColumn("weight", F.when(F.col("_no"), CONFIRMED).otherwise(F.col("weight"))).drop("_no")
        yes = log.where("remove").select("node1", "node2")
        if not any(r for *_, r in self.events):
            return self.nodes, edges
        return contracted(self.nodes, edges, components(yes))

    def heads(self) -> DataFrame:
        """(head, mass, id, first, prob, gain): each head's best candidate in body, synapse and orphan mode, at most one row a head."""
        nodes, edges = self.graph()
        synapses = F.coalesce(F.col("synapses"), F.lit(0)) if "synapses" in nodes.columns else F.lit(0)
        if self.mode == "orphan":
            heads = nodes.where((F.coalesce("boundary_size", F.lit(0)) == 0) & ((synapses > 0) | (F.col("size") >= self.ignore_size))).select("id", F.col("size").alias("mass"))
            targets = nodes.where("boundary_size > 0").select("id", F.lit(1.0).alias("mass"))
            gain, accept = (lambda p, a, b: p * b), 0.0
        else:
            bodies = nodes.select("id", (synapses if self.mode == "synapse" else F.col("size")).cast("double").alias("mass")).where("mass > 0")
            total = float(bodies.agg(F.sum("mass")).first()[0] or 1)
            one, small = (self.ignore_size, 0.0) if self.mode == "synapse" else (self.big, self.small)
            heads = bodies if self.mode == "synapse" else bodies.where(F.col("mass") >= self.ignore_size)
            targets = bodies.where(F.col("mass") >= small)
            change = lambda a, b: voi_change(a, b, total)
            gain, accept = (lambda p, a, b: p * change(a, b)), float(nodes.sparkSession.range(1).select(change(F.lit(float(one)), F.lit(float(self.ignore_size)))).first()[0])
        found = head_candidates(edges, heads, targets, gain, 1 - self.upper, self.hops or None, round(accept, 15), preserve=self.mode != "orphan")
        return heads.select(F.col("id").alias("head"), "mass").join(found, "head")

    def ranked(self) -> DataFrame:
        """(node1, node2, rank_value) of the open questions, best first by ascending rank_value; at most one a head, largest heads first."""
        if self.mode == "edge":
            nodes, edges = self.graph()
            big = nodes.where(F.col("size") > self.ignore_size)
            rows = with_sizes(edges.where((F.col("weight") <= 1) & F.col("weight").between(self.lower, self.upper)), big)
            return rows.select("node1", "node2", F.abs(F.col("weight") - self.start).alias("rank_value"))
        rows = self.heads()
        pairs = rows.select(F.least("head", "first").alias("node1"), F.greatest("head", "first").alias("node2"), (-F.col("mass").cast("double")).alias("rank_value"))
        return pairs.groupBy("node1", "node2").agg(F.min("rank_value").alias("rank_value"))

    def next_edge(self) -> tuple[int, int] | None:
        best = self.ranked().orderBy("rank_value", "node1", "node2").first()
        return (best["node1"], best["node2"]) if best else None

    def remaining(self) -> int:
        return self.ranked().count()

    def finished(self) -> bool:
        return self.next_edge() is None

    def qa_violators(self, threshold: float) -> DataFrame:
        """(id): bodies that touch no boundary and hold synapses or are large."""
        nodes, _ = self.graph()
        syn = F.coalesce(F.col("synapses"), F.lit(0)) if "synapses" in nodes.columns else F.lit(0)
        return nodes.where((F.col("boundary_size") == 0) & ((syn > 0) | (F.col("size") >= threshold))).select("id")

    def estimated_work(self, seed: int = 1) -> int:
        """Questions if every edge is answered by its weight at random: merges that others imply are not asked."""
        _, edges = self.graph()
        rows = self.ranked().join(edges.select("node1", "node2", "weight"), ["node1", "node2"])
        merge = F.pmod(F.xxhash64("node1", "node2", F.lit(seed)), F.lit(100)) > (F.col("weight") * 100).cast("int")
        rows = rows.withColumn("merge", merge)
        yes = rows.where("merge")
        forest = components(yes).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("new").alias("r")).first()
        return rows.where("not merge").count() + forest["n"] - forest["r"]
