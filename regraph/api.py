"""The toolkit's calls, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.states import FeatureSet, basic, edge_vectors, merged_states
from .operators.agglomeration import scored_agglomeration
from .operators.blocks import region_states
from .operators.graph import relabelled, traced_paths
from .operators.inclusions import inclusions
from .operators.learning import edge_features, fit_classifier, scored_edges, training_set
from .operators.overlap import assignment, contingency
from .operators.passes import mito_merged
from .operators.rag import mito_nodes, rag_edges, rag_nodes
from .operators.tables import kept


def find_overlaps(one: DataFrame, two: DataFrame) -> DataFrame:
    """(seg, gt, count) of two label volumes(x, y, z, label)."""
    both = one.select("x", "y", "z", F.col("label").alias("seg")).join(two.select("x", "y", "z", F.col("label").alias("gt")), ["x", "y", "z"])
    return contingency(both)


def agglomerate(voxels: DataFrame, channels: tuple[str, ...], model, threshold: float, label: str = "seg", mito_channel: str | None = None, features: FeatureSet | None = None) -> DataFrame:
    """voxels with labels merged: inclusions go, edges are merged up to the threshold of the model's weight, inclusions go again.

    Merged regions carry their feature states on, and the model scores their edges anew. With a
    mito_channel, mitochondria (told from the regions at the start) take no part, and merge into
    their neighbours at the end.
    """
    features = features or basic(channels)
    # an enclosed region reads as its encloser from the start, so features are those of the merged regions
    first = region_states(voxels, FeatureSet(()), label)
    voxels = relabelled(voxels, kept(inclusions(*first)), label)
    nodes, edges = region_states(voxels, features, label)
    mito = mito_nodes(voxels, mito_channel, label=label).where("mito_type = 2").select("id") if mito_channel else None

    def score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return scored_edges(model, edge_vectors(nodes, edges, features))

    def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
        return merged_states(rows, keys, features)

    nodes, edges, mapping = scored_agglomeration(nodes, edges, threshold, score, merge, mito)
    voxels = relabelled(relabelled(voxels, mapping, label), kept(inclusions(nodes, edges)), label)
    if mito_channel is None:
        return voxels
    nodes = rag_nodes(voxels, (), label).join(mito_nodes(voxels, mito_channel, label=label).select("id", "mito_type"), "id")
    return relabelled(voxels, mito_merged(nodes, rag_edges(voxels, (), label)), label)


def learn(voxels: DataFrame, channels: tuple[str, ...], mito_channel: str | None = None, **options):
    """A classifier of the edges of voxels(x, y, z, seg, gt, channels)."""
    gt = assignment(contingency(voxels)).select("seg", "gt")
    mito = mito_nodes(voxels, mito_channel) if mito_channel else None
    return fit_classifier(training_set(edge_features(voxels, channels), gt, mito), **options)


def find_close_bodies(edges: DataFrame, body: int, hops: int | None, least: float) -> DataFrame:
    """(head, id, hops, prob) of the bodies that best paths of at most `hops` edges (None: any number) reach from one.

    hops holds the bodies in between, the one next to id first; it is empty for neighbours. A body
    without edges gives no rows.
    """
    return _with_hops(traced_paths(edges, edges.sparkSession.createDataFrame([(body,)], "id long"), least, hops))


def find_important_paths(edges: DataFrame, bodies: DataFrame, hops: int | None = 3, least: float = 0.1) -> DataFrame:
    """(head, id, hops, prob) of find_close_bodies for all pairs head < id of bodies(id); ids that repeat or are null count once or not."""
    ids = bodies.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    return _with_hops(traced_paths(edges, ids, least, hops).where("head < id").join(ids, "id", "left_semi"))


def _with_hops(paths: DataFrame) -> DataFrame:
    return paths.select("head", "id", F.expr("reverse(slice(path, 2, size(path) - 2))").alias("hops"), "prob")
