"""Feature states that merge by addition, and the feature vectors read from them.

A state has a size, sums of powers and histogram counts, as two arrays laid out by a `FeatureSet`:

    size long, sums array<double>   four powers a channel
               hist array<long>     for each channel and each number of bins: bins + 1 counts

States of parts of a region, of blocks of a volume or of merged regions add up element by element, in
one aggregate that Spark combines before its shuffle. Moving states is a relabelling of their keys,
removing them an anti join; both leave states as they are.

Values are expected in [0, 1]; the last histogram slot takes the value 1 and is read as part of the
last bin. Values outside are counted at the ends of the histogram. Null and NaN values count as 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import moments

POWERS = 4
NODE, EDGE, DIFF = 0, 1, 2

#: Bins and thresholds of the basic set (fixed values).
BASIC_BINS, BASIC_THRESHOLDS = 25, (0.1, 0.3, 0.5, 0.7, 0.9)


@dataclass(frozen=True)
class Feature:
    """One feature of a channel: count, moments (how many) or hist (bins, thresholds); modes: for nodes, for edges, as difference."""

    kind: str
    many: int = 0
    thresholds: tuple[float, ...] = ()
    modes: tuple[bool, bool, bool] = (True, True, True)
    first_only: bool = False


@dataclass(frozen=True)
class FeatureSet:
    """Channels and their features, in order. Channels are added first; each call returns a new set."""

    channels: tuple[str, ...]
    features: tuple[Feature, ...] = ()

    def add_channel(self, name: str) -> FeatureSet:
        if self.features:
            raise ValueError("channels are added before features")
        return replace(self, channels=(*self.channels, name))

    def _with(self, *features: Feature) -> FeatureSet:
        return replace(self, features=(*self.features, *features))

    def add_moments(self, many: int = POWERS, diff: bool = True) -> FeatureSet:
        """The count, once, and the first `many` moments of each channel."""
        if not 1 <= many <= POWERS:
            raise ValueError("1 to 4 moments")
        modes = (True, True, diff)
        return self._with(Feature("count", modes=modes, first_only=True), Feature("moments", many, modes=modes))

    def add_hist(self, bins: int, thresholds, diff: bool = False) -> FeatureSet:
        """Percentiles read from a histogram; they have no difference feature."""
        return self._with(Feature("hist", bins, tuple(thresholds), (True, True, diff)))

    def add_median(self) -> FeatureSet:
        """The median of an edge; of one channel only."""
        if len(self.channels) != 1:
            raise ValueError("the median is for one channel")
        return self._with(Feature("hist", 100, (0.5,), (False, True, False)))

    @property
    def bins(self) -> list[int]:
        """The histograms of a channel's state, by number of bins."""
        return sorted({f.many for f in self.features if f.kind == "hist"})

    @property
    def width(self) -> tuple[int, int]:
        """Lengths of sums and hist."""
        return POWERS * len(self.channels), len(self.channels) * sum(b + 1 for b in self.bins)


def basic(channels: tuple[str, ...]) -> FeatureSet:
    """Four moments with differences, five percentiles of 25 bins without."""
    return FeatureSet(tuple(channels)).add_moments(4, True).add_hist(BASIC_BINS, BASIC_THRESHOLDS, False)


def merged_states(rows: DataFrame, keys: list[str], features: FeatureSet) -> DataFrame:
    """rows(keys, size, sums, hist, further counts) with the states of equal keys added up."""
    plain = [c for c in rows.columns if c not in (*keys, "sums", "hist")]
    cells = [(c, i) for c, n in zip(("sums", "hist"), features.width) for i in range(n)]
    flat = rows.select(*keys, *plain, *(F.col(c)[i].alias(f"{c}{i}") for c, i in cells))
    out = flat.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in plain), *(F.sum(f"{c}{i}").alias(f"{c}{i}") for c, i in cells))
    pack = lambda c, n, kind: F.array(*(F.col(f"{c}{i}") for i in range(n))).cast(f"array<{kind}>").alias(c)
    return out.select(*keys, *plain, pack("sums", features.width[0], "double"), pack("hist", features.width[1], "long"))


def percentile(counts: str, bins: int, threshold: float) -> Column:
    """Interpolated in the first of `bins` counts whose running sum reaches the share of the size; 0 of an empty state."""
    need = f"{threshold}D * size"
    value = f"if(s.value is null and k > 0 and s.before + k >= {need}, (s.bin + try_divide({need} - s.before, k)) / {bins}, s.value)"
    start = "struct(0L as before, 0 as bin, cast(null as double) as value)"
    return F.expr(f"coalesce(aggregate({counts}, {start}, (s, k) -> struct(s.before + k as before, s.bin + 1 as bin, {value} as value), s -> s.value), 0D)")


def values(features: FeatureSet, channel: int, feature: Feature) -> list[Column]:
    """The values of one feature from a state's columns."""
    size, sums = F.col("size"), F.col("sums")
    if feature.kind == "count":
        return [size.cast("double")]
    if feature.kind == "moments":
        at = POWERS * channel
        n = F.when(size > 0, size.cast("double"))
        return [F.coalesce(m, F.lit(0.0)) for m in moments(n, [sums[at + k] for k in range(POWERS)])[: feature.many]]
    b = feature.many
    at = channel * sum(x + 1 for x in features.bins) + sum(x + 1 for x in features.bins if x < b)
    counts = f"concat(slice(hist, {at + 1}, {b - 1}), array(hist[{at + b - 1}] + hist[{at + b}]))"
    return [percentile(counts, b, t) for t in feature.thresholds]


def vector(features: FeatureSet, mode: int, by_mode: bool = False) -> Column:
    """The features of a state as an array, channel by channel; with by_mode, feature by feature and only those with the mode."""
    pairs = [(c, f) for c in range(len(features.channels)) for f in features.features]
    if by_mode:
        pairs = [(c, f) for f in features.features for c in range(len(features.channels)) if f.modes[mode]]
    cols = [v for c, f in pairs if not (f.first_only and c) for v in values(features, c, f)]
    return F.array(*cols).cast("array<double>")


def edge_vectors(nodes: DataFrame, edges: DataFrame, features: FeatureSet, by_mode: bool = False) -> DataFrame:
    """(node1, node2, features) of states nodes(id, ...) and edges(node1, node2, ...): smaller node, larger node, edge, differences.

    Of nodes of equal size node1 comes first; differences are absolute, percentiles have none. A
    node's values are read once, before its edges are joined. Six channels of the basic set give 190 values.
    """
    apart = replace(features, features=tuple(f for f in features.features if f.kind != "hist"))
    own = nodes.select("id", F.struct("size", vector(features, NODE, by_mode).alias("v"), vector(apart, DIFF, by_mode).alias("d")).alias("_s"))
    both = edges.select("node1", "node2", vector(features, EDGE, by_mode).alias("_e"))
    both = both.join(own.toDF("node1", "_a"), "node1").join(own.toDF("node2", "_b"), "node2")
    swap = F.col("_a.size") > F.col("_b.size")
    ends = [F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in (("_b.v", "_a.v"), ("_a.v", "_b.v"))]
    return both.select("node1", "node2", F.concat(*ends, "_e", F.zip_with("_a.d", "_b.d", lambda x, y: F.abs(x - y))).alias("features"))
