"""MinHash near-dedup with Order MinHash sketches and banded alignment.

Each text is the sequence of its k-mers of KMER words, labelled by occurrence (the second mention of
a k-mer is another element than the first). Sketch j takes the PICKED labelled k-mers that are
smallest under hash j and hashes them *in text order*, so equal sketches speak for similar order,
not just for similar sets. Two texts that share one of SKETCHES sketches are candidates: at a
similarity of 0.8 a pair is missed with a probability below 2e-5.

That holds of texts of more than SHORT k-mers only; short ones have too few subsets of PICKED. Pairs
with a text of at most SHORT are found without loss: each of two similar texts of n k-mers holds all
but 0.2 n of its own in the other, so their smallest floor(0.2 n) + 1 share one. These are buckets of
all texts of at most SHORT / 0.8 k-mers, which a text similar to a short one cannot exceed.

Candidates are verified by banded alignment. As labelled k-mers are distinct within a text, the
longest common subsequence of two texts is a longest increasing run of matched positions; matches
off the band that 0.8 allows (insertions plus deletions) are left out first. The similarity is
L / (n + m - L).

Texts that share buckets, directly or through others, are one candidate group; no link leads out of it. A group of at most
LOCAL k-mers is solved in one task, small groups share one: with the group's k-mers ordered from the rarest to the most
common, two similar texts share one of the first 0.2 n + 1 of each, so all their pairs come up, in one pass and whatever their
buckets; a pair whose texts are of one class already is not aligned. What follows is for larger groups, which take rounds.

No large group is ever paired with itself, and no link of a bucket is lost. Texts of equal words are
one text. Buckets with at most FEW members outside their largest component, or PAIRS pairs, give
all pairs across components, which is linear; pairs whose counts of k-mers by slot already differ too
much are not aligned. In another bucket a leader L is compared with all others, also linear: first the
text that shares most buckets with others, which tends to be the one that the group varies, later the
member that adds least to the leader before. As what follows holds of any L, be it in the bucket or not,
the first buckets take the leader that most of their members have elsewhere: a group has few leaders,
and few rows of a leader and a member, however many buckets it has. If many members stay outside, let x miss m(x) k-mers of L
and hold i(x) further ones, I(x). Two members x and y that are not both linked with L can reach the
similarity only if they differ in at most (n(x) + n(y)) / 9 k-mers; they differ in at least
i(x) + i(y) - 2 |I(x) & I(y)| + |m(x) - m(y)|. So either
  (a) they share a k-mer of I(x) and I(y), even one among the smallest 0.2 n + 1 of each, since each
      holds 0.8 of the other: (L, k-mer) is a bucket of the next round; or
  (b) i(x) + i(y) + |m(x) - m(y)| <= (n(x) + n(y)) / 9: such pairs are found by joining the distinct
      triples (i, m, n) of L's members, and compared.
(a) and (b) hold of any two members that L ever led, so its rows are kept, and a round takes up only
leaders with new members and only buckets that hold one of these and several components. Every round
needs a new pair, and rounds end when there is none. Nothing is capped. Tables of rounds are added to
and never rewritten; links are contracted to the components so far before large-star and small-star
rounds join them; every round ends in a written table.

Nulls, ties, odd input: null and empty texts are one class; texts shorter than a k-mer are a single
element, so they match equal texts only; a null doc_id forms rows of the class but never its name
unless all are null; repeated rows are copies; a doc_id with several texts puts these into one class
and is compared by one of them; very long texts are read whole, a few megabytes of text at a time;
further columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, text_slices, unused, word_hashes, words_of, written

KMER, SIMILARITY, SKETCHES, PICKED, SHORT = 5, 0.8, 40, 6, 40
FEW, PAIRS, SLOTS, WORDS = 8, 2048, 128, 1024

#: Labelled k-mers of a candidate group that is solved in one task (a text counts as LEAST_KMERS at least), and of small groups
#: that share a task; k-mers that are counted by bits.
LOCAL, LEAST_KMERS, SHARED, BITS = 4_000_000, 80, 200_000, 1024
_random = np.random.default_rng(7)
XOR, TIMES = (_random.integers(0, 2**63, (SKETCHES, 1), np.uint64) for _ in range(2))
TIMES |= np.uint64(1)


def kmers_of(texts: pa.Array):
    """For each text its hashed words and its labelled k-mers, both as 64-bit arrays."""
    offsets, codes, vocabulary = words_of(texts)
    word = word_hashes(vocabulary, 2)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(offsets)
    rolled = np.zeros(max(0, len(word) - KMER + 1), np.uint64)
    for j in range(KMER):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + word[j : len(word) - KMER + 1 + j]
    rolled = mix64(rolled)
    for a, n in zip(offsets[:-1].tolist(), count.tolist()):
        own = word[a : a + n]
        if n < KMER:
            yield own, mix64(np.array([mix64(own + np.arange(1, n + 1, dtype=np.uint64)).sum(dtype=np.uint64)], np.uint64))
            continue
        x = rolled[a : a + n - KMER + 1]
        order = np.argsort(x, kind="stable")
        s = x[order]
        again = s[1:] == s[:-1]
        if again.any():  # label by occurrence
            first = np.flatnonzero(np.concatenate([[True], ~again]))
            turn = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
            x = x.copy()
            x[order] = np.where(turn > 0, mix64(s + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), s)
        yield own, x


def sketch(x: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the PICKED smallest labelled k-mers in text order."""
    parts = [(x ^ XOR[a : a + 8]) * TIMES[a : a + 8] for a in range(0, SKETCHES, 8)] if len(x) > 100_000 else [(x ^ XOR) * TIMES]
    out = []
    for y in parts:
        if len(x) > PICKED:
            at = np.sort(np.argpartition(y, PICKED - 1, axis=1)[:, :PICKED], axis=1)
        else:
            at = np.broadcast_to(np.arange(len(x)), (len(y), len(x)))
        total = np.zeros(len(y), np.uint64)
        for i in range(at.shape[1]):
            total = total * np.uint64(0x9E3779B97F4A7C15) + x[at[:, i]]
        out.append(mix64(total))
    return np.concatenate(out)


def keys_of(x: np.ndarray, least: float) -> np.ndarray:
    """The smallest labelled k-mers, as many as any text that x is linked with must share one of."""
    return np.sort(x)[: int((1 - least) * len(x) + 1e-9) + 1]


def buckets_of(x: np.ndarray, least: float) -> np.ndarray:
    """The buckets of a text: its sketches by band, its smallest k-mers where it can be linked with a short text, or both."""
    parts = []
    if len(x) > SHORT:
        parts.append(mix64(sketch(x) + np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    if len(x) * least <= SHORT + 1e-9:
        parts.append(keys_of(x, least))
    return np.concatenate(parts)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (n + m - L) for the longest common subsequence L inside the band; 0 where it cannot reach least."""
    n, m = len(a), len(b)
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    if abs(n - m) > band:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if len(i) < least / (1 + least) * (n + m) - 1e-9:
        return 0.0
    tails: list[int] = []
    for p in j[np.argsort(i)].tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails) / (n + m - len(tails))


def sketched(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, digest, kmers, buckets) of every document; digest stands for the sequence of words."""
    import hashlib

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                digest, count, rows = [], [], []
                for own, x in kmers_of(part.column("text")):
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    count.append(len(x))
                    rows.append(buckets_of(x, least).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(count, pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "digest", "kmers", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary, kmers int, buckets array<long>")


def fingerprint(x: np.ndarray) -> bytes:
    """How many labelled k-mers fall into each of SLOTS slots, at most 255: enough to bound from below how far two texts differ."""
    return np.bincount((x >> np.uint64(57)).astype(np.int64), minlength=SLOTS).clip(max=255).astype(np.uint8).tobytes()


def kmer_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, size, slots, kmer_bytes) of the documents in ids(rep, digest): labelled k-mers and their fingerprint."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [(len(x), fingerprint(x), x.tobytes()) for _, x in kmers_of(part.column("text"))]
                size, slots, data = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("digest"), pa.array(size, pa.int32()), pa.array(slots, pa.binary()), pa.array(data, pa.binary())], names=["rep", "digest", "size", "slots", "kmer_bytes"])

    one = ids.groupBy("rep").agg(F.min("digest").alias("digest"))
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    rows = rows.join(one, "rep").select("rep", "digest", "text")
    hashed = rows.mapInArrow(run, "rep long, digest binary, size int, slots binary, kmer_bytes binary")
    return hashed.select("rep", "size", "slots", "kmer_bytes").dropDuplicates(["rep"])


def close(pairs: DataFrame, kmers: DataFrame, least: float) -> DataFrame:
    """pairs(a, b, led) without those that are not led and whose fingerprints differ too much for the similarity."""

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS).astype(np.int16) for c in ("left", "right"))
            total = batch.column("total").to_numpy()
            apart = np.abs(left - right).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b", "led"]).filter(pa.array(apart <= (1 - least) / (1 + least) * total + 1e-6))

    slots = kmers.select("rep", "size", "slots")
    out = pairs.where("not led").join(slots.toDF("a", "n", "left"), "a").join(slots.toDF("b", "m", "right"), "b")
    out = out.select("a", "b", "led", "left", "right", (F.col("n") + F.col("m")).alias("total"))
    return pairs.where("led").union(out.mapInArrow(run, "a long, b long, led boolean"))


COMPARED = "a long, b long, led boolean, linked boolean, missing int, more int, size int, keys array<long>"


def compared(pairs: DataFrame, kmers: DataFrame, least: float) -> DataFrame:
    """pairs(a, b, led) with: whether the alignment reaches least; b's k-mers against a's: missing, more, all and keys.

    keys are the smallest k-mers that b has and a lacks, as many as any text b is linked with must share one of.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                more = np.setdiff1d(y, x)
                shared = len(y) - len(more)
                linked = shared >= least / (1 + least) * (len(x) + len(y)) - 1e-6 and aligned(x, y, least) >= least - 1e-9
                rows.append((linked, len(x) - shared, len(more), len(y), more[: int((1 - least) * len(y) + 1e-9) + 1].view(np.int64)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("led"), pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.int32()) for c in cols[1:4]), pa.array(cols[4], pa.list_(pa.int64()))], names=["a", "b", "led", "linked", "missing", "more", "size", "keys"])

    out = pairs.join(kmers.select(F.col("rep").alias("a"), F.col("kmer_bytes").alias("left")), "a")
    out = out.join(kmers.select(F.col("rep").alias("b"), F.col("kmer_bytes").alias("right")), "b").select("a", "b", "led", "left", "right")
    return out.mapInArrow(run, COMPARED)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each id of edges(a, b) is connected with; large-star and small-star rounds."""
    stars, before = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()), None
    while True:
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        stars = written(small)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())


def labelled(df: DataFrame, label: DataFrame | None, col: str, name: str) -> DataFrame:
    """df with the component of col as name; what has no link yet is a component of its own."""
    if label is None:
        return df.withColumn(name, F.col(col))
    return df.join(label.select(F.col("id").alias("_id"), F.col("component").alias("_c")), F.col(col) == F.col("_id"), "left").withColumn(name, F.coalesce("_c", col)).drop("_id", "_c")


def relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """label(id, component) after the links(a, b): only links between two components count, contracted to these."""
    cross = labelled(labelled(links, label, "a", "x"), label, "b", "y").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    cross = written(cross)
    if cross.isEmpty():
        return label
    joined = written(components(cross))
    if label is None:
        return joined
    moved = label.join(joined.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left")
    moved = moved.select("id", F.coalesce("_to", "component").alias("component"))
    return written(moved.union(joined.join(label.select("id"), "id", "left_anti")))


def sized(buckets: DataFrame, least_each: bool = False) -> DataFrame:
    """buckets(bucket, rep, own, rank, fresh) that hold a fresh row and several components, with their lead, largest component and the number outside it.

    The member of the lowest (rank, rep) leads, unless the rows bring a lead. With least_each, buckets of
    the same members count once: they are told by their number and two hashes of 64 bits. The heads are
    written, so that the join's two sides are plain exchanges, which adaptive execution can split.
    """
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    parts = buckets.groupBy("bucket", "own").agg(F.min(F.struct("rank", "rep")).alias("_h"), F.count(F.lit(1)).alias("n"), F.max("fresh").alias("fresh"), *members)
    heads = parts.groupBy("bucket").agg(F.min("_h").alias("_h"), F.sum("n").alias("n"), F.max(F.struct("n", "own")).alias("_m"), F.count(F.lit(1)).alias("parts"), F.max("fresh").alias("fresh"), *(F.bit_xor(f"x{i}").alias(f"x{i}") for i in (1, 2))).where("parts > 1 and fresh")
    heads = heads.select("bucket", F.col("_h.rep").alias("head"), F.col("_m.own").alias("most"), (F.col("n") - F.col("_m.n")).alias("outside"), "n", "x1", "x2")
    if least_each:
        heads = heads.groupBy("n", "x1", "x2").agg(F.min(F.struct("bucket", "head", "most", "outside")).alias("_b")).select("_b.*", "n")
    out = buckets.join(written(heads.drop("x1", "x2")), "bucket")
    return out if "lead" in buckets.columns else out.withColumnRenamed("head", "lead")


def few_pairs():
    """Of sized rows: whether their bucket's pairs across components are taken outright, which keeps them linear in its members."""
    return (F.col("outside") <= FEW) | (F.col("outside") * F.col("n") <= PAIRS)


def outright(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, led): of each bucket of rows(bucket, rep, own, most, size), its members outside the largest component with all of other components.

    Pairs whose numbers of k-mers alone keep them from the similarity are left out.
    """
    near = written(rows.select("bucket", "rep", "own", "most", "size"))
    other = near.select("bucket", F.col("rep").alias("rep2"), F.col("own").alias("own2"), F.col("size").alias("size2"))
    alike = F.abs(F.col("size") - F.col("size2")) <= F.lit((1 - least) / (1 + least)) * (F.col("size") + F.col("size2")) + 1e-6
    out = near.where("own != most").join(other, "bucket").where("own != own2 and (rep < rep2 or own2 = most)").where(alike)
    return out.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"), F.lit(False).alias("led"))


def both_of(parts: list[DataFrame]) -> DataFrame:
    """All pairs (a, b, led) of parts, each once; led where any part says so."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("a", "b").agg(F.max("led").alias("led"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    """The union of the tables of all rounds, which are only added to."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def first_buckets(reps: DataFrame) -> DataFrame:
    """(bucket, rep, own, rank, fresh, size): the buckets of several texts; rank puts first the text that meets most others.

    In a group of variants that is the text which the others vary, or the nearest to it.
    """
    rows = reps.select("rep", F.col("kmers").alias("size"), F.explode("buckets").alias("bucket"))
    sizes = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = written(rows.join(sizes, "bucket").groupBy("bucket", "rep").agg(F.max("n").alias("n"), F.max("size").alias("size")))
    rank = written(rows.groupBy("rep").agg((-F.sum("n")).alias("rank")))
    return rows.join(rank, "rep").select("bucket", "rep", F.col("rep").alias("own"), "rank", F.lit(True).alias("fresh"), "size")


def shared_leads(rows: DataFrame) -> DataFrame:
    """rows(bucket, rep, lead, rank, size) with their buckets' leads replaced by those that most members have.

    A member has the lead of lowest (rank, rep) of all its buckets. Members that follow it already need no
    further comparison; a member that merely joins two groups does not give one the lead of the other.
    """
    heads = written(rows.groupBy("bucket").agg(F.min(F.struct("rank", "rep")).alias("_h")))
    best = written(rows.select("bucket", "rep").join(heads, "bucket").groupBy("rep").agg(F.min("_h").alias("_h")))
    votes = rows.select("bucket", "rep").join(best, "rep").groupBy("bucket", "_h").agg(F.count(F.lit(1)).alias("n"))
    lead = votes.groupBy("bucket").agg(F.min(F.struct((-F.col("n")).alias("n"), "_h")).alias("_v")).select("bucket", F.col("_v._h.rep").alias("lead"))
    return rows.drop("lead").join(written(lead), "bucket")


def split(rows: DataFrame, few, least: float, share: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of sized rows: pairs of the buckets with few, pairs of the others' leads with their members, and the rows of these others."""
    led = rows.where(~few).select("bucket", "rep", "lead", "rank", "size")
    led = shared_leads(written(led)) if share else led
    led = written(led.where("rep != lead"))
    star = led.select(F.col("lead").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("led"))
    return outright(rows.where(few), least), star, led


WORD_OF, BIT_OF = f"cast(pmod(k, {WORDS}) as int)", "shiftleft(1L, cast(pmod(shiftright(k, 32), 64) as int))"


def keyed(rows: DataFrame) -> DataFrame:
    """(bucket, rep, own, rank, fresh, size): the buckets (a, key) of rows(a, b, own, more, size, keys, fresh) that can hold two components.

    A key matters only if a member outside the leader's largest component holds it; such keys are
    noted in a table of bits per leader, and the others' keys are looked up there.
    """

    def buckets(df: DataFrame) -> DataFrame:
        return df.select(F.xxhash64("a", "k").alias("bucket"), F.col("b").alias("rep"), "own", F.col("more").alias("rank"), "fresh", "size")

    most = rows.groupBy("a", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("a").agg(F.max(F.struct("n", "own")).alias("_m")).select("a", F.col("_m.own").alias("most"))
    rows = written(rows.select("a", "b", "own", "more", "size", "keys", "fresh").join(written(most), "a"))
    outside = written(rows.where("own != most").select("a", "b", "own", "more", "size", "fresh", F.explode("keys").alias("k")))
    bits = outside.groupBy("a", F.expr(WORD_OF).alias("word")).agg(F.bit_or(F.expr(BIT_OF)).alias("bits"))
    bits = bits.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_w"))  # at most WORDS entries
    bits = written(bits.select("a", F.expr(f"transform(sequence(0, {WORDS - 1}), i -> coalesce(_w[i], 0L))").alias("_w")))
    inside = rows.where("own = most").join(bits, "a").select("a", "b", "own", "more", "size", "fresh", F.explode(F.expr(f"filter(keys, k -> (_w[{WORD_OF}] & {BIT_OF}) != 0)")).alias("k"))
    return buckets(outside).union(buckets(inside))


def level_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, led): case (b), the pairs of the leads' rows(a, b, own, linked, missing, more, size) that hardly add to their leader."""
    kinds = written(rows.groupBy("a", "missing", "more", "size").agg(F.max(~F.col("linked")).alias("off")))
    other = kinds.toDF("a", "missing2", "more2", "size2", "off2")
    bound = F.lit((1 - least) / (1 + least)) * (F.col("size") + F.col("size2")) + 1e-6
    near = kinds.where("off").join(other, "a").where(F.col("more") + F.col("more2") + F.abs(F.col("missing") - F.col("missing2")) <= bound)
    one = rows.where("not linked").select("a", "missing", "more", "size", F.col("b").alias("x"), F.col("own").alias("own_x"))
    two = rows.select("a", F.col("missing").alias("missing2"), F.col("more").alias("more2"), F.col("size").alias("size2"), F.col("b").alias("y"), F.col("own").alias("own_y"))
    pairs = one.join(near.drop("off", "off2"), ["a", "missing", "more", "size"]).join(two, ["a", "missing2", "more2", "size2"]).where("own_x != own_y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(False).alias("led"))


def linked(docs: DataFrame, reps: DataFrame, least: float) -> DataFrame | None:
    """(id, component) of the representatives that are linked with others; None where there are no links."""
    few, star, led = split(sized(first_buckets(reps)), F.col("outside") <= FEW, least, share=True)
    pairs = written(both_of([few, star]))
    members = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    kmers = written(kmer_table(docs, members.join(reps.select("rep", "digest"), "rep")))
    label, known, seen, done = None, [], [], []
    while not pairs.isEmpty():
        known.append(pairs)
        seen.append(written(compared(written(close(pairs, kmers, least)), kmers, least)))
        label = relabelled(label, seen[-1].where("linked").select("a", "b"))
        # the buckets led in this round, after the links found in it
        again = sized(labelled(led, label, "rep", "own").withColumn("fresh", F.lit(True)))
        few, wide = outright(again.where(few_pairs()), least), again.where(~few_pairs()).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        new = written(wide.join(all_of(done), ["a", "b"], "left_anti") if done else wide)
        parts = [few]
        if not new.isEmpty():
            taken = new.withColumn("fresh", F.lit(True))
            if done:
                taken = taken.union(all_of(done).join(new.select("a").distinct(), "a", "left_semi").select("a", "b", F.lit(False)))
            rows = all_of(seen).where("led").join(taken, ["a", "b"])
            rows = written(labelled(rows, label, "b", "own"))
            done.append(new)
            small, star, led = split(sized(keyed(rows), least_each=True), few_pairs(), least)
            parts += [level_pairs(rows, least), small, star]
        else:
            led = led.limit(0)
        both = both_of(parts)
        met = all_of(known).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        before = all_of(seen).where("led").select("a", "b")
        pairs = written(both.where("led").join(before, ["a", "b"], "left_anti").union(both.where("not led").join(met, ["a", "b"], "left_anti")))
    return label


def joined(texts: list[np.ndarray], least: float) -> np.ndarray:
    """For each text of labelled k-mers the first text of its class: whatever pairs have an alignment that reaches least are linked.

    Texts are taken up one after the other; of the earlier ones of other classes that share a k-mer of both prefixes, those that
    share enough k-mers are aligned. Shared k-mers are counted by bits for the BITS most common, by lists of texts for the rest.
    """
    n, size = len(texts), np.array([len(x) for x in texts])
    label = np.arange(n)
    near = lambda x, y: aligned(texts[x], texts[y], least) >= least - 1e-9
    if n == 2:
        return np.zeros(2, np.int64) if near(0, 1) else label
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    _, code, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    code, common = rank[code], max(0, len(count) - BITS)
    order = np.lexsort((code, owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    prefix = order[place < np.repeat(((1 - least) * size + 1e-9).astype(np.int64) + 1, size)]
    bits = np.zeros((n, -(-min(len(count), BITS) // 64)), np.uint64)
    top = np.flatnonzero(code >= common)
    np.bitwise_or.at(bits, (owner[top], (code[top] - common) // 64), np.uint64(1) << ((code[top] - common) % 64).astype(np.uint64))
    lists = [_earlier(code[k], owner[k], n) for k in (prefix, np.flatnonzero(code < common))]
    for x in range(1, n):
        others = lists[0](x, x)
        others = np.unique(others) if others is not None else np.arange(x)
        others = others[label[others] != label[x]]
        if not len(others):
            continue
        shared = np.bitwise_count(bits[others] & bits[x]).sum(axis=1, dtype=np.int64)
        rest = lists[1](x, 1 << 62)
        if len(rest):
            shared += np.bincount(rest, minlength=x)[others]
        ok = shared >= least / (1 + least) * (size[others] + size[x]) - 1e-6
        others = others[ok][np.argsort(-shared[ok], kind="stable")]
        while len(others):
            y, others = others[0], others[1:]
            if near(x, y):
                a, b = sorted((label[x], label[y]))
                label[label == b] = a
                others = others[label[others] != a]
    return label


def _earlier(code: np.ndarray, owner: np.ndarray, n: int):
    """A function of text x and a limit: the texts before x once for each of code that they share with x; None if they are more than the limit."""
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    start = np.searchsorted(code, code).astype(np.int32)  # a text's own place among its code's ends the earlier texts
    at = np.flatnonzero(np.arange(len(code)) > start)
    at = at[np.argsort(owner[at], kind="stable")]
    cuts = np.searchsorted(owner[at], np.arange(n + 1))

    def of(x: int, limit: int):
        mine = at[cuts[x] : cuts[x + 1]]
        many = mine - start[mine]
        if many.sum() > limit:
            return None
        return owner[np.arange(many.sum()) + np.repeat(start[mine] - (np.cumsum(many) - many), many)]

    return of


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(id, component) of the texts that share buckets with others, directly or not."""
    rows = reps.select("rep", F.explode("buckets").alias("bucket"))
    heads = written(rows.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("_m")).where("head != _m").drop("_m"))
    return components(rows.join(heads, "bucket").select(F.col("rep").alias("a"), F.col("head").alias("b")).where("a != b").distinct())


def linked_groups(docs: DataFrame, reps: DataFrame, least: float) -> DataFrame | None:
    """linked(), with all candidate groups of at most LOCAL k-mers solved whole, each in one task."""
    near = written(candidate_groups(reps).join(reps.select(F.col("rep").alias("id"), "kmers"), "id"))
    sizes = written(near.groupBy("component").agg(F.sum(F.greatest("kmers", F.lit(LEAST_KMERS))).alias("n")))
    total = sizes.agg(F.sum(F.when(F.col("n") <= SHARED // 8, F.col("n"))), F.max("n")).first()
    if total[1] is None:
        return None
    own = F.col("n") > SHARED // 8
    sizes = sizes.select("component", "n", own.alias("own"), F.when(own, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(max(1, -(-(total[0] or 0) // SHARED))))).alias("of"))
    ids = near.drop("kmers").join(sizes.where(F.col("n") <= LOCAL).drop("n"), "component").withColumnRenamed("id", "rep")

    def kmers(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                data = [x.tobytes() for _, x in kmers_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("own", "of", "component", "rep")), pa.array(data, pa.binary())], names=["own", "of", "component", "rep", "kmer_bytes"])

    def solve(rows: pa.Table) -> pa.Table:
        of, rep = (rows.column(c).to_numpy() for c in ("component", "rep"))
        order = np.lexsort((rep, of))
        of, rep, data = of[order], rep[order], rows.column("kmer_bytes").combine_chunks()
        ids, labels = [], []
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
            texts: dict[int, bytes] = {}
            for r, i in zip(rep[a:b].tolist(), order[a:b].tolist()):  # of a doc_id's several texts the least
                x = data[i].as_py()
                texts[r] = min(texts.get(r, x), x)
            names = np.fromiter(texts, np.int64, len(texts))
            if len(names) > 1:
                ids.append(names)
                labels.append(names[joined([np.frombuffer(x, np.uint64) for x in texts.values()], least)])
        ids, labels = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, labels))
        return pa.table({"id": ids, "component": labels})

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(ids, "rep").select("own", "of", "component", "rep", "text")
    texts = texts.mapInArrow(kmers, "own boolean, of long, component long, rep long, kmer_bytes binary")
    label = written(texts.groupBy("own", "of").applyInArrow(solve, "id long, component long"))
    if total[1] > LOCAL:
        large = near.join(sizes.where(F.col("n") > LOCAL), "component").select(F.col("id").alias("rep"))
        more = linked(docs, written(reps.join(large, "rep", "left_semi")), least)
        label = label if more is None else written(label.union(more))
    return label


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), text_id (that of equal texts)."""
    rows = written(sketched(docs, least))
    reps = written(rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "kmers", "buckets")).alias("_r")).select("digest", F.col("_r.doc_id").alias("rep"), F.col("_r.kmers").alias("kmers"), F.col("_r.buckets").alias("buckets")))
    label = linked_groups(docs, reps.where("rep is not null"), least)
    named = written(labelled(reps.select("digest", "rep"), label, "rep", "class_id"))
    return rows.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", F.col("rep").alias("text_id"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs, with all their columns, without those whose class has a smaller doc_id; rows that repeat the doc_id that stays are all kept."""
    name = unused(docs, "keep")
    keep = written(near_classes(docs, least).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")  # identifiers grow with the table


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "text_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
