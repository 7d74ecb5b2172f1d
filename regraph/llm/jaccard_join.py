"""Operator 12: documents linked by the Jaccard similarity of their word shingles, joined by token-combination prefixes.

1. A document's set are 64-bit hashes of its distinct shingles. Blocks of documents send their hashes,
   shortened and packed by ranges of values, once to be counted; a hash that no other document has
   cannot be shared, and those that can come back to their block with their number of documents. A
   document goes on only if it has as many of these as any partner would have to share.
2. Documents of one set are one class; its smallest row stands for it.
3. Tokens are ordered from rare to frequent. Of a set of n, any partner has to share o = ceil(0.8 n), so
   all but a prefix may be left out. Rare tokens are signatures by themselves. Frequent ones fall into
   sub-classes, of which pairs of tokens are signatures; the prefix is extended by one token for each
   sub-class it meets, so that what a partner lacks, n - o tokens at most, never breaks all signatures:
   with n_g tokens of sub-class g, rare + sum(max(0, n_g - 1)) has to exceed n - o. How many sub-classes
   there are depends on the size of the sets alone (`subclasses`), at levels of powers of two; a set
   that a larger one of the next level may be similar to has signatures of both.
4. Of the classes with one signature, that with the fewest tokens of its own is compared with all others
   first. What then still lies in different components and may be similar by its sizes is compared pair
   by pair. Every comparison is exact on the hashes.
5. Links are joined to components, classes get the smallest doc_id of theirs.

Nothing is capped or sampled. Nothing that grows with the corpus is broadcast: ranges grow in number
with the words, and groups within one task are ranges of hashes or blocks of `BLOCK` bytes of text.

Null texts and texts without words have an empty set and link with nothing, each other included; texts
of fewer words than a shingle are one shingle. Rows that repeat a doc_id stay rows of their own; rows
without doc_id link, but give a component no id. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import mix64, table, text_slices, word_hashes, words_of, written

#: Words of a shingle, and the similarity in hundredths.
SHINGLE, PERCENT = 5, 80

#: Bytes of text in a block; words in a range of hashes.
BLOCK, RANGE = 8 << 20, 1 << 21

#: Signatures a set may have for them to be listed with each, so that a pair is met once; pairs of larger sets are met in each they share.
LISTED = 256

#: Tokens of more documents than this are frequent.
RARE = 8

_M = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingle hashes of text i are hashes[offsets[i]:offsets[i + 1]]."""
    offsets, codes, vocabulary = words_of(texts)
    h = word_hashes(pc.ascii_lower(vocabulary), 12)[codes]  # of the vocabulary, as ascii_lower misreads sliced arrays if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    grams = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        grams = grams * _POWER + h[k : k + len(grams)]
    grams = mix64(grams)
    out = []
    for a, m in zip(offsets[:-1].tolist(), n.tolist()):
        if m >= size:
            out.append(np.unique(grams[a : a + m - size + 1]))
        elif m:
            one = np.array([m], np.uint64)
            for k in range(a, a + m):
                one = one * _M + h[k : k + 1]
            out.append(mix64(one ^ _M))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.r_[0, np.cumsum([len(x) for x in out], dtype=np.int64)], np.concatenate(out or [np.zeros(0, np.uint64)])


def packed(values: np.ndarray) -> bytes:
    """uint32 values as bytes of equal weight side by side, which compress well where values are small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def needed(n, percent: int = PERCENT):
    """How many tokens a partner of a set of n has to share: ceil(percent / 100 n)."""
    return -(-percent * n // 100)


def subclasses(level: int) -> int:
    """Sub-classes of frequent tokens at sizes from 2 ** level on; 0: each token is a signature."""
    return (1 << level) // 16 if level >= 4 else 0


BLOCKS = "block long, row long, doc_id long, text string, n long, one long, two long, range int, tokens binary, counts binary"


def set_blocks(docs: DataFrame, bits: int, range_bits: int, size: int = SHINGLE, block_bytes: int = BLOCK) -> DataFrame:
    """A row a document (with two hashes of its set), and one for each block and range (row null): the block's different hashes, how many sets have each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in BLOCKS.split(", ")]
    low_bits = np.uint64(bits - range_bits)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, "text", block_bytes):
                offsets, hashes = shingle_sets(part.column("text"), size)
                ones, twos = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = hashes[a:b]
                    ones.append(int(np.bitwise_xor.reduce(mix64(own))) if b > a else 0)
                    twos.append(int(np.sum(mix64(own ^ _M))) if b > a else 0)
                n = len(part)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ones, twos)]
                head = [pa.array(np.full(n, block)), pa.array(block + np.arange(n)), part.column("doc_id"), part.column("text"), pa.array(np.diff(offsets)), *signed]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(head, types)] + [pa.nulls(n, t) for t in types[7:]], names=names)
                # equal sets of a block count once
                first = np.unique(np.array([ones, twos], np.uint64), axis=1, return_index=True)[1] if n else np.zeros(0, np.int64)
                own = [hashes[offsets[k] : offsets[k + 1]] for k in first.tolist()]
                short, count = np.unique(np.concatenate(own or [hashes]) >> np.uint64(64 - bits), return_counts=True)
                ranges = (short >> low_bits).astype(np.int64)
                cuts = np.r_[0, np.flatnonzero(np.diff(ranges)) + 1, len(short)] if len(short) else np.zeros(1, np.int64)
                low = (short & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.int64)
                tokens, counts, at = [], [], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    tokens.append(packed(np.diff(low[a:b], prepend=0)))
                    counts.append(packed(count[a:b]))
                    at.append(int(ranges[a]))
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), *(pa.nulls(m, t) for t in types[1:7]), pa.array(at, pa.int32()), pa.array(tokens, pa.binary()), pa.array(counts, pa.binary())], names=names
                )
                block += max(1, n)

    return rows.mapInArrow(run, BLOCKS)


def counted(blocks: DataFrame) -> DataFrame:
    """(to, range, tokens, counts): for each block its hashes that more than one set has, and how many have them."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpacked(x).astype(np.int64)) for x in rows.column("tokens").to_pylist()]
        number = np.concatenate([unpacked(x).astype(np.int64) for x in rows.column("counts").to_pylist()])
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0])
        total = np.empty(len(values), np.int64)
        total[order] = np.repeat(np.add.reduceat(number[order], starts), np.diff(np.r_[starts, len(values)]))
        shared = total > 1
        cuts = np.r_[0, np.cumsum(np.bincount(owner[shared], minlength=len(parts)))]
        values, total = values[shared], np.minimum(total[shared], (1 << 32) - 1)
        keep = np.flatnonzero(np.diff(cuts))
        tokens = [packed(np.diff(values[cuts[k] : cuts[k + 1]], prepend=0)) for k in keep.tolist()]
        counts = [packed(total[cuts[k] : cuts[k + 1]]) for k in keep.tolist()]
        return pa.table([rows.column("block").take(pa.array(keep)), rows.column("range").take(pa.array(keep)), pa.array(tokens, pa.binary()), pa.array(counts, pa.binary())], names=["to", "range", "tokens", "counts"])

    sent = blocks.where("range is not null").select("block", "range", "tokens", "counts")
    return sent.groupBy("range").applyInArrow(run, "to long, range int, tokens binary, counts binary")


CANDIDATES = "row long, one long, two long, n long, tokens array<long>, counts array<long>"


def candidates(blocks: DataFrame, shared: DataFrame, bits: int, range_bits: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Documents that may have a partner: their shared tokens from rare to frequent, ties by value, and how many sets have each."""
    low_bits = bits - range_bits

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        told = told.combine_chunks().sort_by("range")
        known = [np.cumsum(unpacked(x).astype(np.int64)).astype(np.uint64) + (np.uint64(r) << np.uint64(low_bits)) for x, r in zip(told.column("tokens").to_pylist(), told.column("range").to_pylist())]
        known = np.concatenate([*known, np.zeros(0, np.uint64)])
        number = np.concatenate([*(unpacked(x).astype(np.int64) for x in told.column("counts").to_pylist()), np.zeros(0, np.int64)])
        rows = rows.combine_chunks()
        offsets, hashes = shingle_sets(rows.column("text").combine_chunks(), size)
        short = hashes >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(known, short), max(0, len(known) - 1))
        hit = known[at] == short if len(known) else np.zeros(len(short), bool)
        n = np.diff(offsets)
        before = np.r_[0, np.cumsum(hit)]
        own = before[offsets[1:]] - before[offsets[:-1]]
        keep = np.flatnonzero((own >= needed(n, percent)) & (n > 0))
        tokens, counts = [], []
        for k in keep.tolist():
            mine = slice(offsets[k], offsets[k + 1])
            t, c = hashes[mine][hit[mine]], number[at[mine][hit[mine]]]
            order = np.lexsort((t, c))
            tokens.append(t[order].view(np.int64))
            counts.append(c[order])
        list_ = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.table([*(rows.column(c).take(pa.array(keep)) for c in ("row", "one", "two", "n")), list_(tokens), list_(counts)], names=[x.split()[0] for x in CANDIDATES.split(", ")])

    docs = blocks.where("row is not null").select("block", "row", "text", "one", "two", "n")
    return docs.groupBy("block").cogroup(shared.groupBy("to")).applyInArrow(run, CANDIDATES)


def signatures_of(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature hashes, places, lasts) of a set of n: its shared tokens from rare to frequent and their numbers.

    Places among the shared tokens are those of a signature's rarer and more frequent token.
    """
    need = n - needed(n, percent) + 1 - (n - len(tokens))  # tokens of its own count as covered
    if need <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    few = int(np.searchsorted(counts, rare, side="right"))
    out, at = [mix64(tokens[: min(few, need)] ^ _M)], [np.arange(min(few, need))]
    last = [at[0]]
    need -= few
    if need <= 0:
        return out[0], at[0], at[0]
    frequent = tokens[few:]
    most = 100 * n // percent  # the largest partner
    for level in range(n.bit_length() - 1, most.bit_length()):
        groups = subclasses(level)
        salt = np.uint64(level + 1)
        if not groups:
            out.append(mix64(frequent[:need] * _M + salt))
            at.append(few + np.arange(min(need, len(frequent))))
            last.append(at[-1])
            continue
        group = (mix64(frequent ^ salt) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first = np.zeros(len(frequent), bool)
        first[order[np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])]] = True
        covered = np.cumsum(~first)
        end = int(np.searchsorted(covered, need)) + 1  # subclasses() is small enough for sizes of the level to reach it
        order = np.argsort(group[:end], kind="stable")
        start = 0
        for m in np.unique(group[:end], return_counts=True)[1].tolist():
            place = order[start : start + m]
            a, b = np.triu_indices(m, 1)
            own = frequent[place]
            out.append(mix64((own[a] * _POWER + own[b]) * _M + salt))
            at.append(few + place[a])
            last.append(few + place[b])
            start += m
    return np.concatenate(out), np.concatenate(at), np.concatenate(last)


SIGNATURES = "signature long, row long, n long, shared long, place long, last long"


def signatures(sets: DataFrame, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """(signature, row, n, shared, place, last): shared is how many of the set's tokens another set has."""
    names = [x.split()[0] for x in SIGNATURES.split(", ")]

    def run(batches):
        for batch in batches:
            size, row = batch.column("n").to_numpy(), batch.column("row").to_numpy()
            out = []
            for k in range(len(batch)):
                t, c = (batch.column(x)[k].values.to_numpy() for x in ("tokens", "counts"))
                s, at, last = signatures_of(int(size[k]), t.view(np.uint64), c, percent, rare)
                out.append((s.view(np.int64), *(np.full(len(s), x) for x in (row[k], size[k], len(t))), at, last))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=names)

    return sets.select("row", "n", "tokens", "counts").mapInArrow(run, SIGNATURES)


def may_link(one: str, two: str, percent: int = PERCENT):
    """Whether sets that meet in a signature can be similar: before, between and after its tokens no more agree than the set with fewer shared ones has."""
    n1, s1, p1, q1, n2, s2, p2, q2 = (F.col(c + x) for x in (one, two) for c in ("n", "shared", "place", "last"))
    most = F.least(p1, p2) + F.least(q1 - p1, q2 - p2) + F.least(s1 - q1, s2 - q2)
    return 100 * most >= percent * (n1 + n2 - most)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node1, node2) of pairs(a, b) whose sets are similar."""
    two = sets.select(F.col("row").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    one = sets.select(F.col("row").alias("a"), F.col("n").alias("n1"), F.col("tokens").alias("t1"))

    def run(batches):
        for batch in batches:
            keep = []
            n1, n2 = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            last, held = None, None
            for k, a in enumerate(batch.column("a").to_pylist()):
                if a != last:
                    last, held = a, np.sort(batch.column("t1")[k].values.to_numpy())
                own = batch.column("t2")[k].values.to_numpy()
                at = np.minimum(np.searchsorted(held, own), max(0, len(held) - 1))
                both = int((held[at] == own).sum()) if len(held) else 0
                keep.append(100 * both >= percent * (int(n1[k]) + int(n2[k]) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["node1", "node2"])

    return pairs.join(two, "b").join(one, "a").mapInArrow(run, "node1 long, node2 long")


def in_components(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    return rows.join(mapping.toDF("row", "_new"), "row", "left").withColumn("part", F.coalesce("_new", "row")).drop("_new")


def linked_classes(sets: DataFrame, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """mapping(old, new) of sets' rows to the smallest row they are linked with; rows without links may lack."""
    signed = written(signatures(sets, percent, rare))
    side = lambda df, mark: df.select("signature", *(F.col(c).alias(c + mark) for c in df.columns if c != "signature"))
    central = F.struct((F.col("shared") / F.col("n")).alias("_share"), "n", "row", "shared", "place", "last")
    heads = signed.groupBy("signature").agg(F.max(central).alias("h"), F.count(F.lit(1)).alias("_k")).where("_k > 1").select("signature", "h.row", "h.n", "h.shared", "h.place", "h.last")
    met = side(signed, "2").join(side(heads, "1"), "signature").where((F.col("row1") != F.col("row2")) & may_link("1", "2", percent))
    first = written(met.select(F.least("row1", "row2").alias("a"), F.greatest("row1", "row2").alias("b")).distinct())
    links = written(verified(first, sets, percent))
    parts = written(in_components(signed, components(links)))
    mixed = parts.groupBy("signature").agg(F.min("part").alias("_l"), F.max("part").alias("_m")).where("_l < _m").select("signature")
    open_ = written(parts.join(mixed, "signature", "left_semi"))
    all_ = open_.groupBy("row").agg(F.collect_set("signature").alias("_s")).where(F.size("_s") <= LISTED)  # a set has its prefix's number of signatures
    open_ = written(open_.join(all_, "row", "left").withColumn("before", F.filter("_s", lambda x: x < F.col("signature"))).drop("_s"))
    ok = (F.col("row1") < F.col("row2")) & (F.col("part1") != F.col("part2")) & may_link("1", "2", percent)
    ok = ok & ~F.coalesce(F.arrays_overlap("before1", "before2"), F.lit(False))  # else the pair meets in an earlier signature too
    rest = side(open_, "1").join(side(open_, "2"), "signature").where(ok).select(F.col("row1").alias("a"), F.col("row2").alias("b")).distinct()
    more = written(verified(rest.join(first, ["a", "b"], "left_anti"), sets, percent))
    return components(links.unionAll(more))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach."""
    letters = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    words = max(1, letters // 4)
    range_bits = max(4, (words // RANGE).bit_length())
    bits = max(range_bits + 20, min(62, words.bit_length() + 7))
    blocks = written(set_blocks(docs, bits, range_bits, size, block_bytes), options={"compression": "zstd"})
    some = written(candidates(blocks, counted(blocks), bits, range_bits, size, percent))
    every = blocks.where("row is not null").select("row", "doc_id", "n", "one", "two")
    firsts = written(every.where("n > 0").groupBy("one", "two", "n").agg(F.min("row").alias("row")))
    sets = written(some.join(firsts.select("row"), "row", "left_semi"))
    mapping = linked_classes(sets, percent, rare)
    own = every.join(firsts.withColumnRenamed("row", "first"), ["one", "two", "n"], "left")
    own = own.withColumn("first", F.coalesce("first", "row"))
    placed = own.join(mapping.toDF("first", "_new"), "first", "left").select("doc_id", "n", F.coalesce("_new", "first").alias("part"))
    placed = written(placed)
    least = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "part").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
