"""Mixing sources to target weights by fixed-length blocks and index permutations.

1. The words of each source, in doc_id order, form one stream that is cut into blocks of
   `block` words. Offsets come from sums over ranges of identifiers at three levels, so no source
   is ever ordered in one task.
2. Targets: each source's share of all words by weight; a target stops at `most` times the
   source's size and the excess is shared again by weight.
3. A source's target gives its number of slots. The slots are dealt to output shards by one
   multinomial draw per source, so every shard has multinomial source counts while the totals
   stay exact.
4. Slot i of a source takes block perm(i mod blocks) of pass i div blocks, where perm is a keyed
   Feistel permutation of the block indices with cycle walking: each pass uses every block once,
   so no block is taken more often than ceil(slots / blocks) <= `most` times.
5. Slots and blocks meet in a join on (source, block), whose keys are spread evenly even where one
   source holds a third of all rows.

The catalogue of sources (one row each) is the only thing the driver holds.

Nulls, ties, odd input: a null text has size 0; a null source is a source of its own, ordered last;
null doc_ids come first in their source's stream; rows that repeat a doc_id are kept apart by their
text's hash and, if equal, share the words taken evenly (they count as one document); an empty
table gives no rows; texts without words take nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, mix64, table, text_or_empty, unused, written

BLOCK, SHARD_SLOTS, MOST, SEED = 128, 4096, 3, 20240
#: Documents of 2^FINE identifiers are added up first, then 2^COARSE.
FINE, COARSE = 9, 19


def source_targets(sizes: list[tuple[str | None, int]], most: int = MOST, weights=(1, 2, 3)) -> dict[str | None, float]:
    """Target words of each source: weights repeat over the sources by code point, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    total = sum(size.values())
    target: dict[str | None, float] = {}
    free, left = list(size), float(total)
    while free:
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * per > most * size[s]]
        if not over:
            return target | {s: weight[s] * per for s in free}
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
            free.remove(s)
    return target


def _key(seed: int, source: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, source)).encode(), digest_size=8).digest(), "little")


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1: Feistel rounds on the next even power of two, walking cycles."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key + r * 0x9E3779B97F4A7C15) % 2**64)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo[todo] = out[todo] >= np.uint64(n)
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a tie key; equal documents under one doc_id are one row with `copies`."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text_or_empty()).alias("tie"))
    return rows.groupBy("doc_id", "source", "tie").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def with_offsets(rows: DataFrame) -> DataFrame:
    """rows with begin: the words before it in its source's stream."""
    ident = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))
    rows = rows.withColumns({"words": F.col("size") * F.col("copies"), "fine": F.shiftright(ident, FINE), "coarse": F.shiftright(ident, COARSE), "src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))})
    running = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = written(rows.groupBy("src", "coarse", "fine").agg(F.sum("words").alias("words")))
    coarse = fine.groupBy("src", "coarse").agg(F.sum("words").alias("words"))
    coarse = coarse.select("src", "coarse", running(Window.partitionBy("src").orderBy("coarse")).alias("_c"))
    fine = fine.withColumn("_f", running(Window.partitionBy("src", "coarse").orderBy("fine"))).join(coarse, ["src", "coarse"])
    fine = fine.select("src", "fine", (F.col("_c") + F.col("_f")).alias("_before"))
    rows = rows.withColumn("_in", running(Window.partitionBy("src", "fine").orderBy("doc_id", "tie")))
    return rows.join(fine, ["src", "fine"]).withColumn("begin", F.col("_before") + F.col("_in")).drop("_before", "_in", "fine", "coarse")


def pieces_of(rows: DataFrame, block: int) -> DataFrame:
    """(src, block, doc_id, source, tie, start, words): the parts of each document by block of its source."""
    some = rows.where("words > 0")
    at = some.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + words - 1) div {block}"))))
    low, high = F.greatest("begin", F.col("block") * block), F.least(F.col("begin") + F.col("words"), (F.col("block") + 1) * block)
    return at.withColumns({"start": low - F.col("begin"), "taken_words": high - low})


def drawn_slots(spark: SparkSession, sources: list[tuple[str, int, float]], block: int, most: int, shard_slots: int, seed: int) -> DataFrame:
    """(src, shard, slot, block): sources lists (key, words, target); one row for each slot of the mix."""
    plan = []
    for src, words, target in sources:
        blocks = -(-words // block)
        slots = min(round(target / block), most * blocks)
        # the last block of a stream may be short: as many slots as bring the words nearest the target
        mean = words / blocks if blocks else 0
        slots = min(round(target / mean), most * blocks) if blocks else slots
        plan.append((src, blocks, slots, _key(seed, src) >> 1))
    shards = max(1, -(-sum(x[2] for x in plan) // shard_slots))
    rows = spark.createDataFrame([(*x, shards, seed) for x in plan if x[2]], "src string, blocks long, slots long, key long, shards long, seed long")

    def counts(batches):
        for batch in batches:
            for r in batch.to_pylist():
                drawn = np.random.default_rng([r["seed"], r["key"]]).multinomial(r["slots"], np.full(r["shards"], 1 / r["shards"]))
                first = np.cumsum(drawn) - drawn
                for a in range(0, len(drawn), 65536):
                    part = drawn[a : a + 65536]
                    n = len(part)
                    yield pa.RecordBatch.from_pydict({"src": [r["src"]] * n, "blocks": [r["blocks"]] * n, "key": [r["key"]] * n, "shard": np.arange(a, a + n), "first": first[a : a + n], "count": part})

    dealt = rows.repartition(len(plan) or 1).mapInArrow(counts, "src string, blocks long, key long, shard long, first long, count long").where("count > 0")

    def slots(batches):
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["first"], r["first"] + r["count"])
                turn, n = slot // r["blocks"], len(slot)
                block_of = np.empty(n, np.int64)
                for t in np.unique(turn):
                    here = turn == t
                    block_of[here] = permuted(slot[here] % r["blocks"], r["blocks"], r["key"] + int(t))
                yield pa.RecordBatch.from_pydict({"src": [r["src"]] * n, "shard": [r["shard"]] * n, "slot": slot, "pass": turn, "block": block_of})

    return dealt.repartition("src", "shard").mapInArrow(slots, "src string, shard long, slot long, pass long, block long")


def mix(docs: DataFrame, block: int = BLOCK, most: int = MOST, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
    """(sized rows, slots, pieces, targets) of the mix of docs."""
    spark = docs.sparkSession
    rows = written(with_offsets(written(sized(docs))))
    sizes = rows.groupBy("src").agg(F.max("source").alias("source"), F.sum("words").alias("words")).collect()  # the catalogue: one row a source
    targets = source_targets([(r["source"], r["words"]) for r in sizes], most)
    catalogue = [(r["src"], r["words"], targets.get(r["source"], 0.0)) for r in sizes]
    slots = drawn_slots(spark, catalogue, block, most, shard_slots, seed)
    known = spark.createDataFrame([(r["src"], r["words"], targets.get(r["source"], 0.0)) for r in sizes], "src string, source_size long, target double")
    return rows, slots, pieces_of(rows, block), known


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (shard, slot, src, block, doc_id, start, taken_words), a row for each piece of each slot."""
    _, slots, pieces, _ = mix(docs, **options)
    return slots.join(pieces, ["src", "block"]).select("shard", "slot", "src", "block", "doc_id", "start", "taken_words")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per document of docs: doc_id, size, source, source_size, target, taken."""
    rows, slots, pieces, known = mix(docs, **options)
    times = slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    used = pieces.join(times, ["src", "block"]).groupBy("src", "doc_id", "tie").agg(F.sum(F.col("taken_words") * F.col("times")).alias("got"))
    used = used.select(F.col("src").alias("_src"), F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "got")
    same = (F.col("src") == F.col("_src")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    out = rows.join(used, same, "left").drop("_src", "_id", "_tie")
    out = out.join(F.broadcast(known), "src")  # a row a source
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # equal rows of one doc_id share its words
    got = F.coalesce("got", F.lit(0))
    taken = F.expr("coalesce(got, 0) div copies") + (F.col("copy") <= got % F.col("copies")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, most: int = MOST, **options) -> DataFrame:
    """docs as the mix takes them: pass e of a document holds the words of its blocks drawn more than e times.

    The columns are those of docs; text has the taken words joined by one space and n_chars its
    length; further columns of any name are kept. Documents of which nothing is taken are left out.
    """
    rows, slots, pieces, _ = mix(docs, block=block, most=most, **options)
    times = slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = pieces.join(times, ["src", "block"]).groupBy("doc_id", "src", "tie", "copies", "size").agg(F.collect_list(F.struct("start", "taken_words", "times")).alias("_parts"))
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("src").alias("_src"), F.col("tie").alias("_tie"), "_parts")
    own, drawn_parts = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), unused(docs, "_parts")  # a struct: no name of docs meets one used here
    named = docs.select(own.alias("row"), F.col("doc_id").cast("long").alias("_id2"), F.xxhash64(text_or_empty()).alias("_tie2"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_src2"))
    joined = named.join(parts, F.col("_id2").eqNullSafe(F.col("_id")) & (F.col("_src2") == F.col("_src")) & (F.col("_tie2") == F.col("_tie"))).select("row.*", F.col("_parts").alias(drawn_parts))
    schema = docs.schema

    def rebuild(batches):
        for batch in batches:
            at, parts_at = batch.schema.get_field_index("text"), batch.schema.get_field_index(drawn_parts)
            rows, texts = [], []
            for i in range(batch.num_rows):
                words = np.array((batch.column(at)[i].as_py() or "").encode().split(), object)
                drawn = np.zeros(len(words), np.int64)
                for p in batch.column(parts_at)[i].as_py() if len(words) else ():
                    drawn[np.arange(p["start"], p["start"] + p["taken_words"]) % len(words)] = p["times"]
                for e in range(int(drawn.max(initial=0))):
                    rows.append(i)
                    texts.append(b" ".join(words[drawn > e]).decode())
            picked = batch.take(pa.array(rows, pa.int64()))
            new = {f.name: picked.column(picked.schema.get_field_index(f.name)) for f in schema}
            new["text"] = pa.array(texts, new["text"].type)
            if "n_chars" in new:
                new["n_chars"] = pa.array([len(t) for t in texts], new["n_chars"].type)
            yield pa.RecordBatch.from_pydict(new)

    return joined.mapInArrow(rebuild, schema)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")
