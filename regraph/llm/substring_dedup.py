"""Substring dedup: a log-structured index of window fingerprints.

A window is WINDOW consecutive words of one document; its fingerprint is a 64-bit polynomial hash
of word hashes, computed for every position. Each task fills memtables of `memtable` windows and
flushes each as a sorted immutable run, cut by fingerprint range into blocks (delta and byte-plane
coded, compressed). Within a run only the entries of a fingerprint's smallest document go on; the
others are settled on the spot, since their run holds a smaller document. A passage shared by a
third of all rows therefore sends each range at most one document per run, and no group grows hot.

The runs of one range, and those of earlier batches where a history is given, are merge-joined: all
entries whose document is not the smallest of their fingerprint are hits. Runs are then compacted
to one entry per fingerprint (`compacted`), which is what a later batch joins.

Verification: a hit counts only where CHECK_BITS further bits of a second, independent fingerprint
agree as well, and where the document, read again, still has a window of that fingerprint; a test
compares with the words themselves.

Ranges: one for every RANGE_BYTES of text, at most MAX_RANGES, so that a range's runs fit in a
task; larger corpora are to be added batch by batch.

Nulls, ties, odd input: a null or empty text has no words; a null doc_id is not smaller than any
other, takes nothing from others and keeps its words; rows that repeat a doc_id remove nothing from
each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, text_or_empty, text_slices, word_hashes, words_of

WINDOW, MEMTABLE, RANGE_BYTES, MAX_RANGES, CHECK_BITS = 13, 2_000_000, 12 << 20, 1 << 16, 8
RUNS = "range int, doc long, n int, data binary"
BASE = np.uint64(0x9E3779B97F4A7C15)


def planes(x: np.ndarray) -> bytes:
    """Little-endian bytes of x, plane by plane: equal high bytes end up side by side."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(data: bytes, n: int, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(dtype).ravel()


CODEC = pa.Codec("zstd", 1)


def coded(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> bytes:
    return CODEC.compress(planes(np.diff(h, prepend=np.uint64(0))) + planes(doc) + check.tobytes(), asbytes=True)


def decoded(data: bytes, n: int) -> tuple[np.ndarray, ...]:
    raw = CODEC.decompress(data, 17 * n, asbytes=True)
    return np.cumsum(unplanes(raw[: 8 * n], n, np.uint64), dtype=np.uint64), np.frombuffer(raw[16 * n :], np.uint8), unplanes(raw[8 * n : 16 * n], n, np.int64)


def fingerprints(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, check, text index, position) of every window of the texts."""
    offsets, codes, vocabulary = words_of(texts)
    count = np.diff(offsets)
    at = np.arange(max(0, len(codes) - window + 1))
    row = np.repeat(np.arange(len(count)), count)[: len(at)]
    inside = at + window <= offsets[1:][row] if len(at) else np.zeros(0, bool)
    at, row = at[inside], row[inside]

    def rolled(seed: int) -> np.ndarray:
        word = word_hashes(vocabulary, seed)[codes] if len(codes) else np.zeros(0, np.uint64)
        total = np.zeros(max(0, len(codes) - window + 1), np.uint64)
        for j in range(window):
            total = total * BASE + word[j : len(word) - window + 1 + j]
        return mix64(total[inside])

    return rolled(1), (rolled(2) >> np.uint64(64 - CHECK_BITS)).astype(np.uint8), row, at - offsets[:-1][row]


def smallest(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, least): rows by fingerprint and check, and for each the smallest document that has it."""
    order = np.argsort(h, kind="stable")  # merges sorted runs
    hs, cs, ds = h[order], check[order], doc[order]
    new = np.empty(len(hs), bool)
    if len(hs):
        new[0] = True
        new[1:] = hs[1:] != hs[:-1]
        # a fingerprint with two checks: sort those few groups by check too
        if ((cs[1:] != cs[:-1]) & ~new[1:]).any():
            order = np.lexsort((check, h))
            hs, cs, ds = h[order], check[order], doc[order]
            new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(ds, first) if len(first) else ds
    return order, np.repeat(least, np.diff(np.append(first, len(hs))))


def distinct_entries(h: np.ndarray, check: np.ndarray, doc: np.ndarray, least: np.ndarray):
    """Sorted entries, one for each fingerprint and document."""
    order = np.lexsort((doc, check, h)) if len(h) else np.zeros(0, int)
    h, check, doc, least = h[order], check[order], doc[order], least[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (check[1:] != check[:-1])
    return h[keep], check[keep], doc[keep], least[keep]


def runs_of(docs: DataFrame, ranges: int, window: int = WINDOW, memtable: int = MEMTABLE) -> DataFrame:
    """Runs of docs(doc_id, text) by range; rows of range -1 hold hits that a run settled itself, by document."""

    def flush(parts):
        h, check, doc = (np.concatenate(x) for x in zip(*parts))
        order, least = smallest(h, check, doc)
        h, check, doc = h[order], check[order], doc[order]
        hit = doc > least
        if hit.any():
            own, found = doc[hit], h[hit]
            by = np.lexsort((found, own))
            own, found = own[by], found[by]
            starts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
            ends = np.append(starts[1:], len(own))
            data = [found[a:b].tobytes() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), -1, np.int32)), pa.array(own[starts]), pa.array((ends - starts).astype(np.int32)), pa.array(data, pa.binary())], names=["range", "doc", "n", "data"])
        h, check, doc, _ = distinct_entries(h[~hit], check[~hit], doc[~hit], least[~hit])
        of = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # ascends with h
        starts = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1))
        ends = np.append(starts[1:], len(h))
        data = [coded(h[a:b], check[a:b], doc[a:b]) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int32)), pa.nulls(len(starts), pa.int64()), pa.array((ends - starts).astype(np.int32)), pa.array(data, pa.binary())], names=["range", "doc", "n", "data"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                h, check, row, _ = fingerprints(part.column("text"), window)
                parts.append((h, check, part.column("doc_id").to_numpy(zero_copy_only=False)[row]))
                held += len(h)
                if held >= memtable:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, RUNS)


def decoded_range(group: pa.Table) -> tuple[np.ndarray, ...]:
    parts = [decoded(d, n) for d, n in zip(group.column("data").to_pylist(), group.column("n").to_pylist())]
    return tuple(np.concatenate(x) for x in zip(*parts))


def merged_hits(runs: DataFrame) -> DataFrame:
    """(doc, fingerprint) of the windows that a smaller document has: the merge of all runs of each range."""

    def merge(group: pa.Table) -> pa.Table:
        if group.column("range")[0].as_py() < 0:  # settled already; dealt by document, so these groups stay small
            doc = np.repeat(group.column("doc").to_numpy(), group.column("n").to_numpy())
            h = np.frombuffer(b"".join(group.column("data").to_pylist()), np.uint64)
        else:
            h, check, doc = decoded_range(group)
            order, least = smallest(h, check, doc)
            hit = doc[order] > least
            doc, h = doc[order][hit], h[order][hit]
            by = np.argsort(doc, kind="stable")
            doc, h = doc[by], h[by]
        return pa.table({"doc": pa.array(doc, pa.int64()), "fingerprint": pa.array(h.view(np.int64), pa.int64())})

    keyed = runs.withColumn("part", F.when(F.col("range") < 0, F.pmod(F.xxhash64("doc"), F.lit(1024))))
    return keyed.groupBy("range", "part").applyInArrow(merge, "doc long, fingerprint long")


def compacted(runs: DataFrame) -> DataFrame:
    """One run per range with each fingerprint's smallest document: the history of later batches."""

    def merge(group: pa.Table) -> pa.Table:
        h, check, doc = decoded_range(group)
        order, least = smallest(h, check, doc)
        h, check, doc, least = distinct_entries(h[order], check[order], doc[order], least)
        keep = doc == least
        return pa.table({"range": group.column("range")[:1], "doc": pa.nulls(1, pa.int64()), "n": pa.array([int(keep.sum())], pa.int32()), "data": pa.array([coded(h[keep], check[keep], doc[keep])], pa.binary())})

    return runs.where("range >= 0").groupBy("range").applyInArrow(merge, RUNS)


def ranges_for(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(MAX_RANGES, max(1, -(-total // RANGE_BYTES))))


def removed_words(docs: DataFrame, window: int = WINDOW, history: DataFrame | None = None, ranges: int | None = None, memtable: int = MEMTABLE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of docs: words that a smaller document's window covers are gone.

    history holds compacted runs of earlier batches, made with the same number of ranges. Columns of
    docs other than doc_id and text are not carried.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    runs = runs_of(rows, ranges or ranges_for(rows), window, memtable)
    if history is not None:
        runs = runs.unionByName(history)
    hits = merged_hits(runs).groupBy("doc").agg(F.collect_list("fingerprint").alias("hits"))  # no more than the document's windows
    joined = rows.join(hits, F.col("doc_id") == F.col("doc"), "left").drop("doc")

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                total, removed, kept = [], [], []
                touched = part.column("hits").is_valid()
                h, _, row, at = fingerprints(part.column("text").filter(touched), window)
                ends = np.searchsorted(row, np.arange(int(pc.sum(touched).as_py() or 0) + 1))
                t = 0
                for text, found in zip(part.column("text").to_pylist(), part.column("hits")):
                    words = text.encode().split()
                    total.append(len(words))
                    gone = 0
                    if found.is_valid:
                        a, b = ends[t], ends[t + 1]
                        t += 1
                        marked = at[a:b][np.isin(h[a:b], found.values.to_numpy().view(np.uint64))]
                        edge = np.zeros(len(words) + 1, np.int32)
                        np.add.at(edge, marked, 1)
                        np.add.at(edge, marked + window, -1)
                        cover = np.cumsum(edge[:-1]) > 0
                        gone = int(cover.sum())
                        words = [w for w, c in zip(words, cover.tolist()) if not c]
                    removed.append(gone)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
