"""Operator 13: runs of repeated words, found from Lyndon arrays over an ordered alphabet.

A run with period q and length of at least 4 q holds each of its words four times or more. So a text
is first cut at words that occur less than four times between two cuts, again and again; every run
wanted lies whole between two cuts, and in prose hardly anything is left there. What is left goes
through the linear-time algorithm for general ordered alphabets: the next smaller suffix of every
position under both orders of the words, where common extensions of suffixes already matched are
reused instead of compared again, then each Lyndon word followed by its repetition is extended to
both sides. No suffix array, suffix tree or hash of substrings is built; words are compared by rank.

Null texts have no words; a null doc_id takes no part in what `planted` repeats. Texts of any length
are worked through one document at a time, in time in proportion to their words. Rows that repeat a
doc_id stay rows of their own, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, words_of

#: A run has at least so many periods, and at least so many words.
PERIODS, LEAST = 4, 6

#: Rounds of cutting; what they leave is searched whole.
ROUNDS = 4

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """(nss, lce): the first later suffix that is smaller than that of i, or len(s), and how far both agree.

    Suffixes are met from left to right and those without a smaller one yet wait on a stack. Of all
    stretches known to repeat an earlier one, that which reaches furthest is kept: s[right:reach] is what
    stands `shift` words before. A comparison within it has been made before, `shift` words earlier, and
    goes on only where that one came to the stretch's end. Down the stack, what two neighbours have in
    common is known, so words compared once for i are not compared again.
    """
    n = len(s)
    nss, lce = [n] * n, [0] * n
    pss, plce = [-1] * n, [0] * n
    stack: list[int] = []
    right = reach = shift = 0
    for i in range(n):
        old = i - shift if right < i < reach else -1  # where i was met before
        k = -1  # how far the suffix popped last agrees with i
        while stack:
            t = stack[-1]
            known, least = False, 0
            if k >= 0:  # what t and the one popped have in common is known as well
                least = min(plce[popped], k)
                known = plce[popped] != k
            k = least
            if not known and old >= 0 and (u := t - shift if t >= right else t) >= 0:
                met = lce[u] if nss[u] == old else plce[old] if pss[old] == u else 0
                known = least <= met < reach - i and met > 0
                k = max(least, min(met, reach - i))
            a, b = t + k, i + k
            if not known:
                while b < n and s[a] == s[b]:
                    a += 1
                    b += 1
                k = b - i
                if b > reach:
                    right, reach, shift = i, b, i - t
                    old = -1
            if b == n or s[b] < s[a]:
                nss[t], lce[t] = i, k
                popped = stack.pop()
            else:
                pss[i], plce[i] = t, k
                break
        stack.append(i)
    return nss, lce


def runs_of(s: list[int], periods: int = PERIODS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All (start, length, period) of maximal stretches with smallest period p, length >= max(least, periods * p); periods >= 2."""
    found = set()
    for word in (s, [-x for x in s]):
        nss, lce = next_smaller(word)
        ends: dict[int, int] = {}  # by period, where its last run ends
        for t, (j, k) in enumerate(zip(nss, lce)):
            p = j - t
            # the first Lyndon word of a run starts within its first p words
            if k < (periods - 2) * p or k < 1 or ends.get(p, 0) >= j + k:
                continue
            a = t
            while a and word[a - 1] == word[a - 1 + p]:
                a -= 1
            ends[p] = j + k
            if j + k - a >= max(least, periods * p):
                found.add((a, j + k - a, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, docs: np.ndarray, times: int = PERIODS, least: int = LEAST, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(begin, end) positions between cuts: a word that occurs less than `times` between two cuts is one, as are ends of documents."""
    at = np.arange(len(codes))
    part = docs
    for _ in range(rounds):
        if not len(at):
            return []
        order = np.lexsort((codes[at], part))
        p, c = part[order], codes[at][order]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])])
        count = np.empty(len(at), np.int64)
        count[order] = np.repeat(np.diff(np.r_[new, len(at)]), np.diff(np.r_[new, len(at)]))
        keep = count >= times
        done = keep.all()
        at, part = at[keep], part[keep]
        if not len(at):
            return []
        begin = np.r_[True, (np.diff(at) != 1) | (part[1:] != part[:-1])]
        part = np.cumsum(begin)
        size = np.bincount(part)
        long_ = size[part] >= least
        at, part = at[long_], part[long_]
        if done:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first, np.r_[first[1:], len(at)])]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the contract has a document's words from a on repeat its words a to a + p - 1; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def report(runs: list[tuple[int, int, int]], n: int) -> tuple[tuple, np.ndarray]:
    """((n_runs, start, length, period, exponent_milli, runs_sha256), which of n words stay)."""
    drop = np.zeros(n + 1, np.int64)
    best = None
    for a, length, p in runs:
        drop[a + p] += 1
        drop[a + length] -= 1
        if best is None or length * best[2] > best[1] * p:  # runs come by start, then period
            best = (a, length, p)
    text = "".join(f"{a},{length},{p}\n" for a, length, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(text.encode()).hexdigest()), np.cumsum(drop[:n]) == 0


def periodic_runs(docs: DataFrame, plant: bool = False, periods: int = PERIODS, least: int = LEAST) -> DataFrame:
    """One row per document: its runs of at least `periods` periods and `least` words, and the words left without their repetitions.

    With `plant`, documents are first changed as `planted` says. start, length, period and
    exponent_milli are those of the run with the greatest length / period, ties to the smallest start,
    then period. A word is dropped if a run contains it after that run's first period.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, codes, vocabulary = words_of(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                sizes = np.diff(offsets)
                if plant:
                    codes = codes.copy()
                    for d, (i, n) in enumerate(zip(ids, sizes.tolist())):
                        if change := planted(i, n):
                            a, p = change
                            own = codes[offsets[d] : offsets[d + 1]]
                            own[a:] = own[a + np.arange(n - a) % p]
                owner = np.repeat(np.arange(len(ids)), sizes)
                runs: dict[int, list] = {}
                for a, b in stretches(codes, owner, periods, least):
                    d = int(owner[a])
                    shift = a - int(offsets[d])
                    own = runs_of(codes[a:b].tolist(), periods, least)
                    runs.setdefault(d, []).extend((x + shift, length, p) for x, length, p in own)
                words = np.array(vocabulary.to_pylist(), object)
                out = []
                for d, i in enumerate(ids):
                    facts, stay = report(runs.get(d, []), int(sizes[d]))
                    own = codes[offsets[d] : offsets[d + 1]]
                    kept = own if stay.all() else own[stay]
                    text = " ".join(words[kept].tolist())
                    out.append((i, *facts, hashlib.sha256(text.encode()).hexdigest(), int(sizes[d]), int(sizes[d]) - len(kept)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, SCHEMA)


def collapsed(docs: DataFrame, periods: int = PERIODS, least: int = LEAST) -> DataFrame:
    """docs whose texts lack the repetitions of their runs; texts without runs, null ones too, stay as they are, and so do all other columns."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, codes, vocabulary = words_of(part.column("text"))
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                runs: dict[int, list] = {}
                for a, b in stretches(codes, owner, periods, least):
                    d = int(owner[a])
                    runs.setdefault(d, []).extend((x + a - int(offsets[d]), n, p) for x, n, p in runs_of(codes[a:b].tolist(), periods, least))
                texts = part.column("text").to_pylist()
                for d, found in runs.items():
                    if found:
                        own = codes[offsets[d] : offsets[d + 1]]
                        _, stay = report(found, len(own))
                        texts[d] = " ".join(vocabulary.take(pa.array(own[stay])).to_pylist())
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
