"""Packing documents into token sequences by order-preserving dynamic programming.

Documents are dealt to tasks by ranges of doc_id and read there in order as one stream of tokens.
A window may end at a document's end (free), at a sentence's end inside a document (penalty
`sentence_cut`) or, inside a sentence that is longer than a window, after a full window
(`forced_cut`). With c(j) the j-th possible cut and q(j) its penalty,

    f(j) = q(j) + min over i with c(j) - c(i) <= size of f(i) + size - (c(j) - c(i)),

and since f(i) + c(i) does not depend on j, a monotone queue gives each minimum in constant time.
The stream is solved in stretches of `stretch` tokens; the last window of a stretch is carried over
to the next one, so memory is bounded. Sequences are padded to `size` unless their length is a
power of two; what is left at a task's end is cut into powers of two where that costs less than
padding it.

Tokens come from the given tokenizer, applied once to each distinct word of a batch: the tokenizer
normalises and splits without looking across white space (a test compares whole texts).

Nulls, ties, odd input: a null or empty text is the end token alone; null doc_ids come first;
repeated rows are packed each, in the order of their text's hash; empty tables give no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, words_of

SIZE, END, SENTENCE_CUT, FORCED_CUT, STRETCH = 4096, 2, 16, 256, 1 << 18
CACHE = 600_000  # distinct words a worker remembers
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


#: Lower-case Latin letters: such a word is one piece, so its bytes go to the model directly.
LETTERS = re.compile("[a-zà-öø-ÿ]+")
#: The sign of each byte that byte-level vocabularies do not write as itself (fixed rule).
BYTE_SIGNS = {**{b: 289 + b - 127 for b in range(127, 161)}, 173: 323}


class WordTokens:
    """Token ids of words, remembered for up to CACHE words of a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # for words that normalising and splitting leave whole
        self.clear()

    def clear(self) -> None:
        self.code, self.ids, self.begin = {}, array("I"), array("q", [0])

    def _codes(self, words: pa.Array) -> np.ndarray:
        """A code for each word; new words are tokenized."""
        coded = pc.dictionary_encode(words)
        words = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            found = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(BYTE_SIGNS))] if LETTERS.fullmatch(w) else None for w in fresh]
            rest = [i for i, f in enumerate(found) if f is None]
            for a in range(0, len(rest), 8192):
                part = rest[a : a + 8192]
                for i, e in zip(part, self.tokenizer.encode_batch_fast([fresh[i] for i in part], add_special_tokens=False)):
                    found[i] = e.ids
            codes = np.arange(len(self.code), len(self.code) + len(new))
            self.code.update(zip(fresh, codes.tolist()))
            known[new] = codes
            self.ids.extend(chain.from_iterable(found))
            self.begin.extend((self.begin[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))).tolist())
        return known[coded.indices.to_numpy()]

    def _table(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(begin, ids): the ids of word i are ids[begin[i]:begin[i + 1]].

        Words of Latin letters with at most one mark at the end are looked up as the lower-case
        letters and the mark: the tokenizer itself lower-cases and splits there.
        """
        plain = pc.match_substring_regex(vocabulary, "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$")
        marked = pc.and_(plain, pc.is_in(pc.utf8_slice_codeunits(vocabulary, -1), pa.array(list(".,;:!?"), vocabulary.type)))
        core = pc.if_else(plain, pc.utf8_lower(pc.if_else(marked, pc.utf8_slice_codeunits(vocabulary, 0, -1), vocabulary)), vocabulary)
        has = marked.to_numpy(zero_copy_only=False).astype(bool)
        units = np.empty(len(vocabulary) + int(has.sum()), np.int64)
        at = np.arange(len(vocabulary)) + np.cumsum(has) - has
        units[at] = self._codes(core)
        units[at[has] + 1] = self._codes(pc.utf8_slice_codeunits(vocabulary.filter(marked), -1))
        begin, flat = np.array(self.begin), np.array(self.ids, np.uint32)
        count = begin[units + 1] - begin[units]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[units] - (ends - count), count) + np.arange(total)]
        last = at + has  # the last unit of each word
        return np.concatenate([[0], ends[last]]) if len(ends) else np.zeros(1, np.int64), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, document ends, sentence ends): all texts' ids in a row; the ends count ids."""
        offsets, codes, vocabulary = words_of(texts)
        if len(self.code) > CACHE:
            self.clear()
        begin, flat = self._table(vocabulary)
        start, count = begin[:-1], np.diff(begin)
        ends = np.cumsum(count[codes])
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start[codes] - (ends - count[codes]), count[codes]) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        stops = pc.is_in(pc.utf8_slice_codeunits(vocabulary, -1), pa.array(list(".!?…。"), vocabulary.type)).to_numpy(zero_copy_only=False).astype(bool)
        return ids, ends[offsets[1:]], ends[1:][stops[codes]] if len(codes) else np.zeros(0, np.int64)


_tokens: dict[str, WordTokens] = {}


def best_cuts(ends: list[int], costs: list[int], size: int) -> list[int]:
    """Indices of the chosen cuts among the possible ones: ends ascend, none more than size after the one before."""
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (f(i) + c(i), c(i), i), ascending from the left
    push, pop, shift = queue.append, queue.pop, queue.popleft
    before = []
    for j, (c, q) in enumerate(zip(ends, costs)):
        low = c - size
        head = queue[0]
        while head[1] < low:
            shift()
            head = queue[0]
        before.append(head[2])
        f = q + head[0] + size  # f(j) + c(j)
        while queue and queue[-1][0] > f:
            pop()
        push((f, c, j))
    out, j = [], len(ends) - 1
    while j >= 0:
        out.append(j)
        j = before[j]
    return out[::-1]


def tail_lengths(n: int, size: int, cut: int) -> list[int]:
    """Lengths of the last sequences: powers of two where they cost less than padding."""
    bits = [1 << k for k in range(n.bit_length()) if n >> k & 1][::-1]
    return bits if cut * (len(bits) - 1) < size - n else [n]


class Packer:
    """Takes documents' tokens in order and yields rows of pieces."""

    def __init__(self, size: int, sentence_cut: int, forced_cut: int, first_sequence: int):
        self.size, self.sentence_cut, self.forced_cut, self.sequence = size, sentence_cut, forced_cut, first_sequence
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[tuple[int | None, int, int]] = []  # (doc_id, its tokens, tokens already given out)
        self.cuts, self.costs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, doc_ids: list, ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray) -> None:
        """doc_ends and stops count tokens within ids."""
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [(d, int(n), 0) for d, n in zip(doc_ids, np.diff(doc_ends, prepend=0))]
        cuts = np.union1d(doc_ends, stops)
        costs = np.where(np.isin(cuts, doc_ends), 0, self.sentence_cut)
        self.cuts, self.costs = np.concatenate([self.cuts, base + cuts]), np.concatenate([self.costs, costs])

    def _spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The possible cuts, with further ones where two lie more than a window apart."""
        gaps = np.diff(self.cuts, prepend=0)
        if gaps.max(initial=0) <= self.size:
            return self.cuts, self.costs
        extra = np.concatenate([np.arange(c - g + self.size, c, self.size) for c, g in zip(self.cuts[gaps > self.size], gaps[gaps > self.size])])
        cuts = np.union1d(self.cuts, extra)
        costs = np.full(len(cuts), self.forced_cut)
        costs[np.searchsorted(cuts, self.cuts)] = self.costs
        return cuts, costs

    def flush(self, last: bool) -> list[tuple]:
        if not len(self.ids):
            return []
        cuts, costs = self._spaced()
        costs = costs.copy()
        costs[-1] = 0
        ends = [int(cuts[j]) for j in best_cuts(cuts.tolist(), costs.tolist(), self.size)]
        if last:
            begin = ends[-2] if len(ends) > 1 else 0
            lengths = tail_lengths(ends[-1] - begin, self.size, self.sentence_cut)
            ends = ends[:-1] + (begin + np.cumsum(lengths)).tolist()
        else:
            ends = ends[:-1]
        out, at, d = [], 0, 0
        for end in ends:
            offset = 0
            while at < end:
                doc, n, given = self.docs[d]
                take = min(end - at, n - given)
                crc = zlib.crc32(self.ids[at : at + take].astype("<u4").tobytes())
                out.append((doc, given, take, crc, n, self.sequence, offset, end - at + offset))
                at, offset = at + take, offset + take
                if given + take == n:
                    d += 1
                else:
                    self.docs[d] = (doc, n, given + take)
            self.sequence += 1
        self.docs, self.ids = self.docs[d:], self.ids[at:]
        keep = self.cuts > at
        self.cuts, self.costs = self.cuts[keep] - at, self.costs[keep]
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, sentence_cut: int = SENTENCE_CUT, forced_cut: int = FORCED_CUT, stretch: int = STRETCH) -> DataFrame:
    """One row per piece of a document in a sequence; `tokenizer` is the path of a tokenizer file.

    sequence_length, beyond the columns of the contract, is the number of ids of the whole sequence.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        if tokenizer not in _tokens:
            _tokens[tokenizer] = WordTokens(tokenizer)
        packer = Packer(size, sentence_cut, forced_cut, TaskContext.get().partitionId() << 32)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def emit(out):
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, doc_ends, stops = _tokens[tokenizer].encode(part.column("text"))
                ids = np.insert(ids, doc_ends, end)
                more = np.arange(len(doc_ends))
                # a sentence that ends its document is followed by the end token: the cut is after that
                inner = stops[~np.isin(stops, doc_ends)]
                packer.add(part.column("doc_id").to_pylist(), ids, doc_ends + more + 1, inner + np.searchsorted(doc_ends, inner, side="right"))
                if len(packer.ids) >= stretch and (out := packer.flush(False)):
                    yield emit(out)
        if out := packer.flush(True):
            yield emit(out)

    return ranged.mapInArrow(run, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
