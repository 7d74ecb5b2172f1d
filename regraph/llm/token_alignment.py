"""Operator 11: alignment of two tokenizers' tokens by their ends in bytes.

Every byte of a text gets a label: 0 where no token ends, 1 where one of tokenizer A ends, 2 where one
of B ends, 3 where both do. A regular expression scans the labels for spans up to each 3; a span's
labels count the A and B tokens of a group. Each label but 0 also ends one link, the overlap of one A
and one B token.

Neither tokenizer merges across a single space between two characters that are no white space (A's
pattern splits there; `crossing` finds no piece of B that would), so a text is cut there into chunks,
equal chunks are tokenized, labelled and scanned once a block of texts, and a text's tokens are those
of its chunks in order. Where B has a piece that crosses, a text is one chunk.

How often an id pair is linked is counted over all blocks: a block sends each of its different pairs
once, with their number; counts come back to the block by a join and a text adds up those of its
chunks. Nothing that grows with the corpus is broadcast or held by one task; a block is at most
`BLOCK` bytes of text or one document.

Null and empty texts and those that either tokenizer does not give back byte by byte have no tokens.
Texts of any length are tokenized whole. Rows that repeat a doc_id stay rows of their own, whose
links all count; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_slices, written

#: Bytes of text in a block.
BLOCK = 8 << 20

#: Chunks a task remembers.
CACHE = 100_000

#: White space of any tokenizer's pattern; text is never cut beside it (a few more than Unicode has).
BLANK = re.compile(r"[\s\x1c-\x1f\x85\u180e\u200b\ufeff]")

#: A span of labels up to one where tokens of both end.
SPAN = re.compile(rb"[^\x03]*\x03")

BLOCKS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks array<int>, "
    "pairs array<long>, pair_links array<long>, chunk_starts array<int>, chunk_links array<int>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def bytes_of_level(token: str, table_: dict[str, int]) -> bytes:
    return bytes(table_[c] for c in token)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def label_string(ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """One label a byte, from the offsets where tokens end (each after its last byte)."""
    labels = np.zeros(int(ends_a[-1]), np.uint8)
    labels[ends_a - 1] |= 1
    labels[ends_b - 1] |= 2
    return labels.tobytes()


def scanned(labels: bytes) -> list[tuple[int, int]]:
    """(A tokens, B tokens) of each group."""
    return [(span.count(1) + 1, span.count(2) + 1) for span in SPAN.findall(labels)]


class Alignments:
    """What is made of some chunks: by chunk whether it is given back, its numbers of tokens and groups and its groups as text; links, as A id * n_b + B id, lie one after another."""

    def __init__(self, good: np.ndarray, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray):
        """a, b: ids of the good chunks one after another; sizes: how many each chunk has, 0 if not good."""
        n = len(good)
        self.good, self.n_a, self.n_b = good, sizes_a, sizes_b
        self.n_groups, self.n_links = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.texts, self.links = [""] * n, np.zeros(0, np.int64)
        if not len(a):
            return
        labels = label_string(np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b]))  # a chunk's bytes are as many for both
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        parts, ends = [], []
        at_a = at_b = 0
        for x, y in scanned(labels):
            parts.append(f"{names_a[at_a]}|{names_b[at_b]}" if x == y == 1 else ",".join(names_a[at_a : at_a + x]) + "|" + ",".join(names_b[at_b : at_b + y]))
            at_a, at_b = at_a + x, at_b + y
            ends.append(at_a)
        stops = np.searchsorted(np.array(ends), np.cumsum(sizes_a[good]))  # the last group of each good chunk
        first = 0
        for c, last in zip(np.flatnonzero(good).tolist(), stops.tolist()):
            self.texts[c] = ";".join(parts[first : last + 1])
            self.n_groups[c] = last + 1 - first
            first = last + 1
        marks = np.frombuffer(labels, np.uint8)
        marks = marks[marks != 0].astype(np.int64)
        of_a, of_b = np.cumsum(marks & 1) - (marks & 1), np.cumsum(marks >> 1) - (marks >> 1)
        self.links = a[of_a] * len(lengths_b) + b[of_b]
        self.n_links[good] = sizes_a[good] + sizes_b[good] - self.n_groups[good]  # one more end of a link for each token, but both in one at a group's end


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread keeps memory of its own
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(vocabulary.values(), default=0))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes_of_level(token, letters)
        self.n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        self.crossing = any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i))

    def align(self, chunks: list[str]) -> Alignments:
        """Alignments of texts that begin with a space; good are those that both tokenizers give back."""
        good, a, b = [], [], []
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        ids_b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for c, e, y in zip(chunks, self.a.encode_batch_fast(chunks, add_special_tokens=False), ids_b):
            x, whole = e.ids, c.encode()
            same = b"".join(map(of_a, x)) == whole == b"".join(map(of_b, y))
            good.append(same)
            a.append(x if same else [])
            b.append(y if same else [])
        flat = [np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b)]
        sizes = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b)]
        return Alignments(np.array(good, bool), flat[0], sizes[0], flat[1], sizes[1], self.lengths_a, self.lengths_b)


def chunked(texts: pa.Array, whole: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, chunks): text i, with a space before it, is chunks[c] for c in codes[offsets[i]:offsets[i + 1]], joined.

    Null and empty texts have none. Chunks begin with a space; with `whole` a text is one chunk.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if whole:
        coded, offsets = pc.dictionary_encode(texts), np.arange(len(texts) + 1)
        codes, chunks = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    else:
        lists = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(lists.flatten())
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        codes, chunks = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        open_ = np.array([bool(c) and not BLANK.match(c[0]) for c in chunks] or [True])
        shut = np.array([bool(c) and not BLANK.match(c[-1]) for c in chunks] or [True])
        cut = np.zeros(len(codes) + 1, bool)  # whether a chunk begins at a piece
        cut[1:-1] = shut[codes[:-1]] & open_[codes[1:]]
        cut[offsets] = True
        first = np.flatnonzero(cut)[:-1] if len(codes) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(codes)))
        own = codes[first]
        known: dict[str, int] = {}
        for k in np.flatnonzero(size > 1).tolist():  # white space beside a space: pieces stay together
            c = " ".join([chunks[x] for x in codes[first[k] : first[k] + size[k]].tolist()])
            if c not in known:
                known[c] = len(chunks)
                chunks.append(c)
            own[k] = known[c]
        offsets, codes = np.searchsorted(first, offsets), own
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    if empty.any():
        sizes = np.diff(offsets)
        codes = codes[~np.repeat(empty, sizes)]
        offsets = np.r_[0, np.cumsum(np.where(empty, 0, sizes))]
    used, codes = np.unique(codes, return_inverse=True)
    return offsets, codes, [" " + chunks[u] for u in used.tolist()]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]."""
    before = np.r_[0, np.cumsum(values)]
    return before[offsets[1:]] - before[offsets[:-1]]  # of booleans, how many hold


class Memory:
    """Alignments of chunks that a task has met before: of those that came at least twice in a block, up to CACHE."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.good, self.facts, self.texts = np.zeros(0, bool), np.zeros((4, 0), np.int64), []
        self.links = np.zeros(0, np.int64)

    def aligned(self, both: Aligner, chunks: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(good, facts, texts, links) of the chunks; facts are rows of n_a, n_b, n_groups and n_links."""
        met = [self.at.get(c, -1) for c in chunks]
        new = [c for c, k in zip(chunks, met) if k < 0]
        found: list[Alignments] = []
        at = 0
        while at < len(new):  # some tokens at a time
            end, size = at, 0
            while end < len(new) and (end == at or size < 1 << 16):
                size += len(new[end])
                end += 1
            found.append(both.align(new[at:end]))
            at = end
        good = np.concatenate([self.good, *(x.good for x in found)])
        facts = np.hstack([self.facts, *(np.vstack([x.n_a, x.n_b, x.n_groups, x.n_links]) for x in found)])
        texts = self.texts + [t for x in found for t in x.texts]
        links = np.concatenate([self.links, *(x.links for x in found)])
        order = np.array(met, np.int64)
        order[order < 0] = len(self.texts) + np.arange(len(new))
        starts = np.cumsum(facts[3]) - facts[3]
        if len(self.at) < CACHE:
            keep = np.r_[np.arange(len(self.texts)), order[(order >= len(self.texts)) & (times >= 2)]][:CACHE]
            names = dict(zip(order.tolist(), chunks))
            self.at |= {names[k]: i for i, k in enumerate(keep.tolist()) if i >= len(self.texts)}
            self.links = links[ragged(starts[keep], facts[3][keep])]
            self.good, self.facts, self.texts = good[keep], facts[:, keep], [texts[k] for k in keep.tolist()]
        return good[order], facts[:, order], [texts[k] for k in order.tolist()], links[ragged(starts[order], facts[3][order])]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] to starts[i] + sizes[i], one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


_aligners: dict = {}


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK) -> DataFrame:
    """A row a document, and one a block (doc_id null, pairs not null) with its different pairs and the pairs of each chunk."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.strip().split()[0] for x in BLOCKS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(x.strip().split()[0], kinds[x.strip().split()[1]]) for x in BLOCKS.split(", ")])

    def lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def run(batches):
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        both = _aligners[path_a, path_b]
        memory = Memory()
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, "text", block_bytes):
                offsets, codes, texts = chunked(part.column("text"), both.crossing)
                docs_n = len(part)
                good, facts, groups, links = memory.aligned(both, texts, np.bincount(codes, minlength=len(texts)))
                stay = sums(~good[codes], offsets) == 0
                sizes = np.where(stay, np.diff(offsets), 0)
                codes, offsets = codes[np.repeat(stay, np.diff(offsets))], np.r_[0, np.cumsum(sizes)]
                digests = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    digests.append(hashlib.sha256(";".join([groups[c] for c in codes[a:b].tolist()]).encode()).hexdigest() if b > a else "")
                starts = np.r_[0, np.cumsum(facts[3])]
                pairs, which = np.unique(links, return_inverse=True)
                times = np.bincount(codes, minlength=len(good))
                number = np.bincount(which, np.repeat(times, facts[3]), len(pairs)).astype(np.int64)
                order = codes[np.lexsort((codes, np.repeat(np.arange(docs_n), sizes)))]  # order does not matter to sums, but packs better
                cols = [sums(x[codes], offsets) for x in facts]
                rest = {n: pa.nulls(docs_n, schema.field(n).type) for n in names[8:]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(docs_n, block)), part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(digests, pa.string()), lists(order, offsets, pa.int32()), *rest.values()],
                    schema=schema,
                )
                one = lambda v, kind: lists(v, np.array([0, len(v)]), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *(pa.nulls(1, schema.field(n).type) for n in names[1:8]), one(pairs, pa.int64()), one(number, pa.int64()), one(starts, pa.int32()), one(which, pa.int32())],
                    schema=schema,
                )
                block += 1

    return rows.mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): how many links hold each id pair, and whether that is the most of its B id; pair is A id * n_b + B id."""
    sent = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p"))
    counts = sent.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_links").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair") % n_b))  # a B id has at most as many rows as A has ids
    return counts.withColumn("best", F.col("count") == most)


def aligned(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK) -> DataFrame:
    """One row per document: its tokens, groups and links, and how common its links are in all documents.

    n_best counts links whose count is the highest of their B id, ties included; count_sum adds up the
    counts of all links.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = written(aligned_blocks(docs, path_a, path_b, block_bytes), options={"compression": "zstd"})
    counts = pair_counts(blocks, n_b)
    asked = blocks.where("pairs is not null").select("block", F.explode("pairs").alias("pair"))
    told = asked.join(counts, "pair").select(F.col("block").alias("to"), "pair", "count", "best")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def add(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows, told = rows.combine_chunks(), told.combine_chunks()
        head = rows.filter(pc.is_valid(rows.column("pairs")))
        rows = rows.filter(pc.is_null(rows.column("pairs")))
        pair = told.column("pair").to_numpy()
        order = np.argsort(pair)
        count, best = told.column("count").to_numpy()[order], told.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        flat = lambda df, name: df.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        starts, links = flat(head, "chunk_starts"), flat(head, "chunk_links")
        sizes = pc.fill_null(pc.list_value_length(rows.column("chunks")), 0).to_numpy()
        chunks, offsets = flat(rows, "chunks"), np.r_[0, np.cumsum(sizes)]
        of_best, of_sum = (sums(x[links], starts) if len(links) else np.zeros(max(1, len(starts) - 1), np.int64) for x in (best, count))
        cols = [rows.column(n) for n in names[:5]] + [pa.array(sums(x[chunks], offsets), pa.int64()) for x in (of_best, of_sum)] + [rows.column("groups_sha256")]
        return pa.table(cols, names=names)

    return blocks.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(add, RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
