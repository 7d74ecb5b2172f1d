"""Exact dedup: a log-structured index of text digests.

The method: documents come in batches. Each batch fills a memtable (the map-side combine of a grouped
aggregation) and is flushed as an immutable run sorted by digest; an entry is a digest, the smallest
identifier of its text and the number of its copies. Texts stay in the documents, which the index
reads again where bytes have to be compared. Compaction merges all runs into one: every run has a
Bloom filter of its digests, and only entries that another run's filter takes are compared with
others. The texts of digests that several runs do hold are grouped again, by digest *and* bytes, and
the smallest identifier stays; a second filter, of these digests, is probed before texts are shuffled.
So no hit rests on a hash: each entry stands for identical bytes, and two texts of one digest are two
entries, told apart by their bytes when they are looked up.

Only DataFrame functions run on the main path. A text that a third of all rows share is combined
within each map task before the shuffle, and the join of documents to the index is one that
adaptive execution can split. A filter has ten bits a digest, up to FILTER_WORDS words of 64 bits; with
more digests it takes more of them, which costs comparisons and loses nothing.

Nulls, ties, odd input: a null text counts as empty; equal rows count each; a null doc_id sorts
last, so it stays only where no other row of its group has an identifier; an empty table gives no
rows; very long texts are compared whole; further columns of the input, whatever their names, are
ignored here and kept by `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, shared_dir, table, text_or_empty, unused, written

#: Batches that `exact_dedup` flushes, and the most words of a filter: 4 MB (fixed values).
BATCHES, FILTER_WORDS = 4, 1 << 19


def normalised(col: str = "text"):
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def word_of(words: int) -> Column:
    """The word of a filter of so many that a digest's bits are in."""
    return F.pmod(F.xxhash64("digest"), F.lit(words)).cast("int")


def bits_of() -> Column:
    """The four bits, some of them equal at times, that a digest sets in its word."""
    h = F.xxhash64("digest", F.lit(1))
    out = F.lit(0).cast("long")
    for i in range(4):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


class Filters:
    """A Bloom filter for each of the runs of digests(run, digest), in one row of a table: columns f0, f1, ... of words."""

    def __init__(self, digests: DataFrame, runs: list[int]):
        spark, self.runs = digests.sparkSession, runs
        most = digests.groupBy("run").count().agg(F.max("count")).first()[0] or 1
        self.words = min(FILTER_WORDS, max(1, -(-10 * most // 64)))
        held = digests.groupBy("run", word_of(self.words).alias("word")).agg(F.bit_or(bits_of()).alias("bits"))
        every = spark.range(self.words).select(F.col("id").cast("int").alias("word"))
        maps = [F.max(F.when(F.col("run") == r, F.col("bits"))).alias("_b" + str(i)) for i, r in enumerate(runs)]
        words = every.join(held.groupBy("word").agg(*maps), "word", "left")
        lists = words.agg(F.array_sort(F.collect_list(F.struct("word", *(F.coalesce(f"_b{i}", F.lit(0).cast("long")).alias(f"b{i}") for i in range(len(runs)))))).alias("_l"))  # FILTER_WORDS at most
        self.row = written(lists.select(*(F.col(f"_l.b{i}").alias(f"f{i}") for i in range(len(runs)))))

    def taken(self, rows: DataFrame, own: str | None = None) -> DataFrame:
        """The rows whose digest a filter takes, that of the run in column own left aside."""
        word, bits, hit = word_of(self.words), bits_of(), F.lit(False)
        probe = rows.withColumns({"_word": word, "_bits": bits}).join(F.broadcast(self.row))  # one row
        for i, r in enumerate(self.runs):
            takes = F.col(f"f{i}")[F.col("_word")].bitwiseAND(F.col("_bits")) == F.col("_bits")
            hit = hit | (takes & (F.col(own) != r) if own else takes)
        return probe.where(hit).select(*rows.columns)


class DigestIndex:
    """An index folder of immutable runs, each sorted by digest, over documents that have been flushed.

    digest is a function of the normalised text; any will do, as bytes decide.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.path, self.digest, self.made = spark, path or shared_dir(spark), digest, 0
        self.runs: list[int] = []
        self.tables: list[DataFrame] = []
        self.sources: list[DataFrame] = []

    def digested(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, norm, digest)"""
        return docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("digest", self.digest(F.col("norm")))

    def _write(self, rows: DataFrame) -> DataFrame:
        return written(rows.select("digest", "keep_id", "size", "run").sortWithinPartitions("run", "digest"), f"{self.path}/from-{self.made:05d}", "run")

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> None:
        """Append the digests of docs, dealt to batches by identifier, as a sorted run for each batch.

        The group key holds the whole normalised text: this is the byte verification within a batch.
        """
        rows = self.digested(docs, id_col, text_col)
        self.sources.append(rows)
        run = (F.pmod(F.xxhash64("id"), F.lit(batches)) + self.made).cast("int")
        groups = rows.withColumn("run", run).groupBy("run", "digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
        self.tables.append(self._write(groups))
        self.runs += range(self.made, self.made + batches)
        self.made += batches

    def entries(self) -> DataFrame:
        """(digest, keep_id, size, run) of all runs."""
        return reduce(DataFrame.unionByName, self.tables)

    def _texts(self, digests: DataFrame) -> DataFrame:
        """(digest, norm, keep_id, size) of all flushed documents with one of digests(digest), grouped by bytes."""
        only = Filters(digests.withColumn("run", F.lit(0)), [0])
        rows = only.taken(reduce(DataFrame.unionByName, self.sources))
        return rows.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))

    def merged(self) -> DataFrame:
        """(digest, keep_id, size): the entries of all runs, those of equal bytes as one."""
        entries = self.entries()
        if len(self.runs) > 1:
            near = Filters(entries, self.runs).taken(entries, "run")
            shared = written(near.groupBy("digest").agg(F.count_distinct("run").alias("n")).where("n > 1").select("digest"))
            again = self._texts(shared).select("digest", "keep_id", "size").join(shared, "digest", "left_semi")
            entries = entries.join(shared, "digest", "left_anti").select("digest", "keep_id", "size").unionByName(again)
        return entries.select("digest", "keep_id", "size")

    def compact(self) -> None:
        """Merge all runs into one."""
        self.tables = [self._write(self.merged().withColumn("run", F.lit(self.made)))]
        self.runs = [self.made]
        self.made += 1

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: bool = False) -> DataFrame:
        """docs (id, digest) with keep_id and size of the entry of equal bytes (null where the text is new); one row per document.

        With own, all docs have been flushed: a digest of one entry then stands for one text, and only
        the bytes of digests with several entries are compared.
        """
        rows, entries = self.digested(docs, id_col, text_col), self.merged()
        if own:
            asked = written(entries.groupBy("digest").count().where("count > 1").select("digest"))
            if asked.isEmpty():
                return rows.drop("norm").join(entries, "digest", "left")
        else:
            near = Filters(self.entries().select("run", "digest"), self.runs).taken(rows.select("digest"))
            asked = written(near.join(entries, "digest", "left_semi").distinct())
        exact = rows.join(self._texts(asked), ["digest", "norm"], "left").drop("norm")
        if not own:
            return exact
        alone = rows.drop("norm").join(asked, "digest", "left_anti").join(entries, "digest", "left")
        return exact.join(asked, "digest", "left_semi").unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(docs.sparkSession)
    index.flush(docs, id_col, text_col, BATCHES)
    index.compact()
    found = index.lookup(docs, id_col, text_col, own=True)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a smaller doc_id has.

    Rows that repeat the doc_id of the one that stays are all kept.
    """
    name = unused(docs, "keep")
    keep = written(exact_dedup(docs).where("kept").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")  # identifiers grow with the table


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
