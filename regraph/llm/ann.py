"""Approximate nearest neighbours by balanced posting lists.

1. Centroids: a sample of at most SAMPLE vectors is halved again and again at the median along the
   axis between two means, so all leaves hold equally many; their means are the centroids (at most
   MAX_LISTS, about one for every LIST_ROWS vectors).
2. Every vector goes to its nearest centroid's posting list and, at a boundary, to further lists whose
   centroid is at most (1 + boundary) times as far: at most COPIES in all, each only if the centroid is
   nearer to the vector than to every centroid that has it already, so copies lie in different directions.
3. Queries find centroids by best-first search in a neighbour graph held in memory (at most
   MAX_LISTS nodes) and select the lists whose centroid is at most (1 + reach) times as far as the
   nearest one: distance-ratio pruning, with no fixed number of lists. A query's beam doubles until
   its farthest centroid lies beyond that ratio, and on while the lists that it selects are the
   nearest ones of fewer than k other vectors.
4. A selected list is read in parts of PART_ROWS vectors; each part gives each query its nearest k,
   in double precision on the original vectors, and a window per query keeps the k best. Blocks of
   queries are multiplied with a part at once; only what can be among the k is measured again exactly.

How much is read depends on the data. On vectors without clusters, as the test tables have (64
dimensions, nearest at 1.0, median at 1.41), a recall of 0.9 takes about half of all rows whatever the lists;
with 51,282 such vectors and 200 lists the ratio 0.12 reads 48 % of the rows for a recall of 0.89, 0.15 reads
70 % for 0.97 and REACH somewhat more. On clustered vectors the same ratio reads a few lists.

Equal vectors: of each distinct vector the k + 1 smallest identifiers are enough, since ties go to
the smaller identifier and a query leaves out only its own row. That keeps a vector shared by a
third of all rows from filling a list; no result is lost by it.

Nulls, ties, odd input: vectors that are null, all zero, hold null or non-finite components or have
another length than most take no part; ties go to the smaller identifier; rows repeating a vec_id
count once; fewer than k candidates give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SAMPLE, LIST_ROWS, MAX_LISTS, PART_ROWS = 20_000, 256, 4096, 8192
BOUNDARY, COPIES, REACH, DEGREE, BEAM, EXPANDED = 0.05, 8, 0.18, 24, 64, 16


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as doubles."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(whole & F.exists("v", lambda x: x != 0))


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of equally large leaves: each half is cut at the median along the axis between two means."""
    leaves, rng = [sample], np.random.default_rng(5)
    while len(leaves) < lists and max(map(len, leaves)) >= 2:
        leaves.sort(key=len)
        x = leaves.pop()
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            near = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        order = np.argsort(x @ (b - a), kind="stable")
        leaves += [x[order[: len(x) // 2]], x[order[len(x) // 2 :]]]
    return np.array([x.mean(0) for x in leaves if len(x)])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def neighbour_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each centroid its nearest ones and a few spread at random, which keep the graph connected."""
    n = len(centroids)
    near = np.argsort(squares(centroids, centroids), axis=1)[:, 1 : degree + 1]
    far = np.random.default_rng(6).integers(0, n, (n, 4))
    ring = (np.arange(n)[:, None] + 1) % n
    return np.concatenate([near, far, ring], axis=1)


def graph_search(q: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) of each query's beam, nearest first: best-first search, a batch at a time."""
    n, many = len(centroids), len(q)
    beam = min(beam, n)
    wide = min(EXPANDED, n)  # nodes that a query expands in one step
    seen, grown = np.zeros((many, n), bool), np.zeros((many, n), bool)
    dist = np.full((many, n), np.inf)

    def visit(row: np.ndarray, at: np.ndarray) -> None:
        new = np.unique((row * n + at)[~seen[row, at]])
        row, at = new // n, new % n
        for a in range(0, len(new), 1 << 16):
            r, c = row[a : a + (1 << 16)], at[a : a + (1 << 16)]
            dist[r, c] = np.sqrt(((q[r] - centroids[c]) ** 2).sum(1))
        seen[row, at] = True

    start = np.linspace(0, n - 1, min(n, 8)).astype(int)
    visit(np.repeat(np.arange(many), len(start)), np.tile(start, many))
    while True:
        open_ = np.where(seen & ~grown, dist, np.inf)
        best = np.argpartition(open_, wide - 1, axis=1)[:, :wide]
        worst = np.partition(dist, beam - 1, axis=1)[:, beam - 1 : beam]
        d = np.take_along_axis(open_, best, 1)
        row, at = np.nonzero(np.isfinite(d) & (d <= worst))
        if not len(row):
            break
        at = best[row, at]
        grown[row, at] = True
        visit(np.repeat(row, graph.shape[1]), graph[at].ravel())
    order = np.argsort(dist, axis=1)[:, :beam]
    return order, np.take_along_axis(dist, order, 1)


def lists_of(q: np.ndarray, centroids: np.ndarray, graph: np.ndarray, sizes: np.ndarray, least: int, reach: float = REACH, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, centroid) of all lists to read: those within the ratio, and the next ones while sizes of nearer ones sum to less than `least`."""
    open_, rows, lists = np.arange(len(q)), [np.zeros(0, int)], [np.zeros(0, int)]
    while len(open_):
        at, d = graph_search(q[open_], centroids, graph, beam)
        before = np.cumsum(sizes[at], axis=1) - sizes[at]
        take = (d <= d[:, :1] * (1 + reach) + 1e-12) | (before < least)
        done = ~take[:, -1] | (beam >= len(centroids))
        row, col = np.nonzero(take & done[:, None])
        rows.append(open_[row])
        lists.append(at[row, col])
        open_, beam = open_[~done], beam * 2
    return np.concatenate(rows), np.concatenate(lists)


def boundary_lists(x: np.ndarray, c: np.ndarray, boundary: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, centroid, whether its nearest) of the lists that get each vector."""
    d, between = np.sqrt(squares(x, c)), np.sqrt(squares(c, c))
    near = np.argsort(d, axis=1, kind="stable")[:, : 4 * COPIES]
    far = np.take_along_axis(d, near, 1)
    ok = far <= far[:, :1] * (1 + boundary) + 1e-12
    for j in range(1, near.shape[1]):
        for i in range(j):
            ok[:, j] &= ~ok[:, i] | (between[near[:, j], near[:, i]] > far[:, j])
    ok &= np.cumsum(ok, axis=1) <= COPIES
    row, col = np.nonzero(ok)
    return row, near[row, col], col == 0


def best_of(q: np.ndarray, asked: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest rows of x to each query but itself, ties to the smaller id."""
    near = squares(q, x)
    near[asked[:, None] == ids] = np.inf
    # rounding of the product: what is this much beyond the k-th can be among the k
    slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
    limit = np.partition(near, k - 1, axis=1)[:, k - 1] + slack if len(ids) > k else np.full(len(q), np.inf)
    row, at = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
    d = np.sqrt(((x[at] - q[row]) ** 2).sum(1))
    order = np.lexsort((ids[at], d, row))
    row, at, d = row[order], at[order], d[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return asked[row[rank < k]], ids[at[rank < k]], d[rank < k]


def matrix_of(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fitted(rows: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids fitted on at most `sample` vectors, those whose hashed identifier is smallest."""
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    return balanced_centroids(matrix_of(few.column("v")), min(MAX_LISTS, max(1, n // LIST_ROWS), max(1, len(few) // 4)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, boundary: float = BOUNDARY, reach: float = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors but itself."""
    spark = vectors.sparkSession
    vectors, queries = usable(vectors), usable(queries)
    sizes = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["n"]
    ids = Window.partitionBy("key").orderBy("vec_id")  # row_number below a bound: cut down before the shuffle too
    distinct = vectors.where(F.size("v") == dim).dropDuplicates(["vec_id"]).withColumn("key", F.sha2(F.to_binary(F.array_join("v", ","), F.lit("utf-8")), 256))
    base = written(distinct.withColumn("_n", F.row_number().over(ids)).where(F.col("_n") <= k + 1).select("vec_id", "v"))
    asked = queries.where(F.size("v") == dim).dropDuplicates(["vec_id"])
    n = base.count()
    centroids = fitted(base, n)
    sent = spark.sparkContext.broadcast((centroids, neighbour_graph(centroids)))  # at most MAX_LISTS centroids

    def post(batches):
        c, _ = sent.value
        for batch in batches:
            x = matrix_of(batch.column("v"))
            row, at, home = boundary_lists(x, c, boundary)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(home)], names=["list", "vec_id", "v", "home"])

    def choose(batches):
        c, graph = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                row, at = lists_of(matrix_of(part.column("v")), c, graph, homes.value, k + 1, reach)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row))], names=["list", "vec_id", "v"])

    shape = "list int, vec_id long, v array<double>"
    postings = written(base.mapInArrow(post, shape + ", home boolean"))
    sizes = np.zeros(len(centroids), np.int64)
    for r in postings.where("home").groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    homes = spark.sparkContext.broadcast(sizes)
    parts = F.broadcast(postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")))  # at most MAX_LISTS rows
    dealt = postings.join(parts, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    probes = asked.mapInArrow(choose, shape).join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            x, ids = matrix_of(right.column("v")), right.column("vec_id").to_numpy()
            q, asked = matrix_of(left.column("v")), left.column("vec_id").to_numpy()
            out += [best_of(q[a : a + 256], asked[a : a + 256], x, ids, k) for a in range(0, len(q), 256)]
        query, vec, score = map(np.concatenate, zip(*out))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    found = probes.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
