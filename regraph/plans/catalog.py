"""All queries over the provided tables, and the SQL that checks them.

Queries are thin: fixtures of `sources.fixtures`, one operator, aliases. The SQL is written on its
own, as joins and groupings of the same definitions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.states import FeatureSet
from ..operators import agglomeration as ag
from ..operators import graph as gr
from ..operators import labels as lb
from ..operators import overlap as ov
from ..operators import rag as rg
from ..operators import stencil as st
from ..operators.blocks import region_states
from ..operators.growing import absorbed
from ..sources.fixtures import GROWN_SQL, RAG_SQL, SYN_SQL, VOX_SQL, grown_grid, load, part_graph, part_tasks, synapse_points, voxel_grid

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def with_vox(body: str) -> str:
    return f"WITH {VOX_SQL} {body}"


#: (x, y, z, label, nbr, p0, p1) of all six faces; nbr 0 outside.
NEAR_SQL = """
o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dx, dy, dz)
), near AS (
  SELECT a.x, a.y, a.z, a.seg AS label, coalesce(b.seg, 0) AS nbr, a.p0, a.p1
  FROM vox a CROSS JOIN o LEFT JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz
)"""


def with_near(body: str) -> str:
    return f"WITH {VOX_SQL}, {NEAR_SQL} {body}"


def with_rag(body: str) -> str:
    return f"WITH {RAG_SQL} {body}"


CONT_SQL = "c AS (SELECT CAST(seg AS BIGINT) seg, CAST(gt AS BIGINT) gt, count(*) n FROM vox WHERE seg <> 0 AND gt <> 0 GROUP BY 1, 2)"
VI_SQL = CONT_SQL + """,
t AS (SELECT *, sum(n) OVER (PARTITION BY seg) ss, sum(n) OVER (PARTITION BY gt) gs, sum(n) OVER () nn FROM c),
v AS (SELECT *, n / nn * log2(ss / n) AS m, n / nn * log2(gs / n) AS s FROM t)"""


# --- region graphs from voxels -------------------------------------------------------------------


@query(with_near("""SELECT CAST(label AS BIGINT) id, count(*) size, CAST(sum(b) AS BIGINT) boundary_size, round(sum(p0), 6) sum_p0
FROM (SELECT x, y, z, label, p0, max(CASE WHEN nbr = 0 THEN 1 ELSE 0 END) b FROM near WHERE label <> 0 GROUP BY x, y, z, label, p0) GROUP BY 1"""))
def rag_nodes(spark, sf):
    out = rg.rag_nodes(voxel_grid(spark, sf), ("p0",))
    return out.select("id", "size", "boundary_size", F.round("p0_s1", 6).alias("sum_p0"))


@query(with_near("""SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, count(*) edge_size, round(sum(p0), 6) sum_p0
FROM (SELECT DISTINCT x, y, z, label, nbr, p0 FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr) GROUP BY 1, 2"""))
def rag_edges(spark, sf):
    out = rg.rag_edges(voxel_grid(spark, sf), ("p0",))
    return out.select("node1", "node2", "edge_size", F.round("p0_s1", 6).alias("sum_p0"))


@query(with_near("""SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, CAST(sum(CASE WHEN label > nbr THEN 1 ELSE 0 END) AS BIGINT) edge_size
FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr AND x BETWEEN 1 AND 22 AND y BETWEEN 1 AND 22 AND z BETWEEN 2 AND 6 GROUP BY 1, 2"""))
def batch_edges(spark, sf):
    return rg.batch_edges(voxel_grid(spark, sf), (1, 1, 2), (22, 22, 6))


@query(with_near("""SELECT id, CAST(sum(s) AS BIGINT) size FROM (
 SELECT CAST(seg AS BIGINT) id, 1 s FROM vox WHERE seg <> 0 AND x BETWEEN 1 AND 22 AND y BETWEEN 1 AND 22 AND z BETWEEN 2 AND 6
 UNION ALL SELECT CAST(nbr AS BIGINT), 0 FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr AND x BETWEEN 1 AND 22 AND y BETWEEN 1 AND 22 AND z BETWEEN 2 AND 6
) GROUP BY id"""))
def batch_nodes(spark, sf):
    return rg.batch_nodes(voxel_grid(spark, sf), (1, 1, 2), (22, 22, 6))


@query(with_near("""SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, CAST(sum(CASE WHEN label > nbr THEN 1 ELSE 0 END) AS BIGINT) edge_size
FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr GROUP BY 1, 2"""))
def merged_block_edges(spark, sf):
    """The graph of two half volumes, each with the other's border as halo, merged: equal to the whole's."""
    v = voxel_grid(spark, sf)
    parts = [rg.batch_edges(v.where(f"x between {a - 1} and {b + 1}"), (a, -1, -1), (b, 99, 99)) for a, b in ((0, 11), (12, 23))]
    return rg.merged_blocks(*parts)


@query(with_vox("""SELECT CAST(seg AS BIGINT) id, count(*) size, round(avg(p1), 6) fraction, CASE WHEN round(avg(p1), 6) >= 0.35 THEN 2 ELSE 1 END mito_type FROM vox WHERE seg <> 0 GROUP BY 1"""))
def mito_nodes(spark, sf):
    return rg.mito_nodes(voxel_grid(spark, sf))


@query(with_vox("""SELECT CAST(x - 1 AS INT) x, CAST(y - 1 AS INT) y, CAST(z - 2 AS INT) z, seg FROM vox WHERE x BETWEEN 1 AND 22 AND y BETWEEN 1 AND 22 AND z BETWEEN 2 AND 6"""))
def unpadded_volume(spark, sf):
    return rg.unpadded(voxel_grid(spark, sf), (1, 1, 2), (22, 22, 6)).select("x", "y", "z", "seg")


@query(with_vox("""SELECT CAST(x - 4 AS INT) x, CAST(y - 4 AS INT) y, CAST(z - 4 AS INT) z, seg FROM vox WHERE x BETWEEN 4 AND 19 AND y BETWEEN 4 AND 19 AND z BETWEEN 4 AND 19"""))
def cropped_volume(spark, sf):
    return st.cropped(voxel_grid(spark, sf), 16, 24).select("x", "y", "z", "seg")


@query(with_vox("""SELECT CAST(least(CASE WHEN seg = gt THEN 0 ELSE seg END, gt) AS BIGINT) node1, CAST(greatest(CASE WHEN seg = gt THEN 0 ELSE seg END, gt) AS BIGINT) node2, count(*) edge_size
FROM vox WHERE seg <> 0 AND gt <> 0 GROUP BY 1, 2"""))
def border_edges(spark, sf):
    return rg.border_graph(voxel_grid(spark, sf))


@query(with_near("""SELECT node1, node2, x, y, z, strength FROM (
 SELECT *, row_number() OVER (PARTITION BY node1, node2 ORDER BY strength DESC, z) k FROM (
  SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, z, CAST(count(*) AS DOUBLE) AS strength,
         max(y * 1000 + x) // 1000 y, max(y * 1000 + x) % 1000 x
  FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr GROUP BY 1, 2, z)) WHERE k = 1"""))
def edge_locations(spark, sf):
    return rg.edge_locations(voxel_grid(spark, sf))


@query(with_near("""SELECT node1, node2, x, y, z, strength FROM (
 SELECT *, row_number() OVER (PARTITION BY node1, node2 ORDER BY strength DESC, z) k FROM (
  SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, z, round(sum(1 - p0), 6) AS strength,
         max(y * 1000 + x) // 1000 y, max(y * 1000 + x) % 1000 x
  FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr GROUP BY 1, 2, z)) WHERE k = 1"""))
def edge_locations_by_channel(spark, sf):
    return rg.edge_locations(voxel_grid(spark, sf), "p0")


CUT_SQL = "cut AS (SELECT x, y, z, CASE WHEN max(CASE WHEN nbr <> 0 AND nbr <> label THEN 1 ELSE 0 END) = 1 THEN 0 ELSE max(label) END seg FROM near GROUP BY x, y, z)"


@query(with_near(f", {CUT_SQL} SELECT * FROM cut").replace(" , cut", ", cut"))
def boundary_voxels(spark, sf):
    return rg.boundary_cut(voxel_grid(spark, sf))


@query(with_near(f""", {CUT_SQL} SELECT c.x, c.y, c.z, CASE WHEN EXISTS (
 SELECT 1 FROM cut h WHERE h.seg = 0 AND (h.x - c.x) ** 2 + (h.y - c.y) ** 2 + (h.z - c.z) ** 2 <= 1) THEN 0 ELSE c.seg END seg FROM cut c""").replace(" , cut", ", cut"))
def dilated_boundary(spark, sf):
    return rg.dilated_edges(voxel_grid(spark, sf), 2)


@query(with_vox("""SELECT x, y, z, CASE WHEN count(*) OVER (PARTITION BY seg) < 150 AND seg <> 102 THEN 0 ELSE seg END seg FROM vox"""))
def small_regions_removed(spark, sf):
    keep = spark.createDataFrame([(102,)], "id int")
    return rg.without_small(voxel_grid(spark, sf), 150, keep).select("x", "y", "z", "seg")


@query(with_vox("""SELECT x, y, z, CASE WHEN seg IN (1, 5, 101) THEN 0 ELSE seg END seg FROM vox"""))
def exclusions_applied(spark, sf):
    gone = spark.createDataFrame([(1, 0), (5, 0), (101, 0)], "old int, new int")
    return gr.relabelled(voxel_grid(spark, sf), gone, "seg").select("x", "y", "z", "seg")


@query(with_vox("""SELECT seg AS id, count(*) size FROM vox GROUP BY seg"""))
def region_sizes(spark, sf):
    return voxel_grid(spark, sf).groupBy(F.col("seg").alias("id")).agg(F.count(F.lit(1)).alias("size"))


@query(with_vox("""SELECT seg, count(*) n, round(avg(p0), 6) mean_p0 FROM vox WHERE seg <> 0 AND x BETWEEN 6 AND 17 AND y BETWEEN 6 AND 17 AND z BETWEEN 2 AND 6 GROUP BY seg"""))
def roi_statistics(spark, sf):
    return st.in_box(voxel_grid(spark, sf), (6, 6, 2), (17, 17, 6)).where("seg != 0").groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p0"), 6).alias("mean_p0"))


# --- features ------------------------------------------------------------------------------------


MOMENT_SQL = """round(avg(v), 5) m1, round(avg(v ** 2) - avg(v) ** 2, 5) m2, round(avg(v ** 3) - 3 * avg(v) * avg(v ** 2) + 2 * avg(v) ** 3, 5) m3,
 round(avg(v ** 4) - 4 * avg(v) * avg(v ** 3) + 6 * avg(v) ** 2 * avg(v ** 2) - 3 * avg(v) ** 4, 5) m4"""


def _moments(df, n, c):
    return [F.round(m, 5).alias(f"m{i + 1}") for i, m in enumerate(ft.moments(n, [f"{c}_s{k}" for k in (1, 2, 3, 4)]))]


@query(with_vox(f"SELECT CAST(seg AS BIGINT) id, count(*) n, {MOMENT_SQL} FROM (SELECT seg, p0 v FROM vox WHERE seg <> 0) GROUP BY 1"))
def node_moments(spark, sf):
    sums = voxel_grid(spark, sf).where("seg != 0").groupBy(F.col("seg").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"), *rg.power_sums(("p0",)))
    return sums.select("id", "n", *_moments(sums, "n", "p0"))


@query(with_near(f"""SELECT node1, node2, count(*) n, {MOMENT_SQL} FROM (
 SELECT DISTINCT x, y, z, label, nbr, CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, p1 v FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr
) GROUP BY 1, 2"""))
def edge_moments(spark, sf):
    e = rg.rag_edges(voxel_grid(spark, sf), ("p1",))
    return e.select("node1", "node2", F.col("edge_size").alias("n"), *_moments(e, "edge_size", "p1"))


HIST_SQL = "h AS (SELECT CAST(seg AS BIGINT) seg, CAST(least(floor(p0 * 25), 24) AS INT) bin, count(*) n FROM vox WHERE seg <> 0 GROUP BY 1, 2)"


@query(with_vox(f", {HIST_SQL} SELECT seg, bin, n AS count FROM h").replace(" , h", ", h"))
def node_histogram(spark, sf):
    return ft.histogram(voxel_grid(spark, sf).where("seg != 0"), "seg", "p0", 25)


@query(with_vox(f""", {HIST_SQL}, q AS (SELECT *, sum(n) OVER (PARTITION BY seg ORDER BY bin) cum, sum(n) OVER (PARTITION BY seg) tot FROM h)
SELECT seg, threshold, round((bin + (threshold * tot - (cum - n)) / n) / 25, 6) AS value
FROM q CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) threshold) WHERE cum >= threshold * tot AND cum - n < threshold * tot""").replace(" , h", ", h"))
def node_percentiles(spark, sf):
    h = ft.histogram(voxel_grid(spark, sf).where("seg != 0"), "seg", "p0", 25)
    return ft.percentiles(h, "seg", 25, [0.1, 0.3, 0.5, 0.7, 0.9])


LEN_SQL = """len AS (SELECT node1 id, edge_size l FROM edges UNION ALL SELECT node2, edge_size FROM edges UNION ALL SELECT id, boundary_size FROM nodes WHERE boundary_size > 0)"""


@query(with_rag(f""", {LEN_SQL}, r AS (SELECT id, l, row_number() OVER (PARTITION BY id ORDER BY l DESC) k FROM (SELECT DISTINCT id, l FROM len)),
s AS (SELECT id, sum(l) t FROM len GROUP BY id)
SELECT a.id, round(a.l / t, 6) largest_share, round(b.l / a.l, 6) second_share FROM r a JOIN s ON s.id = a.id LEFT JOIN r b ON b.id = a.id AND b.k = 2 WHERE a.k = 1""").replace(" , len", ", len"))
def node_inclusiveness(spark, sf):
    return ft.inclusiveness(*part_graph(spark, sf))


@query("""SELECT * FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'zero']) AS feature, unnest([round(stddev_pop(l_quantity), 6), round(stddev_pop(l_discount), 6), round(stddev_pop(l_tax), 6), 0.0]) AS deviation,
 unnest([stddev_pop(l_quantity) < 0.001, stddev_pop(l_discount) < 0.001, stddev_pop(l_tax) < 0.001, true]) AS useless FROM lineitem)""")
def feature_screen(spark, sf):
    rows = load(spark, sf, "lineitem").withColumn("zero", F.lit(1.0))
    return ft.feature_screen(rows, ["l_quantity", "l_discount", "l_tax", "zero"])


@query("""SELECT user_id, count(*) n, round(sum(value), 6) s1, round(sum(value * value), 6) s2, round(avg(value), 6) mean FROM events GROUP BY user_id""")
def merged_states(spark, sf):
    """States of hourly blocks, merged by addition: equal to those of all rows."""
    e = load(spark, sf, "events")
    blocks = e.groupBy(F.date_trunc("hour", "ts").alias("block"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    total = blocks.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    return total.select("user_id", "n", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), F.round(F.col("s1") / F.col("n"), 6).alias("mean"))


@query("""SELECT l_quantity, l_discount, min(l_orderkey * 100 + l_linenumber) first_row FROM lineitem GROUP BY 1, 2""")
def distinct_feature_rows(spark, sf):
    from ..operators.learning import first_of_equal

    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node1"), F.col("l_linenumber").alias("node2"), F.array("l_quantity", "l_discount").alias("features"))
    return first_of_equal(rows).select(F.col("features")[0].alias("l_quantity"), F.col("features")[1].alias("l_discount"), (F.col("node1") * 100 + F.col("node2")).alias("first_row"))


# --- two labellings ------------------------------------------------------------------------------


@query(with_vox(f", {CONT_SQL} SELECT seg, gt, n AS count FROM c").replace(" , c", ", c"))
def contingency(spark, sf):
    return ov.contingency(voxel_grid(spark, sf))


@query(with_vox(f", {VI_SQL} SELECT round(sum(m), 6) AS merge, round(sum(s), 6) AS split FROM v").replace(" , c", ", c"))
def variation_of_information(spark, sf):
    return ov.variation_of_information(ov.contingency(voxel_grid(spark, sf)))


@query(with_vox(f", {VI_SQL} SELECT seg AS id, round(sum(m), 6) AS vi FROM v GROUP BY seg").replace(" , c", ", c"))
def vi_by_segment(spark, sf):
    return ov.vi_by_label(ov.contingency(voxel_grid(spark, sf)), "seg")


@query(with_vox(f", {VI_SQL} SELECT gt AS id, round(sum(s), 6) AS vi FROM v GROUP BY gt").replace(" , c", ", c"))
def vi_by_ground_truth(spark, sf):
    return ov.vi_by_label(ov.contingency(voxel_grid(spark, sf)), "gt")


@query(with_vox(f""", {VI_SQL}, b AS (SELECT seg id, round(sum(m), 6) vi FROM v GROUP BY seg),
r AS (SELECT id, vi, round(sum(vi) OVER () - coalesce(sum(vi) OVER (ORDER BY vi DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "left" FROM b)
SELECT id, vi, "left" FROM r WHERE "left" >= 0.2""").replace(" , c", ", c"))
def vi_report(spark, sf):
    return ov.vi_report(ov.vi_by_label(ov.contingency(voxel_grid(spark, sf)), "seg"), 0.2)


ASSIGN_SQL = CONT_SQL + ", a AS (SELECT seg, gt, n FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, gt) k FROM c) WHERE k = 1)"


@query(with_vox(f", {ASSIGN_SQL} SELECT seg, gt, n AS count FROM a").replace(" , c", ", c"))
def gt_assignment(spark, sf):
    return ov.assignment(ov.contingency(voxel_grid(spark, sf)))


@query(with_vox(f", {ASSIGN_SQL} SELECT gt, string_agg(CAST(seg AS VARCHAR), ',' ORDER BY seg) AS segs, count(*) n FROM a GROUP BY gt").replace(" , c", ", c"))
def gt_segments(spark, sf):
    return ov.segments_of_gt(ov.assignment(ov.contingency(voxel_grid(spark, sf))))


@query(with_vox(f""", {VI_SQL} SELECT seg, gt, n AS count, CASE WHEN n / gs > 0.5 THEN 'gt' ELSE 'seg' END AS "by" FROM v WHERE n / gs > 0.5 OR n / ss > 0.5""").replace(" , c", ", c"))
def overlap_matches(spark, sf):
    return ov.overlap_matches(ov.contingency(voxel_grid(spark, sf)))


@query(with_vox(f""", {ASSIGN_SQL}, z AS (SELECT CAST(seg AS BIGINT) id, count(*) size FROM vox WHERE seg <> 0 GROUP BY 1)
SELECT gt, count(*) bodies, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) pairs FROM a JOIN z ON a.seg = z.id WHERE size > 100 GROUP BY gt""").replace(" , c", ", c"))
def unmerged_large_pairs(spark, sf):
    v = voxel_grid(spark, sf)
    return ov.unmerged_pairs(ov.assignment(ov.contingency(v)), rg.mito_nodes(v), 100)


PART_SQL = """p AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) seg, dense_rank() OVER (ORDER BY p_type) gt, l_quantity q FROM part JOIN lineitem ON l_partkey = p_partkey),
c AS (SELECT p_brand seg, p_type gt, count(*) n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY seg) ss, sum(n) OVER (PARTITION BY gt) gs, sum(n) OVER () nn FROM c)"""


@query("""WITH c AS (SELECT p_brand seg, p_type gt, count(*) n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY seg) ss, sum(n) OVER (PARTITION BY gt) gs, sum(n) OVER () nn FROM c)
SELECT round(sum(n / nn * log2(ss / n)), 6) AS merge, round(sum(n / nn * log2(gs / n)), 6) AS split FROM t""")
def part_label_vi(spark, sf):
    rows = load(spark, sf, "part").join(load(spark, sf, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    table = rows.groupBy(F.col("p_brand").alias("seg"), F.col("p_type").alias("gt")).agg(F.count(F.lit(1)).alias("count"))
    return ov.variation_of_information(table)


# --- graphs --------------------------------------------------------------------------------------


@query(with_rag("SELECT (SELECT count(*) FROM nodes) regions, (SELECT count(*) FROM edges) edge_count, CAST((SELECT sum(size) FROM nodes) AS BIGINT) total_size"))
def graph_summary(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return nodes.agg(F.count(F.lit(1)).alias("regions"), F.sum("size").alias("total_size")).join(edges.agg(F.count(F.lit(1)).alias("edge_count"))).select("regions", "edge_count", "total_size")


@query(with_rag("SELECT node1, node2, edge_size, weight FROM edges"))
def part_edges(spark, sf):
    return part_graph(spark, sf)[1]


@query(with_rag("""SELECT id, CAST(coalesce(d, 0) AS BIGINT) degree, CAST(coalesce(s, 0) + boundary_size AS BIGINT) border FROM nodes LEFT JOIN (
 SELECT i, count(*) d, sum(edge_size) s FROM (SELECT node1 i, edge_size FROM edges UNION ALL SELECT node2, edge_size FROM edges) GROUP BY i) ON i = id"""))
def node_degrees(spark, sf):
    return gr.degrees(*part_graph(spark, sf))


@query(with_rag("SELECT node1, node2, a.size size1, b.size size2, weight, edge_size FROM edges JOIN nodes a ON a.id = node1 JOIN nodes b ON b.id = node2"))
def edge_endpoints(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return gr.with_sizes(edges, nodes, part_tasks(spark, sf)).select("node1", "node2", "size1", "size2", "weight", "edge_size")


@query(with_rag("SELECT id, boundary_size = 0 AS orphan FROM nodes"))
def orphan_flags(spark, sf):
    return part_graph(spark, sf)[0].select("id", (F.col("boundary_size") == 0).alias("orphan"))


@query(with_rag(""", e AS (SELECT *, edge_size % 2 = 0 AS preserve, node1 % 7 = 0 AS false_edge FROM edges)
SELECT node1, node2, NOT preserve AND NOT false_edge AS valid, NOT false_edge AND NOT (edge_size < 625 AND preserve) AS valid_synapse FROM e""").replace(" , e", ", e"))
def valid_edges(spark, sf):
    e = part_graph(spark, sf)[1].withColumns({"preserve": F.col("edge_size") % 2 == 0, "false_edge": F.col("node1") % 7 == 0})
    return e.select("node1", "node2", gr.valid_edge().alias("valid"), gr.valid_edge(True).alias("valid_synapse"))


@query(with_rag(""", s AS (SELECT l_partkey + 1 id, count(*) synapses FROM lineitem WHERE l_quantity > 48 GROUP BY 1)
SELECT n.id, size FROM nodes n LEFT JOIN s ON s.id = n.id WHERE boundary_size = 0 AND (coalesce(synapses, 0) > 0 OR size >= 30)""").replace(" , s", ", s"))
def qa_violators(spark, sf):
    nodes, _ = part_graph(spark, sf)
    syn = load(spark, sf, "lineitem").where("l_quantity > 48").groupBy((F.col("l_partkey") + 1).alias("id")).agg(F.count(F.lit(1)).alias("synapses"))
    return nodes.join(syn, "id", "left").where("boundary_size = 0 and (coalesce(synapses, 0) > 0 or size >= 30)").select("id", "size")


@query(with_rag("SELECT count(*) errors, CAST(coalesce(sum(size), 0) AS BIGINT) total FROM nodes WHERE boundary_size = 0 AND size >= 20"))
def large_orphans(spark, sf):
    return part_graph(spark, sf)[0].where("boundary_size = 0 and size >= 20").agg(F.count(F.lit(1)).alias("errors"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"))


@query(with_rag("""SELECT node1, node2, weight, abs(weight - 0.3) AS off FROM edges JOIN nodes a ON a.id = node1 JOIN nodes b ON b.id = node2 WHERE weight BETWEEN 0.1 AND 0.6 AND a.size > 10 AND b.size > 10"""))
def edge_band(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return gr.with_sizes(edges.where("weight between 0.1 and 0.6"), nodes.where("size > 10")).select("node1", "node2", "weight", F.abs(F.col("weight") - 0.3).alias("off"))


@query(with_rag("SELECT node1, node2, weight FROM edges JOIN nodes a ON a.id = node1 JOIN nodes b ON b.id = node2 WHERE weight BETWEEN 0.1 AND 0.6 AND a.size > 10 AND b.size > 10 ORDER BY abs(weight - 0.3), node1, node2 LIMIT 20"))
def edge_ranking(spark, sf):
    """A top-k report: the 20 edges whose weight is nearest 0.3."""
    nodes, edges = part_graph(spark, sf)
    rows = gr.with_sizes(edges.where("weight between 0.1 and 0.6"), nodes.where("size > 10"))
    return rows.orderBy(F.abs(F.col("weight") - 0.3), "node1", "node2").limit(20).select("node1", "node2", "weight")


@query(with_rag("SELECT node1, node2, weight FROM edges WHERE weight > 0.35 AND weight < 0.65"))
def uncertain_edges(spark, sf):
    return part_graph(spark, sf)[1].where("weight > 0.35 and weight < 0.65").select("node1", "node2", "weight")


@query(with_rag("SELECT node1, node2, edge_size FROM edges WHERE node1 IN (SELECT id FROM nodes WHERE boundary_size > 5) AND node2 IN (SELECT id FROM nodes WHERE boundary_size > 5)"))
def zero_pruned_edges(spark, sf):
    nodes, edges = part_graph(spark, sf)
    live = nodes.where("boundary_size > 5").select("id")
    tasks = part_tasks(spark, sf)
    one = gr.dealt(edges, tasks, "node1").join(live, F.col("node1") == F.col("id"), "left_semi")
    return gr.dealt(one, tasks, "node2").join(live, F.col("node2") == F.col("id"), "left_semi").select("node1", "node2", "edge_size")


@query(with_rag("SELECT id, size, rank() OVER (ORDER BY size DESC, id) AS place FROM nodes ORDER BY size DESC, id LIMIT 25"))
def largest_bodies(spark, sf):
    """A top-k report: the 25 largest bodies."""
    top = part_graph(spark, sf)[0].orderBy(F.desc("size"), "id").limit(25)
    from pyspark.sql import Window

    return top.select("id", "size", F.row_number().over(Window.orderBy(F.desc("size"), "id")).cast("long").alias("place"))


@query(with_rag("""SELECT id, size, CAST(before AS BIGINT) AS "before" FROM (SELECT id, size, coalesce(sum(size) OVER (ORDER BY size DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nodes) WHERE before <= 1000"""))
def budgeted_bodies(spark, sf):
    return gr.budgeted(part_graph(spark, sf)[0].select("id", "size"), "size", 1000).select("id", "size", "before")


@query("WITH " + RAG_SQL.replace("edges AS (", "edges AS MATERIALIZED (") + """, o AS MATERIALIZED (SELECT node1, node2, 1 - weight AS w FROM edges WHERE node1 % 2 = 0)
SELECT node1, node2, round(CASE WHEN w IS NULL OR edge_size > 3 THEN weight ELSE w END, 6) AS weight FROM edges LEFT JOIN o USING (node1, node2)""")
def updated_weights(spark, sf):
    """Weights from a second graph, but for edges of more than three contacts."""
    _, edges = part_graph(spark, sf)
    other = edges.where("node1 % 2 = 0").select("node1", "node2", (1 - F.col("weight")).alias("w"))
    new = F.when(F.col("edge_size") > 3, F.col("weight")).otherwise(F.coalesce("w", "weight"))
    return edges.join(other, ["node1", "node2"], "left").select("node1", "node2", F.round(new, 6).alias("weight"))


MAP_SQL = """m AS (SELECT id old, id - id % 40 AS root FROM nodes),
mm AS (SELECT old, min(old) OVER (PARTITION BY root) AS "new" FROM m)"""


def _mapping(nodes):
    root = nodes.select(F.col("id").alias("old"), (F.col("id") - F.col("id") % 40).alias("root"))
    return root.join(root.groupBy("root").agg(F.min("old").alias("new")), "root").select("old", "new")


@query(with_rag(f""", {MAP_SQL} SELECT "new" AS id, CAST(sum(size) AS BIGINT) size, CAST(sum(boundary_size) AS BIGINT) boundary_size FROM nodes JOIN mm ON old = id GROUP BY 1""").replace(" , m", ", m"))
def contracted_nodes(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return gr.contracted(nodes, edges, _mapping(nodes))[0]


@query(with_rag(f""", {MAP_SQL} SELECT least(a."new", b."new") node1, greatest(a."new", b."new") node2, CAST(sum(edge_size) AS BIGINT) edge_size, min(weight) weight
FROM edges JOIN mm a ON a.old = node1 JOIN mm b ON b.old = node2 WHERE a."new" <> b."new" GROUP BY 1, 2""").replace(" , m", ", m"))
def contracted_edges(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return gr.contracted(nodes, edges, _mapping(nodes), tasks=part_tasks(spark, sf))[1]


@query(with_rag(""", k AS (SELECT DISTINCT least(id, id + 8 * (1 + id % 5)) a, greatest(id, id + 8 * (1 + id % 5)) b FROM nodes)
SELECT coalesce(node1, a) node1, coalesce(node2, b) node2, CAST(coalesce(edge_size, 0) AS BIGINT) edge_size, coalesce(weight, 1.0) weight, a IS NOT NULL AS preserve, node1 IS NULL AS false_edge
FROM edges FULL JOIN k ON node1 = a AND node2 = b""").replace(" , k", ", k"))
def constrained_edges(spark, sf):
    nodes, edges = part_graph(spark, sf)
    pairs = nodes.select(F.col("id").alias("node1"), (F.col("id") + 8 * (1 + F.col("id") % 5)).alias("node2"))
    return gr.constrained(edges, pairs, part_tasks(spark, sf))


#: Every round each node takes the smallest label around it; 40 rounds are enough for the whole part graph, whose components are dense.
CC_SQL = """lb AS (SELECT node1 a, node2 b FROM low UNION SELECT node2, node1 FROM low UNION SELECT node1, node1 FROM low UNION SELECT node2, node2 FROM low),
r(n, i, j) AS (SELECT 0, a, min(b) FROM lb GROUP BY a UNION ALL SELECT max(n) + 1, a, min(j) FROM r JOIN lb ON b = i WHERE n < 40 GROUP BY a),
cc AS (SELECT i AS old, min(j) AS "new" FROM r GROUP BY i)"""


def with_cc(threshold: float, body: str) -> str:
    return f"WITH RECURSIVE {RAG_SQL}, low AS (SELECT node1, node2 FROM edges WHERE weight <= {threshold}), {CC_SQL} {body}"


@query(with_cc(0.04, 'SELECT old, "new" FROM cc'))
def flat_agglomeration(spark, sf):
    return gr.flat_merge(part_graph(spark, sf)[1], 0.04)


@query(with_cc(0.04, 'SELECT old, "new" FROM cc WHERE old <> "new"'))
def transformations(spark, sf):
    return gr.flat_merge(part_graph(spark, sf)[1], 0.04).where("old != new")


@query(with_cc(0.04, """SELECT count(*) groups FROM (SELECT "new", sum(size) - max(size) AS rest FROM cc JOIN nodes ON id = old GROUP BY 1) WHERE rest >= 20"""))
def under_merged_bodies(spark, sf):
    nodes, edges = part_graph(spark, sf)
    groups = gr.flat_merge(edges, 0.04).join(nodes, F.col("old") == F.col("id")).groupBy("new").agg((F.sum("size") - F.max("size")).alias("rest"))
    return groups.where("rest >= 20").agg(F.count(F.lit(1)).alias("groups"))


@query(with_cc(0.04, """SELECT (SELECT count(*) FROM low) - ((SELECT count(*) FROM cc) - (SELECT count(DISTINCT "new") FROM cc)) AS redundant, (SELECT count(*) FROM cc) - (SELECT count(DISTINCT "new") FROM cc) AS confirmed"""))
def proofreading_answers(spark, sf):
    """Walking all likely merges: a spanning forest's edges are confirmed, the others redundant."""
    low = part_graph(spark, sf)[1].where("weight <= 0.04")
    cc = gr.components(low)
    return cc.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("new").alias("r")).join(low.agg(F.count(F.lit(1)).alias("e"))).select((F.col("e") - F.col("n") + F.col("r")).alias("redundant"), (F.col("n") - F.col("r")).alias("confirmed"))


def path_sql(hops: int, least: float, heads: str, p: str = "1 - weight") -> str:
    return f"""WITH RECURSIVE {RAG_SQL}, near AS (SELECT node1 a, node2 b, {p} AS p FROM edges UNION ALL SELECT node2, node1, {p} FROM edges),
w(head, id, prob, n) AS (SELECT a, b, p, 1 FROM near WHERE a IN ({heads}) AND p >= {least}
 UNION SELECT head, b, prob * p, n + 1 FROM w JOIN near ON a = id WHERE n < {hops} AND prob * p >= {least} AND b <> head)
SELECT head, id, round(max(prob), 6) AS prob FROM w GROUP BY 1, 2"""


#: The bodies that paths are asked for: the 25 largest, as in largest_bodies.
HEADS_SQL = "SELECT id FROM nodes ORDER BY size DESC, id LIMIT 25"


@query(path_sql(3, 0.6, HEADS_SQL))
def affinity_pairs(spark, sf):
    """Best paths from the largest bodies."""
    nodes, edges = part_graph(spark, sf)
    return gr.best_paths(edges, nodes.orderBy(F.desc("size"), "id").limit(25), 0.6, 3).select("head", "id", F.round("prob", 6).alias("prob"))


@query(path_sql(3, 0.6, HEADS_SQL).replace("FROM w GROUP BY 1, 2", f"FROM w WHERE head < id AND id IN ({HEADS_SQL}) GROUP BY 1, 2"))
def important_paths(spark, sf):
    """Best paths between the largest bodies, each pair once."""
    nodes, edges = part_graph(spark, sf)
    big = nodes.orderBy(F.desc("size"), "id").limit(25).select("id")
    return gr.best_paths(edges, big, 0.6, 3).where("head < id").join(big, "id", "left_semi").select("head", "id", F.round("prob", 6).alias("prob"))


@query(name="graph_certainty")
def graph_certainty(spark, sf):
    """All pairs of the voxel grid's segments; the part graph is dense, so all its pairs would be its square."""
    v = voxel_grid(spark, sf)
    weight = ((F.col("node1") * 31 + F.col("node2") * 17) % 100).cast("double") / F.lit(100.0)
    return gr.graph_uncertainty(rg.rag_nodes(v), rg.rag_edges(v).withColumn("weight", weight))


@query(name="agglomerated_graph")
def agglomerated_graph(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return ag.agglomerated(nodes, edges.select("node1", "node2", "edge_size", "weight"), 0.2)[1].select("node1", "node2", "edge_size", F.round("weight", 6).alias("weight"))


@query(name="agglomeration_mapping")
def agglomeration_mapping(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return ag.agglomerated(nodes, edges.select("node1", "node2", "edge_size", "weight"), 0.2)[2]


@query(name="graph_coloring")
def graph_coloring(spark, sf):
    v = voxel_grid(spark, sf)
    return gr.coloured(rg.mito_nodes(v), rg.rag_edges(v))


@query(with_near(""", e AS (SELECT DISTINCT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2 FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr),
c AS (SELECT CAST(seg AS BIGINT) seg, CAST(gt AS BIGINT) gt, count(*) n FROM vox WHERE seg <> 0 AND gt <> 0 GROUP BY 1, 2),
a AS (SELECT seg, gt FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, gt) k FROM c) WHERE k = 1)
SELECT node1, node2, CASE WHEN p.gt = q.gt THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM e JOIN a p ON p.seg = node1 JOIN a q ON q.seg = node2""").replace(" , e", ", e"))
def optimal_weights(spark, sf):
    """Weight 0 where both ends have one ground truth, else 1."""
    v = voxel_grid(spark, sf)
    gt = ov.assignment(ov.contingency(v)).select("seg", "gt")
    e = rg.rag_edges(v).join(gt.toDF("node1", "g1"), "node1").join(gt.toDF("node2", "g2"), "node2")
    return e.select("node1", "node2", F.when(F.col("g1") == F.col("g2"), 0.0).otherwise(1.0).alias("weight"))


@query(with_rag(""", b AS (SELECT CAST(floor(weight * 100 + 0.5) % 101 AS INT) bin, CAST(sum(CASE WHEN (node1 + node2) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) merges, CAST(sum(CASE WHEN (node1 + node2) % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) splits FROM edges GROUP BY 1)
SELECT *, CAST(sum(splits) OVER (ORDER BY bin) AS BIGINT) cumulative_splits FROM b""").replace(" , b", ", b"))
def uncertainty_histogram(spark, sf):
    edges = part_graph(spark, sf)[1].withColumn("same", (F.col("node1") + F.col("node2")) % 3 == 0)
    return gr.uncertainty_histogram(edges)


@query(with_rag("""SELECT round(100.0 * sum(CASE WHEN weight < 0.5 AND k THEN 1 ELSE 0 END) / count(*), 6) tp, round(100.0 * sum(CASE WHEN weight > 0.5 AND NOT k THEN 1 ELSE 0 END) / count(*), 6) tn,
 round(100.0 * sum(CASE WHEN weight < 0.5 AND NOT k THEN 1 ELSE 0 END) / count(*), 6) fp, round(100.0 * sum(CASE WHEN weight > 0.5 AND k THEN 1 ELSE 0 END) / count(*), 6) fn,
 round(100.0 * sum(CASE WHEN weight = 0.5 THEN 1 ELSE 0 END) / count(*), 6) undecided FROM (SELECT *, (node1 + node2) % 3 = 0 AS k FROM edges)"""))
def edge_accuracy(spark, sf):
    e = part_graph(spark, sf)[1].withColumn("k", (F.col("node1") + F.col("node2")) % 3 == 0)
    share = lambda c: F.round(F.lit(100.0) * F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1)), 6)
    low, high, k = F.col("weight") < 0.5, F.col("weight") > 0.5, F.col("k")
    return e.agg(share(low & k).alias("tp"), share(high & ~k).alias("tn"), share(low & ~k).alias("fp"), share(high & k).alias("fn"), share(F.col("weight") == 0.5).alias("undecided"))


@query(with_rag("""SELECT size FROM (SELECT size, id, sum(size) OVER (ORDER BY size DESC, id) cum, sum(size) OVER () tot FROM nodes) WHERE cum > 0.9 * tot ORDER BY cum LIMIT 1"""))
def coverage_threshold(spark, sf):
    """The size at which bodies in descending size cover over 90 %: from a histogram of sizes, not a sort of bodies."""
    from pyspark.sql import Window

    nodes, _ = part_graph(spark, sf)
    sizes = nodes.groupBy("size").agg(F.sum("size").alias("mass"))  # distinct sizes
    w = Window.orderBy(F.desc("size"))
    cum = sizes.withColumn("cum", F.sum("mass").over(w)).join(sizes.agg(F.sum("mass").alias("tot")))
    return cum.where("cum > 0.9 * tot").agg(F.max("size").alias("size"))


# --- synapses ------------------------------------------------------------------------------------


def with_syn(body: str) -> str:
    return f"WITH {VOX_SQL}, {SYN_SQL}, pts AS (SELECT syn, pos, CAST(seg AS BIGINT) body FROM syn JOIN vox USING (x, y, z)) {body}"


def _bodies(spark, sf):
    return synapse_points(spark, sf).join(voxel_grid(spark, sf), ["x", "y", "z"]).select("syn", "pos", F.col("seg").cast("long").alias("body"))


@query(with_syn("SELECT syn, pos, body FROM pts"))
def synapse_volume(spark, sf):
    return _bodies(spark, sf)


@query(with_syn("SELECT body AS id, count(*) synapses FROM pts WHERE body <> 0 GROUP BY 1"))
def synapse_counts(spark, sf):
    return _bodies(spark, sf).where("body != 0").groupBy(F.col("body").alias("id")).agg(F.count(F.lit(1)).alias("synapses"))


@query(with_syn("SELECT DISTINCT body AS id FROM pts"))
def synapse_labels(spark, sf):
    return _bodies(spark, sf).select(F.col("body").alias("id")).distinct()


@query(with_syn("SELECT DISTINCT least(a.body, b.body) node1, greatest(a.body, b.body) node2 FROM pts a JOIN pts b ON a.syn = b.syn AND a.pos < b.pos WHERE a.body <> b.body AND a.body <> 0 AND b.body <> 0"))
def synapse_constraints(spark, sf):
    b = _bodies(spark, sf).where("body != 0")
    other = b.select("syn", F.col("pos").alias("pos2"), F.col("body").alias("body2"))
    pairs = b.join(other, "syn").where("pos < pos2 and body != body2")  # a synapse has few points
    return pairs.select(F.least("body", "body2").alias("node1"), F.greatest("body", "body2").alias("node2")).distinct()


@query(with_syn("SELECT count(*) pairs, CAST(sum(CASE WHEN a.body = b.body THEN 1 ELSE 0 END) AS BIGINT) violations FROM pts a JOIN pts b ON a.syn = b.syn AND a.pos < b.pos WHERE a.body <> 0 AND b.body <> 0"))
def constraint_violations(spark, sf):
    b = _bodies(spark, sf).where("body != 0")
    other = b.select("syn", F.col("pos").alias("pos2"), F.col("body").alias("body2"))
    return b.join(other, "syn").where("pos < pos2").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.when(F.col("body") == F.col("body2"), 1).otherwise(0)).alias("violations"))


# --- scalar functions ----------------------------------------------------------------------------


@query(with_rag("""SELECT node1, node2, round(-(a.size / t * log2(a.size / t) + b.size / t * log2(b.size / t) - (a.size + b.size) / t * log2((a.size + b.size) / t)), 9) AS change
FROM edges JOIN nodes a ON a.id = node1 JOIN nodes b ON b.id = node2 CROSS JOIN (SELECT sum(size) t FROM nodes)"""))
def voi_changes(spark, sf):
    nodes, edges = part_graph(spark, sf)
    total = nodes.agg(F.sum("size").cast("double").alias("t"))
    e = gr.with_sizes(edges, nodes).join(F.broadcast(total))  # one row
    return e.select("node1", "node2", F.round(ft.voi_change(F.col("size1"), F.col("size2"), F.col("t")), 9).alias("change"))


@query(with_rag("SELECT node1, node2, CASE WHEN weight > 0.4 THEN 1.0 ELSE weight END::DOUBLE merge_cost, CASE WHEN weight > 0.4 THEN 0.0 ELSE 1 - weight END::DOUBLE keep_cost FROM edges"))
def merge_costs(spark, sf):
    e = part_graph(spark, sf)[1]
    return e.select("node1", "node2", ft.merge_cost(F.col("weight"), 0.4).alias("merge_cost"), ft.keep_cost(F.col("weight"), 0.4).alias("keep_cost"))


@query(with_vox("SELECT DISTINCT CAST((z + 3) * 200000 + seg AS BIGINT) AS id, CAST(((z + 3) * 200000 + seg) % 200000 AS BIGINT) AS label FROM vox WHERE seg <> 0"))
def composed_ids(spark, sf):
    at = voxel_grid(spark, sf).where("seg != 0").select(ft.composed_id(F.col("z").cast("long"), F.col("seg"), 3).alias("id")).distinct()
    return at.select("id", (F.col("id") % 200_000).alias("label"))


@query(with_rag("SELECT node1, node2, round(2 * (weight - 0.5) * greatest(-1.0, least(1.0, edge_size - 2.0)), 6) + 0.0 AS risk FROM edges"))
def edge_risk(spark, sf):
    return part_graph(spark, sf)[1].select("node1", "node2", (F.round(ft.risk(F.col("weight"), F.col("edge_size") - F.lit(2.0)), 6) + F.lit(0.0)).alias("risk"))


@query(with_rag("SELECT node1, node2, round(2 * (weight - 0.5) * greatest(-1.0, least(1.0, edge_size - 2.0)), 6) + 0.0 AS risk FROM edges ORDER BY risk, node1, node2 LIMIT 15"))
def lowest_risk(spark, sf):
    """A top-k report: the 15 edges of lowest risk."""
    return edge_risk(spark, sf).orderBy("risk", "node1", "node2").limit(15)


@query("SELECT user_id, round(1 / (1 + exp(-avg(value) / 100)), 6) AS belief FROM events GROUP BY user_id")
def logistic_belief(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.round(ft.logistic(F.avg("value") / 100), 6).alias("belief"))


@query("""SELECT a.vec_id id1, b.vec_id id2, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 1.1""")
def similar_vectors(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ft.similar_pairs(v, 1.1)


@query("""WITH p AS (SELECT a.vec_id i, b.vec_id j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) d
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 1.1)
SELECT id, round(sum(exp(-d * d / (0.5 * 1.21))), 5) AS degree FROM (SELECT i id, d FROM p UNION ALL SELECT j, d FROM p) GROUP BY id""")
def affinity_degrees(spark, sf):
    p = similar_vectors(spark, sf)
    both = p.select(F.col("id1").alias("id"), "distance").unionAll(p.select("id2", "distance"))
    return both.groupBy("id").agg(F.round(F.sum(ft.gaussian(F.col("distance"), 1.1)), 5).alias("degree"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(ft.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


# --- learning ------------------------------------------------------------------------------------


#: nodes and edges of the grown grid, as elements (a, b, c, v) of channel c; b is 0 for a node's.
GROWN_NEAR_SQL = f"{GROWN_SQL}, {NEAR_SQL.replace('near AS (', 'near AS MATERIALIZED (')}"

#: Values are given in millionths, rounded up a hair before halves, so that the order of additions cannot show.
FEATURE_SQL = f"""WITH {GROWN_NEAR_SQL},
touch AS (SELECT DISTINCT x, y, z, least(label, nbr) a, greatest(label, nbr) b, p0, p1 FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr),
both_ AS (SELECT seg a, 0 b, p0, p1 FROM vox WHERE seg <> 0 UNION ALL SELECT a, b, p0, p1 FROM touch),
el AS MATERIALIZED (SELECT a, b, 0 c, p0 v FROM both_ UNION ALL SELECT a, b, 1, p1 FROM both_),
m AS (SELECT a, b, c, count(*) n, avg(v) e1, avg(v ** 2) e2, avg(v ** 3) e3, avg(v ** 4) e4 FROM el GROUP BY 1, 2, 3),
h AS (SELECT a, b, c, CAST(least(floor(v * 25), 24) AS INT) bin, count(*) k FROM el GROUP BY 1, 2, 3, 4),
q AS (SELECT *, sum(k) OVER (PARTITION BY a, b, c ORDER BY bin) cum, sum(k) OVER (PARTITION BY a, b, c) tot FROM h),
t AS (SELECT j, t FROM (SELECT unnest(range(5)) j, unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) t)),
f AS MATERIALIZED (
 SELECT a, b, 0 pos, CAST(n AS DOUBLE) val FROM m WHERE c = 0
 UNION ALL SELECT a, b, 1 + 9 * c, e1 FROM m
 UNION ALL SELECT a, b, 2 + 9 * c, e2 - e1 ** 2 FROM m
 UNION ALL SELECT a, b, 3 + 9 * c, e3 - 3 * e1 * e2 + 2 * e1 ** 3 FROM m
 UNION ALL SELECT a, b, 4 + 9 * c, e4 - 4 * e1 * e3 + 6 * e1 ** 2 * e2 - 3 * e1 ** 4 FROM m
 UNION ALL SELECT a, b, 5 + 9 * c + j, (bin + (t * tot - (cum - k)) / k) / 25 FROM q CROSS JOIN t WHERE cum >= t * tot AND cum - k < t * tot
), s AS (
 SELECT e.a node1, e.b node2, CASE WHEN x.n > y.n THEN e.b ELSE e.a END small, CASE WHEN x.n > y.n THEN e.a ELSE e.b END large
 FROM (SELECT DISTINCT a, b FROM f WHERE b <> 0) e JOIN m x ON x.a = e.a AND x.b = 0 AND x.c = 0 JOIN m y ON y.a = e.b AND y.b = 0 AND y.c = 0
), r AS (
 SELECT node1, node2, pos, val FROM s JOIN f ON f.a = small AND f.b = 0
 UNION ALL SELECT node1, node2, pos + 19, val FROM s JOIN f ON f.a = large AND f.b = 0
 UNION ALL SELECT node1, node2, pos + 38, val FROM s JOIN f ON f.a = node1 AND f.b = node2
 UNION ALL SELECT node1, node2, 57 + CASE WHEN u.pos < 5 THEN u.pos ELSE u.pos - 5 END, abs(u.val - w.val)
 FROM s JOIN f u ON u.a = small AND u.b = 0 JOIN f w ON w.a = large AND w.b = 0 AND w.pos = u.pos WHERE u.pos < 5 OR u.pos BETWEEN 10 AND 13
) SELECT node1, node2, CAST(pos AS INT) AS "position", CAST(floor(val * 1000000 + 0.5001) AS BIGINT) AS millionths FROM r"""


@query(FEATURE_SQL)
def edge_feature_vectors(spark, sf):
    """The basic vectors of all edges of the grown grid, a row for each value."""
    from ..operators.learning import edge_features

    f = edge_features(grown_grid(spark, sf), ("p0", "p1"))
    rows = f.select("node1", "node2", F.posexplode("features").alias("position", "v"))
    return rows.select("node1", "node2", "position", F.floor(F.col("v") * 1000000 + 0.5001).cast("long").alias("millionths"))


@query(f"""WITH {GROWN_NEAR_SQL}, v AS (SELECT x, y, z, label, p0, max(CASE WHEN nbr = 0 THEN 1 ELSE 0 END) b FROM near WHERE label <> 0 GROUP BY 1, 2, 3, 4, 5)
SELECT label AS id, count(*) size, CAST(sum(b) AS BIGINT) boundary_size, CAST(sum(CAST(round(p0 * 1000000) AS BIGINT)) AS BIGINT) sum_p0 FROM v GROUP BY 1""")
def block_nodes(spark, sf):
    nodes, _ = region_states(grown_grid(spark, sf), FeatureSet(("p0",)))
    return nodes.select("id", "size", "boundary_size", F.round(F.col("sums")[0] * 1000000).cast("long").alias("sum_p0"))


@query(f"""WITH {GROWN_NEAR_SQL}, e AS (SELECT DISTINCT x, y, z, label, nbr, p0, p1 FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr)
SELECT least(label, nbr) node1, greatest(label, nbr) node2, count(*) edge_size, CAST(sum(CAST(round(p0 * 1000000) AS BIGINT)) AS BIGINT) sum_p0,
 CAST(sum(CASE WHEN p1 * 10 >= 10 THEN 1 ELSE 0 END) AS BIGINT) full_p1 FROM e GROUP BY 1, 2""")
def block_edges(spark, sf):
    """Edges of the grown grid by halo blocks, with a sum of one channel and the last slot of the other's histogram."""
    _, edges = region_states(grown_grid(spark, sf), FeatureSet(("p0", "p1")).add_hist(10, (0.5,)))
    return edges.select("node1", "node2", F.col("size").alias("edge_size"), F.round(F.col("sums")[0] * 1000000).cast("long").alias("sum_p0"), F.col("hist")[21].alias("full_p1"))


@query(name="classifier_scores")
def classifier_scores(spark, sf):
    """A forest fitted on ground-truth edges of the voxel grid, and its weight for every edge."""
    from ..operators.learning import edge_features, fit_classifier, scored_edges, training_set

    v = voxel_grid(spark, sf)
    f = edge_features(v, ("p0", "p1"))
    gt = ov.assignment(ov.contingency(v)).select("seg", "gt")
    return scored_edges(fit_classifier(training_set(f, gt)), f)


@query(name="propagated_beliefs")
def propagated_beliefs(spark, sf):
    from ..operators.learning import propagated

    e = load(spark, sf, "embeddings")
    seeds = e.where("vec_id < 50").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 1.0).otherwise(-1.0).alias("label"))
    return propagated(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), seeds, 1.1)


@query(with_rag("""SELECT node1, node2, round(1 - CASE WHEN e.edge_size < 2 THEN 0 ELSE greatest(e.edge_size / a.t, e.edge_size / b.t) END, 6) AS weight FROM edges e
JOIN (SELECT id, sum(edge_size) t FROM (SELECT node1 id, edge_size FROM edges UNION ALL SELECT node2, edge_size FROM edges) GROUP BY id) a ON a.id = node1
JOIN (SELECT id, sum(edge_size) t FROM (SELECT node1 id, edge_size FROM edges UNION ALL SELECT node2, edge_size FROM edges) GROUP BY id) b ON b.id = node2"""))
def overlap_weights(spark, sf):
    from ..operators.learning import overlap_weights as weights

    nodes, edges = part_graph(spark, sf)
    return weights(nodes, edges, cutoff=2).select("node1", "node2", F.round("weight", 6).alias("weight"))


# --- inclusions and passes -----------------------------------------------------------------------


#: Without each node x in turn: the inner nodes that still reach the boundary. The outermost x that a node needs encloses it.
@query(with_rag(""", nb AS (SELECT node1 a, node2 b FROM edges WHERE weight <= 0.04 UNION SELECT node2, node1 FROM edges WHERE weight <= 0.04),
inner_ AS (SELECT id FROM nodes WHERE boundary_size = 0), outer_ AS (SELECT id FROM nodes WHERE boundary_size > 0),
near AS (SELECT a, b FROM nb JOIN inner_ ON b = id), c AS (SELECT DISTINCT a x FROM nb UNION ALL SELECT -1),
r(x, id) AS (SELECT x, b FROM near JOIN outer_ ON a = outer_.id JOIN c ON x <> a AND x <> b UNION SELECT x, b FROM r JOIN near ON a = id WHERE b <> x),
needs AS (SELECT v.id, c.x FROM (SELECT id FROM r WHERE x = -1) v JOIN c ON c.x <> v.id AND c.x <> -1 LEFT JOIN r ON r.x = c.x AND r.id = v.id WHERE r.id IS NULL)
SELECT id AS old, x AS "new" FROM needs WHERE x NOT IN (SELECT id FROM needs)""").replace("WITH ", "WITH RECURSIVE ", 1).replace(" , nb", ", nb"))
def merged_inclusions(spark, sf):
    """Bodies that likely merges (weight <= 0.04) link with the boundary through one other body only."""
    from ..operators.inclusions import inclusions

    nodes, edges = part_graph(spark, sf)
    return inclusions(nodes, edges.where("weight <= 0.04"))


def _mito_graph(spark, sf):
    v = voxel_grid(spark, sf)
    return rg.rag_nodes(v).join(rg.mito_nodes(v, least=0.4).select("id", "mito_type"), "id"), rg.rag_edges(v)


@query(with_near(""", e AS (SELECT least(label, nbr) a, greatest(label, nbr) b, count(*) n FROM (SELECT DISTINCT x, y, z, label, nbr FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr) GROUP BY 1, 2),
k AS (SELECT label id, count(*) size, sum(edge) boundary FROM (SELECT x, y, z, label, max(CASE WHEN nbr = 0 THEN 1 ELSE 0 END) edge FROM near WHERE label <> 0 GROUP BY x, y, z, label) GROUP BY 1),
t AS (SELECT seg id, round(avg(p1), 6) >= 0.4 AS mito FROM vox WHERE seg <> 0 GROUP BY 1),
b AS (SELECT a i, b j, n FROM e UNION ALL SELECT b, a, n FROM e), s AS (SELECT i, sum(n) n FROM b GROUP BY i),
q AS (SELECT b.i, b.j, b.n / (s.n + k.boundary) AS ratio FROM b JOIN s ON s.i = b.i JOIN k ON k.id = b.i JOIN k o ON o.id = b.j JOIN t ON t.id = b.i JOIN t u ON u.id = b.j WHERE t.mito AND NOT u.mito AND k.size <= o.size)
SELECT CAST(i AS BIGINT) mito, CAST(j AS BIGINT) other, round(1 - ratio, 9) AS "key" FROM q WHERE ratio <= 1""").replace(" , e", ", e"))
def mito_priorities(spark, sf):
    from ..operators.passes import mito_keys

    return mito_keys(*_mito_graph(spark, sf)).select("mito", "other", F.round("key", 9).alias("key"))


@query(name="mito_agglomeration")
def mito_agglomeration(spark, sf):
    """With a threshold that yields rows: these grids' regions touch along long borders."""
    from ..operators.passes import mito_merged

    return mito_merged(*_mito_graph(spark, sf), threshold=0.95)


@query(name="two_step_agglomeration")
def two_step_agglomeration(spark, sf):
    from ..operators.passes import two_step

    v = voxel_grid(spark, sf)
    weight = ((F.col("node1") * 31 + F.col("node2") * 17) % 100).cast("double") / F.lit(100.0)
    return two_step(rg.rag_nodes(v), rg.rag_edges(v).withColumn("weight", weight), 0.2)


@query(with_rag("""SELECT node1, node2, round(CAST(('0x' || substr(md5(node1 || '-' || node2 || '-1'), 1, 8)) AS BIGINT) / 4294967296.0 * 0.3, 9) AS priority FROM edges WHERE weight <= 0.3"""))
def random_priorities(spark, sf):
    from ..operators.passes import random_priority

    return random_priority(part_graph(spark, sf)[1], 0.3).select("node1", "node2", F.round("priority", 9).alias("priority"))


@query(name="greedy_seeds")
def greedy_seeds(spark, sf):
    from ..operators.passes import greedy_seeds as seeds

    return seeds(*part_graph(spark, sf))


@query(path_sql(3, 0.6, HEADS_SQL).replace("SELECT head, id, round(max(prob), 6) AS prob FROM w GROUP BY 1, 2", f""", big AS ({HEADS_SQL}),
p AS (SELECT head, id, round(max(prob), 9) AS prob FROM w WHERE id NOT IN (SELECT id FROM big) GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, head DESC) turn FROM p), gt AS (SELECT p_partkey + 1 id, p_size gt FROM part),
k AS (SELECT size, CASE WHEN s.gt = l.gt THEN 1 WHEN s.gt IN (SELECT gt FROM gt JOIN big USING (id)) THEN 2 ELSE 3 END kind FROM q JOIN nodes USING (id) JOIN gt s ON s.id = q.id JOIN gt l ON l.id = head WHERE turn <= 2)
SELECT count(*) FILTER (kind = 1) correct, CAST(coalesce(sum(size) FILTER (kind = 1), 0) AS BIGINT) correct_size, count(*) FILTER (kind = 2) incorrect, CAST(coalesce(sum(size) FILTER (kind = 2), 0) AS BIGINT) incorrect_size,
 count(*) FILTER (kind = 3) orphan, CAST(coalesce(sum(size) FILTER (kind = 3), 0) AS BIGINT) orphan_size, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM big)) - count(*) FILTER (kind = 1) AS "left" FROM k""").replace("\n, big", ", big"))
def small_segment_work(spark, sf):
    """Fragments against the 25 largest bodies; a part's size stands for its ground truth."""
    from ..operators.passes import small_segments

    nodes, edges = part_graph(spark, sf)
    big = nodes.orderBy(F.desc("size"), "id").limit(25).select("id")
    paths = gr.best_paths(edges, big, 0.6, 3).withColumn("prob", F.round("prob", 9))
    gt = load(spark, sf, "part").select((F.col("p_partkey") + 1).alias("id"), F.col("p_size").alias("gt"))
    return small_segments(paths, big, nodes, gt)


@query(path_sql(3, 0.6, HEADS_SQL).replace("SELECT head, id, round(max(prob), 6) AS prob FROM w GROUP BY 1, 2", f"""SELECT *, row_number() OVER (ORDER BY prob DESC, head DESC, id DESC) AS place
FROM (SELECT head, id, round(max(prob), 6) AS prob FROM w WHERE head < id AND id IN ({HEADS_SQL}) GROUP BY 1, 2)"""))
def ranked_paths(spark, sf):
    """The paths between the 25 largest bodies, best first: at most 300 rows in the window's one task."""
    from pyspark.sql import Window

    return important_paths(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(F.desc("prob"), F.desc("head"), F.desc("id"))).cast("long"))


@query(with_rag(""", s AS (SELECT l_partkey + 1 id, count(*) synapses FROM lineitem WHERE l_quantity > 48 GROUP BY 1)
SELECT count(*) bodies, CAST(coalesce(sum(synapses), 0) AS BIGINT) synapses FROM nodes JOIN s USING (id) WHERE boundary_size = 0 AND synapses >= 2""").replace(" , s", ", s"))
def orphan_synapse_bodies(spark, sf):
    nodes, _ = part_graph(spark, sf)
    syn = load(spark, sf, "lineitem").where("l_quantity > 48").groupBy((F.col("l_partkey") + 1).alias("id")).agg(F.count(F.lit(1)).alias("synapses"))
    return nodes.join(syn, "id").where("boundary_size = 0 and synapses >= 2").agg(F.count(F.lit(1)).alias("bodies"), F.coalesce(F.sum("synapses"), F.lit(0)).alias("synapses"))


@query(with_near(""", loc AS (SELECT node1, node2, x, y, z FROM (
 SELECT *, row_number() OVER (PARTITION BY node1, node2 ORDER BY strength DESC, z) k FROM (
  SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, z, count(*) strength, max(y * 1000 + x) // 1000 y, max(y * 1000 + x) % 1000 x
  FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr GROUP BY 1, 2, z)) WHERE k = 1),
l AS (SELECT loc.*, seg = node2 AS two, CASE WHEN seg = node2 THEN node1 ELSE node2 END other FROM loc JOIN vox USING (x, y, z)),
s AS (SELECT * FROM (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, -1, 0, 0), (3, 0, -1, 0), (4, 0, 0, -1)) t(turn, dx, dy, dz)),
f AS (SELECT node1, node2, min(turn) turn FROM l CROSS JOIN s JOIN vox v ON v.x = l.x + dx AND v.y = l.y + dy AND v.z = l.z + dz AND v.seg = other GROUP BY 1, 2),
m AS (SELECT l.*, coalesce(l.x + dx, l.x) nx, coalesce(l.y + dy, l.y) ny, coalesce(l.z + dz, l.z + 1) nz FROM l LEFT JOIN f USING (node1, node2) LEFT JOIN s USING (turn))
SELECT node1, node2, CASE WHEN two THEN nx ELSE x END x1, CASE WHEN two THEN ny ELSE y END y1, CASE WHEN two THEN nz ELSE z END z1,
 CASE WHEN two THEN x ELSE nx END x2, CASE WHEN two THEN y ELSE ny END y2, CASE WHEN two THEN z ELSE nz END z2 FROM m""").replace(" , loc", ", loc"))
def edge_second_locations(spark, sf):
    from ..operators.passes import second_locations

    v = voxel_grid(spark, sf)
    return second_locations(rg.edge_locations(v), v)


@query(with_vox(""", o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dx, dy, dz)),
pairs AS (SELECT a.z > 3 AS h, a.x, a.y, a.z, CAST(least(a.seg, b.seg) AS BIGINT) node1, CAST(greatest(a.seg, b.seg) AS BIGINT) node2 FROM vox a CROSS JOIN o JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz
 WHERE (a.z > 3) = (b.z > 3) AND a.seg <> 0 AND b.seg <> 0 AND a.seg <> b.seg),
planes AS (SELECT h, node1, node2, z, count(*) n, max(y * 1000 + x) yx FROM pairs GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h, node1, node2 ORDER BY n DESC, z) k FROM planes) WHERE k = 1)
SELECT node1, node2, CAST(total AS DOUBLE) AS weight, yx % 1000 x, yx // 1000 y, z FROM (
 SELECT *, sum(n) OVER (PARTITION BY node1, node2) total, row_number() OVER (PARTITION BY node1, node2 ORDER BY n DESC, h) j FROM best) WHERE j = 1""").replace(" , o", ", o"))
def combined_edge_states(spark, sf):
    """Edges and locations of two half volumes, merged."""
    from ..operators.passes import combined_states

    v = voxel_grid(spark, sf)
    halves = [rg.edge_locations(v.where(c)).withColumnRenamed("strength", "weight") for c in ("z <= 3", "z > 3")]
    return combined_states(*halves)


@query(with_rag("SELECT node1, node2, 1 - weight AS save_prob, 1 - weight AS orig_prob FROM edges"))
def saved_probabilities(spark, sf):
    from ..operators.passes import saved_probs

    e = part_graph(spark, sf)[1].select("node1", "node2", F.col("weight").alias("orig_prob"), (1 - F.col("weight")).alias("save_prob"))
    return saved_probs(e).select("node1", "node2", "save_prob", "orig_prob")


@query(with_rag(""", b AS (SELECT CAST(floor(weight * 100 + 0.5) % 101 AS INT) bin, count(*) FILTER ((node1 + node2) % 3 = 0) merges, count(*) FILTER ((node1 + node2) % 3 <> 0) splits FROM edges GROUP BY 1),
e AS (SELECT CAST(i AS INT) bin, coalesce(merges, 0) merges, coalesce(splits, 0) splits FROM range(101) t(i) LEFT JOIN b ON bin = i)
SELECT *, CAST(sum(splits) OVER (ORDER BY bin) AS BIGINT) cumulative_splits, round(CAST(sum((merges + splits) * bin) OVER (ORDER BY bin) AS DOUBLE) / 100, 4) cumulative_ideal FROM e""").replace(" , b", ", b"))
def uncertainty_distribution(spark, sf):
    edges = part_graph(spark, sf)[1].withColumn("same", (F.col("node1") + F.col("node2")) % 3 == 0)
    return gr.uncertainty_distribution(edges).withColumn("cumulative_ideal", F.round("cumulative_ideal", 4))


@query(with_rag("SELECT node1, node2, edge_size, weight FROM edges WHERE node1 IN (SELECT id FROM nodes WHERE size > 35) OR node2 IN (SELECT id FROM nodes WHERE size > 35)"))
def body_neighbourhood(spark, sf):
    """Edges at either end of a list of bodies, to be scored."""
    nodes, edges = part_graph(spark, sf)
    return gr.neighbourhood(edges, nodes.where("size > 35"), part_tasks(spark, sf))


#: Edges of the voxel grid's segments with a weight made of their ids.
VOX_EDGES_SQL = """, e AS (SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, count(*) n FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr GROUP BY 1, 2),
w0 AS (SELECT node1, node2, 1 - CAST((node1 * 31 + node2 * 17) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) p FROM e),
n2 AS (SELECT node1 a, node2 b, p FROM w0 UNION ALL SELECT node2, node1, p FROM w0),
w(head, id, prob, n, path) AS (SELECT a, b, p, 1, [a, b] FROM n2 WHERE a <= 8 AND p >= 0.2
 UNION SELECT head, b, prob * n2.p, n + 1, list_append(path, b) FROM w JOIN n2 ON a = id WHERE n < 3 AND prob * n2.p >= 0.2 AND b <> head)"""


def with_vox_paths(body: str) -> str:
    return f"WITH RECURSIVE {VOX_SQL}, {NEAR_SQL.strip()}{VOX_EDGES_SQL} {body}"


def _vox_edges(spark, sf):
    weight = ((F.col("node1") * 31 + F.col("node2") * 17) % 100).cast("double") / F.lit(100.0)
    return rg.rag_edges(voxel_grid(spark, sf)).withColumn("weight", weight)


@query(with_vox_paths("SELECT head, id, round(prob, 6) AS prob, array_to_string(path, ',') AS path FROM (SELECT *, row_number() OVER (PARTITION BY head, id ORDER BY round(prob, 11) DESC, n, path DESC) k FROM w) WHERE k = 1"))
def path_hops(spark, sf):
    """Best paths from segments 1 to 8 with the nodes on them."""
    e = _vox_edges(spark, sf)
    heads = gr.endpoints(e).select("id").where("id <= 8").distinct()
    return gr.traced_paths(e, heads, 0.2, 3).select("head", "id", F.round("prob", 6).alias("prob"), F.array_join("path", ",").alias("path"))


@query(with_vox_paths("""SELECT a.id AS head, b.id, round(coalesce(max(prob), 0), 6) AS prob FROM (SELECT DISTINCT node1 id FROM e WHERE node1 <= 8) a CROSS JOIN (SELECT DISTINCT node2 id FROM e WHERE node2 > 8) b
LEFT JOIN w ON w.head = a.id AND w.id = b.id GROUP BY 1, 2"""))
def pair_affinities(spark, sf):
    """The affinity of segments 1 to 8 with the later ones, 0 where no path is good enough; few ids on either side."""
    e = _vox_edges(spark, sf)
    one, two = e.select(F.col("node1").alias("head")).where("head <= 8").distinct(), e.select(F.col("node2").alias("id")).where("id > 8").distinct()
    return gr.path_affinity(e, one.join(two), 0.2, 3).select("head", "id", F.round("prob", 6).alias("prob"))


@query(f"WITH {VOX_SQL.replace('vox AS', 'vox0 AS')}, vox AS (SELECT x, y, z, CASE WHEN seg = 0 THEN 0 ELSE (z + 3) * 200000 + seg END seg, p0, p1 FROM vox0), {NEAR_SQL} " + """SELECT node1, node2, edge_size,
CASE WHEN node1 % 200000 = node2 % 200000 THEN -1 ELSE round(s / edge_size, 9) END::DOUBLE AS weight FROM (SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, count(*) edge_size, sum(p0) s
FROM (SELECT DISTINCT x, y, z, label, nbr, p0 FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr) GROUP BY 1, 2)""")
def superpixel_edges(spark, sf):
    """The graph of labels by plane, weighted with the mean of the first channel."""
    v = voxel_grid(spark, sf)
    v = v.withColumn("seg", F.when(F.col("seg") == 0, 0).otherwise(ft.composed_id(F.col("z"), F.col("seg"), 3)))
    e = rg.rag_edges(v, ("p0",)).withColumn("weight", F.round(F.col("p0_s1") / F.col("edge_size"), 9))
    return gr.plane_weights(e).select("node1", "node2", "edge_size", "weight")


@query(with_near(""", loc AS (SELECT node1, node2, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY node1, node2 ORDER BY strength DESC, z) k FROM (
 SELECT CAST(least(label, nbr) AS BIGINT) node1, CAST(greatest(label, nbr) AS BIGINT) node2, z, count(*) strength, max(y * 1000 + x) // 1000 y, max(y * 1000 + x) % 1000 x
 FROM near WHERE label <> 0 AND nbr <> 0 AND label <> nbr GROUP BY 1, 2, z)) WHERE k = 1),
a AS (SELECT DISTINCT CAST(seg AS BIGINT) node1, CAST(seg + 1 AS BIGINT) node2 FROM vox WHERE seg <> 0)
SELECT node1, node2, coalesce(x, 0) x, coalesce(y, 0) y, coalesce(z, 0) z FROM (SELECT node1, node2 FROM loc UNION SELECT node1, node2 FROM a) LEFT JOIN loc USING (node1, node2)""").replace(" , loc", ", loc"))
def edge_locations_or_origin(spark, sf):
    """Locations of all edges, false ones between consecutive ids included."""
    v = voxel_grid(spark, sf)
    found = rg.edge_locations(v)
    asked = v.where("seg != 0").select(F.col("seg").cast("long").alias("node1"), (F.col("seg") + 1).cast("long").alias("node2"))
    return gr.located(found.select("node1", "node2").union(asked).distinct(), found)


@query(with_rag("SELECT node1, node2, edge_size FROM edges WHERE edge_size > 0"))
def emitted_edges(spark, sf):
    """Edges that are written as features: false edges, which have no size, are not."""
    nodes, edges = part_graph(spark, sf)
    asked = nodes.select(F.col("id").alias("node1"), (F.col("id") + 1).alias("node2"))
    return gr.emitted(nodes, gr.constrained(edges, asked, part_tasks(spark, sf)))[1].select("node1", "node2", "edge_size")


@query(with_vox(f""", {VI_SQL} SELECT count(*) AS matches, count(DISTINCT seg) segs, count(DISTINCT gt) gts FROM v WHERE n / gs > 0.5 OR n / ss > 0.5""").replace(" , c", ", c"))
def overlap_match_counts(spark, sf):
    return ov.match_counts(ov.overlap_matches(ov.contingency(voxel_grid(spark, sf))))


@query(f"WITH {VOX_SQL}, {SYN_SQL}, pts AS (SELECT syn, pos, CAST(seg AS BIGINT) body, gt FROM syn JOIN vox USING (x, y, z)), " + """p AS (SELECT a.syn, a.body = b.body s, a.gt = b.gt g FROM pts a JOIN pts b ON a.syn = b.syn AND a.pos < b.pos)
SELECT count(*) FILTER (s) violations, count(*) FILTER (s AND NOT g) true_violations, count(*) FILTER (g) gt_merges, count(DISTINCT CASE WHEN s AND NOT g THEN syn END) violated_synapses,
 (SELECT count(*) FROM pts) points, (SELECT count(DISTINCT syn) FROM pts) synapses FROM p""")
def synapse_violations(spark, sf):
    at = synapse_points(spark, sf).join(voxel_grid(spark, sf), ["x", "y", "z"])
    return ov.synapse_violations(at.select("syn", "pos", F.col("seg").cast("long").alias("body"), "gt"))


@query(f"WITH {VOX_SQL}, {SYN_SQL} SELECT syn, pos, CAST(seg AS BIGINT) body FROM syn s JOIN vox v ON v.x = s.x + 1 AND v.y = 24 - s.y - 2 AND v.z = s.z + 1")
def synapse_bodies_unpadded(spark, sf):
    return rg.bodies_at(voxel_grid(spark, sf), synapse_points(spark, sf), 24).select("syn", "pos", "body")


# --- proofreading --------------------------------------------------------------------------------


@query(with_rag("""SELECT node1, node2, round(abs(weight - 0.1), 6) AS rank_value FROM edges JOIN nodes a ON a.id = node1 JOIN nodes b ON b.id = node2 WHERE weight BETWEEN 0.1 AND 0.9 AND a.size > 1 AND b.size > 1"""))
def edge_mode_questions(spark, sf):
    from ..operators.editing import Session

    s = Session(*part_graph(spark, sf))
    s.set_edge_mode(0.1, 0.9, 0.1)
    return s.ranked().select("node1", "node2", F.round("rank_value", 6).alias("rank_value"))


def _change(a: str, b: str) -> str:
    return f"-({a} / tot * log2({a} / tot) + {b} / tot * log2({b} / tot) - ({a} + {b}) / tot * log2(({a} + {b}) / tot))"


@query(with_rag(f""", e2 AS MATERIALIZED (SELECT node1 a, node2 b, round(1 - weight, 9) p FROM edges WHERE round(1 - weight, 9) >= 0.5),
d2 AS MATERIALIZED (SELECT a, b, p FROM e2 UNION ALL SELECT b, a, p FROM e2),
n2 AS MATERIALIZED (SELECT id, CAST(size AS DOUBLE) m, (SELECT CAST(sum(size) AS DOUBLE) FROM nodes) tot FROM nodes),
hop AS (SELECT a head, b id, b first, p prob, 1 hops FROM d2
 UNION ALL SELECT u.a, w.b, u.b, round(u.p * w.p, 9), 2 FROM d2 u JOIN d2 w ON w.a = u.b AND w.b <> u.a WHERE round(u.p * w.p, 9) >= 0.5),
top AS (SELECT head, id, CASE WHEN e.node1 IS NULL THEN first ELSE id END first, prob FROM (SELECT *, row_number() OVER (PARTITION BY head, id ORDER BY prob DESC, hops, first) k FROM hop)
 LEFT JOIN edges e ON e.node1 = least(head, id) AND e.node2 = greatest(head, id) WHERE k = 1),
c AS (SELECT head, t.id, first, x.m, round(prob * ({_change('x.m', 'y.m').replace('tot', 'x.tot')}), 15) gain, x.tot
 FROM top t JOIN n2 x ON x.id = head JOIN n2 y ON y.id = t.id WHERE x.m >= 15 AND y.m >= 12),
r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY gain DESC, id) k FROM c WHERE gain >= round({_change('10.0', '15.0')}, 15))
SELECT least(head, first) node1, greatest(head, first) node2, -max(m) rank_value FROM r WHERE k = 1 GROUP BY 1, 2""").replace(" , e2", ", e2"))
def body_mode_questions(spark, sf):
    """Each large body's best question over paths of at most two edges, in the order of the bodies' sizes."""
    from ..operators.editing import Session

    s = Session(*part_graph(spark, sf))
    s.set_body_mode(15, hops=2, upper=0.5, big=10, small=12)
    return s.ranked()


# --- label history -------------------------------------------------------------------------------


def label_events(spark, sf):
    """(labels, merges, splits) over all parts: each part goes to the part of half its number, some come out again and are merged anew."""
    ids = load(spark, sf, "part").select((F.col("p_partkey") + 1).cast("long").alias("id"))
    rows = ids.join(F.broadcast(ids.agg(F.max("id").alias("mx"))))  # one row
    up = rows.where("id >= 2").selectExpr("2 * (mx - id) AS step", "id AS remove", "id div 2 AS keep")
    again = rows.where("id % 20 = 7").selectExpr("2 * mx + id AS step", "id AS remove", "CAST(1 AS BIGINT) AS keep")
    out = rows.where("id % 10 = 7").selectExpr("2 * (mx - id div 4) + 1 AS step", "id AS label", "id AS head")
    more = rows.where("id % 20 = 7 AND id + 3 <= mx").selectExpr("2 * (mx - id div 4) + 1 AS step", "id + 3 AS label", "id AS head")
    return ids.toDF("label"), up.union(again), out.union(more)


@query("""WITH RECURSIVE ids AS (SELECT CAST(p_partkey + 1 AS BIGINT) id, (SELECT max(p_partkey) + 1 FROM part) mx FROM part),
merges AS (SELECT 2 * (mx - id) step, id remove, id // 2 keep FROM ids WHERE id >= 2 UNION ALL SELECT 2 * mx + id, id, 1 FROM ids WHERE id % 20 = 7),
splits AS (SELECT 2 * (mx - id // 4) + 1 step, id AS label, id head FROM ids WHERE id % 10 = 7
 UNION ALL SELECT 2 * (mx - id // 4) + 1, id + 3, id FROM ids WHERE id % 20 = 7 AND id + 3 <= mx),
heads AS (SELECT DISTINCT head, step FROM splits),
edges AS (SELECT remove, coalesce(max(r.step), -1) rv, keep, coalesce(max(k.step), -1) kv, m.step FROM merges m
 LEFT JOIN heads r ON r.head = remove AND r.step <= m.step LEFT JOIN heads k ON k.head = keep AND k.step <= m.step GROUP BY remove, keep, m.step),
times AS (SELECT DISTINCT 'middle' AS moment, mx AS t FROM ids UNION ALL SELECT DISTINCT 'end', 4 * mx FROM ids),
own AS (SELECT moment, t, id AS label, coalesce(arg_max(head, s.step), id) node, coalesce(max(s.step), -1) v FROM ids CROSS JOIN times LEFT JOIN splits s ON s.label = id AND s.step <= t GROUP BY moment, t, id),
walk AS (SELECT moment, t, label, node, v, 0 AS hops FROM own
 UNION ALL SELECT w.moment, w.t, w.label, e.keep, e.kv, hops + 1 FROM walk w JOIN edges e ON e.remove = w.node AND e.rv = w.v AND e.step <= w.t)
SELECT moment, label, CAST(arg_max(node, hops) AS BIGINT) body FROM walk GROUP BY moment, label""")
def labels_over_time(spark, sf):
    """The body of each part halfway through the events and after all of them."""
    labels, merges, splits = label_events(spark, sf)
    middle = load(spark, sf, "part").agg(F.max("p_partkey") + 1).first()[0]
    parts = [lb.labels_at(labels, merges, splits, t).withColumn("moment", F.lit(n)) for n, t in (("middle", middle), ("end", None))]
    return parts[0].union(parts[1]).select("moment", "label", "body")


@query(f"""WITH {GROWN_SQL}, c AS MATERIALIZED (SELECT seg, gt, count(*) n FROM vox WHERE seg > 0 AND gt <> 0 GROUP BY 1, 2),
a AS (SELECT seg - 1 seg, arg_max(gt, n * 1000000 - gt) gt, max(n) n FROM c WHERE seg % 4 = 3 GROUP BY seg),
c2 AS (SELECT seg, gt, sum(n) n FROM (SELECT * FROM c UNION ALL SELECT * FROM a) WHERE seg % 4 <> 3 GROUP BY 1, 2),
b AS (SELECT seg - seg % 4 seg, arg_max(gt, n * 1000000 - gt) gt, max(n) n FROM c2 WHERE seg % 4 <> 0 GROUP BY c2.seg),
c3 AS (SELECT seg, gt, sum(n) n FROM (SELECT * FROM c2 UNION ALL SELECT * FROM b) WHERE seg % 4 = 0 GROUP BY 1, 2)
SELECT CAST(seg AS BIGINT) seg, CAST(arg_max(gt, n * 1000000 - gt) AS BIGINT) gt, CAST(max(n) AS BIGINT) AS "count" FROM c3 GROUP BY seg""")
def assignment_after_merges(spark, sf):
    """Ground-truth labels of the segments that are left after merging four segments into one, in two steps."""
    table = ov.contingency(grown_grid(spark, sf).where("seg > 0"))
    segs = table.select("seg").distinct()
    merges = segs.where("seg % 4 != 0").selectExpr("4 - seg % 4 AS step", "seg AS remove", "CASE WHEN seg % 4 = 3 THEN seg - 1 ELSE seg - seg % 4 END AS keep")
    return lb.assigned_after(table, merges)


@query()
def absorbed_regions(spark, sf):
    """The grown grid after segments of fewer than 60 voxels and the background are flooded from the others; tested against a heap flood."""
    return absorbed(grown_grid(spark, sf), "p0", 60)
