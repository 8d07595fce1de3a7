"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.operators import graph
from strataquill.plans import fixtures as fx
from strataquill.plans.registry import query
from strataquill.session import cut, ship, table

_E = "WITH " + fx.EDGES_SQL
_C = _E + ", " + fx.COMMUNITIES_SQL


@query(_E + """, ends AS (SELECT src_path AS rel_path, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst_path, 1, 0 FROM edges UNION ALL SELECT 'p' || p_partkey, 0, 0 FROM part)
SELECT rel_path, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree, CAST(3 * sum(i) + sum(o) AS BIGINT) AS score FROM ends GROUP BY rel_path""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.centrality(fx.edges(spark, sf_dir), fx.part_nodes(spark, sf_dir))


@query(_E + """, ends AS (SELECT src_path AS rel_path, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst_path, 1, 0 FROM edges)
SELECT rel_path, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree, CAST(3 * sum(i) + sum(o) AS BIGINT) AS score FROM ends GROUP BY rel_path ORDER BY score DESC, indegree DESC, rel_path LIMIT 30""")
def top_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_central(graph.centrality(fx.edges(spark, sf_dir)))


@query(_E + " SELECT (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FILTER (WHERE is_external) FROM edges) AS external_edges, (SELECT count(*) FROM part) AS total_nodes, CAST(0 AS BIGINT) AS n_entrypoints")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(fx.edges(spark, sf_dir), fx.part_nodes(spark, sf_dir))


@query(_E + " SELECT src_path, dst_path, edge_type FROM edges ORDER BY src_path, dst_path, edge_type LIMIT 2000")
def edge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.list_edges(fx.edges(spark, sf_dir).select("src_path", "dst_path", "edge_type"))


def _hops(n: int) -> str:
    both = ", b AS (SELECT DISTINCT * FROM (SELECT src_path AS x, dst_path AS y FROM edges WHERE NOT is_external UNION ALL SELECT dst_path, src_path FROM edges WHERE NOT is_external))"
    return _E.replace("WITH ", "WITH RECURSIVE ", 1) + both + f", r(rel_path, hop) AS (SELECT 'p3', 0 UNION SELECT b.y, r.hop + 1 FROM r JOIN b ON b.x = r.rel_path WHERE r.hop < {n}) SELECT rel_path, CAST(min(hop) AS BIGINT) AS hop FROM r GROUP BY rel_path ORDER BY min(hop), rel_path LIMIT 2000"


@query(_hops(1))
def neighbours_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(fx.edges(spark, sf_dir), "p3", 1)


@query(_hops(2))
def neighbours_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(fx.edges(spark, sf_dir), "p3", 2)


@query(_hops(2).replace("SELECT rel_path, CAST(min(hop) AS BIGINT) AS hop FROM r GROUP BY rel_path ORDER BY min(hop), rel_path LIMIT 2000", ", n AS (SELECT rel_path, min(hop) AS hop FROM r GROUP BY rel_path HAVING min(hop) < 2) SELECT DISTINCT src_path, dst_path, edge_type FROM edges WHERE NOT is_external AND (src_path IN (SELECT rel_path FROM n) OR dst_path IN (SELECT rel_path FROM n))"))
def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.edges(spark, sf_dir)
    return graph.neighbourhood_edges(e, graph.neighbours(e, "p3", 2), 2)


@query(_E + " SELECT 'in' AS direction, src_path AS rel_path FROM edges WHERE dst_path = 'p3' UNION ALL SELECT 'out', dst_path FROM edges WHERE src_path = 'p3'")
def in_out_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_lists(fx.edges(spark, sf_dir), "p3")


#: Cycles by the whole closure; at sf0.01 it has 3.6 million rows.
CYCLES_SQL = "WITH RECURSIVE " + fx.EDGES_SQL + """, e AS (SELECT DISTINCT src_path AS a, dst_path AS b FROM edges WHERE NOT is_external AND src_path <> dst_path),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b),
g AS (SELECT a AS rel_path, least(a, min(b)) AS root, count(*) + 1 AS cycle_size FROM m GROUP BY a), c AS (SELECT rel_path, cycle_size, CAST(dense_rank() OVER (ORDER BY cycle_size DESC, root) - 1 AS BIGINT) AS cycle_no FROM g)"""


@query(CYCLES_SQL + " SELECT rel_path, cycle_size, cycle_no FROM c")
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return graph.cycles(fx.edges(spark, sf_dir)).select("rel_path", "cycle_size", "cycle_no")


@query(_E + """, ends AS (SELECT src_path AS rel_path, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst_path, 1, 0 FROM edges UNION ALL SELECT 'p' || p_partkey, 0, 0 FROM part),
top AS (SELECT rel_path, row_number() OVER (ORDER BY 3 * sum(i) + sum(o) DESC, sum(i) DESC, rel_path) AS k FROM ends GROUP BY 1)
SELECT (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM part) AS total_nodes, '' AS entrypoints, (SELECT string_agg(rel_path, ',' ORDER BY k) FROM top WHERE k <= 30) AS top_files""")
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = graph.overview(fx.edges(spark, sf_dir), fx.part_nodes(spark, sf_dir))
    return one.select("total_edges", "total_nodes", F.array_join("entrypoints", ",").alias("entrypoints"), F.array_join("top_files", ",").alias("top_files"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.edges(spark, sf_dir).where("not is_external").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct()


@query(_C + """, s AS (SELECT m.rel_path, m.community_id, count(c.dst) AS hub_score FROM members m LEFT JOIN cpairs c ON c.dst = m.rel_path AND c.c_src = c.c_dst GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY hub_score DESC, rel_path) AS rn FROM s),
n AS (SELECT c_src AS community_id, c_dst AS x FROM cpairs WHERE c_src <> c_dst UNION SELECT c_dst, c_src FROM cpairs WHERE c_src <> c_dst), k AS (SELECT community_id, list_sort(list(x)) AS l FROM n GROUP BY 1)
SELECT t.community_id, count(*) AS member_count, round(count(*) / (SELECT count(*) FROM members), 6) AS size_share,
 array_to_string(list(t.rel_path ORDER BY rn) FILTER (WHERE rn <= 3), ',') AS hubs, coalesce(array_to_string(any_value(k.l), ','), '') AS neighbours FROM t LEFT JOIN k USING (community_id) GROUP BY t.community_id""")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.community_summaries(fx.communities(spark, sf_dir), _pairs(spark, sf_dir))
    return rows.withColumn("hubs", F.array_join("hubs", ",")).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query(_C + " SELECT m.rel_path, m.community_id, count(c.dst) AS hub_score FROM members m LEFT JOIN cpairs c ON c.dst = m.rel_path AND c.c_src = c.c_dst GROUP BY ALL")
def hub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hub_scores(fx.communities(spark, sf_dir), _pairs(spark, sf_dir))


@query(_C + " SELECT c_src, c_dst, count(*) AS n_edges FROM cpairs WHERE c_src <> c_dst GROUP BY ALL")
def community_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_edges(fx.communities(spark, sf_dir), _pairs(spark, sf_dir))


@query(_C + """, s AS (SELECT community_id, min(rel_path) AS rel_path FROM members GROUP BY 1 HAVING count(*) = 1), b AS (SELECT src AS x, dst AS y FROM inner_pairs UNION ALL SELECT dst, src FROM inner_pairs),
v AS (SELECT s.rel_path, m.community_id AS there, count(*) AS n FROM s JOIN b ON b.x = s.rel_path JOIN members m ON m.rel_path = b.y WHERE m.community_id <> s.community_id GROUP BY ALL),
w AS (SELECT rel_path, first(there ORDER BY n DESC, there) AS chosen FROM v GROUP BY 1)
SELECT m.rel_path, coalesce(w.chosen, m.community_id) AS community_id FROM members m LEFT JOIN w USING (rel_path)""")
def singleton_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.absorb_singletons(fx.communities(spark, sf_dir), _pairs(spark, sf_dir))


@query(_C + " SELECT rel_path, community_id FROM members WHERE community_id = (SELECT community_id FROM members WHERE rel_path = 'p5')")
def community_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_of(fx.communities(spark, sf_dir), "p5")


@query(_C + """ SELECT (SELECT count(*) FROM part) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FILTER (WHERE is_external) FROM edges) AS n_external, (SELECT count(*) FROM inner_pairs) AS n_distinct_edges,
 (SELECT count(DISTINCT community_id) FROM members) AS n_communities, (SELECT count(*) FROM (SELECT 1 FROM members GROUP BY community_id HAVING count(*) = 1)) AS n_singletons,
 (SELECT count(*) FROM (SELECT DISTINCT c_src, c_dst FROM cpairs WHERE c_src <> c_dst)) AS n_community_edges""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.export(fx.edges(spark, sf_dir), fx.communities(spark, sf_dir), fx.part_nodes(spark, sf_dir))


@query()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return graph.communities(cut(_pairs(spark, sf_dir)), fx.part_nodes(spark, sf_dir))


@query(_E + """, p AS (SELECT DISTINCT src_path AS a, dst_path AS b FROM edges WHERE NOT is_external), n AS (SELECT a AS x FROM p UNION SELECT b FROM p UNION SELECT 'p' || p_partkey FROM part)
SELECT count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_unsettled, true AS beats_one_community, true AS beats_single_nodes FROM n""")
def community_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That no node of louvain_communities would raise the modularity by moving to a community next to it, by joins of their own."""
    ship(spark)
    pairs = cut(_pairs(spark, sf_dir))
    homes = cut(graph.communities(pairs, fx.part_nodes(spark, sf_dir)))
    ends = pairs.where("src <> dst").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    both = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y")))
    of = lambda name, c: homes.select(F.col("rel_path").alias(name), F.col("community_id").alias(c))
    degrees = both.groupBy("x").agg(F.count(F.lit(1)).alias("d")).join(of("x", "home"), "x")
    loads, total = degrees.groupBy(F.col("home").alias("c")).agg(F.sum("d").alias("load")), degrees.agg(F.sum("d")).scalar()
    links = both.join(of("y", "c"), "y").groupBy("x", "c").agg(F.count(F.lit(1)).alias("links"))
    every = links.unionByName(degrees.select("x", F.col("home").alias("c"), F.lit(0).cast("long").alias("links"))).groupBy("x", "c").agg(F.sum("links").alias("links"))
    worth = every.join(degrees, "x").join(loads, "c").select("x", (F.col("c") == F.col("home")).alias("own"), (F.col("links") - F.col("d") * (F.col("load") - F.when(F.col("c") == F.col("home"), F.col("d")).otherwise(0)) / total).alias("w"))
    told = worth.groupBy("x").agg(F.max(F.when(F.col("own"), F.col("w"))).alias("stays"), F.max("w").alias("best"))
    unsettled = told.agg(F.count_if(F.col("best") > F.col("stays") + 1e-6)).scalar()
    inner = links.join(of("x", "home"), "x").where("c = home").agg(F.sum("links")).scalar() / total
    shares = loads.agg(F.sum((F.col("load") / total) * (F.col("load") / total))).scalar()
    alone = degrees.agg(F.sum((F.col("d") / total) * (F.col("d") / total))).scalar()
    return homes.agg(F.count(F.lit(1)).alias("n_nodes"), unsettled.alias("n_unsettled"), (inner - shares > 0).alias("beats_one_community"), (inner - shares > -alone).alias("beats_single_nodes"))


# Imports -----------------------------------------------------------------------------------------------------------

_TREE = """docs AS (SELECT doc_id, 'root' || (doc_id % 3) || '/pkg' || (doc_id % 5) || '/mod' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS rel_path FROM documents),
tree AS (SELECT DISTINCT rel_path FROM docs), imp AS (SELECT DISTINCT rel_path AS src_path, 'pkg' || (doc_id % 7) || '.mod' || (doc_id % 60) AS dotted, '../pkg' || (doc_id % 6) || '/./mod' || (doc_id % 55) AS rel FROM docs),
suffix AS (SELECT s, min(rel_path) AS dst FROM (SELECT rel_path, unnest([rel_path, substr(rel_path, instr(rel_path, '/') + 1), regexp_extract(rel_path, '[^/]+$')]) AS s FROM tree WHERE rel_path LIKE '%.py') GROUP BY s)"""


def _imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    s = lambda n: (i % n).cast("string")
    path = F.concat(F.lit("root"), s(3), F.lit("/pkg"), s(5), F.lit("/mod"), s(50), F.when(i % 2 == 0, ".py").otherwise(".ts"))
    docs = table(spark, sf_dir, "documents").select(path.alias("rel_path"), F.concat(F.lit("pkg"), s(7), F.lit(".mod"), s(60)).alias("dotted"), F.concat(F.lit("../pkg"), s(6), F.lit("/./mod"), s(55)).alias("rel"))
    return docs.select("rel_path").distinct(), docs.select(F.col("rel_path").alias("src_path"), "dotted", "rel").distinct()


@query("WITH " + _TREE + " SELECT src_path, dotted AS target, dst AS dst_path FROM (SELECT DISTINCT src_path, dotted FROM imp) LEFT JOIN suffix ON s = replace(dotted, '.', '/') || '.py'")
def suffix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, imports = _imports(spark, sf_dir)
    return graph.resolve_dotted(imports.select("src_path", F.col("dotted").alias("target")).distinct(), tree)


_RELATIVE = _TREE + """, r AS (SELECT DISTINCT src_path, rel, string_split(src_path, '/')[1] || '/' || replace(substr(rel, 4), '/./', '/') AS base FROM imp),
rr AS (SELECT r.src_path, r.rel, first(t.rel_path ORDER BY k) AS dst_path FROM r, (VALUES (0, ''), (1, '.py'), (2, '.ts'), (3, '.tsx')) e(k, x) JOIN tree t ON t.rel_path = base || x GROUP BY 1, 2)"""


@query("WITH " + _RELATIVE + " SELECT r.src_path, r.rel AS target, rr.dst_path FROM r LEFT JOIN rr USING (src_path, rel)")
def relative_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, imports = _imports(spark, sf_dir)
    return graph.resolve_relative(imports.select("src_path", F.col("rel").alias("target")).distinct(), tree)


@query("WITH " + _RELATIVE + """ SELECT DISTINCT src, dst FROM (
 SELECT src_path AS src, dst AS dst FROM imp JOIN suffix ON s = replace(dotted, '.', '/') || '.py' WHERE src_path LIKE '%.py' UNION ALL SELECT src_path, dst_path FROM rr) WHERE src <> dst""")
def edge_reresolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, imports = _imports(spark, sf_dir)
    stored = imports.select("src_path", F.explode(F.array("dotted", "rel")).alias("dst_path")).withColumn("is_external", F.lit(True))
    return graph.reresolve(stored, tree)


@query("WITH " + _RELATIVE + """ SELECT src_path, coalesce(dst, dotted) AS dst_path, 'import' AS edge_type, dst IS NULL AS is_external FROM (SELECT DISTINCT src_path, dotted FROM imp WHERE src_path LIKE '%.py') LEFT JOIN suffix ON s = replace(dotted, '.', '/') || '.py'
UNION ALL SELECT r.src_path, coalesce(rr.dst_path, r.rel), 'import', rr.dst_path IS NULL FROM r LEFT JOIN rr USING (src_path, rel) WHERE r.src_path LIKE '%.ts'""")
def edge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, imports = _imports(spark, sf_dir)
    python = F.endswith("src_path", F.lit(".py"))
    told = imports.select("src_path", F.when(python, F.col("dotted")).otherwise(F.col("rel")).alias("target")).distinct()
    return graph.build_edges(told, tree)


@query(r"""SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<a href="([^"]*)">', chr(10) || 'import x from ''\1'';', 'g'), '(?m)^\s*import\s+(?:[^''"]+?\s+from\s+)?[''"]([^''"]+)[''"]', 1)) AS target FROM pages) GROUP BY ALL""")
def import_edges_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, written as import statements."""
    code = F.regexp_replace("html", r'<a href="([^"]*)">', "\nimport x from '$1';")
    rows = graph.script_imports(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel_path"), code.alias("content")))
    return rows.groupBy(F.col("src_path").cast("long").alias("page_id"), "target").agg(F.count(F.lit(1)).alias("n"))
