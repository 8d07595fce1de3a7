"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import text
from strataquill.operators import retrieval as r
from strataquill.plans import fixtures as fx
from strataquill.plans.registry import query
from strataquill.session import cut, table

ASKED = list(fx.ASKED)


@query("WITH " + fx.CHUNKS_SQL + " SELECT rel_path, category, language, chunk_index, content, token_estimate FROM chunks")
def flat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.chunks(spark, sf_dir)


@query("WITH " + fx.CHUNKS_SQL + " SELECT rel_path, chunk_index, substr(content, 1, 500) AS preview FROM chunks")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.chunks(spark, sf_dir).select("rel_path", "chunk_index", F.substring("content", 1, 500).alias("preview"))


@query("SELECT item_id, array_to_string(list_distinct_keep, ' ') AS terms FROM (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(t), lambda x: {'p': list_position(t, x), 'x': x})), lambda s: s.x) AS list_distinct_keep FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'), lambda x: length(x) > 1) AS t FROM benchmark))")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+') AS t FROM documents)")
def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.corpus_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("WITH " + fx.TERMS_SQL + " SELECT term, df FROM dfs")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.frequencies(fx.files(spark, sf_dir)).where("term is not null")


@query("WITH " + fx.TERMS_SQL + " SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.corpus_stats(fx.chunks(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query("WITH " + fx.TERMS_SQL + " SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(r.frequencies(fx.files(spark, sf_dir)).where("df >= 2 or term is null"))
    return r.idf(found.where("term is not null"), found.where("term is null").select(F.col("df").alias("n"))).withColumn("idf", F.round("idf", 6))


def _scores(c: DataFrame) -> DataFrame:
    return r.scores_of(c, ASKED)


@query("WITH " + fx.SCORES_SQL + " SELECT rel_path, chunk_index, bm25, rank FROM stage1")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.ranked(r.top(_scores(fx.chunks(spark, sf_dir)), "bm25"), "bm25")


_LEXICAL = " + ".join(f"(length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)} + CASE WHEN contains(lower(rel_path), '{t}') THEN 2 ELSE 0 END" for t in fx.ASKED)


@query("WITH " + fx.CHUNKS_SQL + f" SELECT * FROM (SELECT rel_path, chunk_index, {_LEXICAL} AS score FROM chunks) WHERE score > 0 ORDER BY score DESC, rel_path, chunk_index LIMIT 100")
def lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.chunks(spark, sf_dir).select("rel_path", "chunk_index", text.lexical_score(F.col("content"), F.col("rel_path"), ASKED).alias("score"))
    return r.top(rows.where("score > 0"), "score")


_GROWN = """, near AS (SELECT rel_path, chunk_index, language, content, token_estimate, lead(content) OVER (PARTITION BY rel_path ORDER BY chunk_index) AS next FROM chunks),
o AS (SELECT *, next IS NOT NULL AND CASE WHEN language = 'python' THEN regexp_matches(content, '(?m)^[ \\t]*(?:def |class |async def )') AND regexp_matches(content, '^[ \\t]')
 ELSE length(content) - length(replace(content, '{', '')) > length(content) - length(replace(content, '}', '')) END AS expanded FROM near)"""


@query("WITH " + fx.CHUNKS_SQL + _GROWN + " SELECT rel_path, chunk_index, expanded, CASE WHEN expanded THEN content || chr(10) || next ELSE content END AS content, CASE WHEN expanded THEN greatest(1, length(content || chr(10) || next) // 4) ELSE token_estimate END AS token_estimate FROM o")
def boundary_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.expanded_chunks(fx.chunks(spark, sf_dir))


@query("""WITH s AS (SELECT page_id, unnest(range(0, greatest(1, CAST(ceil((length(html) - 1300) / 1138.0) AS BIGINT) + 1))) AS k, html FROM pages), c AS (SELECT page_id, k AS chunk_index, substr(html, k * 1138 + 1, 1300) AS content FROM s)
SELECT page_id, chunk_index, length(content) - length(replace(content, '{', '')) > length(content) - length(replace(content, '}', '')) AS is_open FROM c""")
def boundary_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.sliding_chunks(F.col("html"), F.lit(1300))).alias("chunk_index", "content"))
    return rows.select("page_id", F.col("chunk_index").cast("long"), text.ends_open(F.col("content"), F.lit("html")).alias("is_open"))


_CENTRAL = ", " + fx.FILE_EDGES_SQL + """, ends AS (SELECT src_path AS rel_path, 0 AS i, 1 AS o FROM fe UNION ALL SELECT dst_path, 1, 0 FROM fe),
central AS (SELECT rel_path, row_number() OVER (ORDER BY 3 * sum(i) + sum(o) DESC, sum(i) DESC, rel_path) AS central_rank FROM ends GROUP BY rel_path ORDER BY central_rank LIMIT 30)"""


def _central(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from strataquill.operators import graph

    rows = graph.top_central(graph.centrality(fx.file_edges(spark, sf_dir)))
    return rows.withColumn("central_rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("indegree"), "rel_path")).cast("long")).select("rel_path", "central_rank")


def _single(extra: str) -> str:
    return "WITH " + fx.SCORES_SQL + _CENTRAL + f""" SELECT s.rel_path, s.chunk_index, c.token_estimate, round(s.bm25 + CASE WHEN c.category IN ('source', 'config', 'infra') THEN 1.4 ELSE 0 END
 + CASE WHEN z.central_rank IS NOT NULL THEN greatest(0, 2.6 - z.central_rank * 0.08) ELSE 0 END + {extra}, 6) AS score
FROM scores s JOIN chunks c USING (rel_path, chunk_index) LEFT JOIN central z USING (rel_path) ORDER BY score DESC, s.rel_path, s.chunk_index LIMIT 40"""


_HYBRID = " + ".join(f"CASE WHEN contains(lower(s.rel_path), '{t}') THEN 0.6 ELSE 0 END" for t in fx.ASKED)
_VECTORLESS = "CASE WHEN z.central_rank IS NOT NULL THEN 1.8 ELSE 0 END + CASE WHEN regexp_matches(lower(s.rel_path), 'index|router|service') THEN 0.9 ELSE 0 END"


def _single_pass(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    return r.single_pass(c, cut(_scores(c)), cut(_central(spark, sf_dir)), ASKED, "architecture", mode, 40)


@query(_single(_HYBRID))
def single_pass_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single_pass(spark, sf_dir, "hybrid")


@query(_single(_VECTORLESS))
def single_pass_vectorless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single_pass(spark, sf_dir, "vectorless")


@query("WITH a AS (SELECT *, row_number() OVER (ORDER BY score DESC, rel_path, chunk_index) AS k FROM (" + _single(_HYBRID) + ")), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, rel_path, chunk_index) AS k FROM (" + _single(_VECTORLESS) + """))
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (rel_path, chunk_index)) AS n_both,
 (SELECT count(*) FROM a JOIN b USING (rel_path, chunk_index) WHERE a.k <= 5 AND b.k <= 5) AS n_both_first, (SELECT CAST(sum(token_estimate) AS BIGINT) FROM b) - (SELECT CAST(sum(token_estimate) AS BIGINT) FROM a) AS token_delta""")
def mode_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    scores, central = cut(_scores(c)), cut(_central(spark, sf_dir))
    each = (cut(r.single_pass(c, scores, central, ASKED, "architecture", mode, 40)) for mode in ("hybrid", "vectorless"))
    return r.compare(*each)


_EXPANDED = ", " + fx.FILE_EDGES_SQL + """, seeds AS (SELECT DISTINCT rel_path AS seed_path FROM stage1 WHERE rank <= 20), fm AS (SELECT rel_path, doc_id % 101 AS community_id FROM files),
sides AS (SELECT src_path AS a, dst_path AS b FROM fe UNION SELECT dst_path, src_path FROM fe),
grown AS (SELECT DISTINCT * FROM (SELECT s.seed_path, y.rel_path AS path, 'community' AS source FROM seeds s JOIN fm x ON x.rel_path = s.seed_path JOIN fm y ON y.community_id = x.community_id AND y.rel_path <> s.seed_path
 UNION ALL SELECT seed_path, b, 'neighbour' FROM (SELECT s.seed_path, b.b, row_number() OVER (PARTITION BY s.seed_path ORDER BY b.b) AS rn FROM seeds s JOIN sides b ON b.a = s.seed_path AND b.b <> s.seed_path) WHERE rn <= 50
 UNION ALL SELECT s.seed_path, f2.rel_path, 'reference' FROM seeds s JOIN files f1 ON f1.rel_path = s.seed_path JOIN files f2 ON f2.doc_id = f1.doc_id + 5))"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.files(spark, sf_dir).select("doc_id", "rel_path")
    return f.select(F.col("rel_path").alias("src_path"), (F.col("doc_id") + 5).alias("t")).join(f.select(F.col("doc_id").alias("t"), F.col("rel_path").alias("dst_path")), "t").select("src_path", "dst_path")


@query("WITH " + fx.SCORES_SQL + _EXPANDED + " SELECT seed_path, path, source FROM grown")
def stage2_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage1 = bm25_topk(spark, sf_dir)
    return r.expansion(stage1.where(F.col("rank") <= r.SEEDS), fx.file_edges(spark, sf_dir), fx.file_communities(spark, sf_dir), _references(spark, sf_dir))


_STAGE3 = _EXPANDED + """, ends AS (SELECT src_path AS rel_path, 0 AS i, 1 AS o FROM fe UNION ALL SELECT dst_path, 1, 0 FROM fe),
central AS (SELECT rel_path FROM ends GROUP BY rel_path ORDER BY 3 * sum(i) + sum(o) DESC, sum(i) DESC, rel_path LIMIT 30),
cand AS (SELECT rel_path, chunk_index FROM stage1 UNION ALL SELECT c.rel_path, c.chunk_index FROM chunks c WHERE c.rel_path IN (SELECT path FROM grown) AND c.rel_path NOT IN (SELECT rel_path FROM stage1)),
sc AS (SELECT DISTINCT community_id FROM fm WHERE rel_path IN (SELECT seed_path FROM seeds)),
parts3 AS (SELECT d.rel_path, d.chunk_index, c.token_estimate, round(coalesce(s.bm25, 0) + CASE WHEN c.category IN ('source', 'config', 'infra') THEN 1.4 ELSE 0 END, 6) AS bm25_component,
 CASE WHEN d.rel_path IN (SELECT rel_path FROM stage1) THEN 1.5 ELSE 1.0 END AS symbol_bonus, CASE WHEN m.community_id IN (SELECT community_id FROM sc) THEN 1.3 ELSE 1.0 END AS module_bonus,
 CASE WHEN d.rel_path IN (SELECT rel_path FROM central) THEN 2.6 ELSE 0.0 END AS centrality_bonus
 FROM cand d JOIN chunks c USING (rel_path, chunk_index) LEFT JOIN scores s USING (rel_path, chunk_index) LEFT JOIN fm m ON m.rel_path = d.rel_path),
scored3 AS (SELECT *, CAST(round(CAST(bm25_component AS DECIMAL(18,6)) * CAST(symbol_bonus AS DECIMAL(3,1)) * CAST(module_bonus AS DECIMAL(3,1)) + CAST(centrality_bonus AS DECIMAL(3,1)), 6) AS DOUBLE) AS score FROM parts3), ranked AS (SELECT * FROM scored3 WHERE score > 0)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(fx.chunks(spark, sf_dir))
    scores = cut(_scores(c))
    stage1 = cut(r.ranked(r.top(scores, "bm25"), "bm25"))
    seeds, communities = stage1.where(F.col("rank") <= r.SEEDS), fx.file_communities(spark, sf_dir)
    grown = r.expansion(seeds, fx.file_edges(spark, sf_dir), communities, _references(spark, sf_dir))
    return r.stage3(r.candidates(stage1, grown, c), c, scores, stage1, seeds, communities, _central(spark, sf_dir), "architecture")


@query("WITH " + fx.SCORES_SQL + _STAGE3 + " SELECT rel_path, chunk_index, token_estimate, bm25_component, CAST(symbol_bonus AS DOUBLE) AS symbol_bonus, CAST(module_bonus AS DOUBLE) AS module_bonus, CAST(centrality_bonus AS DOUBLE) AS centrality_bonus, score FROM ranked")
def two_stage_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


_FOLDED = """, q AS (SELECT rel_path, chunk_index, token_estimate AS t, score, symbol_bonus > 1 OR module_bonus > 1 AS grown, row_number() OVER (ORDER BY score DESC, rel_path, chunk_index) AS k FROM ranked),
fold(k, used, kept) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT q.k, CASE WHEN f.used + q.t <= 14000 THEN f.used + q.t ELSE f.used END, f.used + q.t <= 14000 FROM fold f JOIN q ON q.k = f.k + 1)"""


def _two_stage(spark: SparkSession, sf_dir: str, c: DataFrame, lexical: bool = False) -> DataFrame:
    central = cut(_central(spark, sf_dir))
    return r.two_stage(c, " ".join(ASKED), fx.file_edges(spark, sf_dir), fx.file_communities(spark, sf_dir), _references(spark, sf_dir), central, lexical=lexical)


@query("WITH RECURSIVE " + fx.SCORES_SQL + _STAGE3 + _FOLDED + " SELECT q.rel_path, q.chunk_index, q.t AS token_estimate, q.score FROM fold f JOIN q USING (k) WHERE f.kept")
def ret_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_stage(spark, sf_dir, cut(fx.chunks(spark, sf_dir))).select("rel_path", "chunk_index", "token_estimate", "score")


_LEXICAL_SQL = fx.CHUNKS_SQL + f""", scores AS (SELECT * FROM (SELECT rel_path, chunk_index, CAST({_LEXICAL} AS DOUBLE) AS bm25 FROM chunks) WHERE bm25 > 0),
stage1 AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, rel_path, chunk_index) AS rank FROM scores ORDER BY bm25 DESC, rel_path, chunk_index LIMIT 100)"""


@query("WITH RECURSIVE " + _LEXICAL_SQL + _STAGE3 + _FOLDED + " SELECT q.rel_path, q.chunk_index, q.t AS token_estimate, q.score FROM fold f JOIN q USING (k) WHERE f.kept")
def ret_two_stage_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over a corpus without statistics."""
    return _two_stage(spark, sf_dir, cut(fx.chunks(spark, sf_dir)), lexical=True).select("rel_path", "chunk_index", "token_estimate", "score")


@query("WITH RECURSIVE " + fx.SCORES_SQL + _STAGE3 + _FOLDED + """ SELECT 'the ention thand und maison core' AS query, 'architecture' AS section, CAST(14000 AS BIGINT) AS budget_tokens, (SELECT max(used) FROM fold) AS used_tokens, q.rel_path, q.chunk_index, q.score,
 q.t AS token_estimate, CASE WHEN q.grown THEN '2stage-bm25,graph-expand' ELSE '2stage-bm25' END AS reason_codes, c.content AS excerpt FROM fold f JOIN q USING (k) JOIN chunks c USING (rel_path, chunk_index) WHERE f.kept""")
def ret_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence bundle of two stages, a row for each evidence."""
    c = cut(fx.chunks(spark, sf_dir))
    one = r.bundle(r.evidence(_two_stage(spark, sf_dir, c), c), " ".join(ASKED), "architecture", r.BUDGETS["architecture"])
    each = one.select("query", "section", "budget_tokens", "used_tokens", F.explode("evidences").alias("e"))
    return each.select("query", "section", "budget_tokens", "used_tokens", "e.rel_path", "e.chunk_index", "e.score", "e.token_estimate", F.array_join("e.reason_codes", ",").alias("reason_codes"), "e.excerpt")


def _single_sql(extra: str, last: str) -> str:
    return "WITH RECURSIVE " + fx.SCORES_SQL + _CENTRAL + _GROWN + f""", g AS (SELECT rel_path, chunk_index, expanded, CASE WHEN expanded THEN content || chr(10) || next ELSE content END AS content,
  CASE WHEN expanded THEN greatest(1, length(content || chr(10) || next) // 4) ELSE token_estimate END AS t FROM o),
p AS (SELECT s.rel_path, s.chunk_index, z.central_rank IS NOT NULL AS central, c.category IN ('source', 'config', 'infra') AS hinted, round(s.bm25 + CASE WHEN c.category IN ('source', 'config', 'infra') THEN 1.4 ELSE 0 END
 + CASE WHEN z.central_rank IS NOT NULL THEN greatest(0, 2.6 - z.central_rank * 0.08) ELSE 0 END + {extra}, 6) AS score, {extra} > 0 AS extra FROM scores s JOIN chunks c USING (rel_path, chunk_index) LEFT JOIN central z USING (rel_path)),
q AS (SELECT p.*, g.t, g.expanded, row_number() OVER (ORDER BY p.score DESC, p.rel_path, p.chunk_index) AS k FROM p JOIN g USING (rel_path, chunk_index)),
fold(k, used, n, kept) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, false UNION ALL SELECT q.k, CASE WHEN f.used + q.t <= 9000 THEN f.used + q.t ELSE f.used END, CASE WHEN f.used + q.t <= 9000 THEN f.n + 1 ELSE f.n END, f.used + q.t <= 9000 FROM fold f JOIN q ON q.k = f.k + 1 WHERE f.n < 30)
SELECT q.rel_path, q.chunk_index, q.t AS token_estimate, q.score, concat_ws(',', 'bm25-hit', CASE WHEN q.hinted THEN 'section-category-match' END, CASE WHEN q.central THEN 'graph-centrality-hint' END, {last}, CASE WHEN q.expanded THEN 'boundary-expanded' END) AS reason_codes
FROM fold f JOIN q USING (k) WHERE f.kept"""


def _single_evidence(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    c = cut(fx.chunks(spark, sf_dir))
    found = r.single_pass_evidence(c, cut(_scores(c)), cut(_central(spark, sf_dir)), ASKED, "architecture", mode, 30, 9000)
    return found.select("rel_path", "chunk_index", "token_estimate", "score", F.array_join("reason_codes", ",").alias("reason_codes"))


@query(_single_sql(_HYBRID, "CASE WHEN q.extra THEN 'symbol-path-hint' END"))
def single_pass_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback's evidence: grown to boundaries and folded into a budget."""
    return _single_evidence(spark, sf_dir, "hybrid")


@query(_single_sql(_VECTORLESS, "'vectorless-graph-prior'"))
def single_pass_bundle_vectorless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single_evidence(spark, sf_dir, "vectorless")


@query("""WITH RECURSIVE q AS (SELECT doc_id, CAST(coalesce(n_chars, 0) // 4 + 1 AS BIGINT) AS t, row_number() OVER (ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS k FROM documents),
fold(k, used, kept) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT q.k, CASE WHEN f.used + q.t <= 12000 THEN f.used + q.t ELSE f.used END, f.used + q.t <= 12000 FROM fold f JOIN q ON q.k = f.k + 1)
SELECT q.doc_id, q.t AS token_estimate FROM fold f JOIN q USING (k) WHERE f.kept""")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("rel_path"), F.lit(0).cast("long").alias("chunk_index"), (F.floor(n / 4) + 1).cast("long").alias("token_estimate"), n.cast("double").alias("score"))
    return r.pack(rows, 12000).select(F.col("rel_path").cast("long").alias("doc_id"), "token_estimate")


@query("WITH " + fx.SCORES_SQL + """, q AS (SELECT 1 AS query_no, rel_path, chunk_index, bm25 AS score FROM stage1 UNION ALL SELECT 2, rel_path, chunk_index, bm25 * 2 FROM stage1 WHERE rank % 2 = 0 UNION ALL SELECT 2, rel_path, chunk_index, bm25 FROM scores WHERE chunk_index = 3)
SELECT query_no, rel_path, chunk_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rel_path, chunk_index ORDER BY query_no, score DESC) AS rn FROM q) WHERE rn = 1""")
def merge_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = cut(_scores(fx.chunks(spark, sf_dir)))
    stage1 = r.ranked(r.top(scores, "bm25"), "bm25")
    take = lambda rows, n, s: rows.select(F.lit(n).alias("query_no"), "rel_path", "chunk_index", s.alias("score"))
    rows = take(stage1, 1, F.col("bm25")).unionByName(take(stage1.where("rank % 2 = 0"), 2, F.col("bm25") * 2)).unionByName(take(scores.where("chunk_index = 3"), 2, F.col("bm25")))
    return r.merge_bundles(rows).withColumn("score", F.round("score", 6))


@query("WITH " + fx.SCORES_SQL + " SELECT rel_path, first(chunk_index ORDER BY bm25 DESC, chunk_index) AS chunk_index, max(bm25) AS score FROM scores GROUP BY rel_path")
def best_chunk_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_per_file(_scores(fx.chunks(spark, sf_dir)).withColumnRenamed("bm25", "score"))


#: A constant query for each section that asks the index, in terms that the corpus has.
WORKLOAD = (
    "the and ention main", "services api core layer", "und der thand router", "utils models folder", "for that rules ein", "les des maison handlers",
    "infra core ment config", "setup readme docs the", "domain models term und", "token und risk la",
)


def _workload_sql() -> str:
    asked = ", ".join(f"({k}, '{t}')" for k, q in enumerate(WORKLOAD) for t in q.split())
    return fx.TERMS_SQL + f""", queries(query_no, term) AS (VALUES {asked}), asked AS (SELECT query_no, term, idf FROM queries JOIN idfs USING (term) WHERE idf > 0),
parts AS (SELECT a.query_no, t.rel_path, t.chunk_index, a.idf * (t.f * 3.0 / (t.f + 2.0 * (0.25 + 0.75 * t.dl / s.avgdl))) AS part FROM terms t JOIN asked a USING (term) CROSS JOIN stats s
 UNION ALL SELECT a.query_no, d.rel_path, d.chunk_index, a.idf FROM told d JOIN asked a ON contains(lower(d.rel_path), a.term) WHERE len(d.tokens) > 0),
s AS (SELECT query_no, rel_path, chunk_index, round(sum(part), 6) AS bm25 FROM parts GROUP BY ALL HAVING round(sum(part), 6) > 0)
SELECT CAST(query_no AS BIGINT) AS query_no, rel_path, chunk_index, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY bm25 DESC, rel_path, chunk_index) AS rank FROM s) WHERE rank <= 100"""


@query("WITH " + _workload_sql())
def workload_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten constant queries of the sections, answered together."""
    return r.scores_of_many(fx.chunks(spark, sf_dir), [r.terms_of(q) for q in WORKLOAD])
