"""The driver's tables in the shape of snapshot tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import paths
from strataquill.session import spread, table

TOPS = ("src", "tests", "docs", "infra", "domain", "api", "services", "migrations")
SUBS = ("core", "utils", "handlers", "models", "routes")
EXTENSIONS = (".py", ".ts", ".md", ".json", ".go", ".png", ".spec.ts", ".js", ".txt", ".min.js", ".rs", ".yaml")


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def files(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, rel_path, size_bytes, content, language, category of documents."""
    docs = spread(table(spark, sf_dir, "documents")) if docs is None else docs
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    i = F.col("doc_id")
    name = F.concat(F.when(i % 29 == 0, "token_").when(i % 31 == 0, "main").otherwise("doc_"), i.cast("string"))
    rel = F.concat_ws("/", pick(TOPS, i % len(TOPS) + 1), pick(SUBS, F.floor(i / 8) % len(SUBS) + 1), F.concat(name, pick(EXTENSIONS, F.floor(i / 3) % len(EXTENSIONS) + 1)))
    rows = docs.select("doc_id", rel.alias("rel_path"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"))
    return rows.withColumn("language", paths.language(F.col("rel_path"))).withColumn("category", paths.category(F.col("rel_path")))


FILES_SQL = f"""
named AS (
  SELECT doc_id, text AS content, n_chars AS size_bytes,
    [{_listed(TOPS)}][doc_id % {len(TOPS)} + 1] || '/' || [{_listed(SUBS)}][(doc_id // 8) % {len(SUBS)} + 1] || '/' ||
    CASE WHEN doc_id % 29 = 0 THEN 'token_' WHEN doc_id % 31 = 0 THEN 'main' ELSE 'doc_' END || doc_id ||
    [{_listed(EXTENSIONS)}][(doc_id // 3) % {len(EXTENSIONS)} + 1] AS rel_path
  FROM documents
), suffixed AS (
  SELECT *, regexp_extract(rel_path, '(\\.[^./]+)$', 1) AS ext FROM named
), files AS (
  SELECT doc_id, rel_path, size_bytes, content,
    CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' WHEN '.go' THEN 'go'
      WHEN '.js' THEN 'javascript' WHEN '.rs' THEN 'rust' WHEN '.yaml' THEN 'yaml' END AS language,
    CASE WHEN contains(rel_path, 'token') THEN 'secret-risk' WHEN ext = '.png' THEN 'asset' WHEN rel_path LIKE '%.min.js' THEN 'generated'
      WHEN contains(rel_path, 'migration') THEN 'migration' WHEN rel_path LIKE 'tests/%' OR contains(rel_path, '.spec.') THEN 'test'
      WHEN rel_path LIKE 'docs/%' OR ext = '.md' THEN 'docs' WHEN rel_path LIKE 'infra/%' THEN 'infra' WHEN ext IN ('.json', '.yaml') THEN 'config'
      WHEN ext IN ('.py', '.ts', '.go', '.js', '.rs') THEN 'source' ELSE 'other' END AS category
  FROM suffixed
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataquill.operators.retrieval import flat_chunks

    return flat_chunks(files(spark, sf_dir))


CHUNKS_SQL = (
    FILES_SQL
    + r""", clean AS (
  SELECT rel_path, category, language, trim(regexp_replace(coalesce(content, ''), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS c,
    CASE WHEN category = 'docs' THEN 1800 WHEN category = 'config' THEN 1200 WHEN category = 'test' THEN 1400
      WHEN language IN ('python', 'typescript', 'javascript', 'ruby', 'elixir', 'julia') THEN 1500 ELSE 1300 END AS size
  FROM files WHERE category NOT IN ('generated', 'asset', 'secret-risk', 'other')
), slices AS (
  SELECT *, size - greatest(120, size // 8) AS step, unnest(range(0, CAST(greatest(0, ceil((length(c) - size) / (size - greatest(120, size // 8)))) AS BIGINT) + 1)) AS chunk_index
  FROM clean WHERE c <> ''
), chunks AS (
  SELECT rel_path, category, language, chunk_index, substr(c, chunk_index * step + 1, size) AS content,
    greatest(1, length(substr(c, chunk_index * step + 1, size)) // 4) AS token_estimate
  FROM slices
)"""
)

TERMS_SQL = (
    CHUNKS_SQL
    + """, told AS (
  SELECT rel_path, chunk_index, regexp_extract_all(lower(content), '[A-Za-z0-9_]+') AS tokens FROM chunks
), each AS (
  SELECT rel_path, chunk_index, len(tokens) AS dl, unnest(tokens) AS term FROM told
), terms AS (
  SELECT rel_path, chunk_index, dl, term, count(*) AS f FROM each GROUP BY ALL
), stats AS (
  SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM told
), dfs AS (
  SELECT term, count(*) AS df FROM terms GROUP BY term
), idfs AS (
  SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM dfs, stats WHERE df >= 2
)"""
)

QUERY = "the ention thand und für maison core"

ASKED = ("the", "ention", "thand", "und", "maison", "core")

SCORES_SQL = (
    TERMS_SQL
    + f""", asked AS (
  SELECT term, idf FROM idfs WHERE idf > 0 AND term IN ({_listed(ASKED)})
), parts AS (
  SELECT t.rel_path, t.chunk_index, a.idf * (t.f * 3.0 / (t.f + 2.0 * (0.25 + 0.75 * t.dl / s.avgdl))) AS part
  FROM terms t JOIN asked a USING (term) CROSS JOIN stats s
  UNION ALL
  SELECT d.rel_path, d.chunk_index, a.idf FROM told d JOIN asked a ON contains(lower(d.rel_path), a.term) WHERE len(d.tokens) > 0
), scores AS (
  SELECT rel_path, chunk_index, round(sum(part), 6) AS bm25 FROM parts GROUP BY ALL HAVING round(sum(part), 6) > 0
), stage1 AS (
  SELECT *, row_number() OVER (ORDER BY bm25 DESC, rel_path, chunk_index) AS rank FROM scores
  ORDER BY bm25 DESC, rel_path, chunk_index LIMIT 100
)"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_path, dst_path, edge_type, is_external: parts bought one after the other in an order."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem")
    # Rows that are equal in these have the same part, so the other columns of the SQL's order change no pair.
    order = ["l_linenumber", "l_partkey"]
    pairs = rows.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("b")).where("b is not null")
    node = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    return pairs.select(node("a").alias("src_path"), node("b").alias("dst_path"), F.lit("import").alias("edge_type"), (F.col("b") % 11 == 0).alias("is_external"))


EDGES_SQL = """
pairs AS (
  SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS b
  FROM lineitem
), edges AS (
  SELECT 'p' || a AS src_path, 'p' || b AS dst_path, 'import' AS edge_type, b % 11 = 0 AS is_external FROM pairs WHERE b IS NOT NULL
)"""


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("rel_path"))


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given communities of the parts."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("rel_path"), (F.col("p_partkey") % 37 * F.when(F.col("p_size") > 49, 1000).otherwise(1)).cast("long").alias("community_id"))


COMMUNITIES_SQL = """
members AS (
  SELECT 'p' || p_partkey AS rel_path, CAST(p_partkey % 37 * CASE WHEN p_size > 49 THEN 1000 ELSE 1 END AS BIGINT) AS community_id FROM part
), inner_pairs AS (
  SELECT DISTINCT src_path AS src, dst_path AS dst FROM edges WHERE NOT is_external
), cpairs AS (
  SELECT src, dst, a.community_id AS c_src, b.community_id AS c_dst FROM inner_pairs JOIN members a ON a.rel_path = src JOIN members b ON b.rel_path = dst
)"""


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the document files: each document to the ones at twice and at three times its number, plus one."""
    f = files(spark, sf_dir).select("doc_id", "rel_path")
    two = f.select("rel_path", F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 3 + 1)).alias("t"))
    return two.join(f.select(F.col("doc_id").alias("t"), F.col("rel_path").alias("dst_path")), "t").select(F.col("rel_path").alias("src_path"), "dst_path", F.lit("import").alias("edge_type"), F.lit(False).alias("is_external"))


FILE_EDGES_SQL = """
fe AS (
  SELECT a.rel_path AS src_path, b.rel_path AS dst_path FROM files a JOIN files b ON b.doc_id = a.doc_id * 2 + 1
  UNION ALL
  SELECT a.rel_path, b.rel_path FROM files a JOIN files b ON b.doc_id = a.doc_id * 3 + 1
)"""


def file_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("rel_path", (F.col("doc_id") % 101).alias("community_id"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols made of conversation turns and parts: rel_path, language, name, kind, line_start, line_end, signature, parent_name, extract_source."""
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    kinds, langs, ends = ("class", "function", "method", "class"), ("python", "go", "java", None, "rust"), ("Service", "Handler", "", "Utils", "_id", "Factory")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    name = F.concat(F.when(i % 3 == 0, F.initcap(F.substring_index("p_name", " ", 1))).otherwise(F.substring_index("p_name", " ", 1)), pick(ends, i % 6 + 1))
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(i % 7 == 0, "/tests").otherwise(""), F.lit("/m"), (i % 40).cast("string"), F.lit(".py"))
    return p.select(
        path.alias("rel_path"), pick(langs, i % 5 + 1).alias("language"), name.alias("name"), pick(kinds, i % 4 + 1).alias("kind"), i.alias("line_start"), (i + F.col("p_size")).alias("line_end"),
        F.when(i % 2 == 0, F.col("p_name")).alias("signature"), F.when(i % 4 == 2, F.col("p_type")).alias("parent_name"), F.lit("lexical").alias("extract_source"),
    )


SYMBOLS_SQL = """
symbols AS (
  SELECT 'src/' || lower(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 7 = 0 THEN '/tests' ELSE '' END || '/m' || (p_partkey % 40) || '.py' AS rel_path,
    ['python', 'go', 'java', NULL, 'rust'][p_partkey % 5 + 1] AS language,
    CASE WHEN p_partkey % 3 = 0 THEN upper(substr(split_part(p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) ELSE split_part(p_name, ' ', 1) END
      || ['Service', 'Handler', '', 'Utils', '_id', 'Factory'][p_partkey % 6 + 1] AS name,
    ['class', 'function', 'method', 'class'][p_partkey % 4 + 1] AS kind, p_partkey AS line_start, p_partkey + p_size AS line_end,
    CASE WHEN p_partkey % 2 = 0 THEN p_name END AS signature, CASE WHEN p_partkey % 4 = 2 THEN p_type END AS parent_name, 'lexical' AS extract_source
  FROM part
)"""
