"""Queries over file manifests and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import paths, text
from strataquill.operators import analyzers, manifest, reports, symbols
from strataquill.plans import fixtures as fx
from strataquill.plans.registry import query
from strataquill.session import ship, table

_F = "WITH " + fx.FILES_SQL


@query(_F + " SELECT rel_path, language, category, size_bytes, size_bytes // 40 AS est_lines, sha1(coalesce(content, '')) AS checksum FROM files")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(fx.files(spark, sf_dir))


_BEFORE = """, now AS (SELECT rel_path, sha1(coalesce(content, '')) AS checksum, size_bytes, CASE WHEN doc_id % 11 <> 0 THEN doc_id * 1000 END AS mtime_ns FROM files),
before AS (SELECT rel_path, sha1(CASE WHEN doc_id % 5 = 0 THEN content || '!' ELSE coalesce(content, '') END) AS checksum, size_bytes, CASE WHEN doc_id % 11 <> 0 THEN doc_id * 1000 + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END END AS mtime_ns FROM files WHERE doc_id % 7 <> 0),
delta AS (SELECT n.rel_path, CASE WHEN b.rel_path IS NULL THEN 'new' WHEN b.checksum IS NOT DISTINCT FROM n.checksum AND b.size_bytes IS NOT DISTINCT FROM n.size_bytes AND b.mtime_ns IS NOT DISTINCT FROM n.mtime_ns THEN 'unchanged' ELSE 'changed' END AS change
  FROM now n LEFT JOIN before b USING (rel_path))"""


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.files(spark, sf_dir).withColumn("mtime_ns", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") * 1000))
    touched = F.col("mtime_ns") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)
    old = f.where("doc_id % 7 <> 0").withColumn("mtime_ns", touched).withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return manifest.delta(manifest.manifest(f), manifest.manifest(old))


@query(_F + _BEFORE + " SELECT rel_path, change FROM delta")
def manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


@query(_F + _BEFORE + " SELECT count(*) AS total, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, CAST(0 AS BIGINT) AS ignored FROM delta")
def manifest_delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.delta_counts(_delta(spark, sf_dir))


@query(_F + """, parts AS (SELECT DISTINCT string_split(rel_path, '/') AS p FROM files), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM parts)
SELECT DISTINCT array_to_string(p[1:i], '/') AS path, i < len(p) AS is_dir, i AS depth,
 array_to_string(list_transform(p[1:i], lambda x, k: CASE WHEN k < len(p) THEN '0' ELSE '1' END || lower(x) || chr(1) || x), chr(2)) AS place FROM n""")
def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tree(fx.files(spark, sf_dir), limit=None)


@query(_F + " SELECT rel_path, category, size_bytes FROM files ORDER BY rel_path LIMIT 200")
def manifest_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.preview(fx.files(spark, sf_dir).select("rel_path", "category", "size_bytes"))


@query(_F + " SELECT rel_path FROM files WHERE rel_path NOT LIKE 'infra/%' AND NOT regexp_matches(rel_path, '\\.png$') AND NOT regexp_matches(rel_path, '^src/.*/doc_1.*\\.py$')")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.visible(fx.files(spark, sf_dir).select("rel_path"), ["infra/**", "*.png", "src/*/doc_1*.py"])


@query(_F + " SELECT category, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM files GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.counts(fx.files(spark, sf_dir), "category")


@query(_F + " SELECT language, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM files GROUP BY language")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.counts(fx.files(spark, sf_dir), "language")


@query(_F + r""" SELECT rel_path, regexp_matches(lower(rel_path), '^tests?/|_test\.|\.spec\.') AS v1,
 regexp_matches(rel_path, '(?i)(?:^|/)tests?(?:/|$)|test_|_test|\.test\.|\.spec\.') AS v2, regexp_matches(lower(rel_path), '/tests?/|_test\.py$|\.spec\.|\.test\.') AS v3,
 regexp_matches(rel_path, '/main[^/]*$') AND false OR regexp_matches(rel_path, '/bin/|/cmd/') AS entry, string_split(rel_path, '/')[1] AS module,
 CASE WHEN contains(rel_path, 'infrastructure') THEN 0 WHEN contains(rel_path, 'domain') THEN 1 WHEN contains(rel_path, 'service') THEN 2 WHEN contains(rel_path, 'api') THEN 3
  WHEN contains(rel_path, 'controllers') THEN 4 WHEN contains(rel_path, 'routes') THEN 5 ELSE -1 END AS layer,
 regexp_extract(rel_path, '([^/]+)\.[^./]+$', 1) AS stem FROM files""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("rel_path")
    return fx.files(spark, sf_dir).select(
        p, paths.is_test_manifest(p).alias("v1"), paths.is_test_analysis(p).alias("v2"), paths.is_test_export(p).alias("v3"), paths.is_entrypoint(p).alias("entry"),
        paths.module_of(p).alias("module"), paths.layer_of(p).alias("layer"), paths.stem(p).alias("stem"),
    )


@query(r"""SELECT page_id, regexp_matches(regexp_replace(lower(url), '[?#].*$', ''), '(?:^|/)(?:main\.py|__main__\.py|app\.py|server\.py|cli\.py|index\.tsx?)$|/bin/|/cmd/|/manage\.py$') AS entry,
 CASE WHEN contains(lower(url), 'github.com') THEN 'github' WHEN contains(lower(url), 'bitbucket.org') THEN 'bitbucket' ELSE 'local' END AS host FROM pages""")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.lower("url"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", paths.is_entrypoint(bare).alias("entry"), text.source_host(F.col("url")).alias("host"))


@query(_F + " SELECT count(*) AS n_files, greatest(1200, count(*) * 220) AS estimated_tokens FROM files")
def token_estimate_for_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.estimate_tokens(fx.files(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return manifest.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS name, count(*) AS n_rows FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, items = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    levels = {
        "customer": (customers.select(F.col("c_custkey").alias("cust"), F.col("c_custkey").alias("gone")), "cust", "gone"),
        "orders": (orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("order")), "order", "cust"),
        "lineitem": (items.select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("item")), "item", "order"),
    }
    left = manifest.cascade(levels, customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("gone")), "gone")
    return reduce(DataFrame.unionByName, (rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows")) for name, rows in left.items()))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def point_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and value of some rows replaced."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("done").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return manifest.updated(orders, changes, "o_orderkey")


@query(_F + " SELECT count(*) FILTER (WHERE NOT i) AS n_files, count(*) FILTER (WHERE i) AS n_ignored FROM (SELECT rel_path LIKE 'infra/%' OR regexp_matches(rel_path, '\\.png$') AS i FROM files)")
def file_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.estimate_files(fx.files(spark, sf_dir).select("rel_path"), ["infra/**", "*.png"])


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def report_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return reports.cached_report(rows, ["o_custkey"]).select("o_custkey", F.col("id").alias("o_orderkey"))


# Symbols -----------------------------------------------------------------------------------------------------------

_S = "WITH " + fx.SYMBOLS_SQL


@query(_S + """ SELECT rel_path, name, line_start, CAST(CASE WHEN name = 'small' THEN 0 WHEN lower(name) LIKE 'small%' THEN 1 ELSE 2 END AS BIGINT) AS level
FROM symbols WHERE lower(name) LIKE '%small%' OR lower(rel_path) LIKE '%small%' ORDER BY level, rel_path, line_start, name LIMIT 120""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.search(fx.symbols(spark, sf_dir), " small ").select("rel_path", "name", "line_start", "level")


@query(_S + " SELECT rel_path, name, line_start FROM symbols WHERE lower(rel_path) LIKE 'src/brand1%' ORDER BY rel_path, line_start, name LIMIT 500")
def symbol_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.by_prefix(fx.symbols(spark, sf_dir), "SRC/brand1").select("rel_path", "name", "line_start")


_QUOTED = ", ".join(f"'\"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '\"', '\"\"') || '\"'" for c in ("rel_path", "language", "name", "kind", "line_start", "line_end", "parent_name", "signature", "extract_source"))


@query(_S + f" SELECT DISTINCT rel_path, line_start, name, concat_ws(',', '\"snap 1\"', {_QUOTED}) AS line FROM symbols WHERE NOT regexp_matches(lower(rel_path), '/tests?/|_test\\.py$|\\.spec\\.|\\.test\\.')")
def symbol_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.export_lines(fx.symbols(spark, sf_dir), "snap 1")


@query(_S + " SELECT kind, language, count(*) AS n_symbols FROM symbols GROUP BY ALL")
def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.breakdown(fx.symbols(spark, sf_dir), "kind", "language")


@query(_S + """, c AS (SELECT lower(language) AS language, count(*) FILTER (WHERE kind = 'class') AS n_classes, count(*) FILTER (WHERE kind IN ('function', 'method')) AS n_functions FROM symbols WHERE language IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT *, CASE WHEN n_classes = 0 THEN 'purely functional' WHEN n_functions = 0 THEN 'class-heavy (no standalone functions)' WHEN n_classes / (n_classes + n_functions) > 0.4 THEN 'class-heavy OOP'
 WHEN n_classes / (n_classes + n_functions) < 0.1 THEN 'functional / procedural' END AS style FROM c WHERE n_classes + n_functions >= 10) WHERE style IS NOT NULL ORDER BY language LIMIT 4""")
def class_function_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.class_function_style(fx.symbols(spark, sf_dir))


@query(_S + """, s AS (SELECT CASE WHEN name LIKE '%Service' THEN 'Service' WHEN name LIKE '%Handler' THEN 'Handler' WHEN name LIKE '%Factory' THEN 'Factory' WHEN name LIKE '%Utils' THEN 'Utils' END AS suffix FROM symbols WHERE kind = 'class')
SELECT suffix, count(*) AS n FROM s WHERE suffix IS NOT NULL GROUP BY suffix HAVING count(*) >= 2 ORDER BY n DESC, suffix LIMIT 5""")
def suffix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.suffix_histogram(fx.symbols(spark, sf_dir))


@query(_S + r""", n AS (SELECT name FROM symbols WHERE kind IN ('function', 'method') AND name NOT LIKE '\_%' ESCAPE '\' ORDER BY line_start, name LIMIT 300),
c AS (SELECT count(*) FILTER (WHERE regexp_matches(name, '^[a-z][a-zA-Z0-9]*$')) AS n_camel, count(*) FILTER (WHERE regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')) AS n_pascal, count(*) FILTER (WHERE regexp_matches(name, '^[a-z][a-z0-9_]*$')) AS n_snake, count(*) AS n FROM n)
SELECT *, CASE WHEN n > 0 AND greatest(n_camel, n_pascal, n_snake) * 2 >= n THEN CASE greatest(n_camel, n_pascal, n_snake) WHEN n_camel THEN 'camelCase' WHEN n_pascal THEN 'PascalCase' ELSE 'snake_case' END END AS style FROM c""")
def naming_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.symbols(spark, sf_dir).where(F.col("kind").isin("function", "method") & ~F.startswith("name", F.lit("_")))
    return analyzers.naming_style(rows.select("name", F.col("line_start").alias("ord")))


@query(r"""WITH h AS (SELECT page_id, 'module' AS kind, unnest(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1)) AS t FROM pages)
SELECT page_id, kind, substr(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 60) AS name, count(*) AS n FROM h WHERE trim(t) <> '' GROUP BY ALL""")
def html_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and ids of pages, by the operator on whole pages."""
    ship(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel_path"), F.lit("html").alias("language"), F.lit("source").alias("category"), F.col("html").alias("content"))
    return symbols.symbols(pages, repeats=True).groupBy(F.col("rel_path").cast("long").alias("page_id"), "kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query()
def file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents read as source files."""
    ship(spark)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"), F.lit("html").alias("language"), F.lit("source").alias("category"), F.col("html").alias("content"))
    return symbols.symbols(pages.unionByName(fx.files(spark, sf_dir).select("rel_path", "language", "category", "content")))


@query()
def syntax_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return symbols.syntax_chunks(fx.files(spark, sf_dir).where("category in ('source', 'test', 'infra')"))
