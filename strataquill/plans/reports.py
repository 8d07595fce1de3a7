"""Queries over reports, jobs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import text
from strataquill.operators import reports, retrieval, sections
from strataquill.plans.registry import query
from strataquill.session import ship, table
from strataquill.streaming import events as ev
from strataquill.streaming import state


@query("""SELECT o_orderkey AS id, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS repo_name, coalesce(n_name, 'unknown') AS branch, o_orderdate AS created_at
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0 LEFT JOIN nation ON n_nationkey = o_orderkey % 40 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), (F.col("o_orderkey") % 40).alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    repos = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    snapshots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("branch"))
    return reports.report_list(rows, repos, snapshots, 500)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def report_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return reports.cached_report(rows, ["o_custkey"]).select("o_custkey", F.col("id").alias("o_orderkey"))


@query("SELECT CAST(k AS BIGINT) AS pos, x AS conv_id, (SELECT min(text) FROM conversations c WHERE c.conv_id = x AND turn = 0) AS text FROM (VALUES (0, 9), (1, 3), (2, 100000), (3, 1)) v(k, x)")
def sections_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    return reports.in_order(rows.withColumn("conv_id", F.col("conv_id").cast("int")), "conv_id", [9, 3, 100000, 1])


# Each even conversation against the next one, turn by turn.
_SIDES = """WITH s AS (SELECT conv_id, turn, text, (conv_id // 2) || '-' || turn AS letter, ['high', 'medium', 'low', NULL][(conv_id + turn) % 4 + 1] AS confidence FROM conversations),
a AS (SELECT letter, confidence, text AS content FROM s WHERE conv_id % 2 = 0), b AS (SELECT letter, confidence, text AS content FROM s WHERE conv_id % 2 = 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scale = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", None)]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    letter = F.concat(F.floor(F.col("conv_id") / 2).cast("string"), F.lit("-"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", letter.alias("letter"), scale.alias("confidence"), F.col("text").alias("content"))
    return rows.where("conv_id % 2 = 0").drop("conv_id"), rows.where("conv_id % 2 = 1").drop("conv_id")


@query(_SIDES + r""", j AS (SELECT coalesce(a.letter, b.letter) AS letter, a.confidence AS ca, b.confidence AS cb, a.content AS ta, b.content AS tb FROM a FULL JOIN b ON a.letter = b.letter),
w AS (SELECT *, greatest(1, len(regexp_extract_all(ta, '[\pL\pN_\pM]+'))) AS wa, len(regexp_extract_all(tb, '[\pL\pN_\pM]+')) AS wb, CASE ca WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS ra, CASE cb WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rb FROM j)
SELECT letter, coalesce(ca, '?') <> coalesce(cb, '?') OR coalesce(ta, '?') <> coalesce(tb, '?') AS changed, CASE WHEN ca IS DISTINCT FROM cb THEN coalesce(ca, '?') || ' → ' || coalesce(cb, '?') END AS confidence_delta,
 CASE WHEN ta IS NOT NULL AND tb IS NOT NULL AND abs(wb - wa) / wa > 0.1 THEN round(abs(wb - wa) / wa * 100, 1) END AS word_delta_pct, CASE WHEN ra > 0 AND rb > 0 AND ra <> rb THEN rb > ra END AS improvement FROM w""")
def section_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.section_diff(*_sides(spark, sf_dir))


@query(_SIDES + """, r AS (SELECT (SELECT avg(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) FROM a) AS ma, (SELECT avg(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) FROM b) AS mb)
SELECT round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, CASE WHEN mb > ma + 0.15 THEN 'improving' WHEN mb < ma - 0.15 THEN 'degrading' ELSE 'stable' END AS trend FROM r""")
def confidence_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumnRenamed("confidence", "score") for x in _sides(spark, sf_dir))
    return reports.quality_trend(a, b)


@query("""WITH o AS (SELECT DISTINCT doc_id % 3 AS k, lang || source || (doc_id // 3 % 400) AS item FROM documents WHERE doc_id % 2 = 0), n AS (SELECT DISTINCT doc_id % 3 AS k, lang || source || (doc_id // 3 % 400) AS item FROM documents WHERE doc_id % 5 = 0)
SELECT k, change, item FROM (SELECT *, row_number() OVER (PARTITION BY k, change ORDER BY item) AS rn FROM (SELECT k, 'added' AS change, item FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT k, 'removed', item FROM (SELECT * FROM o EXCEPT SELECT * FROM n))) WHERE rn <= 80""")
def list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("k"), F.concat("lang", "source", (F.floor(F.col("doc_id") / 3) % 400).cast("string")).alias("item"))
    return reports.list_diff(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 5 = 0"), "k", "item")


@query(r"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE 'k,z' END AS known,
 CASE WHEN event_id % 3 = 0 THEN 'a,z' ELSE 'a' END AS missing FROM events""")
def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found in answers with fences and words around them, and the keys that they lack."""
    e = table(spark, sf_dir, "events")
    whole = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "z": 1}')))
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), whole, F.lit(" done.")))
    found = reports.parse_loose(answer, "k string, z string")
    return e.select("event_id", found["k"].alias("k"), F.array_join(F.sort_array(F.json_object_keys(whole)), ",").alias("known"), F.array_join(reports.missing_keys(whole, ["z", "k", "a"]), ",").alias("missing"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq, count(*) AS n_events FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest_state(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_id >= 100")
def event_offset_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.offset_slice(table(spark, sf_dir, "events"), "user_id", 8, "event_id", 100).select("event_id", "event_type")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS status, max(event_id) AS seq, count(*) AS n_events FROM events GROUP BY ALL")
def section_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest_state(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


@query("""WITH l AS (SELECT user_id AS job_id, event_type AS step, arg_max(value, event_id) AS percent, max(event_type = 'error' AND value > 400) AS failed FROM events GROUP BY ALL),
r AS (SELECT job_id, count(*) FILTER (WHERE percent >= 100) AS n_done, count(*) AS n_steps, max(failed) AS failed FROM l GROUP BY 1)
SELECT job_id, n_done, n_steps, CASE WHEN failed THEN 'failed' WHEN n_done = n_steps THEN 'done' WHEN n_done > 0 THEN 'running' ELSE 'pending' END AS state FROM r""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error") & (F.col("value") > 400)
    return ev.job_progress(e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("step"), F.col("value").alias("percent"), failed.alias("failed"), F.col("event_id").alias("seq")))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq, count(*) AS n_events FROM events GROUP BY user_id")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of job_latest_state, run as a stream over all that is there."""
    import uuid

    from strataquill.session import ensure_checkpoint_dir

    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return ev.run_available(ev.stream_latest(source, ["user_id"], "event_type", "event_id"), f"{ensure_checkpoint_dir(spark).rstrip('/')}/events_{uuid.uuid4().hex}")


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS key, arg_max(CAST(event_id % 1000 AS VARCHAR), event_id) AS status, max(event_id) AS seq, count(*) AS n_events FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded by user and type in keyed state, as a stream over all that is there."""
    import uuid

    from strataquill.session import ensure_checkpoint_dir

    ship(spark)
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.where("user_id is not null").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 1000).cast("string").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    with state.store(spark):
        found = ev.run_available(state.stream_jobs(rows), f"{ensure_checkpoint_dir(spark).rstrip('/')}/jobs_{uuid.uuid4().hex}", "update")
    return state.latest_of(found).select("job_id", "key", "status", "seq", "n_events")


@query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(trim(source), '[^a-zA-Z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), ''), 'report') AS slug, length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS n_clean, CASE WHEN lang IN ('high', 'medium', 'low') THEN lang ELSE 'medium' END AS confidence FROM documents")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.slug(F.col("source")).alias("slug"), F.char_length(text.strip_controls(F.col("text"))).cast("long").alias("n_clean"), text.normalized_confidence(F.col("lang")).alias("confidence"))


@query("SELECT conv_id AS id, string_agg('## ' || lpad(CAST(turn AS VARCHAR), 6, '0') || '. ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("letter"), F.col("role").alias("title"), F.col("text").alias("content"))
    return reports.to_markdown(rows)


_COHORTS = """WITH d AS (SELECT doc_id, lang || '-' || (doc_id % 13) AS title, ['high', 'medium', 'low'][doc_id % 3 + 1] AS severity, text AS item FROM documents),
o AS (SELECT title, severity, max(item) AS item FROM d WHERE doc_id % 2 = 0 GROUP BY ALL), n AS (SELECT title, severity, max(item) AS item FROM d WHERE doc_id % 5 <> 0 AND doc_id % 4 <> 2 GROUP BY ALL)"""


@query(_COHORTS + """ SELECT 'added' AS change, title, severity, substr(item, 1, 300) AS item FROM n WHERE (title, severity) NOT IN (SELECT (title, severity) FROM o)
UNION ALL SELECT 'removed', title, severity, substr(item, 1, 300) FROM o WHERE (title, severity) NOT IN (SELECT (title, severity) FROM n)""")
def findings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    scale = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (i % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(i, F.concat("lang", F.lit("-"), (i % 13).cast("string")).alias("title"), scale.alias("severity"), F.col("text").alias("item"))
    return reports.findings_diff(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 5 <> 0 and doc_id % 4 <> 2"))


@query(_SIDES + """, j AS (SELECT coalesce(a.letter, b.letter) AS letter, coalesce(a.confidence, '') AS x, coalesce(b.confidence, '') AS y FROM a FULL JOIN b ON a.letter = b.letter)
SELECT letter, CASE x WHEN '' THEN '?' ELSE x END || ' → ' || CASE y WHEN '' THEN '?' ELSE y END AS change FROM j WHERE x <> y""")
def score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumnRenamed("confidence", "score") for x in _sides(spark, sf_dir))
    return reports.score_changes(a, b)


@query(r"""SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(q), lambda x: {'p': list_position(q, x), 'x': x})), lambda s: s.x), '|') AS queries,
 regexp_matches(lower(t), 'truncated|not provided|not present|not included|could not be verified|were not provided|not available|incomplete|limited to|missing') AS misses
FROM (SELECT item_id, t, list_concat(regexp_extract_all(t, '[\w./-]+\.\w{1,10}'), [trim(substr(t, 1, 150))]) AS q FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'src/a' || item_id || '.py is missing, ' ELSE '' END || text AS t FROM benchmark))""".replace("\\\\", "\\"))
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("src/a"), F.col("item_id").cast("string"), F.lit(".py is missing, "))).otherwise(""), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.follow_ups(note), "|").alias("queries"), text.misses_evidence(note).alias("misses"))


@query(r"""SELECT o_orderkey, regexp_matches(m, '(^|[^0-9])1\.5b([^0-9]|$)|(^|[^0-9])1b([^0-9]|$)|(^|[^0-9])2b([^0-9]|$)|(^|[^0-9])3b([^0-9]|$)|:mini\b|:tiny\b|tinyllama|gemma[-_]?2b|qwen[^:]*:1\.5b|phi[-_]?3[:_-]?mini|smollm') AS is_small
FROM (SELECT o_orderkey, ['llama-' || (o_orderkey % 40) || 'b', 'phi3:mini', 'x' || (o_orderkey % 5) || 'B-it', 'SmolLM', 'qwen2:1.5b'][o_orderkey % 5 + 1] AS n, lower(n) AS m FROM orders)""")
def small_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(F.concat(F.lit("llama-"), (k % 40).cast("string"), F.lit("b")), F.lit("phi3:mini"), F.concat(F.lit("x"), (k % 5).cast("string"), F.lit("B-it")), F.lit("SmolLM"), F.lit("qwen2:1.5b"))
    return table(spark, sf_dir, "orders").select(k, text.is_small_model(F.element_at(names, (k % 5 + 1).cast("int"))).alias("is_small"))


@query("""SELECT ord, rel_path, excerpt FROM (SELECT doc_id AS ord, source AS rel_path, text AS excerpt, row_number() OVER (PARTITION BY source, substr(text, 1, 100) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 ORDER BY ord LIMIT 15""")
def supplemental_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("rel_path"), F.col("text").alias("excerpt"))
    return retrieval.supplement(rows)


@query("""SELECT rel_path, chunk_index FROM (SELECT 'd' || (doc_id % 17) || '/' || ['README.md', 'readme.rst', 'main.py', 'go.mod', 'x.json'][doc_id % 5 + 1] AS rel_path, doc_id AS chunk_index FROM documents)
WHERE lower(rel_path) LIKE '%readme.md' OR lower(rel_path) LIKE '%readme.rst' ORDER BY length(rel_path), rel_path, chunk_index LIMIT 40""")
def docs_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in ("README.md", "readme.rst", "main.py", "go.mod", "x.json")])
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (i % 17).cast("string"), F.lit("/"), F.element_at(names, (i % 5 + 1).cast("int"))).alias("rel_path"), i.alias("chunk_index"))
    return retrieval.named_files(rows, retrieval.DOC_NAMES, 40)


# Sections as JSON --------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN k IN (1, 4, 5) OR (k IN (2, 3) AND m > 0) THEN 1 ELSE 0 END::BIGINT AS n_problems,
 CASE WHEN k = 1 THEN '$.confidence: missing' WHEN k = 2 AND m > 0 THEN '$.terms[' || (m - 1) || '].definition: not a string' WHEN k = 3 AND m > 0 THEN '$.terms[' || (m - 1) || '].evidence_files: not a list'
  WHEN k = 4 THEN '$.confidence: not one of high, medium, low' WHEN k = 5 THEN '$: not JSON' ELSE '' END AS shown
FROM (SELECT doc_id, doc_id % 6 AS k, len(coalesce(text, '')) % 4 AS m FROM documents)""")
def section_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary sections made of documents' texts, some of them broken in one of five ways, against their contract."""
    d = table(spark, sf_dir, "documents").select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).withColumns({"k": F.col("doc_id") % 6, "m": F.char_length("text") % 4})
    term, definition, files = F.col("lang").alias("term"), F.substring("text", 1, 40), F.array("source")
    made = lambda definition, files: F.to_json(F.struct(term, definition.alias("definition"), files.alias("evidence_files")))
    good, last = made(definition, files), F.when(F.col("k") == 2, made(F.col("doc_id"), files)).when(F.col("k") == 3, made(definition, F.col("source"))).otherwise(made(definition, files))
    terms = F.when(F.col("m") > 0, F.array_join(F.concat(F.array_repeat(good, (F.col("m") - 1).cast("int")), F.array(last)), ",")).otherwise("")
    confidence = F.when(F.col("k") == 1, "").when(F.col("k") == 4, ',"confidence":"sure"').otherwise(',"confidence":"High"')
    whole = F.concat(F.lit('{"terms":['), terms, F.lit("]"), confidence, F.lit(',"blind_spots":'), F.to_json(F.array("source")), F.when(F.col("k") == 5, "").otherwise("}"))
    found = sections.validated(d.select("doc_id", F.lit("I").alias("letter"), whole.alias("section")))
    return found.select("doc_id", F.size("problems").cast("long").alias("n_problems"), F.array_join(F.transform("problems", lambda p: F.concat_ws(": ", p["path"], p["problem"])), "; ").alias("shown"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, '{"a":"' || coalesce(role, '') || '","b":[' || turn || ',{"c":1,"d":' || len(coalesce(text, '')) || '}]}' AS item FROM conversations),
s AS (SELECT conv_id, list_sort(list(DISTINCT item) FILTER (WHERE turn % 2 = 0)) AS o, list_sort(list(DISTINCT item) FILTER (WHERE turn % 3 <> 1)) AS n, list(item ORDER BY turn, item) FILTER (WHERE turn % 2 = 0) AS ol, list(item ORDER BY turn, item) FILTER (WHERE turn % 3 <> 1) AS nl,
 list_sort(list(DISTINCT '"' || role || '"') FILTER (WHERE turn % 2 = 0)) AS ro, list_sort(list(DISTINCT '"' || role || '"') FILTER (WHERE turn % 3 <> 1)) AS rn FROM c GROUP BY conv_id HAVING count(*) FILTER (WHERE turn % 2 = 0) > 0 AND count(*) FILTER (WHERE turn % 3 <> 1) > 0),
f AS (SELECT *, '{"confidence":"low","roles":[' || array_to_string(ro, ',') || '],"turns":[' || array_to_string(ol, ',') || ']}' AS fo, '{"confidence":"high","roles":[' || array_to_string(rn, ',') || '],"turns":[' || array_to_string(nl, ',') || ']}' AS fn FROM s)
SELECT conv_id, true AS changed, 2 AS confidence_delta, len(regexp_extract_all(fo, '[A-Za-z0-9_]+')) AS words_a, len(regexp_extract_all(fn, '[A-Za-z0-9_]+')) AS words_b,
 array_to_string(list_concat([('roles:' || x)[:246] for x in rn if NOT list_contains(ro, x)], [('turns:' || x)[:246] for x in n if NOT list_contains(o, x)])[:80], '|') AS added,
 array_to_string(list_concat([('roles:' || x)[:246] for x in ro if NOT list_contains(rn, x)], [('turns:' || x)[:246] for x in o if NOT list_contains(n, x)])[:80], '|') AS removed FROM f""")
def section_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a section per conversation, whose objects have their keys in different orders."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.char_length(F.coalesce("text", F.lit(""))).cast("string").alias("n"))

    def side(where: str, confidence: str, item: list) -> DataFrame:
        told = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in item))
        rows = c.where(where).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", told.alias("item")))).alias("turns"), F.array_sort(F.collect_set("role")).alias("roles"))
        return rows.select("conv_id", F.concat(F.lit('{"turns":['), F.array_join(F.transform("turns", lambda x: x["item"]), ", "), F.lit('], "roles":'), F.to_json("roles"), F.lit(f', "confidence":"{confidence}"}}')).alias("section"))

    turn = F.col("turn").cast("string")
    old = side("turn % 2 = 0", "low", ['{"b": [', turn, ', {"d": ', F.col("n"), ', "c": 1}], "a": "', F.col("role"), '"}'])
    new = side("turn % 3 <> 1", "high", ['{"a": "', F.col("role"), '", "b": [', turn, ', {"c": 1, "d": ', F.col("n"), "}]}"])
    found = sections.section_diffs(old, new, ["conv_id"])
    return found.select("conv_id", "changed", F.col("confidence_delta").cast("int"), "words_a", "words_b", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))
