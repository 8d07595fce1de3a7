"""Queries of small operators: scalars on text, report fields, filters, and source code made of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import text
from strataquill.operators import manifest, references, reports, retrieval, symbols
from strataquill.plans.registry import query
from strataquill.session import ship, spread, table

# Text ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(h) - length(replace(h, chr(10), '')) + 1 AS line FROM (SELECT doc_id, substr(text, 1, n_chars // 2) AS h FROM documents WHERE text IS NOT NULL)")
def offset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", text.line_of(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > cap THEN rtrim(substr(text, 1, cap)) || '...' ELSE text END AS excerpt FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 4000 ELSE 2000 END AS cap FROM documents)")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), F.col("doc_id") % 2 == 0).alias("excerpt"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda x: {'p': list_position(t, x), 'x': x})), lambda s: s.x), '|') AS patterns
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS t FROM conversations)""")
def pattern_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.coalesce("text", F.lit("")), ",")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.clean_patterns(parts), "|").alias("patterns"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, sha256(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), coalesce(CAST(CASE WHEN l_partkey % 3 > 0 THEN l_suppkey END AS VARCHAR), chr(0)))) AS id FROM lineitem")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, text.stable_id(*(F.col(k) for k in keys), F.when(F.col("l_partkey") % 3 > 0, F.col("l_suppkey"))).alias("id"))


@query("SELECT event_id, sha256('{\"a\":' || (event_id % 7) || ',\"z\":\"' || event_type || '\"}') AS hash FROM events")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose keys come in either order."""
    a, z = F.concat(F.lit('"a": '), (F.col("event_id") % 7).cast("string")), F.concat(F.lit('"z": "'), "event_type", F.lit('"'))
    written = F.when(F.col("event_id") % 2 == 0, F.concat_ws(", ", a, z)).otherwise(F.concat_ws(" , ", z, a))
    return table(spark, sf_dir, "events").select("event_id", reports.canonical_hash(F.concat(F.lit("{"), written, F.lit("}"))).alias("hash"))


# Reports -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'old' WHEN 2 THEN event_type WHEN 3 THEN event_type END AS section FROM events")
def report_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of stored reports: of versions 2 and 3 under one name, before that under another, of others none."""
    version = F.col("event_id") % 4
    held = F.when(version == 0, F.lit('"sections_v2": {"A": "old"}')).when(version == 1, F.lit('"sections_v2": {"B": "x"}')).otherwise(F.concat(F.lit('"sections": {"A": "'), "event_type", F.lit('"}, "sections_v2": {"A": "wrong"}')))
    report = F.concat(F.lit('{"version": '), version.cast("string"), F.lit(", "), held, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(reports.sections_of(report), F.lit("A")).alias("section"))


@query("SELECT c_custkey, c_name, c_custkey % 3 = 0 AS has_api_key FROM customer")
def provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("sk-"), "c_name")).when(F.col("c_custkey") % 3 == 1, "")
    return reports.without_secrets(table(spark, sf_dir, "customer").select("c_custkey", "c_name", key.alias("api_key")))


@query("SELECT event_id, event_type AS category FROM events WHERE event_type IN ('click', 'error')")
def findings_of_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.of_categories(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category")), ("click", "error"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey <> 100 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey = 100 UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 5 = 0")
def report_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports but one, that one, and those of no workspace."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, "w").alias("workspace_id"))
    alone = reports.get(rows, 100).select((-F.col("id")).alias("id"))
    return reports.without(rows, 100).select("id").unionByName(alone).unionByName(reports.of_workspace(rows, None).select((F.col("id") + 1000000000).alias("id")))


@query("WITH c AS (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) SELECT o_orderkey AS id FROM orders WHERE o_custkey = (SELECT o_custkey FROM c) AND o_orderkey <> (SELECT min(o_orderkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def snapshot_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("local_repo_id"), F.col("o_orderdate").alias("created_at"))
    return manifest.previous_snapshot(rows, rows.agg(F.min("id")).scalar()).select("id")


@query("""SELECT DISTINCT 'L' || turn AS letter FROM conversations WHERE turn = 2 OR (conv_id + turn) % 9 = 0 AND turn < 4""")
def sections_that_are_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = ((F.col("conv_id") + F.col("turn")) % 9 == 0) & (F.col("turn") < 4)
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("L"), F.col("turn").cast("string")).alias("letter"), F.when(low, " LOW ").otherwise("high").alias("confidence"))
    return reports.weak_sections(rows, ["L2"])


@query("SELECT o_orderkey, '  Tech stack: ' || o_orderstatus || ', x' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '  Domain: d' || (o_orderkey % 9) ELSE '' END AS context FROM orders")
def identity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    domain = F.when(k % 2 == 0, F.concat(F.lit(', "domain": "d'), (k % 9).cast("string"), F.lit('"'))).otherwise("")
    section = F.concat(F.lit('{"tech_stack": ["'), "o_orderstatus", F.lit('", "x"]'), domain, F.lit("}"))
    return table(spark, sf_dir, "orders").select(k, reports.identity_context(section).alias("context"))


@query("""SELECT item_id, '## I — Glossary / Domain Terms' || chr(10) || chr(10) || '| Term | Definition | Evidence |' || chr(10) || '|---|---|---|' || chr(10) || '| **t' || item_id || '** | d | `f.py` |' || chr(10) || chr(10) || '_Confidence: low_' AS markdown FROM benchmark""")
def glossary_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.concat(F.lit('{"terms": [{"term": "t'), F.col("item_id").cast("string"), F.lit('", "definition": "d", "evidence_files": ["f.py"]}], "confidence": "low"}'))
    return table(spark, sf_dir, "benchmark").select("item_id", reports.section_markdown(F.lit("I"), section).alias("markdown"))


# Evidence ------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, 'd' || doc_id, 0) AS k FROM documents), x AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS reason FROM e WHERE k <= 200)
SELECT reason, count(*) AS n, round(count(*) FILTER (WHERE doc_id % 2 = 0) / count(*), 6) AS precision FROM x GROUP BY reason""")
def precision_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("rel_path"), F.lit(0).cast("long").alias("chunk_index"), F.col("n_chars").alias("score"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("reason_codes"))
    return retrieval.precision_by_reason(rows, rows.where("doc_id % 2 = 0"), 200)


@query("SELECT count(DISTINCT source) AS n_cited, count(DISTINCT source) FILTER (WHERE source IN (SELECT source FROM documents WHERE lang = 'de')) AS n_hit, round(count(DISTINCT source) FILTER (WHERE source IN (SELECT source FROM documents WHERE lang = 'de')) / count(DISTINCT source), 6) AS rate FROM documents WHERE lang = 'en' AND source IS NOT NULL")
def evidence_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("rel_path")).where("rel_path is not null")
    return retrieval.hit_rate(rows.where("lang = 'en'"), rows.where("lang = 'de'"))


@query("SELECT count(*) AS n_queries, CAST(sum(o_orderkey % 1000) AS BIGINT) AS budget_tokens, CAST(sum(o_orderkey % 7) AS BIGINT) AS used_tokens FROM orders")
def bundle_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return retrieval.merged_totals(table(spark, sf_dir, "orders").select(k.alias("query_no"), (k % 1000).alias("budget_tokens"), (k % 7).alias("used_tokens")))


# Source code made of rows ----------------------------------------------------------------------------------------------

#: A source per language, and the declarations in it: name, kind, owner, first and last line. @ stands for the row's number.
SOURCES = {
    "typescript": ("export class A@ {\n  async get(x: string): Promise<void> {\n    const s = 'class No {'; // }\n    return foo(s);\n  }\n}\ninterface I@ { a: number }\nconst f@ = (x) => x;\n", [("A@", "class", None, 1, 6), ("get", "method", "A@", 2, 5), ("I@", "interface", None, 7, 7), ("f@", "function", None, 8, 8)]),
    "javascript": ("class A@ {\n  go() { if (x) { y() } }\n}\nfunction f@(a) {\n}\n", [("A@", "class", None, 1, 3), ("go", "method", "A@", 2, 2), ("f@", "function", None, 4, 5)]),
    "go": ("package m\n\ntype S@ struct {\n\ta int\n}\n\nfunc (s *S@) M() {\n\tx := \"}\"\n}\n\nfunc F@() {}\n", [("S@", "class", None, 3, 5), ("M", "method", "S@", 7, 9), ("F@", "function", None, 11, 11)]),
    "java": ("public class A@ {\n  A@(int x) { }\n  public int f(int x) {\n    return g(x); /* } */\n  }\n}\nenum E@ { X }\n", [("A@", "class", None, 1, 6), ("A@", "method", "A@", 2, 2), ("f", "method", "A@", 3, 5), ("E@", "enum", None, 7, 7)]),
    "rust": ("pub struct S@ { x: u8 }\nimpl S@ {\n    pub fn f(&self) -> u8 { self.x }\n}\ntrait T@ {}\nfn g@() {}\n", [("S@", "class", None, 1, 1), ("f", "method", "S@", 3, 3), ("T@", "interface", None, 5, 5), ("g@", "function", None, 6, 6)]),
    "c": ("#include <a.h>\nstruct S@ {\n  int a;\n};\nstatic int *f@(int a)\n{\n  return g(a);\n}\ntypedef unsigned long u@;\n", [("S@", "class", None, 2, 4), ("f@", "function", None, 5, 8), ("u@", "type", None, 9, 9)]),
    "cpp": ("namespace n {\nclass K@ {\n  int get() { return 1; }\n};\n}\nvoid f@() {\n}\n", [("K@", "class", None, 2, 4), ("get", "function", None, 3, 3), ("f@", "function", None, 6, 7)]),
    "zig": ("const S@ = struct {\n    a: u8,\n};\nfn f@() void {}\n", [("S@", "class", None, 1, 3), ("f@", "function", None, 4, 4)]),
    "bash": ("f@() {\n  echo '}'\n}\n", [("f@", "function", None, 1, 3)]),
    "kotlin": ("class A@ {\n  fun f() = 1\n}\ninterface I@\nfun g@() {\n}\n", [("A@", "class", None, 1, 3), ("f", "method", "A@", 2, 2), ("I@", "interface", None, 4, 4), ("g@", "function", None, 5, 6)]),
    "scala": ("object O@ {\n  def f(x: Int): Int = x\n}\ntrait T@\n", [("O@", "class", None, 1, 3), ("f", "method", "O@", 2, 2), ("T@", "interface", None, 4, 4)]),
    "groovy": ("class A@ {\n  def f(x) { x }\n}\n", [("A@", "class", None, 1, 3), ("f", "method", "A@", 2, 2)]),
    "ruby": ("module M@\n  class A\n    def f?\n      if x\n      end\n    end\n  end\nend\n", [("M@", "module", None, 1, 8), ("A", "class", "M@", 2, 7), ("f?", "method", "A", 3, 6)]),
    "php": ("<?php\nclass A@ {\n  public function f() { return \"}\"; }\n}\nfunction g@() {\n}\n", [("A@", "class", None, 2, 4), ("f", "method", "A@", 3, 3), ("g@", "function", None, 5, 6)]),
    "lua": ("local function f@(x)\n  if x then\n  end\nend\nT@ = {}\nfunction T@:m()\nend\n", [("f@", "function", None, 1, 4), ("T@", "class", None, 5, 5), ("m", "method", "T@", 6, 7)]),
    "csharp": ("namespace N@ {\n  class A {\n    public int F(int x) { return G(x); }\n  }\n}\n", [("N@", "module", None, 1, 5), ("A", "class", None, 2, 4), ("F", "method", "A", 3, 3)]),
    "haskell": ("f@ 0 = 1\nf@ n = n\n  where k = 1\ndata D@ = D\n", [("f@", "function", None, 1, 3), ("D@", "type", None, 4, 4)]),
    "ocaml": ("let f@ x =\n  x + 1\nlet v@ = 3\ntype t@ = A\n", [("f@", "function", None, 1, 2), ("v@", "variable", None, 3, 3), ("t@", "type", None, 4, 4)]),
    "elixir": ("defmodule A@ do\n  def f(x) do\n    x\n  end\nend\n", [("A@", "module", None, 1, 5), ("f", "function", "A@", 2, 4)]),
    "julia": ("module M@\nstruct S\n  x\nend\nfunction f(x)\n  for i in x\n  end\nend\nend\n", [("M@", "module", None, 1, 9), ("S", "class", "M@", 2, 4), ("f", "method", "M@", 5, 8)]),
    "yaml": ("a@: 1\nb:\n  c: 2\n", [("a@", "variable", None, 1, 1), ("b", "variable", None, 2, 3)]),
    "toml": ("[t@]\na = 1\n[x.y]\nb = 2\n", [("t@", "module", None, 1, 2)]),
    "json": ("{\"a@\": {\"b\": 1},\n \"c\": 2}", [("a@", "variable", None, 1, 1), ("c", "variable", None, 2, 2)]),
    "cmake": ("function(f@ a)\n  if(a)\n  endif()\nendfunction()\n", [("f@", "function", None, 1, 4)]),
    "sql": ("create table t@ (x int);\n-- create table no\ncreate view v@ as select 1;\n", [("t@", "class", None, 1, 1), ("v@", "class", None, 3, 3)]),
    "css": (".a@, .b {\n  c: d\n}\n@media (x) {}\n", [(".a@", "class", None, 1, 3), ("@media", "module", None, 4, 4)]),
    "markdown": ("# One@\n```\n# no\n```\n## Two\n", [("One@", "module", None, 1, 1), ("Two", "function", None, 5, 5)]),
    "svelte": ("<script>\nexport let a@;\nfunction f() {}\n</script>\n<style>b {}</style>\n", [("a@", "variable", None, 2, 2), ("f", "function", None, 3, 3), ("<style>", "module", None, 5, 5)]),
}
_LANGUAGES = list(SOURCES)

#: How a line of comment begins and ends in a language; none where it would be text or break the format.
COMMENTS = dict.fromkeys(("typescript", "javascript", "go", "java", "rust", "c", "cpp", "zig", "kotlin", "scala", "groovy", "csharp"), ("// ", "")) | dict.fromkeys(
    ("bash", "ruby", "elixir", "julia", "yaml", "toml", "cmake"), ("# ", "")
) | dict.fromkeys(("lua", "haskell", "sql"), ("-- ", "")) | {"css": ("/* ", " */"), "ocaml": ("(* ", " *)"), "svelte": ("<!-- ", " -->"), "markdown": ("> ", "")}
#: Formats that hold their declarations once; of the others, files have up to three copies, with names of their own.
ONCE = {"json", "yaml", "toml", "markdown", "haskell", "ocaml", "svelte", "php", "html"}


def _declared_sql() -> str:
    told = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {', '.join(map(told, (lang, *d, SOURCES[lang][0].count(chr(10)), lang in ONCE, lang in COMMENTS)))})" for k, lang in enumerate(_LANGUAGES) for d in SOURCES[lang][1])
    name = lambda c: f"CASE WHEN {c} LIKE '@%' THEN {c} ELSE replace({c}, '@', p_partkey || '_' || i) END"
    return f"""WITH d AS (SELECT p_partkey, p_size, x.*, unnest(range(CASE WHEN once THEN 1 ELSE 1 + p_partkey // {len(_LANGUAGES)} % 3 END)) AS i
FROM part JOIN (VALUES {rows}) x(k, language, name, kind, parent, a, b, n, once, said) ON k = p_partkey % {len(_LANGUAGES)})
SELECT p_partkey, language, {name('name')} AS name, kind, {name('parent')} AS parent_name, CAST(a + i * n + s AS BIGINT) AS line_start, CAST(b + i * n + s AS BIGINT) AS line_end
FROM (SELECT *, CASE WHEN said THEN p_size % 5 ELSE 0 END AS s FROM d)"""


@query(_declared_sql())
def declared_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of source files of 28 languages, one for each part: some lines of comments that look like code, then copies of
    declarations under names of their own."""
    ship(spark)
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(_LANGUAGES) + 1).cast("int"))
    first, last = pick([COMMENTS.get(x, ("", ""))[0] for x in _LANGUAGES]), pick([COMMENTS.get(x, ("", ""))[1] for x in _LANGUAGES])
    line = F.concat(first, F.coalesce("p_name", F.lit("")), F.lit(" class Fake { function no() { } } def f"), last, F.lit("\n"))
    noise = F.when(first != "", F.repeat(line, (F.col("p_size") % 5).cast("int"))).otherwise("")
    copies = F.when(pick([x in ONCE for x in _LANGUAGES]), 1).otherwise(1 + F.floor(k / len(_LANGUAGES)) % 3)
    # A sign that stands for the name is followed by no letter or is behind one; others, as in CSS, stay.
    own = lambda i: F.regexp_replace(pick([SOURCES[x][0] for x in _LANGUAGES]), F.lit("@(?!media)"), F.concat(k.cast("string"), F.lit("_"), i.cast("string")))
    content = F.concat(noise, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), own), ""))
    files = spread(table(spark, sf_dir, "part")).select(k.cast("string").alias("rel_path"), pick(_LANGUAGES).alias("language"), F.lit("source").alias("category"), content.alias("content"))
    return symbols.symbols(files).select(F.col("rel_path").cast("long").alias("p_partkey"), "language", "name", "kind", "parent_name", "line_start", "line_end")


_CODE = """WITH f AS (SELECT DISTINCT s_suppkey AS k FROM supplier)"""

STEMS = ("utils", "core", "models", "index", "base", "types", "helpers")
#: A module for each part: seven to a folder, under the same seven names in every folder.
_PLACE = "'pkg' || ({k} // 7) % 40 || '/sub' || {k} // 280 || '/' || [" + ", ".join(f"'{x}'" for x in STEMS) + "][{k} % 7 + 1]"
_MODULES_SQL = f"""WITH p AS (SELECT p_partkey AS k, (p_partkey * 13 + 5) % (SELECT max(p_partkey) + 1 FROM part) AS t, p_size AS z FROM part),
m AS (SELECT k, t, z, {_PLACE.format(k="k")} AS place FROM p),
e AS (SELECT m.k, m.z, m.place, o.place AS target, o.k AS ok FROM m JOIN m o ON o.k = m.t)"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files whose names repeat in many folders. Each imports, in one of four ways, from the file of another part, and
    holds a class and functions, after some lines of comments and strings that look like code."""
    parts = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"), F.coalesce("p_name", F.lit("")).alias("name"))
    most = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).scalar()
    stems = F.array(*[F.lit(x) for x in STEMS])
    text = lambda c: c.cast("string")

    def place(k: Column, glue: str) -> Column:
        return F.concat(F.lit("pkg"), text(F.floor(k / 7) % 40), F.lit(f"{glue}sub"), text(F.floor(k / 280)), F.lit(glue), F.element_at(stems, (k % 7 + 1).cast("int")))

    k, other = F.col("k"), F.col("t")
    rows = parts.withColumn("t", (k * 13 + 5) % most)
    module, folder, stem = place(other, "."), F.regexp_replace(place(other, "."), r"\.\w+$", ""), F.element_at(stems, (other % 7 + 1).cast("int"))
    head, call = (
        F.when(k % 4 == 0, a).when(k % 4 == 1, b).when(k % 4 == 2, c).otherwise(d)
        for a, b, c, d in (
            (F.concat(F.lit("from "), module, F.lit(" import go, Kit")), F.concat(F.lit("from ..."), module, F.lit(" import go as gone, Kit")), F.concat(F.lit("import "), module, F.lit(" as m\nfrom "), module, F.lit(" import Kit")), F.concat(F.lit("from "), folder, F.lit(" import "), stem, F.lit("\nfrom "), module, F.lit(" import Kit"))),
            (F.lit("go(x)"), F.lit("gone(x)"), F.lit("m.go(x)"), F.concat(stem, F.lit(".go(x)"))),
        )
    )
    noise = F.repeat(F.concat(F.lit("# go() "), "name", F.lit("\nNOTE = 'utils.go() and Kit().run()'\n")), (F.col("z") % 4).cast("int"))
    own = F.concat(F.lit("def go(x):\n    return x\n\n"), noise, F.lit("def call(x):\n    return "), call, F.lit("\n\n"))
    kit = F.concat(F.lit("class Kit"), text(k), F.lit("(Kit):\n    def __init__(self):\n        self.kit = Kit()\n\n    def use(self):\n        self.kit.run()\n        return self.mine()\n\n    def mine(self):\n        return None\n\n"))
    base = F.lit("class Kit:\n    def run(self):\n        return 1\n")
    return rows.select(F.concat(place(k, "/"), F.lit(".py")).alias("rel_path"), F.concat(head, F.lit("\n\n"), F.when(k % 2 == 0, noise).otherwise(""), own, F.when(k % 3 == 0, base).otherwise(kit)).alias("content"))


@query(_MODULES_SQL + """ SELECT place || '.py::call' AS src_symbol, target || '.py::go' AS dst_symbol, 'high' AS confidence FROM e
UNION ALL SELECT place || '.py::Kit' || k || '.use', place || '.py::Kit' || k || '.mine', 'high' FROM e WHERE k % 3 <> 0
UNION ALL SELECT place || '.py::Kit' || k || '.use', target || '.py::Kit.run', 'high' FROM e WHERE k % 3 <> 0 AND ok % 3 = 0""")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return references.symbol_edges(_modules(spark, sf_dir)).select("src_symbol", "dst_symbol", "confidence")


@query(_MODULES_SQL + " SELECT DISTINCT place || '.py' AS src_path, target || '.py' AS dst_path FROM e WHERE k <> ok")
def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return references.file_references(references.symbol_edges(_modules(spark, sf_dir)))


@query(_MODULES_SQL + """, d AS (SELECT k, place || '.py' AS src_path, replace(target, '/', '.') AS target FROM e)
SELECT src_path, target FROM d UNION ALL SELECT src_path, CASE WHEN k % 4 = 2 THEN target ELSE regexp_replace(target, '\\.\\w+$', '') END FROM d WHERE k % 4 >= 2""")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return symbols.imports_of(_modules(spark, sf_dir))


@query("""SELECT 'd' || p_partkey % 9 || '/s' || p_partkey || '.ts::Svc.run' AS src_symbol, 'd' || p_partkey % 9 || '/r' || p_partkey || '.ts::C' || i || '.find' AS dst_symbol, 'low' AS confidence
FROM part, LATERAL (SELECT unnest(range(1 + p_partkey % 3)) AS i)""")
def interface_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on an injected interface reach all classes that implement it, one to three; the same names are in all files."""
    ship(spark)
    k = F.col("p_partkey")
    n, place = k.cast("string"), F.concat(F.lit("d"), (k % 9).cast("string"), F.lit("/"))
    note = F.repeat(F.concat(F.lit("// "), F.coalesce("p_name", F.lit("")), F.lit(" class No implements Repo { find() { } }\n")), (F.col("p_size") % 4).cast("int"))
    one = lambda i: F.concat(F.lit("class C"), i.cast("string"), F.lit(" implements Repo {\n  find(id: string) { return 1; }\n}\n"))
    own = F.concat(note, F.lit("interface Repo {\n  find(id: string): any;\n}\n"), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: F.concat(one(i), note)), ""), F.lit("class Other {\n  find(id: string) { return 3; }\n}\n"))
    user = F.concat(F.lit("import { Repo } from './r"), n, F.lit("';\n"), note, F.lit("class Svc {\n  constructor(private repo: Repo) {}\n  run(id: string) {\n    return this.repo.find(id);\n  }\n}\n"))
    rows = spread(table(spark, sf_dir, "part")).select(F.explode(F.array(F.struct(F.concat(place, F.lit("r"), n, F.lit(".ts")).alias("rel_path"), own.alias("content")), F.struct(F.concat(place, F.lit("s"), n, F.lit(".ts")).alias("rel_path"), user.alias("content")))).alias("x")).select("x.*")
    return references.symbol_edges(rows).select("src_symbol", "dst_symbol", "confidence")


@query("""WITH p AS (SELECT p_partkey AS k, 2 + p_size % 4 AS m, p_partkey % 2 AS tail FROM part)
SELECT k AS p_partkey, CAST(0 AS BIGINT) AS chunk_index, 'import_group' AS chunk_type, '' AS names FROM p
UNION ALL SELECT k, CAST(i + 1 AS BIGINT), CASE WHEN k % 3 = 1 AND i % 2 = 0 THEN 'class' ELSE 'function' END, 'A' || k || '_' || i FROM p, LATERAL (SELECT unnest(range(m)) AS i)
UNION ALL SELECT k, CAST(m + 1 AS BIGINT), 'block', 'B' || k || ',C' || k FROM p WHERE tail = 1""")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks along the definitions of Go and Python sources: two to five that are large, and in half of the files two small
    ones at the end; what stands between them is left out."""
    ship(spark)
    k, name = F.col("p_partkey"), F.coalesce("p_name", F.lit(""))
    text = lambda c: c.cast("string")
    python = k % 3 == 1
    pad = F.when(python, F.concat(F.lit("    # "), name, F.lit(" padding def no(): class No:\n"))).otherwise(F.concat(F.lit("\t// "), name, F.lit(" padding } func No() {\n")))
    # Between 1,500 and 1,900 bytes: nothing fits into a chunk beside one, and none is taken apart.
    body = F.repeat(pad, (F.floor(1560 / F.octet_length(pad)) + F.col("p_size") % 5).cast("int"))
    called = lambda i: F.concat(F.lit("A"), text(k), F.lit("_"), text(i))
    own = lambda i: F.when(python & (i % 2 == 0), F.concat(F.lit("class "), called(i), F.lit(":\n"), body, F.lit("    x = 1\n\nLEFT = 1\n\n"))).when(python, F.concat(F.lit("def "), called(i), F.lit("():\n"), body, F.lit("    return 1\n\n"))).otherwise(F.concat(F.lit("func "), called(i), F.lit("() {\n"), body, F.lit("}\n\nvar left = 1\n\n")))
    head = F.when(python, "import os\nimport sys\n\n").otherwise('package m\n\nimport "fmt"\n\n')
    two = F.when(python, F.concat(F.lit("def B"), text(k), F.lit("():\n    return 1\n\ndef C"), text(k), F.lit("():\n    return 2\n"))).otherwise(F.concat(F.lit("func B"), text(k), F.lit("() {\n}\n\nfunc C"), text(k), F.lit("() {\n}\n")))
    content = F.concat(head, F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4 + 1), own), ""), F.when(k % 2 == 1, two).otherwise(""))
    files = spread(table(spark, sf_dir, "part")).select(text(k).alias("rel_path"), F.when(python, "python").otherwise("go").alias("language"), F.lit("source").alias("category"), content.alias("content"))
    found = symbols.syntax_chunks(files)
    return found.select(F.col("rel_path").cast("long").alias("p_partkey"), "chunk_index", "chunk_type", F.array_join("names", ",").alias("names"))


# Tables of snapshots and single files ----------------------------------------------------------------------------------


@query("""SELECT 's1' AS snapshot_id, o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 's2', o_orderkey, -1.0 FROM orders WHERE o_orderkey % 3 = 2
UNION ALL SELECT 's2', o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 6 = 3""")
def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written, replaced by snapshot, appended to, filled up and cut: s1 replaced, s2 grown, s3 dropped."""
    import uuid

    from strataquill.session import ensure_checkpoint_dir
    from strataquill.sources import snapshots

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_totalprice").alias("value"))
    of = lambda name, rows, value=None: rows.select(F.lit(name).alias("snapshot_id"), "id", F.col("value") if value is None else F.lit(value).alias("value"))
    snapshots.replace(of("s1", orders).unionByName(of("s3", orders)), path)
    snapshots.replace(of("s1", orders.where("id % 3 = 1")), path)
    snapshots.append(of("s2", orders.where("id % 3 = 2"), -1.0), path)
    snapshots.insert_absent(of("s2", orders.where("id % 3 = 2 or id % 6 = 3")), path, ["snapshot_id", "id"], ["value"])
    snapshots.drop(spark, path, ["s3"])
    return snapshots.read(spark, path).select("snapshot_id", "id", "value")


@query("SELECT rel_path, substr(text, 1, 50) AS content, length(text) > 50 AS truncated FROM (SELECT 'd/' || doc_id || '.txt' AS rel_path, text FROM documents) WHERE rel_path = 'd/7.txt'")
def one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataquill.sources.tree import read_file

    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.col("text").alias("content"))
    return read_file(rows, "d/7.txt", 50)


@query("SELECT count(*) AS n_entries, count(*) FILTER (WHERE p_partkey % 50 = 0) AS n_heavy, true AS warn FROM part")
def root_size_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataquill.sources.tree import size_warning

    name = F.when(F.col("p_partkey") % 50 == 0, "build").otherwise(F.concat(F.lit("n"), F.col("p_partkey").cast("string")))
    return size_warning(table(spark, sf_dir, "part").select(name.alias("name")))


# Sections and evidence as text -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, '## Confidence' || chr(10) || chr(10) || 'high' || chr(10) || chr(10) || '## Scores' || chr(10) || chr(10) || '| section | score |' || chr(10) || '|-|-|' || chr(10) || '| A | low |' || chr(10) || '| B | ' || o_orderstatus || ' |' || chr(10) || chr(10) || '## Weak sections' || chr(10) || chr(10) || 'A' AS markdown FROM orders""")
def audit_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = F.concat(F.lit('{"overall_confidence": "high", "section_scores": {"B": "'), "o_orderstatus", F.lit('", "A": "low"}, "weakest_sections": ["A"]}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.audit_markdown(audit).alias("markdown"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS id, 'A' AS letter, count(*) + CASE WHEN o_custkey = (SELECT min(o_custkey) FROM orders) THEN 1 ELSE 0 END AS version,
 CASE WHEN o_custkey = (SELECT min(o_custkey) FROM orders) THEN '{"new":1}' ELSE CAST(arg_max(o_orderkey, o_orderkey) AS VARCHAR) END AS section FROM orders GROUP BY o_custkey""")
def section_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each section after one has been patched."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    history = orders.select(F.col("o_custkey").cast("string").alias("id"), F.lit("A").alias("letter"), version.alias("version"), F.col("o_orderkey").cast("string").alias("section"), F.lit("").alias("hash"))
    first = str(orders.agg(F.min("o_custkey")).first()[0])
    return reports.current_sections(reports.patched(history, first, "A", '{"new":1}')).select("id", "letter", "version", "section")


@query("SELECT event_id, '{\"summary\":\"' || event_type || '\"}' AS short FROM events")
def short_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.concat(F.lit('{"summary": "'), "event_type", F.lit('", "other": [1, 2], "confidence": "low"}'))
    return table(spark, sf_dir, "events").select("event_id", reports.compressed(F.lit("C"), section).alias("short"))


@query("""SELECT string_agg('=== d' || doc_id || ' #0 ===' || chr(10) || CASE WHEN length(text) > 2000 THEN rtrim(substr(text, 1, 2000)) || '...' ELSE text END, chr(10) || chr(10) ORDER BY n_chars DESC, 'd' || doc_id) AS evidence
FROM (SELECT * FROM documents WHERE text IS NOT NULL ORDER BY n_chars DESC, 'd' || doc_id LIMIT 40)""")
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty longest documents as one text of evidence."""
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(path.alias("rel_path"), F.lit(0).cast("long").alias("chunk_index"), F.col("n_chars").cast("double").alias("score"), F.col("text").alias("content"), F.lit(False).alias("expanded"))
    return retrieval.rendered(retrieval.top(rows, "score", 40))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '  Layers: api, ' || o_orderstatus || chr(10) ELSE '' END || '  Known services:' || chr(10) || '    - s' || (o_orderkey % 5) || ' (r)' AS context FROM orders")
def layer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    layers = F.when(k % 2 == 0, F.concat(F.lit('"main_layers": ["api", "'), "o_orderstatus", F.lit('"], '))).otherwise("")
    section = F.concat(F.lit("{"), layers, F.lit('"main_services": [{"name": "s'), (k % 5).cast("string"), F.lit('", "role": "r"}]}'))
    return table(spark, sf_dir, "orders").select(k, reports.layer_context(section).alias("context"))


@query("SELECT conv_id, array_to_string(list(turn ORDER BY turn), ',') AS steps FROM (SELECT conv_id, turn FROM conversations) GROUP BY conv_id")
def ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onboarding steps that were stored the other way round."""
    step = F.concat(F.lit('{"order": '), F.col("turn").cast("string"), F.lit(', "title": "t"}'))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.sort_array(F.collect_list(step))).alias("s"))
    section = F.concat(F.lit('{"steps": ['), F.array_join("s", ","), F.lit("]}"))
    return rows.select("conv_id", F.array_join(F.transform(reports.onboarding_steps(section), lambda x: x["order"].cast("string")), ",").alias("steps"))
