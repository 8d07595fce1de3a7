"""Stored reports: listing, caching, section comparison, validation, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import text
from strataquill.operators.analyzers import latest
from strataquill.session import cut

#: Fields of each section that its short form keeps. (fixed values)
PREVIEW = {
    "A": ["purpose", "domain", "tech_stack", "runtime_type"],
    "B": ["main_layers", "frameworks", "entrypoints"],
    "C": ["summary", "folders"],
    "D": ["naming_style", "async_style", "error_handling"],
    "E": ["rules", "violations_found"],
    "F": ["features"],
    "G": ["entrypoint", "backbone", "read_first"],
    "H": ["steps"],
    "I": ["terms"],
    "J": ["summary", "findings"],
}


def report_list(reports: DataFrame, repos: DataFrame, snapshots: DataFrame, limit: int = 50) -> DataFrame:
    """Reports with the names of their repository and branch, newest first; missing ones fall back to ids."""
    rows = reports.join(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("__repo")), "repo_id", "left")
    rows = rows.join(snapshots.select(F.col("id").alias("snapshot_id"), F.col("branch").alias("__branch")), "snapshot_id", "left")
    rows = rows.select("id", F.coalesce("__repo", F.col("repo_id").cast("string")).alias("repo_name"), F.coalesce("__branch", F.lit("unknown")).alias("branch"), "created_at")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 200)))


def cached_report(reports: DataFrame, keys: list[str]) -> DataFrame:
    """The newest report of each key."""
    return latest(reports, keys, [F.desc("created_at"), F.desc("id")])


def in_order(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of the wanted keys in the order of request, numbered by ``pos``; missing ones last with a null payload."""
    order = rows.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in wanted])).alias("pos", key))
    return F.broadcast(order.withColumn("pos", F.col("pos").cast("long"))).join(rows, key, "left")


def list_diff(old: DataFrame, new: DataFrame, key: str, item: str, width: int = 240, limit: int = 80) -> DataFrame:
    """(key, change, item) of items that one side of a key lacks, cut to a width; of each key and change the first ``limit``
    by item."""
    a, b = old.select(key, item).distinct(), new.select(key, item).distinct()
    added = b.join(a, [key, item], "left_anti").withColumn("change", F.lit("added"))
    removed = a.join(b, [key, item], "left_anti").withColumn("change", F.lit("removed"))
    w = Window.partitionBy(key, "change").orderBy(item)
    shown = added.unionByName(removed).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit)
    return shown.select(key, "change", F.substr(item, F.lit(1), F.lit(width)).alias(item))


def section_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per letter: presence, confidence delta, word delta in percent (over 10 only), improvement. Sides: letter, confidence, content."""
    x, y = a.select("letter", F.col("confidence").alias("ca"), F.col("content").alias("ta")), b.select("letter", F.col("confidence").alias("cb"), F.col("content").alias("tb"))
    rows = x.join(y, "letter", "full_outer")
    ask = lambda c: F.coalesce(c, F.lit("?"))
    delta = F.when(~F.col("ca").eqNullSafe(F.col("cb")), F.concat(ask(F.col("ca")), F.lit(" → "), ask(F.col("cb"))))
    old, new = F.greatest(F.lit(1), text.word_count(F.col("ta"))), text.word_count(F.col("tb"))
    share = F.abs(new - old) / old
    words = F.when(F.col("ta").isNotNull() & F.col("tb").isNotNull() & (share > 0.1), F.round(share * 100, 1))
    ra, rb = text.confidence_rank(F.col("ca")), text.confidence_rank(F.col("cb"))
    better = F.when((ra > 0) & (rb > 0) & (ra != rb), rb > ra)
    same = F.sha2(F.concat_ws("|", ask(F.col("ca")), ask(F.col("ta"))), 256) == F.sha2(F.concat_ws("|", ask(F.col("cb")), ask(F.col("tb"))), 256)
    return rows.select("letter", (~same).alias("changed"), delta.alias("confidence_delta"), words.alias("word_delta_pct"), better.alias("improvement"))


def quality_trend(a: DataFrame, b: DataFrame) -> DataFrame:
    """mean_a, mean_b, trend of section scores (score: high, medium, low), one row."""
    mean = lambda rows: rows.agg(F.round(F.avg(text.confidence_rank(F.col("score"))), 6)).scalar()
    trend = F.when(F.col("mean_b") > F.col("mean_a") + 0.15, "improving").when(F.col("mean_b") < F.col("mean_a") - 0.15, "degrading").otherwise("stable")
    return a.sparkSession.range(1).select(mean(a).alias("mean_a"), mean(b).alias("mean_b")).withColumn("trend", trend)


def sections_of(report: Column) -> Column:
    """The sections of a stored report (JSON text): ``sections`` of versions 2 and 3, else ``sections_v2``; a map."""
    kind = "struct<version:int,sections:map<string,string>,sections_v2:map<string,string>>"
    r = F.from_json(report, kind)
    return F.when(r["version"].isin(2, 3), r["sections"]).otherwise(r["sections_v2"])


def missing_keys(section: Column, required: list[str]) -> Column:
    """Required keys that a section (JSON text) lacks, sorted."""
    return F.sort_array(F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(section), F.array().cast("array<string>"))))


def parse_loose(answer: Column, schema: str) -> Column:
    """A struct from text that holds JSON: fences stripped, then as a whole, then its first braced block."""
    bare = F.trim(F.regexp_replace(answer, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = F.try_parse_json(bare).isNotNull()
    return F.from_json(F.when(valid, bare).otherwise(block), schema)


def to_markdown(sections: DataFrame) -> DataFrame:
    """id, markdown: a report's sections (id, letter, title, content) in order."""
    body = F.concat(F.lit("## "), "letter", F.lit(". "), "title", F.lit("\n\n"), F.coalesce("content", F.lit("")))
    rows = sections.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("letter", body.alias("body")))).alias("parts"))
    return rows.select("id", F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n").alias("markdown"))


# Markdown of single sections ---------------------------------------------------------------------------------------

_FOOT = "evidence_files:array<string>,blind_spots:array<string>,confidence:string"
_FILE = "struct<file:string,reason:string>"

#: Slots of the file section with their labels, and the order of a report's sections. (fixed values)
SLOTS = {"entrypoint": "Entrypoint", "backbone": "Backbone", "critical_config": "Critical config", "highest_centrality": "Highest centrality", "most_dangerous_to_touch": "Most dangerous to touch", "read_first": "Read first"}
ORDER = "ABCDEFGHIJK"


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _listed(items: Column, most: int, glue: str, code: bool = True) -> Column:
    """Some first items in one line; null if there are none."""
    own = F.slice(items, 1, most)
    shown = F.transform(own, lambda x: F.concat(F.lit("`"), _filled(x), F.lit("`"))) if code else own
    return F.when(F.size(items) > 0, F.array_join(shown, glue))


def _lines(*parts: Column) -> Column:
    """Lines of text; null ones are left out."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"**{label}:** "), value)


def _gap(value: Column) -> Column:
    """A line behind an empty one; null if it is null."""
    return F.concat(F.lit("\n"), value)


def _footer(s: Column) -> Column:
    confidence = F.when(_filled(s["confidence"]) != "", F.concat(F.lit("\n_Confidence: "), s["confidence"], F.lit("_")))
    parts = (_gap(_labelled("Evidence files", _listed(s["evidence_files"], 20, ", "))), _gap(_labelled("Blind spots", _listed(s["blind_spots"], 10, "; ", code=False))), confidence)
    return F.when(F.coalesce(*parts).isNotNull(), _lines(*parts))


def _identity(json: Column) -> Column:
    s = F.from_json(json, f"struct<repo_name:string,domain:string,runtime_type:string,purpose:string,business_context:string,tech_stack:array<string>,{_FOOT}>")
    return _lines(
        F.lit("## A — Project Identity Card\n"), F.concat(_labelled("Repo", _filled(s["repo_name"])), F.lit("  ")), F.concat(_labelled("Domain", _filled(s["domain"])), F.lit("  ")),
        F.concat(F.lit("**Runtime type:** `"), _filled(s["runtime_type"]), F.lit("`  \n")), F.concat(_labelled("Purpose", _filled(s["purpose"])), F.lit("\n")),
        F.concat(_labelled("Business context", _filled(s["business_context"])), F.lit("\n")), _labelled("Tech stack", _listed(s["tech_stack"], 1 << 20, ", ")), _footer(s),
    )


def _files(json: Column) -> Column:
    s = F.from_json(json, f"struct<{','.join(f'{k}:{_FILE}' for k in SLOTS)},other_important:array<{_FILE}>,{_FOOT}>")
    told = lambda v: F.concat(F.lit("`"), _filled(v["file"]), F.lit("` — "), _filled(v["reason"]))
    slots = [F.when(s[k].isNotNull(), F.concat(F.lit(f"- **{label}:** "), told(s[k]))) for k, label in SLOTS.items()]
    others = F.when(F.size(s["other_important"]) > 0, F.concat(F.lit("\n**Other important files:**\n"), F.array_join(F.transform(F.slice(s["other_important"], 1, 10), lambda v: F.concat(F.lit("  - "), told(v))), "\n")))
    return _lines(F.lit("## G — Important Files Radar\n"), *slots, others, _footer(s))


def _glossary(json: Column) -> Column:
    s = F.from_json(json, f"struct<terms:array<struct<term:string,definition:string,evidence_files:array<string>>>,{_FOOT}>")
    row = lambda t: F.concat(F.lit("| **"), _filled(t["term"]), F.lit("** | "), _filled(t["definition"]), F.lit(" | "), _filled(_listed(t["evidence_files"], 2, ", ")), F.lit(" |"))
    table = F.when(F.size(s["terms"]) > 0, F.concat(F.lit("| Term | Definition | Evidence |\n|---|---|---|\n"), F.array_join(F.transform(F.slice(s["terms"], 1, 40), row), "\n")))
    return _lines(F.lit("## I — Glossary / Domain Terms\n"), table, _footer(s))


def _risks(json: Column) -> Column:
    s = F.from_json(json, f"struct<summary:string,findings:array<struct<category:string,severity:string,title:string,rationale:string,evidence:array<string>>>,{_FOOT}>")

    def one(f: Column) -> Column:
        head = F.concat(F.lit("- **["), _filled(f["category"]), F.lit("]** "), _filled(f["title"]))
        return _lines(head, F.when(_filled(f["rationale"]) != "", F.concat(F.lit("  "), f["rationale"])), F.concat(F.lit("  Evidence: "), _listed(f["evidence"], 3, ", ")))

    def of(severity: str) -> Column:
        own = F.filter(s["findings"], lambda f: f["severity"] == severity)
        return F.when(F.size(own) > 0, F.concat(F.lit(f"### {severity.upper()} severity ("), F.size(own).cast("string"), F.lit(")\n"), F.array_join(F.transform(own, one), "\n"), F.lit("\n")))

    return _lines(F.lit("## J — Risk / Complexity / Unknowns\n"), F.when(_filled(s["summary"]) != "", F.concat(s["summary"], F.lit("\n"))), *(of(x) for x in ("high", "medium", "low")), _footer(s))


def _audit(json: Column) -> Column:
    s = F.from_json(json, "struct<coverage_percentage:double,overall_confidence:string,section_scores:map<string,string>,weakest_sections:array<string>,notes:string,blind_spots:array<string>>")
    scores = F.slice(F.array_sort(F.map_entries(s["section_scores"])), 1, 12)
    told = F.when(F.size(scores) > 0, F.array_join(F.transform(scores, lambda e: F.concat(e["key"], F.lit(": "), _filled(e["value"]))), "; "))
    share = F.concat(F.bround(F.coalesce(s["coverage_percentage"], F.lit(0.0)), 0).cast("long").cast("string"), F.lit("%"))
    return _lines(
        F.lit("## K — Confidence Auditor\n"), _labelled("Coverage (high/medium sections)", share), _labelled("Overall confidence", F.when(_filled(s["overall_confidence"]) != "", s["overall_confidence"])),
        _gap(_labelled("Section scores", told)), _gap(_labelled("Weakest sections", _listed(s["weakest_sections"], 10, ", ", code=False))), _gap(F.when(_filled(s["notes"]) != "", s["notes"])),
        _gap(_labelled("Blind spots", _listed(s["blind_spots"], 10, "; ", code=False))),
    )


def _other(letter: Column, json: Column) -> Column:
    """A section without a form of its own: its fields in order, lists in one line."""
    held = F.from_json(json, "map<string,string>")
    named = F.filter(F.map_entries(held), lambda e: ~e["key"].isin("confidence", "evidence_files", "blind_spots"))
    items = lambda v: F.from_json(v, "array<string>")
    line = lambda e: F.concat(F.lit("**"), e["key"], F.lit(":** "), F.when(F.startswith(e["value"], F.lit("[")), _filled(F.array_join(F.slice(items(e["value"]), 1, 20), ", "))).otherwise(_filled(e["value"])))
    return _lines(F.concat(F.lit("## "), letter, F.lit(" — (section)\n")), F.when(F.size(named) > 0, F.array_join(F.transform(named, line), "\n")), _footer(F.from_json(json, f"struct<{_FOOT}>")))


def section_markdown(letter: Column, section: Column) -> Column:
    """A section (JSON text) as Markdown by the form of its letter."""
    forms = {"A": _identity, "G": _files, "I": _glossary, "J": _risks, "K": _audit}
    out = F.when(letter == "A", forms["A"](section))
    for name in "GIJK":
        out = out.when(letter == name, forms[name](section))
    return out.otherwise(_other(letter, section))


def full_markdown(reports: DataFrame, sections: DataFrame, title: str = "Analysis Report") -> DataFrame:
    """id, markdown of reports (id, repo_name, branch, model_id, scan_mode, created_at) with their sections (id, letter,
    section: JSON text), in the order of letters; sections that hold an error are left out."""
    usable = sections.where(F.col("letter").isin(*ORDER) & ~F.coalesce(F.map_contains_key(F.from_json("section", "map<string,string>"), F.lit("error")), F.lit(True)))
    each = usable.select("id", F.struct("letter", section_markdown(F.col("letter"), F.col("section")).alias("text")).alias("s"))
    bodies = each.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["text"]), "\n\n").alias("body"))
    field = lambda label, value, mark="": F.concat(F.lit(f"- **{label}:** {mark}"), F.coalesce(value.cast("string"), F.lit("unknown")), F.lit(mark))
    head = _lines(F.lit(f"# {title}\n"), field("Report ID", F.col("id"), "`"), field("Repo", F.col("repo_name")), field("Branch", F.col("branch")), field("Model", F.col("model_id"), "`"), field("Scan mode", F.col("scan_mode")), field("Created at", F.col("created_at")))
    nothing = F.lit("_No analysis section data found. Re-run analysis to generate sections._")
    return reports.join(bodies, "id", "left").select("id", F.concat(head, F.lit("\n\n"), F.coalesce("body", nothing), F.lit("\n")).alias("markdown"))


# Stored reports ----------------------------------------------------------------------------------------------------


def get(reports: DataFrame, report_id) -> DataFrame:
    return reports.where(F.col("id") == report_id)


def get_by_job(reports: DataFrame, job_id) -> DataFrame:
    """The newest report of a job."""
    return cached_report(reports.where(F.col("job_id") == job_id), ["job_id"])


def without(reports: DataFrame, report_id) -> DataFrame:
    """The reports but one; a null id isn't that one."""
    return reports.where(~F.col("id").eqNullSafe(F.lit(report_id)))


def of_workspace(repos: DataFrame, workspace_id) -> DataFrame:
    """Repositories of a workspace, or, for None, those of none."""
    return repos.where(F.col("workspace_id").eqNullSafe(F.lit(workspace_id)))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Section diff of two reports (repo_id, letter, confidence, content, hash). They must be of one repository; sections of
    equal hash are the same and aren't compared."""
    repos = a.select("repo_id").unionByName(b.select("repo_id")).agg(F.count_distinct("repo_id")).first()[0]
    if repos > 1:
        raise ValueError("the reports are of different repositories")
    same = a.join(b.select("letter", F.col("hash").alias("other")), "letter").where("hash = other").select("letter")
    left, right = (x.join(same, "letter", "left_anti") for x in (a, b))
    none = lambda kind: F.lit(None).cast(kind)
    equal = same.select("letter", F.lit(False).alias("changed"), none("string").alias("confidence_delta"), none("double").alias("word_delta_pct"), none("boolean").alias("improvement"))
    return equal.unionByName(section_diff(left, right))


def onboarding_steps(section: Column) -> Column:
    """The steps of an onboarding section (JSON text) by their order."""
    steps = F.from_json(section, "struct<steps:array<struct<order:int,title:string,description:string>>>")["steps"]
    return F.sort_array(steps)


def glossary_terms(section: Column, asked: str = "") -> Column:
    """The terms of a glossary section (JSON text) whose term or definition contains a text, in any case."""
    terms, low = F.from_json(section, "struct<terms:array<struct<term:string,definition:string>>>")["terms"], asked.strip().lower()
    has = lambda c: F.contains(F.lower(_filled(c)), F.lit(low))
    return F.filter(terms, lambda t: has(t["term"]) | has(t["definition"]))


def layer_context(section: Column) -> Column:
    """The lines on layers and six services of an architecture section (JSON text); empty if it has none."""
    s = F.from_json(section, "struct<main_layers:array<string>,main_services:array<struct<name:string,role:string>>>")
    service = lambda v: F.concat(F.lit("    - "), _filled(v["name"]), F.when(_filled(v["role"]) != "", F.concat(F.lit(" ("), v["role"], F.lit(")"))).otherwise(""))
    services = F.when(F.size(s["main_services"]) > 0, F.concat(F.lit("  Known services:\n"), F.array_join(F.transform(F.slice(s["main_services"], 1, 6), service), "\n")))
    return _lines(F.concat(F.lit("  Layers: "), _listed(s["main_layers"], 1 << 20, ", ", code=False)), services)


def pattern_context(section: Column) -> Column:
    """Five confirmed patterns of a conventions section (JSON text), a line each; empty if it has none."""
    signals = F.from_json(section, "struct<signals:array<struct<category:string,pattern:string,description:string,evidence:string>>>")["signals"]
    full = lambda c: F.when(_filled(c) != "", c)
    hint = lambda x: F.substring(_filled(F.coalesce(full(x["pattern"]), full(x["description"]), full(x["evidence"]))), 1, 90)
    line = lambda x: F.trim(F.when(_filled(x["category"]) != "", F.concat(x["category"], F.lit(": "), hint(x))).otherwise(hint(x)))
    return _filled(F.array_join(F.filter(F.transform(F.slice(signals, 1, 5), line), lambda t: t != ""), "\n"))


def file_context(section: Column) -> Column:
    """Five files with reasons of a file section (JSON text), each once, slots first; empty if it has none."""
    s = F.from_json(section, f"struct<{','.join(f'{k}:{_FILE}' for k in SLOTS)},other_important:array<{_FILE}>>")
    every = F.concat(F.array(*(s[k] for k in SLOTS)), F.coalesce(s["other_important"], F.array().cast(f"array<{_FILE}>")))
    trimmed = F.transform(every, lambda v: F.struct(F.trim(_filled(v["file"])).alias("file"), F.trim(_filled(v["reason"])).alias("reason")))
    usable = F.filter(trimmed, lambda v: ~v["file"].isin("", "unknown") & (v["reason"] != ""))
    names = F.transform(usable, lambda v: v["file"])
    first = F.filter(usable, lambda v, i: F.array_position(names, v["file"]) == i + 1)
    return F.array_join(F.transform(F.slice(first, 1, 5), lambda v: F.concat(F.lit("- "), v["file"], F.lit(" ("), F.substring(v["reason"], 1, 80), F.lit(")"))), "\n")


def quality_passes(sections: DataFrame, audit: Callable[[DataFrame], list[str]], rerun: Callable[[DataFrame, list[str]], DataFrame], most: int = 3) -> tuple[DataFrame, int]:
    """Sections (letter, confidence, ...) after passes in which weak ones, flagged by an audit or of low confidence, are made
    anew; it ends when none is weak or after ``most`` passes. The calls are injected; a report has few sections."""
    for done in range(most):
        weak = sorted(r["letter"] for r in weak_sections(sections, audit(sections)).collect())
        if not weak:
            return sections, done
        sections = cut(rerun(sections, weak))
    return sections, most


def weak_sections(sections: DataFrame, flagged: list[str]) -> DataFrame:
    """Letters that an audit flags or that report low confidence."""
    return sections.where(F.col("letter").isin(*flagged) | (text.confidence_rank(F.col("confidence")) == 1)).select("letter").distinct()


def canonical_hash(document: Column) -> Column:
    """SHA-256 of a JSON object with its keys in order (one level of nesting is sorted by Spark's own variant form)."""
    return F.sha2(F.to_json(F.try_parse_json(document)), 256)


def compressed(letter: Column, section: Column, cap: int = 500) -> Column:
    """The short form of a section (JSON text): its preview fields, cut to a length."""
    fields = F.create_map(*[x for k, v in PREVIEW.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    wanted = F.coalesce(F.try_element_at(fields, letter), F.array().cast("array<string>"))
    held = F.from_json(section, "map<string,string>")
    kept = F.map_from_entries(F.transform(F.filter(wanted, lambda f: F.map_contains_key(held, f) & F.element_at(held, f).isNotNull()), lambda f: F.struct(f, F.element_at(held, f))))
    return F.substring(F.to_json(kept), 1, cap)


def findings_diff(old: DataFrame, new: DataFrame, width: int = 300) -> DataFrame:
    """(change, title, severity, item) of findings (title, severity, item) that one side lacks by title and severity."""
    key = ["title", "severity"]
    last = lambda rows: rows.groupBy(*[F.coalesce(k, F.lit("")).alias(k) for k in key]).agg(F.max("item").alias("item"))
    a, b = last(old), last(new)
    added = b.join(a, key, "left_anti").withColumn("change", F.lit("added"))
    removed = a.join(b, key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select("change", *key, F.substring("item", 1, width).alias("item"))


def score_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(letter, change) of section scores (letter, score) that differ in any case."""
    low = lambda rows, name: rows.select("letter", F.lower(F.coalesce("score", F.lit(""))).alias(name))
    rows = low(old, "a").join(low(new, "b"), "letter", "full_outer").withColumns({"a": F.coalesce("a", F.lit("")), "b": F.coalesce("b", F.lit(""))})
    ask = lambda c: F.when(F.col(c) == "", "?").otherwise(F.col(c))
    return rows.where("a <> b").select("letter", F.concat(ask("a"), F.lit(" → "), ask("b")).alias("change"))


def of_categories(findings: DataFrame, categories: tuple[str, ...] = ("blast_radius", "anti_pattern")) -> DataFrame:
    return findings.where(F.col("category").isin(*categories))


def patched(history: DataFrame, report_id: str, letter: str, section: str) -> DataFrame:
    """The version table (id, letter, version, section, hash) with a new version of one section."""
    own = history.where((F.col("id") == report_id) & (F.col("letter") == letter)).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).scalar()
    row = history.sparkSession.range(1).select(F.lit(report_id).alias("id"), F.lit(letter).alias("letter"), own.cast("long").alias("version"), F.lit(section).alias("section"), canonical_hash(F.lit(section)).alias("hash"))
    return history.unionByName(row)


def current_sections(history: DataFrame) -> DataFrame:
    """The latest version of each section."""
    return latest(history, ["id", "letter"], [F.desc("version")])


def identity_context(section: Column) -> Column:
    """The lines on stack, domain and runtime of a first section (JSON text); empty if it has none."""
    s = F.from_json(section, "struct<tech_stack:array<string>,domain:string,runtime_type:string>")
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name}: "), value))
    return F.concat_ws("\n", line("Tech stack", F.array_join(s["tech_stack"], ", ")), line("Domain", s["domain"]), line("Runtime type", s["runtime_type"]))


def run_section(letter: str, context: DataFrame, answer: Callable[[str, DataFrame], dict] | None = None) -> dict:
    """A section by an injected model call; without one, or if it fails, the fallback with low confidence."""
    fallback = {"letter": letter, "confidence": "low", "content": ""}
    if answer is None:
        return fallback
    try:
        return fallback | answer(letter, context)
    except Exception as error:
        return fallback | {"error": str(error)}


def audit_markdown(audit: Column) -> Column:
    """The audit section (JSON text) as Markdown: overall confidence, a table of scores, weak sections, notes."""
    a = F.from_json(audit, "struct<overall_confidence:string,section_scores:map<string,string>,weakest_sections:array<string>,notes:string>")
    scores = F.array_sort(F.map_entries(F.coalesce(a["section_scores"], F.create_map().cast("map<string,string>"))))
    rows = F.array_join(F.transform(scores, lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), F.coalesce(e["value"], F.lit("")), F.lit(" |"))), "\n")
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body))
    table = F.when(rows != "", F.concat(F.lit("| section | score |\n|-|-|\n"), rows))
    return F.concat_ws("\n\n", part("Confidence", a["overall_confidence"]), part("Scores", table), part("Weak sections", F.array_join(a["weakest_sections"], ", ")), part("Notes", a["notes"]))


def without_secrets(providers: DataFrame, secret: str = "api_key") -> DataFrame:
    """Provider rows that say whether there is a key, without the key."""
    return providers.withColumn(f"has_{secret}", F.coalesce(F.col(secret), F.lit("")) != "").drop(secret)
