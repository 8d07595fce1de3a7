"""Rule-based risks and conventions over files, symbols, chunks and edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import paths, text
from strataquill.session import cut

#: Role endings of class names, in order of precedence. (fixed values)
SUFFIXES = ("Service", "Controller", "Repository", "Handler", "Manager", "Factory", "Builder", "Provider", "Middleware", "Adapter", "Decorator", "Observer", "Strategy", "Validator", "Serializer", "Util", "Utils", "Helper", "Mixin")

#: Roles of folder names. (fixed values)
ROLES = {
    "api": "API layer", "controllers": "controllers", "controller": "controller", "services": "services", "service": "service", "domain": "domain logic",
    "repositories": "data access", "repository": "data access", "models": "data models", "schemas": "schemas/serialization", "utils": "utilities", "helpers": "helpers",
    "middleware": "middleware", "handlers": "handlers", "routes": "routing", "components": "UI components", "hooks": "React hooks", "stores": "state management", "screens": "UI screens",
}

#: Names of the styles: no classes, no functions, over 40 % classes, below 10 %. (fixed values)
STYLES = ("purely functional", "class-heavy (no standalone functions)", "class-heavy OOP", "functional / procedural")

#: Annotations of deferred work, reads of the environment, assignments that look like credentials. (fixed values)
ANNOTATIONS = ("TODO", "FIXME", "HACK", "XXX", "NOSONAR")
ENVIRONMENT = r"(?i)os\.environ|process\.env|getenv|dotenv|\.env"
CREDENTIAL = r"""(?i)(password|secret|api_key|token|bearer)\s*=\s*['"][^'"]{8,}['"]"""


def god_objects(files: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """rel_path, est_lines, n_symbols, severity of large files (not tests) with many symbols."""
    counts = symbols.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_symbols"))
    rows = files.where(~paths.is_test_analysis(F.col("rel_path"))).select("rel_path", F.floor(F.col("size_bytes") / 40).cast("long").alias("est_lines"))
    rows = rows.join(counts, "rel_path", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0))).where("est_lines >= 300 and n_symbols >= 25")
    severity = F.when((F.col("est_lines") >= 600) | (F.col("n_symbols") >= 50), "high").otherwise("medium")
    return rows.withColumn("severity", severity).orderBy(text.severity_rank(F.col("severity")), F.desc("est_lines"), "rel_path").limit(limit)


def circular_imports(cycles: DataFrame, limit: int = 8) -> DataFrame:
    """cycle_no, cycle_size, severity, evidence of the largest cycles; ``cycles`` as the graph operator gives them."""
    rows = cycles.where(F.col("cycle_no") < limit).groupBy("cycle_no", "cycle_size").agg(F.sort_array(F.collect_list("rel_path")).alias("evidence"))
    return rows.withColumn("severity", F.when(F.col("cycle_size") >= 3, "high").otherwise("medium"))


def hotspots(chunks: DataFrame, keywords: tuple[str, ...] = ANNOTATIONS, medium: int = 3, high: int = 8, limit: int = 8) -> DataFrame:
    """module, n_annotations, n_files, severity by whole-word keywords in chunks (overlaps count twice)."""
    found = chunks.select("rel_path", F.regexp_count("content", F.lit(text.whole_words(list(keywords)))).cast("long").alias("n")).where("n > 0")
    rows = found.groupBy(paths.module_of(F.col("rel_path")).alias("module")).agg(F.sum("n").alias("n_annotations"), F.countDistinct("rel_path").alias("n_files"))
    rows = rows.where(F.col("n_annotations") >= medium).withColumn("severity", F.when(F.col("n_annotations") >= high, "high").otherwise("medium"))
    return rows.orderBy(F.desc("n_annotations"), "module").limit(limit)


def test_gaps(files: DataFrame, least: int = 3, limit: int = 8) -> DataFrame:
    """module, n_sources, severity of modules with source files but no test file; the most severe, then by module."""
    tested = paths.is_test_analysis(F.col("rel_path"))
    with_module = files.withColumn("module", paths.module_of(F.col("rel_path")))
    sources = with_module.where((F.col("category") == "source") & ~tested).groupBy("module").agg(F.count(F.lit(1)).alias("n_sources")).where(F.col("n_sources") >= least)
    gaps = sources.join(with_module.where(tested).select("module").distinct(), "module", "left_anti")
    gaps = gaps.withColumn("severity", F.when(F.col("n_sources") >= 10, "high").otherwise("medium"))
    return gaps.orderBy(text.severity_rank(F.col("severity")), "module").limit(limit)


def test_ratio(files: DataFrame) -> DataFrame:
    """n_tests, n_sources, ratio, is_low of all files, one row."""
    rows = files.agg(F.count_if(paths.is_test_analysis(F.col("rel_path"))).alias("n_tests"), F.count_if(F.col("category") == "source").alias("n_sources"))
    ratio = F.when(F.col("n_sources") > 0, F.col("n_tests") / F.col("n_sources")).otherwise(0.0)
    return rows.select("n_tests", "n_sources", F.round(ratio, 3).alias("ratio"), ((ratio < 0.15) & (F.col("n_sources") >= 10)).alias("is_low"))


def blast_radius(central: DataFrame, strict: bool = False, limit: int = 10) -> DataFrame:
    """The most central files. ``strict`` gives none, as a reader that looks for other field names would."""
    rows = central.orderBy(F.desc("score"), F.desc("indegree"), "rel_path").limit(limit)
    return rows.where(F.lit(False)) if strict else rows


def config_risks(chunks: DataFrame) -> DataFrame:
    """risk, n_files: files that read the environment (from 8 on) and files with credential-like assignments."""
    files = lambda pattern: F.countDistinct(F.when(F.col("content").rlike(pattern), F.col("rel_path")))
    found = chunks.agg(files(ENVIRONMENT).alias("env"), files(CREDENTIAL).alias("cred"))
    one = lambda name, column: F.struct(F.lit(name).alias("risk"), F.col(column).alias("n_files"))
    rows = found.select(F.explode(F.array(one("env_spread", "env"), one("credentials", "cred"))).alias("x")).select("x.risk", "x.n_files")
    return rows.where(((F.col("risk") == "credentials") & (F.col("n_files") >= 1)) | (F.col("n_files") >= 8))


FINDING = ("category", "severity", "title")


def findings(parts: list[DataFrame]) -> DataFrame:
    """All findings (category, severity, title), most severe first, then by category."""
    rows = reduce(DataFrame.unionByName, [p.select(*FINDING) for p in parts])
    return rows.withColumn("rank", text.severity_rank(F.col("severity")).cast("long"))


def gap_findings(gaps: DataFrame, ratio: DataFrame, limit: int = 8) -> DataFrame:
    """Findings of untested modules and of a low ratio of tests over all files; at most ``limit`` together, the most severe
    first, the ratio after the modules of its severity."""
    modules = gaps.select(F.lit("test_gap").alias("category"), "severity", F.concat(F.lit("no tests: "), "module").alias("title"), F.lit(0).alias("last"), "module")
    share = F.concat(F.lit("low test ratio: "), F.col("n_tests").cast("string"), F.lit("/"), F.col("n_sources").cast("string"))
    low = ratio.where("is_low").select(F.lit("test_gap").alias("category"), F.lit("medium").alias("severity"), share.alias("title"), F.lit(1).alias("last"), F.lit("").alias("module"))
    return modules.unionByName(low).orderBy(text.severity_rank(F.col("severity")), "last", "module").limit(limit).select(*FINDING)


def cycle_findings(cycles: DataFrame) -> DataFrame:
    """Findings of the cycles that ``circular_imports`` gives."""
    title = F.concat(F.lit("import cycle of "), F.col("cycle_size").cast("string"), F.lit(" files: "), F.element_at("evidence", 1))
    return cycles.select(F.lit("circular_import").alias("category"), "severity", title.alias("title"))


def blast_findings(central: DataFrame) -> DataFrame:
    """One finding of the most central files, if there are some."""
    n = central.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return n.select(F.lit("blast_radius").alias("category"), F.lit("medium").alias("severity"), F.concat(F.lit("central files: "), F.col("n").cast("string")).alias("title"))


def risk_report(detectors: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The findings of all detectors, and the errors of those that failed; one that fails is left out.

    Each detector's findings are few; they are written, so that it fails here or not at all.
    """
    found, failed = [], {}
    for name, detect in detectors.items():
        try:
            found.append(cut(detect().select(*FINDING)))
        except Exception as error:
            failed[name] = str(error)
    return (findings(found) if found else None), failed


def detectors(files: DataFrame, symbols: DataFrame, chunks: DataFrame, cycles: Callable[[], DataFrame], central: DataFrame, keywords: tuple[str, ...] = ANNOTATIONS) -> dict[str, Callable[[], DataFrame]]:
    """The six detectors over a snapshot's tables; ``cycles`` gives the graph's cycles when it is asked."""
    config = lambda: config_risks(chunks).select(
        F.lit("config_risk").alias("category"), F.when(F.col("risk") == "credentials", "high").otherwise("medium").alias("severity"), F.concat(F.lit("config: "), "risk").alias("title")
    )
    return {
        "god_objects": lambda: god_objects(files, symbols).select(F.lit("god_object").alias("category"), "severity", F.concat(F.lit("large file: "), "rel_path").alias("title")),
        "circular_imports": lambda: cycle_findings(circular_imports(cycles())),
        "todo_hotspots": lambda: hotspots(chunks, keywords).select(F.lit("todo_hotspot").alias("category"), "severity", F.concat(F.lit("hotspot: "), "module").alias("title")),
        "test_coverage": lambda: gap_findings(test_gaps(files), test_ratio(files)),
        "blast_radius": lambda: blast_findings(blast_radius(central)),
        "config_risk": config,
    }


def findings_text(rows: DataFrame) -> DataFrame:
    """One line per finding."""
    return rows.select(F.concat(F.lit("["), F.upper("severity"), F.lit("]["), "category", F.lit("] "), "title").alias("line"))


def class_suffix(name: Column) -> Column:
    """The first role ending of a class name; null if it has none."""
    found = F.when(F.endswith(name, F.lit(SUFFIXES[0])), SUFFIXES[0])
    for s in SUFFIXES[1:]:
        found = found.when(F.endswith(name, F.lit(s)), s)
    return found


def suffix_histogram(symbols: DataFrame, limit: int = 5) -> DataFrame:
    rows = symbols.where(F.col("kind") == "class").select(class_suffix(F.col("name")).alias("suffix")).where("suffix is not null")
    return rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.desc("n"), "suffix").limit(limit)


def naming_style(names: DataFrame, sample: int = 300) -> DataFrame:
    """n_camel, n_pascal, n_snake, n, style of the first names in order (name, ord); style needs half of them."""
    rows = names.orderBy("ord", "name").limit(sample)
    hits = lambda p: F.count_if(F.col("name").rlike(p))
    out = rows.agg(hits("^[a-z][a-zA-Z0-9]*$").alias("n_camel"), hits("^[A-Z][a-zA-Z0-9]*$").alias("n_pascal"), hits("^[a-z][a-z0-9_]*$").alias("n_snake"), F.count(F.lit(1)).alias("n"))
    most = F.greatest("n_camel", "n_pascal", "n_snake")
    style = F.when(most == F.col("n_camel"), "camelCase").when(most == F.col("n_pascal"), "PascalCase").otherwise("snake_case")
    return out.withColumn("style", F.when((F.col("n") > 0) & (most * 2 >= F.col("n")), style))


def folder_roles(files: DataFrame, limit: int = 6) -> DataFrame:
    """folder, role, n_files: source files below folders of a known role; a file counts once per matching part."""
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    parts = F.filter(F.split(paths.posix(F.col("rel_path")), "/"), lambda p: ~p.isin("", "."))
    each = files.where(F.col("category") == "source").select(F.explode(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("folder"))
    known = each.withColumn("role", F.try_element_at(roles, F.lower("folder"))).where("role is not null")
    return known.groupBy("folder", "role").agg(F.count(F.lit(1)).alias("n_files")).where("n_files >= 2").orderBy(F.desc("n_files"), "folder").limit(limit)


def class_function_style(symbols: DataFrame, limit: int = 4) -> DataFrame:
    """language, n_classes, n_functions, style of languages with at least ten of both together."""
    lang, kind = F.lower(F.coalesce("language", F.lit("unknown"))), F.lower(F.coalesce("kind", F.lit("")))
    rows = symbols.select(lang.alias("language"), kind.alias("kind")).where(~F.col("language").isin("unknown", ""))
    rows = rows.groupBy("language").agg(F.count_if(F.col("kind") == "class").alias("n_classes"), F.count_if(F.col("kind").isin("function", "method")).alias("n_functions"))
    total = F.col("n_classes") + F.col("n_functions")
    ratio = F.col("n_classes") / total
    style = F.when(F.col("n_classes") == 0, STYLES[0]).when(F.col("n_functions") == 0, STYLES[1]).when(ratio > 0.4, STYLES[2]).when(ratio < 0.1, STYLES[3])
    return rows.where(total >= 10).withColumn("style", style).where("style is not null").orderBy("language").limit(limit)


def layer_violations(edges: DataFrame) -> DataFrame:
    """Internal edges from a layer to one more than one above it."""
    rows = edges.where(~F.col("is_external")).select("src_path", "dst_path", paths.layer_of(F.col("src_path")).cast("long").alias("src_layer"), paths.layer_of(F.col("dst_path")).cast("long").alias("dst_layer"))
    return rows.where("src_layer >= 0 and dst_layer > src_layer + 1")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
