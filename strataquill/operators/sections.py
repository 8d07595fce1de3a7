"""Sections of reports as JSON text: contracts compiled to column expressions, canonical forms, and differences in one row.

A contract is a Spark type. :func:`problems` compiles it to one expression over a variant that walks the JSON as the type says and
returns the path and kind of each departure, so validation is a projection over any number of sections, inside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquill.functions import text

_LIST, _ENDS = "array<string>", "confidence:string,evidence_files:array<string>,blind_spots:array<string>"
_FILE, _ASPECT = "struct<file:string,reason:string>", "struct<description:string,evidence_files:array<string>>"

#: Contracts of the sections by letter: fields and their types, all of them required. (fixed values)
CONTRACTS = {
    "A": f"struct<repo_name:string,domain:string,purpose:string,runtime_type:string,tech_stack:{_LIST},business_context:string,{_ENDS}>",
    "B": f"struct<main_layers:{_LIST},frameworks:{_LIST},entrypoints:{_LIST},main_services:array<struct<name:string,path:string,role:string>>,external_integrations:{_LIST},config_sources:{_LIST},database_hints:{_LIST},{_ENDS}>",
    "C": f"struct<folders:array<struct<path:string,role:string,description:string>>,summary:string,{_ENDS}>",
    "D": f"struct<naming_style:{_ASPECT},error_handling:{_ASPECT},async_style:{_ASPECT},di_style:{_ASPECT},class_vs_functional:{_ASPECT},test_style:{_ASPECT},signals:array<struct<category:string,description:string,evidence:string>>,{_ENDS}>",
    "E": f"struct<rules:array<struct<rule:string,inferred_from:string,severity:string>>,violations_found:array<struct<rule:string,file:string,description:string,severity:string>>,{_ENDS}>",
    "F": f"struct<features:array<struct<name:string,description:string,entrypoint:string,key_files:{_LIST},data_path:string,tests:{_LIST},reading_order:{_LIST}>>,{_ENDS}>",
    "G": f"struct<entrypoint:{_FILE},backbone:{_FILE},critical_config:{_FILE},highest_centrality:{_FILE},most_dangerous_to_touch:{_FILE},read_first:{_FILE},other_important:array<{_FILE}>,{_ENDS}>",
    "H": f"struct<steps:array<struct<order:int,file:string,goal:string,outcome:string>>,total_estimated_minutes:int,{_ENDS}>",
    "I": "struct<terms:array<struct<term:string,definition:string,evidence_files:array<string>>>,confidence:string,blind_spots:array<string>>",
    "J": f"struct<findings:array<struct<category:string,severity:string,title:string,rationale:string,evidence:{_LIST}>>,summary:string,{_ENDS}>",
    "K": f"struct<overall_confidence:string,section_scores:map<string,string>,weakest_sections:{_LIST},coverage_percentage:double,notes:string,blind_spots:{_LIST}>",
    "L": "struct<executive_summary:string,architecture_narrative:string,tech_stack_snapshot:string,developer_quickstart:string,conventions_digest:string,risk_highlights:string,reading_path:string,confidence:string>",
}

#: Fields with few values, wherever they stand. (fixed values)
VALUES = {"confidence": ("high", "medium", "low"), "overall_confidence": ("high", "medium", "low"), "severity": ("high", "medium", "low")}

_PROBLEM = "array<struct<path:string,problem:string>>"
_NAMES = {T.StringType: "a string", T.IntegerType: "a whole number", T.DoubleType: "a number", T.ArrayType: "a list", T.StructType: "an object", T.MapType: "an object"}
_KINDS = {T.StringType: "^STRING", T.IntegerType: "^BIGINT$", T.DoubleType: "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", T.ArrayType: "^ARRAY", T.StructType: "^OBJECT", T.MapType: "^OBJECT"}


def _one(path: Column, problem: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem")))


def _none() -> Column:
    return F.array().cast(_PROBLEM)


def _checked(value: Column, kind: T.DataType, path: Column, values: tuple[str, ...] = ()) -> Column:
    """The problems of a variant that isn't missing."""
    fits = F.coalesce(F.schema_of_variant(value).rlike(_KINDS[type(kind)]), F.lit(False))
    if isinstance(kind, T.StructType):
        inside = F.concat(*(_field(value, f, path) for f in kind.fields))
    elif isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _checked(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        inside = F.flatten(each)
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>").cast("map<string,string>")))
        kinds = F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, x: F.schema_of_variant(x))
        wrong = F.filter(entries, lambda e: ~F.coalesce(F.element_at(kinds, e["key"]).rlike(_KINDS[type(kind.valueType)]), F.lit(False)))
        inside = F.transform(wrong, lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), F.lit(f"not {_NAMES[type(kind.valueType)]}").alias("problem")))
    elif values:
        inside = F.when(F.lower(F.try_variant_get(value, "$", "string")).isin(*values), _none()).otherwise(_one(path, f"not one of {', '.join(values)}"))
    else:
        inside = _none()
    return F.when(fits, F.coalesce(inside, _none())).otherwise(_one(path, f"not {_NAMES[type(kind)]}"))


def _field(owner: Column, field: T.StructField, path: Column) -> Column:
    value, place = F.try_variant_get(owner, f"$.{field.name}", "variant"), F.concat(path, F.lit(f".{field.name}"))
    return F.when(value.isNull(), _one(place, "missing")).otherwise(_checked(value, field.dataType, place, VALUES.get(field.name, ())))


def problems(section: Column, contract: str) -> Column:
    """array<struct<path, problem>> of a section (JSON text): fields that are missing, of another type or with a value that
    isn't allowed, in the order of the contract; a text that isn't JSON has one problem, at ``$``. Fields that the contract
    doesn't have are left alone."""
    parsed = F.try_parse_json(section)
    return F.when(parsed.isNull(), _one(F.lit("$"), "not JSON")).otherwise(_checked(parsed, T._parse_datatype_string(contract), F.lit("$")))


def validated(sections: DataFrame, letter: str = "letter", section: str = "section") -> DataFrame:
    """``sections`` with ``problems``, by the contract of each row's letter; an unknown letter is a problem of its own."""
    out = _one(F.lit("$"), F.concat(F.lit("unknown section "), F.coalesce(F.col(letter), F.lit("null"))))
    for name, contract in CONTRACTS.items():
        out = F.when(F.col(letter) == name, problems(F.col(section), contract)).otherwise(out)
    return sections.withColumn("problems", out)


# Differences -------------------------------------------------------------------------------------------------------


def canonical(value: Column) -> Column:
    """JSON text with the keys of objects in order at every level and no spaces; lists keep their order. Null if it isn't JSON."""
    return F.to_json(F.try_parse_json(value))


def signatures(section: Column) -> Column:
    """map<key, array<string>> of the fields of a section (JSON text) that are lists: the canonical forms of their items."""
    fields = F.try_variant_get(F.try_parse_json(section), "$", "map<string,variant>")
    lists = F.map_filter(fields, lambda k, v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False)))
    told = F.transform_values(lists, lambda k, v: F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)))
    return F.coalesce(told, F.create_map().cast("map<string,array<string>>"))


def _lacking(one: Column, other: Column, width: int, limit: int) -> Column:
    """``key:item`` of the items that ``one`` has and ``other`` lacks, over the keys that both have, first by key, then item."""
    shared = F.array_sort(F.array_intersect(F.map_keys(one), F.map_keys(other)))
    each = lambda k: F.transform(F.array_sort(F.array_except(F.element_at(one, k), F.element_at(other, k))), lambda s: F.concat(k, F.lit(":"), F.substring(s, 1, width)))
    return F.slice(F.flatten(F.transform(shared, each)), 1, limit)


def section_diffs(old: DataFrame, new: DataFrame, by: list[str], width: int = 240, limit: int = 80) -> DataFrame:
    """One row for each section (``by``, section: JSON text) that both sides have: whether its canonical form changed, rise
    of confidence, words before and after, change of words in percent, and what was added to and removed from its lists:
    at most ``limit`` items of all lists together, each with its key in front and cut to ``width``."""
    side = lambda rows, name: rows.select(*by, F.col("section").alias(name), canonical(F.col("section")).alias(f"{name}_form"), signatures(F.col("section")).alias(f"{name}_lists"))
    rows = side(old, "a").join(side(new, "b"), by)
    rank = lambda c: text.confidence_rank(F.coalesce(F.try_variant_get(F.try_parse_json(c), "$.confidence", "string"), F.lit("")))
    words = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\w+")).cast("long")
    counted = rows.withColumns({"words_a": words("a_form"), "words_b": words("b_form")})
    percent = F.when(F.col("words_a") > 0, F.round((F.col("words_b") - F.col("words_a")) * 100.0 / F.col("words_a"), 1))
    return counted.select(
        *by, (~F.col("a_form").eqNullSafe(F.col("b_form"))).alias("changed"), (rank("b") - rank("a")).cast("long").alias("confidence_delta"), "words_a", "words_b", percent.alias("word_delta"),
        _lacking(F.col("b_lists"), F.col("a_lists"), width, limit).alias("added"), _lacking(F.col("a_lists"), F.col("b_lists"), width, limit).alias("removed"),
    )
