"""Scalar text functions, all built-in expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z0-9_]+"
SLICES = 16


def normalize_space(text: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def corpus_tokens(text: Column) -> Column:
    """Word tokens of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct word tokens longer than one character, in order of first use."""
    return F.array_distinct(F.filter(corpus_tokens(text), lambda t: F.char_length(t) > 1))


def chunk_size(category: Column, language: Column) -> Column:
    """Target characters of a chunk by file category, else by language."""
    return (
        F.when(category == "docs", 1800).when(category == "config", 1200).when(category == "test", 1400)
        .when(language.isin("python", "typescript", "javascript", "ruby", "elixir", "julia"), 1500)
        .when(language.isin("haskell", "ocaml", "erlang"), 1400)
        .otherwise(1300)
    )


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliding_chunks(text: Column, size: Column) -> Column:
    """Overlapping slices: each begins max(120, size / 8) characters before the end of the one before.

    A slice is found by counting characters from the start, so a text is cut into blocks of ``SLICES`` slices first.
    """
    step = size - F.greatest(F.lit(120), F.floor(size / 8))
    part = lambda t, at, n: F.substr(t, (at + 1).cast("int"), n.cast("int"))

    def slices(t: Column) -> Column:
        # The last slice is the first that reaches the end.
        last = F.greatest(F.lit(0), F.ceil((F.char_length(t) - size) / step)).cast("long")
        within = lambda b: lambda t: F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(SLICES - 1).cast("long"), last - b * SLICES)), lambda k: part(t, k * step, size))
        blocks = F.sequence(F.lit(0).cast("long"), F.floor(last / SLICES))
        return F.flatten(F.transform(blocks, lambda b: _bound(part(t, b * SLICES * step, size + (SLICES - 1) * step), within(b))))

    return _bound(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), slices)


def ends_open(content: Column, language: Column) -> Column:
    """Whether a slice seems to end inside a block: more opening than closing braces, or, for Python, a definition whose
    last line that isn't blank is indented."""
    braces = F.regexp_count(content, F.lit(r"\{")) > F.regexp_count(content, F.lit(r"\}"))
    python = content.rlike(r"(?m)^[ \t]*(?:def |class |async def )") & content.rlike(r"(?:^|\n)[ \t][^\n]*\S[^\n]*\s*$")
    return F.when(F.trim(F.regexp_replace(content, r"\s", " ")) == "", False).when(F.lower(F.coalesce(language, F.lit(""))) == "python", python).otherwise(braces)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a part that isn't empty."""
    return F.floor((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("long")


def lexical_score(content: Column, path: Column, terms: list[str]) -> Column:
    """Occurrences of the terms in the content, and 2 for each that is part of the path."""
    low, low_path = F.lower(content), F.lower(path)
    score = F.lit(0).cast("long")
    for t in terms:
        score = score + occurrences(low, F.lit(t)) + F.when(F.contains(low_path, F.lit(t)), 2).otherwise(0)
    return score


def slug(text: Column, default: str = "report") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^a-zA-Z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(cleaned == "", default).otherwise(cleaned)


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def csv_quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset, from 0."""
    return F.regexp_count(F.substr(text, F.lit(1), offset.cast("int")), F.lit("\n")).cast("long") + 1


def excerpt(content: Column, expanded: Column) -> Column:
    """At most 2000 characters, 4000 of an expanded chunk; what is cut ends in three dots."""
    cap = F.when(expanded, 4000).otherwise(2000)
    return F.when(F.char_length(content) > cap, F.concat(F.rtrim(F.substr(content, F.lit(1), cap)), F.lit("..."))).otherwise(content)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\w+\b")).cast("long")


def confidence_rank(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low == "high", 3).when(low == "medium", 2).when(low == "low", 1).otherwise(0)


def severity_rank(value: Column) -> Column:
    return F.when(value == "high", 0).when(value == "medium", 1).when(value == "low", 2).otherwise(3)


def normalized_confidence(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")


#: Phrases that say that evidence is missing or cut. (fixed values)
MISSING_EVIDENCE = (
    "truncated",
    "not provided",
    "not present",
    "not included",
    "could not be verified",
    "were not provided",
    "not available",
    "incomplete",
    "limited to",
    "missing",
)

#: Names of models too small for the analysis. (fixed values)
SMALL_MODELS = (
    r"(^|[^0-9])1\.5b([^0-9]|$)",
    r"(^|[^0-9])1b([^0-9]|$)",
    r"(^|[^0-9])2b([^0-9]|$)",
    r"(^|[^0-9])3b([^0-9]|$)",
    r":mini\b",
    r":tiny\b",
    r"tinyllama",
    r"gemma[-_]?2b",
    r"qwen[^:]*:1\.5b",
    r"phi[-_]?3[:_-]?mini",
    r"smollm",
)


def misses_evidence(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(MISSING_EVIDENCE))


def follow_ups(text: Column) -> Column:
    """Queries that a note on missing evidence asks for: the paths in it, then its first 150 characters."""
    own = F.trim(F.substring(text, 1, 150))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"[\w./-]+\.\w{1,10}"), F.lit(0)), F.filter(F.array(own), lambda x: x != "")))


def is_small_model(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).rlike("|".join(f"(?:{p})" for p in SMALL_MODELS))


def source_host(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(F.contains(low, F.lit("github.com")), "github").when(F.contains(low, F.lit("bitbucket.org")), "bitbucket").otherwise("local")


def clean_patterns(patterns: Column) -> Column:
    """Trimmed patterns, blank ones dropped, the first of equals kept."""
    return F.array_distinct(F.filter(F.transform(patterns, lambda p: F.trim(p)), lambda p: p != ""))


def whole_words(words: list[str]) -> str:
    """A pattern for any of some words between characters that aren't ASCII letters, digits or underscores."""
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])"


def stable_id(*parts: Column) -> Column:
    """An id made of a row's own values, the same in every run."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
