"""Path expressions and file classification (Column -> Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension. (fixed values)
BY_EXTENSION = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".scala": "scala",
    ".sc": "scala",
    ".sh": "bash",
    ".bash": "bash",
    ".lua": "lua",
    ".zig": "zig",
    ".hs": "haskell",
    ".lhs": "haskell",
    ".ex": "elixir",
    ".exs": "elixir",
    ".ml": "ocaml",
    ".mli": "ocaml",
    ".jl": "julia",
    ".groovy": "groovy",
    ".gradle": "groovy",
    ".svelte": "svelte",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "css",
    ".sass": "css",
    ".json": "json",
    ".jsonc": "json",
    ".md": "markdown",
    ".mdx": "markdown",
    ".sql": "sql",
    ".cmake": "cmake",
    ".ini": "ini",
}

#: Parts of paths and extensions that decide a file's category. (fixed values)
SECRET_HINTS = (".env", "id_rsa", "id_ed25519", "credentials", "secret", "token", "key")
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".mp4", ".mp3", ".wav", ".pdf", ".zip", ".tar", ".gz")
CONFIGS = (".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".cfg", ".xml")

#: Ignored at the root of a tree. (fixed values)
DEFAULT_IGNORES = (".git/**", "node_modules/**", ".venv/**", "venv/**", "dist/**", "build/**", "target/**", "__pycache__/**", ".mypy_cache/**", ".pytest_cache/**", ".idea/**", ".vscode/**")

#: Layers, lowest first. (fixed values)
LAYERS = ("infrastructure", "domain", "service", "api", "controllers", "routes")


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(posix(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix with its dot, lower-cased; empty for dot files and names that end in a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def language(path: Column, first_line: Column | None = None) -> Column:
    """By file name, then extension, then the interpreter that the first line names."""
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    found = F.when(base_name(path) == "CMakeLists.txt", "cmake").otherwise(F.try_element_at(table, extension(path)))
    if first_line is None:
        return found
    bang = F.trim(first_line)
    named = F.when(F.contains(bang, F.lit("python")), "python").when(bang.rlike("node|deno"), "javascript").when(F.contains(bang, F.lit("sh")), "bash")
    return F.coalesce(found, F.when(F.startswith(bang, F.lit("#!")), named))


def category(path: Column) -> Column:
    """The first rule that holds decides."""
    low, name, ext = F.lower(path), F.lower(base_name(path)), extension(path)
    has = lambda *parts: low.rlike("|".join(re.escape(p) for p in parts))
    starts = lambda *parts: low.rlike("^(?:" + "|".join(re.escape(p) for p in parts) + ")")
    return (
        F.when(has(*SECRET_HINTS), "secret-risk")
        .when(ext.isin(*ASSETS), "asset")
        .when(low.rlike(r"\.min\.js$|generated|\.lock$"), "generated")
        .when(has("migration"), "migration")
        .when(is_test_manifest(path), "test")
        .when(starts("docs/") | ext.isin(".md", ".rst"), "docs")
        .when(name.isin("dockerfile", "makefile") | starts(".github/", "infra/"), "infra")
        .when(ext.isin(*CONFIGS), "config")
        .when(ext.isin(*BY_EXTENSION), "source")
        .otherwise("other")
    )


def is_test_manifest(path: Column) -> Column:
    """Test files as the manifest sees them."""
    return F.lower(path).rlike(r"^tests?/|_test\.|\.spec\.")


def is_test_analysis(path: Column) -> Column:
    """Test files as the analyzers see them."""
    return path.rlike(r"(?i)(?:^|/)tests?(?:/|$)|test_|_test|\.test\.|\.spec\.")


def is_test_export(path: Column) -> Column:
    """Test files as the symbol export sees them."""
    return F.lower(path).rlike(r"/tests?/|_test\.py$|\.spec\.|\.test\.")


def is_entrypoint(path: Column) -> Column:
    low = F.lower(path)
    name = base_name(low)
    return (
        name.isin("main.py", "__main__.py", "app.py", "server.py", "cli.py", "index.ts", "index.tsx")
        | low.rlike(r"/bin/|/cmd/|/manage\.py$")
        | (F.contains(low, F.lit("/routes/")) & name.rlike(r"index\.|router"))
    )


def is_package_marker(path: Column) -> Column:
    return path.rlike(r"(?:^|/)__init__\.py$")


def module_of(path: Column) -> Column:
    """The first part of a path, or ``<root>``."""
    parts = F.filter(F.split(posix(path), "/"), lambda p: ~p.isin("", "."))
    return F.when(F.size(parts) > 1, parts[0]).otherwise("<root>")


def layer_of(path: Column) -> Column:
    """The number of the first layer whose name is in a part of the path; -1 if there is none."""
    low = F.lower(path)
    found = F.when(F.contains(low, F.lit(LAYERS[0])), 0)
    for k, name in enumerate(LAYERS[1:], 1):
        found = found.when(F.contains(low, F.lit(name)), k)
    return found.otherwise(-1)


def collapsed(path: Column) -> Column:
    """A path without ``.`` and, as far as there is a part before, ``..``."""
    parts = F.filter(F.split(posix(path), "/"), lambda p: ~p.isin("", "."))

    def step(stack: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(stack) > 0) & (F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("..")) != "..")
        return F.when(back, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(F.concat(stack, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def suffixes(path: Column) -> Column:
    """The path and all its endings of whole parts, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: Column) -> Column:
    """struct(path, is_dir) of each directory above a file, and of the file."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i < F.size(parts)).alias("is_dir")))


def glob_regex(pattern: str) -> str:
    """A regular expression for a shell pattern whose ``*`` also matches slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def is_ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Ignored files: below an ignored directory (anchored at the root), or matched by a pattern."""
    every = [*DEFAULT_IGNORES, *(patterns or [])]
    below = "|".join(re.escape(p[:-3]) for p in every if p.endswith("/**"))
    matched = F.lit(False)
    for p in every:
        matched = matched | path.rlike(glob_regex(p))
    return path.rlike(f"^(?:{below})/") | matched
