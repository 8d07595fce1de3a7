"""Symbol references: which definition a call reaches.

Source files are parsed into five tables (definitions, imports, calls, attributes, bases); calls are resolved by four joins:
bare names, own methods, methods of attributes built in the class, and functions of imported modules. An import means one file, found
by its whole path: joins are on paths and endings of paths together with a name, of which an index holds one definition each, so
modules of one name in many folders neither mix nor multiply. Classes are told apart by
their files: a name means the class of its own file, else the imported one, else the only one of that name. A target found
with one type is of high confidence, one of several of low, as are the methods of the classes that implement an interface
that is the declared type of an attribute; what can't be resolved gives no row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import paths
from strataquill.operators.graph import ENDINGS
from strataquill.operators.symbols import UNPARSED
from strataquill.session import cut

SCHEMA = "rel_path string, fact string, owner string, name string, a string, b string, line long"


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def python_facts(path: str, content: str) -> list[tuple]:
    """Facts of a file: definition (owner class, name, qualified name), import (-, local name, module, original name), star,
    call (class, called name, caller, receiver), attribute (class, attribute, type), base (class, base, position)."""
    try:
        tree = ast.parse(content)
    except UNPARSED:
        return []
    out: list[tuple] = []

    def imports(node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            for x in node.names:
                out.append((path, "import", None, x.asname or x.name.split(".")[0], x.name, None, node.lineno))
        elif isinstance(node, ast.ImportFrom):
            for x in node.names:
                out.append((path, "star" if x.name == "*" else "import", None, x.asname or x.name, "." * node.level + (node.module or ""), x.name, node.lineno))

    def body(nodes, cls: str | None, caller: str | None) -> None:
        for node in nodes:
            imports(node)
            if isinstance(node, ast.ClassDef):
                out.append((path, "class", None, node.name, node.name, None, node.lineno))
                for k, base in enumerate(node.bases):
                    if name := _dotted(base):
                        out.append((path, "base", node.name, name.split(".")[-1], f"{k:03d}", None, node.lineno))
                body(ast.iter_child_nodes(node), node.name, caller)
                continue
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                qualified = f"{cls}.{node.name}" if cls else node.name
                # A function inside a function belongs to the outer one.
                if caller is None:
                    out.append((path, "function", cls, node.name, qualified, None, node.lineno))
                body(ast.iter_child_nodes(node), cls, caller or qualified)
                continue
            if isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(node.value, ast.Call) and cls:
                made = _dotted(node.value.func)
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if made and isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                        out.append((path, "attribute", cls, target.attr, made.split(".")[-1], None, node.lineno))
            if isinstance(node, ast.Call) and caller and (name := _dotted(node.func)):
                receiver, _, called = name.rpartition(".")
                out.append((path, "call", cls, called, caller, receiver or None, node.lineno))
            body(ast.iter_child_nodes(node), cls, caller)

    body(tree.body, None, None)
    return out


_TS_CLASS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface)\s+(\w+)(?:<[^{]*>)?(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?")
_TS_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|async|readonly)\s+)*(\w+)\s*(?:<[^(]*>)?\([^;]*\)\s*(?::[^{;]+)?\{")
_TS_FUNCTION = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)")
_TS_IMPORT = re.compile(r"^\s*import\s+\{([^}]*)\}\s+from\s+['\"]([^'\"]+)['\"]")
_TS_FIELD = re.compile(r"\b(?:private|public|protected|readonly)\s+(?:readonly\s+)?(\w+)\s*[?!]?:\s*(\w+)\b(?!\s*[(\[])")
_TS_NEW = re.compile(r"this\.(\w+)\s*=\s*new\s+(\w+)")
_TS_CALL = re.compile(r"((?:this\.)?(?:\w+\.)?)(?<![\w.])?\b(\w+)\s*(?:<[\w\s,]*>)?\(")
_TS_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "new", "typeof", "await", "super"}


def script_facts(path: str, content: str) -> list[tuple]:
    """The same facts of a TypeScript or JavaScript file, by lines and braces; interfaces have no bodies to reach."""
    out: list[tuple] = []
    depth, cls, cls_depth, fn, fn_depth = 0, None, 0, None, 0
    for number, line in enumerate(content.split("\n"), 1):
        if m := _TS_IMPORT.match(line):
            for x in filter(None, (x.strip() for x in m[1].split(","))):
                original, _, local = x.partition(" as ")
                out.append((path, "import", None, (local or original).strip(), m[2], original.strip(), number))
        opened = None
        if (m := _TS_CLASS.match(line)) and cls is None:
            out.append((path, m[1], None, m[2], m[2], None, number))
            for k, base in enumerate(filter(None, [m[3], *(x.strip() for x in (m[4] or "").split(","))])):
                out.append((path, "base", m[2], base, f"{k:03d}", None, number))
            cls, cls_depth = (m[2], m[1]), depth
        elif (m := _TS_FUNCTION.match(line)) and fn is None:
            opened = m[1]
            out.append((path, "function", None, opened, opened, None, number))
        elif cls and cls[1] == "class" and fn is None and (m := _TS_METHOD.match(line)) and m[1] not in _TS_WORDS - {"constructor"}:
            opened = f"{cls[0]}.{m[1]}"
            out.append((path, "function", cls[0], m[1], opened, None, number))
        if opened:
            fn, fn_depth = opened, depth
        owner = cls[0] if cls and cls[1] == "class" else None
        if owner:
            out += [(path, "attribute", owner, a, made, None, number) for a, made in _TS_NEW.findall(line)]
            if fn is None or opened:  # fields and parameters that are fields, by their declared types
                out += [(path, "field", owner, a, of_type, None, number) for a, of_type in _TS_FIELD.findall(line)]
        if fn:
            rest = line[line.index("{") + 1 :] if opened and "{" in line else "" if opened else line
            for receiver, name in _TS_CALL.findall(rest):
                if name not in _TS_WORDS:
                    receiver = receiver.rstrip(".").replace("this", "self", 1) if receiver.startswith("this") else receiver.rstrip(".")
                    out.append((path, "call", owner, name, fn, receiver or None, number))
        depth += line.count("{") - line.count("}")
        if fn and depth <= fn_depth and "}" in line:
            fn = None
        if cls and depth <= cls_depth and "}" in line:
            cls = None
    return out


def facts(files: DataFrame) -> DataFrame:
    """All facts of files (rel_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for path, content in zip(b["rel_path"], b["content"], strict=True):
                rows += python_facts(path, content or "") if path.endswith(".py") else script_facts(path, content or "")
            yield pd.DataFrame(rows, columns=columns)

    kept = files.where(F.col("rel_path").rlike(r"\.(?:py|tsx?|jsx?)$")).select("rel_path", "content")
    return kept.mapInPandas(run, SCHEMA)


def _tries(imports: DataFrame) -> DataFrame:
    """``imports`` (rel_path, local, module, original) with the places that each may mean: ``key`` and its turn ``k``.

    A key is ``=`` and a path, or ``~`` and an ending of paths. Relative imports mean a path from their folder; those of Python,
    like the absolute ones, also any file whose path ends like the module's, or with which the module's path ends. Scripts take
    the first of the endings that may be left out. Modules of scripts that aren't relative are not files.
    """
    python, module = F.endswith("rel_path", F.lit(".py")), F.col("module")
    folder = F.regexp_replace("rel_path", r"(?:^|/)[^/]*$", "")
    below = lambda rest: paths.collapsed(F.concat_ws("/", F.when(folder == "", None).otherwise(folder), rest))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    endings = paths.suffixes(F.concat(rest, F.lit(".py")))
    exact = lambda path: F.concat(F.lit("="), path)
    of_python = F.concat(
        F.when(dots > 0, F.array(exact(F.concat(below(F.concat(up, rest)), F.lit(".py"))))).otherwise(F.array().cast("array<string>")),
        F.when(rest != "", F.concat(F.array(F.concat(F.lit("~"), rest, F.lit(".py"))), F.transform(F.slice(endings, F.lit(2), F.greatest(F.size(endings), F.lit(1))), exact))).otherwise(F.array().cast("array<string>")),
    )
    of_scripts = F.when(F.startswith("module", F.lit(".")), F.array(*[exact(F.concat(below(module), F.lit(e))) for e in ENDINGS]))
    keys = F.when(python, of_python).otherwise(of_scripts)
    return imports.select("rel_path", "local", "original", F.posexplode(keys).alias("k", "key"))


def _places(defined: DataFrame, *values: str) -> DataFrame:
    """``defined`` (def_path, name, values) by key: for each key and name the values of the smallest path that has both."""
    ends = F.transform(paths.suffixes(F.col("def_path")), lambda x: F.concat(F.lit("~"), x))
    each = defined.select("name", F.struct("def_path", *values).alias("place"), F.explode(F.concat(F.array(F.concat(F.lit("="), "def_path")), ends)).alias("key"))
    return each.groupBy("key", "name").agg(F.min("place").alias("place"))


def _found(wanted: DataFrame, places: DataFrame, *by: str) -> DataFrame:
    """The place of the first try that has one for each row of ``wanted`` (by, key, name, k)."""
    hits = wanted.join(places.hint("merge"), ["key", "name"])
    return hits.groupBy(*by).agg(F.min_by("place", "k").alias("place")).select(*by, "place.*")


def resolve(found: DataFrame) -> DataFrame:
    """src_symbol, dst_symbol, edge_type, confidence, line of the calls in a table of facts."""
    found = cut(found)
    of = lambda *kinds: found.where(F.col("fact").isin(*kinds))
    defs = of("function").select(F.col("rel_path").alias("def_path"), F.col("owner").alias("def_owner"), F.col("name").alias("def_name"), F.col("a").alias("def_symbol")).distinct()
    calls = of("call").select("rel_path", F.col("owner").alias("cls"), F.col("name").alias("called"), F.col("a").alias("caller"), F.col("b").alias("receiver"), "line")
    imports = of("import").select("rel_path", F.col("name").alias("local"), F.struct("line", F.col("a").alias("module"), F.coalesce("b", "name").alias("original"), F.col("b").isNotNull().alias("inner")).alias("x"))
    # A name that is imported twice means the last.
    imports = cut(imports.groupBy("rel_path", "local").agg(F.max("x").alias("x")).select("rel_path", "local", "x.module", "x.original", "x.inner"))
    tries = cut(_tries(imports))
    symbol = lambda path, name: F.concat(F.col(path), F.lit("::"), F.col(name))
    edge = lambda rows, n: rows.select(symbol("rel_path", "caller").alias("src_symbol"), symbol("def_path", "def_symbol").alias("dst_symbol"), n.cast("long").alias("types"), "line")

    # Bare names: imported ones, else the file's own; a star import hides where names come from.
    bare = calls.where("receiver is null").join(of("star").select("rel_path").distinct().hint("merge"), "rel_path", "left_anti")
    module_level = defs.where("def_owner is null")
    places = cut(_places(module_level.withColumnRenamed("def_name", "name"), "def_symbol"))
    own = bare.join(imports.select("rel_path", F.col("local").alias("called")).hint("merge"), ["rel_path", "called"], "left_anti")
    own = own.join(module_level.hint("merge"), (bare["rel_path"] == module_level["def_path"]) & (bare["called"] == module_level["def_name"]))
    bound = _found(tries.withColumnRenamed("original", "name"), places, "rel_path", "local")
    through = bare.join(bound.withColumnRenamed("local", "called").hint("merge"), ["rel_path", "called"])
    edges = edge(own, F.lit(1)).unionByName(edge(through, F.lit(1)))

    # Functions of imported modules: a name imported from a module may be a module inside it.
    inside = F.concat("module", F.when(F.endswith("module", F.lit(".")), F.lit("")).otherwise(F.lit(".")), "original")
    inner = imports.where(F.col("inner") & F.endswith("rel_path", F.lit(".py"))).select("rel_path", "local", inside.alias("module"), "original")
    modules = _tries(inner).unionByName(tries.withColumn("k", F.col("k") + 100)).drop("original").withColumnRenamed("local", "receiver")
    via = calls.where("receiver is not null and receiver not like 'self%'")
    asked = via.select("rel_path", "receiver", F.col("called").alias("name")).distinct().join(modules.hint("merge"), ["rel_path", "receiver"])
    edges = edges.unionByName(edge(via.join(_found(asked, places, "rel_path", "receiver", "name").withColumnRenamed("name", "called").hint("merge"), ["rel_path", "receiver", "called"]), F.lit(1)))

    # What the names of types mean: (rel_path, type, key, is_interface).
    key = lambda path, name: F.concat(F.col(path), F.lit("::"), F.col(name))
    classes = of("class", "interface").select(F.col("rel_path").alias("def_path"), F.col("name").alias("original"), (F.col("fact") == "interface").alias("is_interface")).distinct()
    classes = cut(classes.withColumn("key", key("def_path", "original")))
    attributes = of("attribute", "field").select("rel_path", F.col("owner").alias("cls"), F.col("name").alias("attribute"), F.col("a").alias("type"), (F.col("fact") == "field").alias("declared")).distinct()
    bases = of("base").select("rel_path", F.col("owner").alias("cls"), F.col("name").alias("type"), F.coalesce("a", F.lit("000")).alias("position")).distinct()
    named = cut(attributes.select("rel_path", "type").unionByName(bases.select("rel_path", "type")).distinct())
    own_types = named.join(classes.select(F.col("def_path").alias("rel_path"), F.col("original").alias("type"), "key", "is_interface").hint("merge"), ["rel_path", "type"])
    left = named.join(own_types.select("rel_path", "type").hint("merge"), ["rel_path", "type"], "left_anti")
    asked_types = tries.withColumnRenamed("local", "type").join(left.hint("merge"), ["rel_path", "type"], "left_semi").withColumnRenamed("original", "name")
    through_types = _found(asked_types, _places(classes.withColumnRenamed("original", "name"), "key", "is_interface"), "rel_path", "type").select("rel_path", "type", "key", "is_interface")
    left = left.join(through_types.select("rel_path", "type").hint("merge"), ["rel_path", "type"], "left_anti")
    only = classes.groupBy(F.col("original").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("is_interface").alias("is_interface")).where("n = 1").drop("n")
    means = cut(own_types.unionByName(through_types).unionByName(left.join(only.hint("merge"), "type").select("rel_path", "type", "key", "is_interface")).distinct())

    # Where a class's methods are looked up: itself, then its bases, the first one with its own bases before the next, at
    # most twenty levels; ``place`` sorts them.
    parents = cut(bases.join(means.hint("merge"), ["rel_path", "type"]).select(key("rel_path", "cls").alias("ancestor"), F.col("key").alias("parent"), "position", "is_interface"))
    level = classes.select("key", F.col("key").alias("ancestor"), F.lit("").alias("place"))
    chain = level
    for _ in range(20):
        grown = level.join(parents.select("ancestor", "parent", "position").hint("merge"), "ancestor").select("key", F.col("parent").alias("ancestor"), F.concat("place", "position").alias("place"))
        level = cut(grown.join(chain.select("key", "ancestor").hint("merge"), ["key", "ancestor"], "left_anti").groupBy("key", "ancestor").agg(F.min("place").alias("place")))
        if level.isEmpty():
            break
        chain = chain.unionByName(level)
    methods = defs.where("def_owner is not null").select(key("def_path", "def_owner").alias("ancestor"), "def_name", "def_path", "def_symbol")
    first = Window.partitionBy("key", "def_name")
    reach = chain.join(methods.hint("merge"), "ancestor").withColumn("first", F.min("place").over(first)).where("place = first").select("key", F.col("def_name").alias("called"), "def_path", "def_symbol")

    mine = calls.where("receiver = 'self' and cls is not null").withColumn("key", key("rel_path", "cls")).join(reach.hint("merge"), ["key", "called"])
    edges = edges.unionByName(edge(mine, F.lit(1)))

    # Attributes by the types that are built for them, and by declared interfaces, which stand for all that implement them.
    built = attributes.where("not declared").join(means.hint("merge"), ["rel_path", "type"])
    types = attributes.where("not declared").groupBy("rel_path", "cls", "attribute").agg(F.countDistinct("type").alias("types"))
    held = calls.where("receiver like 'self.%'").withColumn("attribute", F.substring_index("receiver", ".", -1))
    made = held.join(built.where("not is_interface").select("rel_path", "cls", "attribute", "key").hint("merge"), ["rel_path", "cls", "attribute"]).join(types.hint("merge"), ["rel_path", "cls", "attribute"]).join(reach.hint("merge"), ["key", "called"])
    edges = edges.unionByName(edge(made, F.col("types")))
    declared = attributes.join(means.hint("merge"), ["rel_path", "type"]).where("is_interface").select("rel_path", "cls", "attribute", F.col("key").alias("parent"))
    # What is built in the class is known better than what is declared.
    declared = declared.join(built.where("not is_interface").select("rel_path", "cls", "attribute").hint("merge"), ["rel_path", "cls", "attribute"], "left_anti")
    implementors = parents.where("is_interface").select("parent", F.col("ancestor").alias("key"))
    injected = held.join(declared.hint("merge"), ["rel_path", "cls", "attribute"]).join(implementors.hint("merge"), "parent").join(reach.hint("merge"), ["key", "called"])
    edges = edges.unionByName(edge(injected, F.lit(2)))

    confidence = F.when(F.col("types") > 1, "low").otherwise("high")
    rows = edges.where("src_symbol <> dst_symbol").select("src_symbol", "dst_symbol", F.lit("call").alias("edge_type"), confidence.alias("confidence"), "line")
    return rows.groupBy("src_symbol", "dst_symbol", "edge_type", "confidence").agg(F.min("line").alias("line"))


def symbol_edges(files: DataFrame) -> DataFrame:
    """Resolved calls of source files (rel_path, content)."""
    return resolve(facts(files))


def file_references(edges: DataFrame) -> DataFrame:
    """(src_path, dst_path) of symbol edges between different files."""
    rows = edges.select(F.substring_index("src_symbol", "::", 1).alias("src_path"), F.substring_index("dst_symbol", "::", 1).alias("dst_path"))
    return rows.where("src_path <> dst_path").distinct()
