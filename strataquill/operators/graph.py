"""Graphs of files: import resolution, centrality, neighbourhoods, cycles, communities.

Edges: src_path, dst_path, edge_type, is_external. Degree, neighbourhood, resolution and summaries are joins and group-bys.
Strongly connected components lie inside weakly connected parts of a graph: parts of at most ``LARGEST`` edges are solved in
groups of their own; larger ones lose what is in no cycle, and if they are still large have their chains drawn together first and go in rounds of joins (coloring and backward reach)
if they are still large, so no task holds a graph of unbounded size. Communities are in a module of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.functions import paths, text
from strataquill.operators.chains import Shortened, turned
from strataquill.operators.communities import multilevel
from strataquill.operators.parts import connected, numbered
from strataquill.session import Rounds, cut, remove

#: Import statements of TypeScript and JavaScript. (fixed values)
IMPORT_FROM = r"""(?m)^\s*import\s+(?:[^'"]+?\s+from\s+)?['"]([^'"]+)['"]"""
REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""

#: What may be appended to a relative import, in order of preference. (fixed values)
ENDINGS = ("", ".py", ".ts", ".tsx", ".js", ".jsx", "/index.py", "/index.ts", "/index.tsx", "/index.js")


def script_imports(files: DataFrame) -> DataFrame:
    """(src_path, target, position): import statements first, then require calls."""
    found = F.concat(F.regexp_extract_all("content", F.lit(IMPORT_FROM), F.lit(1)), F.regexp_extract_all("content", F.lit(REQUIRE), F.lit(1)))
    rows = files.select(F.col("rel_path").alias("src_path"), F.posexplode(found).alias("position", "target"))
    return rows.select("src_path", "target", F.col("position").cast("long"))


def suffix_index(files: DataFrame) -> DataFrame:
    """(suffix, dst_path) of Python files; of files with one suffix, the smallest path."""
    each = files.where(F.endswith("rel_path", F.lit(".py"))).select("rel_path", F.explode(paths.suffixes(F.col("rel_path"))).alias("suffix"))
    return each.groupBy("suffix").agg(F.min("rel_path").alias("dst_path"))


def resolve_dotted(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, target, dst_path) of dotted module names; dst_path is null if no file ends that way."""
    guess = F.concat(F.replace("target", F.lit("."), F.lit("/")), F.lit(".py"))
    return imports.withColumn("suffix", guess).join(suffix_index(files), "suffix", "left").select("src_path", "target", "dst_path")


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, target, dst_path) of imports relative to their file: the first existing of ten candidates."""
    folder = F.regexp_replace("src_path", r"(?:^|/)[^/]*$", "")
    base = paths.collapsed(F.concat_ws("/", F.when(folder == "", None).otherwise(folder), F.col("target")))
    wanted = imports.select("src_path", "target", base.alias("base")).distinct()
    tried = wanted.select("src_path", "target", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS])).alias("k", "candidate"))
    hit = tried.join(files.select(F.col("rel_path").alias("candidate")).distinct(), "candidate")
    best = hit.groupBy("src_path", "target").agg(F.min_by("candidate", "k").alias("dst_path"))
    return imports.join(best, ["src_path", "target"], "left").select("src_path", "target", "dst_path")


def build_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of imports (src_path, target): resolved ones internal, others external with the text as target."""
    relative = F.startswith("target", F.lit("."))
    python = F.endswith("src_path", F.lit(".py"))
    found = resolve_relative(imports.where(relative & ~python), files).unionByName(resolve_dotted(imports.where(python), files))
    rest = imports.where(~relative & ~python).select("src_path", "target", F.lit(None).cast("string").alias("dst_path"))
    rows = found.unionByName(rest)
    return rows.select("src_path", F.coalesce("dst_path", "target").alias("dst_path"), F.lit("import").alias("edge_type"), F.col("dst_path").isNull().alias("is_external"))


def reresolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct internal edges (src, dst) among nodes, with stored external ones resolved again; no self loops."""
    own = edges.join(nodes.select(F.col("rel_path").alias("src_path")).distinct(), "src_path", "left_semi").where("src_path <> dst_path")
    inside = own.where(~F.col("is_external")).join(nodes.select(F.col("rel_path").alias("dst_path")).distinct(), "dst_path", "left_semi").select("src_path", "dst_path")
    outside = own.where("is_external").select("src_path", F.col("dst_path").alias("target"))
    dotted = F.endswith("src_path", F.lit(".py")) & ~F.contains("target", F.lit("/")) & ~F.startswith("target", F.lit("."))
    again = resolve_dotted(outside.where(dotted), nodes).unionByName(resolve_relative(outside.where(F.startswith("target", F.lit("."))), nodes))
    again = again.where(F.col("dst_path").isNotNull() & (F.col("dst_path") != F.col("src_path"))).select("src_path", "dst_path")
    return inside.unionByName(again).distinct().select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))


def graph_nodes(files: DataFrame) -> DataFrame:
    """Nodes: files other than package markers and tests."""
    return files.where(~paths.is_package_marker(F.col("rel_path")) & (F.col("category") != "test")).select("rel_path")


def centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """rel_path, indegree, outdegree, score = 3 in + out of all nodes and edge ends; repeated edges count."""
    ends = edges.select(F.col("src_path").alias("rel_path"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst_path").alias("rel_path"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("rel_path", F.lit(0).alias("i"), F.lit(0).alias("o")))
    total = ends.groupBy("rel_path").agg(F.sum("i").cast("long").alias("indegree"), F.sum("o").cast("long").alias("outdegree"))
    return total.withColumn("score", F.col("indegree") * 3 + F.col("outdegree"))


def top_central(scores: DataFrame, limit: int = 30) -> DataFrame:
    return scores.orderBy(F.desc("score"), F.desc("indegree"), "rel_path").limit(limit)


def _one_row(spark: SparkSession, **values: DataFrame) -> DataFrame:
    """One row of the values of one-row, one-column tables."""
    return spark.range(1).select(*[v.scalar().alias(k) for k, v in values.items()])


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    count = lambda rows: rows.agg(F.count(F.lit(1)))
    return _one_row(
        edges.sparkSession, total_edges=count(edges), external_edges=count(edges.where("is_external")), total_nodes=count(nodes), n_entrypoints=count(nodes.where(paths.is_entrypoint(F.col("rel_path"))))
    )


def list_edges(edges: DataFrame, limit: int = 2000) -> DataFrame:
    return edges.orderBy("src_path", "dst_path", "edge_type").limit(limit)


def neighbours(edges: DataFrame, seed: str, hops: int = 1, limit: int = 2000) -> DataFrame:
    """(rel_path, hop) around a seed over internal edges in both directions; nodes enter by hop, then path, up to a limit.

    Each hop joins the edges with its frontier, which the limit bounds and which is therefore broadcast."""
    hops, limit = min(max(hops, 1), 4), min(max(limit, 10), 2000)
    inner = edges.where(~F.col("is_external"))
    both = inner.select(F.col("src_path").alias("a"), F.col("dst_path").alias("b")).unionByName(inner.select(F.col("dst_path").alias("a"), F.col("src_path").alias("b")))
    visited = edges.sparkSession.range(1).select(F.lit(seed).alias("rel_path"), F.lit(0).cast("long").alias("hop"))
    for hop in range(1, hops + 1):
        edge_of = F.broadcast(visited.where(F.col("hop") == hop - 1).select(F.col("rel_path").alias("a")))
        reached = both.join(edge_of, "a").select(F.col("b").alias("rel_path")).distinct().join(F.broadcast(visited.select("rel_path")), "rel_path", "left_anti")
        grown = visited.unionByName(reached.withColumn("hop", F.lit(hop).cast("long")))
        visited = cut(grown.orderBy("hop", "rel_path").limit(limit))
    return visited


def neighbourhood_edges(edges: DataFrame, visited: DataFrame, hops: int) -> DataFrame:
    """Internal edges that touch a node less than ``hops`` away from the seed."""
    inner = F.broadcast(visited.where(F.col("hop") < hops).select("rel_path"))
    kept = edges.where(~F.col("is_external"))
    touches = kept.join(inner, kept["src_path"] == inner["rel_path"], "left_semi").unionByName(kept.join(inner, kept["dst_path"] == inner["rel_path"], "left_semi"))
    return touches.select("src_path", "dst_path", "edge_type").distinct()


def edge_lists(edges: DataFrame, node: str) -> DataFrame:
    """(direction, rel_path) of a node's incoming and outgoing edges, repeats kept."""
    into = edges.where(F.col("dst_path") == node).select(F.lit("in").alias("direction"), F.col("src_path").alias("rel_path"))
    return into.unionByName(edges.where(F.col("src_path") == node).select(F.lit("out").alias("direction"), F.col("dst_path").alias("rel_path")))


# Cycles ----------------------------------------------------------------------------------------------------------


def strongly_connected(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Groups of at least two nodes that reach each other; largest first, then by members."""
    out: dict[str, list[str]] = defaultdict(list)
    back: dict[str, list[str]] = defaultdict(list)
    for a, b in pairs:
        if a != b:
            out[a].append(b)
            back[b].append(a)
    # Two passes: nodes by the time at which a search leaves them, then backward searches in reverse order.
    left: list[str] = []
    seen: set[str] = set()
    for start in sorted(out):
        if start in seen:
            continue
        seen.add(start)
        todo = [(start, iter(out[start]))]
        while todo:
            node, rest = todo[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    todo.append((b, iter(out.get(b, ()))))
                    break
            else:
                todo.pop()
                left.append(node)
    groups, done = [], set()
    for start in reversed(left):
        if start in done:
            continue
        done.add(start)
        group, todo = [], [start]
        while todo:
            node = todo.pop()
            group.append(node)
            for a in back.get(node, ()):
                if a not in done:
                    done.add(a)
                    todo.append(a)
        if len(group) > 1:
            groups.append(sorted(group))
    return sorted(groups, key=lambda g: (-len(g), g))


LARGEST = 1_000_000  # edges that one task may hold


def trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without nodes that lack an incoming or an outgoing edge, which are in no cycle."""
    now = edges.where("src_path <> dst_path").select("src_path", "dst_path").distinct()
    for _ in range(rounds):
        kept = now.join(now.select(F.col("dst_path").alias("src_path")).distinct(), "src_path", "left_semi")
        now = cut(kept.join(kept.select(F.col("src_path").alias("dst_path")).distinct(), "dst_path", "left_semi").select("src_path", "dst_path"))
    return now


def _settled(step: Callable[[DataFrame], DataFrame], now: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Repeats a step on (node, label) until no label changes; each round is written."""
    seen, table = None, Rounds(now.sparkSession)
    for _ in range(rounds):
        now = table.write(step(now))
        state = now.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if state == seen:
            return now
        seen = state
    raise RuntimeError(f"labels didn't settle in {rounds} rounds")


def _reached(begin: np.ndarray, head: np.ndarray, start: int, steps: int = 64) -> np.ndarray | None:
    """Which nodes edges lead to from ``start``; those of node k are ``head[begin[k]:begin[k + 1]]``. Nothing if it takes more steps."""
    seen, front = np.zeros(len(begin) - 1, bool), np.array([start])
    seen[start] = True
    for _ in range(steps):
        counts = begin[front + 1] - begin[front]
        found = head[np.repeat(begin[front] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        front = np.unique(found[~seen[found]])
        if not len(front):
            return seen
        seen[front] = True
    return None


def component_roots(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For the nodes 0 to n - 1 of distinct edges the smallest node of their strongly connected component; -1 if alone.

    The component of the node with the most edges is often most of the graph; it is what the node reaches both ways. The search
    by single nodes is for the rest."""
    roots = np.full(n, -1)
    into, out = np.bincount(dst, minlength=n), np.bincount(src, minlength=n)
    start = int(np.minimum(into, out).argmax())
    there = _reached(np.r_[0, np.cumsum(out)], dst[np.argsort(src, kind="stable")], start)
    back = _reached(np.r_[0, np.cumsum(into)], src[np.argsort(dst, kind="stable")], start) if there is not None else None
    if there is not None and back is not None:
        own = there & back
        if own.sum() > 1:
            roots[own] = np.flatnonzero(own)[0]
        # No cycle of others crosses the border of what is reached one way.
        kept = ~own[src] & ~own[dst] & (there[src] == there[dst]) & (back[src] == back[dst])
        src, dst = src[kept], dst[kept]
    for group in strongly_connected(list(zip(src.tolist(), dst.tolist(), strict=True))):
        roots[group] = group[0]
    return roots


def in_one_task(pairs: DataFrame, *by: str) -> DataFrame:
    """(node, root) of the strongly connected components of at least two nodes of each group of distinct pairs (src, dst)."""
    kind = pairs.schema["src"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["src"] != group["dst"]]
        # Numbers in the order of names take less room than names. (pandas' factorize takes names that begin with NUL for one.)
        if kind == "string":
            names = np.array(sorted({*group["src"], *group["dst"]}), dtype=object)
            number = {name: k for k, name in enumerate(names)}
            src, dst = (np.array([number[x] for x in group[c]], dtype=np.int64) for c in ("src", "dst"))
        else:
            names = np.unique(group[["src", "dst"]].to_numpy())
            src, dst = (np.searchsorted(names, group[c].to_numpy()) for c in ("src", "dst"))
        if not len(names):
            return pd.DataFrame({"node": names, "root": names})
        roots = component_roots(src, dst, len(names))
        found = roots >= 0
        return pd.DataFrame({"node": names[found], "root": names[roots[found]]})

    return pairs.select("src", "dst", *by).groupBy(*(by or (F.lit(0).alias("one"),))).applyInPandas(run, f"node {kind}, root {kind}")


def long_cycles(pairs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(node, root) of the strongly connected components of at least two nodes of pairs (src, dst). Chains are drawn together
    along incoming, then along outgoing edges; what is left goes to one task if it has at most ``largest`` edges."""
    forward = Shortened(pairs)
    backward = Shortened(turned(forward.pairs))
    rest = backward.pairs.where("src <> dst")
    found = in_one_task(rest) if rest.limit(largest + 1).count() <= largest else colored(rest)
    found = cut(found.select("node", F.col("root").alias("label")))
    loops = backward.pairs.where("src = dst").select(F.col("src").alias("node"))
    found = found.unionByName(loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))
    members = forward.expand(backward.expand(found))
    roots = members.groupBy("label").agg(F.min("node").alias("root"))
    return members.join(roots, "label").select("node", "root")


def colored(pairs: DataFrame) -> DataFrame:
    """(node, root) of the strongly connected components of at least two nodes of pairs (src, dst), in rounds of joins.

    Each node takes the largest node that reaches it as its color; a node of its own color and those of that color that
    reach it are a component. They are removed, and the rest goes on."""
    out, left = None, trimmed(pairs.toDF("src_path", "dst_path")).toDF("src", "dst")
    while not left.isEmpty():
        ends = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()

        def spread(now: DataFrame, edges: DataFrame = left) -> DataFrame:
            sent = edges.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("sent"))
            return now.join(sent, "node", "left").select("node", F.greatest("label", F.coalesce("sent", "label")).alias("label"))

        colors = _settled(spread, ends.select("node", F.col("node").alias("label")))
        a, b = colors.toDF("src", "c_src"), colors.toDF("dst", "c_dst")
        inner = cut(left.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst"))

        def back(now: DataFrame, edges: DataFrame = inner) -> DataFrame:
            more = edges.join(now.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label")
            return now.unionByName(more).distinct()

        members = _settled(back, colors.where("node = label"))
        groups = members.groupBy("label").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found = members.join(groups, "label").select("node", "root")
        out = cut(found if out is None else out.unionByName(found))
        gone = members.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = trimmed(rest.select(F.col("src").alias("src_path"), F.col("dst").alias("dst_path"))).toDF("src", "dst")
    return pairs.select(F.col("src").alias("node"), F.col("dst").alias("root")).where(F.lit(False)) if out is None else out


def _by_size(pairs: DataFrame, largest: int) -> tuple[DataFrame, DataFrame | None]:
    """``pairs`` (src, dst; numbers) of weakly connected parts of at most ``largest`` edges, with the ``key`` of a task for whole parts; those of
    larger parts, if any."""
    labels = connected(pairs).toDF("src", "part")
    sizes = cut(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(labels, "src").groupBy("part").agg(F.sum("n").alias("n")))
    # Parts of some size have a task of their own, smaller ones share one. All are dealt out: they take long for their few bytes.
    told = sizes.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > largest).alias("large")).first()
    shared = F.pmod(F.xxhash64("part"), F.lit(8 * (told["n"] or 0) // max(largest, 1) + 1))
    keys = labels.join(sizes.select("part", (F.col("n") > largest).alias("large"), F.when(F.col("n") > largest // 8, F.col("part")).otherwise(shared).alias("key")), "part").drop("part")
    parts = pairs.join(keys, "src")
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(16 * (told["n"] or 0) // max(largest, 1), 2000))
    few = parts.where("not large").repartition(tasks, "key").select("src", "dst", "key")
    return few, parts.where("large").select("src", "dst") if told["large"] else None


def cycles(edges: DataFrame, snapshot_col: str | None = None, largest: int | None = None) -> DataFrame:
    """(cycle_no, cycle_size, rel_path) of strongly connected components of at least two nodes, per snapshot; the largest
    first, then by their smallest member."""
    largest = LARGEST if largest is None else largest
    inner, mark = edges.where(~F.col("is_external")), "\x00"
    own = F.col(snapshot_col).cast("string") if snapshot_col else F.lit("")
    named = lambda c: F.concat(own, F.lit(mark), c).alias(c)
    table = Rounds(edges.sparkSession)
    pairs, names = numbered(inner.where("src_path <> dst_path").select(named("src_path").alias("src"), named("dst_path").alias("dst")).distinct(), table)
    pairs = pairs.toDF("src", "dst")
    few, many = _by_size(pairs, largest)
    found = in_one_task(few, "key")
    if many is not None:
        # Nodes that are in no cycle may be what holds a large part together.
        few, many = _by_size(trimmed(many.toDF("src_path", "dst_path")).toDF("src", "dst"), largest)
        found = found.unionByName(in_one_task(few, "key"))
        if many is not None:
            found = found.unionByName(long_cycles(many, largest))
    members = cut(found.join(names.toDF("node", "name"), "node").select("root", "name"))
    smallest = members.groupBy("root").agg(F.min("name").alias("least"))
    found = cut(members.join(smallest, "root").select(F.col("name").alias("node"), F.col("least").alias("root")))
    remove(edges.sparkSession, table.folder)
    # One row for each cycle is numbered.
    counted = found.groupBy("root").agg(F.count(F.lit(1)).alias("cycle_size"))
    order = Window.partitionBy(F.substring_index("root", mark, 1)).orderBy(F.desc("cycle_size"), "root")
    told = found.join(counted.withColumn("cycle_no", F.row_number().over(order).cast("long") - 1), "root")
    out = told.select(F.substring_index("node", mark, 1).alias("snapshot_id"), "cycle_no", "cycle_size", F.substring_index("node", mark, -1).alias("rel_path"))
    return out if snapshot_col else out.drop("snapshot_id")


# Communities -----------------------------------------------------------------------------------------------------


def communities(pairs: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(rel_path, community_id) from edges (src, dst) by modularity over several levels. Nodes without edges are alone;
    communities are numbered by their smallest member."""
    homes = multilevel(pairs, resolution)
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node")))
    every = nodes.select(F.col("rel_path").alias("node")).unionByName(ends).distinct()
    held = cut(every.join(homes, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    # One row for each community is numbered.
    numbers = held.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("community_id"))
    return held.join(numbers, "label").select(F.col("node").alias("rel_path"), "community_id")


def absorb_singletons(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes alone in their community go to the one most of their neighbours were in; equal votes to the smallest id."""
    both = pairs.select(F.col("src").alias("rel_path"), F.col("dst").alias("other")).unionByName(pairs.select(F.col("dst").alias("rel_path"), F.col("src").alias("other")))
    alone = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("rel_path")).where("n = 1").select("rel_path", F.col("community_id").alias("own"))
    there = members.select(F.col("rel_path").alias("other"), F.col("community_id").alias("there"))
    votes = both.join(alone, "rel_path").join(there, "other").where("there <> own").groupBy("rel_path", "there").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("rel_path").agg(F.max_by("there", F.struct("n", -F.col("there"))).alias("chosen"))
    return members.join(chosen, "rel_path", "left").select("rel_path", F.coalesce("chosen", "community_id").alias("community_id"))


def community_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with the communities of their ends: src, dst, c_src, c_dst."""
    a, b = members.select(F.col("rel_path").alias("src"), F.col("community_id").alias("c_src")), members.select(F.col("rel_path").alias("dst"), F.col("community_id").alias("c_dst"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "c_src", "c_dst")


def community_edges(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Directed edge counts between different communities."""
    return community_pairs(members, pairs).where("c_src <> c_dst").groupBy("c_src", "c_dst").agg(F.count(F.lit(1)).alias("n_edges"))


def hub_scores(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """rel_path, community_id, hub_score: edges into a node from its own community."""
    inner = community_pairs(members, pairs).where("c_src = c_dst").groupBy(F.col("dst").alias("rel_path")).agg(F.count(F.lit(1)).alias("hub_score"))
    return members.join(inner, "rel_path", "left").select("rel_path", "community_id", F.coalesce("hub_score", F.lit(0)).cast("long").alias("hub_score"))


def community_summaries(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """community_id, member_count, size_share, hubs (three, by score then path), neighbours."""
    scored = hub_scores(members, pairs)
    first = scored.withColumn("rn", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("hub_score"), "rel_path"))).where("rn <= 3")
    hubs = first.groupBy("community_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "rel_path"))), lambda x: x["rel_path"]).alias("hubs"))
    between = community_edges(members, pairs)
    near = between.select(F.col("c_src").alias("community_id"), F.col("c_dst").alias("n")).unionByName(between.select(F.col("c_dst").alias("community_id"), F.col("c_src").alias("n")))
    near = near.groupBy("community_id").agg(F.sort_array(F.collect_set("n")).alias("neighbours"))
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("member_count"))
    total = members.agg(F.count(F.lit(1))).scalar()
    rows = sizes.join(hubs, "community_id").join(near, "community_id", "left")
    return rows.select("community_id", "member_count", F.round(F.col("member_count") / total, 6).alias("size_share"), "hubs", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def community_of(members: DataFrame, node: str) -> DataFrame:
    """The members of a node's community, sorted."""
    own = F.broadcast(members.where(F.col("rel_path") == node).select("community_id"))
    return members.join(own, "community_id", "left_semi").orderBy("rel_path")


def export(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seven counters of a graph, one row."""
    count = lambda rows: rows.agg(F.count(F.lit(1)))
    pairs = edges.where(~F.col("is_external")).select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct()
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    return _one_row(
        edges.sparkSession, n_nodes=count(nodes), n_edges=count(edges), n_external=count(edges.where("is_external")), n_distinct_edges=count(pairs), n_communities=count(sizes),
        n_singletons=count(sizes.where("n = 1")), n_community_edges=count(community_edges(members, pairs)),
    )


def export_json(edges: DataFrame, members: DataFrame, cycle_rows: DataFrame | None = None) -> DataFrame:
    """A graph as lines of JSON in the order of ``part``: stats, nodes with community and marks for tests and cycles,
    distinct internal edges, edges between communities, cycles; lines, because a graph has no bound that one value could hold."""
    pairs = edges.where(~F.col("is_external")).select("src_path", "dst_path", "edge_type").distinct()
    between = community_edges(members, pairs.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct())
    looped = members.select("rel_path", F.lit(False).alias("in_cycle")) if cycle_rows is None else members.select("rel_path").join(cycle_rows.select("rel_path", F.lit(True).alias("hit")).distinct(), "rel_path", "left").select("rel_path", F.coalesce("hit", F.lit(False)).alias("in_cycle"))
    line = lambda rows, part, kind, *columns: rows.select(F.lit(part).alias("part"), F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)).alias("line"))
    nodes = members.join(looped, "rel_path").withColumn("is_test", paths.is_test_manifest(F.col("rel_path")))
    stats = export(edges, members, members.select("rel_path"))
    out = line(stats, 0, "stats", *stats.columns).unionByName(line(nodes, 1, "node", "rel_path", "community_id", "is_test", "in_cycle")).unionByName(line(pairs, 2, "edge", "src_path", "dst_path", "edge_type"))
    out = out.unionByName(line(between, 3, "community_edge", "c_src", "c_dst", "n_edges"))
    return out if cycle_rows is None else out.unionByName(line(cycle_rows, 4, "cycle", "cycle_no", "cycle_size", "rel_path"))


def overview(edges: DataFrame, nodes: DataFrame, shown: int = 30) -> DataFrame:
    """One row: the counts of ``summary``, the first entrypoints by path and the most central files."""
    starts = nodes.where(paths.is_entrypoint(F.col("rel_path"))).orderBy("rel_path").limit(shown)
    central = top_central(centrality(edges, nodes), shown)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), (-F.col("indegree")).alias("negin"), "rel_path")))
    return summary(edges, nodes).select("*", starts.agg(F.sort_array(F.collect_list("rel_path"))).scalar().alias("entrypoints"), central.agg(F.transform(listed, lambda x: x["rel_path"])).scalar().alias("top_files"))


def keyword_counts(rows: DataFrame, keywords: list[str]) -> DataFrame:
    """rel_path, n: whole-word occurrences of any keyword in the contents of a file, if there are some."""
    return rows.select("rel_path", F.regexp_count("content", F.lit(text.whole_words(keywords))).cast("long").alias("n")).groupBy("rel_path").agg(F.sum("n").alias("n")).where("n > 0")
