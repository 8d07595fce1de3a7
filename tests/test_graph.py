import json
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataquill.operators import chains, communities, graph, parts
from strataquill.plans import registry


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "import", x) for a, b, x in rows], "src_path string, dst_path string, edge_type string, is_external boolean")


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "rel_path string")


def test_degree_counts_external_ends_and_repeats(spark):
    e = edges(spark, [("a", "b", False), ("a", "c", False), ("d", "b", False), ("d", "b", False), ("e", "b", True)])
    got = {r["rel_path"]: (r["indegree"], r["outdegree"], r["score"]) for r in graph.centrality(e, paths(spark, ["z"])).collect()}
    assert got["b"] == (4, 0, 12) and got["a"] == (0, 2, 2) and got["z"] == (0, 0, 0)
    assert [r["rel_path"] for r in graph.top_central(graph.centrality(e)).collect()] == ["b", "c", "a", "d", "e"]


def test_neighbourhood(spark):
    e = edges(spark, [("a", "b", False), ("a", "c", False), ("b", "d", False), ("c", "e", False), ("e", "f", False), ("a", "requests", True)])
    found = graph.neighbours(e, "a", 2)
    assert {r["rel_path"]: r["hop"] for r in found.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}
    assert ("e", "f") not in {(r[0], r[1]) for r in graph.neighbourhood_edges(e, found, 2).collect()}
    many = edges(spark, [("hub", f"n{k:03d}", False) for k in range(30)])
    assert graph.neighbours(many, "hub", 9, 1).count() == 10


def test_strongly_connected():
    pairs = lambda s: [tuple(x) for x in s.split()]
    assert graph.strongly_connected(pairs("ab ba")) == [["a", "b"]]
    assert graph.strongly_connected(pairs("ab bc cd")) == []
    assert graph.strongly_connected(pairs("ab bc ca aa")) == [["a", "b", "c"]]
    assert graph.strongly_connected(pairs("ab ba bc cd dc")) == [["a", "b"], ["c", "d"]]
    assert graph.strongly_connected([]) == []
    assert len(graph.strongly_connected([(f"{k:05d}", f"{(k + 1) % 5000:05d}") for k in range(5000)])[0]) == 5000


def test_cycles_per_snapshot(spark):
    rows = [("s1", "a", "b"), ("s1", "b", "a"), ("s2", "a", "b"), ("s2", "b", "c"), ("s2", "c", "a"), ("s2", "x", "a")]
    e = spark.createDataFrame(rows, "snapshot_id string, src_path string, dst_path string").withColumn("is_external", F.lit(False))
    got = sorted((r["snapshot_id"], r["rel_path"], r["cycle_size"]) for r in graph.cycles(e, "snapshot_id").collect())
    assert got == [("s1", "a", 2), ("s1", "b", 2), ("s2", "a", 3), ("s2", "b", 3), ("s2", "c", 3)]


def test_large_parts_are_solved_in_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(f"n{a:02d}", f"n{b:02d}") for a, b in rng.integers(0, 12, size=(14, 2))] + [("x", "y"), ("y", "x"), ("p", "q"), ("q", "r"), ("r", "p")]
    e = edges(spark, [(a, b, False) for a, b in rows])
    one, other = (sorted(map(tuple, graph.cycles(e, largest=n).collect())) for n in (10**6, 0))
    want = graph.strongly_connected(rows)
    assert one == other == sorted((k, len(g), n) for k, g in enumerate(want) for n in g)
    assert graph.colored(spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0


def test_long_cycles_take_few_rounds(spark, monkeypatch):
    rounds = []
    write, whole_cut = chains.Rounds.write, chains.cut
    monkeypatch.setattr(chains.Rounds, "write", lambda self, df: (rounds.append(1), write(self, df))[1])
    monkeypatch.setattr(chains, "cut", lambda df: (rounds.append(1), whole_cut(df))[1])
    n = 3000
    ring = [(f"r{k:05d}", f"r{(k + 1) % n:05d}") for k in range(n)]
    chords = [(f"r{k:05d}", f"r{k - 7:05d}") for k in range(100, 140, 3)]
    tails = [(f"r{k:05d}", f"t{k:05d}-0") for k in range(0, n, 500)] + [(f"t{k:05d}-{j}", f"t{k:05d}-{j + 1}") for k in range(0, n, 500) for j in range(9)] + [(f"h{j}", f"h{j + 1}") for j in range(9)] + [("h9", "r00000")]
    for pairs in (ring, ring + chords + tails):
        rounds.clear()
        got = graph.long_cycles(spark.createDataFrame(pairs, "src string, dst string"), largest=100).collect()
        assert sorted(r["node"] for r in got) == sorted(a for a, _ in ring) and {r["root"] for r in got} == {"r00000"}
        assert len(rounds) < 110


def test_long_cycles_of_random_graphs(spark):
    rnd = np.random.default_rng(9)
    pairs = []
    for g in range(40):  # many small graphs side by side
        n = int(rnd.integers(2, 12))
        pairs += [(f"{g:02d}-{a:02d}", f"{g:02d}-{b:02d}") for a, b in rnd.integers(0, n, (int(rnd.integers(1, 2 * n)), 2)) if a != b]
    want = sorted((n, g[0]) for g in graph.strongly_connected(pairs) for n in g)
    for largest in (10**6, 0):
        assert sorted(map(tuple, graph.long_cycles(spark.createDataFrame(pairs, "src string, dst string"), largest).collect())) == want


def test_communities_of_small_graphs(spark):
    triangles = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    rows, nodes = spark.createDataFrame(triangles, "src string, dst string"), paths(spark, ["a", "lonely"])
    whole = dict(map(tuple, graph.communities(rows, nodes).collect()))
    assert whole == {"a": 0, "b": 0, "c": 0, "lonely": 1, "x": 2, "y": 2, "z": 2}
    assert dict(map(tuple, graph.communities(rows.limit(0), nodes).collect())) == {"a": 0, "lonely": 1}
    star = spark.createDataFrame([("hub", f"n{k}") for k in range(40)] + [("hub", "hub")], "src string, dst string")
    assert {r["community_id"] for r in graph.communities(star, nodes.limit(0)).collect()} == {0}


def clustered(seed, groups, size, inner, outer):
    rnd = np.random.default_rng(seed)
    at = rnd.permutation(groups * size)
    pairs = [(f"n{at[g * size + a]:04d}", f"n{at[g * size + b]:04d}") for g in range(groups) for a, b in rnd.integers(0, size, (inner, 2))]
    return pairs + [(f"n{a:04d}", f"n{b:04d}") for a, b in rnd.integers(0, groups * size, (outer, 2))]


def better_moves(pairs, home):
    """Nodes that would raise the modularity by moving to a neighbour's community."""
    links, degree, load, total = {}, {}, {}, 0
    for a, b in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                links.setdefault(x, {}).setdefault(home[y], 0)
                links[x][home[y]] += 1
                degree[x] = degree.get(x, 0) + 1
                load[home[x]] = load.get(home[x], 0) + 1
                total += 1
    worth = lambda x, c: links[x].get(c, 0) - degree[x] * (load[c] - (degree[x] if home[x] == c else 0)) / total
    return [x for x in links if any(worth(x, c) > worth(x, home[x]) + 1e-6 for c in links[x])]


def test_communities_are_the_same_in_one_task_and_in_rounds(spark, monkeypatch):
    pairs = clustered(1, 4, 9, 30, 12)
    results = []
    for small, partitions in ((10**5, 1), (60, 3), (0, 5)):
        monkeypatch.setattr(communities, "SMALL", small)
        rows = spark.createDataFrame(pairs, "src string, dst string").repartition(partitions)
        results.append(sorted(map(tuple, communities.multilevel(rows).collect())))
    assert results[0] == results[1] == results[2]
    home = dict(results[0])
    assert better_moves(pairs, home) == [] and all(home[home[n]] == home[n] <= n for n in home)


def test_communities_find_planted_groups(spark):
    pairs = clustered(2, 12, 25, 200, 150)
    rows = spark.createDataFrame(pairs, "src string, dst string")
    labels = communities.multilevel(rows)
    home = dict(map(tuple, labels.collect()))
    assert len(set(home.values())) == 12 and better_moves(pairs, home) == []
    assert abs(communities.modularity(rows, labels) - modularity([(a, b, 1.0) for a, b in pairs if a != b], home)) < 1e-9


def test_export(spark):
    e = edges(spark, [("a", "b", False), ("b", "a", False), ("tests/t", "a", False), ("a", "os", True)])
    members = spark.createDataFrame([("a", 0), ("b", 0), ("tests/t", 1)], "rel_path string, community_id long")
    lines = [json.loads(r["line"]) for r in graph.export_json(e, members, graph.cycles(e)).orderBy("part", "line").collect()]
    assert lines[0]["kind"] == "stats" and lines[0]["n_edges"] == 4 and lines[0]["n_external"] == 1
    nodes = {x["rel_path"]: (x["is_test"], x["in_cycle"]) for x in lines if x["kind"] == "node"}
    assert nodes == {"a": (False, True), "b": (False, True), "tests/t": (True, False)}
    assert sum(x["kind"] == "edge" for x in lines) == 3 and sum(x["kind"] == "cycle" for x in lines) == 2
    assert [(x["c_src"], x["c_dst"], x["n_edges"]) for x in lines if x["kind"] == "community_edge"] == [(1, 0, 1)]


def modularity(edges, home):
    m = sum(w for *_, w in edges)
    degree, inner = {}, 0.0
    for a, b, w in edges:
        degree[home[a]] = degree.get(home[a], 0) + w
        degree[home[b]] = degree.get(home[b], 0) + w
        inner += w * (home[a] == home[b])
    return inner / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_absorption_and_summaries(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("s", "a"), ("s", "x"), ("s", "b"), ("x", "y")], "src string, dst string")
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("s", 1), ("x", 2), ("y", 2), ("t", 3)], "rel_path string, community_id long")
    got = dict(map(tuple, graph.absorb_singletons(members, pairs).collect()))
    assert got["s"] == 0 and got["t"] == 3
    first = graph.community_summaries(members, pairs).where("community_id = 0").first()
    assert first["hubs"] == ["b", "c", "a"] and first["member_count"] == 3 and first["neighbours"] == [1]


def test_import_resolution(spark):
    files = paths(spark, ["backend/domain/x/y.py", "web/store/a.ts", "web/view/index.tsx", "web/view/b.tsx", "z/y.py"])
    imports = spark.createDataFrame([("backend/m.py", "domain.x.y"), ("backend/m.py", "os"), ("backend/m.py", "y")], "src_path string, target string")
    assert {r["target"]: r["dst_path"] for r in graph.resolve_dotted(imports, files).collect()} == {"domain.x.y": "backend/domain/x/y.py", "os": None, "y": "backend/domain/x/y.py"}
    relative = spark.createDataFrame([("web/view/b.tsx", "../store/a"), ("web/view/b.tsx", "./index"), ("web/view/b.tsx", "../view"), ("web/view/b.tsx", "./none")], "src_path string, target string")
    assert {r["target"]: r["dst_path"] for r in graph.resolve_relative(relative, files).collect()} == {"../store/a": "web/store/a.ts", "./index": "web/view/index.tsx", "../view": "web/view/index.tsx", "./none": None}
    stored = edges(spark, [("backend/domain/x/y.py", "z.y", True), ("web/view/b.tsx", "../store/a", True), ("web/view/b.tsx", "./b", True), ("web/view/b.tsx", "web/store/a.ts", False), ("gone.py", "z.y", True)])
    assert {tuple(r) for r in graph.reresolve(stored, files).collect()} == {("backend/domain/x/y.py", "z/y.py"), ("web/view/b.tsx", "web/store/a.ts")}


def test_script_imports(spark):
    code = "import a from './a';\nimport {\n b } from \"../b\"\nimport './c'\nconst d = require('d');\n"
    got = graph.script_imports(spark.createDataFrame([("x.ts", code)], "rel_path string, content string")).orderBy("position").collect()
    assert [r["target"] for r in got] == ["./a", "../b", "./c", "d"]


def part_pairs(sf_dir):
    """Distinct internal edges of all rows of lineitem, by brute force."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = pd.read_parquet(f"{sf_dir}/lineitem.parquet").sort_values(["l_orderkey", *order])
    parts = [list(g) for _, g in rows.groupby("l_orderkey")["l_partkey"]]
    return sorted({(f"p{a}", f"p{b}") for g in parts for a, b in zip(g, g[1:], strict=False) if b % 11})


def test_part_cycles_are_those_of_all_rows(spark, sf_dir):
    pairs = part_pairs(sf_dir)
    names = sorted({x for p in pairs for x in p})
    at = {n: k for k, n in enumerate(names)}
    reach = np.eye(len(names), dtype=bool)
    for a, b in pairs:
        reach[at[a], at[b]] = True
    for k in range(len(names)):
        reach |= reach[:, k : k + 1] & reach[k]
    groups = {tuple(names[j] for j in np.flatnonzero(row)) for row in reach & reach.T}
    want = sorted((g for g in groups if len(g) > 1), key=lambda g: (-len(g), g))[:8]
    got = registry.QUERIES["circular_imports"](spark, sf_dir).orderBy("cycle_no").collect()
    assert [tuple(r["evidence"].split(",")) for r in got] == want


def test_part_communities_are_those_of_all_rows(spark, sf_dir):
    nodes = [f"p{k}" for k in pd.read_parquet(f"{sf_dir}/part.parquet")["p_partkey"]]
    got = dict(map(tuple, registry.QUERIES["louvain_communities"](spark, sf_dir).collect()))
    pairs = [(a, b, 1.0) for a, b in part_pairs(sf_dir)]
    assert set(got) == set(nodes) | {x for a, b, _ in pairs for x in (a, b)}
    assert better_moves([(a, b) for a, b, _ in pairs], got) == [] and modularity(pairs, got) > 0.128


def groups_of(pairs):
    up = {x: x for pair in pairs for x in pair}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_small_parts_are_not_trimmed_first(spark, monkeypatch):
    """Trimming passes all edges several times, and a part that one task may hold doesn't need it."""
    r = random.Random(3)
    rows = list({(f"{g}n{r.randrange(20)}", f"{g}n{r.randrange(20)}") for g in range(4) for _ in range(30)})
    monkeypatch.setattr(graph, "trimmed", None)
    edges = spark.createDataFrame([(a, b, "import", False) for a, b in rows], "src_path string, dst_path string, edge_type string, is_external boolean")
    got = {}
    for x in graph.cycles(edges).collect():
        got.setdefault(x["cycle_no"], []).append(x["rel_path"])
    assert [sorted(got[k]) for k in sorted(got)] == graph.strongly_connected(rows)
    pairs = [*rows, *((f"c{k:02d}", f"c{k + 1:02d}") for k in range(30)), ("q", "q")]
    assert dict(map(tuple, graph.connected(spark.createDataFrame(pairs, "src string, dst string")).collect())) == groups_of(pairs)


def test_communities_of_small_parts_need_no_joins_in_rounds(spark, monkeypatch):
    r = random.Random(1)
    rows = list({(f"g{g}n{r.randrange(20)}", f"g{g}n{r.randrange(20)}") for g in range(2) for _ in range(40)})
    pairs = spark.createDataFrame(rows, "src string, dst string")
    want = sorted(map(tuple, communities.multilevel(pairs).collect()))
    monkeypatch.setattr(communities, "SMALL", 100)
    monkeypatch.setattr(communities, "_wishes", None)
    assert sorted(map(tuple, communities.multilevel(pairs).collect())) == want


def test_small_parts_go_through_all_levels_in_one_task(spark, monkeypatch):
    """Each level and each stretch of rounds was a job of its own, and each round counted all edges anew."""
    writes, write = [], communities.Rounds.write
    monkeypatch.setattr(communities.Rounds, "write", lambda self, df: (writes.append(1), write(self, df))[1])
    pairs = clustered(3, 6, 20, 120, 60)
    rows = spark.createDataFrame(pairs, "src string, dst string")
    home = dict(map(tuple, communities.multilevel(rows).collect()))
    assert len(writes) == 2 and better_moves(pairs, home) == []
    ids = np.arange(120)
    rnd = np.random.default_rng(5)
    e = np.unique(np.sort(rnd.integers(0, 120, (900, 2)), axis=1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    node, other = np.concatenate([e, e[:, ::-1]]).T
    node, other = node[np.argsort(node, kind="stable")], other[np.argsort(node, kind="stable")]
    hashes = np.sort(rnd.integers(-(2**62), 2**62, 120))
    tabled = communities.levels_here(node, other, np.ones(len(node)), hashes, float(len(node)), 1.0)
    monkeypatch.setattr(communities._Links, "_tabled", lambda self, label: None)
    assert (communities.levels_here(node, other, np.ones(len(node)), hashes, float(len(node)), 1.0) == tabled).all()
    assert better_moves([(a, b) for a, b in zip(node, other, strict=True) if a < b], dict(zip(ids, tabled, strict=True))) == []


def test_names_with_the_same_number_are_told_apart(spark, monkeypatch):
    number, seeds = parts._number, []
    monkeypatch.setattr(parts, "_number", lambda c, seed: (seeds.append(seed), number(c, seed) % (2 if seed < 2 else 2**60))[1])
    rows, names = parts.numbered(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string"), communities.Rounds(spark))
    named = {r["id"]: r["name"] for r in names.collect()}
    assert set(seeds) == {0, 1, 2} and sorted((named[r["a"]], named[r["b"]]) for r in rows.collect()) == [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]


def test_components_of_numbered_nodes():
    """One search both ways from the busiest node finds most; chains longer than its steps go to the search by single nodes."""
    rnd = np.random.default_rng(8)
    for n, m in ((1, 0), (6, 9), (40, 60), (40, 200), (200, 230)):
        for _ in range(20):
            e = np.unique(rnd.integers(0, n, (m, 2)), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            got = {}
            for node, root in enumerate(graph.component_roots(e[:, 0], e[:, 1], n)):
                got.setdefault(int(root), []).append(node)
            got.pop(-1, None)
            want = graph.strongly_connected([(int(a), int(b)) for a, b in e])
            assert sorted(got.values()) == sorted(want) and all(k == min(v) for k, v in got.items())
    ring = np.arange(500)
    assert (graph.component_roots(ring, np.roll(ring, -1), 500) == 0).all()


def test_small_parts_share_tasks(spark):
    """Each part, of however few edges, was a group of its own for Python."""
    pairs = spark.range(300).selectExpr("id * 2 AS src", "id * 2 + 1 AS dst")
    pairs = pairs.unionByName(pairs.selectExpr("dst AS src", "src AS dst"))
    few, many = graph._by_size(pairs, 600)
    assert many is None and few.count() == 600 and few.select("key").distinct().count() <= 9
    assert {(r["node"], r["root"]) for r in graph.in_one_task(few, "key").collect()} == {(k, k // 2 * 2) for k in range(600)}
