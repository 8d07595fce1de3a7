import subprocess
import time

import pytest
from pyspark.sql import functions as F

from strataquill.engine import Engine
from strataquill.operators import reports
from strataquill.sources import git, snapshots
from strataquill.sources.locks import Held, Lease, Lost
from strataquill.sources.results import Results, fingerprint
from strataquill.sources.tree import folder_record, read_tree

FILES = {
    "src/app/main.py": "from app.store import Store\n\nclass MainService:\n    def __init__(self):\n        self.store = Store()\n\n    def run(self):\n        return self.store.load()\n",
    "src/app/store.py": "import os\n\nclass Store:\n    def load(self):\n        return os.getcwd()  # TODO retry, TODO log, FIXME\n",
    "src/web/a.ts": "import { b } from './b';\nexport function start() { return b(); }\n",
    "src/web/b.ts": "import { start } from './a';\nexport function b() { return start(); }\n",
    "docs/guide.md": "# Guide\n\nThe store loads things and the main service runs the store.\n",
    "node_modules/x.js": "ignored",
}


def test_build_and_ask(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(content)
    e = Engine(spark, f"file://{tmp_path}/tables")
    e.build("s1", str(tmp_path / "tree"))
    (tmp_path / "tree/docs/guide.md").write_text("# Changed\n")
    e.build("s2", str(tmp_path / "tree"))
    assert {r["rel_path"] for r in e.files("s1").collect()} == set(FILES) - {"node_modules/x.js"}
    assert {r["rel_path"]: r["change"] for r in e.changes("s2", "s1").where("change <> 'unchanged'").collect()} == {"docs/guide.md": "changed"}
    assert [r["name"] for r in e.search("s1", "Store").collect()][0] == "Store"
    assert {(r["src_path"], r["dst_path"]) for r in e.edges("s1").where(~F.col("is_external")).collect()} == {("src/app/main.py", "src/app/store.py"), ("src/web/a.ts", "src/web/b.ts"), ("src/web/b.ts", "src/web/a.ts")}
    assert {r["rel_path"] for r in e.cycles("s1").collect()} == {"src/web/a.ts", "src/web/b.ts"}
    assert e.table("symbol_edges", "s1").where("dst_symbol = 'src/app/store.py::Store.load'").count() == 1
    found = [r["rel_path"] for r in e.retrieve("s1", "store service").collect()]
    assert "docs/guide.md" in found and "src/app/store.py" in found
    one = e.bundle("s1", "store service").first()
    assert 0 < one["used_tokens"] <= one["budget_tokens"] == 14000 and one["used_tokens"] == sum(x["token_estimate"] for x in one["evidences"])
    assert {"docs/guide.md", "src/app/store.py"} <= {x["rel_path"] for x in one["evidences"]} and "2stage-bm25" in one["evidences"][0]["reason_codes"]
    assert set(e.prefetch("s1", {"glossary": "store", "conventions": "!"})) == {"glossary"}
    assert e.risks("s1").where("category = 'todo_hotspot'").count() == 1
    assert e.communities("s1").count() >= 1 and e.export_graph("s1").count() >= 7 and set(e.conventions("s1")) == {"suffixes", "folders", "styles", "layers"}
    assert e.tree("s1").where("is_dir").count() == 4 and e.estimate("s1").first()["estimated_tokens"] == 1200
    # Statistics that are missing are built alone, and searches do without them until then.
    snapshots.drop(spark, f"file://{tmp_path}/tables/terms", ["s1"])
    spark.catalog.refreshByPath(f"file://{tmp_path}/tables/terms")
    assert e.bundle("s1", "store service").first()["used_tokens"] > 0
    e.build("s1", str(tmp_path / "tree"), rebuild=False)
    spark.catalog.refreshByPath(f"file://{tmp_path}/tables/terms")
    assert not e.table("terms", "s1").isEmpty() and e.failures == {"s1/conventions": "the query has no terms"}
    with Lease(spark, f"file://{tmp_path}/tables/_locks/s1"), pytest.raises(Held):
        e.build("s1", str(tmp_path / "tree"))
    shared = e.context("s1")
    assert set(shared) == {"architecture", "tree", "documents", "manifests"} and shared["tree"].count() == e.tree("s1").count()
    assert shared["documents"].count() > 0 and shared["manifests"].columns == ["rel_path", "content"]
    # A section that is written again finds its static results and reads no table but the files' checksums.
    first = sorted(map(str, e.static("s1", "risks").collect()))
    read, whole = [], e.table
    e.table = lambda name, snapshot_id=None: (read.append(name), whole(name, snapshot_id))[1]
    history = spark.createDataFrame([], "id string, letter string, version long, section string, hash string")
    section, after = e.rerun("s1", "J", history, "r", lambda letter, context: {"content": str(context.count())})
    assert section["content"] == str(len(first)) and after.count() == 1 and set(read) == {"files"}
    e.table = whole
    assert sorted(map(str, e.static("s1", "risks").collect())) == first
    e.failures.clear()
    e.bundle("s1", "store", budget=100)
    assert not e.failures
    e.delete(["s2"])
    spark.catalog.refreshByPath(f"file://{tmp_path}/tables/files")
    assert e.table("files").select("snapshot_id").distinct().count() == 1


def test_tables_that_are_not_there(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/none")
    assert e.table("files", "s").columns[-2:] == ["mtime_ns", "snapshot_id"] and e.table("terms").count() == 0
    old = spark.createDataFrame([("a", "s")], "rel_path string, snapshot_id string")
    snapshots.replace(old, f"file://{tmp_path}/none/files")
    assert e.table("files", "s").select("rel_path", "mtime_ns").first() == ("a", None)
    config = spark.createDataFrame([("ssh_key", "/k"), ("consent", None)], "key string, value string")
    assert (snapshots.config_value(config, "ssh_key"), snapshots.config_value(config, "consent", "no"), snapshots.config_value(config, "x")) == ("/k", "no", None)
    known = spark.createDataFrame([("s", "r")], "id string, local_repo_id string")
    assert snapshots.belongs(known, "s", "r") and not snapshots.belongs(known, "s", "q")


def test_deep_trees_are_split_up(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"one/two/d{k}").mkdir(parents=True)
        (tmp_path / f"one/two/d{k}/f.txt").write_text("x")
    (tmp_path / "one/bin").write_bytes(b"\0" * 5000)
    found = read_tree(spark, str(tmp_path))
    assert found.count() == 30 and found.rdd.getNumPartitions() >= 30
    record = folder_record(str(tmp_path))
    assert record["is_folder"] and record["n_entries"] == 1 and not folder_record(f"{tmp_path}/no")["exists"]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    assert git.info(spark, str(tmp_path)).first()["is_git_repo"] is False
    run("init", "-b", "main")
    (tmp_path / "a").write_text("x")
    run("add", "a")
    run("commit", "-m", "one")
    run("branch", "other")
    r = git.info(spark, str(tmp_path)).first()
    assert r["branch"] == "main" and len(r["head"]) == 12 and r["is_dirty"] is False
    assert sorted(x["branch"] for x in git.branches(spark, str(tmp_path)).collect()) == ["main", "other"]


def test_section_versions(spark):
    h = spark.createDataFrame([("r", "A", 1, "{}", "x")], "id string, letter string, version long, section string, hash string")
    now = reports.current_sections(reports.patched(h, "r", "A", '{"b": 1, "a": 2}')).first()
    assert now["version"] == 2 and now["section"] == '{"b": 1, "a": 2}'
    assert reports.run_section("A", h)["confidence"] == "low"
    assert reports.run_section("A", h, lambda letter, c: {"confidence": "high"})["confidence"] == "high"
    assert "boom" in reports.run_section("A", h, lambda letter, c: 1 / 0 if letter == "B" else (_ for _ in ()).throw(ValueError("boom")))["error"]
    text = reports.identity_context(F.lit('{"tech_stack": ["a", "b"], "domain": "d"}'))
    assert spark.range(1).select(text).first()[0] == "  Tech stack: a, b\n  Domain: d"


def test_leases_of_two_drivers(spark, tmp_path):
    place = f"file://{tmp_path}/lock"
    a, b, c = (Lease(spark, place, seconds=2, beat=False) for _ in range(3))
    assert a.acquire() == 1
    with pytest.raises(Held):
        b.acquire()
    time.sleep(2.2)  # a is gone for longer than its lease
    assert b.acquire() == 2
    with pytest.raises(Lost):
        a.check()
    with pytest.raises(Lost):
        a.renew()
    a.release()  # frees nothing: the lock is b's
    with pytest.raises(Held):
        c.acquire()
    b.check()
    b.release()
    assert c.acquire() == 3
    c.release()
    with Lease(spark, place, seconds=1.5) as d:  # touched again and again
        time.sleep(3)
        d.check()
        with pytest.raises(Held):
            a.acquire()
    assert d.token is None and a.acquire() == 5


def test_results_are_kept_by_their_inputs(spark, tmp_path):
    kept, made = Results(spark, f"file://{tmp_path}/results"), []
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, checksum string")
    first, other = fingerprint(files), fingerprint(files.orderBy(F.desc("rel_path")))
    changed = fingerprint(spark.createDataFrame([("a", "2"), ("b", "1")], "rel_path string, checksum string"))
    assert first == other != changed

    def make():
        made.append(1)
        return spark.range(len(made)).select("id")

    for inputs, settings, n in ((first, {"x": 1}, 1), (first, {"x": 1}, 1), (changed, {"x": 1}, 2), (changed, {"x": 2}, 3), (first, {"x": 1}, 4)):
        assert kept.get("r", "s1", inputs, settings, make).count() == n
    assert len(made) == 4 and kept.get("r", "s2", first, {"x": 1}, make).count() == 5
    kept.drop(["s1"])
    assert kept.get("r", "s1", first, {"x": 1}, make).count() == 6 and kept.get("r", "s2", first, {"x": 1}, make).count() == 5
