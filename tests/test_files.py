import re

import pytest
from pyspark.sql import functions as F

from strataquill.functions import paths, text
from strataquill.operators import manifest, reports, retrieval
from strataquill.sources import snapshots, tree
from strataquill.streaming import events, source, state


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("path", "category", "language"),
    [
        ("src/tokenizer.py", "secret-risk", "python"), ("a/b.PNG", "asset", None), ("x/app.min.js", "generated", "javascript"), ("yarn.lock", "generated", None), ("db/migration_1.sql", "migration", "sql"),
        ("tests/a.py", "test", "python"), ("pkg/tests/a.py", "source", "python"), ("a/b.spec.ts", "test", "typescript"), ("docs/a.txt", "docs", None), ("README.md", "docs", "markdown"), ("Dockerfile", "infra", None),
        ("infra/x.tf", "infra", None), ("a.yaml", "config", "yaml"), ("CMakeLists.txt", "other", "cmake"), ("a.rs", "source", "rust"), ("LICENSE", "other", None), (".gitignore", "other", None),
    ],
)
def test_classification(spark, path, category, language):
    assert one(spark, paths.category(F.col("p")), p=path) == category
    assert one(spark, paths.language(F.col("p")), p=path) == language


def test_shebang(spark):
    assert [one(spark, paths.language(F.col("p"), F.col("f")), p="run", f=f) for f in ("#!/usr/bin/env python3", "#!/usr/bin/node", "#!/bin/sh", "echo")] == ["python", "javascript", "bash", None]


def test_paths(spark):
    assert one(spark, paths.collapsed(F.col("p")), p="a/./b/../../c/x") == "c/x"
    assert one(spark, paths.collapsed(F.col("p")), p="../a/..//b") == "../b"
    assert one(spark, paths.suffixes(F.col("p")), p="a/b/c.py") == ["a/b/c.py", "b/c.py", "c.py"]
    assert [one(spark, paths.is_ignored(F.col("p"), ["*.log", "tmp/**"]), p=p) for p in ("node_modules/a.js", "web/node_modules/a.js", "a/b.log", "tmp/x/y", "src/a.py")] == [True, False, True, True, False]
    assert [one(spark, paths.is_entrypoint(F.col("p")), p=p) for p in ("src/main.py", "a/routes/router_x.ts", "a/cmd/x.go", "a/x.py")] == [True, True, True, False]


def test_text(spark):
    assert one(spark, text.normalize_space(F.col("t")), t=" a\t\n b  c ") == "a b c"
    assert one(spark, text.query_terms(F.col("t")), t="The the a foo_bar Foo") == ["the", "foo_bar", "foo"]
    body = "".join(chr(97 + k % 26) for k in range(3000))
    parts = one(spark, text.sliding_chunks(F.col("t"), F.lit(1000)), t=body)
    assert parts[0] == body[:1000] and parts[1] == body[875:1875] and parts[-1].endswith(body[-10:]) and len(parts) == 4
    assert one(spark, text.sliding_chunks(F.col("t"), F.lit(1000)), t="x" * 1000) == ["x" * 1000]
    opens = lambda t, lang: one(spark, text.ends_open(F.col("t"), F.lit(lang)), t=t)
    assert opens("fn a() { if x {", "rust") and not opens("fn a() { }", "rust") and not opens("  ", "go")
    assert opens("def f():\n    x = 1", "python") and not opens("def f():\n    x = 1\ny = 2", "python")
    assert one(spark, text.excerpt(F.col("t"), F.lit(False)), t="y" * 2001) == "y" * 2000 + "..."
    assert one(spark, text.slug(F.col("t")), t="--- //") == "report"


def test_delta(spark):
    rows = lambda *r: spark.createDataFrame(r, "rel_path string, checksum string, size_bytes long")
    got = dict(map(tuple, manifest.delta(rows(("a", "1", 1), ("b", "2", 2), ("c", "3", 3)), rows(("a", "1", 1), ("b", "9", 2), ("gone", "0", 0))).collect()))
    assert got == {"a": "unchanged", "b": "changed", "c": "new"}


def chunk_table(spark, docs):
    return spark.createDataFrame([(p, "source", "python", 0, c, max(1, len(c) // 4)) for p, c in docs], "rel_path string, category string, language string, chunk_index long, content string, token_estimate long")


def scored(spark, docs, query):
    c = chunk_table(spark, docs)
    terms, stats = retrieval.chunk_terms(c), retrieval.corpus_stats(c)
    return {r["rel_path"]: r["bm25"] for r in retrieval.bm25(terms, retrieval.idf(retrieval.document_frequency(terms), stats), stats, query).collect()}


@pytest.mark.parametrize("name", ["document_frequency", "bm25_idf"])
def test_frequencies_are_counted_before_they_meet(spark, sf_dir, name):
    """Only terms are dealt out by key: no row for each chunk and term is."""
    from strataquill.plans import registry

    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) <= {"term"}


def test_frequencies(spark):
    """Chunks that agree in path, place and length have a term once together; all count as chunks."""
    rows = [("a.py", "one two two"), ("a.py", "two three three"), ("a.py", "two four"), ("b.py", "One\u00a0two"), ("c.py", "\u3000\u00a0\n"), ("d.py", None), ("e.py", "!"), ("b.png", "one")]
    files = spark.createDataFrame([(p, "asset" if p == "b.png" else "source", "python", c) for p, c in rows], "rel_path string, category string, language string, content string")
    got = dict(map(tuple, retrieval.frequencies(files).collect()))
    assert got == {"one": 2, "two": 3, "three": 1, "four": 1, None: 5}
    terms = retrieval.chunk_terms(retrieval.flat_chunks(files))
    assert dict(map(tuple, retrieval.document_frequency(terms).collect())) == {t: n for t, n in got.items() if t}
    once = files.dropDuplicates(["rel_path"]).where("rel_path <> 'a.py'")
    assert dict(map(tuple, retrieval.frequencies(once).collect())) == {"one": 1, "two": 1, None: 2}
    assert retrieval.frequencies(files.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 1499, 1500, 1501, 1313 * 15 + 1500, 1313 * 15 + 1501, 1313 * 16 + 1500, 100_000])
def test_slices_of_long_texts(spark, n):
    body = "".join("aé漢😀"[k * k % 4] + chr(97 + k // 26 % 26) for k in range(n))[:n]
    last = max(0, -(-(n - 1500) // 1313))
    assert one(spark, text.sliding_chunks(F.col("t"), F.lit(1500)), t=body) == [body[k * 1313 : k * 1313 + 1500] for k in range(last + 1)]


def test_bm25(spark):
    filler = [(f"z{k}.py", "other words here") for k in range(4)]
    got = scored(spark, [("a.py", "foo foo bar"), ("b.py", "foo baz"), *filler], ["foo"])
    assert got["a.py"] > got["b.py"] > 0
    assert scored(spark, [("a.py", "foo once"), ("b.py", "bar twice"), *filler], ["foo"]) == {}  # one chunk only
    got = scored(spark, [("foo_module.py", "foo bar"), ("some.py", "foo bar"), ("foo_empty.py", ""), ("foo_absent.py", "qux"), *filler], ["foo"])
    assert got["foo_module.py"] > got["some.py"] and "foo_empty.py" not in got and got["foo_absent.py"] > 0


def test_packing_skips_what_overflows(spark):
    rows = spark.createDataFrame([("a", 0, 60, 9.0), ("b", 0, 50, 8.0), ("c", 0, 40, 7.0), ("d", 0, 1, 1.0)], "rel_path string, chunk_index long, token_estimate long, score double")
    assert sorted(r["rel_path"] for r in retrieval.pack(rows, 100).collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        retrieval.terms_of("a ! ?")


def test_packing_folds_any_number_of_rows_in_blocks(spark, monkeypatch):
    # 600 rows that exceed the budget, then ties, a null, and small rows that fit.
    data = [(f"big{k:03d}", 0, 1000 + k, 900.0) for k in range(600)] + [(f"r{k * 7 % 50:02d}", k % 3, (k * 37) % 41 + 1, float(k % 5)) for k in range(50)] + [("null", 0, None, 3.0)]
    want, used = [], 0
    for path, chunk, t, _ in sorted(data, key=lambda r: (-r[3], r[0], r[1])):
        if t is not None and used + t <= 100:
            used += t
            want.append((path, chunk))
    rows = spark.createDataFrame(data, "rel_path string, chunk_index long, token_estimate long, score double").repartition(3)
    for block in (1, 2, 7, 4096):
        assert sorted((r["rel_path"], r["chunk_index"]) for r in retrieval.pack(rows, 100, block=block).collect()) == sorted(want)
    # No task gathers all rows.
    monkeypatch.setattr(retrieval.F, "collect_list", None)
    assert retrieval.pack(rows, 100).count() == len(want)
    assert retrieval.pack(rows.limit(0), 100).count() == 0


def test_tree(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.bin": b"a\0b", "node_modules/x.js": b"y", "c.log": b"z", "d/é.txt": "é".encode(), "e.txt": b"ab\xff"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["rel_path"]: r["content"] for r in tree.read_tree(spark, str(tmp_path), ["*.log"]).collect()}
    assert got == {"src/a.py": "x = 1\n", "d/é.txt": "é"}
    plain = {r["rel_path"]: (r["is_binary"], r["content"]) for r in tree.read_binary(spark, str(tmp_path)).collect()}
    assert plain["src/b.bin"][0] and plain["e.txt"] == (True, "ab") and plain["src/a.py"] == (False, "x = 1\n")
    assert tree.looks_binary(b"a" * 2047 + "é".encode()[:1])
    with pytest.raises(ValueError):
        tree.read_file(spark.createDataFrame([("a", "b")], "rel_path string, content string"), "../a")


def test_snapshot_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(r, "snapshot_id string, rel_path string, n long")
    assert not snapshots.built(spark, path, "s1")
    snapshots.insert_absent(rows(("s1", "a", 1), ("s1", "a", 2)), path, ["snapshot_id", "rel_path"], ["n"])
    snapshots.insert_absent(rows(("s1", "a", 3), ("s2", "b", 4)), path, ["snapshot_id", "rel_path"], ["n"])
    assert sorted(r["n"] for r in snapshots.read(spark, path).collect()) == [1, 4]
    snapshots.replace(rows(("s2", "c", 5)), path)
    assert sorted((r["rel_path"], r["n"]) for r in snapshots.read(spark, path).collect()) == [("a", 1), ("c", 5)]
    snapshots.drop(spark, path, ["s1"])
    spark.catalog.refreshByPath(path)
    assert [r["n"] for r in snapshots.read(spark, path).collect()] == [5] and snapshots.built(spark, path, "s2")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", "new", 1), (1, "a", "run", 2), (2, "b", "new", 3), (1, "a", "done", 4)]
    schema = "job long, step string, status string, seq long"
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).write.mode("append").parquet(f"{tmp_path}/log")
    out = events.run_available(events.stream_latest(events.stream(spark, f"{tmp_path}/log", schema), ["job", "step"], "status", "seq"), f"{tmp_path}/run")
    want = events.latest_state(spark.createDataFrame(rows, schema), ["job", "step"], "status", "seq")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) == [(1, "a", "done", 4, 3), (2, "b", "new", 3, 1)]


def test_reports(spark):
    assert one(spark, reports.missing_keys(F.col("j"), ["b", "a"]), j='{"b": 1}') == ["a"]
    assert one(spark, reports.sections_of(F.col("j")), j='{"version": 2, "sections": {"A": "x"}}') == {"A": "x"}
    assert one(spark, reports.sections_of(F.col("j")), j='{"version": 1, "sections_v2": {"B": "y"}}') == {"B": "y"}
    same = {one(spark, reports.canonical_hash(F.col("j")), j=j) for j in ('{"a": 1, "b": {"c": 2, "d": 3}}', '{"b": {"d": 3, "c": 2}, "a": 1}')}
    assert len(same) == 1
    cut = one(spark, reports.compressed(F.lit("A"), F.col("j")), j='{"purpose": "x", "domain": null, "other": 1, "tech_stack": "py"}')
    assert cut == '{"purpose":"x","tech_stack":"py"}'
    audit = one(spark, reports.audit_markdown(F.col("j")), j='{"overall_confidence": "low", "section_scores": {"B": "high", "A": "low"}, "weakest_sections": ["A"]}')
    assert audit == "## Confidence\n\nlow\n\n## Scores\n\n| section | score |\n|-|-|\n| A | low |\n| B | high |\n\n## Weak sections\n\nA"
    keys = reports.without_secrets(spark.createDataFrame([("p", "k"), ("q", None)], "id string, api_key string")).collect()
    assert [(r["id"], r["has_api_key"]) for r in keys] == [("p", True), ("q", False)] and "api_key" not in keys[0]
    shown = retrieval.rendered(spark.createDataFrame([("a", 0, 1.0, "x", False), ("b", 1, 2.0, "y" * 2500, False)], "rel_path string, chunk_index long, score double, content string, expanded boolean")).first()[0]
    assert shown.startswith("=== b #1 ===\nyyy") and shown.endswith("...\n\n=== a #0 ===\nx")
    assert one(spark, text.stable_id(F.col("a"), F.lit(None)), a="x") != one(spark, text.stable_id(F.col("a"), F.lit("")), a="x")


def test_state_of_ended_jobs_expires(spark, tmp_path):
    import datetime as d

    schema = "job_id string, key string, seq long, status string, at timestamp"
    at = lambda s: d.datetime(2024, 1, 1, tzinfo=d.timezone.utc) + d.timedelta(seconds=s)
    log, out = f"{tmp_path}/log", f"{tmp_path}/run"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        return events.run_available(state.stream_jobs(events.stream(spark, log, schema)), out, "update")

    def held():
        rows = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}/checkpoint")
        return sorted((r["key"]["job_id"], r["user_map_key"]["key"]) for r in rows.collect())

    with state.store(spark):
        rows = [("a", "A", 1, "running", at(0)), ("a", "A", 3, "done", at(5)), ("a", "A", 2, "late", at(4)), ("a", "job", 4, "done", at(6)), ("b", "A", 1, "running", at(6))]
        first = feed(rows)
        assert {tuple(r)[:-1] for r in first.collect()} == {("a", "A", "done", 3, 3, True), ("a", "job", "done", 4, 1, True), ("b", "A", "running", 1, 1, False)}
        more = [("b", "B", 2, "new", at(590)), ("a", "A", 5, "after", at(591))]
        told = state.latest_of(feed(more)).select("job_id", "key", "status", "seq", "n_events")
        want = events.latest_state(spark.createDataFrame(rows + more, schema), ["job_id", "key"], "status", "seq")
        assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
        assert held() == [("a", "A"), ("a", "job"), ("b", "A"), ("b", "B")]
        feed([("b", "A", 6, "on", at(700))])  # event time is 600 s past the end of a
        assert held() == [("b", "A"), ("b", "B")]
        last = {tuple(r)[:-1] for r in feed([("a", "A", 9, "again", at(710)), ("b", "A", 7, "done", at(711)), ("b", "job", 8, "failed", at(711))]).where("seq >= 7").collect()}
        assert last == {("a", "A", "again", 9, 1, False), ("b", "A", "done", 7, 3, True), ("b", "job", "failed", 8, 1, True)}  # a was forgotten and counts anew


def test_cancelled_jobs(spark):
    steps = spark.createDataFrame([("x", "s", 50.0, False, 1), ("y", "s", 100.0, False, 1), ("z", "s", 0.0, True, 1)], "job_id string, step string, percent double, failed boolean, seq long")
    got = {r["job_id"]: r["state"] for r in events.job_progress(steps, steps.select("job_id")).collect()}
    assert got == {"x": "cancelled", "y": "done", "z": "failed"}


def test_section_forms(spark):
    import json

    foot = {"evidence_files": ["a.py"], "blind_spots": ["x", "y"], "confidence": "high"}
    sections = {
        "A": {"repo_name": "r", "domain": "d", "runtime_type": "cli", "purpose": "p", "business_context": "b", "tech_stack": ["py", "go"], **foot},
        "G": {"entrypoint": {"file": "m.py", "reason": "starts"}, "other_important": [{"file": "o.py", "reason": "other"}], "confidence": "low"},
        "I": {"terms": [{"term": "T", "definition": "D", "evidence_files": ["e1", "e2", "e3"]}]},
        "J": {"summary": "S", "findings": [{"category": "c", "severity": "low", "title": "t"}, {"category": "k", "severity": "high", "title": "u", "rationale": "why", "evidence": ["e"]}]},
        "K": {"coverage_percentage": 62.5, "overall_confidence": "medium", "section_scores": {"B": "low", "A": "high"}, "notes": "n"},
        "B": {"main_layers": ["api", "db"], "style": "plain", "confidence": "low"},
        "C": {"error": "failed"},
    }
    rows = spark.createDataFrame([("r1", k, json.dumps(v)) for k, v in sections.items()], "id string, letter string, section string")
    heads = spark.createDataFrame([("r1", "repo", None, "m", "full", "2024"), ("r2", None, "main", "m", "full", "2024")], "id string, repo_name string, branch string, model_id string, scan_mode string, created_at string")
    got = {r["id"]: r["markdown"] for r in reports.full_markdown(heads, rows).collect()}
    text = got["r1"]
    assert text.startswith("# Analysis Report\n\n- **Report ID:** `r1`\n- **Repo:** repo\n- **Branch:** unknown\n") and "failed" not in text
    assert [x for x in text.split("\n") if x.startswith("## ")] == ["## A — Project Identity Card", "## B — (section)", "## G — Important Files Radar", "## I — Glossary / Domain Terms", "## J — Risk / Complexity / Unknowns", "## K — Confidence Auditor"]
    for part in ("**Tech stack:** `py`, `go`\n\n**Evidence files:** `a.py`\n\n**Blind spots:** x; y\n\n_Confidence: high_", "- **Entrypoint:** `m.py` — starts\n\n**Other important files:**\n  - `o.py` — other", "| **T** | D | `e1`, `e2` |",
                 "### HIGH severity (1)\n- **[k]** u\n  why\n  Evidence: `e`\n\n### LOW severity (1)\n- **[c]** t\n", "**Coverage (high/medium sections):** 62%\n**Overall confidence:** medium\n\n**Section scores:** A: high; B: low\n\nn", "**main_layers:** api, db\n**style:** plain\n\n_Confidence: low_"):
        assert part in text, (part, text)
    assert "No analysis section data" in got["r2"]


def test_contexts_of_sections(spark):
    services = '{"main_layers": ["api"], "main_services": [{"name": "s", "role": "r"}, {"name": "q"}]}'
    assert one(spark, reports.layer_context(F.col("j")), j=services) == "  Layers: api\n  Known services:\n    - s (r)\n    - q"
    assert one(spark, reports.pattern_context(F.col("j")), j='{"signals": [{"category": "c", "pattern": "p"}, {"description": "d"}, {}]}') == "c: p\nd"
    assert one(spark, reports.file_context(F.col("j")), j='{"backbone": {"file": "a", "reason": "x"}, "other_important": [{"file": "a", "reason": "y"}, {"file": "b", "reason": "z"}, {"file": "unknown", "reason": "w"}]}') == "- a (x)\n- b (z)"
    assert [x["order"] for x in one(spark, reports.onboarding_steps(F.col("j")), j='{"steps": [{"order": 2, "title": "b"}, {"order": 1, "title": "a"}]}')] == [1, 2]
    assert [x["term"] for x in one(spark, reports.glossary_terms(F.col("j"), " ABC "), j='{"terms": [{"term": "x", "definition": "has abc"}, {"term": "y"}]}')] == ["x"]


def test_report_store_and_passes(spark):
    stored = spark.createDataFrame([(1, "j", "w", 1), (2, "j", None, 2), (3, "k", None, 1)], "id long, job_id string, workspace_id string, created_at long")
    assert [r["id"] for r in reports.get(stored, 3).collect()] == [3] and [r["id"] for r in reports.get_by_job(stored, "j").collect()] == [2]
    assert [r["id"] for r in reports.without(stored, 2).orderBy("id").collect()] == [1, 3] and [r["id"] for r in reports.of_workspace(stored, None).orderBy("id").collect()] == [2, 3]
    side = lambda *rows: spark.createDataFrame(rows, "repo_id string, letter string, confidence string, content string, hash string")
    a, b = side(("r", "A", "low", "x", "1"), ("r", "B", "low", "y", "2")), side(("r", "A", "high", "x", "1"), ("r", "B", "high", "z", "3"))
    assert {r["letter"]: (r["changed"], r["improvement"]) for r in reports.compared(a, b).collect()} == {"A": (False, None), "B": (True, True)}
    with pytest.raises(ValueError):
        reports.compared(a, side(("other", "A", "low", "x", "1")))
    rows = spark.createDataFrame([("A", "low"), ("B", "high")], "letter string, confidence string")
    better = lambda s, weak: s.withColumn("confidence", F.when(F.col("letter").isin(*weak), "high").otherwise(F.col("confidence")))
    out, passes = reports.quality_passes(rows, lambda s: [], better)
    assert passes == 1 and {r["confidence"] for r in out.collect()} == {"high"}
    assert reports.quality_passes(rows, lambda s: ["B"], better)[1] == 3


def test_log_is_read_once_by_offsets_per_job(spark, tmp_path):
    log, out = f"file://{tmp_path}/log", f"{tmp_path}/run"

    def run():
        rows = events.run_available(source.stream(spark, log), out, "update")
        return sorted(tuple(r) for r in rows.drop("batch").collect())

    assert source.JobEventsReader(f"{tmp_path}/none").latestOffset() == {}
    source.append(log, "a", [{"seq": 1}, {"seq": 2}])
    source.append(log, "b", [{"seq": 1, "text": "é" * 40_000}])
    first = run()
    assert [(j, p) for j, p, _ in first] == [("a", 0), ("a", 11), ("b", 0)] and "é" not in first[2][2] and len(first[2][2]) > 200_000
    assert run() == first  # nothing new, nothing twice
    with open(f"{tmp_path}/log/a.jsonl", "a") as f:
        f.write('{"seq": 3}\n{"se')  # the last line isn't whole yet
    source.append(log, "c", [{"seq": 1}])
    second = run()
    assert len(second) == 5 and ("a", 22, '{"seq": 3}') in second and ("c", 0, '{"seq": 1}') in second
    with open(f"{tmp_path}/log/a.jsonl", "a") as f:
        f.write('q": 4}\n')
    assert sorted(set(run()) - set(second)) == [("a", 33, '{"seq": 4}')] and len(run()) == 6
    many = source.JobEventsReader(log)
    parts = many.partitions({}, {f"j{k:02d}": 5 << 20 for k in range(10)})
    assert [len(p.parts) for p in parts] == [3, 3, 3, 1] and many.partitions({"a": 5}, {"a": 5}) == []
