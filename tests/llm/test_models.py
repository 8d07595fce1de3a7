import math
import zlib

import numpy as np
import pytest
from helpers import docs, odd_rows, prose

from strataquill.llm import embeddings, langid
from strataquill.llm.components import components

LANGS = {
    "en": ("the", "and", "with", "house", "thing", "which", "there", "would", "water"),
    "de": ("der", "und", "nicht", "haus", "schön", "zwischen", "wasser", "über", "jetzt"),
    "fr": ("le", "et", "avec", "maison", "où", "être", "français", "eau", "jusque"),
}


def rows_of(n):
    return [(k, prose(k, 30 + k % 50, LANGS[lang]), lang) for k in range(n) for lang in (list(LANGS)[k % 3],)]


def letters(symbols):
    return "".join(chr(0x100 + x) for x in symbols.tolist())


def phrases(text, learned):
    """Brute force: each phrase as long as it is found in the learned symbols."""
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in learned:
            end += 1
        count, at = count + 1, end
    return count


def test_phrases_are_those_of_brute_force(monkeypatch):
    texts = {lang: " ".join(prose(k, 60, words) for k in range(3)) for lang, words in LANGS.items()}
    asked = [prose(77, 300, LANGS["de"]), prose(5, 9, LANGS["fr"]), "日本 zzz q", "a", "", texts["en"], texts["fr"][40:] + texts["de"][:500], "the " * 400]
    for block, mark in ((512, 32), (16, 4), (5, 5), (1, 1)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "MARK", mark)
        model = langid.Model(texts)
        coded = [model.alphabet.symbols(t) for t in asked]
        learned = [letters(model.alphabet.symbols(texts[x])) for x in model.langs]
        want = [[phrases(letters(c), x) for c in coded] for x in learned]
        assert model.phrases(coded).astype(int).tolist() == want
        for k, t in enumerate(asked):
            needed = [w[k] * b for w, b in zip(want, model.bits, strict=True)]
            assert model.predict([t])[0][0] == (model.langs[needed.index(min(needed))] if len(coded[k]) else "und")


def test_alphabets_have_no_bound():
    many = "".join(chr(0x4E00 + k) for k in range(3000))
    model = langid.Model({"zh": many + many[::3], "en": prose(1, 200, LANGS["en"])})
    assert model.alphabet.size > 3000
    assert [x for x, _ in model.predict([many[500:900], "the water there", "ж"])] == ["zh", "en", "en"]
    slots = sum(x.nbytes for s in model.steps for x in (s.keys, s.to, s.only, s.leads))
    assert slots < 600_000


def test_held_out_accuracy_and_odd_rows(spark):
    rows = rows_of(300) + [(1000 + i if i else None, t, None) for i, t, _ in odd_rows()]
    d = docs(spark, rows)
    texts = langid.sample(d)
    out = {r["doc_id"]: r for r in langid.predict(d, texts).collect()}
    unseen = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(out[k]["lang_pred"] == list(LANGS)[k % 3] for k in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    for i, t, _ in odd_rows():
        if i and (t is None or not any(c.isalpha() for c in t)):
            assert out[1000 + i]["lang_pred"] == "und"
    held = [r["doc_id"] for r in d.where(langid.held_out(d["doc_id"])).select("doc_id").collect()]
    assert sorted(held) == sorted(k for k, *_ in rows if k is not None and zlib.crc32(str(k).encode()) % 3 == 1)
    kept = langid.keep_known(d)
    assert kept.columns == d.columns and kept.count() == sum(r["lang_pred"] != "und" for r in langid.predict(d, texts).collect())


def test_every_symbol_of_the_sampled_rows_is_learned(spark):
    rows = [(k, prose(k, 400, LANGS["en"]), "en") for k in range(300)] + [(1000 + k, prose(k, 30_000 + k, LANGS["de"]), "de") for k in range(3)]
    texts = langid.sample(docs(spark, rows))
    own = {t for _, t, _ in rows}
    assert len(texts["en"].split("\n")) == langid.TRAIN_ROWS and all(t in own for t in texts["en"].split("\n"))
    learned = [t for k, t, lang in rows if lang == "de" and zlib.crc32(str(k).encode()) % 3 != 1]
    assert set(texts["de"].split("\n")) <= set(learned)
    assert sum(map(len, texts["de"].split("\n"))) <= langid.TRAIN_CHARS  # of rows of any length
    model = langid.Model({"en": texts["en"]})
    assert round(2 ** model.bits[0]) == len(model.alphabet.symbols(texts["en"])) + 1


def test_query_agrees_with_brute_force(spark):
    """Sampling, parsing and choice, spelled out over Python strings."""
    rows = rows_of(120) + [(500, "zz", None), (501, None, "en"), (502, "12", "de")]
    d = docs(spark, rows)
    texts = langid.sample(d)
    model = langid.Model(texts)
    learned = {x: letters(model.alphabet.symbols(texts[x])) for x in model.langs}
    for r in langid.predict(d, texts).collect():
        symbols = model.alphabet.symbols(next(t for i, t, _ in rows if i == r["doc_id"]) or "")
        symbols = letters(symbols)
        if not symbols:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        needed = sorted((phrases(symbols, learned[x]) * math.log2(len(learned[x]) + 1), x) for x in model.langs)
        assert r["lang_pred"] == needed[0][1] and math.isclose(r["score"], 1 - needed[0][0] / needed[1][0], abs_tol=1e-9)


def test_nothing_labelled(spark):
    d = docs(spark, [(1, "abc", None), (2, None, "en"), (3, "1 2", None)])
    assert [r["lang_pred"] for r in langid.predict(d, langid.sample(d)).collect()] == ["und"] * 3
    assert langid.predict(d.limit(0), langid.sample(d.limit(0))).count() == 0
    assert [r["doc_id"] for r in langid.keep_known(d).collect()] == [1]
    assert langid.keep_known(d.withColumnRenamed("kept", "language")).columns == [c if c != "kept" else "language" for c in d.columns]


def brute_links(rows, threshold):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links, root = [0] * n, list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(n):
        for j in range(i):
            (a, v, x), (b, w, y) = rows[i], rows[j]
            if None in (a, b, x, y) or x != y or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            p, q = (np.array(z) / max(map(abs, z)) for z in (v, w))
            if p @ q / math.sqrt(p @ p) / math.sqrt(q @ q) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (a, *_) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), 1 << 62))
    return [(a, links[i], least.get(find(i)), a is None or least[find(i)] == a) for i, (a, *_) in enumerate(rows)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(k, (base[k % 60] + rng.normal(scale=0.02 + 0.1 * (k % 3), size=16)).tolist(), k % 60 % 3) for k in range(600)]
    hot = rng.normal(size=16)
    rows += [(1000 + k, (hot + rng.normal(scale=0.1, size=16)).tolist(), 1) for k in range(200)]
    rows += [(2000 + k, [float(x) for x in range(16)], 2) for k in range(5)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, [float("nan")] * 16, 1), (3005, [float("inf")] * 16, 1), (3006, [1.0] * 16, None), (None, [1.0] * 16, 1), (3007, [1.0] * 8, 1), (3008, [2.0] * 8, 1), (3009, [1e200] * 8, 2), (3010, [3e-200] * 8, 2)]
    return rows


@pytest.mark.parametrize("block", [256, 16])
def test_embedding_links(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    d = spark.createDataFrame([(*r, 1.0, 7) for r in vectors], "vec_id long, embedding array<double>, label int, n double, cid long")
    got = {r["vec_id"]: tuple(r) for r in embeddings.near_duplicates(d).collect()}
    want = {r[0]: r for r in brute_links(vectors, 0.98)}
    found, true = sum(g[1] for g in got.values()), sum(w[1] for w in want.values())
    assert len(got) == len(want) and all(got[k][1] <= want[k][1] for k in want)
    assert found >= 0.97 * true  # recall of the index
    assert sum(got[k][2:] == want[k][2:] for k in want) >= 0.97 * len(want)
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def cone(n):
    """Vectors within a narrow cone, so that one pivot is apart, the second half near those of the first."""
    rng = np.random.default_rng(3)
    base = np.eye(32)[0] + rng.normal(scale=0.05, size=(n, 32))
    base[n // 2 :] = base[: n - n // 2] + rng.normal(scale=0.01, size=(n - n // 2, 32))
    return [(k, v.tolist(), k % 2) for k, v in enumerate(base)]


@pytest.mark.parametrize("rows", [cone(300), [(1, [1.0, 0.0], 1), (2, [0.99, 0.1], 1)], [(1, [1.0, 0.0], 1), (2, [0.99, 0.1], 1), (3, [0.0, 1.0], 1), (4, [0.1, 0.99], 1)]], ids=["cone", "two", "two_cones"])
def test_few_pivots_lose_no_links(spark, rows):
    want = sorted(brute_links(rows, 0.98))
    assert sum(w[1] for w in want)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(d).collect())) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(250, 2))] + [(1000 + k, 1001 + k) for k in range(200)] + [(5000, 5000 + k) for k in range(1, 300)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("held", [8, 100, 300, 1 << 17])
def test_components_in_rounds_and_in_tasks(spark, held):
    """In rounds of joins only where edges don't fit a task; the driver has few stages to keep track of where they do."""
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000 + 2 * k, 2001 + 2 * k) for k in range(100)]
    want = {k: 0 for k in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)} | {2001 + 2 * k: 2000 + 2 * k for k in range(100)}
    sc = spark.sparkContext
    sc.setJobGroup(f"components-{held}", "")
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7), held=held)
    n_jobs = len(sc.statusTracker().getJobIdsForGroup(f"components-{held}"))
    sc._jsc.clearJobGroup()
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert held < 1 << 17 or n_jobs <= 8
