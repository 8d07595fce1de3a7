import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import docs, odd_rows, prose
from pyspark.sql import functions as F

from strataquill.llm import codes, queries, repeats, runs

WORDS = re.compile("[^\x20\x09-\x0d]+")


# --- codes


def test_nearest_entries_are_those_of_brute_force():
    rnd = np.random.default_rng(3)
    for width in (1, 2, 3, 5, 8, 16, 33):
        for spread in (2, 50, 4000, 1 << 23):
            v, e = rnd.integers(-spread, spread + 1, (200, width)), rnd.integers(-spread, spread + 1, (16, width))
            e[7], v[:16] = e[3], e  # ties and exact hits
            away = ((v[:, None, :] - e[None]) ** 2).sum(axis=2)
            index, error = codes.nearest(v, e)
            assert index.tolist() == away.argmin(axis=1).tolist() and error.tolist() == away.min(axis=1).tolist()
            big_index, big_error = codes.nearest(v.astype(object), e)
            assert big_index.tolist() == index.tolist() and big_error.tolist() == error.tolist()


def test_bounds_leave_few_entries():
    rnd = np.random.default_rng(4)
    e = rnd.integers(-4000, 4000, (16, 8))
    v = e[rnd.integers(0, 16, 500)] + rnd.integers(-50, 50, (500, 8))
    means, lengths, rest = codes._described(v, 4)
    m, _, r = codes._described(e, 4)
    bound = (lengths * (means[:, None] - m[None]) ** 2).sum(axis=2) + (rest[:, None] - r[None]) ** 2
    away = ((v[:, None, :] - e[None]) ** 2).sum(axis=2)
    assert (bound * (1 - 1e-9) - 1 <= away).all() and (bound <= away.min(axis=1)[:, None]).sum(axis=1).mean() < 1.5


def test_whole_numbers_round_down_at_every_size():
    v = np.array([[0.0, -0.0001, 1.00024, -1.5, 5e-324, 3e300]])
    assert codes.whole(v).tolist() == [[math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in v[0]]]
    assert codes.whole(v[:, :5]).dtype == np.int64
    for total in (0, -1, 5, -(1 << 31), 1 << 31, -(1 << 90) - 7, 10**60):
        assert sum(d << 32 * k for k, d in enumerate(codes._limbs(total))) == total


def _brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, vector) in any order."""
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = lambda x: int(x) * 4096 if abs(x) >= 2**53 else math.floor(4096 * x)
    length = len(kept[0][2])
    at = [length * k // parts for k in range(parts + 1)]
    cut = lambda v, p: tuple(map(whole, v[at[p] : at[p + 1]]))
    books = [[cut(v, p) for _, _, v in kept[:entries] if len(v) == length] for p in range(parts)]
    like = [r for r in kept if len(r[2]) == length]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, _, v in like:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(c) for c in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, lab, v in kept:
        if len(v) != length:
            out.append((i, lab, None, None))
            by_label[lab] += 0
            continue
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), error if error < 2**63 else None))
        by_label[lab] += error if error < 2**63 else 0
    has = {lab for _, lab, _, e in out if e is not None}
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, c, e, by_label[lab] if lab in has else None, hashlib.sha256(text.encode()).hexdigest()) for i, lab, c, e in out), key=str)


VECTORS = "vec_id long, label int, embedding array<double>, error string, entry long, n int"


@pytest.mark.parametrize("most_labels", [1 << 16, 1])
@pytest.mark.parametrize("dims,far", [(16, 1.0), (19, 1.0), (8, 1e200), (4, 1.0)])
def test_codes_equal_brute_force(spark, monkeypatch, dims, far, most_labels):
    monkeypatch.setattr(codes, "MOST_LABELS", most_labels)
    rnd = random.Random(dims)
    rows = [(i, rnd.choice([None, 1, 1, 2, 3]), [rnd.choice([rnd.gauss(0, 1), 0.5]) for _ in range(dims)]) for i in range(60)]
    rows += [(3, 1, rows[3][2]), (3, 1, [0.25] * dims), (None, 2, [1.0] * dims), (70, 2, None), (71, 2, [float("nan")] * dims), (72, 3, [None] * dims), (73, 1, [float("inf")] * dims)]
    rows += [(74, 9, [1.0] * (dims + 1)), (75, 4, []), (76, 4, [far] * dims), (-5, None, [-far / 3] + [0.1] * (dims - 1))]
    rnd.shuffle(rows)
    told = spark.createDataFrame([(i, lab, v, "x", 1, 2) for i, lab, v in rows], VECTORS)
    for partitions in (1, 7):
        found, _ = codes.compress(told.repartition(partitions), parts=4, entries=8, rounds=3)
        got = found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
        assert sorted(map(tuple, got), key=str) == _brute_codes(rows, 4, 8, 3)


def test_codes_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, 1, [0.1, 0.2], "x", 1, 2), (2, None, [0.3, -0.2], "x", 1, 2)], VECTORS)
    assert [r["error"] for r in codes.compress(few)[0].collect()] == [0, 0]
    none = codes.compress(few.where("vec_id > 5"))[0]
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


# --- runs


def _brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        n, some = rnd.randint(0, 80), "abcdefghijklmnopqrstuvwxyz"[: rnd.choice([1, 2, 3, 6, 26])]
        w = [rnd.choice(some) for _ in range(n)]
        if n and rnd.random() < 0.6:
            a, p = rnd.randrange(n), rnd.randint(1, 9)
            w = w[:a] + [w[min(n - 1, a + (i - a) % p)] for i in range(a, n)]
        for least in (2, 12):
            assert runs.runs_of(w, least) == _brute_runs(w, least)
    long = [str(i % 1700) for i in range(6000)] + ["x"] * 2000
    assert runs.runs_of(long) == [(0, 6000, 1700), (6000, 2000, 1)]


def test_run_queries_rows(spark):
    text = "so " + "a b c " * 5 + "end"
    rows = [*odd_rows(), (40, text, "en"), (40, text, "en"), (None, text, "en"), (41, "x " * 4000, "en")]
    got = runs.find_runs(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        w = WORDS.findall(t or "")
        found = _brute_runs(w) if len(w) < 5000 else runs.runs_of(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(w), [tuple(r) for r in found], " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(want, key=str)
    assert runs.find_runs(docs(spark, [])).count() == 0
    assert queries.planted(None, ["a"]) == ["a"] and queries.planted(3, []) == []


# --- repeats


def _brute_repeats(rows, window):
    starts = defaultdict(set)
    words = [WORDS.findall(t or "") for _, t, _ in rows]
    for (i, _, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            if i is not None:
                starts[tuple(w[k : k + window])].add(i)
    out = []
    for (i, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and min(starts[tuple(w[k : k + window])]) < i:
                gone |= set(range(k, k + window))
        spans = [[k, next(e for e in range(k, len(w) + 1) if e not in gone) - k] for k in sorted(gone) if k - 1 not in gone]
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), spans))
    return sorted(out, key=str)


def _mixed_rows(seed, n=60):
    rnd = random.Random(seed)
    passages = [prose(k, 40) for k in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(1000 + i, rnd.randint(0, 30), words=tuple(f"w{rnd.randint(0, 5000)}" for _ in range(50)))]
        parts += rnd.sample(passages, rnd.randint(0, 3)) + [" ".join(prose(k, 40).split()[5:20]) for k in rnd.sample(range(6), 1)]
        rnd.shuffle(parts)
        rows.append((i * 7 % n, rnd.choice([" ", "\n", "\t \x0b"]).join(parts), "en"))
    return rows


@pytest.mark.parametrize("window", [13, 12, 5, 2, 1])
def test_repeats_equal_brute_force(spark, window):
    rows = [*_mixed_rows(window), *odd_rows(), (None, prose(0, 40), "en"), (3, prose(1, 40) + " é", "fr"), (3, prose(1, 40) + " é", "fr"), (100, "日本 " * 30, "ja"), (101, "日本\n" * 14, "ja"), (102, "a" * 70_000, "en")]
    got = repeats.remove_repeats(docs(spark, rows), window).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], [[s["start"], s["length"]] for s in r["spans"]]) for r in got), key=str)
    assert found == _brute_repeats(rows, window)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    assert [r["n_removed"] for r in repeats.remove_repeats(docs(spark, [(1, None, "en"), (2, "", "en")])).collect()] == [0, 0]


def test_levels_go_on_until_nothing_survives(spark):
    def own(k, n):
        return " ".join(f"{k}-{i}" for i in range(n))

    rows = [(1, own("a", 110), "en"), (2, own("b", 9) + " " + own("a", 110), "en"), (3, own("a", 30), "en"), (4, own("c", 200), "en"), (5, own("a", 13), "en"), (6, own("a", 12), "en"), (6, own("c", 50) * 2, "en")]
    assert {r["doc_id"]: r["longest"] for r in repeats.longest(docs(spark, rows)).collect()} == {1: 104, 2: 104, 3: 26, 4: 26, 5: 13, 6: 26}


def test_window_hashes_are_sums_over_the_words():
    import pyarrow as pa

    words = repeats.Words(pa.array(["a b c d e f g h", "", "b c d\te f g h i", "x"], pa.string())[1:])
    assert words.n_words.tolist() == [0, 8, 1] and words.inside(3).tolist() == [True] * 6 + [False]
    again = repeats.Words(pa.array(["z a b c d e f g h"]))
    assert set(words.windows(7).tolist()) & set(again.windows(7).tolist()) == {again.windows(7).tolist()[2]}
    assert len(words.windows(20)) == 0 and repeats.lengths_to(13) == [7, 13] and repeats.lengths_to(1) == [1]


def test_queries_sums_are_those_of_all_rows(spark, sf_dir):
    found = queries.op11_vector_codes(spark, sf_dir)
    assert found.agg(F.sum("error")).first()[0] == found.select("label_error").distinct().agg(F.sum("label_error")).first()[0]
