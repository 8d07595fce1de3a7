import random

import numpy as np
import pytest
from helpers import docs, odd_rows, prose

from strataquill.llm import ngram_join as N


def words_of(t):
    low = "".join(c.lower() if c < "\x80" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), 1 << 62))
    return sorted(((r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)), key=str)


def edited(text, rnd, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = odd_rows()
    passage = prose(900, 60)
    base, long = prose(7, 150), prose(8, 900)
    out += [(1000 + k, edited(base, rnd, k % 8), "en") for k in range(90)]  # one family around the threshold
    out += [(2000 + k, edited(long, rnd, 2 * k), "en") for k in range(12)]
    out += [(3000 + k, prose(100 + k, 60) + " " + passage + " " + prose(500 + k, 60), "en") for k in range(60)]  # a shared passage
    out += [(4000 + k, "same words in a small text here", "en") for k in range(40)]
    out += [(5000 + k, prose(3000 + k // 2, 40) + (" end" if k % 2 else ""), "en") for k in range(40)]
    out += [(6000, "One two  THREE", "en"), (6001, "one\ttwo three", "en"), (6002, "one two three four", "en")]
    return out


def test_same_components_as_brute_force(spark, rows):
    assert sorted(map(tuple, N.join(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_blocks_and_long_lists(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SHORT", 3)
    monkeypatch.setattr(N, "MOST_HOT", 10)
    assert sorted(map(tuple, N.join(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_forest_of_links():
    rnd = random.Random(1)
    base = np.unique(np.array([rnd.getrandbits(60) for _ in range(100)], np.uint64))
    sets = [np.unique(np.r_[base[k:], np.arange(1000 * k, 1000 * k + k, dtype=np.uint64)]) for k in range(0, 40, 3)]
    edges = N.linked_forest(list(range(len(sets))), sets)
    root = list(range(len(sets)))
    for a, b in edges:
        root[a] = b
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want = [want[j] if w == want[i] else w for w in want]
    assert [root[i] == root[j] for i in range(len(sets)) for j in range(i)] == [want[i] == want[j] for i in range(len(sets)) for j in range(i)]


def test_empty_and_keep_one(spark):
    assert N.join(docs(spark, [(1, "a", "en")]).limit(0)).count() == 0
    d = docs(spark, [(3, prose(1, 50), "en"), (2, prose(1, 50) + " x", "en"), (4, None, "en"), (None, "z", "en")])
    out = N.keep_one(d)
    assert out.columns == d.columns and sorted((r["doc_id"] for r in out.collect()), key=str) == [2, 4, None]
    assert N.keep_one(d.limit(0)).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    a, b, c, e = (prose(k, 50) for k in (11, 12, 13, 14))
    rows = [(7, a, "en"), (7, b, "en"), (3, b + " x", "fr"), (None, c, "en"), (None, c + " y", "en"), (9, e, "en"), (9, e, "en"), (None, None, "en"), (None, "", "en"), (5, "", "en")]
    kept = sorted(((r["doc_id"], r["text"]) for r in N.keep_one(docs(spark, rows)).collect()), key=str)
    assert [x for x in kept if x[1] in (c, c + " y")] in ([(None, c)], [(None, c + " y")])
    assert [x for x in kept if x[1] not in (c, c + " y")] == sorted([(7, a), (3, b + " x"), (9, e), (None, None), (None, ""), (5, "")], key=str)
