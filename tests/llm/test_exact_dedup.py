import hashlib
import re

from helpers import docs, odd_rows, prose
from pyspark.sql import functions as F

from strataquill.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        rank = lambda m: (-len(m[1]), m[0] is None, m[0] or 0)
        best = min(map(rank, members))
        keep = next(m[0] for m in members if rank(m) == best)
        out += [(m[0], keep, len(members), rank(m) == best, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_dedup(spark):
    rows = odd_rows() + [(100 + k, " a b" if k == 50 else "ab", "en") for k in range(200)] + [(400 + k, prose(k % 5, 30), "en") for k in range(20)]
    assert sorted(map(tuple, exact_dedup.dedup(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert exact_dedup.dedup(docs(spark, [(1, "a", "en")]).limit(0)).count() == 0


def test_keep_first_keeps_all_columns(spark):
    d = docs(spark, [(1, "a b", "en"), (2, "a  b", "en"), (3, "c", None)])
    out = exact_dedup.keep_first(d)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3]


def test_texts_of_one_digest_are_told_apart_by_content(spark, monkeypatch):
    rows = odd_rows() + [(100 + k, f"text {k % 7}", "en") for k in range(50)]
    want = [x[:4] for x in brute(rows)]
    first = lambda norm: {"digest": F.encode(F.substring(norm, 1, 1), "utf-8"), "second": F.lit(0).cast("long"), "len": F.lit(0)}
    monkeypatch.setattr(exact_dedup, "_keys", first)
    assert sorted((tuple(r)[:4] for r in exact_dedup.dedup(docs(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_no_text_is_lost(spark):
    rows = [(7, "a", "en"), (7, "b", "en"), (3, "b", "fr"), (None, "unique", "en"), (9, "same", "en"), (9, "same", "en"), (9, "same", "fr"), (None, "null twice", "en"), (None, "null twice", "en"), (8, None, "en"), (None, "", "en")]
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.keep_first(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(7, "a"), (3, "b"), (None, "unique"), (9, "same"), (None, "null twice"), (8, None)], key=str)
    assert exact_dedup.keep_first(docs(spark, rows).limit(0)).count() == 0
