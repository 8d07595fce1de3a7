import re

import corpus_pipeline
from helpers import docs, prose


def test_stages(spark, sf_dir, tmp_path):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(k, prose(k, 120), "en") for k in range(12)]
    rows += [(20, prose(1, 120).replace(" ", "  "), "en"), (21, prose(2, 120) + " more", "en"), (22, None, "en"), (23, "12 34 !!", None), (24, f'{prose(50, 40)} token = "{key}"', "en"), (25, "", "en")]
    now, kept = docs(spark, rows), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted({r["doc_id"] for r in now.select("doc_id").collect()}))
    everything = sorted(i for i, *_ in rows)
    assert kept[0] == [i for i in everything if i not in (22, 23, 25)]
    assert kept[1] == [i for i in kept[0] if i != 1]  # 20 is longer
    assert kept[2] == [i for i in kept[1] if i != 21]
    assert kept[3] == kept[2] == kept[4]
    masked = [r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect() if r["doc_id"] == 24]
    assert masked and key not in masked[0]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() >= 100 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def brute_stages(rows):
    """Rows (id, text, lang) that the first three stages keep, spelled out; ids sort with nulls last."""
    age = lambda r: (r[0] is None, r[0] or 0)
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), *age(r))) for g in groups.values()]
    sets = []
    for r in rows:
        w = r[1].lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    return {min((r for k, r in enumerate(rows) if root[k] == x), key=age)[:2] for x in set(root)}


def test_null_and_repeated_ids_ties_and_clashing_columns(spark, sf_dir, tmp_path):
    a, b, c = (prose(k, 70) for k in (61, 62, 63))
    rows = [(7, a, "en"), (7, b, "en"), (3, b.replace(" ", "  "), "en"), (None, c, "en"), (None, c, "en"), (None, "alone it is", None), (9, a + " end", "en"), (9, a + " end", "en"), (5, None, "en"), (None, None, None), (6, "", "en"), (None, " 12 ", "en")]
    rows += [(100 + k, prose(70 + k, 20_000), "de") for k in range(2)]
    now = docs(spark, rows)
    for name, other in (("kept", "row"), ("h", "key"), ("label", "found"), ("cid", "language"), ("digest", "rank")):
        now = now.withColumnRenamed(name, other)
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, now, sf_dir)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 2:
            assert sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str) == sorted(brute_stages(rows), key=str)
    packed = corpus_pipeline.STAGES[4][1](spark, now, sf_dir)
    assert packed.where("piece = 0").count() == now.count()


def test_empty_table(spark, sf_dir, tmp_path):
    now = docs(spark, [(1, "a", "en")]).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.count() == 0
