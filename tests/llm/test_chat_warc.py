import hashlib
import io

import pytest
from pyspark.sql import functions as F

from strataquill.llm import chat, warc

ODD = ["", "hi", "a\\", "\\\\", "<turn>", "</turn>", "<then>x<says>", "<\\turn>", "\\<turn>", "<<turn>>", "\\### Assistant: </turn> ok", "é\n日🙂", "\n", "\ufeffmark", "x" * 50_000]


def conversation_rows():
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(ODD)]
    rows += [(2, i, "assistant" if i > 1 else "user", t) for i, t in enumerate(ODD)]
    rows += [(3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, None, "<turn>odd\n", None), (3, 7, None, "x"), (None, 0, "user", "q"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    rows += [(5, 1, "user", "<turn>"), (5, 1, "user", "<s"), (5, 1, "<turn>", "a"), (5, 1, "<s", "b")]  # raw order, not that of escaped texts
    return rows


def test_turns_and_loss_are_read_back(spark):
    rows = conversation_rows()
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, blocks string")
    out = chat.format_chats(d)
    got = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    for r in got:
        own = sorted(((x[1] is not None, x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(t["role"], t["text"]) for t in r["t"]] == [(role, text) for *_, role, text in own]
        assert r["loss"] == [text for *_, role, text in own if role == "assistant"]
    assert len(got) == 6 and chat.format_chats(d.limit(0)).count() == 0


def test_adjacent_turns_are_merged(spark):
    d = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(d).first()
    assert r["formatted"] == "<turn>user<says>a<then>b</turn>\n<turn>assistant<says>c</turn>" and r["n_blocks"] == 2


def test_archives(spark, tmp_path):
    long = "é" * 300_000
    rows = [(5, "u", "z" * 100), (3, "v\r\nX: y", "z" * 100), (9, None, None), (8, "u", ""), (7, "s", "z" * 99), (6, "s", "z" * 99), (2, "l", long), (11, "l", long), (None, "n", "z" * 100), (12, "e", "\r\n\r\nWARC/1.1\r\n")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to long")
    got = {r["page_id"]: r for r in warc.round_trip(d.repartition(3), f"file://{tmp_path}/w").collect()}
    firsts = {"z" * 100: 3, long: 2}
    for i, url, html in rows:
        payload = (html or "").encode()
        first = firsts.get(html)
        revisit = first is not None and first != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
        assert r["content"] == ("" if revisit else html or "")
    assert "\n" not in got[3]["url"] and len(got) == len(rows)
    assert warc.round_trip(d.limit(0), f"file://{tmp_path}/none").count() == 0


def test_broken_archives():
    one = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "2020-01-01T00:00:00Z")
    assert [(p, n) for _, p, n in warc.read_archive(io.BytesIO(one + one))] == [(b"payload", 7)] * 2
    for cut in (1, 5, len(one) - 20, len(one) - 1):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(one + one[:cut])))
    bad = warc.record(1, "u", b"payload", "0" * 64, None, False, "2020-01-01T00:00:00Z")
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(bad)))
    again = warc.record(2, "", b"payload", hashlib.sha256(b"payload").hexdigest(), 1, True, "2020-01-01T00:00:00Z")
    ((head, payload, size),) = warc.read_archive(io.BytesIO(again))
    assert (payload, size, head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Refers-To"]) == (b"", 7, "revisit", "about:blank", warc.record_id(1))


def test_pages_without_ids(spark, tmp_path):
    d = spark.createDataFrame([(None, "u", "z" * 200)] * 3, "page_id long, url string, html string")
    got = warc.round_trip(d, f"file://{tmp_path}/n").collect()
    assert [(r["page_id"], r["record_type"], r["payload_bytes"]) for r in got] == [(None, "response", 200)] * 3
