import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import docs, odd_rows

from strataquill.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts(n=400):
    rnd = random.Random(4)
    kinds = ["abcdefghij", "the ing er'sre", " \n\t\x85 ", "äöüßéñ", "日本語中文", "🙂🎉👩‍🚀", "0123456789", "!@#-_'s't", "\x00\x1c\x7f", "ΣΑς́"]
    return ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 80))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, " " * 4000, "\n" * 300 + "x", "é" * 2000]


def test_same_ids_as_the_library(library):
    transducer, split, table = bpe.tokenizer(PATH, P.PATTERN)
    for t in texts():
        ids = transducer.encode(split.findall(t))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        for chunk in (4, 12, 4096):
            assert "".join(bpe.decode_stream((ids[i : i + chunk] for i in range(0, len(ids), chunk)), table)) == t


def test_bounded_memory(library):
    small = bpe.Transducer(bpe.load_ranks(PATH), max_states=50, max_cached=20, max_known=100)
    split = bpe.splitter(P.PATTERN)
    for t in texts(60):
        assert np.frombuffer(small.encode(split.findall(t)), "<u4").tolist() == library.encode_ordinary(t)
        assert len(small.sets) <= 50 + small.window and len(small.moves) <= 200 + small.window
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))  # one match
    bounded = bpe.Transducer(bpe.load_ranks(PATH), max_states=5_000)
    assert np.frombuffer(bounded.encode([long]), "<u4").tolist() == library.encode_ordinary(long)
    assert len(bounded.sets) <= 5_000 + bounded.window


def test_unfinished_characters_are_held_back():
    stream = bpe.Utf8Stream()
    data = "aé日🙂".encode()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.feed(b"", last=True) == "aé日🙂"
    assert stream.feed(b"\xf0\x9f") == "" and stream.feed(b"", last=True) == "�"
    assert stream.feed(b"\xffa\xc0") == "�a�"


def test_state_machine_reads_any_bytes():
    rnd = random.Random(7)
    some = [bytes(rnd.choice(b"a\x80\xbf\xc2\xe0\xa0\xed\x9f\xf0\x90\xf4\x8f\xff\xc0\xe2\x82\xac") for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    for data in some:
        for size in (1, 2, 5):
            plain, kept = bpe.Utf8Stream(), bpe.Utf8Stream(escape=True)
            parts = [data[i : i + size] for i in range(0, len(data), size)]
            assert "".join(map(plain.feed, parts)) + plain.feed(b"", last=True) == data.decode("utf-8", "replace")
            text = "".join(map(kept.feed, parts)) + kept.feed(b"", last=True)
            assert text == data.decode("utf-8", "surrogateescape") and text.encode("utf-8", "surrogateescape") == data


def test_query(spark, library):
    rows = odd_rows()
    out = bpe.round_trip(docs(spark, rows), PATH, P.PATTERN).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.encode(docs(spark, rows).limit(0), PATH, P.PATTERN).count() == 0
