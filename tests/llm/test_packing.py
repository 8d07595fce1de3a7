import random
import zlib

import numpy as np
import public_tokenizers as P
from helpers import docs, odd_rows, prose
from tokenizers import Tokenizer

from strataquill.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def library_ids(t):
    tok = Tokenizer.from_file(PATH)
    return tok.encode(t or "", add_special_tokens=False).ids + [0]


def test_same_ids_as_the_library():
    words, rnd = K.WordIds(PATH, max_cached=50), random.Random(2)
    kinds = ["abcdefgh", "THE Ing", "'s 't'RE", " \n\t\xa0", "äÖüßÉñİſ", "²³¼½ªº", "0123", "!@#''", "\xad’€", "éΣ日́", "<|endoftext|>"]
    texts = ["".join(rnd.choice(rnd.choice(kinds[: 9 if k % 2 else 11])) for _ in range(rnd.randint(0, 50))) for k in range(600)]
    texts += ["end <|endoftext|> begin", "END <|ENDOFTEXT|> x", "<|startoftext|>"]
    assert [words.encode(t) for t in texts] == [words.whole(t) for t in texts]
    assert np.frombuffer(words.encode("end <|endoftext|> begin"), "<u4").tolist() == [806, 49407, 4947]
    assert len(words) <= 50


def test_every_piece_is_packed_once(spark):
    rows = odd_rows() + [(10_000 + k, prose(k, 50 + 40 * (k % 60)), "en") for k in range(300)]
    out = K.pack(K.pieces(docs(spark, rows), PATH), part=64).collect()
    sequences, seen = {}, []
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.append((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    want = []
    for i, t, _ in rows:
        ids = np.array(library_ids(t), "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(seen, key=str) == sorted(want, key=str)
    bound = K.lower_bound(np.bincount([r["length"] for r in out], minlength=2049), 2048)
    assert bound <= len(sequences) <= 1.05 * bound + 1


def test_bounds_never_exceed_what_is_needed():
    rnd = random.Random(3)
    for _ in range(60):
        # Cut full bins into parts: so many bins are enough.
        bins, sizes = rnd.randint(1, 12), []
        for _ in range(bins):
            cuts = sorted(rnd.sample(range(1, 60), rnd.randint(0, 4)))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 60])]
        counts = np.bincount(sizes, minlength=61)
        assert K.lower_bound(counts, 60) <= bins
        used = len(K.best_fit_decreasing(np.array(sizes), 60)[2])
        assert used >= K.lower_bound(counts, 60)
    assert K.lower_bound(np.bincount([31] * 7, minlength=61), 60) == 7
    assert K.lower_bound(np.bincount([21] * 9, minlength=61), 60) == 5


def test_empty(spark):
    assert K.pack(K.pieces(docs(spark, [(1, "a", "en")]).limit(0), PATH)).count() == 0


def least_bins(lengths, capacity):
    """Brute force: every item goes into every open bin that takes it, or into a new one."""
    best, lengths = len(lengths), sorted(lengths, reverse=True)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= lengths[k] and room not in rooms[:i]:
                place(k + 1, [*rooms[:i], room - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_bound_and_packing_around_the_least():
    rnd = random.Random(8)
    for _ in range(40):
        sizes = [rnd.randint(3, 30) for _ in range(9)]
        least = least_bins(sizes, 40)
        assert K.lower_bound(np.bincount(sizes, minlength=41), 40) <= least <= len(K.best_fit_decreasing(np.array(sizes), 40)[2]) <= least * 11 / 9 + 1


def test_rows_without_ids_are_spread_and_exchanged(spark):
    rnd = random.Random(9)
    items = spark.createDataFrame([(None, 0, 0, rnd.randint(300, 1500), 1) for _ in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = K.pack(items, part=50)
    used, bound = K.certificate(out)
    alone = K.pack(items, part=50, patience=0).where("offset = 0").count()
    assert out.count() == 600 and bound <= used <= alone
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
