"""Removal of passages that stand in several documents, found by windows of words at lengths that double.

A window of ``window`` words can only stand in two documents if every shorter window inside it does. So windows are looked
at level by level: those of half the length first (seven words for 13), and only what is repeated at one length is extended
to twice that length (or to ``window``). A level ends the search if nothing of it survives. :func:`longest` goes on doubling
past ``window`` until no candidates survive.

At the first level a document sends, for each window of the next length, only the smallest of the hashes of the short windows
inside it: equal windows have the same smallest one, so nothing is lost, and neighbours mostly share theirs, so about a
quarter of all places is sent. At each level hashes meet in a partially aggregated group-by that tells the smallest and the
largest id; hashes with one id go. The others are joined back to the rows that sent them, in a plain sort-merge join whose
hot hashes AQE splits, and gathered by document (a document's own windows, no more). Rows of hashes are written as tables
that are read twice and then deleted, so a text is taken apart once at each level, ``PIECE`` bytes at a time.

Windows are equal if their 64-bit hashes are (polynomials of mixed word hashes). Texts are taken apart as bytes with numpy.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; of rows with equal ids none is
smaller, so they don't take words from each other; a null id is neither smaller nor larger than others: such rows neither
lose words nor take them; rows equal in id and text get the same result; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.session import Rounds, cut, release, remove

WINDOW = 13
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of a column of texts without nulls: bytes, ends, hashes and whose they are."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.n_texts = len(texts)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        held = ~_SPACE[self.data]
        # A word begins and ends at white space and at the ends of its text.
        edge = np.zeros(len(self.data) + 1, bool)
        edge[at] = True
        before = np.concatenate([[False], held[:-1]]) if len(held) else held
        after = np.concatenate([held[1:], [False]]) if len(held) else held
        self.starts = np.flatnonzero(held & (~before | edge[:-1]))
        self.ends = np.flatnonzero(held & (~after | edge[1:])) + 1
        self.text = np.searchsorted(at, self.starts, side="right") - 1
        lengths = self.ends - self.starts
        firsts = np.cumsum(lengths) - lengths
        self.held = np.flatnonzero(held)
        place = np.arange(len(self.held)) - np.repeat(firsts, lengths)
        signs = _BYTE[self.data[self.held]] * _powers(int(lengths.max(initial=0)))[place]
        self.hashes = _mixed(np.add.reduceat(signs, firsts)) if len(firsts) else np.zeros(0, np.uint64)
        self.n_words = np.bincount(self.text, minlength=self.n_texts)

    def windows(self, length: int) -> np.ndarray:
        """A hash for each ``length`` words in a row, by doubling; those across two texts are there too."""
        out, done, block, size = np.zeros(max(0, len(self.hashes) - length + 1), np.uint64), 0, self.hashes, 1
        while True:
            if length & size:
                out = out + block[done : done + len(out)] * np.uint64(pow(_BASE, done, 1 << 64))
                done += size
            if size * 2 > length:
                return _mixed(out)
            block = block[:-size] + block[size:] * np.uint64(pow(_BASE, size, 1 << 64))
            size *= 2

    def inside(self, length: int) -> np.ndarray:
        """Whether the window that begins at a word ends in the same text."""
        n = max(0, len(self.text) - length + 1)
        return self.text[:n] == self.text[length - 1 : length - 1 + n]

    def smallest(self, length: int, longer: int) -> np.ndarray:
        """For each window of ``longer`` words the smallest hash of the windows of ``length`` words in it."""
        out, have, n = self.windows(length), 1, longer - length + 1
        while have < n:
            step = min(have, n - have)
            out = np.minimum(out[: max(0, len(out) - step)], out[step:])
            have += step
        return out


PIECE = 1 << 20  # bytes of text; numpy's arrays take about fifty times as much


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows of about ``PIECE`` bytes of text at a time, and their words; a text is never split."""
    for b in batches:
        ends, a = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, side="right")))
            piece = b.slice(a, z - a)
            yield piece, Words(piece.column("text"))
            a = z


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and key: what tells rows of one id apart, a hash of the text; zero where all ids differ."""
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"))
    repeated = not ids.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.select("doc_id", F.when(F.lit(repeated) | F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("key"), "text")


_SENT = "doc_id long, key long, h long"


def _sent(b: pa.RecordBatch, text: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """A row for each hash of a text, however often it is there."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    whose = pa.array(text[new])
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(whose), b.column("key").take(whose), pa.array(hashes[new].view(np.int64))], ["doc_id", "key", "h"])


def _first_level(docs: DataFrame, length: int, longer: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _pieces(batches):
            inside = words.inside(longer)
            yield _sent(b, words.text[: len(inside)][inside], words.smallest(length, longer)[inside])

    return docs.where("doc_id is not null").mapInArrow(run, _SENT)


def _among(words: Words, hashes: np.ndarray, found: pa.Array) -> np.ndarray:
    """Which of ``hashes`` (by first word) are in their text's list ``found``."""
    out = np.zeros(len(hashes), bool)
    lists, at = found.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(found.value_lengths().fill_null(0)))])
    ends = np.cumsum(words.n_words)
    for k in np.flatnonzero(np.diff(at)).tolist():
        a, z = ends[k] - words.n_words[k], min(ends[k], len(hashes))
        out[a:z] = np.isin(hashes[a:z], lists[at[k] : at[k + 1]])
    return out


def _next_level(docs: DataFrame, length: int, longer: int, first: int) -> DataFrame:
    """The windows of ``longer`` words in ``docs`` (with ``found``) that can be repeated by what is repeated at ``length``:
    by their smallest hash after the first level, by the windows at their ends after others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _pieces(batches):
            inside = words.inside(longer)
            if length == first:
                yes = _among(words, words.smallest(length, longer), b.column("found"))
            else:
                short = _among(words, words.windows(length), b.column("found"))
                yes = short[: len(inside)] & short[longer - length : longer - length + len(inside)]
            yes = yes & inside
            yield _sent(b, words.text[: len(inside)][yes], words.windows(longer)[yes])

    return docs.mapInArrow(run, _SENT)


def _gathered(sent: DataFrame, later_only: bool = False) -> DataFrame:
    """doc_id, key and found: the hashes of each document that other documents have too; with ``later_only``, those that
    a document with a smaller id has."""
    several = sent.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "least")
    back = sent.join(several, "h")
    if later_only:
        back = back.where("doc_id > least")
    return back.groupBy("doc_id", "key").agg(F.collect_set("h").alias("found"))


def lengths_to(window: int) -> list[int]:
    """The lengths of the levels: half of ``window`` (rounded up), then ``window``."""
    return [(window + 1) // 2, window] if window > 1 else [1]


def _repeated(docs: DataFrame, window: int, later_only: bool) -> DataFrame:
    first, *more = lengths_to(window)
    tables = Rounds(docs.sparkSession)
    sent = tables.write(_first_level(docs, first, (more or [first])[0]))
    found = cut(_gathered(sent, later_only and not more), free=True)
    remove(docs.sparkSession, tables.folder)
    if more:
        sent = tables.write(_next_level(docs.join(found, ["doc_id", "key"]).select("doc_id", "key", "text", "found"), first, window, first))
        del found
        release(docs.sparkSession)
        found = cut(_gathered(sent, later_only), free=True)
        remove(docs.sparkSession, tables.folder)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and spans (start and length of each removed
    stretch of words) for each row of ``docs``: the words of windows that also begin in a document with a smaller id go."""
    rows = _keyed(docs, id_col, text_col)
    found = _repeated(rows, window, later_only=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _pieces(batches):
            n = len(words.text)
            inside = words.inside(window)
            begins = np.flatnonzero(_among(words, words.windows(window), b.column("found")) & inside)
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, begins, 1)
            np.add.at(depth, begins + window, -1)
            gone = np.cumsum(depth)[:n] > 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words.n_words.astype(np.int64)), pa.array(np.bincount(words.text[gone], minlength=words.n_texts).astype(np.int64)), _joined(words, ~gone), _spans(words, gone)],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    joined = rows.join(found, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("found", F.array().cast("array<long>")).alias("found"))
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,length:long>>")


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by a space."""
    lengths = np.where(kept, words.ends - words.starts + 1, 0)
    ends = np.cumsum(lengths)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    own = np.repeat(kept, words.ends - words.starts)
    place = np.arange(len(words.held)) - np.repeat(np.cumsum(words.ends - words.starts) - (words.ends - words.starts), words.ends - words.starts)
    out[(np.repeat(ends - lengths, words.ends - words.starts) + place)[own]] = words.data[words.held][own]
    per_text = np.bincount(words.text, weights=lengths, minlength=words.n_texts).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(per_text)])
    raw = out.tobytes()
    return pa.array([raw[a : z - 1].decode("utf-8", "replace") if z > a else "" for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


def _spans(words: Words, gone: np.ndarray) -> pa.Array:
    """Stretches of removed words, counted from the beginning of their text."""
    first = np.cumsum(words.n_words) - words.n_words
    new_text = np.concatenate([[True], words.text[1:] != words.text[:-1]]) if len(words.text) else gone
    begins = np.flatnonzero(gone & (new_text | ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone))
    last = np.flatnonzero(gone & (np.concatenate([new_text[1:], [True]]) | ~np.concatenate([gone[1:], [False]]) if len(gone) else gone))
    values = pa.StructArray.from_arrays([pa.array((begins - first[words.text[begins]]).astype(np.int64)), pa.array((last + 1 - begins).astype(np.int64))], ["start", "length"])
    at = np.concatenate([[0], np.cumsum(np.bincount(words.text[begins], minlength=words.n_texts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), values)


def longest(docs: DataFrame, first: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and longest for the documents that share words with others: the greatest of the lengths ``first``, twice that,
    and so on, at which a window of the document stands in another one. Each level extends what the one before it left."""
    rows, spark = _keyed(docs, id_col, text_col), docs.sparkSession
    levels, length, start = Rounds(spark), first, lengths_to(first)[0]
    found = _repeated(rows, first, later_only=False)
    reached = levels.write(found.select("doc_id", F.lit(length).cast("long").alias("longest")).distinct())
    while not found.isEmpty():
        tables = Rounds(spark)
        sent = tables.write(_next_level(rows.join(found, ["doc_id", "key"]).select("doc_id", "key", "text", "found"), length, 2 * length, start if length == start else 0))
        found, length = cut(_gathered(sent), free=True), 2 * length
        remove(spark, tables.folder)
        now = found.select("doc_id", F.lit(length).cast("long").alias("longest"))
        reached = levels.write(reached.unionByName(now).groupBy("doc_id").agg(F.max("longest").alias("longest")))
    return reached
