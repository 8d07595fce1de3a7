"""Best-fit packing of tokenised documents into sequences, with certified bounds.

1. Documents are tokenised, closed with an end id and cut into pieces of at most ``capacity`` tokens (only longer
   documents are cut). The pieces, a few numbers each, are written to a checkpoint.
2. Pieces are dealt to partitions by a hash of their place in that table, about ``PART`` pieces each, and each partition is packed best-fit decreasing.
   Lower bounds from dual feasible functions certify how many bins the partition needs at least.
3. Partitions with a gap between bins and bound give up their bins that aren't full; the pieces of those bins are dealt
   anew, so that partitions exchange documents, and packed again. An exchange counts only if it saves bins. Exchanges go
   on until no partition has a gap, the open bins are as few as their content needs, or ``PATIENCE`` exchanges in a row
   saved none; :func:`certificate` tells how many bins any packing of the same pieces needs.

Texts are tokenised by the library. Texts of usual characters only are lower-cased and split here, by the rules of the
tokenizer file, and each distinct word goes to the library's model once; all other texts, and those that hold the string
of an added token, go to the library whole.

Defined results: null text is empty (its only id is the end id); rows repeated (equal doc_id) each give pieces; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.session import cut, give_back

CAPACITY, PART, PATIENCE = 2048, 16_384, 3

# Tokenising ------------------------------------------------------------------------------------------------------

#: Characters for which composing (NFC) does nothing and lower-casing needs no context; white space among them. (fixed values)
_SPACE = "\t\n\r \xa0"
_USUAL = "\t\n\r -~\xa0-ſ‐-‧‰-⁞₠-₿"
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_UNUSUAL = re.compile(f"[^{_USUAL}]")
#: The split of the tokenizer file, spelled out for those characters (letters and digits among the signs aren't usual characters).
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")


class WordIds(dict):
    """Token ids of words, and of texts, as little-endian unsigned 32-bit integers, by a tokenizer file that lower-cases,
    drops white space and reads bytes as characters. As a dict it holds the words that the library has told so far."""

    def __init__(self, path: str, max_cached: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        added = {t.content.lower() for t in self.library.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.model = self.library.model
        self.max_cached = max_cached
        # Bytes as characters: those that print stand for themselves, the others follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = dict(zip(sorted(set(range(256)) - set(plain)), range(256, 512), strict=False))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.max_cached:
            self.clear()
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        found = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _UNUSUAL.search(text):
            return self.whole(text)
        low = text.lower()
        return self.whole(text) if self.added.search(low) else b"".join(map(self.__getitem__, _SPLIT.findall(low)))


_WORDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _WORDS:
            _WORDS[path] = WordIds(path)
        words = _WORDS[path]
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = words.encode(text) + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[a : a + 4 * capacity]
                    out.append((doc, k, a // 4, len(some) // 4, zlib.crc32(some)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


# Packing ---------------------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and each bin's fill; of bins with equal room the latest is used."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []  # bit r of rooms: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        room -= n
        if room:
            open_by_room[room].append(k)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[n]`` items have length n. The best of three families of dual feasible functions."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    number, weight = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    for e in range(1, capacity // 2 + 1):  # large items count as whole bins, those below e as nothing
        large = int(number[capacity + 1] - number[capacity - e + 1])
        middle = int(weight[capacity - e + 1] - weight[e])
        best = max(best, large + -(-middle // capacity))
        parts = capacity // e  # items up to half a bin count as one of so many parts
        over = np.arange(capacity // 2 + 1, capacity + 1, dtype=np.int64)
        value = int((counts[over] * (parts - (capacity - over) // e)).sum()) + int(number[capacity // 2 + 1] - number[e])
        best = max(best, -(-value // parts))
    for k in range(1, 33):  # rounding to k-ths, exact multiples of 1 / (k + 1) kept
        scaled = sizes * (k + 1)
        value = int((counts * np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)).sum())
        best = max(best, -(-value // (k * capacity)))
    return best


_PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long, part_bins long, part_bound long"


def _pack(dealt: DataFrame, capacity: int) -> DataFrame:
    """Packs each group of ``part``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return group.assign(bin=bins, offset=offsets, fill=fill[bins], part_bins=len(fill), part_bound=bound)

    return dealt.groupBy("part").applyInPandas(run, _PACKED)


def pack(items: DataFrame, capacity: int = CAPACITY, part: int = PART, patience: int = PATIENCE) -> DataFrame:
    """The rows of :func:`pieces` with sequence_id and offset."""
    columns = items.columns
    # Rows of a checkpoint have a fixed place, so repeated and null ids are told apart.
    items = cut(items).withColumn("row", F.monotonically_increasing_id())

    def dealt(rows: DataFrame, n: int, turn: int) -> DataFrame:
        parts = max(1, -(-n // part))
        return rows.select("row", *columns, F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(parts)).alias("part"))

    turn, last, failed, kept = 0, 0, 0, []
    now = cut(_pack(dealt(items, items.count(), turn), capacity))
    gap = (F.col("part_bins") > F.col("part_bound")) & (F.col("fill") < capacity)
    while failed < patience:
        n_pieces, n_bins, weight = now.where(gap).agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        # No exchange can help if the open bins are as few as their content needs.
        if n_bins <= -(-weight // capacity):
            break
        turn += 1
        again = cut(_pack(dealt(now.where(gap), n_pieces, turn), capacity))
        if again.where("offset = 0").count() >= n_bins:
            failed += 1
            continue
        kept.append(now.where(~gap).withColumn("turn", F.lit(last)))
        now, last, failed = again, turn, 0
    kept.append(now.withColumn("turn", F.lit(last)))
    out = kept[0]
    for rows in kept[1:]:
        out = out.unionByName(rows)
    # A bin's number is below 2**15 and a part's below 2**38: a part has about PART pieces, each in one bin.
    ident = F.col("turn").cast("long") * F.lit(1 << 53) + F.col("part") * F.lit(1 << 15) + F.col("bin")
    return out.select(*columns, ident.alias("sequence_id"), "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(bins used, bins that any packing of the same pieces needs); reads one count per length."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed.where("offset = 0").count(), lower_bound(counts, capacity)
