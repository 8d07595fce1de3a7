"""Periodic runs of words: stretches that repeat their first words over and over.

A run of period q is a maximal stretch in which words q apart are identical, of at least ``max(least, 2 * q)`` words, whose
smallest period is q. They are found lag by lag with whole-text bit operations. A text's words are numbered; bit plane k is
one big integer that holds bit k of the number of every word. At lag q a plane is XORed with itself shifted by q, and the
results are ORed over the planes: a zero is a word that equals the one q places on. ANDs of the complement with itself,
shifted by doubling distances, leave the places where enough zeros follow each other; what is left in a row is a run. After
the first planes, which tell most words apart, this is tried once; most lags end there. All lags up to half of the text are
tried, so no run is missed. A stretch found at a multiple of its smallest period was found at that period before, with the
same ends (its length of at least two periods makes sure of that), and counts once.

The work of a text grows with the square of its words, divided by the 64 bits of a machine word, and its memory with its words.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; ``doc_id`` may be null or repeated,
each row is looked at on its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, FIRST_PLANES = 12, 4
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def planes_of(words: list[str]) -> list[int]:
    """Bit planes of the words' numbers; bit i of a plane belongs to word i."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint32)
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range((len(number) - 1).bit_length())]


def _followed(zeros: int, n: int) -> int:
    """The places of ``zeros`` from which ``n`` places in a row are set."""
    have = 1
    while zeros and have < n:
        step = min(have, n - have)
        zeros &= zeros >> step
        have += step
    return zeros


def _places(bits: int) -> list[int]:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def runs_of(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < max(least, 2):
        return []
    planes, found, all_places = planes_of(words), {}, (1 << n) - 1
    for q in range(1, n // 2 + 1):
        all_places >>= 1  # one for each pair of words q apart
        needed, differ = max(least - q, q), 0
        for plane in planes[:FIRST_PLANES]:
            differ |= plane ^ plane >> q
        left = _followed(all_places & ~differ, needed)
        if left and len(planes) > FIRST_PLANES:
            for plane in planes[FIRST_PLANES:]:
                differ |= plane ^ plane >> q
            left = _followed(all_places & ~differ, needed)
        if left:
            for start, last in zip(_places(left & ~(left << 1)), _places(left & ~(left >> 1)), strict=True):
                found.setdefault((start, last + needed + q), q)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, depth in zip(words, np.cumsum(change).tolist(), strict=False) if not depth]


def find_runs(docs: DataFrame, least: int = LEAST, change: Callable[[int | None, list[str]], list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed (the kept words, joined by a space) for each row of ``docs``.

    ``change`` gets the id and the words of a text and returns the words to look at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                doc_id = None if i == "" else int(i)
                words = WORD.findall(t)
                if change:
                    words = change(doc_id, words)
                runs = runs_of(words, least)
                out.append((doc_id, len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], " ".join(collapse(words, runs) if runs else words)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "collapsed"]).astype({"doc_id": "Int64"})

    # ids as text: pandas would turn a column of longs with nulls into doubles
    told = docs.select(F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return told.mapInPandas(run, SCHEMA)
