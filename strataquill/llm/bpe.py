r"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A sequence of tokens is the encoding of its bytes exactly if each adjacent pair is the encoding of *its* bytes.
That makes encoding a regular relation: a nondeterministic transducer reads bytes down a trie of the vocabulary, and at
the end of a token ``t`` it may go back to the root if ``t`` may follow the token before. The transducer is determinised
while texts are read. A deterministic state is a set of hypotheses (last whole token, trie node); as every prefix has one
encoding, each move also names the one token that ends there. A hypothesis is dropped when no token below its node may
follow its last one, and lives no longer than the longest token; so the hypotheses soon agree on all but the last few
tokens, and what they agree on is emitted. The lookahead is bounded by the vocabulary, not by the text. States are made
on first use and dropped together beyond a limit.

Whether ``b`` may follow ``a`` is decided on the merges that built them: the pieces of ``a`` that touch the boundary and
the pieces of ``b`` that touch it exist during certain ranks; the pair is allowed if no two that exist together would
have merged across the boundary first.

Decoding. Tokens are looked up and joined in chunks and fed, byte by byte, to a UTF-8 state machine, whose state is the
number of bytes that the character still needs, the range allowed for the next one, and the code point so far. Runs of
ASCII bytes, on which it stays in its first state, pass whole. What isn't UTF-8 becomes a replacement character per
maximal beginning, or stays as it is (``escape``), so that the bytes can be told from the text.

Text is split by a pattern first and each match is encoded on its own. Matches seen before come from a bounded cache of
the transducer's output.

Defined results: null text is encoded as empty (no ids); rows repeated each give a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Encodes byte strings; see the module's docstring."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, max_cached: int = 600_000, max_known: int = 700_000):
        self.ranks, self.max_states, self.max_cached, self.max_known = ranks, max_states, max_cached, max_known
        self.text = {rank: token for token, rank in ranks.items()}
        #: So many bytes are read before what is agreed on is emitted.
        self.window = 8 * max(map(len, ranks))
        # The trie: a node is a number; node * 256 + byte leads to its child.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.children: list[list[int]] = [[]]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                to = self.child.get(key)
                if to is None:
                    to = self.child[key] = len(self.depth)
                    self.children[node].append(to)
                    self.children.append([])
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.token_at[node] = rank
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._follows: dict[int, bool] = {}
        self._tokens_below: dict[int, list[int] | None] = {}
        self._living: dict[int, bool] = {}
        self.ending: dict[int, int] = {}
        self.cache: dict[str, bytes] = {}
        self._reset()

    # Merges ------------------------------------------------------------------------------------------------------

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte; (-1, -1) if merging its bytes doesn't make it."""
        if token not in self._splits:
            whole = self.text[token]
            parts = [bytes([b]) for b in whole]
            while len(parts) > 2:
                pairs = [(self.ranks.get(x + y, _NEVER), i) for i, (x, y) in enumerate(itertools.pairwise(parts))]
                rank, i = min(pairs)
                if rank == _NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._splits[token] = None if len(parts) == 1 else tuple(self.ranks[p] for p in parts) if len(parts) == 2 else (-1, -1)
        return self._splits[token]

    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        return self._split(token) != (-1, -1)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank at which it goes into a larger one) of the pieces at one end (0 left, 1 right), largest first."""
        key = (token, side)
        if key not in self._spines:
            out, at, until = [], token, _NEVER
            while True:
                out.append((at, until))
                split = self._split(at)
                if split is None:
                    break
                at, until = split[side], at
            self._spines[key] = out
        return self._spines[key]

    def follows(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of the bytes of a and b."""
        known = self._follows.get(a << 24 | b)
        if known is None:
            if len(self._follows) > self.max_known:
                self._follows.clear()
            known = self._follows[a << 24 | b] = self._free(a, b)
        return known

    def _free(self, a: int, b: int) -> bool:
        left, right, text, ranks = self._spine(a, 1), self._spine(b, 0), self.text, self.ranks
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            merged = ranks.get(text[x] + text[y])
            # Of equal ranks the leftmost merges first: one inside a goes before the boundary, one inside b after.
            if merged is not None and merged < x_until and merged <= y_until:
                return False
            more_x, more_y = i + 1 < len(left), j + 1 < len(right)
            # Step back to before the later of the two merges that made x and y.
            if more_x and (not more_y or x > y):
                i += 1
            elif more_y:
                j += 1
            else:
                return True

    # Determinisation ---------------------------------------------------------------------------------------------

    def _below(self, node: int) -> list[int] | None:
        """The tokens at and below a node; None if there are too many to look at."""
        if node not in self._tokens_below:
            todo, out, seen = [node], [], 0
            while todo and seen < 200:
                at = todo.pop()
                seen += 1
                token = self.token_at.get(at)
                if token is not None and self.whole(token):
                    out.append(token)
                todo.extend(self.children[at])
            self._tokens_below[node] = None if todo else out
        return self._tokens_below[node]

    def _alive(self, last: int, node: int) -> bool:
        """Whether a token below the node may follow ``last``."""
        if last < 0 or self._below(node) is None:
            return True
        return any(self.follows(last, t) for child in self.children[node] for t in self._below(child))

    def _reset(self) -> None:
        # A hypothesis is (last + 1) << 24 | node; a move's key is state << 8 | byte, its value state << 24 | token + 1.
        self.numbers: dict[tuple[int, ...], int] = {}
        self.sets: list[tuple[int, ...]] = []
        self.moves: dict[int, int] = {}
        self.start = self._intern((0,))

    def _intern(self, hypotheses: tuple[int, ...]) -> int:
        n = self.numbers.get(hypotheses)
        if n is None:
            n = self.numbers[hypotheses] = len(self.sets)
            self.sets.append(hypotheses)
        return n

    def _move(self, key: int) -> int:
        """The state after a byte, and the token that ends with it."""
        byte, after, ended = key & 255, [], -1
        child, ending, living, follows = self.child.get, self.ending, self._living, self._follows
        for h in self.sets[key >> 8]:
            to = child((h & 0xFFFFFF) << 8 | byte)
            if to is None:
                continue
            if ended < 0:
                token = ending.get(to)
                if token is None:
                    token = self.token_at.get(to, -1)
                    token = ending[to] = token if token >= 0 and self.whole(token) else -1
                if token >= 0:
                    last = (h >> 24) - 1
                    may = last < 0 or follows.get(last << 24 | token)
                    if may is None:
                        may = self.follows(last, token)
                    if may:
                        after.append((token + 1) << 24)
                        ended = token
            on = h - (h & 0xFFFFFF) + to
            alive = living.get(on)
            if alive is None:
                if len(living) > self.max_known:
                    living.clear()
                alive = living[on] = self._alive((h >> 24) - 1, to)
            if alive:
                after.append(on)
        after.sort()
        found = self.moves[key] = self._intern(tuple(after)) << 24 | ended + 1
        return found

    def _agreed(self, state: int, ends: list[int]) -> int:
        """How many of the bytes read are covered by tokens on which all hypotheses of a state agree."""
        at = {len(ends) - self.depth[h & 0xFFFFFF] for h in self.sets[state]}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - len(self.text[ends[far - 1]]) if far else 0)
        return at.pop()

    def _emit(self, ends: list[int], upto: int) -> bytes:
        out = []
        while upto > 0:
            token = ends[upto - 1]
            out.append(token)
            upto -= len(self.text[token])
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def encode_bytes(self, data: bytes) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        state, out, known, ends = self.start, [], self.moves.get, []
        for a in range(0, len(data), self.window):
            if len(self.sets) > self.max_states or len(self.moves) > 4 * self.max_states:
                # Long matches too: all states but the present one are dropped.
                here = self.sets[state]
                self._reset()
                state, known = self._intern(here), self.moves.get
            for byte in data[a : a + self.window]:
                key = state << 8 | byte
                move = known(key) or self._move(key)
                state = move >> 24
                ends.append((move & 0xFFFFFF) - 1)
            if len(data) > a + self.window:
                sure = self._agreed(state, ends)
                out.append(self._emit(ends, sure))
                del ends[:sure]
        out.append(self._emit(ends, len(ends)))
        return b"".join(out)

    def encode(self, pieces: list[str]) -> bytes:
        """The ids of the matches of a text."""
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            if len(cache) > self.max_cached:
                cache.clear()
            long = {}
            for p in pieces:
                if p not in cache:
                    # What is longer than any usual word isn't kept.
                    (cache if len(p) <= 64 else long)[p] = self.encode_bytes(p.encode("utf-8", "surrogatepass"))
            if long:
                return b"".join([cache[p] if len(p) <= 64 else long[p] for p in pieces])
            return b"".join(map(cache.__getitem__, pieces))


class Utf8Stream:
    """An incremental UTF-8 state machine: text of whole characters, the rest held in the state.

    With ``escape``, a byte that belongs to no character stands as a lone surrogate, U+DC00 + byte; else an ill-formed
    beginning of a character is one U+FFFD.
    """

    #: Lead bytes with the continuation bytes they need and the range of the first of these; later ones are 80-BF. (fixed values)
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))
    ENTER = {byte: (need, low, high, byte & (0x3F >> need)) for first, last, need, low, high in LEADS for byte in range(first, last + 1)}

    def __init__(self, escape: bool = False) -> None:
        self.escape = escape
        self.need, self.low, self.high, self.point, self.begun = 0, 0x80, 0xBF, 0, b""

    def _broken(self, data: bytes) -> str:
        return "".join(chr(0xDC00 + x) for x in data) if self.escape else "\ufffd"

    def feed(self, data: bytes, last: bool = False) -> str:
        need, low, high, point, begun = self.need, self.low, self.high, self.point, self.begun
        out, enter = [], self.ENTER
        for run in _RUNS.findall(data):
            if run[0] < 0x80:
                if need:
                    out.append(self._broken(begun))
                    need = 0
                out.append(run.decode("ascii"))
                continue
            for byte in run:
                if need:
                    if low <= byte <= high:
                        need, low, high, point = need - 1, 0x80, 0xBF, point << 6 | byte & 0x3F
                        if need:
                            begun += bytes((byte,))
                        else:
                            out.append(chr(point))
                        continue
                    out.append(self._broken(begun))
                    need = 0
                entered = enter.get(byte)
                if entered:
                    need, low, high, point = entered
                    begun = bytes((byte,))
                else:
                    out.append(self._broken(bytes((byte,))))
        if last and need:
            out.append(self._broken(begun))
            need = 0
        self.need, self.low, self.high, self.point, self.begun = need, low, high, point, begun
        return "".join(out)


#: Runs of ASCII bytes and of others.
_RUNS = re.compile(rb"[\x00-\x7f]+|[\x80-\xff]+")


def decode_stream(chunks: Iterable[bytes], table: dict[int, bytes] | list[bytes], escape: bool = False) -> Iterator[str]:
    """Text of chunks of ids (little-endian unsigned 32-bit), as far as whole characters have come."""
    stream = Utf8Stream(escape)
    for ids in chunks:
        yield stream.feed(b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())))
    yield stream.feed(b"", last=True)


#: The white space of Unicode, for the class \s of the split pattern. (fixed values)
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"


def splitter(pattern: str) -> regex.Pattern:
    r"""The compiled pattern; its \s and \S mean Unicode white space exactly."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


_LOADED: dict[tuple, tuple[Transducer, regex.Pattern, list[bytes]]] = {}


def tokenizer(path: str, pattern: str) -> tuple[Transducer, regex.Pattern, list[bytes]]:
    """Transducer, splitter and decoding table; one per Python worker, so states made for one task serve the next."""
    key = (path, pattern)
    if key not in _LOADED:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _LOADED[key] = (Transducer(ranks), splitter(pattern), table)
    return _LOADED[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row. ``path`` is a place that all nodes have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer, split, _ = tokenizer(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [transducer.encode(split.findall(t)) if t else b"" for t in b["text"]]})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, ids binary").select(F.col("doc_id").cast("long").alias("doc_id"), "ids")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 4096) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer, split, table = tokenizer(path, pattern)
        for b in batches:
            out = []
            for t in b["text"]:
                ids = transducer.encode(split.findall(t)) if t else b""
                digest = hashlib.sha256()
                # Bytes that aren't UTF-8 come back as they were, so the digest is that of the decoded bytes.
                for text in decode_stream((ids[i : i + 4 * chunk] for i in range(0, len(ids), 4 * chunk)), table, escape=True):
                    digest.update(text.encode("utf-8", "surrogateescape"))
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest.hexdigest()))
            rows = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            rows.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield rows

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))
