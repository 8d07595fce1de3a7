"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is parsed against it into the fewest phrases that
each occur in the labelled text: the automaton is followed as long as possible (its path is the longest match), then a
new phrase begins. The phrases, times the bits that name a place in the labelled text, per symbol, estimate the cross
entropy; the language that needs the least wins, the first by name of equals.

Texts are lower-cased; runs of what isn't a letter are one space; letters become symbols, those that the labelled texts don't
have one that no phrase goes on with. Transitions are sparse: most states lead on with one symbol, kept by state; those of the
others are in a hash table, so memory grows with the labelled text, whatever the alphabet. Texts are parsed in blocks of
``BLOCK`` symbols, so that many advance together, one symbol at a time; a phrase goes on from one block into the next. For
that, blocks are first parsed as if a phrase began with each, then again from where the block before ended, as far as the two
ways differ (they meet when both are in the same state), until no block's end changes.

Fitting uses a bounded sample, the same for any size of the input: per language the ``TRAIN_ROWS`` labelled rows with the
smallest hashes of their ids, of any length, as far as they have ``TRAIN_CHARS`` characters together; a row that has more than
is left is passed over, and a language that has only longer ones is learned from its shortest. Of the sampled rows every symbol is
learned.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and if no row has a label; ``keep_known``
keeps texts with a letter if no row has a label; rows repeated each give a row; an empty table gives an empty result;
other columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.llm.rows import unused
from strataquill.session import give_back

TRAIN_ROWS, TRAIN_CHARS = 128, 1 << 19
BLOCK, MARK, LANES = 256, 16, 49152
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Labelled text per language, for fitting."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"))).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    # Eight times the rows that are wanted, by hash; null and empty texts among them are the reason for more.
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 31, math.ceil((1 << 31) * 8 * TRAIN_ROWS / n)))])
    usable = rows.where((F.octet_length("text") > 0) & F.col("text").rlike(r"\p{L}")).withColumn("size", F.char_length("text"))
    near = usable.where(F.col("h") < limits[F.col("lang")])
    chosen: dict[str, list] = {}
    left = dict.fromkeys(counts, TRAIN_CHARS)
    for r in sorted(near.select("lang", "h", F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("t"), "size").collect()):
        own = chosen.setdefault(r["lang"], [])
        if len(own) < TRAIN_ROWS and r["size"] <= left[r["lang"]]:
            own.append(tuple(r)[:4])
            left[r["lang"]] -= r["size"]
    found: dict[str, list] = {}
    picked = {k for own in chosen.values() for k in own}
    if picked:
        few = near.where(F.xxhash64("text").isin(sorted({k[3] for k in picked})))
        for r in few.select("lang", "h", F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("t"), "text").collect():
            if tuple(r)[:4] in picked:
                found.setdefault(r["lang"], {})[tuple(r)[:4]] = r["text"]
    missing = sorted(set(counts) - set(found))
    out = {lang: [t for _, t in sorted(texts.items())] for lang, texts in found.items()}
    if missing:
        short = usable.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by("text", F.struct("size", "h")).alias("text"))
        out |= {r["lang"]: [r["text"]] for r in short.collect()}
    return {lang: "\n".join(texts) for lang, texts in sorted(out.items())}


class Alphabet:
    """Symbols: 0 for what isn't a letter, the letters of the labelled texts, and a last one for all other letters."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.other, self.size = 1 + len(letters), 2 + len(letters)
        is_letter = np.fromiter((unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)), bool, 0x110000)
        self.table = np.where(is_letter, self.other, 0).astype(np.int32)
        for i, c in enumerate(letters):
            self.table[ord(c)] = 1 + i

    def symbols(self, text: str) -> np.ndarray:
        """The symbols of a text, without repeated spaces."""
        codes = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not codes.any():
            return codes[:0]
        kept = codes > 0
        kept[1:] |= codes[:-1] > 0
        return codes[kept]


def suffix_automaton(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automaton that accepts all substrings: the symbol that each state leads on with, -1 if none and -2 if several do,
    the state it leads to, and the transitions (from, symbol, to) of the states with several. It starts in state 0."""
    only, leads, more = [-1], [0], {}
    link, length, last = [-1], [0], 0

    def get(p: int, c: int) -> int:
        return leads[p] if only[p] == c else more[p].get(c, -1) if p in more else -1

    def put(p: int, c: int, to: int) -> None:
        if p in more:
            more[p][c] = to
        elif only[p] in (-1, c):
            only[p], leads[p] = c, to
        else:
            more[p] = {only[p]: leads[p], c: to}
            only[p] = -2

    for c in symbols.tolist():
        new = len(only)
        only.append(-1)
        leads.append(0)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and get(p, c) < 0:
            put(p, c, new)
            p = link[p]
        if p >= 0:
            q = get(p, c)
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(only)
                only.append(only[q])
                leads.append(leads[q])
                if q in more:
                    more[copy] = dict(more[q])
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and get(p, c) == q:
                    put(p, c, copy)
                    p = link[p]
        last = new
    many = np.array([(p, c, to) for p, moves in more.items() for c, to in moves.items()], np.int64).reshape(-1, 3)
    return np.array(only, np.int32), np.array(leads, np.int32), many


class Steps:
    """The transitions of a suffix automaton, for many lanes at once: by state where there is one way on, in a hash table with
    open addressing where there are several."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.only, self.leads, many = suffix_automaton(symbols)
        root = many[many[:, 0] == 0] if self.only[0] == -2 else np.array([(0, self.only[0], self.leads[0])])
        self.begin = np.zeros(width, np.int32)  # where a phrase that begins with a symbol leads; 0 if it ends there
        self.begin[root[:, 1]] = root[:, 2]
        self.only[0] = -1  # no phrase is open there
        many = many[many[:, 0] > 0]
        # States with several ways on get numbers of their own, by which their transitions are found.
        branching, number = np.unique(many[:, 0], return_inverse=True)
        self.leads[branching] = np.arange(len(branching))
        self.width = width
        kind = np.int32 if len(branching) * width < 1 << 31 else np.int64
        key, to = (number * width + many[:, 1]).astype(kind), many[:, 2].astype(np.int32)
        bits = max(4, (2 * len(key)).bit_length())
        self.shift, self.last = 32 - bits if bits < 32 else 0, (1 << bits) - 1
        self.keys, self.to = np.full(self.last + 1, -1, kind), np.zeros(self.last + 1, np.int32)
        place, left = self._place(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[place[left]] < 0]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[place[put]], self.to[place[put]] = key[put], to[put]
            left = left[self.keys[place[left]] != key[left]]
            place[left] = (place[left] + 1) & self.last

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(self.shift)).astype(np.int64) & self.last

    def on(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each lane, and whether a phrase begins with its symbol."""
        only, out = self.only[state], self.leads[state]
        fits = only == symbol
        some = np.flatnonzero(only == -2)
        if len(some):
            key = out[some].astype(self.keys.dtype) * self.width + symbol[some]
            place = self._place(key)
            held = self.keys[place]
            while len(some):
                hit = held == key
                found = some[hit]
                out[found], fits[found] = self.to[place[hit]], True
                on = ~hit & (held >= 0)
                some, key, place = some[on], key[on], (place[on] + 1) & self.last
                held = self.keys[place]
        new = ~fits
        np.copyto(out, self.begin[symbol], where=new)
        return out, new

    def run(self, state: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after ``rows`` (a row per place, a column per lane; -1 fills up) and the phrases begun on the way."""
        begun = np.zeros(len(state), np.int64)
        for row in rows:
            full = row >= 0
            if full.all():
                state, new = self.on(state, row)
                begun += new
            elif full.any():
                state = state.copy()
                state[full], new = self.on(state[full], row[full])
                begun[full] += new
        return state, begun

    def phrases(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases begun in each block; ``rows`` has a row per place and a column per block, ``first`` says which blocks
        begin a text. A block goes on from the end of the one before it."""
        n, marks = rows.shape[1], range(0, len(rows), MARK)
        states, counts = np.zeros((len(marks) + 1, n), np.int32), np.zeros((len(marks), n), np.int64)
        for k, a in enumerate(marks):
            states[k + 1], counts[k] = self.run(states[k], rows[a : a + MARK])
        todo = np.flatnonzero(~first)
        while len(todo):
            before = states[-1, todo - 1]
            moved = todo[states[0, todo] != before]
            now, ended = before[states[0, todo] != before], []
            states[0, moved] = now
            for k, a in enumerate(marks):
                if not len(moved):
                    break
                now, counts[k, moved] = self.run(now, rows[a : a + MARK, moved])
                differs = states[k + 1, moved] != now
                moved, now = moved[differs], now[differs]
                states[k + 1, moved] = now
            # The blocks after those whose end is another now.
            todo = moved[moved + 1 < n] + 1
            todo = todo[~first[todo]]
        return counts.sum(axis=0)


class Model:
    """The automata of all languages over one alphabet."""

    def __init__(self, texts: dict[str, str]):
        self.alphabet = Alphabet(list(texts.values()))
        self.langs, self.steps, self.bits = [], [], []
        for lang in sorted(texts):
            symbols = self.alphabet.symbols(texts[lang])
            if len(symbols):
                self.langs.append(lang)
                self.steps.append(Steps(symbols, self.alphabet.size))
                self.bits.append(math.log2(len(symbols) + 1))

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases per language and text."""
        each = [-(-len(c) // BLOCK) for c in coded]
        grid = np.full((sum(each), BLOCK), -1, np.int32)
        at = 0
        for c, n in zip(coded, each, strict=True):
            if n:
                grid[at : at + n].reshape(-1)[: len(c)] = c
                at += n
        owner = np.repeat(np.arange(len(coded)), each)
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]
        rows = np.ascontiguousarray(grid.T)
        return np.stack([np.bincount(owner, steps.phrases(rows, first), len(coded)) for steps in self.steps])

    def predict(self, texts: list[str | None], room: int = BLOCK * LANES) -> list[tuple[str, float]]:
        """(language, score) per text; the score is how much less than the second language the first needs."""
        out: list[tuple[str, float]] = []
        pending: list[np.ndarray] = []
        held = 0
        for t in texts:
            pending.append(self.alphabet.symbols(t) if t else np.zeros(0, np.int32))
            held += len(pending[-1])
            if held >= room:
                out += self._judge(pending)
                pending, held = [], 0
        return out + self._judge(pending)

    def _judge(self, coded: list[np.ndarray]) -> list[tuple[str, float]]:
        sizes = np.array([len(c) for c in coded], np.int64)
        if not sizes.sum() or not self.langs:
            return [(UNKNOWN, 0.0)] * len(coded)
        entropy = self.phrases(coded) * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(axis=0)
        ordered = np.sort(entropy, axis=0)
        score = 1 - ordered[0] / np.maximum(ordered[1], 1e-12) if len(self.langs) > 1 else np.ones(len(coded))
        return [(self.langs[b], float(min(1, max(0, s)))) if n else (UNKNOWN, 0.0) for b, s, n in zip(best, score, sizes, strict=True)]


_MODELS: dict[int, Model] = {}


def model_of(texts: dict[str, str]) -> Model:
    """The model of the labelled texts, built once per Python worker."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(texts)
    return _MODELS[key]


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row; ``texts`` (of :func:`sample`) is of bounded size and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(shared.value)

        def told(some: list[pd.DataFrame]) -> pd.DataFrame:
            b = pd.concat(some)
            out = pd.DataFrame(model.predict(b["text"].tolist()), columns=["lang_pred", "score"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            return out

        # Several batches are parsed together: a step costs little more for many lanes than for few.
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += int(b["text"].str.len().sum())
            if n >= BLOCK * LANES:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)
        give_back()

    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def predicted(text: Column, texts: dict[str, str]) -> Column:
    """struct(lang_pred, score) of a text, for use beside other columns: only texts go to Python, no row moves. ``texts`` are
    broadcast, since a plan that held them would stand in the driver's memory several times."""
    shared = SparkSession.active().sparkContext.broadcast(texts)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_of(shared.value)
        for b in batches:
            yield pd.DataFrame(model.predict(b.tolist()), columns=["lang_pred", "score"])
        give_back()

    return run(text)


def keep_known(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told."""
    texts, text, found = sample(docs), docs[text_col], unused(docs, "language")
    if not texts:
        return docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return docs.withColumn(found, predicted(text, texts)).where(F.col(found)["lang_pred"] != UNKNOWN).drop(found)
