"""N-gram Jaccard self-join of documents by a grouped prefix join.

A document's set holds its distinct word shingles, as 64-bit hashes. Two sets link when 100 * intersection >=
``percent`` * union; results are exact (up to equal hashes of different shingles).

1. Order. Any total order of shingles gives a correct prefix filter; rare first gives few candidates. Half of the shingles
   (even hashes) are counted over all documents, and frequent ones, the most frequent ``MOST_HOT`` at most, are ordered
   last by count. The rest stand first, by hash; uncounted (odd) ones come after all counted ones.
2. Groups. A linked pair shares a shingle of its prefixes, the first ``n - ceil(t n) + 1`` of each set. Documents with
   identical prefix and size are one group, documents with identical sets one class; only groups go on.
3. Group pairs. Postings (shingle, group) meet in buckets. Lists of at most ``SHORT`` groups give pairs of compatible
   size, with the count of prefix shingles that they share; a pair goes on only if that count and what lies behind the
   prefixes can reach the needed overlap. Longer lists give a star. Frequent shingles are contracted to stars in each map
   task before they meet. Pairs, stars and groups of several classes connect *families*; every linked pair lies in one.
4. Members. A family's classes are cut into blocks, and each pair of blocks is verified in a task of its own on the full
   sets: documents are compared with all others of the task until all that remain uncompared are connected already. A
   task returns a spanning forest, never pairs.
5. Components of the forests' edges; each document gets its class's component.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component;
texts of fewer words than a shingle have their whole sequence as one shingle; rows with a null id link with nothing;
equal rows are linked copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm.components import Forest, components
from strataquill.llm.rows import one_each, packed
from strataquill.session import cut, give_back

WORDS, PERCENT = 5, 80
FREQUENT, MOST_HOT, SHORT = 8, 1 << 20, 16
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
BITS = 1 << 23
MOST_BROADCAST = 1 << 16  # rows of two numbers
HELD = 1_000_000  # hashes that a map task holds before it hands them on

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, as ascending hashes. A-Z count as a-z; only ASCII white space parts words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts))] if parts else [], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = (mixed ^ each[k : k + n]) * _FACTORS[k % 4]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _digest(*parts: bytes) -> bytes:
    h = xxhash.xxh3_128()
    for p in parts:
        h.update(p)
    return h.digest()


# Frequent shingles -----------------------------------------------------------------------------------------------


def _dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def frequent(docs: DataFrame, buckets: int, words: int = WORDS, least: int = FREQUENT) -> DataFrame:
    """(key, df) of the even shingles in more than ``least`` documents. ``docs`` has the column text."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            own = _dealt(keys, buckets)
            order = np.argsort(own, kind="stable")
            keys, counts, own = keys[order], counts[order], own[order]
            rows = []
            at = np.searchsorted(own, np.arange(buckets + 1))
            for k in range(buckets):
                a, b = at[k], at[k + 1]
                if a < b:
                    once = counts[a:b] == 1
                    rows.append((k, keys[a:b][once].tobytes(), keys[a:b][~once].tobytes(), counts[a:b][~once].astype(np.uint32).tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "once", "more", "counts"])

        for b in batches:
            for t in b["text"]:
                s = shingles(t, words)
                held.append(s[(s & np.uint64(1)) == 0])
                size += len(held[-1])
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held.clear()
        give_back()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(group["once"]), np.uint64)
        more, counts = np.frombuffer(b"".join(group["more"]), np.uint64), np.frombuffer(b"".join(group["counts"]), np.uint32)
        keys = np.concatenate([once, more])
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], np.concatenate([np.ones(len(once), np.int64), counts.astype(np.int64)])[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        df = np.add.reduceat(weights, starts)
        kept = df > least
        return pd.DataFrame({"key": keys[starts][kept].view(np.int64), "df": df[kept]})

    return docs.mapInPandas(spread, "bucket int, once binary, more binary, counts binary").groupBy("bucket").applyInPandas(merge, "key long, df long")


def _ordered_hot(found: DataFrame, most: int = MOST_HOT) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and counts of the most frequent shingles, at most ``most``; all of one power of two or none."""
    sizes = {r["level"]: r["n"] for r in found.groupBy(F.floor(F.log2("df")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, None
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        least = level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = found.where(F.floor(F.log2("df")) >= least).select("key", "df").toArrow()
    keys, df = rows["key"].to_numpy().view(np.uint64), rows["df"].to_numpy()
    order = np.argsort(keys)
    return keys[order], df[order]


# Signatures ------------------------------------------------------------------------------------------------------


def prefix(s: np.ndarray, hot_keys: np.ndarray, hot_df: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set: its frequent shingles and the others."""
    p = prefix_length(len(s), percent)
    even = (s & np.uint64(1)) == 0
    counted, rest = s[even], s[~even]
    if len(hot_keys) and len(counted):
        at = np.minimum(np.searchsorted(hot_keys, counted), len(hot_keys) - 1)
        is_hot = hot_keys[at] == counted
        hot, df, cold = counted[is_hot], hot_df[at[is_hot]], counted[~is_hot]
    else:
        hot, df, cold = counted[:0], np.zeros(0, np.int64), counted
    if len(cold) >= p:
        return hot[:0], cold[:p]
    hot = hot[np.lexsort((hot, df))][: p - len(cold)]
    return hot, np.concatenate([cold, rest[: p - len(cold) - len(hot)]])


_SIGNATURE = "doc_id string, key long, n long, digest binary, prefix_digest binary, hot binary, cold binary"


def signatures(docs: DataFrame, hot, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_keys, hot_df = hot.value
        for b in batches:
            out = []
            for doc, key, t in zip(b["doc_id"], b["key"], b["text"], strict=True):
                s = shingles(t, words)
                first, others = (x.tobytes() for x in prefix(s, hot_keys, hot_df, percent))
                out.append((doc, key, len(s), _digest(s.tobytes()), _digest(len(s).to_bytes(8, "little"), len(first).to_bytes(8, "little"), first, others), first, others))
            yield pd.DataFrame(out, columns=["doc_id", "key", "n", "digest", "prefix_digest", "hot", "cold"])
        give_back()

    return docs.mapInPandas(run, _SIGNATURE).withColumn("doc_id", F.col("doc_id").cast("long"))


# Candidates ------------------------------------------------------------------------------------------------------


def _cold_edges(groups: DataFrame, buckets: int, percent: int = PERCENT, short: int = SHORT) -> DataFrame:
    """Edges (a, b) from prefix shingles that aren't frequent."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys = np.frombuffer(b"".join(b["cold"]), np.uint64)
            sizes = np.array([len(x) // 8 for x in b["cold"]], np.int64)
            gid, n = np.repeat(b["gid"].to_numpy(np.int64), sizes), np.repeat(b["n"].to_numpy(np.uint32), sizes)
            own = _dealt(keys, buckets)
            order = np.argsort(own, kind="stable")
            at = np.searchsorted(own[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                some = order[at[k] : at[k + 1]]
                if len(some):
                    rows.append((k, keys[some].tobytes(), gid[some].tobytes(), n[some].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "keys", "gids", "ns"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        keys, gid = np.frombuffer(b"".join(group["keys"]), np.uint64), np.frombuffer(b"".join(group["gids"]), np.int64)
        n = np.frombuffer(b"".join(group["ns"]), np.uint32).astype(np.int64)
        order = np.lexsort((gid, keys))
        keys, gid, n = keys[order], gid[order], n[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        found = []
        for d in range(1, short):
            i = np.flatnonzero((size[:-d] <= short) & (keys[:-d] == keys[d:])) if len(keys) > d else np.zeros(0, np.int64)
            if not len(i):
                continue
            small, large = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
            i = i[100 * small >= percent * large]
            found.append(np.stack([gid[i], gid[i + d], n[i], n[i + d]], axis=1))
        pairs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        pairs, shared = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
        long = np.flatnonzero((size > short) & (first != np.arange(len(keys))))
        stars = np.unique(np.stack([gid[first[long]], gid[long]], axis=1), axis=0)
        out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "na": pairs[:, 2], "nb": pairs[:, 3], "shared": shared, "star": False})
        more = pd.DataFrame({"a": stars[:, 0], "b": stars[:, 1], "na": 0, "nb": 0, "shared": 0, "star": True})
        return pd.concat([out, more], ignore_index=True) if len(more) else out

    met = groups.select("gid", "n", "cold").mapInPandas(spread, "bucket int, keys binary, gids binary, ns binary")
    met = met.groupBy("bucket").applyInPandas(meet, "a long, b long, na long, nb long, shared long, star boolean")
    total = met.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"), F.max("star").alias("star"))
    behind = lambda n: F.ceil(F.col(n) * percent / 100) - 1  # noqa: E731  set minus prefix
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    return total.where(F.col("star") | (F.col("shared") + F.greatest(behind("na"), behind("nb")) >= needed)).select("a", "b")


def _hot_edges(groups: DataFrame) -> DataFrame:
    """Edges (a, b) from frequent prefix shingles: contracted in each map task, then one star per shingle."""

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, holder = Forest(), {}
        for b in batches:
            for gid, hot in zip(b["gid"].tolist(), b["hot"], strict=True):
                for key in np.frombuffer(hot, np.int64).tolist():
                    if key in holder:
                        forest.join(gid, holder[key])
                    else:
                        holder[key] = forest.root(gid)
        rows = [(None, x, forest.root(x)) for x in list(forest.up) if forest.root(x) != x]
        rows += [(key, forest.root(x), None) for key, x in holder.items()]
        yield pd.DataFrame(rows, columns=["key", "a", "b"], dtype=object).astype("Int64")

    found = cut(groups.select("gid", "hot").where(F.octet_length("hot") > 0).mapInPandas(contract, "key long, a long, b long"))
    held = found.where("key is not null").select("key", "a")
    least = held.groupBy("key").agg(F.min("a").alias("b"))
    across = held.join(least, "key").where("a <> b").select("a", "b")
    return found.where("key is null").select("a", "b").unionByName(across)


# Verification ----------------------------------------------------------------------------------------------------


def linked_forest(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning edges (id, smallest connected id) of the links among some sets.

    A set is compared with all others at once through an inverted index. Sets with the most shared shingles come first;
    as soon as everything not yet compared lies in one component, the rest can add nothing.
    """
    n = np.array([len(s) for s in sets], np.int64)
    keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    # Shingles of one set alone can't be shared.
    own_list = np.empty(len(keys), np.int64)
    own_list[:] = np.repeat(np.arange(len(starts)), sizes)
    many = sizes[own_list] > 1
    by_set = np.argsort(owner[many], kind="stable")
    lists_of = np.split(own_list[many][by_set], np.searchsorted(owner[many][by_set], np.arange(1, len(sets))))
    central = np.array([sizes[x].sum() for x in lists_of], np.int64) / np.maximum(n, 1)
    forest = Forest()
    compared = np.zeros(len(sets), bool)

    def compare(x: int) -> None:
        compared[x] = True
        mine = lists_of[x]
        if not len(mine):
            return
        lengths = sizes[mine]
        at = np.arange(lengths.sum()) + np.repeat(starts[mine] - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        both = np.bincount(owner[at], minlength=len(sets))
        for y in np.flatnonzero(100 * both >= percent * (n[x] + n - both)).tolist():
            if y != x:
                forest.join(x, y)

    todo = np.argsort(-central, kind="stable").tolist()
    for x in todo[: min(len(todo), 8)]:
        compare(x)
    while True:
        roots = np.array([forest.root(x) for x in range(len(sets))])
        left = np.flatnonzero(~compared)
        if not len(left):
            break
        values, counts = np.unique(roots[left], return_counts=True)
        outside = left[roots[left] != values[counts.argmax()]]
        if not len(outside):
            break
        for x in outside.tolist():
            compare(x)
    least: dict[int, int] = {}
    for x, i in enumerate(ids):
        r = forest.root(x)
        least[r] = min(i, least.get(r, i))
    return [(i, least[forest.root(x)]) for x, i in enumerate(ids) if i != least[forest.root(x)]]


def _verified(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) that span the links inside each family. ``members``: cid, digest, n, family."""
    place = F.pmod(F.xxhash64("cid"), F.lit(BITS))
    # A bit map of fixed size lets documents that are in no family pass by without being shingled again.
    bits = members.select(place.alias("place")).select(F.expr("cast(place div 32 as int) as word"), F.expr("shiftleft(1L, cast(place % 32 as int)) as bit"))
    bitmap = np.zeros(BITS // 32, np.uint32)
    marked = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap[marked["word"].to_numpy()] = marked["bits"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                s = shingles(text, words)
                out.append((doc, _digest(s.tobytes()), s.tobytes()))
            yield pd.DataFrame(out, columns=["cid", "digest", "shingles"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["place"].to_numpy(np.int64)
            yield b[(shared.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) == 1]

    hit = docs.where("doc_id is not null").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)))
    found = hit.mapInPandas(lambda batches: sets(near(batches)), "cid long, digest binary, shingles binary")
    held = cut(found.dropDuplicates(["cid", "digest"]).join(members.select("cid", "digest", "n", "family"), ["cid", "digest"]))
    shared.destroy()

    sizes = held.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    sizes = sizes.where("k > 1").select("family", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = cut(sizes)
    # Families are broadcast if few, so a large one isn't dealt to one task; beyond that they are joined as they come.
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    placed = held.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (F.col("blocks") == 1) | (k != F.col("own")))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    tasks = placed.withColumn("pair", F.explode(pairs)).select("family", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "cid", "shingles")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        edges = linked_forest(group["cid"].tolist(), [np.frombuffer(x, np.uint64) for x in group["shingles"]], percent)
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return tasks.groupBy("family", "i", "j").applyInPandas(verify, "a long, b long")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component_id of each row of ``docs`` (doc_id, key, text); equal ids are one document."""
    spark = docs.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = spark.sparkContext.broadcast(_ordered_hot(cut(frequent(docs.select("text"), buckets, words), free=True)))
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    signed = cut(signatures(typed, hot, words, percent))
    hot.destroy()  # the checkpoint holds all that was made with it

    usable = signed.where("n > 0 and doc_id is not null")
    groups = cut(usable.groupBy("prefix_digest").agg(F.min("doc_id").alias("gid"), F.first("n").alias("n"), F.first("hot").alias("hot"), F.first("cold").alias("cold")), free=True)
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("prefix_digest").alias("prefix_digest")))
    grouped = classes.join(groups.select("prefix_digest", "gid"), "prefix_digest").where("cid <> gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    candidates = _cold_edges(groups, buckets, percent).unionByName(_hot_edges(groups)).unionByName(grouped)
    connected = cut(components(candidates), free=True)
    ids = connected.select(F.col("id").alias("cid"), F.col("component").alias("family")).unionByName(connected.select(F.col("component").alias("cid"), F.col("component").alias("family")).distinct())
    members = cut(classes.drop("prefix_digest").join(ids, "cid"))

    linked = components(_verified(docs, members, words, percent)).withColumnRenamed("id", "cid")
    decided = classes.join(linked, "cid", "left").select("digest", F.coalesce("component", "cid").alias("component"))
    # Rows that can't link get a digest of their own, so that they don't meet in one task.
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("none"), F.col("doc_id").cast("string")), "utf-8"))
    rows = signed.select("doc_id", "key", "n", own.alias("digest"))
    return rows.join(decided, "digest", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), docs[text_col].alias("text"))
    return linked(rows, words, percent).drop("key")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, that with the smallest id, of each component; every other text stays.

    Where ids are null or repeated, rows are numbered in the order of their ids first (nulls last, then by a hash of all
    columns), so that each row decides for itself: null ids link too, and one of rows that agree in all columns stays.
    """
    rows = packed(docs, id_col, text_col)
    odd = docs.select(docs[id_col].alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1")
    if not odd.isEmpty():
        each = cut(rows.select("doc_id", "key").distinct().sort(F.col("doc_id").asc_nulls_last(), "key"))
        # Numbers ascend with partitions and places, so they keep the order of the sort.
        numbers = cut(each.withColumn("number", F.monotonically_increasing_id()))
        same = numbers.withColumnsRenamed({"doc_id": "id", "key": "hash"})
        matched = rows.join(same, rows["doc_id"].eqNullSafe(same["id"]) & (rows["key"] == same["hash"]))
        rows = matched.select("row", F.col("number").alias("doc_id"), "text", "key")
    # Texts without words link with nothing; of all else the smallest of each component stays.
    chosen = linked(rows.select("doc_id", "key", "text"), words, percent).where("doc_id = component_id").select("doc_id", "key").distinct()
    return one_each(rows.select("row", "doc_id", "key").join(chosen, ["doc_id", "key"]), "doc_id", "key")
