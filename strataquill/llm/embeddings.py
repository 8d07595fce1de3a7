"""Near-duplicate embeddings through a pivot-permutation index.

Reference points (pivots) are vectors of the table, a sample chosen by hash, about twice the square root of the number of
vectors and at most ``MOST_PIVOTS``. Each vector is described by its permutation: the ``NEAREST`` pivots closest to it, in
order of distance. Vectors that are close see the pivots in nearly the same order. They are retrieved through inverted
lists per label and pivot, in which a vector stands for the ``LISTS`` pivots at the head of its permutation. In a list, a
pair is a candidate if the two share at least ``SHARED`` pivots (counted on bit masks) and their permutations lie no
further apart than ``FAR`` (Spearman's footrule, a pivot that one of them lacks standing behind its last); candidates are
verified by cosine in double precision. A pair that stands together in several lists is taken up in that of the lowest
pivot, so once.

Equal vectors are one class with a count. A list is cut into blocks of about ``BLOCK`` and each pair of blocks is a task
of its own, so a hot list is spread; a task returns its vectors' link counts and a spanning forest, never pairs. No
candidate is dropped; what the index doesn't find is measured in the tests. Vectors that leave at most ``NEAREST`` pivots
apart (narrow cones, small tables) are all compared, within their label.

Defined results: vectors without id or label, null, empty or zero ones, and those with null or non-finite components
have no links and are their own component; vectors of different length never link; equal rows are linked copies; an
empty table gives an empty result; other columns are ignored. Vectors are scaled by their largest component first, so
very large and very small finite ones have a cosine too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm.components import Forest, components
from strataquill.session import cut

NEAREST, LISTS, SHARED, FAR, BLOCK = 8, 3, 3, 48, 768
LEAST_PIVOTS, MOST_PIVOTS, APART = 128, 1 << 16, 0.8
MOST_BROADCAST = 1 << 16  # rows of four short columns


def pivots_of(vectors: DataFrame, n: int) -> np.ndarray:
    """The pivots, unit vectors: about twice the square root of the number of vectors, within fixed bounds."""
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * math.sqrt(n))))
    # Vectors with the smallest hashes: a share of the rows that holds enough of them, ordered on the driver.
    share = min(1.0, 4 * wanted / max(n, 1))
    near = vectors.withColumn("h", F.pmod(F.xxhash64("cid"), F.lit(1 << 31))).where(F.col("h") < F.lit(int(share * (1 << 31)) + 1))
    found = [e for *_, e in sorted((r["h"], r["cid"], r["embedding"]) for r in near.select("h", "cid", "embedding").collect())]
    unit = _unit(found, max(map(len, found), default=0))
    # Pivots close to each other would come in any order seen from a vector near both.
    kept, n_kept = np.zeros((min(wanted, len(unit)), unit.shape[1])), 0
    for v in unit:
        if n_kept < len(kept) and (not n_kept or (kept[:n_kept] @ v).max() < APART):
            kept[n_kept] = v
            n_kept += 1
    return kept[:n_kept]


def _unit(vectors: list, width: int) -> np.ndarray:
    """Unit vectors of ``width`` components; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, e in enumerate(vectors):
        out[i, : min(width, len(e))] = e[:width]
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), 1e-300)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def index(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """Adds ``permutation`` to each vector: the numbers of its nearest pivots, nearest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                away = -(_unit(b["embedding"].tolist(), shared.value.shape[1]) @ shared.value.T)
                some = np.argpartition(away, nearest - 1, axis=1)[:, :nearest] if nearest < away.shape[1] else np.tile(np.arange(away.shape[1]), (len(b), 1))
                order = np.take_along_axis(some, np.lexsort((some, np.take_along_axis(away, some, axis=1)), axis=1), axis=1)
                yield b.assign(permutation=list(order.astype(np.int32)))

    return vectors.mapInPandas(run, "label string, dim int, cid long, n long, embedding array<double>, permutation array<int>")


def _masks(numbers: np.ndarray, words: int) -> np.ndarray:
    """A bit per number, in 64-bit words."""
    mask = np.zeros((len(numbers), words), np.uint64)
    rows = np.repeat(np.arange(len(numbers)), numbers.shape[1])
    np.bitwise_or.at(mask, (rows, numbers.ravel() // 64), np.uint64(1) << (numbers.ravel() % 64).astype(np.uint64))
    return mask


def footrule(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far two permutation heads lie apart, per row: places moved; a pivot that one lacks stands behind its last."""
    n = x.shape[1]
    same = x[:, :, None] == y[:, None, :]
    moved = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    behind = n - np.arange(n)
    return (same * moved).sum((1, 2)) + (~same.any(2) * behind).sum(1) + (~same.any(1) * behind).sum(1)


def _linked(pivot: int, first: np.ndarray, second: np.ndarray, permutations: np.ndarray, lists: int, shared: int, far: int, unit: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (rows of ``unit``) of one from ``first`` and one from ``second`` that have no list below that of ``pivot`` in common."""
    # The pivots that occur here, numbered anew in the same order.
    present, local = np.unique(permutations, return_inverse=True)
    local = local.reshape(permutations.shape)
    words = -(-len(present) // 64)
    masks, heads = _masks(local, words), _masks(local[:, :lists], words)
    own = int(np.searchsorted(present, pivot))
    heads[:, own // 64] &= np.uint64((1 << own % 64) - 1)
    heads[:, own // 64 + 1 :] = 0
    for a in range(0, len(first), 64):
        some = first[a : a + 64]
        found = np.bitwise_count(masks[some][:, None, :] & masks[second][None, :, :]).sum(axis=2) >= shared
        found &= ~(heads[some][:, None, :] & heads[second][None, :, :]).any(axis=2)
        i, j = np.nonzero(found)
        x, y = some[i], second[j]
        near = footrule(local[x], local[y]) <= far
        x, y = x[near], y[near]
        yes = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
        yield x[yes], y[yes]


def link_classes(vectors: DataFrame, threshold: float, lists: int = LISTS, shared: int = SHARED, far: int = FAR, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """(cid, links, root): links of a class found in one task, and the smallest class linked to it there."""
    vectors = cut(vectors)
    pivots = pivots_of(vectors, vectors.count())
    described = cut(index(vectors, pivots, nearest))
    if len(pivots) <= nearest:
        # Where no more pivots lie apart than a vector has, their order tells little: one list holds all, and all pairs are candidates.
        lists, shared, far, nearest = 1, len(pivots), 2 * nearest * nearest, len(pivots)
        described = described.withColumn("permutation", F.sort_array("permutation"))
    keys = ["label", "dim", "pivot"]
    stands = described.withColumn("pivot", F.explode(F.slice("permutation", 1, lists)))
    # Lists longer than a block. They are broadcast if few; beyond that they are joined as they come.
    long_lists = cut(stands.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block))
    if long_lists.count() <= MOST_BROADCAST:
        long_lists = F.broadcast(long_lists)
    blocks = F.coalesce(F.ceil(F.col("size") / F.lit(block)), F.lit(1)).cast("int")
    placed = stands.join(long_lists, keys, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Block pairs (i, j) with i <= j that hold the vector's own block.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    tasks = placed.withColumn("pair", F.explode(pairs)).select(*keys, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "cid", "n", "embedding", "permutation")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
        if len(group) < 2:
            return nothing
        pivot, i, j = (int(group[c].iat[0]) for c in ("pivot", "i", "j"))
        permutations = np.stack(group["permutation"].to_numpy())
        unit = _unit(group["embedding"].tolist(), int(group["dim"].iat[0]))
        own, n, cid = group["own"].to_numpy(), group["n"].to_numpy(np.int64), group["cid"].tolist()
        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, forest = np.zeros(len(group), np.int64), Forest()
        for x, y in _linked(pivot, first, second, permutations, lists, shared, far, unit, threshold):
            if i == j:
                x, y = x[x < y], y[x < y]
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                forest.join(cid[p], cid[q])
        some = np.flatnonzero(links)
        return pd.DataFrame({"cid": [cid[k] for k in some], "links": links[some], "root": [forest.root(cid[k]) for k in some]}).astype("int64") if len(some) else nothing

    return tasks.groupBy(*keys, "i", "j").applyInPandas(run, "cid long, links long, root long")


def near_duplicates(table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept."""
    vector = table[vector_col].cast("array<double>")
    rows = table.select(table[id_col].cast("long").alias("vec_id"), vector.alias("embedding"), table[label_col].cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.select("label", F.size("embedding").alias("dim"), "cid", "n", "embedding"))

    found = cut(link_classes(classes, threshold))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    decided = classes.join(counts, "cid", "left").join(roots, "cid", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")
    )
    # Rows that can't link have a null key and stay unmatched; a random key keeps them from meeting in one task.
    keyed = rows.withColumn("embedding", F.when(usable, F.col("embedding"))).withColumn("label", F.when(usable, F.col("label")).otherwise(F.concat(F.lit("-"), F.col("vec_id").cast("string"))))
    out = keyed.join(decided, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
