"""Exact deduplication on whitespace-free text, with DataFrame expressions only.

Three combining stages, each of which groups by digest *and* full normalised text, so that two texts are merged only
if their contents are equal:

1. local: equal texts of one map task are combined inside the task, before anything is shuffled (they share a salt);
2. salted: what is left meets by (digest, text, salt), so the copies of one text are spread over ``salts`` tasks;
3. global: the at most ``salts`` winners of each text meet by (digest, text).

The decisions go back to the rows by digest. That no digest stands for two texts is seen in the global stage; should
one do so, its rows, and only they, are matched by their text. A hot digest's rows aren't collected: the join is a plain
sort-merge join, which AQE splits.

Defined results: null text counts as empty; empty texts form one group; a null ``doc_id`` loses against any other id
(``keep_id`` is null only if all ids of a group are); ``kept`` is true for the rows whose code points and id are those of
the winner, so rows that agree in both share their decision (:func:`keep_first` keeps one of them); an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm.rows import one_each, packed
from strataquill.session import cut

#: The characters that are deleted before texts are compared. (fixed values)
WHITE_SPACE = " \t\n\x0b\x0c\r"

_TOP = str(2**63)


def normalised(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _rank(doc_id: Column, text: Column) -> Column:
    """A 30-digit number that is larger for more code points, then for a smaller id; decimals keep the hash aggregate."""
    points = F.char_length(F.coalesce(text, F.lit(""))).cast("string")
    shifted = F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)")
    digits = F.concat(F.lpad(points, 10, "0"), F.lpad(F.coalesce(shifted.cast("string"), F.lit("0")), 20, "0"))
    return digits.cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    shifted = F.substring(F.lpad(rank.cast("string"), 30, "0"), 11, 20).cast("decimal(20,0)")
    return F.when(shifted > 0, F.lit(_TOP).cast("decimal(20,0)") - shifted).cast("long")


_KEYS = ["digest", "second", "len"]


def _keys(norm: Column) -> dict[str, Column]:
    """Two texts of one digest would be told apart by length and a second hash; what these don't tell apart, content does."""
    return {"digest": F.coalesce(F.unhex(F.sha2(norm, 256)), F.lit(b"")), "second": F.xxhash64(norm), "len": F.octet_length(norm)}


def _winners(docs: DataFrame, salts: int) -> DataFrame:
    """The keys, norm, best and group_size of each text of ``docs`` (doc_id, text)."""
    norm = normalised(F.col("text"))
    texts = docs.select(_rank(F.col("doc_id"), F.col("text")).alias("rank"), norm.alias("norm"), *(c.alias(k) for k, c in _keys(norm).items()))
    # All copies in one map task have one salt, so they are combined there.
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    salted = texts.groupBy(*_KEYS, "norm", salt).agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy(*_KEYS, "norm").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))


def decided(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and others) but text, with its keys, rank, best and group_size."""
    winners = cut(_winners(docs, salts).drop("norm"), free=True)
    norm = normalised(F.col("text"))
    rows = docs.withColumns({**_keys(norm), "rank": _rank(F.col("doc_id"), F.col("text"))})
    several = winners.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEYS)
    if several.isEmpty():
        return rows.drop("text").join(winners, _KEYS)
    alone = rows.join(several, _KEYS, "left_anti").drop("text").join(winners, _KEYS)
    same = rows.join(several, _KEYS, "left_semi").withColumn("norm", norm)
    again = _winners(docs.withColumns(_keys(norm)).join(several, _KEYS, "left_semi"), salts)
    return alone.unionByName(same.drop("text").join(again, [*_KEYS, "norm"]).drop("norm"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    told = decided(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), salts)
    return told.select(
        "doc_id",
        _id_of(F.col("best")).alias("keep_id"),
        "group_size",
        (F.col("rank") == F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: of rows that agree in code points and id, one with the
    smallest hash of all columns. No text is lost, also where ids are null or stand for several texts."""
    rows = packed(docs, id_col, text_col)
    told = decided(rows.select("doc_id", "text", "key"), salts)
    chosen = told.where("rank = best").groupBy(*_KEYS, "rank").agg(F.min("key").alias("key"))
    found = rows.withColumns({**_keys(normalised(F.col("text"))), "rank": _rank(F.col("doc_id"), F.col("text"))}).select("row", *_KEYS, "rank", "key")
    return one_each(found.join(chosen, [*_KEYS, "rank", "key"]), *_KEYS, "rank", "key")
