"""Rows as wholes: operators that filter tables carry each row as a struct, so that no column name can clash with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns), doc_id, text, and key, a hash of all columns."""
    row = F.struct(*(docs[c] for c in docs.columns))
    return docs.select(row.alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(row).alias("key"))


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The columns of ``row``, for one row of each value of ``keys``; after a join on these no row moves again."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[-1]))
    return rows.select("row", *keys, first.alias("place")).where("place = 1").select("row.*")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
