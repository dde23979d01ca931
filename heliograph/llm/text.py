"""Words, lines and folds, in the one way all operators use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def value(df: DataFrame, name: str, kind: str) -> Column:
    """A column of df, typed; null where df has none of that name."""
    have = {c.lower(): c for c in df.columns}
    return (df[f"`{have[name.lower()]}`"] if name.lower() in have else F.lit(None)).cast(kind)


def columns(df: DataFrame, **defaults: str) -> DataFrame:
    """df with just these columns, typed; one that is missing is null."""
    return df.select(*[value(df, k, t).alias(k) for k, t in defaults.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until df has no column called so."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def own(df: DataFrame) -> list[Column]:
    """All columns of df by name, whatever dots their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]
