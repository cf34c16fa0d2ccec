"""Listings: filter, search, sort and page, with the author of each row and the exact count."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ListQuery:
    """What a caller asks for. A filter whose value is ``all`` or None is off, and so is a blank
    search or a threshold of 0."""

    equal: dict[str, object] = field(default_factory=dict)
    search: str = ""
    search_in: str = "title"
    least: dict[str, float] = field(default_factory=dict)
    sort: list[str] = field(default_factory=list)
    key: str = "id"
    page: int = 0
    limit: int = 20


def filtered(df: DataFrame, q: ListQuery) -> DataFrame:
    for name, value in q.equal.items():
        if value is not None and value != "all":
            df = df.filter(F.col(name) == F.lit(value))
    for name, value in q.least.items():
        if value > 0:
            df = df.filter(F.col(name) >= F.lit(value))
    text = q.search.strip()
    return df.filter(F.col(q.search_in).ilike(f"%{text}%")) if text else df


def ordered(q: ListQuery) -> list[Column]:
    """Descending keys; the row's key breaks ties so that pages don't overlap."""
    return [*(F.col(c).desc_nulls_last() for c in q.sort), F.col(q.key).asc_nulls_last()]


def page(df: DataFrame, q: ListQuery) -> DataFrame:
    """Rows of one page: a top-k of offset + limit rows, not a sort of the table."""
    return filtered(df, q).orderBy(*ordered(q)).offset(q.page * q.limit).limit(q.limit)


def total(df: DataFrame, q: ListQuery) -> DataFrame:
    return filtered(df, q).agg(F.count("*").alias("total_count"))


def page_with_authors(df: DataFrame, authors: DataFrame, q: ListQuery, on: str, key: str, columns: list[str], name: str = "author") -> DataFrame:
    """The page first, the lookup after, in the page's order. The page has ``limit`` rows and is
    broadcast to the authors, whose number doesn't matter then; those that it names are broadcast
    back. A row without an author stays, with a null. Keys of authors are unique. The page is kept
    for its second use, so that the content is scanned and cut once; it is made anew if it is lost."""
    rows = page(df, q).persist()
    side = authors.select(F.col(key).alias("_key"), F.struct(*columns).alias(name))
    named = side.join(F.broadcast(rows.select(on)), F.col(on) == F.col("_key"), "left_semi")
    found = rows.join(F.broadcast(named), F.col(on) == F.col("_key"), "left").drop("_key")
    return found.orderBy(*ordered(q)).limit(q.limit)


def page_count(n: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / limit)).cast("bigint")


def page_buttons(pages: DataFrame, n: str, at: str, most: int = 10, before: int = 4) -> DataFrame:
    """One row for each button of a window of at most ``most`` pages around page ``at``."""
    start = F.greatest(F.lit(0), F.least(F.col(at) - before, F.col(n) - most))
    stop = F.least(F.col(n), start + most) - 1
    return pages.withColumn("button", F.explode(F.sequence(start, stop)))


def keyset_page(df: DataFrame, q: ListQuery, after: tuple) -> DataFrame:
    """Extension: the page after a row (its sort values and key), at the cost of a first page."""
    names = [*q.sort, q.key]
    past = F.lit(False)
    for i, name in enumerate(names):
        same = F.lit(True)
        for j in range(i):
            same = same & (F.col(names[j]) == F.lit(after[j]))
        past = past | (same & (F.col(name) > F.lit(after[i]) if name == q.key else F.col(name) < F.lit(after[i])))
    return filtered(df, q).filter(past).orderBy(*ordered(q)).limit(q.limit)


def one(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this key; the caller asserts that there is just one."""
    return df.filter(F.col(key) == F.lit(value))


def probe(df: DataFrame, **equal: object) -> DataFrame:
    """At most two rows that match: none, one, or an error."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.limit(2)


def flagged(items: DataFrame, marks: DataFrame, on: list[str], name: str) -> DataFrame:
    """``items`` with a flag: whether ``marks`` holds their key."""
    return items.join(marks.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def free_names(wanted: DataFrame, taken: DataFrame, name: str, key: str) -> DataFrame:
    """Rows of ``wanted`` (key, name) whose name, in lower case, nobody else holds."""
    other = taken.select(F.lower(name).alias("_name"), F.col(key).alias("_other"))
    return wanted.join(other, (F.lower(name) == F.col("_name")) & (F.col(key) != F.col("_other")), "left_anti")


def translated(df: DataFrame, dictionary: DataFrame, key: str, out: str) -> DataFrame:
    """The text of each key, or the key itself. ``dictionary``: key, text; few rows."""
    side = dictionary.select(F.col("key").alias("_key"), F.col("text").alias("_text"))
    return df.join(side, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_text", key)).drop("_key", "_text")
