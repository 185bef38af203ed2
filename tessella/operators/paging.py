"""Ordered pages by keyset: value and id after a cursor, nulls last, exact reverse for going back."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sort:
    value: str
    descending: bool = True
    id: str = "id"

    def order(self, reverse: bool = False) -> list[Column]:
        """Null values stand last (first in reverse); ids decide ties, newest first."""
        v = F.col(self.value)
        if self.descending != reverse:
            first = v.desc_nulls_first() if reverse else v.desc_nulls_last()
        else:
            first = v.asc_nulls_first() if reverse else v.asc_nulls_last()
        return [first, F.col(self.id).asc() if reverse else F.col(self.id).desc()]

    def beyond(self, cursor: tuple, kind: str, reverse: bool = False) -> Column:
        """Strictly after the cursor (value or None, id), or before it in reverse."""
        value, row = cursor
        v, i = F.col(self.value), F.col(self.id)
        next_id = i > row if reverse else i < row
        if value is None:
            return v.isNotNull() | (v.isNull() & next_id) if reverse else v.isNull() & next_id
        c = F.lit(value).cast(kind)
        further = (v < c) if self.descending != reverse else (v > c)
        return further | ((v == c) & next_id) | (F.lit(False) if reverse else v.isNull())


def encode(value: object, row: int) -> str:
    return f"~{row}" if value is None else f"{quote(str(value), safe='')}~{row}"


def decode(cursor: str) -> tuple[str | None, int]:
    value, tilde, row = cursor.rpartition("~")
    if not row.lstrip("-").isdigit():
        raise ValueError(f"not a cursor: {cursor}")
    return (unquote(value) if tilde and value else None), int(row)


def page(df: DataFrame, sort: Sort, limit: int = 50, cursor: str | tuple | None = None, reverse: bool = False) -> DataFrame:
    """At most so many rows (1 to 200) beyond a cursor; plans as a top-k, not as a full sort."""
    limit = min(max(limit, 1), 200)
    if cursor is not None:
        at = decode(cursor) if isinstance(cursor, str) else cursor
        df = df.where(sort.beyond(at, dict(df.dtypes)[sort.value], reverse))
    return df.orderBy(*sort.order(reverse)).limit(limit)


def neighbours(df: DataFrame, sort: Sort, row: int) -> DataFrame:
    """Previous and next id around one row of the list, each by a page of one."""
    value = df.where(F.col(sort.id) == row).select(sort.value).first()
    if value is None:
        return df.sparkSession.createDataFrame([], "side string, id long")
    at = (value[0], row)
    one = lambda side, reverse: page(df, sort, 1, at, reverse).select(F.lit(side).alias("side"), F.col(sort.id).cast("long").alias("id"))
    return one("previous", True).unionByName(one("next", False))


def all_neighbours(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """Previous and next of every row within its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"previous_id": F.lag(id_col).over(w), "next_id": F.lead(id_col).over(w)})


def after(columns: list[str], values: list, kinds: list[str]) -> Column:
    """Row comparison: the columns, in order, are greater than the values."""
    out = F.lit(False)
    for i in range(len(columns)):
        same = F.lit(True)
        for j in range(i):
            same = same & (F.col(columns[j]) == F.lit(values[j]).cast(kinds[j]))
        out = out | (same & (F.col(columns[i]) > F.lit(values[i]).cast(kinds[i])))
    return out


def ids_below(df: DataFrame, id_col: str, cursor: int | None, limit: int) -> DataFrame:
    return (df if cursor is None else df.where(F.col(id_col) < cursor)).orderBy(F.col(id_col).desc()).limit(limit)


def priority(col: str, names: list[str]) -> Column:
    """Position in a fixed list; others come after it."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col(col))
    return F.when(at > 0, at).otherwise(len(names) + 1)


def exported(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)
