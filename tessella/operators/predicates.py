"""Composable filters, row-level visibility, scopes and selectors. Everything is a lazy DataFrame or a Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce
from urllib.parse import parse_qsl, quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIASES = {"from": "year_from", "to": "year_to", "q": "text", "person": "person_id", "place": "place_id", "album": "album_id"}


@dataclass
class Filters:
    """Browse filters; unset ones don't restrict."""

    year: int | None = None
    decade: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    person_id: int | None = None
    place_id: int | None = None
    album_id: int | None = None
    no_date: bool = False
    untagged: bool = False
    min_completeness: int | None = None
    text: str | None = None

    @staticmethod
    def parse(query: str) -> Filters:
        """From a query string; unknown keys and bad numbers are ignored, aliases are accepted."""
        out, kinds = Filters(), {f.name: str(f.type) for f in fields(Filters)}
        for k, v in parse_qsl(query):
            k = ALIASES.get(k, k)
            if k not in kinds:
                continue
            if kinds[k].startswith("bool"):
                setattr(out, k, v.lower() in ("1", "true", "yes", "on"))
            elif kinds[k].startswith("int"):
                if v.lstrip("-").isdigit():
                    setattr(out, k, int(v))
            else:
                setattr(out, k, v.strip() or None)
        return out


@dataclass
class Columns:
    """Which columns a filter reads, and the membership tables (id, key) behind the key filters."""

    id: str = "id"
    date: str = "date"
    texts: tuple[str, ...] = ()
    completeness: str | None = None
    people: DataFrame | None = None
    places: DataFrame | None = None
    albums: DataFrame | None = None
    unknown_faces: DataFrame | None = None


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def member_of(df: DataFrame, members: DataFrame, key: int | str | None, id_col: str) -> DataFrame:
    chosen = members if key is None else members.where(F.col("key") == key)
    return df.join(chosen.select(F.col("id").alias("__id")).distinct(), df[id_col] == F.col("__id"), "left_semi")


def apply_filters(df: DataFrame, f: Filters, c: Columns) -> DataFrame:
    """The AND of all set filters: plain predicates reach the scan, memberships become semi joins."""
    year = F.year(c.date)
    parts = []
    if f.year is not None:
        parts.append(year == f.year)
    if f.decade is not None:
        parts.append(year.between(f.decade, f.decade + 9))
    if f.year_from is not None:
        parts.append(year >= f.year_from)
    if f.year_to is not None:
        parts.append(year <= f.year_to)
    if f.no_date:
        parts.append(F.col(c.date).isNull())
    if f.min_completeness is not None and c.completeness:
        parts.append(F.col(c.completeness) >= f.min_completeness)
    if f.text and c.texts:
        parts.append(reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(f.text.lower())) for t in c.texts]))
    df = df.where(every(parts)) if parts else df
    for key, table in ((f.person_id, c.people), (f.place_id, c.places), (f.album_id, c.albums)):
        if key is not None and table is not None:
            df = member_of(df, table, key, c.id)
    if f.untagged and c.unknown_faces is not None:
        df = member_of(df, c.unknown_faces, None, c.id)
    return df


@dataclass
class Access:
    """Who may see what: (row id, group) and (group, user) memberships, live rows only."""

    row_groups: DataFrame
    group_members: DataFrame
    row_id: str = "id"
    group: str = "group_id"
    user: str = "user_id"


def visible(df: DataFrame, access: Access, user: int | None, id_col: str, admin: bool = False, deleted: Column | None = None, private: Column | None = None) -> DataFrame:
    """Rows that are not deleted, not private, and (for all but an admin) share a group with the user."""
    for flag in (deleted, private):
        if flag is not None:
            df = df.where(~F.coalesce(flag, F.lit(False)))
    if admin:
        return df
    mine = access.group_members.where(F.col(access.user) == user).select(F.col(access.group).alias("__g"))
    ids = access.row_groups.join(mine, F.col(access.group) == F.col("__g"), "left_semi").select(F.col(access.row_id).alias("__id"))
    return df.join(ids, df[id_col] == F.col("__id"), "left_semi")


def is_visible(df: DataFrame, access: Access, user: int | None, id_col: str, row: int, **options) -> bool:
    return not visible(df.where(F.col(id_col) == row), access, user, id_col, **options).isEmpty()


def scoped(df: DataFrame, access: Access, id_col: str, scope: str | int = "all") -> DataFrame:
    """'all', 'unfiled' (in no group) or one group's rows."""
    ids = access.row_groups.select(F.col(access.row_id).alias("__id"), F.col(access.group).alias("__g"))
    if scope == "all":
        return df
    if scope == "unfiled":
        return df.join(ids, df[id_col] == F.col("__id"), "left_anti")
    return df.join(ids.where(F.col("__g") == scope), df[id_col] == F.col("__id"), "left_semi")


def missing_pairs(df: DataFrame, ids: list[int], existing: DataFrame, id_col: str, key: str) -> DataFrame:
    """Every row paired with every key of a list, but for pairs that exist."""
    pairs = df.select(F.col(id_col), F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias(key))
    return pairs.join(existing, [id_col, key], "left_anti")


def exact_or_prefix(col: str, wanted: str) -> Column:
    """Equal, or starting with what stands before a trailing star."""
    return F.col(col).startswith(wanted[:-1]) if wanted.endswith("*") else F.col(col) == wanted


def eligible(df: DataFrame, jobs: DataFrame, id_col: str, job: str, model: str, version: str) -> DataFrame:
    """Rows whose job entry is missing, not done, or of another model or version."""
    mine = jobs.where(F.col("job") == job).select(F.col("id").alias("__id"), "status", "model", "version")
    j = df.join(mine, df[id_col] == F.col("__id"), "left")
    due = F.col("__id").isNull() | (F.coalesce("status", F.lit("")) != "done") | (F.coalesce("model", F.lit("")) != model) | (F.coalesce("version", F.lit("")) != version)
    return j.where(due).select(*df.columns)


def none_of(df: DataFrame, others: list[DataFrame], id_col: str) -> DataFrame:
    """Rows whose id is in none of the tables (of one column each)."""
    for o in others:
        df = df.join(o.select(F.col(o.columns[0]).alias("__id")), df[id_col] == F.col("__id"), "left_anti")
    return df


def tombstones(df: DataFrame, deleted_at: str, synced_at: str, announced_at: str) -> DataFrame:
    """Once synced, now gone, not yet announced since."""
    return df.where(F.col(synced_at).isNotNull() & F.col(deleted_at).isNotNull() & (F.col(announced_at).isNull() | (F.col(announced_at) < F.col(deleted_at))))


def not_absolute(path: str) -> Column:
    return ~F.col(path).rlike(r"^([A-Za-z]:\\|/)")


@dataclass
class Target:
    """A text that corrections may look at: a table, a name, an expression and what to show beside it."""

    table: str
    name: str
    value: Callable[[], Column]
    context: Callable[[], Column]
    id_col: str = "id"


@dataclass
class Targets:
    items: list[Target] = field(default_factory=list)

    def add(self, table: str, column: str, context: str, id_col: str, json_path: str | None = None) -> None:
        value = (lambda: F.get_json_object(column, json_path)) if json_path else (lambda: F.col(column))
        self.items.append(Target(table, f"{table}.{column}{json_path or ''}", value, lambda: F.col(context).cast("string"), id_col))


def search_targets(tables: Callable[[str], DataFrame], targets: Targets, needle: str, match_case: bool = False) -> DataFrame:
    """target, id, value, context of every text that holds the needle."""
    from ..functions.text import holds

    parts = [tables(t.table).where(holds(t.value(), needle, match_case)).select(F.lit(t.name).alias("target"), F.col(t.id_col).cast("long").alias("id"), t.value().alias("value"), t.context().alias("context")) for t in targets.items]
    return reduce(DataFrame.unionByName, parts)


#: List keys: code letter -> filter field, and sort names by code.
LIST_FILTERS = {"p": "person_id", "l": "place_id", "a": "album_id", "y": "year", "d": "decade"}


def list_key(f: Filters, sort: str) -> str:
    for code, name in LIST_FILTERS.items():
        if getattr(f, name) is not None:
            return f"{code}.{getattr(f, name)}"
    return f"nd.{sort}" if f.no_date else f"b.{quote(sort)}"


def parse_list_key(key: str) -> tuple[Filters, str | None]:
    code, _, rest = key.partition(".")
    if code in LIST_FILTERS and rest.lstrip("-").isdigit():
        return Filters(**{LIST_FILTERS[code]: int(rest)}), None
    if code == "nd":
        return Filters(no_date=True), unquote(rest) or None
    if code == "b":
        return Filters(), unquote(rest) or None
    raise ValueError(f"not a list key: {key}")
