"""Dates with a precision: spans, labels, parsing, hygiene rules, windows of the week."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What people say of dates, and the month or decade that it stands for; words of doubt in front of a date.
MONTHS = "january february march april may june july august september october november december".split()
SEASONS = {"spring": 4, "summer": 7, "autumn": 10, "fall": 10, "winter": 1}
FEASTS = {"christmas": 12, "xmas": 12}
DECADES = {"twenties": 1920, "thirties": 1930, "forties": 1940, "fifties": 1950, "sixties": 1960, "seventies": 1970, "eighties": 1980, "nineties": 1990}
HEDGES = "maybe probably possibly approx approximately about around circa ca abt sometime in during the early mid late".split()
FIRST_YEAR, LAST_YEAR = 1800, 2100
#: Years of two digits from here on are of the 20th century.
CENTURY = 30


def span(date: Column, precision: Column) -> Column:
    """Closed range of days that a date of a precision stands for: struct(lo, hi); null for a null date."""
    decade = (F.floor(F.year(date) / 10) * 10).cast("int")
    lo = F.when(precision == "decade", F.make_date(decade, F.lit(1), F.lit(1))).when(precision == "year", F.trunc(date, "year")).when(precision == "month", F.trunc(date, "month")).otherwise(date.cast("date"))
    hi = F.when(precision == "decade", F.make_date(decade + 9, F.lit(12), F.lit(31))).when(precision == "year", F.make_date(F.year(date), F.lit(12), F.lit(31))).when(precision == "month", F.last_day(date)).otherwise(date.cast("date"))
    return F.when(date.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def json_span(payload: Column, date_path: str = "$.date", precision_path: str = "$.precision") -> Column:
    """The span of a JSON payload; null, not an error, where it isn't a date."""
    text = F.get_json_object(payload, date_path)
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return span(date, F.coalesce(F.get_json_object(payload, precision_path), F.lit("exact")))


def overlaps(lo: Column, hi: Column, q_lo: Column, q_hi: Column) -> Column:
    """Null bounds are open."""
    return (q_hi.isNull() | lo.isNull() | (lo <= q_hi)) & (q_lo.isNull() | hi.isNull() | (hi >= q_lo))


def contained(lo: Column, hi: Column, q_lo: Column, q_hi: Column) -> Column:
    return (q_lo.isNull() | (lo >= q_lo)) & (q_hi.isNull() | (hi <= q_hi)) & lo.isNotNull() & hi.isNotNull()


def label(date: Column, precision: Column) -> Column:
    return F.when(date.isNull(), F.lit(None).cast("string")).when(precision == "decade", F.concat((F.floor(F.year(date) / 10) * 10).cast("string"), F.lit("s"))).when(precision == "year", F.year(date).cast("string")).when(precision == "month", F.date_format(date, "MMMM yyyy")).otherwise(F.date_format(date, "d MMMM yyyy"))


def range_label(lo: Column, hi: Column) -> Column:
    a, b = F.year(lo).cast("string"), F.year(hi).cast("string")
    return F.when(lo.isNull() & hi.isNull(), F.lit(None).cast("string")).when(lo.isNull(), F.concat(F.lit("before "), b)).when(hi.isNull(), F.concat(F.lit("after "), a)).when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))


def placement(date: Column, precision: Column, confirmed: Column) -> Column:
    """Folder of a dated thing: year/month, year, decade, or Unsorted."""
    known = date.isNotNull() & F.coalesce(confirmed, F.lit(False))
    return F.when(known & precision.isin("exact", "day", "month"), F.date_format(date, "yyyy/MM")).when(known & (precision == "year"), F.date_format(date, "yyyy")).when(known & (precision == "decade"), F.concat((F.floor(F.year(date) / 10) * 10).cast("string"), F.lit("s"))).otherwise("Unsorted")


def shift_month(month: Column, by: int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), by), "yyyy-MM")


def months_apart(a: Column, b: Column) -> Column:
    n = lambda d: F.year(d) * 12 + F.month(d)
    return F.abs(n(a) - n(b))


#: Fixed value: no photograph is older.
FIRST_PHOTO = 1826


def unset_clock(t: Column) -> Column:
    """The first minute of a year: a camera clock that was never set."""
    return (F.month(t) == 1) & (F.dayofmonth(t) == 1) & (F.hour(t) == 0) & (F.minute(t) == 0)


def hygiene_flags(date: Column, clock: Column, folder_month: Column, added: Column, is_scan: Column, most_months: int = 3, first_year: int = FIRST_PHOTO) -> Column:
    """Array of the rules that a confirmed date breaks, in order: a is a scan, whose clock says when it was scanned; b the clock
    that gave it was never set; c is far from the folder's month; d is after the thing was added, or too early. Empty if no date."""
    rules = [
        ("a", is_scan),
        ("b", clock.isNotNull() & unset_clock(clock)),
        ("c", folder_month.isNotNull() & (months_apart(date, folder_month) > most_months)),
        ("d", (date.cast("date") > added.cast("date")) | (F.year(date) < first_year)),
    ]
    return F.when(date.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])))


def ingest_reason(taken: Column, is_scan: Column, modified: Column) -> Column:
    """Why a camera's date can't be taken for a fact as it arrives; null if it can, or if there is none. A file may be dated
    a day after it was modified, as it may come from another time zone."""
    late = F.coalesce(taken > modified + F.expr("interval 1 day"), F.lit(False))
    return F.when(taken.isNull(), F.lit(None).cast("string")).when(F.coalesce(is_scan, F.lit(False)), "scanner_clock").when(unset_clock(taken), "unset_camera_clock").when((F.year(taken) < FIRST_PHOTO) | late, "implausible_date")


def first_rule(flags: Column) -> Column:
    return F.get(flags, F.lit(0))


def date_fields(date: Column, precision: Column) -> Column:
    """Typed outputs of a dated thing: the day if known, the year, a text."""
    exact = precision.isin("exact", "day")
    return F.struct(F.when(exact, date).alias("day"), F.when(precision != "decade", F.year(date)).alias("year"), label(date, precision).alias("text"))


# A date in free text is read in two steps. Its tokens, runs of digits, runs of letters and single signs, become a string of
# kinds, a letter each, and what means nothing between others is taken out of it; what is left must be one of READINGS.

_TOKEN = "[0-9]+|[a-z]+|[^0-9a-z \\t\\n\\r\\f\\x0B]"

#: Kind and value of each known word: Month, Season, feast (X) and Decade have a value; of, ordinal endings, the plural s,
#: words of doubt (h; c needs its full stop; "some time" is p and q) have none. Numbers are i (one digit), n (two), y (four) or z.
LEXICON: dict[str, tuple[str, int | None]] = {
    **{w: ("M", i) for i, name in enumerate(MONTHS, 1) for w in (name, name[:3])},
    **{"sept": ("M", 9), "of": ("f", None), "s": ("s", None), "c": ("c", None), "some": ("p", None), "time": ("q", None)},
    **{w: (kind, v) for kind, words in (("S", SEASONS), ("X", FEASTS), ("D", DECADES)) for w, v in words.items()},
    **{w: ("h", None) for w in HEDGES},
    **{w: ("o", None) for w in ("st", "nd", "rd", "th")},
}
_SIGNS = {"/": "/", "-": "-", ".": ".", ",": ",", "'": "'", "’": "'", "?": "!", "!": "!"}

#: Taken out, or made alike, in this order.
_NOISE = (
    (r"^(?:h\.?|c\.|pq)+", ""),
    (r"!+$", ""),
    (r"'(?=s)", ""),
    (r"i(?!s)", "n"),
    (r"(?<=n)o", ""),
    (r"(?<=M)\.", ""),
    (r"(?<=[MSXn])f(?=[nyM])", ""),
    (r"(?<=[Mn]),(?=y)", ""),
)

#: What the values of a string of kinds are, in order: year, month and day.
READINGS = {"y": "y", "ys": "y", "ns": "y", "D": "y", "My": "my", "Sy": "my", "Xy": "my", "y-n": "ym", "n/y": "my", "n-y": "my", "Mny": "mdy", "nMy": "dmy", "y-n-n": "ymd", "n/n/y": "mdy", "n.n.y": "mdy"}


def _precision(core: str) -> str:
    return "decade" if core[-1] in "sD" else "year" if core[0] == "S" else ("year", "month", "exact")[len(READINGS[core]) - 1]


def free_date(x: Column) -> Column:
    """Free text ("March 1962", "the sixties", "12th of March, 1962", "around 1962?") to struct(date, precision); null if it has
    none of READINGS or is no day of the calendar. A decade is dated to its start, a season to a month in its middle."""
    table = lambda pairs: F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    kinds, worth = table((w, k) for w, (k, _) in LEXICON.items()), table((w, v) for w, (_, v) in LEXICON.items() if v)
    signs, by_length = table(_SIGNS.items()), table([(1, "i"), (2, "n"), (4, "y")])

    def kind(w: Column) -> Column:
        return F.coalesce(kinds[w], signs[w], F.when(w.rlike("^[0-9]"), F.coalesce(by_length[F.length(w)], F.lit("z"))), F.lit("_"))

    def value(w: Column) -> Column:
        return F.coalesce(worth[w], F.when(w.rlike("^[0-9]{1,4}$"), w.try_cast("int")))

    def core(tokens: Column) -> Column:
        out = F.array_join(F.transform(tokens, kind), "")
        for pattern, to in _NOISE:
            out = F.regexp_replace(out, pattern, to)
        return out

    def read(t: Column) -> Column:
        roles = table(READINGS.items())[t["core"]]
        part = lambda role: F.get(t["values"], F.instr(roles, role) - 1)
        precision = table((c, _precision(c)) for c in READINGS)[t["core"]]
        y = part("y") + F.when(part("y") < CENTURY, 2000).when(part("y") < 100, 1900).otherwise(0)
        first = F.when(precision == "decade", (F.floor(y / 10) * 10).cast("int")).otherwise(y)
        # a string, as a day that doesn't exist is an error for make_date
        date = F.try_to_date(F.format_string("%04d-%02d-%02d", first, F.coalesce(part("m"), F.lit(1)), F.coalesce(part("d"), F.lit(1))), "yyyy-MM-dd")
        return F.when(y.between(FIRST_YEAR, LAST_YEAR) & date.isNotNull(), F.struct(date.alias("date"), precision.alias("precision")))

    # variables of lambdas: what they hold is worked out once, not again for each use
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    tokens = F.regexp_extract_all(F.lower(x), F.lit(_TOKEN), F.lit(0))
    return once(once(tokens, lambda t: F.struct(core(t).alias("core"), F.array_compact(F.transform(t, value)).alias("values"))), read)


@dataclass(frozen=True)
class Parsed:
    date: dt.date
    precision: str


def lexed(text: str, more: dict[str, str] | None = None) -> tuple[str, list[int]]:
    """The kinds of a text's tokens, without noise, and the values of those that have one. more: kinds of further words."""
    kinds, values = "", []
    for w in re.findall(_TOKEN, text.lower()):
        kind, value = LEXICON.get(w) or (_SIGNS.get(w, "_"), None)
        if w.isdigit() and w.isascii():
            kind, value = {1: "i", 2: "n", 4: "y"}.get(len(w), "z"), int(w) if len(w) <= 4 else None
        kinds += (more or {}).get(w, kind)
        values += [value] if value is not None else []
    for pattern, to in _NOISE:
        kinds = re.sub(pattern, to, kinds)
    return kinds, values


def parse_free(text: str | None) -> Parsed | None:
    """free_date for what is typed into a query, by the same tables."""
    core, values = lexed(text or "")
    if core not in READINGS:
        return None
    said, precision = dict(zip(READINGS[core], values)), _precision(core)
    y = said["y"] + (2000 if said["y"] < CENTURY else 1900 if said["y"] < 100 else 0)
    try:
        found = dt.date(y - y % 10 if precision == "decade" else y, said.get("m", 1), said.get("d", 1))
    except ValueError:
        return None
    return Parsed(found, precision) if FIRST_YEAR <= y <= LAST_YEAR else None


@dataclass(frozen=True)
class WeekWindow:
    """A weekly window, Monday 0; it may wrap past midnight. from_spec("mon-fri 22:00-06:00")."""

    days: frozenset[int]
    start: int
    end: int

    @staticmethod
    def from_spec(spec: str) -> WeekWindow:
        names = "mon tue wed thu fri sat sun".split()
        m = re.fullmatch(r"(?:([a-z]{3})(?:-([a-z]{3}))? )?(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})", spec.strip().lower())
        if not m:
            raise ValueError(f"not a window: {spec}")
        a, b = (names.index(m[1]), names.index(m[2] or m[1])) if m[1] else (0, 6)
        days = range(a, b + 1) if a <= b else [*range(a, 7), *range(b + 1)]
        return WeekWindow(frozenset(days), int(m[3]) * 60 + int(m[4]), int(m[5]) * 60 + int(m[6]))

    def contains(self, t: Column) -> Column:
        day, minute = F.weekday(t), F.hour(t) * 60 + F.minute(t)
        own, before = day.isin(*self.days), F.pmod(day + 6, F.lit(7)).isin(*self.days)
        if self.start < self.end:
            return own & (minute >= self.start) & (minute < self.end)
        return own & (minute >= self.start) | before & (minute < self.end)
