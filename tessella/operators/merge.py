"""Merging and replaying. Tables don't change in place: a mutation gives the new table and the log of what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def incoming_wins(theirs: Column, ours: Column) -> Column:
    """Last writer wins by the time of the human edit; a tie goes to the incoming side."""
    return theirs.isNotNull() & (ours.isNull() | (theirs >= ours))


def _pair(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    s = stored.select(*[F.col(c).alias(f"s_{c}") for c in stored.columns], F.lit(True).alias("s__"))
    i = incoming.select(*[F.col(c).alias(f"i_{c}") for c in incoming.columns], F.lit(True).alias("i__"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"s_{k}") == F.col(f"i_{k}"))
    return s.join(i, cond, "full_outer")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], guarded: dict[str, str] | None = None, newer: str | None = None, floor: int | None = None) -> DataFrame:
    """Incoming rows replace stored ones. A guarded column (column -> edit time) keeps the stored value where the stored
    edit is newer; `newer` drops incoming rows that are strictly older; ids at or above the floor are left alone."""
    j = _pair(stored, incoming, keys)
    have = F.coalesce("s__", F.lit(False))
    take = F.coalesce("i__", F.lit(False))
    if newer:
        take = take & (~have | F.col(f"s_{newer}").isNull() | (F.col(f"i_{newer}") >= F.col(f"s_{newer}")))
    if floor is not None:
        take = take & ~(have & (F.col(f"s_{keys[0]}") >= floor))
    out = []
    for c in stored.columns:
        if guarded and (c in guarded or c in guarded.values()):
            t = guarded.get(c, c)
            chosen = take & (~have | incoming_wins(F.col(f"i_{t}"), F.col(f"s_{t}")) | F.col(f"s_{t}").isNull())
        else:
            chosen = take
        out.append(F.when(chosen, F.col(f"i_{c}")).otherwise(F.col(f"s_{c}")).alias(c))
    return j.where(have | take).select(*out)


def latest(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order: a union of old and new rows in, an upsert out."""
    rest = [c for c in parts.columns if c not in keys]
    best = parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"x.{c}") for c in parts.columns])


def sticky(stored: DataFrame, incoming: DataFrame, key: str, status: str = "status", open_status: str = "pending") -> DataFrame:
    """An upsert in which a pending copy never reopens what is resolved."""
    j = _pair(stored, incoming, [key])
    keep = F.coalesce("s__", F.lit(False)) & (~F.coalesce("i__", F.lit(False)) | ((F.col(f"s_{status}") != open_status) & (F.col(f"i_{status}") == open_status)))
    return j.select(*[F.when(keep, F.col(f"s_{c}")).otherwise(F.col(f"i_{c}")).alias(c) for c in stored.columns])


def reconcile(stored: DataFrame, live: DataFrame, owner: str, value: str, flag: str = "is_deleted") -> DataFrame:
    """The stored set after a full list of what is live: absent values are flagged, present ones revived, new ones added;
    values compare without case and stored spellings stay. Only owners in the list are touched."""
    s = stored.withColumn("__v", F.lower(value))
    i = live.select(F.col(owner).alias("__o"), F.lower(value).alias("__w"), F.col(value).alias("__new")).dropDuplicates(["__o", "__w"])
    j = s.join(i, (s[owner] == F.col("__o")) & (F.col("__v") == F.col("__w")), "full_outer")
    touched = live.select(F.col(owner).alias("__t")).distinct()
    j = j.withColumn("__own", F.coalesce(F.col(owner), F.col("__o"))).join(touched, F.col("__own") == F.col("__t"), "left")
    gone = F.when(F.col("__t").isNull(), F.col(flag)).otherwise(F.col("__w").isNull())
    return j.select(F.col("__own").alias(owner), F.coalesce(value, "__new").alias(value), gone.alias(flag))


def changes_since(df: DataFrame, time: str, id_col: str, cursor: tuple | None, limit: int) -> DataFrame:
    """A page of a change feed by (time, id), strictly after the cursor."""
    if cursor:
        t = F.lit(cursor[0]).cast("timestamp")
        df = df.where((F.col(time) > t) | ((F.col(time) == t) & (F.col(id_col) > cursor[1])))
    return df.orderBy(time, id_col).limit(limit)


def replay(log: DataFrame, entity: str, action: str, value: str, id_col: str, families: dict[str, str]) -> DataFrame:
    """Per entity and family of actions, the value of the last entry by id: (entity, family, action, value)."""
    family = F.coalesce(*[F.when(F.col(action) == a, F.lit(f)) for a, f in families.items()])
    rows = log.select(F.col(entity).alias("entity"), family.alias("family"), F.col(action).alias("action"), F.col(value).alias("value"), F.col(id_col).alias("__id")).where("family is not null")
    best = rows.groupBy("entity", "family").agg(F.max_by(F.struct("action", "value"), "__id").alias("x"))
    return best.select("entity", "family", "x.action", "x.value")


def correct(df: DataFrame, id_col: str, value: str, corrected: Column, batch: str) -> tuple[DataFrame, DataFrame]:
    """(new table, log) of one projection: every row whose value changes is logged with both values."""
    both = df.withColumn("__new", corrected)
    changed = ~F.col(value).eqNullSafe(F.col("__new"))
    log = both.where(changed).select(F.lit(batch).alias("batch_id"), F.col(id_col).alias("entity_id"), F.col(value).alias("previous"), F.col("__new").alias("new"))
    return both.select(*[F.col("__new").alias(c) if c == value else F.col(c) for c in df.columns]), log


def undo(df: DataFrame, log: DataFrame, id_col: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(restored table, skipped): values that were changed again since are left and listed."""
    j = df.join(log.select(F.col("entity_id").alias("__e"), "previous", "new"), df[id_col] == F.col("__e"), "left")
    same = F.col("__e").isNotNull() & F.col(value).eqNullSafe(F.col("new"))
    skipped = j.where(F.col("__e").isNotNull() & ~F.col(value).eqNullSafe(F.col("new"))).select(F.col(id_col).alias("entity_id"), F.col(value).alias("current"), F.col("new").alias("written"))
    return j.select(*[F.when(same, F.col("previous")).otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in df.columns]), skipped


def batches(log: DataFrame, undone: DataFrame) -> DataFrame:
    """(batch_id, n, undone) of a correction log."""
    u = undone.select(F.col("batch_id").alias("__b")).distinct()
    g = log.groupBy("batch_id").agg(F.count("*").alias("n"))
    return g.join(u, F.col("batch_id") == F.col("__b"), "left").select("batch_id", "n", F.col("__b").isNotNull().alias("undone"))


def touched(old: DataFrame, new: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """Keys whose watched columns differ between two versions, added and removed ones included."""
    o = old.select(F.col(key).alias("__a"), F.struct(*watched).alias("__x"))
    n = new.select(F.col(key).alias("__b"), F.struct(*watched).alias("__y"))
    return o.join(n, F.col("__a") == F.col("__b"), "full_outer").where(~F.col("__x").eqNullSafe(F.col("__y"))).select(F.coalesce("__a", "__b").alias(key))


def refreshed(view: DataFrame, keys: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """A maintained view with the touched keys' rows replaced; recomputed holds those keys only."""
    return view.join(keys, key, "left_anti").unionByName(recomputed.join(keys, key, "left_semi"))


def decided(rows: DataFrame, decisions: DataFrame, id_col: str, columns: dict[str, dict[str, object]]) -> tuple[DataFrame, DataFrame]:
    """A state machine: decisions (id, status) set columns per status and bump `version`; (new rows, log)."""
    d = decisions.select(F.col("id").alias("__d"), F.col("status").alias("__s"))
    j = rows.join(d, rows[id_col] == F.col("__d"), "left")
    hit = F.col("__d").isNotNull()

    def value(c: str) -> Column:
        if c == "version":
            return F.when(hit, F.col(c) + 1).otherwise(F.col(c)).alias(c)
        if c not in columns:
            return F.col(c)
        out = F.col(c)
        for status, v in columns[c].items():
            out = F.when(hit & (F.col("__s") == status), F.lit(v)).otherwise(out)
        return out.alias(c)

    new = j.select(*[value(c) for c in rows.columns])
    before, after = F.to_json(F.struct(*columns)), F.to_json(F.struct(*[value(c) for c in columns]))
    return new, j.where(hit).select(F.col(id_col).alias("entity_id"), F.col("__s").alias("action"), before.alias("previous"), after.alias("new"))


def set_status(rows: DataFrame, ids: DataFrame, id_col: str, status: str, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Status of an id list set; a null note keeps the old one. (new rows, previous values)."""
    i = ids.select(F.col(ids.columns[0]).alias("__i")).distinct()
    j = rows.join(i, rows[id_col] == F.col("__i"), "left")
    hit = F.col("__i").isNotNull()
    out = [F.when(hit, F.lit(status)).otherwise(F.col(c)).alias(c) if c == "status" else F.when(hit, F.coalesce(F.lit(note), F.col(c))).otherwise(F.col(c)).alias(c) if c == "note" else F.col(c) for c in rows.columns]
    return j.select(*out), j.where(hit).select(*rows.columns)


def accept(suggestions: DataFrame, facts: DataFrame, key: str, value: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Accepted suggestions against facts: (key, value, carried columns, current, outcome in applied, same, conflict)."""
    s = suggestions.select(key, F.col(value).alias("value"), *carried)
    f = facts.select(F.col(key).alias("__k"), F.col(value).alias("current"))
    j = s.join(f, F.col(key) == F.col("__k"), "left").drop("__k")
    return j.withColumn("outcome", F.when(F.col("current").isNull(), "applied").when(F.col("current") == F.col("value"), "same").otherwise("conflict"))


def clear_fact(facts: DataFrame, ids: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(facts with the value nulled, suggestions that keep it)."""
    i = ids.select(F.col(ids.columns[0]).alias("__i")).distinct()
    j = facts.join(i, facts[key] == F.col("__i"), "left")
    hit = F.col("__i").isNotNull() & F.col(value).isNotNull()
    return j.select(*[F.when(hit, F.lit(None)).otherwise(F.col(c)).cast(dict(facts.dtypes)[c]).alias(c) if c == value else F.col(c) for c in facts.columns]), j.where(hit).select(key, F.col(value).alias("value"), F.lit("pending").alias("status"))


def pick_current(rows: DataFrame, key: str, id_col: str, status: str = "status") -> DataFrame:
    """The pending row of each key if it has one, else its latest."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(status) == "pending", id_col)).alias("x"))
    return best.select(key, *[F.col(f"x.{c}") for c in rest])


def proposal_outcome(requests: DataFrame, existing: DataFrame, key: str, is_scan: str) -> DataFrame:
    """What asking for a proposal does: not_a_scan, inserted, reopened, already_pending or already_accepted."""
    e = existing.select(F.col(key).alias("__k"), F.col("status").alias("__s"))
    j = requests.join(e, requests[key] == F.col("__k"), "left")
    return j.select(*requests.columns, F.when(~F.col(is_scan), "not_a_scan").when(F.col("__s").isNull(), "inserted").when(F.col("__s") == "rejected", "reopened").when(F.col("__s") == "pending", "already_pending").otherwise("already_accepted").alias("outcome"))


def preferred(masters: DataFrame, key: str, id_col: str, pixels: str) -> DataFrame:
    """The master with strictly most pixels; of equals the older."""
    return masters.groupBy(key).agg(F.max_by(id_col, F.struct(pixels, -F.col(id_col))).alias("preferred"))


def reordered(items: DataFrame, keys: list[str], id_col: str, wanted: DataFrame) -> DataFrame:
    """(key, id, position) of the items that move: wanted (id, at) come first in their order, the others follow."""
    w = Window.partitionBy(*keys).orderBy(F.col("at").asc_nulls_last(), "position", id_col)
    j = items.join(wanted.select(F.col("id").alias("__w"), "at"), items[id_col] == F.col("__w"), "left")
    return j.withColumn("new_position", F.row_number().over(w)).where("position is null or position <> new_position").select(*keys, id_col, "new_position")


def next_ids(rows: DataFrame, existing: DataFrame, id_col: str, order: list[Column], floor: int) -> DataFrame:
    """Ids from greatest(floor, max + 1) on, in order; numbers within partitions of a range sort are offset by the
    sizes of those before, so that no task sees all rows."""
    top = existing.agg(F.max(id_col)).first()[0]
    start = max(floor, (top if top is not None else 0) + 1)
    n = rows.rdd.getNumPartitions()
    key = F.struct(*order)
    placed = rows.withColumn("__o", key).repartitionByRange(n, "__o").sortWithinPartitions("__o").withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    from .graph import kept_table

    placed = kept_table(placed, "ids")
    sizes = {r[0]: r[1] for r in placed.groupBy("__p").count().collect()}
    before, at = [], start
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    # a row a partition: a table to join, since a branch a partition would make the expression as long as the job is wide
    base = F.broadcast(rows.sparkSession.createDataFrame(before, "__p int, __b long"))
    return placed.join(base, "__p").withColumn(id_col, F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__o", "__p", "__m", "__b")


def above_floor(rows: DataFrame, id_col: str, floor: int) -> bool:
    return not rows.where(F.col(id_col) >= floor).isEmpty()


def expired(rows: DataFrame, expires: str, now: str) -> DataFrame:
    return rows.where(F.col(expires) < F.lit(now).cast("timestamp"))


def live_request(new: DataFrame, pending: DataFrame, email: str, expires: str, now: str) -> DataFrame:
    """Requests whose address, without case, has no pending one that hasn't expired."""
    p = pending.where(F.col(expires) > F.lit(now).cast("timestamp")).select(F.lower(email).alias("__e"))
    return new.join(p, F.lower(new[email]) == F.col("__e"), "left_anti")
