"""Declared constraints as audits: each returns the violating rows or counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchline.operators.skew import is_small, lookup_join
from wrenchline.schemas import Rule
from wrenchline.session import pinned

# Bits of the integer types without the sign.
INTEGER_BITS = {"smallint": 15, "int": 31}


def audit_pk(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or have a NULL part, with their row counts."""
    null_part = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null_part)


def audit_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per required column, one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "nulls")


def audit_fk(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows without a parent; ``on`` maps child to parent columns. A NULL in the child key passes."""
    keys = list(on)
    known = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    return lookup_join(child.dropna(subset=keys), known, keys, "left_anti")


def renames_in_turn(renames: DataFrame, seq: str = "seq", aliases: bool = False) -> DataFrame:
    """(old, new) that do at once what the renames (old, new and ``seq``, unique) do one after the other.

    A key takes its first rename; what this makes of it takes the next later rename of that name, and so on.
    Numbers only grow along such a chain, so there are no cycles; each round of the loop doubles the steps taken.
    Names in between are in the result too and rename nothing where no key has them at first.

    With ``aliases`` a key goes on answering to each name that a rename gave it: every later rename of one of them
    concerns it, and the last of all those names it. The two readings differ only where a name is given more than
    once; this one takes a round of the loop per step of the longest chain.
    """
    renames = pinned(renames.select(F.col(seq).alias("_seq"), "old", "new").filter(F.col("old") != F.col("new")))
    if aliases:
        return _last_of_aliases(renames)
    # Per name: where a rename leads to it and where one starts from it; the next start after an arrival goes on.
    events = renames.select(F.col("new").alias("_name"), "_seq", F.col("_seq").alias("_from"), F.lit(None).alias("_to")) \
        .unionByName(renames.select(F.col("old").alias("_name"), "_seq", F.lit(None).alias("_from"), F.col("_seq").alias("_to")))
    later = Window.partitionBy("_name").orderBy("_seq").rowsBetween(1, Window.unboundedFollowing)
    following = events.withColumn("_next", F.first("_to", ignorenulls=True).over(later)).filter(
        F.col("_from").isNotNull()).select(F.col("_from").alias("_seq"), "_next")
    steps = pinned(renames.join(following, "_seq").select("_seq", "old", "new", "_next"))
    while not steps.filter(F.col("_next").isNotNull()).isEmpty():
        ahead = steps.select(F.col("_seq").alias("_next"), F.col("new").alias("_new"), F.col("_next").alias("_after"))
        steps = pinned(steps.join(ahead, "_next", "left").select(
            "_seq", "old", F.when(F.col("_next").isNull(), F.col("new")).otherwise(F.col("_new")).alias("new"),
            F.col("_after").alias("_next")))
    return steps.groupBy("old").agg(F.min_by("new", "_seq").alias("new"))


def _last_of_aliases(renames: DataFrame) -> DataFrame:
    """(old, new): the last of the renames that follow the first one of ``old``, see ``renames_in_turn``."""
    steps = renames.withColumn("_last", F.struct("_seq", "new"))
    nothing = F.lit(None).cast(steps.schema["_last"].dataType)
    # From the latest rename of a name back to its arrivals, so that the frame only grows.
    later = Window.partitionBy("_name").orderBy(F.desc("_seq")).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # Per name: where a rename leads to it, and those that start from it with the last one that follows them.
        events = steps.select(F.col("new").alias("_name"), "_seq", "old", "new", "_last", nothing.alias("_ahead")) \
            .unionByName(steps.select(F.col("old").alias("_name"), "_seq", *[F.lit(None).alias(c) for c in ("old", "new")],
                                      nothing.alias("_last"), F.col("_last").alias("_ahead")))
        steps = pinned(events.withColumn("_then", F.max("_ahead").over(later)).filter(F.col("_last").isNotNull()).select(
            "_seq", "old", "new", F.greatest("_last", "_then").alias("_last"), (F.col("_then") > F.col("_last")).alias("_grew")))
        if steps.filter("_grew").isEmpty():
            return steps.groupBy("old").agg(F.min_by("_last.new", "_seq").alias("new"))
        steps = steps.drop("_grew")


def checked_renames(renames: DataFrame, keys: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """The renames (old, new), which fail when they are used if an ``old`` comes twice.

    With ``keys`` (the parent's, one column) only renames of these are kept, and they also fail if two keys become
    the same or if one becomes a key that stays, unless ``merge`` allows that. A key may move to the name of one that
    moves away.
    """
    def fail(text: str, value: Column) -> Column:
        return F.raise_error(F.concat(F.lit(text), value.cast("string")))

    given = renames.select("old", "new").filter(F.col("old").isNotNull())
    single = given.groupBy("old").agg(F.count("*").alias("_n"), F.max("new").alias("new"))
    kind = renames.schema["new"].dataType
    new = F.when(F.col("_n") > 1, fail("renamed twice: ", F.col("old")).cast(kind))
    if keys is not None:
        held = keys.toDF("old").distinct()
        single = single.join(held, "old", "left_semi")
    if keys is not None and not merge:
        # Keys as they will be: those that stay and the new ones, each of which must come once.
        staying = held.join(single.select("old"), "old", "left_anti").select(F.col("old").alias("new"))
        after = single.select("new").unionByName(staying).groupBy("new").agg(F.count("*").alias("_m"))
        single = single.join(after, "new", "left")
        new = new.when(F.col("_m") > 1, fail("two keys become ", F.col("new")).cast(kind))
    return single.select("old", new.otherwise(F.col("new")).alias("new"))


def cascade_rename(children: Mapping[str, tuple[DataFrame, str]], renames: DataFrame) -> dict[str, DataFrame]:
    """Rewrite changed parent keys in every child table.

    ``children`` maps a table name to (table, key column); ``renames`` has unique ``old`` and their ``new``, applied
    at once, so that a -> b and b -> a swap (see ``renames_in_turn`` for the other reading). Repeated ones are
    refused with an error.
    """
    renames = checked_renames(renames)
    return {name: _renamed(table, column, renames) for name, (table, column) in children.items()}


def _renamed(table: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    mapping = renames.select(F.col("old").alias(column), F.col("new").alias("_new"), F.lit(True).alias("_hit"))
    joined = lookup_join(table, mapping, [column], "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*table.columns)


def cascade_tables(tables: Mapping[str, DataFrame], parent: str, column: str, renames: DataFrame,
                   foreign_keys: Sequence[Rule], merge: bool = False) -> dict[str, DataFrame]:
    """Rename keys of ``parent.column`` and follow every cascading foreign key below it.

    A new name that a key which stays has already is refused with an error, as are repeated ones. With ``merge``, for a
    column that need not be unique in the parent, keys may become the same: their rows stay and have one key from then on.
    """
    renames = checked_renames(renames, tables[parent].select(column), merge)
    result = dict(tables)
    todo = [(parent, column)]
    while todo:
        table, key = todo.pop()
        result[table] = _renamed(result[table], key, renames)
        todo += [(rule.table, rule.columns[0]) for rule in foreign_keys
                 if rule.parent == table and rule.parent_columns == (key,) and rule.on_update == "cascade"
                 and rule.table in result]
    return result


def restrict_rename(renames: DataFrame, child: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(allowed, refused) renames: a parent key still used by ``child.column`` may not change."""
    used = child.select(F.col(column).alias("old")).dropna().distinct()
    if is_small(used):
        return renames.join(used, "old", "left_anti"), renames.join(used, "old", "left_semi")
    # Keys shrink so well in a shuffle that AQE would merge many millions of them into one task, which sorts and hashes
    # them all. A given number of partitions stays, on both sides of a join; Spark would push a semi join below it.
    spread = renames.repartition(int(renames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "old")
    marked = spread.join(used.withColumn("_hit", F.lit(True)), "old", "left")
    return marked.filter(F.col("_hit").isNull()).drop("_hit"), marked.filter("_hit").drop("_hit")


def audit_enum(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value lies outside the declared domain (NULL passes)."""
    return df.filter(~F.col(column).isin(list(values)))


def audit_length(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """Rows with a text longer than declared, trailing blanks not counted."""
    return df.filter(reduce(lambda a, b: a | b, [_too_long(c, n) for c, n in lengths.items()]))


def _too_long(column: str, limit: int) -> Column:
    return F.coalesce(F.length(F.rtrim(column)) > limit, F.lit(False))


def audit_range(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Rows with a number that does not fit the declared integer type once rounded, or a text that is no number."""
    return df.filter(reduce(lambda a, b: a | b, [_out_of_range(df, c, t) for c, t in types.items()]))


def _out_of_range(df: DataFrame, column: str, type_name: str) -> Column:
    """Plain comparisons with the bounds half a unit further out, so numbers need no conversion."""
    above = 2 ** INTEGER_BITS[type_name]
    kind = df.select(column).schema[0].dataType
    if isinstance(kind, T.IntegralType):
        outside = (F.col(column) >= above) | (F.col(column) < -above)
    else:
        number = F.col(column) if isinstance(kind, T.NumericType) else F.col(column).try_cast("decimal(38,6)")
        outside = (number >= F.lit(above - Decimal("0.5"))) | (number <= F.lit(-above - Decimal("0.5")))
    return F.col(column).isNotNull() & F.coalesce(outside, F.lit(True))


def constraint_report(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """(rule, table_name, violations) for every rule.

    Row rules (not null, enum, length, range) of a table share one scan; key rules aggregate by key first, so a
    key held by very many rows costs one row after the map side.
    """
    parts: list[DataFrame] = []
    row_kinds = ("not_null", "enum", "length", "range")
    for table in dict.fromkeys(r.table for r in rules):
        checks = [(r, row_test(tables[table], r)) for r in rules if r.table == table and r.kind in row_kinds]
        if checks:
            counted = tables[table].agg(*[F.count_if(test).alias(rule.name) for rule, test in checks])
            names = [rule.name for rule, _ in checks]
            long = counted.unpivot([], [F.col(f"`{n}`") for n in names], "rule", "violations")
            parts.append(long.select("rule", F.lit(table).alias("table_name"), "violations"))
    for rule in rules:
        if rule.kind == "key":
            violations = audit_pk(tables[rule.table], rule.columns).agg(F.count("*").alias("violations"))
        elif rule.kind == "foreign_key":
            violations = _orphans(tables, rule)
        else:
            continue
        parts.append(violations.select(
            F.lit(rule.name).alias("rule"), F.lit(rule.table).alias("table_name"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def row_test(df: DataFrame, rule: Rule) -> Column:
    """Whether a row breaks a row rule (not null, enum, length, range); its columns may be fields of structs."""
    if rule.kind == "not_null":
        return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule.columns])
    column = rule.columns[0]
    if rule.kind == "enum":
        return F.coalesce(~F.col(column).isin(list(rule.values)), F.lit(False))
    if rule.kind == "length":
        return _too_long(column, rule.limit)
    return _out_of_range(df, column, rule.type_name)


def _orphans(tables: Mapping[str, DataFrame], rule: Rule) -> DataFrame:
    keys = list(rule.columns)
    child = tables[rule.table].dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    parent = tables[rule.parent].select(
        *[F.col(p).alias(c) for c, p in zip(rule.columns, rule.parent_columns)]).distinct()
    return child.join(parent, keys, "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("violations"))
