"""Relational building blocks: universes with typed gaps, dynamic filters, versions, upserts, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_observation_state(universe: DataFrame, facts: DataFrame, key: str, measure: str, observed: str = "observed", unknown: str = "unknown") -> DataFrame:
    """Every row of `universe` once, `facts` joined by `key`; rows without facts keep nulls and say so. Missing is never zero."""
    return universe.join(facts, key, "left").withColumn("observation_state", F.when(F.col(measure).isNotNull(), observed).otherwise(unknown))


def filtered(df: DataFrame, equal: Mapping[str, object | None] | None = None, least: Mapping[str, object | None] | None = None, most: Mapping[str, object | None] | None = None) -> DataFrame:
    """Conjunction of the given predicates; a null argument is no predicate."""
    rules = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    rules += [F.col(c) >= v for c, v in (least or {}).items() if v is not None]
    rules += [F.col(c) <= v for c, v in (most or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, rules)) if rules else df


def released(df: DataFrame, state: str, decision: str, live: str, refused: Sequence[str]) -> DataFrame:
    """The public-release predicate, written before any aggregate so it reaches the scan; a null decision is no refusal."""
    return df.where((F.col(state) == live) & ~F.coalesce(F.col(decision), F.lit("")).isin(list(refused)))


def fixture_mode(df: DataFrame, flag: str, mode: str) -> DataFrame:
    """'live_only' counts a null flag as live, 'fixture_only' doesn't, 'all' keeps every row."""
    if mode == "live_only":
        return df.where(~F.coalesce(F.col(flag), F.lit(False)))
    return df.where(F.col(flag)) if mode == "fixture_only" else df


def auto_fixture_mode(df: DataFrame, flag: str) -> DataFrame:
    """Live rows only as soon as one stands there; else all."""
    any_live = df.agg(F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), 1).otherwise(0)).alias("_any"))
    return df.crossJoin(F.broadcast(any_live)).where((F.col("_any") == 0) | ~F.coalesce(F.col(flag), F.lit(False))).drop("_any")  # one row


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in `order`, by one partial aggregate and no sort; ties in `order` fall to the greatest row."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def latest_partition(df: DataFrame, part: str, wanted: object | None = None) -> DataFrame:
    """Rows of the wanted partition, or of the greatest there is."""
    if wanted is not None:
        return df.where(F.col(part) == wanted)
    return df.join(F.broadcast(df.agg(F.max(part).alias(part))), part, "left_semi")  # one row


def unregistered(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows whose key the registry lacks, null keys included."""
    return df.join(registry.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ON CONFLICT DO NOTHING: old rows and those new ones whose key isn't there."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE: of each key the new row, among several the greatest in `order`."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest(both, keys, ["_v", *order]).drop("_v")


def seeded(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Registry seed: `seed_state` new, kept or retired_not_in_current_registry for each key of either side."""
    a, b = old.select(F.col(key), F.lit(1).alias("_o")), new.select(F.col(key), F.lit(1).alias("_n"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_n").isNull(), "retired_not_in_current_registry").when(F.col("_o").isNull(), "new").otherwise("kept").alias("seed_state"))


def contaminated(df: DataFrame, digest: str, first: str, second: str) -> DataFrame:
    """Rows whose digest stands under more than one `first` and more than one `second`."""
    bad = df.groupBy(digest).agg(F.count_distinct(first).alias("_a"), F.count_distinct(second).alias("_b")).where((F.col("_a") > 1) & (F.col("_b") > 1))
    return df.join(bad.select(digest), digest, "left_semi")


def densified_counts(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """Counts over a closed vocabulary; here nought is a true count."""
    words = df.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{column} string")
    return words.join(df.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def histogram_of_codes(df: DataFrame, code: str, unrecorded: str = "unrecorded") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(code), F.lit(unrecorded)).alias(code)).agg(F.count(F.lit(1)).alias("n"))


def crosstab_with_totals(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n for cells, row totals, column totals and the whole; 'ALL' marks a total, 'UNRESOLVED' a null."""
    x = df.select(F.coalesce(row, F.lit("UNRESOLVED")).alias(row), F.coalesce(column, F.lit("UNRESOLVED")).alias(column))
    c = x.cube(row, column).agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce(row, F.lit("ALL")).alias(row), F.coalesce(column, F.lit("ALL")).alias(column), "n")


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key, rule: one row for each rule a row breaks. A rule that can't be decided for nulls isn't broken."""
    codes = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key), F.explode(codes).alias("rule"))


def duplicate_identities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def sentinel_number(text: Column, sentinels: Sequence[str] = ("", "NULL", "NA", "-999", "99.9", "####")) -> Column:
    """A number with thousands commas, or null for a sentinel or anything else that isn't one."""
    t = F.upper(F.trim(text))
    return F.when(~t.isin(list(sentinels)), F.regexp_replace(t, ",", "")).try_cast("double")


def owner(df: DataFrame, key: str, rank: Column, order: Sequence[Column | str]) -> DataFrame:
    """One row per key: lowest `rank`, then first in `order`. The order must settle every tie."""
    low = df.withColumn("_rank", rank)
    rest = df.columns
    best = low.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_rank", *order)).alias("_r"))
    return best.select(*[F.col(f"_r.`{c}`").alias(c) for c in rest])


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark limits each partition to k rows a group before the shuffle (rank-limit pushdown), so a hot group doesn't gather."""
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank_in_group") <= k)


def timeline(df: DataFrame, day: Column) -> DataFrame:
    """day, n, cumulative: rows a UTC day and the running total; the window runs over days, not rows."""
    n = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("cumulative", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def canonical_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def content_key(columns: Sequence[str]) -> Column:
    """SHA-256 over the fields joined by the unit separator; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
