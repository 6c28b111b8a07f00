"""Implausible, frozen and outlying measurements, flagged per source.

Peaks over threshold: each source's readings are compared with its own level
and season; the excesses over a high threshold of that source are fitted with a
generalised Pareto tail, whose quantile at a fixed risk is the cutoff. Rules
for physical plausibility and for values that stay the same too long stand
beside it.

Rows are laid out once by source and block of sequence numbers; whatever is
known of a source is sent to its blocks, so a source of any size is worked on
by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teesta.functions.harmonic import harmonic_features, predict, solve_sums
from teesta.functions.stage import settle
from teesta.session import cut as checkpointed

BLOCK = 65_536
SUBBLOCK = 4_096
EPOCH = "2000-01-01"


@dataclass(frozen=True)
class FieldRule:
    """Plausible range of a field and how far from its source's centre a reading stands off.

    With `positive_only` the centre is zero and the yardstick the median of the
    positive readings; else they are the median and the median distance from it.
    """

    low: float
    high: float
    factor: float
    positive_only: bool = False


STATION_FIELDS: Mapping[str, FieldRule] = {
    "rainfall_mm": FieldRule(0.0, 500.0, 5.0, positive_only=True),
    "temperature_c": FieldRule(-10.0, 55.0, 6.0),
    "relative_humidity_pct": FieldRule(0.0, 100.0, 6.0),
}


def _real(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


def _level(v: Column, per_fold: int) -> Column:
    """The number of a logarithmic bin, rising with `v`; `per_fold` bins to each factor of e, zero in its own."""
    size = F.floor((F.log(F.abs(v)) + 746.0) * per_fold)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str, weight: Column | None = None) -> DataFrame:
    """Exact median of `value` per group: the middle value, or the mean of the two middle values. Nulls don't count.

    Values are counted in logarithmic bins first. The bins hold the middle ranks
    of a group, however large; only the values of those bins, a few thousandths
    of the group's range, are then ordered. `weight`: how often a row counts.
    """
    keys = list(keys)
    x = df.where(F.col(value).isNotNull()).groupBy(*keys, _level(F.col(value), 256).alias("_bin"), F.col(value).alias("_v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    bins = x.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(group))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = bins.where((F.col("_upto") > low) & (F.col("_upto") - F.col("_n") <= high)).select(*keys, "_bin", (F.col("_upto") - F.col("_n")).alias("_below"), "_all")
    near = x.join(middle, [*keys, "_bin"])
    run = near.withColumn("_to", F.col("_below") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    holds = lambda rank: (F.col("_to") - F.col("_n") <= rank) & (F.col("_to") > rank)
    return run.groupBy(*keys).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name))


def keyed(rows: DataFrame, row_id: str, source: str, sequence: str, fields: Sequence[str], day: str | None) -> DataFrame:
    """_id, _src, _seq, _block, _t and the fields. Rows without a sequence number are spread over sixteen blocks below zero."""
    t = F.datediff(F.to_date(F.col(day)), F.lit(EPOCH).cast("date")).cast("double") if day else F.lit(0.0)
    seq = F.col(sequence).cast("long")
    return rows.select(
        F.col(row_id).alias("_id"), F.col(source).alias("_src"), seq.alias("_seq"),
        F.coalesce(F.floor(seq / BLOCK), -1 - F.pmod(F.xxhash64(F.col(row_id)), F.lit(16))).cast("long").alias("_block"),
        F.coalesce(t, F.lit(0.0)).alias("_t"), *[_real(F.col(f)).alias(f) for f in fields],
    )


def one_reading(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """_src, _block, _seq, _t and the fields of each reading once, and of each field `_at_`, its number among the block's
    values, and `_like_`, the sequence number of the value before where that is equal and not zero.

    A reading sent again under other ids counts once, with the value of the
    smallest id that has one. Rows without source or sequence number are no
    readings. One exchange by source and block serves the grouping and the order.
    """
    known = rows.where(F.col("_src").isNotNull() & F.col("_seq").isNotNull()).repartition("_src", "_block")
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_id"))).alias(f) for f in fields]
    one = known.groupBy("_src", "_block", "_seq").agg(F.min("_t").alias("_t"), *first)
    order = Window.partitionBy("_src", "_block").orderBy("_seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = {f"_p_{f}": F.last(F.when(F.col(f).isNotNull(), F.struct(F.col(f).alias("v"), F.col("_seq").alias("q"))), ignorenulls=True).over(before) for f in fields}
    at = {f"_at_{f}": F.count(f).over(order.rowsBetween(Window.unboundedPreceding, 0)) for f in fields}
    x = one.withColumns(last | at)
    like = {f"_like_{f}": F.when((F.col(f) == F.col(f"_p_{f}")["v"]) & (F.col(f) != 0), F.col(f"_p_{f}")["q"]) for f in fields}
    return x.withColumns(like).drop(*last)


def _middle(a: Column) -> Column:
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def _distance(centre: Column) -> Callable[[Column], Column]:
    return lambda v: F.abs(v - centre)


def centres(readings: DataFrame, fields: Mapping[str, FieldRule]) -> DataFrame:
    """_src, _field, centre, yardstick.

    A source of one block has no more values than a block has numbers; they are
    ordered as they stand. Sources of several blocks go through grouped_median.
    """
    names = list(fields)
    wanted = {f: F.when(F.col(f) > 0, F.col(f)) if r.positive_only else F.col(f) for f, r in fields.items()}
    lists = readings.groupBy("_src", "_block").agg(*[F.sort_array(F.collect_list(wanted[f])).alias(f) for f in names])
    lists = settle(lists, **{f"_c_{f}": _middle(F.col(f)) for f in names})
    away = {f: F.sort_array(F.transform(f, _distance(F.col(f"_c_{f}")))) for f in names if not fields[f].positive_only}
    lists = settle(lists, **{f"_d_{f}": a for f, a in away.items()})
    yardstick = {f: _middle(F.col(f"_d_{f}")) if f in away else F.lit(None).cast("double") for f in names}
    by_block = lists.select("_src", F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), F.col(f"_c_{f}").alias("_c"), yardstick[f].alias("_y")) for f in names])))
    # One row a block and field: where there is one block, it says all.
    per = checkpointed(by_block.groupBy("_src", "_field").agg(F.count(F.lit(1)).alias("_blocks"), F.max("_c").alias("centre"), F.max("_y").alias("yardstick")))
    alone = per.where((F.col("_blocks") == 1) & F.col("centre").isNotNull()).select("_src", "_field", "centre", "yardstick")
    large = per.where(F.col("_blocks") > 1).select("_src").distinct()
    long = readings.join(large, "_src", "left_semi").select("_src", F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), wanted[f].alias("_v")) for f in names])))
    counts = long.where(F.col("_v").isNotNull()).groupBy("_src", "_field", "_v").agg(F.count(F.lit(1)).alias("_c"))
    median = grouped_median(counts, ["_src", "_field"], "_v", "centre", F.col("_c"))
    zero = [f for f, r in fields.items() if r.positive_only]
    away = counts.where(~F.col("_field").isin(zero)).join(median, ["_src", "_field"]).select("_src", "_field", F.abs(F.col("_v") - F.col("centre")).alias("_away"), "_c")
    spread = grouped_median(away, ["_src", "_field"], "_away", "yardstick", F.col("_c"))
    both = alone.unionByName(median.join(spread, ["_src", "_field"], "left"))
    is_zero = F.col("_field").isin(zero)
    return both.select("_src", "_field", F.when(is_zero, 0.0).otherwise(F.col("centre")).alias("centre"), F.when(is_zero, F.col("centre")).otherwise(F.col("yardstick")).alias("yardstick"))


def _season(t: Column, days: float = 365.25) -> list[Column]:
    return harmonic_features(t, days, 1, 3652.5)


def _plausible(f: str, r: FieldRule) -> Column:
    return F.when(F.col(f).between(r.low, r.high), F.col(f))


def seasons(readings: DataFrame, fields: Mapping[str, FieldRule]) -> DataFrame:
    """_src, _field, beta: level, trend and yearly wave of each source's plausible readings.

    All fields' normal equations are summed in one wide aggregate per source, which combines before the shuffle.
    """
    x = _season(F.col("_t"))
    p = len(x)
    sums = []
    for f, r in fields.items():
        v = _plausible(f, r)
        sums += [F.sum(F.when(v.isNotNull(), x[i] * x[j])).alias(f"{f}_{i}_{j}") for i in range(p) for j in range(i, p)]
        sums += [F.sum(x[i] * v).alias(f"{f}_{i}_y") for i in range(p)] + [F.count(v).alias(f"{f}_n")]
    s = readings.groupBy("_src").agg(*sums)
    each = [
        F.struct(
            F.lit(f).alias("_field"), F.array(*[F.col(f"{f}_{i}_{j}") for i in range(p) for j in range(i, p)]).alias("_xx"),
            F.array(*[F.col(f"{f}_{i}_y") for i in range(p)]).alias("_xy"), F.col(f"{f}_n").alias("n_fit"),
        )
        for f in fields
    ]
    long = s.select("_src", F.inline(F.array(*each))).where(F.col("n_fit") > 0)
    return solve_sums(long, ["_src", "_field"], p, ridge=1e-2).select("_src", "_field", "beta")


def to_blocks(blocks: DataFrame, per_source: DataFrame) -> DataFrame:
    """The rows of `per_source` for each block of their source."""
    return blocks.where(F.col("_src").isNotNull()).select("_src", "_block").distinct().join(per_source, "_src")


def _by_source(df: DataFrame, fields: Mapping[str, FieldRule], columns: Sequence[str]) -> DataFrame:
    """One row per source with a column <name>_<field number> for each of the columns."""
    return df.groupBy("_src").agg(*[F.first(F.when(F.col("_field") == f, F.col(c)), ignorenulls=True).alias(f"{c}_{i}") for i, f in enumerate(fields) for c in columns])


def tail_cutoffs(readings: DataFrame, model: DataFrame, fields: Mapping[str, FieldRule], risk: float = 1e-3, tail_share: float = 0.1) -> DataFrame:
    """_src, _field, threshold, scale, shape, pareto, reach, cutoff: the generalised Pareto tail of the seasonal residuals.

    `model`: _src, _field, centre, yardstick, beta. From the absolute residuals
    exceeded by `tail_share` of the plausible readings, by half and by a quarter
    of it, Pickands' estimator gives shape and scale, which a few wild readings
    don't move. The shape is held within half a unit and drawn to nought where a
    source has few readings. `pareto` is the residual exceeded at `risk`.
    `reach` is the greatest distance of the season's curve from the centre: a
    reading further than factor x yardstick from the centre has a residual above
    that distance less reach. The cutoff is the smaller of the two, so no
    reading the field's rule speaks of lies below it.
    """
    names = list(fields)
    x = readings.join(to_blocks(readings, _by_source(model, fields, ["centre", "beta"])), ["_src", "_block"])
    curve = {f"_s_{i}": F.coalesce(predict(F.col(f"beta_{i}"), _season(F.col("_t"))), F.col(f"centre_{i}")) for i in range(len(names))}
    x = settle(x, **curve)
    shares = F.array(*[F.lit(1 - tail_share / k) for k in (1, 2, 4)])
    aggs = []
    for i, (f, r) in enumerate(fields.items()):
        e = F.abs(_plausible(f, r) - F.col(f"_s_{i}"))
        aggs += [F.percentile_approx(e, shares, F.lit(1000)).alias(f"q_{i}"), F.count(e).alias(f"n_{i}"), F.max(F.when(F.col(f).isNotNull(), F.abs(F.col(f"_s_{i}") - F.col(f"centre_{i}")))).alias(f"reach_{i}")]
    q = x.groupBy("_src").agg(*aggs)
    q = q.select("_src", F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), F.col(f"q_{i}").alias("_q"), F.col(f"n_{i}").alias("_all"), F.col(f"reach_{i}").alias("reach")) for i, f in enumerate(names)])))
    near, far = F.get("_q", F.lit(1)) - F.get("_q", F.lit(0)), F.get("_q", F.lit(2)) - F.get("_q", F.lit(1))
    raw = F.when((near > 0) & (far > 0), F.log(far / near) / F.log(F.lit(2.0))).otherwise(0.0)
    q = settle(q, shape=F.greatest(F.lit(-0.5), F.least(F.lit(0.5), raw)) * F.col("_all") / (F.col("_all") + 200))
    flat = F.abs(F.col("shape")) < 1e-6
    q = settle(q, scale=F.when(flat, near / F.log(F.lit(2.0))).otherwise(near * F.col("shape") / (F.pow(F.lit(2.0), F.col("shape")) - 1)))
    rate = F.lit(risk / tail_share)
    over = F.when(flat, -F.col("scale") * F.log(rate)).otherwise(F.col("scale") / F.col("shape") * (F.pow(rate, -F.col("shape")) - 1))
    q = q.join(model, ["_src", "_field"])
    factor = F.create_map(*[y for f in names for y in (F.lit(f), F.lit(float(fields[f].factor)))])[F.col("_field")]
    pareto = F.get("_q", F.lit(0)) + F.greatest(F.lit(0.0), over)
    surely = factor * F.col("yardstick") - F.col("reach") - F.lit(1e-9) * (1 + F.col("reach"))
    return q.select("_src", "_field", F.get("_q", F.lit(0)).alias("threshold"), "scale", "shape", pareto.alias("pareto"), "reach", F.coalesce(F.least(pareto, surely), F.lit(-1.0)).alias("cutoff"))


def frozen_stretches(readings: DataFrame, fields: Sequence[str], least: int = 8) -> DataFrame:
    """_src, _field, _from, _to of the stretches of `least` or more equal successive values, zero excepted; nulls are passed over.

    `readings` as one_reading gives them: a stretch is a run of values equal to
    the one before. Stretches that cross block ends are put together from each
    block's first and last stretch.
    """
    each = [F.when(F.col(f"_like_{f}").isNotNull(), F.struct(F.lit(f).alias("_field"), F.col(f).alias("_v"), F.col(f"_at_{f}").alias("_at"), F.col(f"_like_{f}").alias("_before"))) for f in fields]
    equal = readings.select("_src", "_block", "_seq", F.inline(F.array_compact(F.array(*each))))  # few readings equal the one before
    island = F.col("_at") - F.row_number().over(Window.partitionBy("_src", "_block", "_field").orderBy("_at"))
    runs = equal.withColumn("_run", island).groupBy("_src", "_block", "_field", "_run").agg(
        (F.count(F.lit(1)) + 1).alias("_n"), F.min("_v").alias("_v"), F.min("_before").alias("_from"), F.max("_seq").alias("_to"), F.min("_at").alias("_a"), F.max("_at").alias("_z")
    )
    # What stands at the ends of the blocks of sources with several.
    ends = [F.struct(F.lit(f).alias("_field"), F.col(f"n_{f}").alias("_all"), F.col(f"f_{f}").alias("_first"), F.col(f"l_{f}").alias("_last")) for f in fields]
    has = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.col("_seq").alias("q"), F.col(f).alias("v")))
    blocks = readings.groupBy("_src", "_block").agg(*[y for f in fields for y in (F.count(f).alias(f"n_{f}"), F.min(has(f)).alias(f"f_{f}"), F.max(has(f)).alias(f"l_{f}"))])
    blocks = blocks.withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy("_src")) > 1).where("_several").select("_src", "_block", F.inline(F.array(*ends))).where(F.col("_all") > 0)
    cols = ["_src", "_block", "_field"]
    head = runs.where(F.col("_a") == 2).select(*cols, F.col("_n").alias("_hn"), F.col("_to").alias("_hto"), F.col("_z").alias("_hz"))
    tail = runs.join(blocks.select(*cols, "_all"), cols).where(F.col("_z") == F.col("_all")).select(*cols, F.col("_n").alias("_tn"), F.col("_from").alias("_tfrom"))
    b = blocks.join(head, cols, "left").join(tail, cols, "left")
    whole = F.coalesce(F.col("_hz") == F.col("_all"), F.col("_all") == 1)
    first = F.struct(F.lit(0).alias("_k"), F.col("_first.v").alias("_v"), F.coalesce("_hn", F.lit(1)).alias("_n"), F.col("_first.q").alias("_from"), F.coalesce("_hto", F.col("_first.q")).alias("_to"))
    last = F.when(~whole, F.struct(F.lit(1).alias("_k"), F.col("_last.v").alias("_v"), F.coalesce("_tn", F.lit(1)).alias("_n"), F.coalesce("_tfrom", F.col("_last.q")).alias("_from"), F.col("_last.q").alias("_to")))
    e = b.select(*cols, F.inline(F.array_compact(F.array(first, last))))
    by_source = Window.partitionBy("_src", "_field").orderBy("_block", "_k")  # at most two rows a block
    goes_on = (F.col("_k") == 0) & (F.lag("_v").over(by_source) == F.col("_v"))
    e = e.withColumn("_island", F.sum(F.when(goes_on, 0).otherwise(1)).over(by_source.rowsBetween(Window.unboundedPreceding, 0)))
    across = e.groupBy("_src", "_field", "_island").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_v"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    columns = ["_src", "_field", "_from", "_to"]
    # A stretch at a block's end also stands alone here, where it is long enough: the same readings, told twice.
    return runs.where(F.col("_n") >= least).select(*columns).unionByName(across.where((F.col("_n") >= least) & (F.col("_v") != 0)).select(*columns)).distinct()


def _stretches_by_block(stuck: DataFrame) -> DataFrame:
    """_src, _block, _spans: a map from a part of the block to the stretches that touch it."""
    part = stuck.select("_src", "_field", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / SUBBLOCK), F.floor(F.col("_to") / SUBBLOCK))).alias("_sub"))
    lists = part.groupBy("_src", "_sub").agg(F.collect_list(F.struct("_field", "_from", "_to")).alias("_list"))
    return lists.groupBy("_src", F.floor(F.col("_sub") * SUBBLOCK / BLOCK).cast("long").alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct("_sub", "_list"))).alias("_spans"))


def source_tails(rows: DataFrame, row_id: str = "obs_id", source: str = "station", sequence: str = "reading_no", day: str | None = "observed_on", fields: Mapping[str, FieldRule] = STATION_FIELDS, risk: float = 1e-3) -> DataFrame:
    """source, field_name, centre, yardstick, threshold, scale, shape, pareto, reach, cutoff of each source and field with readings."""
    readings = checkpointed(one_reading(keyed(rows, row_id, source, sequence, list(fields), day), list(fields)))
    model = checkpointed(centres(readings, fields).join(seasons(readings, fields), ["_src", "_field"], "full_outer"))
    tails = tail_cutoffs(readings, model, fields, risk)
    x = model.drop("beta").join(tails, ["_src", "_field"], "left")
    return x.select(F.col("_src").alias(source), F.col("_field").alias("field_name"), "centre", "yardstick", "threshold", "scale", "shape", "pareto", "reach", "cutoff")


def flag_spikes(
    rows: DataFrame,
    row_id: str = "obs_id",
    source: str = "station",
    sequence: str = "reading_no",
    day: str | None = "observed_on",
    fields: Mapping[str, FieldRule] = STATION_FIELDS,
    stuck_least: int = 8,
    risk: float = 1e-3,
) -> DataFrame:
    """row_id, field_name, value, impossible, frozen, extreme, stands_off, cutoff of each flagged value.

    impossible: outside the field's range. frozen: in a stretch of `stuck_least`
    or more equal successive readings of its source, zero excepted. extreme: the
    seasonal residual exceeds the source's cutoff (see tail_cutoffs). stands_off:
    an extreme value that an exact check also finds further from the centre than
    the field rule says. Null and NaN are no values. Rows sent again (same source
    and sequence number) count once and are flagged under each row id, each row
    by its own value; repeated rows come out as often as they stand. A row
    without source is held to its range alone; one without a sequence number is
    in no stretch and in no statistic. An empty table gives an empty result;
    other columns are ignored.
    """
    names = list(fields)
    all_rows = keyed(rows, row_id, source, sequence, names, day)
    readings = checkpointed(one_reading(all_rows, names))
    model = checkpointed(centres(readings, fields).join(seasons(readings, fields), ["_src", "_field"], "full_outer"))
    tails = model.join(tail_cutoffs(readings, model, fields, risk).select("_src", "_field", "cutoff"), ["_src", "_field"], "left")
    wide = _by_source(tails, fields, ["centre", "yardstick", "beta", "cutoff"])
    unnumbered = rows.sparkSession.range(16).select((-1 - F.col("id")).alias("_block"))
    blocks = to_blocks(readings, wide).unionByName(wide.crossJoin(F.broadcast(unnumbered)), allowMissingColumns=True)  # sixteen rows
    told = blocks.join(_stretches_by_block(frozen_stretches(readings, names, stuck_least)), ["_src", "_block"], "left")
    x = all_rows.join(checkpointed(told), ["_src", "_block"], "left")
    each = []
    for i, (f, r) in enumerate(fields.items()):
        v = F.col(f)
        d = v - F.col(f"centre_{i}") if r.positive_only else F.abs(v - F.col(f"centre_{i}"))
        e = F.abs(v - F.coalesce(predict(F.col(f"beta_{i}"), _season(F.col("_t"))), F.col(f"centre_{i}")))
        sub = F.floor(F.col("_seq") / SUBBLOCK)
        frozen = F.when(F.col("_spans").isNotNull() & (v != 0), F.exists(F.try_element_at("_spans", sub), lambda s: (s["_field"] == f) & F.col("_seq").between(s["_from"], s["_to"])))  # noqa: B023
        each.append(
            F.struct(
                F.lit(f).alias("field_name"), v.alias("value"), (~v.between(r.low, r.high)).alias("impossible"), F.coalesce(frozen, F.lit(False)).alias("frozen"),
                F.coalesce(e > F.col(f"cutoff_{i}"), F.lit(False)).alias("extreme"), (d > F.lit(float(r.factor)) * F.col(f"yardstick_{i}")).alias("_off"), F.col(f"cutoff_{i}").alias("cutoff"),
            )
        )
    y = x.select(F.col("_id").alias(row_id), F.inline(F.array(*each))).where(F.col("value").isNotNull())
    y = y.withColumn("stands_off", F.col("extreme") & F.coalesce("_off", F.lit(False))).drop("_off")
    return y.where(F.col("impossible") | F.col("frozen") | F.col("extreme"))


def suspect_readings(station_observation: DataFrame) -> DataFrame:
    """obs_id, field_name of the readings that cannot be, are frozen, or stand off."""
    flagged = flag_spikes(station_observation)
    return flagged.where(F.col("impossible") | F.col("frozen") | F.col("stands_off")).select("obs_id", "field_name")
