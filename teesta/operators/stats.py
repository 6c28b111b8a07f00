"""Statistics of panels and forecasts: ranks, quantile grids, shrunken rates, proper scores, calibration, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teesta.session import cut


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, largest, median: of an even number the upper middle value. Equal values are counted before a group is sorted."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = c.groupBy(*keys).agg(F.sum("_n").alias("n"), F.max(value).alias("largest"))
    x = c.withColumn("_u", F.sum("_n").over(w)).join(total, list(keys))
    return x.where((F.col("_u") - F.col("_n") <= F.floor(F.col("n") / 2)) & (F.col("_u") > F.floor(F.col("n") / 2))).select(*keys, "n", "largest", F.col(value).alias("median"))


def ensemble_summary(members: DataFrame, keys: Sequence[str], member: str, value: str) -> DataFrame:
    """Per key over the members' means: size, mean, P10 and P90 by linear interpolation."""
    m = members.groupBy(*keys, member).agg(F.avg(value).alias("_m"))
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("ensemble_size"), F.avg("_m").alias("mean"), F.percentile("_m", F.lit(0.1)).alias("p10"), F.percentile("_m", F.lit(0.9)).alias("p90"))


def quantile_grid(panel: DataFrame, key: str, week_no: str, value: str, levels: Sequence[float], reach: int = 3) -> DataFrame:
    """key, week_no, grid: quantiles over a week and `reach` weeks either side, around the year of 52; week 53 is read as 52 and given its grid."""
    x = panel.select(key, F.least(F.col(week_no), F.lit(52)).alias("_w"), value)
    x = x.select(key, value, F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_o"), "_w").select(key, value, (F.pmod(F.col("_w") - 1 + F.col("_o"), F.lit(52)) + 1).alias(week_no))
    g = x.groupBy(key, week_no).agg(F.percentile(value, F.array(*[F.lit(float(v)) for v in levels])).alias("grid"))
    return g.unionByName(g.where(F.col(week_no) == 52).withColumn(week_no, F.lit(53).cast(g.schema[week_no].dataType)))


def percentile_from_grid(value: Column, grid: Column, levels: Sequence[float]) -> Column:
    """Where a value lies in its quantile grid, by linear interpolation, held within the grid's ends."""
    n = len(levels)
    out = F.when(value <= F.element_at(grid, 1), F.lit(float(levels[0]))).when(value >= F.element_at(grid, n), F.lit(float(levels[-1])))
    for i in range(n - 1):
        a, b = F.element_at(grid, i + 1), F.element_at(grid, i + 2)
        out = out.when(value <= b, F.lit(float(levels[i])) + (value - a) / (b - a) * F.lit(float(levels[i + 1] - levels[i])))
    return out


def shrunken_climatology(train: DataFrame, key: str, week_no: str, target: str, reach: int = 3) -> DataFrame:
    """key, week_no, probability: a global rate, times the key's shrunken ratio, times the season's shrunken ratio in a circular window; held in 5e-5..0.6."""
    base = train.agg(((F.sum(target) + 0.5) / (F.count(F.lit(1)) + 1)).alias("_g"))
    k = train.groupBy(key).agg(F.sum(target).alias("_o"), F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(base))  # one row
    k = k.select(key, "_g", ((F.col("_o") + 5) / (F.col("_n") * F.col("_g") + 5)).alias("_r"))
    w = train.groupBy(F.least(F.col(week_no), F.lit(52)).alias("_w")).agg(F.sum(target).alias("_o"), F.count(F.lit(1)).alias("_n"))
    w = w.select("_o", "_n", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: F.pmod(F.col("_w") - 1 + o, F.lit(52)) + 1)).alias(week_no))
    w = w.groupBy(week_no).agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n")).crossJoin(F.broadcast(base)).select(week_no, ((F.col("_o") + 1) / (F.col("_n") * F.col("_g") + 1)).alias("_m"))  # one row
    # A grid of keys by 52 weeks is the result itself.
    return k.crossJoin(F.broadcast(w)).select(key, week_no, F.least(F.lit(0.6), F.greatest(F.lit(5e-5), F.col("_g") * F.col("_r") * F.col("_m"))).alias("probability"))


def hierarchical_rates(train: DataFrame, key: str, month: str, target: str, prior: float = 5.0) -> DataFrame:
    """key, month, rate: the key's month shrunken to the month's rate, that to the global one."""
    g = train.agg(F.avg(target).alias("_g"))
    m = train.groupBy(month).agg(F.sum(target).alias("_mo"), F.count(F.lit(1)).alias("_mn")).crossJoin(F.broadcast(g)).select(month, ((F.col("_mo") + prior * F.col("_g")) / (F.col("_mn") + prior)).alias("_m"))  # one row
    k = train.groupBy(key, month).agg(F.sum(target).alias("_o"), F.count(F.lit(1)).alias("_n"))
    return k.join(m, month).select(key, month, ((F.col("_o") + prior * F.col("_m")) / (F.col("_n") + prior)).alias("rate"))


def scores(df: DataFrame, p: str, y: str, clip: float = 1e-6) -> DataFrame:
    """n, brier, log_score, base_rate, brier_skill against the base rate."""
    q = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col(p)))
    a = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_score"), F.avg(y).alias("base_rate"))
    ref = F.col("base_rate") * (1 - F.col("base_rate"))
    return a.withColumn("brier_skill", F.when(ref > 0, 1 - F.col("brier") / ref).otherwise(0.0))


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the curve with average ranks for ties; null with one class. Ranks run over counts of different scores, added up in blocks, so no task sorts all rows."""
    c = df.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_k"))
    ranked = running_total(c, "_p", ["_n"])
    a = ranked.agg(F.sum(F.col("_k") * (F.col("_before__n") + (F.col("_n") + 1) / 2)).alias("_r"), F.sum("_k").alias("_pos"), F.sum(F.col("_n") - F.col("_k")).alias("_neg"))
    return a.select(F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), (F.col("_r") - F.col("_pos") * (F.col("_pos") + 1) / 2) / (F.col("_pos") * F.col("_neg"))).alias("auc"))


def running_total(df: DataFrame, order: str, sums: Sequence[str], blocks: int = 256) -> DataFrame:
    """`df` (one row for each value of the number `order`) with _before_<c>: the total of c over lower values.

    Values are cut into blocks at approximate quantiles, so the running total is
    taken within blocks by many tasks and the blocks' totals are added on.
    """
    cuts = df.agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 10 * blocks).alias("_cuts"))
    x = df.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda q: q < F.col(order)))).drop("_cuts")  # one row
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = x.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    bw = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    t = t.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(bw), F.lit(0)).alias(f"_s_{c}") for c in sums])
    return x.join(F.broadcast(t), "_b").select(*df.columns, *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_s_{c}")).alias(f"_before_{c}") for c in sums])


def row_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`df` with the number of each row in `order`, from 1: rows are split by range and numbered in parts, the parts' sizes added on."""
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))  # one row a part
    return x.join(F.broadcast(before), "_part").select(*df.columns, (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_off")).alias(name))


def reliability_bins(df: DataFrame, p: str, y: str, tie: str, bins: int = 10) -> DataFrame:
    """bin, n, low, high, mean_p, rate: bins of floor(n/bins) rows in order of (p, tie); the last takes the rest."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    x = row_numbers(df.select(p, y, tie), [p, tie], "_rn").crossJoin(F.broadcast(total))  # one row
    size = F.greatest(F.lit(1), F.floor(F.col("_all") / bins))
    x = x.withColumn("bin", F.least(F.floor((F.col("_rn") - 1) / size), F.lit(bins - 1)).cast("int"))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration_error(binned: DataFrame) -> DataFrame:
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def fixed_bins(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    """bin, n, mean_p, rate over equal widths; empty bins stay with nought."""
    x = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(x, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_p", F.lit(0.0)).alias("mean_p"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone, however the rows are partitioned."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pit_histogram(df: DataFrame, u: Column, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, chi_squared: randomised probability integral transform of binary forecasts, all bins told, and its distance from an even spread.

    `u` is a number in [0, 1) for each row; hashed_uniform makes one from a key.
    """
    pit = F.when(F.col(y) == 1, 1 - F.col(p) + u * F.col(p)).otherwise(u * (1 - F.col(p)))
    counts = df.groupBy(F.least(F.lit(bins - 1), F.floor(pit * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    even = F.sum("n").over(Window.partitionBy()) / bins  # as many rows as bins
    return every.withColumn("chi_squared", F.sum(F.pow(F.col("n") - even, 2) / even).over(Window.partitionBy()))


def block_bootstrap(df: DataFrame, block: str, p: str, y: str, reference: str | None = None, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """brier, low, high of the Brier score with whole blocks drawn again; with a `reference` also delta, delta_low, delta_high, better.

    Model and reference are drawn together, so the difference (reference less
    model) is of the same blocks; better is the share of replicates where the
    model wins. Rows are reduced to three sums a block first.
    """
    other = F.col(reference) if reference else F.lit(None).cast("double")
    b = df.groupBy(block).agg(F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("_s"), F.sum(F.pow(other - F.col(y), 2)).alias("_q"), F.count(F.lit(1)).alias("_n"))
    b = b.withColumn("_i", F.row_number().over(Window.orderBy(block)) - 1)  # one row a block
    n = b.agg(F.count(F.lit(1)).alias("_blocks"))
    draws = df.sparkSession.range(replicates).withColumnRenamed("id", "_rep").crossJoin(F.broadcast(n)).select("_rep", "_blocks", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))).alias("_k"))  # one row
    draws = draws.select("_rep", F.floor(hashed_uniform(F.col("_rep"), F.col("_k"), F.lit(seed)) * F.col("_blocks")).cast("int").alias("_i"))
    r = draws.join(b, "_i").groupBy("_rep").agg((F.sum("_s") / F.sum("_n")).alias("_v"), ((F.sum("_q") - F.sum("_s")) / F.sum("_n")).alias("_d"))
    ends = lambda c, lo, hi: [F.percentile(c, F.lit(0.025)).alias(lo), F.percentile(c, F.lit(0.975)).alias(hi)]
    point = b.agg((F.sum("_s") / F.sum("_n")).alias("brier"), ((F.sum("_q") - F.sum("_s")) / F.sum("_n")).alias("delta"))
    out = r.agg(*ends("_v", "low", "high"), *ends("_d", "delta_low", "delta_high"), F.avg(F.when(F.col("_d") > 0, 1.0).otherwise(0.0)).alias("better")).crossJoin(point)  # two single rows
    return out.select("brier", "low", "high", *(["delta", "delta_low", "delta_high", "better"] if reference else []))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """`df` with the mean rank of equal values; ranks run over counts of different values, added up in blocks. Nulls have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_total(counts, value, ["_n"]).select(F.col(value).alias("_of"), (F.col("_before__n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("_of"), "left").drop("_of")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; null for fewer than three rows or no variation."""
    x = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return x.agg(F.when((F.count(F.lit(1)) >= 3) & (F.stddev_pop("_ra") > 0) & (F.stddev_pop("_rb") > 0), F.corr("_ra", "_rb")).alias("spearman"))


def priority(df: DataFrame, key: str, p: str, context: str) -> DataFrame:
    """100 (0.8 percent rank of p + 0.2 context); the percent rank is the share of the others below."""
    counts = df.groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    below = running_total(counts, p, ["_n"]).select(F.col(p).alias("_of"), F.col("_before__n").alias("_below"))
    total = counts.agg(F.sum("_n").alias("_all"))
    x = df.join(below, F.col(p) == F.col("_of")).crossJoin(F.broadcast(total))  # one row
    rank = F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(0.0)
    return x.select(key, (100 * (0.8 * rank + 0.2 * F.col(context))).alias("priority"))


def class_breaks(df: DataFrame, value: str, most: int = 5) -> DataFrame:
    """class_no, low, high, n: up to `most` classes whose lower bounds are quantiles of the different values."""
    u = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    size = u.agg(F.count(F.lit(1)).alias("_u"))
    x = running_total(u, "_v", ["_one"]).crossJoin(F.broadcast(size))  # one row
    x = x.withColumn("class_no", F.floor(F.col("_before__one") * F.least(F.lit(most), F.col("_u")) / F.col("_u")).cast("int"))
    return x.groupBy("class_no").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.sum("_n").alias("n"))


def month_weights(df: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """key, month, weight: share of a window's days that fall in each calendar month."""
    d = df.select(key, F.explode(F.sequence(begin, end, F.expr("interval 1 day"))).alias("_d")).groupBy(key, F.month("_d").alias("month")).agg(F.count(F.lit(1)).alias("_n"))
    return d.withColumn("weight", F.col("_n") / F.sum("_n").over(Window.partitionBy(key))).drop("_n")  # at most twelve rows a key


def blended(weights: DataFrame, rates: DataFrame, key: str, rate: str, fallback: float) -> DataFrame:
    """Sum of weight times the month's rate, `fallback` where it lacks one."""
    return weights.join(rates, "month", "left").groupBy(key).agg(F.sum(F.col("weight") * F.coalesce(rate, F.lit(fallback))).alias("blend"))


def standardised(df: DataFrame, columns: Sequence[str], floor: float = 1e-9) -> DataFrame:
    """Columns less their mean over their population deviation."""
    m = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"_s_{c}"))])
    x = df.crossJoin(F.broadcast(m))  # one row
    return x.select(*[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
