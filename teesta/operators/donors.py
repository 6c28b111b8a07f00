"""Missing values filled from similar records by predictive mean matching.

A regression with coefficients per group predicts each field for every row; a
cell without a real value takes over the observed value of the row of its group
whose prediction lies nearest, and keeps that row's id as donor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teesta.functions.harmonic import fit_normal_equations, predict

# Texts that only stand for nothing, lower case, trimmed.
STAND_INS = ["", "-", "--", "na", "n/a", "n.a.", "nan", "nil", "null", "none", "unknown", "unk", "not available", "not known", "?", "."]


def real_text(c: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(c.cast("string"), r"[\s ]+", " ")))
    return c.isNotNull() & ~t.isin(STAND_INS)


def real_count(c: Column, limit: Column) -> Column:
    v = c.cast("double")
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= limit), F.lit(False))


def real_share(c: Column) -> Column:
    v = c.cast("double")
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1), F.lit(False))


def filler_limits(rows: DataFrame, group: Column, fields: Sequence[str], times: float = 20.0, share: float = 0.9) -> DataFrame:
    """_group and the largest believable figure of each field in it: `times` the larger of the group's and the whole table's
    `share` quantile over the non-negative values (1 at least). A group of large figures may go further than the others."""
    v = lambda f: F.when((F.col(f).cast("double") >= 0) & ~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    high = lambda f: F.coalesce(F.percentile_approx(v(f), share, 10000), F.lit(0.0))
    overall = rows.agg(*[F.greatest(high(f), F.lit(1.0)).alias(f"_all_{f}") for f in fields])
    own = rows.groupBy(group.alias("_group")).agg(*[high(f).alias(f"_own_{f}") for f in fields])
    return own.crossJoin(F.broadcast(overall)).select("_group", *[(F.greatest(f"_own_{f}", f"_all_{f}") * times).alias(f"_limit_{f}") for f in fields])  # one row beside each group


def nearest_donors(cells: DataFrame, keys: Sequence[str], target_rows: int = 20_000, most_buckets: int = 256) -> DataFrame:
    """For each cell without a value the donor of its group with the nearest prediction.

    `cells`: keys, `_id`, `_pred`, `_value` (null where missing). Returns the
    cells without a value with `_donor` and `_given` (both null if the group has
    no donor) and `_donors`, the number of donors of the group. Of two donors equally near the one below is taken; of equal
    predictions the nearest id in order.

    Groups above `target_rows` are cut into buckets of prediction ranges at
    quantiles of the group, so that a hot group is sorted by many tasks; the
    nearest donors beyond a bucket's ends come from a summary of each bucket.
    """
    fractions = [i / most_buckets for i in range(1, most_buckets)]
    count = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count("_value").alias("_donors"), F.when(F.count(F.lit(1)) > target_rows, F.percentile_approx("_pred", fractions, 4 * most_buckets)).alias("_q"))
    # A group gets as many cuts as its size asks for, so that a row is held against few.
    want = F.least(F.lit(most_buckets), F.ceil(F.col("_n") / target_rows)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), want - 1), lambda i: F.element_at("_q", F.round(i * most_buckets / want).cast("int")))
    sized = count.select(*keys, "_donors", F.when(F.col("_n") > target_rows, F.array_distinct(picked)).alias("_q"))
    c = cells.join(sized, list(keys))
    # Equal predictions stay in one bucket; a bucket is the number of cuts below the prediction.
    c = c.withColumn("_bucket", F.coalesce(F.size(F.filter("_q", lambda q: q < F.col("_pred"))), F.lit(-1)).cast("int")).drop("_q")
    donor = F.when(F.col("_value").isNotNull(), F.struct("_pred", "_id", "_value"))
    up = Window.partitionBy(*keys, "_bucket").orderBy("_pred", "_id").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_pred"), F.desc("_id")).rowsBetween(Window.unboundedPreceding, -1)
    x = c.withColumn("_d", donor).withColumn("_below", F.last("_d", ignorenulls=True).over(up)).withColumn("_above", F.last("_d", ignorenulls=True).over(down))
    ends = c.where(F.col("_value").isNotNull()).groupBy(*keys, "_bucket").agg(F.min(F.struct("_pred", "_id", "_value")).alias("_first"), F.max(F.struct("_pred", "_id", "_value")).alias("_last"))
    # Buckets without donors must be passed over, so every bucket that has cells takes part.
    spine = c.select(*keys, "_bucket").distinct().join(ends, [*keys, "_bucket"], "left")
    b_up = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    b_down = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = spine.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(b_up).alias("_lower"), F.last("_first", ignorenulls=True).over(b_down).alias("_upper"))
    y = x.where(F.col("_value").isNull()).drop("_value", "_d").join(beyond, [*keys, "_bucket"], "left")
    low, high = F.coalesce("_below", "_lower"), F.coalesce("_above", "_upper")
    pick = F.when(low.isNull(), high).when(high.isNull(), low).when(F.col("_pred") - low["_pred"] <= high["_pred"] - F.col("_pred"), low).otherwise(high)
    return y.withColumn("_pick", pick).select(*keys, "_id", "_pred", "_donors", F.col("_pick._id").alias("_donor"), F.col("_pick._value").alias("_given"))


def fill_health_cells(rows: DataFrame) -> DataFrame:
    """row_id, field_name, filled_value string, donor_row_id, group_donors of every cell of the four fields without a real value.

    A cell has no real value if it is null, NaN, blank or a stand-in text, a
    share outside 0..1, a negative count, no tests beside positive records, or a
    filler far above all other figures. Donors come from rows of the same
    district_id (rows without one form a group of their own); where a whole
    group has no real value, the donor and the value stay null. Repeated rows
    are rows of their own. Of an empty table an empty table comes out; other
    columns are ignored.
    """
    counts = ["malaria_tests", "dengue_positive_records"]
    group = F.coalesce(F.col("district_id"), F.lit(""))
    r = rows.withColumn("_group", group).join(filler_limits(rows, group, counts), "_group")
    log = lambda f: F.log1p(F.greatest(F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0)), F.lit(0.0)))
    tests_ok = real_count(F.col("malaria_tests"), F.col("_limit_malaria_tests")) & ~F.coalesce((F.col("malaria_tests") == 0) & (F.col("malaria_positive_records") > 0), F.lit(False))
    month = F.coalesce(F.col("month_no").cast("double"), F.lit(0.0)) * F.lit(3.141592653589793 / 6)
    x = r.select(
        "_group",
        F.col("row_id").alias("_id"),
        log("malaria_microscopy_tests").alias("_x1"), log("malaria_microscopy_positive_records").alias("_x2"), log("malaria_rdt_positive_records").alias("_x3"), log("childhood_diarrhoea_records").alias("_x4"),
        F.sin(month).alias("_x5"), F.cos(month).alias("_x6"),
        F.inline(F.array(
            F.struct(F.lit("malaria_tests").alias("_field"), F.when(tests_ok, F.col("malaria_tests").cast("string")).alias("_value"), F.when(tests_ok, F.log1p(F.col("malaria_tests").cast("double"))).alias("_y")),
            F.struct(F.lit("malaria_test_positivity").alias("_field"), F.when(real_share(F.col("malaria_test_positivity")), F.col("malaria_test_positivity").cast("string")).alias("_value"), F.when(real_share(F.col("malaria_test_positivity")), F.col("malaria_test_positivity").cast("double")).alias("_y")),
            F.struct(F.lit("dengue_positive_records").alias("_field"), F.when(real_count(F.col("dengue_positive_records"), F.col("_limit_dengue_positive_records")), F.col("dengue_positive_records").cast("string")).alias("_value"), F.when(real_count(F.col("dengue_positive_records"), F.col("_limit_dengue_positive_records")), F.log1p(F.col("dengue_positive_records").cast("double"))).alias("_y")),
            # A name is matched on the predicted number of tests: only the group decides which name it can be.
            F.struct(F.lit("district_name").alias("_field"), F.when(real_text(F.col("district_name")), F.col("district_name")).alias("_value"), F.when(tests_ok, F.log1p(F.col("malaria_tests").cast("double"))).alias("_y")),
        )),
    )
    features = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, 7)]]
    beta = fit_normal_equations(x, ["_field", "_group"], "_y", features).select("_field", "_group", "beta")
    cells = x.join(beta, ["_field", "_group"], "left").select("_field", "_group", "_id", F.coalesce(predict(F.col("beta"), features), F.lit(0.0)).alias("_pred"), "_value")
    found = nearest_donors(cells, ["_field", "_group"])
    return found.select(F.col("_id").alias("row_id"), F.col("_field").alias("field_name"), F.col("_given").alias("filled_value"), F.col("_donor").alias("donor_row_id"), F.col("_donors").alias("group_donors"))


def filled_health_rows(rows: DataFrame) -> DataFrame:
    """row_id, the four fields with their gaps filled, and `filled`, a map of each filled field to its donor's row_id."""
    f = fill_health_cells(rows)
    wide = f.groupBy("row_id").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("field_name", "donor_row_id")))).alias("filled"),
        *[F.max(F.when(F.col("field_name") == n, F.col("filled_value"))).alias(f"_{n}") for n in ("malaria_tests", "malaria_test_positivity", "dengue_positive_records", "district_name")],
    )
    x = rows.select("row_id", "malaria_tests", "malaria_test_positivity", "dengue_positive_records", "district_name").join(wide, "row_id", "left")
    new = lambda n, kind: F.when(F.array_contains(F.map_keys("filled"), n), F.col(f"_{n}").cast(kind)).otherwise(F.col(n)).alias(n)
    return x.select("row_id", new("malaria_tests", "int"), new("malaria_test_positivity", "double"), new("dengue_positive_records", "int"), new("district_name", "string"), F.coalesce("filled", F.create_map().cast("map<string,bigint>")).alias("filled"))


def cells_without_value(hmis_row: DataFrame) -> DataFrame:
    """row_id, field_name of the cells that took over a donor's value, or whose group has no donor at all."""
    found = fill_health_cells(hmis_row)
    return found.where((F.col("donor_row_id").isNotNull() & F.col("filled_value").isNotNull()) | (F.col("group_donors") == 0)).select("row_id", "field_name")


def donor_audit(hmis_row: DataFrame) -> DataFrame:
    """row_id, field_name, same_group, same_value: each filled cell held against its donor's own row."""
    fields = ["malaria_tests", "malaria_test_positivity", "dengue_positive_records", "district_name"]
    found = fill_health_cells(hmis_row).where(F.col("donor_row_id").isNotNull())
    stack = F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("own_value")) for f in fields]))
    given = hmis_row.select(F.col("row_id").alias("donor_row_id"), F.coalesce("district_id", F.lit("")).alias("donor_group"), stack)
    taker = hmis_row.select("row_id", F.coalesce("district_id", F.lit("")).alias("own_group"))
    x = found.join(given, ["donor_row_id", "field_name"], "left").join(taker, "row_id")
    return x.select("row_id", "field_name", F.coalesce(F.col("own_group") == F.col("donor_group"), F.lit(False)).alias("same_group"), F.coalesce(F.col("filled_value") == F.col("own_value"), F.lit(False)).alias("same_value"))
