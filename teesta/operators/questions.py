"""Questions in plain words: what they ask for, their scope, and answers from panels and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teesta.operators import cues as C


def holds(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds one of the terms; false for null."""
    return F.coalesce(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)), F.lit(False))


def intent(question: Column, has_disease: Column) -> Column:
    """The first rule that applies; which rules there are depends on whether a disease is named.

    A comparison is about statistics only with a counted noun, a trend or a
    distribution by the disease alone; words for evidence keep both with texts.
    """
    q = F.lower(question)
    has = lambda terms: holds(q, terms)
    sick = F.coalesce(has_disease, F.lit(False))
    evidence = has(C.EVIDENCE_NOUNS)
    forecast = has(C.FORECAST_TERMS) | (sick & has(C.OUTLOOK_TERMS)) | (has(C.FUTURE_TERMS) & (sick | has(C.OUTBREAK_TERMS)))
    counted = has(C.INCIDENCE_TERMS) | (holds(q, ["how many"]) & holds(q, ["case"]))
    compared = sick & has(C.COMPARISON_TERMS) & has(C.STATISTIC_NOUNS) & ~evidence
    spread = sick & (has(C.TREND_TERMS) | has(C.DISTRIBUTION_TERMS)) & ~evidence
    return (
        F.when(has(C.CLINICAL_TERMS), "clinical_advice_request").when(forecast, "forecast_request").when(counted | compared | spread, "incidence_request")
        .when(has(C.AUDIT_TERMS), "data_audit").when(has(C.VERIFIED_TERMS), "verified_events").when(has(C.ALERT_TERMS), "candidate_alerts").otherwise("evidence_search")
    )


def horizon_weeks(question: Column) -> Column:
    """Weeks ahead a question asks for, one if it names none."""
    q = F.lower(question)
    return (
        F.when(holds(q, ["three month", "3 month", "12 week"]), 12).when(holds(q, ["two month", "2 month", "8 week"]), 8).when(holds(q, ["next month", "one month", "4 week"]), 4)
        .when(holds(q, ["2 week", "two week"]), 2).otherwise(1)
    )


def horizon_months(question: Column) -> Column:
    q = F.lower(question)
    return F.when(holds(q, ["three month", "3 month", "12 week"]), 3).when(holds(q, ["two month", "2 month", "8 week"]), 2).otherwise(1)


def scope(turns: DataFrame, conversation: str, turn: str, matches: str) -> DataFrame:
    """`turns` with `resolved` and `scope_state`: the one match of a turn, else that of the newest earlier turn with exactly one."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    one = F.when(F.size(matches) == 1, F.element_at(matches, 1))
    earlier = F.last(one, ignorenulls=True).over(w)
    n = F.size(matches)
    return turns.withColumn("resolved", F.when(n == 1, F.element_at(matches, 1)).when(n == 0, earlier)).withColumn("scope_state", F.when(n == 1, "stated").when(n > 1, "ambiguous").when(earlier.isNotNull(), "inherited").otherwise("unscoped"))


def yearly(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """key, year, total: sums of the years with a figure; a year without any is absent, not nought."""
    return df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key, year).agg(F.sum(value).alias("total"))


def annual_trend(totals: DataFrame, key: str, year: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """key, first_year, last_year, first_total, last_total, change, peak_year, lowest_year, in_window.

    Over the years asked for; a key with fewer than two of them is answered over
    its whole series, which in_window says.
    """
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col(year) >= first)
    if last is not None:
        inside = inside & (F.col(year) <= last)
    x = totals.withColumn("_in", inside).groupBy(key).agg(
        F.count_if("_in").alias("_n"),
        *[
            f.alias(n + s)
            for s, cond in (("", F.col("_in")), ("_all", F.lit(True)))
            for n, f in (
                ("first_year", F.min(F.when(cond, F.col(year)))), ("last_year", F.max(F.when(cond, F.col(year)))),
                ("first_total", F.min_by("total", F.when(cond, F.col(year)))), ("last_total", F.max_by("total", F.when(cond, F.col(year)))),
                ("peak_year", F.max_by(year, F.when(cond, F.struct("total", (-F.col(year)).alias("y"))))), ("lowest_year", F.min_by(year, F.when(cond, F.struct("total", F.col(year).alias("y"))))),
            )
        ],
    )
    enough = F.col("_n") >= 2
    names = ["first_year", "last_year", "first_total", "last_total", "peak_year", "lowest_year"]
    x = x.select(key, enough.alias("in_window"), *[F.when(enough, F.col(n)).otherwise(F.col(f"{n}_all")).alias(n) for n in names])
    return x.withColumn("change", F.col("last_total") - F.col("first_total"))


def observation_answer(totals: DataFrame, key: str, wanted: Sequence[str], k: int = 5) -> DataFrame:
    """position, key, total: the statewide sum for no place asked for, else each place, nulls last; beside the top k for ranking."""
    per = totals.groupBy(key).agg(F.sum("total").alias("total"))
    ranked = per.orderBy(F.desc("total"), key).limit(k).select(F.lit("ranking").alias("answer"), key, "total")
    state = per.agg(F.sum("total").alias("total")).select(F.lit("statewide").alias("answer"), F.lit("ALL").alias(key), "total")
    places = totals.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string").join(per, key, "left").select(F.lit("comparison").alias("answer"), key, "total")
    return ranked.unionByName(state).unionByName(places)


def layered(places: DataFrame, key: str, layers: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """key, value, layer: the first layer that has a figure for the place; 'unavailable' where none has."""
    x = places.select(key)
    for i, (_, df, value) in enumerate(layers):
        x = x.join(df.select(key, F.col(value).cast("double").alias(f"_v{i}")), key, "left")
    named = F.lit("unavailable")
    for i in reversed(range(len(layers))):
        named = F.when(F.col(f"_v{i}").isNotNull(), layers[i][0]).otherwise(named)
    return x.select(key, F.coalesce(*[F.col(f"_v{i}") for i in range(len(layers))]).alias("value"), named.alias("layer"))


def named_places(question: Column) -> Column:
    """Capitalised names after a word of place, or before 'district'."""
    after = F.regexp_extract_all(question, F.lit(r"\b(?:in|at|for|from|near|around|about|across)\s+(?!the\b)([A-Z][A-Za-z]{2,})"), 1)
    before = F.regexp_extract_all(question, F.lit(r"\b([A-Z][A-Za-z]{2,})\s+(?:[Dd]istrict)\b"), 1)
    return F.array_distinct(F.concat(after, before))


def off_scope_places(questions: DataFrame, key: str, text: str, known: DataFrame, name: str) -> DataFrame:
    """key, place: capitalised places of a question that `known` doesn't have."""
    x = questions.where(F.col(text).isNotNull()).select(key, F.explode(named_places(F.col(text))).alias("place"))
    return x.join(known.select(F.lower(name).alias("_k")).distinct(), F.lower("place") == F.col("_k"), "left_anti")


def evidence_answer(rows: DataFrame, key: str, text: str, at: str, query: str, fetch: int = 20, most: int = 4) -> DataFrame:
    """position, key, score, record: the newest max(4 k, fetch) rows, ranked by the query's words; the best `most` as numbered records.

    The two limits are the feature: what is newest is looked at first.
    """
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{Nd}_]+)"), 1))
    newest = rows.where(F.col(text).isNotNull()).orderBy(F.desc(at), F.desc(key)).limit(max(most * 4, fetch))
    scored = newest.select(key, at, F.col(text).alias("_t"), F.round(F.size(F.array_intersect(words, tokens)) / F.size(words), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), F.desc(at), key).limit(most)
    order = Window.orderBy(F.desc("score"), F.desc(at), key)  # at most `most` rows
    n = F.row_number().over(order)
    return top.select(n.alias("position"), key, "score", F.concat(F.lit("[E"), n.cast("string"), F.lit("] "), F.substring(F.translate(F.regexp_replace("_t", r"\p{Cc}", " "), "<>", "‹›"), 1, 400)).alias("record"))
