"""Signals from documents: sentence links, processing states, review scores of copies, and views of them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teesta.operators import cues as C
from teesta.operators import panel, text


def tag_terms(texts: DataFrame, column: str, vocabularies: Mapping[str, DataFrame], most_terms: int = 200_000) -> DataFrame:
    """`texts` with one array<string> column for each vocabulary (group, term): the groups that stand in `column` as words, in order.

    Vocabularies are dimension tables; more than `most_terms` rows are refused.
    """
    terms = {}
    for name, v in vocabularies.items():
        rows = v.select("group", "term").where("group is not null and term is not null").distinct().limit(most_terms + 1).collect()
        if len(rows) > most_terms:
            raise ValueError(f"{name} has more than {most_terms} terms: use match_terms")
        terms[name] = [(r[0], r[1]) for r in rows]
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([*texts.schema.fields, *[T.StructField(name, T.ArrayType(T.StringType())) for name in vocabularies]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finders = {n: text.TermFinder(t) for n, t in shared.value.items()}
        for b in batches:
            yield b.assign(**{n: [sorted(f.find(x or "")) for x in b[column]] for n, f in finders.items()})

    return texts.mapInPandas(run, schema)


def blocks(c: Column) -> Column:
    """Pieces between full stops, dandas, question marks and line ends, trimmed and not empty."""
    return F.filter(F.transform(F.split(c, r"[.!?।॥\r\n]+"), F.trim), lambda x: x != "")


def sentence_links(documents: DataFrame, key: str, body: str, at: str, publisher: str, diseases: DataFrame, districts: DataFrame) -> DataFrame:
    """key, disease, district_id, found_class, ambiguous: what each document says of a disease at a place.

    A disease is linked in the block it stands in: to the one district named
    there, or to the publisher's where none is named or it is among several. What
    stays without a district, or a document without any link, gives one ambiguous
    row: with the disease if it is a single one, and the class of the whole text.
    Documents without a disease give nothing.
    """
    d = documents.where(F.col(body).isNotNull())
    x = tag_terms(d.select(key, at, publisher, F.explode(blocks(F.col(body))).alias("_block")), "_block", {"_diseases": diseases, "_places": districts}).where(F.size("_diseases") > 0)
    fits = F.col(publisher).isNotNull() & ((F.size("_places") == 0) | F.array_contains("_places", F.col(publisher)))
    place = F.when(F.size("_places") == 1, F.element_at("_places", 1)).when(fits, F.col(publisher))
    x = x.select(key, place.alias("district_id"), text.assertion_class(F.col("_block"), F.year(at)).alias("found_class"), F.explode("_diseases").alias("disease"))
    linked = x.where(F.col("district_id").isNotNull()).select(key, "disease", "district_id", "found_class").distinct()
    said = x.groupBy(key).agg(
        F.collect_set(F.when(F.col("district_id").isNull(), F.col("disease"))).alias("_open"), F.collect_set(F.when(F.col("district_id").isNotNull(), F.col("disease"))).alias("_linked")
    )
    left = F.array_except("_open", "_linked")
    rest = said.where((F.size(left) > 0) | (F.size("_linked") == 0)).select(key, F.when(F.size(left) == 1, F.element_at(left, 1)).alias("disease"))
    whole = d.select(key, text.assertion_class(F.col(body), F.year(at)).alias("found_class")).dropDuplicates([key])
    rest = rest.join(whole, key).select(key, "disease", F.lit(None).cast("string").alias("district_id"), "found_class", F.lit(True).alias("ambiguous"))
    return linked.withColumn("ambiguous", F.lit(False)).unionByName(rest)


# Marks of personal data that placeholders leave or that ask for review.
_PRIVATE = r"(?:\+91[ -]?\d{5}[ -]?\d{5})|(?:\b\d{4}[ -]?\d{4}[ -]?\d{4}\b)|[\w.+-]+@[\w-]+\.[\w.-]+"


def process(documents: DataFrame, key: str, body: str, at: str, diseases: DataFrame, districts: DataFrame) -> DataFrame:
    """key, route, redacted, diseases, districts, found_class, coverage_state, eligible, warnings, content_sha256 of each document.

    Route, then redaction of direct identifiers, then matches and class on the
    redacted text. coverage_state: language_review_required for an undetermined
    or mixed route, privacy_review_required where something was redacted, else
    active_direct. Eligible: affirmed, active, with a disease and a district.
    A null text is undetermined, without matches.
    """
    x = documents.select(key, at, F.col(body).alias("_raw"), text.language_route(F.col(body)).alias("route"), F.regexp_replace(body, _PRIVATE, "[REDACTED]").alias("redacted"))
    x = tag_terms(x, "redacted", {"diseases": diseases, "districts": districts})
    hidden = F.coalesce(F.col("redacted") != F.col("_raw"), F.lit(False))
    state = F.when(F.col("route").isin("und", "mixed"), "language_review_required").when(hidden, "privacy_review_required").otherwise("active_direct")
    x = x.withColumn("found_class", text.assertion_class(F.col("redacted"), F.year(at))).withColumn("coverage_state", state)
    rules = {"no_disease": F.size("diseases") == 0, "no_district": F.size("districts") == 0, "several_districts": F.size("districts") > 1, "identifiers_redacted": hidden}
    eligible = (F.col("found_class") == "affirmed") & (F.col("coverage_state") == "active_direct") & (F.size("diseases") > 0) & (F.size("districts") > 0)
    return x.select(
        key, "route", "redacted", F.array_join("diseases", ",").alias("diseases"), F.array_join("districts", ",").alias("districts"), "found_class", "coverage_state", eligible.alias("eligible"),
        F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])), ",").alias("warnings"), F.sha2("redacted", 256).alias("content_sha256"),
    )


def review_score(same_disease: Column, same_district: Column, hours: Column, lexical: Column, cross_language: Column) -> Column:
    """0.4 disease + 0.4 district + 0.2 (1 - hours / 96) within 72 hours; within a language 0.7 of that and 0.3 of the word overlap."""
    s = F.when(same_disease, 0.4).otherwise(0.0) + F.when(same_district, 0.4).otherwise(0.0) + F.when(hours <= 72, 0.2 * (1 - hours / 96)).otherwise(0.0)
    return F.round(F.when(cross_language, s).otherwise(F.least(F.lit(1.0), s * 0.7 + lexical * 0.3)), 4)


def _reasons(same_disease: Column, same_district: Column, hours: Column, lexical: Column, cross: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(same_disease, "same_normalised_disease"), F.when(same_district, "same_resolved_district"), F.when(hours <= 72, "retrieved_within_72_hours"), F.when(~cross & (lexical >= 0.7), "high_within_language_token_overlap"))), ",")


def _scored(x: DataFrame, key: str) -> DataFrame:
    same = lambda c: F.coalesce(F.col(c) == F.col(f"{c}_b"), F.lit(False))
    hours = F.abs(F.unix_micros("at") - F.unix_micros("at_b")) / 3.6e9
    lexical = F.col("lexical")
    cross = ~F.coalesce(F.col("language") == F.col("language_b"), F.lit(False))
    score = review_score(same("disease"), same("district_id"), hours, lexical, cross)
    y = x.select(key, f"{key}_b", cross.alias("cross_language"), score.alias("score"), _reasons(same("disease"), same("district_id"), hours, lexical, cross).alias("reasons"))
    return y.where(F.col("score") >= F.when(F.col("cross_language"), 0.70).otherwise(0.75))


def copy_candidates(signals: DataFrame, key: str, body: str, disease: str, district: str, at: str, language: str) -> DataFrame:
    """key, key_b, cross_language, score, reasons: each signal sent in with a text that stood before, held against the first with that text.

    Pairs with one representative, not all pairs of copies. Null texts are none.
    """
    x = signals.where(F.col(body).isNotNull()).select(key, F.sha2(F.lower(text.collapsed(F.col(body))), 256).alias("_f"), F.col(disease).alias("disease"), F.col(district).alias("district_id"), F.col(at).alias("at"), F.col(language).alias("language"))
    rest = ["disease", "district_id", "at", "language"]
    first = x.groupBy("_f").agg(F.min_by(F.struct(key, *rest), F.struct("at", key)).alias("_r"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = first.select("_f", F.col(f"_r.{key}").alias(f"{key}_b"), *[F.col(f"_r.{c}").alias(f"{c}_b") for c in rest])
    return _scored(x.join(first, "_f").where(F.col(key) != F.col(f"{key}_b")).withColumn("lexical", F.lit(1.0)), key)


def cross_language_candidates(signals: DataFrame, key: str, disease: str, district: str, at: str, language: str, languages: Sequence[str] = ("en", "hi", "or", "bn", "mr")) -> DataFrame:
    """key, key_b, cross_language, score, reasons: of each signal the last earlier one of its disease and district in every other language.

    Signals of one disease, district and time are candidates in whatever
    language; a chain of nearest ones stands for all pairs. As-of joins by blocks
    of time carry the partner on.
    """
    x = signals.where(F.col(disease).isNotNull() & F.col(district).isNotNull() & F.col(at).isNotNull()).select(key, F.col(disease).alias("disease"), F.col(district).alias("district_id"), F.col(at).alias("at"), F.col(language).alias("language"))
    wanted = x.select("*", F.explode(F.array(*[F.lit(c) for c in languages])).alias("other")).where(~F.coalesce(F.col("language") == F.col("other"), F.lit(False)))
    facts = x.select("disease", "district_id", F.col("language").alias("other"), F.col("at").alias("known"), F.col(key).alias("k"), F.struct(F.col(key).alias("id"), F.col("at").alias("t")).alias("v"))
    y = panel.as_of_join(wanted, facts, ["disease", "district_id", "other"], "at", "known", "k", "v").where(F.col("v").isNotNull() & (F.col("v.id") != F.col(key)))
    z = y.select(key, "disease", "district_id", "at", "language", F.col("v.id").alias(f"{key}_b"), F.col("disease").alias("disease_b"), F.col("district_id").alias("district_id_b"), F.col("v.t").alias("at_b"), F.col("other").alias("language_b"), F.lit(0.0).alias("lexical"))
    return _scored(z, key)


def signal_view(signals: DataFrame, snapshots: DataFrame, districts: DataFrame, placeholder: str = "[live text not retained]") -> DataFrame:
    """signal_id, title, district, review_state, shown_text: live text is masked, that of fixtures shown."""
    x = signals.join(snapshots.select(F.col("snapshot_id").alias("source_snapshot_id"), "is_fixture"), "source_snapshot_id", "left").join(districts.select("district_id", "canonical_name"), "district_id", "left")
    name = F.coalesce("canonical_name", F.initcap(F.translate(F.regexp_replace("district_id", r"^[A-Z]+-DIST-", ""), "-_", "  ")))
    state = (
        F.when(F.col("processing_state") != "active_direct", F.concat(F.lit("held_"), F.col("processing_state"))).when(F.col("assertion_class") != "affirmed", "not_reviewable")
        .when(F.col("event_review_eligible"), "awaiting_review").otherwise("published")
    )
    return x.select(
        "signal_id", F.concat(F.initcap(F.coalesce("disease", F.lit("unspecified"))), F.lit(" in "), F.coalesce(name, F.lit("an unresolved place"))).alias("title"), name.alias("district"),
        state.alias("review_state"), F.when(F.coalesce("is_fixture", F.lit(False)), F.col("evidence_text")).otherwise(F.lit(placeholder)).alias("shown_text"),
    )


def candidate_alerts(signals: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Affirmed, eligible and not yet decided signals."""
    return signals.where((F.col("assertion_class") == "affirmed") & F.col("event_review_eligible")).join(decided.select(key), key, "left_anti")


def within_times(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from `start` to `end`, RFC 3339 times with an offset; a time without one, or a start after the end, is refused."""
    given = {}
    for name, v in (("start", start), ("end", end)):
        if v is not None:
            t = pd.Timestamp(v)
            if t.tzinfo is None:
                raise ValueError(f"{name} has no offset: {v}")
            given[name] = t
    if len(given) == 2 and given["start"] > given["end"]:
        raise ValueError(f"{start} lies after {end}")
    for name, t in given.items():
        instant = F.timestamp_micros(F.lit(t.value // 1000))
        df = df.where(F.col(column) >= instant if name == "start" else F.col(column) <= instant)
    return df


def decoded_warnings(warnings: DataFrame, key: str, outlook: str) -> DataFrame:
    """key, peak_severity, hazards (of all days, in order, each once), days: codes as labels, the gravest severity."""
    labels = F.create_map(*[x for k, v in C.HAZARDS.items() for x in (F.lit(str(k)), F.lit(v))])
    ranks = F.create_map(*[x for k, v in C.SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    codes = F.array_distinct(F.flatten(F.transform(outlook, lambda d: F.regexp_extract_all(F.coalesce(d["codes"], F.lit("")), F.lit(r"(\d+)"), 1))))
    peak = F.coalesce(F.array_max(F.transform(outlook, lambda d: F.coalesce(F.try_element_at(ranks, d["severity"]), F.lit(0)))), F.lit(0))
    named = F.transform(codes, lambda c: F.coalesce(F.try_element_at(labels, c), F.concat(F.lit("unmapped_code_"), c)))
    return warnings.select(key, F.element_at(F.array(*[F.lit(x) for x in ("no_warning", "watch", "alert", "warning")]), peak + 1).alias("peak_severity"), F.coalesce(F.array_join(named, "; "), F.lit("")).alias("hazards"), F.coalesce(F.size(outlook), F.lit(0)).alias("days"))


def collapsed(products: Mapping[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """One row a key that any product has: each product's latest value, (frame with key, order, value; name of the order column). Keys of one product alone stay."""
    out = None
    for name, (df, order) in products.items():
        one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("value", F.struct(order, "value")).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    return out


def fresh_only(gauges: DataFrame, group: str, day: str, value: str, as_of: str) -> DataFrame:
    """group, n, stale, largest: gauges observed on `as_of` count, the others are told."""
    now = F.coalesce(F.col(day) == as_of, F.lit(False))
    return gauges.groupBy(group).agg(F.count_if(now).alias("n"), F.count_if(~now).alias("stale"), F.max(F.when(now & ~F.isnan(F.col(value)), F.col(value))).alias("largest"))


def ranked_links(links: DataFrame, key: str, url: str, label: str, context: str, pdf: str, diseases: Sequence[str] = tuple(C.DISEASES), most: int = 60) -> DataFrame:
    """position, key, link_score of the eligible links in order of disease, health marker, document, score, address.

    Eligible: no navigation, and a disease, a health marker, a document, or a
    label with a score above nought. The limit is the feature: a frontier takes
    so many links of a page.
    """
    near = F.lower(F.concat_ws(" ", label, context))
    has = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(near, x))
    x = links.where(F.col(url).isNotNull()).select(
        key, F.col(url).alias("_u"), has(diseases).alias("_d"), has(C.HEALTH_MARKERS).alias("_h"), F.coalesce(pdf, F.lit(False)).alias("_p"),
        text.link_score(F.col(label), F.col(context), F.col(url), F.coalesce(pdf, F.lit(False)), diseases).alias("link_score"), F.coalesce(F.trim(label), F.lit("")).alias("_l"),
    )
    x = x.where(~text.is_navigation(F.col("_u")) & (F.col("_d") | F.col("_h") | F.col("_p") | ((F.col("link_score") > 0) & (F.col("_l") != ""))))
    order = [F.desc("_d"), F.desc("_h"), F.desc("_p"), F.desc("link_score"), F.col("_u"), F.col(key)]
    top = x.orderBy(*order).limit(most)
    from pyspark.sql import Window

    return top.select(F.row_number().over(Window.orderBy(*order)).alias("position"), key, "link_score")  # at most `most` rows


def top_drivers(df: DataFrame, key: str, weights: Mapping[str, float], centres: Mapping[str, tuple[float, float]], most: int = 4) -> DataFrame:
    """key, drivers: the features with the greatest contribution to a linear predictor, by size, with sign."""
    each = F.array(*[F.struct((-F.abs(c)).alias("o"), F.lit(n).alias("n"), c.alias("c")) for n, w in weights.items() for c in (F.round((F.col(n) - centres[n][0]) / centres[n][1] * w, 4),)])
    kept = F.slice(F.array_sort(F.filter(each, lambda x: x["c"].isNotNull() & ~F.isnan(x["c"]))), 1, most)
    return df.select(key, F.array_join(F.transform(kept, lambda x: F.concat(x["n"], F.when(x["c"] >= 0, "+").otherwise("-"))), ",").alias("drivers"))


def data_gate(edges: DataFrame, edge: str, issue: str, weeks: int = 3) -> DataFrame:
    """common_edge, current: whether the edge all keys share is no older than `weeks` before the issue; false where a key has none."""
    x = edges.agg(F.min(edge).alias("common_edge"), F.count_if(F.col(edge).isNull()).alias("_none"), F.count(F.lit(1)).alias("_n"))
    ok = (F.col("_none") == 0) & (F.col("_n") > 0) & (F.datediff(F.lit(issue).cast("date"), "common_edge") <= 7 * weeks)
    return x.select(F.when(F.col("_none") == 0, F.col("common_edge")).alias("common_edge"), F.coalesce(ok, F.lit(False)).alias("current"))
