"""Timestamps written in many formats and zones, normalised to one UTC instant.

A value is read under every format that fits it. Three families of values have
several readings: all-number dates with slashes (day, month and year in three
orders), day and year of two digits around a month's name (either way), and zone
abbreviations that stand for several zones. Which reading a source means is a
mixture, estimated per source and family by expectation-maximisation: a value
adds likelihood to each reading under which it is valid, more where the reading
agrees with a date known from elsewhere in the row or with the source's zone. The
posterior picks the reading or marks the value ambiguous. Shapes with a single
reading have the posterior one. Values that name no zone are read in the source's
zone, and local times that occur twice are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teesta.functions.stage import settle

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"

# Digits of the scripts read, English month names, and zone abbreviations in minutes east of UTC.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
ODIA_DIGITS = "୦୧୨୩୪୫୬୭୮୯"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "ist": 330, "cet": 60, "cest": 120, "bst": 60, "eet": 120, "eest": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}

# Abbreviations of several zones, the meaning of ZONES first.
ZONE_MEANINGS = {"ist": [330, 120, 60], "bst": [60, 360], "cst": [-360, 480]}

ORDERS = ("dmy", "mdy", "ymd")
_ZONE = r"\s*(z|utc|gmt|ut|[a-z]{3,4}|[+-]\d{2}:?\d{2})?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(am|pm)?"
# Named shapes. Groups are named by the fields list beside each.
SHAPES: list[tuple[str, str, str]] = [
    ("iso", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[t\s]+" + _CLOCK + _ZONE + r")?$", "y m d H M S f a z"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})" + _ZONE + "$", "y m d H M S z"),
    ("day_month_name", r"^(?:[a-z]{3,9},?\s+)?(\d{1,2})[\s-]+([a-z]{3,9})[\s,-]+(\d{4}|\d{2})(?:,?\s+" + _CLOCK + _ZONE + r")?$", "d b y H M S f a z"),
    ("day_month_hours", r"^(\d{1,2})[\s-]+([a-z]{3,9})[\s-]+(\d{4}|\d{2})\s+(\d{2})(\d{2})\s*(?:hrs|hours|h)" + _ZONE + "$", "d b y H M z"),
    ("month_name_day", r"^(?:[a-z]{3,9},?\s+)?([a-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+" + _CLOCK + _ZONE + r")?$", "b d y H M S f a z"),
]
_SLASH = r"^(\d{1,4})/(\d{1,2})/(\d{1,4})(?:,?\s+" + _CLOCK + _ZONE + r")?$"
MICROS = 1_000_000


def cleaned(value: Column) -> Column:
    """Trimmed, lower case, digits of Indian scripts as ASCII."""
    v = F.translate(value, DEVANAGARI_DIGITS + BENGALI_DIGITS + ODIA_DIGITS, "0123456789" * 3)
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(v, r"[\u00a0\u202f\u200e\u200f]", " ")), r"\s+", " "))


def _number(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _instant(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column, frac: Column, ampm: Column, zone: Column, default_zone: Column) -> Column:
    """Micros since the epoch, or null for no such time. Parts not written are zero."""
    year = F.when(y < 100, y + 2000).otherwise(y)
    hour = F.coalesce(h, F.lit(0))
    hour = F.when(ampm == "pm", F.when(hour.between(1, 12), hour % 12 + 12)).when(ampm == "am", F.when(hour.between(1, 12), hour % 12)).otherwise(hour)
    minutes = F.when(zone.rlike(r"^[+-]"), (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, -2, 2).cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1))
    known = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])
    named = zone.isNotNull() & (zone != "")
    minutes = F.when(named, F.coalesce(minutes, F.try_element_at(known, zone)))
    second = F.coalesce(s, F.lit(0))
    parts = (year, m, d, hour, F.coalesce(mi, F.lit(0)), second)
    at_utc = F.try_make_timestamp(*parts, F.lit("UTC"))
    at_zone = F.try_make_timestamp(*parts, F.coalesce(default_zone, F.lit("UTC")))
    micro = F.coalesce(F.rpad(frac, 9, "0").cast("long"), F.lit(0)) / 1000
    base = F.when(named, F.unix_micros(at_utc) - minutes.cast("long") * 60 * MICROS).when(default_zone.isNotNull(), F.unix_micros(at_zone))
    return base + F.floor(micro).cast("long")


FIELDS = "y m b d p q s H M S f a z".split()


def _parts(v: Column, shape: Column) -> Column:
    """The fields of a value as an array in the order of FIELDS, '' where its shape has none: one pattern run a value."""
    text = F.lit(None).cast("string")
    cases = F.when(F.lit(False), text)
    for name, pattern, fields in [*SHAPES, ("slash", _SLASH, "p q s H M S f a z")]:
        at = {n: i + 1 for i, n in enumerate(fields.split())}
        cases = cases.when(shape == name, F.regexp_replace(v, pattern, "|".join(f"${at[n]}" if n in at else "" for n in FIELDS)))
    return F.split(cases, r"\|", -1)


def reading_posteriors(cases: DataFrame, keys: list[str], iterations: int = 25, prior_weight: float = 4.0) -> DataFrame:
    """EM over the readings of each source and family.

    `cases` has one row per group: keys, `favoured` (the number of a reading or
    null) and `seen`, an array of (signature, n). A signature is three digits,
    one per reading: 0 the value has no such reading, 1 it has, 2 it has one that
    agrees with what is known. Returns keys and `posterior`, a map of signature
    to three probabilities. The favoured reading enters as a Dirichlet prior.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = np.array([1e-12, 1.0, 20.0])
        for b in batches:
            if not len(b):
                continue
            out = []
            for favoured, seen in zip(b["favoured"], b["seen"], strict=True):
                sig = [r["signature"] for r in seen]
                n = np.array([r["n"] for r in seen], dtype=float)
                like = weight[np.array([[int(c) for c in s] for s in sig])]
                prior = np.full(3, 1.0)
                if favoured is not None and favoured == favoured:
                    prior[int(favoured)] += prior_weight * (1.0 + 0.05 * n.sum())
                pi = prior / prior.sum()
                for _ in range(iterations):
                    r = like * pi
                    r /= r.sum(axis=1, keepdims=True)
                    pi = prior - 1.0 + 1e-3 + (r * n[:, None]).sum(axis=0)
                    pi /= pi.sum()
                r = like * pi
                r /= r.sum(axis=1, keepdims=True)
                out.append({s: [float(x) for x in p] for s, p in zip(sig, r, strict=True)})
            yield b[keys].assign(posterior=out)

    fields = ", ".join(f"`{k}` {cases.schema[k].dataType.simpleString()}" for k in keys)
    return cases.mapInPandas(run, f"{fields}, posterior map<string,array<double>>")


def normalise_timestamps(rows: DataFrame, registry: DataFrame, key: str, source: str, value: str, context: str | None = None, sure: float = 0.95) -> DataFrame:
    """key, `written`, `utc_micros`, `zone`, `reading` and `status` of each row's timestamp text.

    `registry` has one row per source: source_id, time_zone, date_order; a
    source it lacks has neither zone nor order. `context` names a date column
    near the instant, or null. Status: 'ok'; 'missing' (null, blank, or nothing
    that reads as a time); 'ambiguous_order' (no reading reaches the
    posterior `sure`); 'no_zone' (no zone written and none known); 'repeated_hour' (the local time
    occurs twice; the earlier is given; one that is skipped is moved on by the
    gap). utc_micros is null for 'missing', 'no_zone' and 'ambiguous_order'. Every input row comes out
    once, repeated rows as often as they stand; extra columns are ignored.
    """
    ctx = F.to_date(F.col(context)) if context else F.lit(None).cast("date")
    reg = registry.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.max("time_zone").alias("_tz"), F.max("date_order").alias("_order"))
    r = rows.select(F.col(key).alias("_key"), F.col(source).alias("_src"), F.col(value).alias("written"), ctx.alias("_ctx"))
    r = r.join(reg, r["_src"] == reg["source_id"], "left").drop("source_id")
    r = settle(r, _v=cleaned(F.col("written")))
    v, tz = F.col("_v"), F.col("_tz")
    # The shape is settled first, so each value is taken apart by one pattern only.
    shape = F.when(v.isNull() | (v == ""), F.lit("none")).when(v.rlike(r"^\d{13}$"), "epoch_ms").when(v.rlike(r"^\d{9,10}$"), "epoch_s").when(v.rlike(r"^\d{16}$"), "epoch_us")
    for name, pattern, _ in SHAPES:
        shape = shape.when(v.rlike(pattern), name)
    shape = shape.when(v.rlike(_SLASH), "slash").otherwise("none")
    r = settle(r, _shape=shape)
    r = settle(r, _f=_parts(v, F.col("_shape")))
    g = {n: F.col("_f")[i] for i, n in enumerate(FIELDS)}
    p, q, s = (_number(g[c]) for c in "pqs")
    clock = (_number(g["H"]), _number(g["M"]), _number(g["S"]), F.when(g["f"] != "", g["f"]), g["a"], g["z"], F.coalesce(tz, F.lit("UTC")))

    def slash(order: str) -> Column:
        y, m, d = {"dmy": (s, q, p), "mdy": (s, p, q), "ymd": (p, q, s)}[order]
        wide = F.length(g["p"]) == 4
        fits = wide if order == "ymd" else ~wide
        return F.when(fits, _instant(y, m, d, *clock))

    month = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.substring(g["b"], 1, 3)).cast("int")
    month = F.when(g["b"] == "", _number(g["m"])).otherwise(F.when(month > 0, month))
    is_slash = F.col("_shape") == "slash"
    short_year = (F.length(g["y"]) == 2) & (g["b"] != "")
    several_zones = ~is_slash & g["z"].isin(list(ZONE_MEANINGS))
    family = F.when(is_slash, "order").when(several_zones, F.concat(F.lit("zone_"), g["z"])).when(short_year, "year")
    r = settle(r, _family=family)
    many = r.where(F.col("_family").isNotNull())
    once = _instant(_number(g["y"]), month, _number(g["d"]), *clock)
    swapped = F.when(short_year, _instant(_number(g["d"]), month, _number(g["y"]), *clock))
    zones = F.create_map(*[x for k, v in ZONE_MEANINGS.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in (v + [None, None])[:3]]))])
    many = settle(many, _once=F.when(~is_slash, once), _means=F.try_element_at(zones, g["z"]))
    meant = lambda i: F.col("_once") + (F.col("_means")[0] - F.col("_means")[i]).cast("long") * 60 * MICROS
    readings = [
        F.when(is_slash, slash(o)).when(several_zones, meant(i)).otherwise([F.col("_once"), swapped, F.lit(None).cast("long")][i])
        for i, o in enumerate(ORDERS)
    ]
    many = settle(many, _r0=readings[0], _r1=readings[1], _r2=readings[2])
    # What a reading may agree with: the row's date, or, where zones are told apart, the source's own zone.
    nearby = lambda c: F.abs(F.datediff(F.date_from_unix_date(F.floor(c / F.lit(86_400 * MICROS)).cast("int")), F.col("_ctx"))) <= 2
    own_zone = lambda i, c: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(c), F.coalesce("_tz", F.lit("UTC")))) - c == F.col("_means")[i].cast("long") * 60 * MICROS
    digit = lambda i: F.when(F.col(f"_r{i}").isNull(), "0").when(F.when(several_zones, own_zone(i, F.col(f"_r{i}"))).otherwise(nearby(F.col(f"_r{i}"))), "2").otherwise("1")
    many = settle(many, _sig=F.concat(digit(0), digit(1), digit(2)))
    counted = many.where(F.col("_sig") != "000").groupBy("_src", "_family", "_order", "_sig").count()
    favoured = F.when(F.col("_family") != "order", 0).otherwise(F.array_position(F.array(*[F.lit(o) for o in ORDERS]), F.max("_order")) - 1).cast("int")
    cases = counted.groupBy("_src", "_family").agg(F.when(favoured >= 0, favoured).alias("favoured"), F.collect_list(F.struct(F.col("_sig").alias("signature"), F.col("count").alias("n"))).alias("seen"))
    post = reading_posteriors(cases, ["_src", "_family"]).withColumnsRenamed({"_src": "_psrc", "_family": "_pfam"})
    chosen = many.join(post, F.col("_src").eqNullSafe(F.col("_psrc")) & (F.col("_family") == F.col("_pfam")), "left").withColumn("_p", F.try_element_at("posterior", F.col("_sig")))
    best = F.array_max("_p")
    which = F.array_position("_p", best).cast("int")
    several = F.array(*[F.col(f"_r{i}") for i in range(3)])
    agree = F.array_distinct(F.array_compact(several))
    chosen = settle(chosen, _which=F.when(best >= sure, which), _agree=agree)
    one = F.size("_agree") == 1
    names = F.when(is_slash, F.element_at(F.array(*[F.lit(f"slash_{o}") for o in ORDERS]), F.col("_which"))).when(several_zones, F.concat(F.lit("zone_"), F.element_at("_means", F.col("_which")).cast("string"))).otherwise(F.element_at(F.array(F.lit("day_first"), F.lit("year_first"), F.lit(None)), F.col("_which")))
    chosen = chosen.select(
        "_key", "written", F.when(one, F.col("_agree")[0]).when(F.col("_which").isNotNull(), F.element_at(several, F.col("_which"))).alias("_at"), F.when(g["z"] != "", g["z"]).alias("_named"), "_tz",
        F.when(F.col("_which").isNotNull(), names).when(one, F.concat("_shape", F.lit("_any"))).alias("reading"),
        F.when(F.size("_agree") == 0, "missing").when(~one & F.col("_which").isNull(), "ambiguous_order").alias("_bad"),
    )

    at = F.when(F.col("_shape") == "epoch_s", F.col("_v").cast("long") * MICROS).when(F.col("_shape") == "epoch_ms", F.col("_v").cast("long") * 1000).when(F.col("_shape") == "epoch_us", F.col("_v").cast("long"))
    named = F.when(F.col("_shape").startswith("epoch"), F.lit("utc"))
    at = at.otherwise(once)
    named = named.otherwise(F.when(g["z"] != "", g["z"]))
    plain = settle(r.where(F.col("_family").isNull()), _at=at, _named=named)
    plain = plain.select("_key", "written", "_at", "_named", "_tz", F.col("_shape").alias("reading"), F.when(F.col("_at").isNull(), "missing").alias("_bad"))
    both = plain.unionByName(chosen)
    instant = F.timestamp_micros("_at")
    local = F.from_utc_timestamp(instant, F.coalesce("_tz", F.lit("UTC")))
    hour = F.expr("interval 1 hour")
    unzoned = F.col("_named").isNull()
    twice = unzoned & (F.from_utc_timestamp(instant + hour, F.coalesce("_tz", F.lit("UTC"))) == local)
    status = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(unzoned & F.col("_tz").isNull(), "no_zone").when(twice, "repeated_hour").otherwise("ok")
    return both.select(
        F.col("_key").alias(key),
        "written",
        F.when(status.isin("ok", "repeated_hour"), F.col("_at")).alias("utc_micros"),
        F.coalesce("_named", "_tz").alias("zone"),
        "reading",
        status.alias("status"),
    )


def irregular_instants(station_observation: DataFrame, district_warning: DataFrame, source_snapshot: DataFrame, registry: DataFrame) -> DataFrame:
    """record_table, record_key, utc_micros of each time not written in the canonical form."""
    rows = None
    for name, df, key, value, context in (
        ("station_observation", station_observation, "obs_id", "observed_at", "observed_on"),
        ("district_warning", district_warning, "warning_id", "updated_at", "issued_for_date"),
        ("source_snapshot", source_snapshot, "snapshot_id", "retrieved_at", None),
    ):
        odd = df.where(F.col(value).isNotNull() & ~F.col(value).rlike(CANONICAL))
        day = F.to_date(F.col(context)) if context else F.lit(None).cast("date")
        part = odd.select(F.struct(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_key")).alias("record"), "source_id", F.col(value).alias("written"), day.alias("near"))
        rows = part if rows is None else rows.unionByName(part)
    found = normalise_timestamps(rows, registry, "record", "source_id", "written", "near")
    return found.where(F.col("utc_micros").isNotNull()).select("record.record_table", "record.record_key", "utc_micros")
