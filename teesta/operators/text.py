"""Evidence text: keys, scripts, cues, dictionary matches, sentence links, near-copies, ranks, addresses of pages."""

from __future__ import annotations

import html.parser
import re
import unicodedata
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from teesta.operators import cues as C

# Code points of the scripts told apart.
SCRIPT_RANGES = {"latin": r"A-Za-z", "devanagari": r"\x{0900}-\x{097F}", "bengali": r"\x{0980}-\x{09FF}", "odia": r"\x{0B00}-\x{0B7F}"}


def normalised_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """NFC, case folded, joiners dropped, spaces collapsed."""
    drop = dict.fromkeys((0x200C, 0x200D, 0xFEFF))
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().translate(drop).split()))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "०१२३४५६७८९০১২৩৪৫৬৭৮৯୦୧୨୩୪୫୬୭୮୯", "0123456789" * 3)


def script_counts(c: Column) -> dict[str, Column]:
    """Letters and marks of each script, dandas left out."""
    return {n: F.regexp_count(c, F.lit(rf"[\p{{L}}\p{{M}}&&[{r}]]")) for n, r in SCRIPT_RANGES.items()}


def script_votes(c: Column, dominant: float = 0.6) -> Column:
    """array of (script, letters) by vote: each line gives all its letters to the script that has `dominant` of them, or to each its own."""
    letters = {"latin": r"A-Za-zÀ-ÖØ-öø-ɏ", "hi": SCRIPT_RANGES["devanagari"], "or": SCRIPT_RANGES["odia"]}
    lines = F.filter(F.transform(F.split(c, r"\R"), F.trim), lambda x: x != "")
    counted = F.transform(lines, lambda x: F.struct(*[F.regexp_count(x, F.lit(rf"[\p{{L}}\p{{M}}&&[{r}]]")).alias(n) for n, r in letters.items()]))
    names = list(letters)
    total = lambda x: sum((x[n] for n in names), F.lit(0))
    vote = lambda x: F.struct(*[F.when(F.greatest(*[x[m] for m in names]) >= total(x) * dominant, F.when(x[n] == F.greatest(*[x[m] for m in names]), total(x)).otherwise(0)).otherwise(x[n]).cast("long").alias(n) for n in names])
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    votes = F.aggregate(F.transform(counted, vote), zero, lambda acc, x: F.struct(*[(acc[n] + x[n]).alias(n) for n in names]))
    return F.array(*[F.struct(votes[n].alias("letters"), F.lit(n).alias("script")) for n in names])


def language_route(c: Column, dominant: float = 0.6, bilingual: float = 0.25) -> Column:
    """or, hi, en (with a function word), mixed (two scripts of a share of `bilingual`), else und; by the votes of script_votes."""
    votes = script_votes(c, dominant)
    total = F.aggregate(votes, F.lit(0).cast("long"), lambda acc, v: acc + v["letters"])
    top = F.array_max(votes)
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,:;!?()\[\]{}\"'`]+|[.,:;!?()\[\]{}\"'`]+$", ""))
    strong = F.size(F.filter(votes, lambda v: (v["letters"] >= 2) & (v["letters"] >= total * bilingual)))
    return (
        F.when(c.isNull() | (total < 2), "und")
        .when(top["letters"] >= total * dominant, F.when(top["script"] != "latin", top["script"]).when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in C.ENGLISH_WORDS])), "en").otherwise("und"))
        .when(strong >= 2, "mixed").otherwise("und")
    )


def assertion_class(c: Column, year_of: Column) -> Column:
    """not_affirmed (a cue or a count of zero cases), speculative, non_current (a cue, or no year later than two before `year_of`), else affirmed."""
    t = F.lower(collapsed(c))
    has = lambda cues: F.coalesce(F.exists(F.array(*[F.lit(x) for x in cues]), lambda x: F.contains(t, x)), F.lit(False))
    none = F.coalesce(t.rlike(r"\b(?:zero|0)\s+(?:new\s+)?(?:[a-z -]+\s+)?cases?\b"), F.lit(False))
    year = F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), 1), lambda y: y.cast("int")))
    return F.when(none | has(C.NOT_AFFIRMED), "not_affirmed").when(has(C.SPECULATIVE), "speculative").when(has(C.NON_CURRENT) | F.coalesce(year < year_of - 1, F.lit(False)), "non_current").otherwise("affirmed")


def sentences(c: Column) -> Column:
    """Blocks up to a sentence's end, danda included, trimmed and not empty."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?।॥])\s+|[\r\n]+"), F.trim), lambda x: x != "")


_WORDS = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def _words(text: str) -> tuple[list[str], list[int]]:
    """Lower-case words of letters, marks and digits, and where each begins."""
    out, at = [], []
    for m in _WORDS.finditer(text):
        out.append(m[0].lower())
        at.append(m.start())
    return out, at


class TermFinder:
    """Terms as a search automaton over a text's words: where each group's longest term first stands."""

    def __init__(self, terms: list[tuple[str, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[str, str]]] = {}
        for group, term in terms:
            words = " ".join(_words(term)[0])
            if words:
                held.setdefault(f" {words} ", []).append((group, term))
        for run, names in held.items():
            self.automaton.add_word(run, (len(run), sorted(names)))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def find(self, text: str) -> dict[str, tuple[str, int]]:
        """group: (term, place from 1)."""
        if self.empty or not text:
            return {}
        words, at = _words(text)
        if not words:
            return {}
        starts, n = {}, 0
        for i, w in enumerate(words):
            starts[n] = i
            n += len(w) + 1
        best: dict[str, tuple[int, str, int]] = {}
        for end, (size, names) in self.automaton.iter(f" {' '.join(words)} "):
            begin = at[starts[end - size + 1]] + 1
            for group, term in names:
                rank = (len(term), term, -begin)
                if group not in best or rank > best[group]:
                    best[group] = rank
        return {g: (term, -place) for g, (_, term, place) in best.items()}


def match_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, group: str, term: str, most_terms: int = 200_000) -> DataFrame:
    """key, group, term, at: the longest term of each group that stands in the text as words, and the code point (from 1) where it first begins.

    Up to `most_terms` terms, a size that is checked, go to the tasks as one
    automaton, and texts are read in batches where they lie. More are met by an
    equi-join of the texts' runs of words. Null texts and terms match nothing.
    """
    t = terms.where(F.col(term).isNotNull() & F.col(group).isNotNull()).select(group, term).distinct()
    some = t.limit(most_terms + 1).collect()
    kinds = f"_k {texts.schema[key].dataType.simpleString()}, _g {terms.schema[group].dataType.simpleString()}, _m string, at int"
    if len(some) > most_terms:
        return _joined_terms(texts, key, text, t, group, term, kinds)
    shared = texts.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in some])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = TermFinder(shared.value)
        for b in batches:
            out = [(k, g, m, at) for k, x in zip(b["_k"], b["_t"], strict=True) for g, (m, at) in finder.find(x or "").items()]
            yield pd.DataFrame(out, columns=["_k", "_g", "_m", "at"])

    found = texts.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, kinds)
    return found.withColumnsRenamed({"_k": key, "_g": group, "_m": term})


def _joined_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, group: str, term: str, kinds: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{Nd}]+)"), 1)
    t = terms.select(group, term, words(F.col(term)).alias("_w")).where(F.size("_w") > 0)
    t = t.select(group, term, F.array_join("_w", " ").alias("_run"), F.size("_w").alias("_len"))
    longest = t.agg(F.max("_len")).first()[0] or 1
    x = texts.select(F.col(key), F.col(text).alias("_text"), words(F.col(text)).alias("_w"))
    runs = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - n + 1)), lambda i, n=n: F.array_join(F.slice("_w", i, n), " ")) for n in range(1, longest + 1)]))  # noqa: B023
    hit = x.where(F.size("_w") > 0).select(key, F.explode(F.array_distinct(runs)).alias("_run")).join(t, "_run")
    best = hit.groupBy(key, group).agg(F.max_by(term, F.struct(F.length(term), term)).alias("_m"))
    with_text = best.join(texts.select(key, F.col(text).alias("_t")), key)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, g, m, TermFinder([(g, m)]).find(x)[g][1]) for k, g, m, x in zip(b["_k"], b["_g"], b["_m"], b["_t"], strict=True)]
            yield pd.DataFrame(out, columns=["_k", "_g", "_m", "at"])

    placed = with_text.select(F.col(key).alias("_k"), F.col(group).alias("_g"), "_m", "_t").mapInPandas(place, kinds)
    return placed.withColumnsRenamed({"_k": key, "_g": group, "_m": term})


def fingerprint(c: Column) -> Column:
    return F.sha2(F.lower(collapsed(c)), 256)


def tokens(c: Column) -> Column:
    """Different words of two signs or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{Nd}_]+)"), 1), lambda x: F.length(x) > 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def duplicate_candidates(signals: DataFrame, key: str, text: str, disease: str, district: str, at: str, language: str, width: int = 5, same: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, candidates): key with its class of equal text, and pairs of classes for review; nothing is merged.

    Equal texts (letter case and spaces aside) of one disease and district are
    one class, whatever their `language` says: labels are missing or wrong, so
    they only stand beside the members. Classes of a disease and district are
    candidates if the sets of their runs of `width` words are alike by `same` or
    more and the signals lie within 72 hours. Pairs come from shared rare runs:
    of a set of n runs the first n - ceil(same n) + 1 in an order by rarity must
    hold one that the other set's such prefix holds too, so no alike pair is lost
    and common runs join nothing.
    """
    x = signals.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), fingerprint(F.col(text)).alias("_f"), F.lower(collapsed(F.col(text))).alias("_t"), F.coalesce(disease, F.lit("")).alias("_a"), F.coalesce(district, F.lit("")).alias("_b"), F.col(language).alias("_l"), F.col(at).alias("_at"))
    x = x.withColumn("class_id", F.xxhash64("_f", "_a", "_b"))
    members = x.select(F.col("_k").alias(key), "class_id", F.col("_l").alias("language"))
    c = x.groupBy("class_id", "_a", "_b").agg(F.min("_t").alias("_t"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    w = F.split("_t", " ")
    runs = F.when(F.size(w) < width, F.array(F.xxhash64("_t"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " ")))))
    c = c.select("class_id", "_a", "_b", "_first", "_last", runs.alias("_r"))
    long = c.select("class_id", F.explode("_r").alias("_h"))
    seen = long.groupBy("_h").agg(F.count(F.lit(1)).alias("_df"))
    ordered = long.join(seen, "_h").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("_df", "_h"))).alias("_o"))
    n = F.size("_o")
    ahead = ordered.select("class_id", F.explode(F.slice("_o", 1, (n - F.ceil(n * same - 1e-9) + 1).cast("int"))).alias("_p")).where(F.col("_p._df") > 1).select("class_id", F.col("_p._h").alias("_h"))
    keyed = ahead.join(c.select("class_id", "_a", "_b"), "class_id")
    one, two = keyed.withColumnRenamed("class_id", "class_a"), keyed.withColumnRenamed("class_id", "class_b")
    pairs = one.join(two, ["_h", "_a", "_b"]).where(F.col("class_a") < F.col("class_b")).select("class_a", "class_b").distinct()
    side = lambda s: c.select(F.col("class_id").alias(f"class_{s}"), F.col("_r").alias(f"_r{s}"), F.col("_first").alias(f"_f{s}"), F.col("_last").alias(f"_g{s}"))
    p = pairs.join(side("a"), "class_a").join(side("b"), "class_b")
    gap = F.greatest(F.lit(0), F.unix_seconds("_fa") - F.unix_seconds("_gb"), F.unix_seconds("_fb") - F.unix_seconds("_ga")) / 3600.0
    p = p.withColumn("similarity", jaccard(F.col("_ra"), F.col("_rb"))).withColumn("hours", gap)
    return members, p.where((F.col("similarity") >= same) & (F.col("hours") <= 72)).select("class_a", "class_b", "similarity", "hours")


def lexical_rank(texts: DataFrame, key: str, text: str, query: str, k: int = 10, least: float = 0.0) -> DataFrame:
    """The k rows with the greatest share of the query's words; the least score is asked for after the cut."""
    q = F.array_distinct(F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())]))
    score = F.size(F.array_intersect(q, tokens(F.col(text)))) / F.greatest(F.lit(1), F.size(q))
    return texts.where(F.col(text).isNotNull()).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k).where(F.col("score") >= least)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 4096) -> DataFrame:
    """query_id, key, cosine (6 places), rank_in_group: the k vectors nearest to each query by cosine, itself left out, ties by key.

    The queries are a stated set, held against all vectors: they go to the tasks
    in blocks of at most `block`, one pass each, and are multiplied with batches
    of vectors; each task hands on its best k a query. Null vectors and those of
    length nought have no neighbours.
    """
    spark = vectors.sparkSession
    from teesta.operators.relational import top_per_group

    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    kind = vectors.schema[key].dataType.simpleString()

    def unit(rows: list) -> np.ndarray:
        m = np.array([list(r) for r in rows], dtype=np.float64)
        n = np.sqrt((m * m).sum(axis=1))
        n[n == 0] = np.nan
        return m / n[:, None]

    def against(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], unit([r[1] for r in rows])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in ids]
            for b in batches:
                if not len(b):
                    continue
                keys = b["_k"].tolist()
                cosine = np.round(m @ unit(b["_v"].tolist()).T, 6)
                take = min(len(keys), k + 1)
                for i in range(len(ids)):
                    row = np.where(np.isnan(cosine[i]), -np.inf, cosine[i])
                    floor = np.partition(row, len(row) - take)[len(row) - take]
                    near = [(-row[j], keys[j]) for j in np.flatnonzero(row >= floor) if keys[j] != ids[i] and row[j] > -np.inf]
                    best[i] = sorted(best[i] + near)[:k]
            yield pd.DataFrame([(ids[i], x, -c) for i, found in enumerate(best) for c, x in found], columns=["query_id", key, "cosine"])

        return v.mapInPandas(run, f"query_id {kind}, `{key}` {kind}, cosine double")

    held: list = []
    parts: list[DataFrame] = []
    for r in q.toLocalIterator():
        held.append(r)
        if len(held) == block:
            parts.append(against(held))
            held = []
    if held or not parts:
        parts.append(against(held) if held else v.limit(0).select(F.col("_k").alias("query_id"), F.col("_k").alias(key), F.lit(0.0).alias("cosine")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_per_group(out, "query_id", [F.desc("cosine"), F.col(key)], k)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking keys, sorted query, '.' and '..' resolved, no final slash but that of a bare host.

    A text without scheme or host comes back trimmed.
    """
    u = F.trim(url)
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    port = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*:(\d+)", 1)
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    segments = F.aggregate(F.split(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/"), empty, step)
    key = lambda x: F.lower(F.substring_index(x, "=", 1))
    query = F.array_sort(F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit("")), "&"), lambda x: (x != "") & ~key(x).startswith("utm_") & ~key(x).isin(C.TRACKING_KEYS)))
    shown = F.when((port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443")), F.concat(F.lit(":"), port)).otherwise("")
    whole = F.concat(scheme, F.lit("://"), host, shown, F.lit("/"), F.array_join(segments, "/"), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.coalesce(whole, u)


def allowed_host(url: Column, hosts: Sequence[str]) -> Column:
    """Whether the address is of a listed host or a host under one."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.coalesce(F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h))), F.lit(False))


def is_navigation(url: Column) -> Column:
    """Whether an address only leads on: no path, a listing's segment, a section's front page, or a numbered page."""
    path = F.lower(F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit("")))
    s = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(s)
    numbered = (n >= 2) & (F.try_element_at(s, n - 1) == "page") & F.try_element_at(s, n).rlike(r"^\d+$")
    return (n == 0) | F.arrays_overlap(s, F.array(*[F.lit(x) for x in C.NAVIGATION_SEGMENTS])) | ((n == 1) & F.try_element_at(s, F.lit(1)).isin(C.SECTION_PATHS)) | F.coalesce(numbered, F.lit(False))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(ascii_digits(c), F.lit(r"(\d+(?:\.\d+)?)"), 1)


def grounded(answer: Column, evidence: Column, records: Column | None = None) -> Column:
    """Whether every number of the answer stands in the evidence, or counts its `records` (1 to that many)."""
    left = F.array_except(numbers(answer), numbers(evidence))
    if records is not None:
        left = F.array_except(left, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), records)), lambda i: i.cast("string")))
    return F.size(left) == 0


def same_numbers(a: Column, b: Column) -> Column:
    """Whether two texts hold the same numbers, each as often."""
    return F.array_sort(numbers(a)) == F.array_sort(numbers(b))


def citations(answer: Column, most: Column) -> Column:
    """Numbers of [E n] marks within 1..most, in order of first appearance."""
    n = F.transform(F.regexp_extract_all(answer, F.lit(r"\[E\s*(\d{1,6})\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(n, lambda x: (x >= 1) & (x <= most)))


def sanitised(c: Column, most: int | None = 2000) -> Column:
    """Control signs as blanks, no angle brackets; the first `most` signs, or all."""
    x = F.translate(F.regexp_replace(c, r"\p{Cc}", " "), "<>", "‹›")
    return x if most is None else F.substring(x, 1, most)


def evidence_span(c: Column, anchors: Sequence[str], most: int = 2400) -> Column:
    """(begin from 0, span): at most `most` code points around the earliest anchor, cut back to blanks; a shorter text whole."""
    at = F.least(*[F.nullif(F.instr(F.lower(c), a), F.lit(0)) for a in anchors], F.lit(None).cast("int"))
    begin = F.greatest(F.lit(1), F.least(F.coalesce(at, F.lit(1)) - most // 2, F.length(c) - most + 1))
    raw = F.substring(c, begin, F.lit(most))
    # Words cut at either side are dropped, unless the text begins or ends there.
    head = F.when(begin > 1, F.length(raw) - F.length(F.regexp_replace(raw, r"^\S{0,80}\s+", ""))).otherwise(0)
    tail = F.when(begin + most <= F.length(c), F.regexp_replace(raw, r"\s+\S{0,80}$", "")).otherwise(raw)
    span = F.substring(tail, head + 1, F.lit(most))
    return F.when(F.length(c) <= most, F.struct(F.lit(0).alias("begin"), c.alias("span"))).when(c.isNotNull(), F.struct((begin + head - 1).alias("begin"), span.alias("span")))


def text_quality(c: Column) -> Column:
    """Share of printable signs; a text of under 50 signs has none."""
    return F.when(F.length(c) >= 50, F.regexp_count(c, F.lit(r"\P{Cc}")) / F.length(c))


class _Visible(html.parser.HTMLParser):
    """Visible text and links of a page, each piece with the innermost chrome element around it; scripts and the like aside."""

    HIDDEN = {"script", "style", "noscript", "svg", "template"}
    CHROME = {"nav", "header", "footer", "aside"}
    NAMED = CHROME | {"div", "ul", "ol", "section", "form", "table"}
    ROLES = {"navigation", "banner", "contentinfo", "search", "menu", "menubar", "complementary"}
    TOKEN = re.compile(r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|megamenu|breadcrumbs?|sidebar|footer|header|masthead|topbar|skip|skiplink|social|share|cookie|banner|language-switcher|langswitch|accessibility)(?:$|[-_ ])")
    BLOCK = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "section", "article", "td"} | CHROME
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[tuple[str, int]] = []  # piece, chrome element or -1
        self.links: list[tuple[str, list[int]]] = []  # address, pieces of its label
        self.title, self.stack, self.hidden = "", [], 0
        self.parent: list[int] = []
        self.open: list[int] = []

    def _chrome(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in self.CHROME:
            return True
        if tag not in self.NAMED:
            return False
        given = {k: v or "" for k, v in attrs}
        return given.get("role", "").casefold() in self.ROLES or bool(self.TOKEN.search(f" {given.get('class', '')} {given.get('id', '')} ".casefold()))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.BLOCK:
            self.text.append(("\n", -1))
        if tag in self.VOID:
            self.text.append((" ", -1))
            return
        mark = -1
        if tag in self.HIDDEN:
            self.hidden += 1
        elif self._chrome(tag, attrs):
            mark = len(self.parent)
            self.parent.append(self.open[-1] if self.open else -1)
            self.open.append(mark)
        self.stack.append((tag, mark))
        if tag == "a" and dict(attrs).get("href"):
            self.links.append((dict(attrs)["href"], []))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.BLOCK | self.VOID:
            self.text.append(("\n" if tag in self.BLOCK else " ", -1))

    def handle_endtag(self, tag: str) -> None:
        # A stray end tag closes nothing; a matched one also what was left open within it.
        if not any(t == tag for t, _ in self.stack):
            return
        while True:
            t, mark = self.stack.pop()
            self.hidden -= t in self.HIDDEN
            if mark >= 0:
                self.open.pop()
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.stack and self.stack[-1][0] == "title":
            self.title += data
            return
        if self.links and any(t == "a" for t, _ in self.stack):
            self.links[-1][1].append(len(self.text))
        self.text.append((data, self.open[-1] if self.open else -1))

    def furniture(self, most: float) -> list[bool]:
        """Of each piece, whether it stands in chrome; an element with more than `most` of the page's letters is none."""
        weight, total = [0] * len(self.parent), _letters(self.title)
        for piece, at in self.text:
            n = _letters(piece)
            total += n
            while at >= 0:
                weight[at] += n
                at = self.parent[at]
        return [at >= 0 and weight[at] <= most * total for _, at in self.text]


def _letters(text: str) -> int:
    return sum(c.isalpha() for c in text)


def _lines(text: str) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def read_pages(pages: DataFrame, key: str, body: str, most: float = 0.5, least_letters: int = 120, least_share: float = 0.15) -> DataFrame:
    """key, title, visible_text, page_text, chrome_share, links array<struct<href,label>>. Broken pages give what could be read.

    visible_text is the page without its chrome, of which an element with more
    than `most` of the letters is none. page_text is the same, but the whole page
    where fewer than `least_letters` letters (the title's too) or `least_share`
    of them would be left.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["_k"], b["_b"], strict=True):
                p = _Visible()
                p.feed(t or "")
                off = p.furniture(most)
                text, whole = _lines("".join(x for (x, _), o in zip(p.text, off, strict=True) if not o)), _lines("".join(x for x, _ in p.text))
                kept, every, title = _letters(text), _letters(whole), _letters(p.title)
                enough = kept + title >= least_letters and kept + title >= least_share * (every + title)
                links = [{"href": h, "label": " ".join("".join(p.text[i][0] for i in at if not off[i]).split())} for h, at in p.links]
                out.append((k, p.title.strip(), text, text if enough else whole, (every - kept) / every if every else 0.0, links))
            yield pd.DataFrame(out, columns=["_k", "title", "visible_text", "page_text", "chrome_share", "links"])

    return pages.select(F.col(key).alias("_k"), F.col(body).alias("_b")).mapInPandas(run, f"_k {kind}, title string, visible_text string, page_text string, chrome_share double, links array<struct<href:string,label:string>>").withColumnRenamed("_k", key)


GENERIC_LABEL = r"(?i)^\s*(?:download|view|open|click here|read more|details|pdf|here|more)\s*(?:\(?pdf\)?)?\s*$"


def link_score(label: Column, context: Column, url: Column, pdf: Column, diseases: Sequence[str]) -> Column:
    """+5 a disease, +3 a health marker, +1 a notice marker, +1 a document, -4 page furniture, -10 navigation, -1 no label."""
    near = F.lower(F.concat_ws(" ", label, context))
    has = lambda c, xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(c, x))
    weight = lambda rule, w: F.when(rule, w).otherwise(0)
    return (
        weight(has(near, diseases), 5) + weight(has(near, C.HEALTH_MARKERS), 3) + weight(has(near, C.NOTICE_MARKERS), 1) + weight(pdf, 1)
        + weight(has(F.lower(url), C.CHROME_MARKERS), -4) + weight(is_navigation(url), -10) + weight(F.coalesce(F.trim(label), F.lit("")) == "", -1)
    )


def repaired_label(label: Column, context: Column) -> Column:
    """A label that only names the control gives way to the row it stands in."""
    return F.when(label.rlike(GENERIC_LABEL), F.trim(F.concat_ws(" ", context, label))).otherwise(label)


# Code points of the two scripts that mean the same letter lie 0x200 apart; dandas are shared.
_PAIRED = [i for i in range(0x01, 0x70) if i not in (0x64, 0x65)]


def transliterated(c: Column, to: str = "hi") -> Column:
    """Odia letters as Devanagari ('hi') or the other way ('or'), by place in the code chart."""
    odia, deva = "".join(chr(0x0B00 + i) for i in _PAIRED), "".join(chr(0x0900 + i) for i in _PAIRED)
    return F.translate(c, odia, deva) if to == "hi" else F.translate(c, deva, odia)


def collapsed_runs(c: Column, least: int = 3) -> Column:
    """A word said `least` times or more in a row, said once."""
    return F.regexp_replace(c, rf"(?<!\S)(\S+)(?:\s+\1){{{least - 1},}}(?!\S)", "$1")


def capped_sentences(c: Column, most: int = 400) -> Column:
    """Sentences, those above `most` signs cut at the last blank before it."""
    wrapped = F.transform(sentences(c), lambda s: F.regexp_extract_all(s, F.lit(rf"(?:\S.{{0,{most - 1}}})(?=\s|$)|(?:\S.{{0,{most - 1}}})"), 0))
    return F.filter(F.transform(F.flatten(wrapped), F.trim), lambda x: x != "")


def protected(c: Column, terms: Sequence[str]) -> Column:
    """Terms as marks U+E000 and on, the longest first, so that no later step changes them."""
    for i, t in sorted(enumerate(terms), key=lambda x: -len(x[1])):
        c = F.replace(c, F.lit(t), F.lit(chr(0xE000 + i)))
    return c


def restored(c: Column, terms: Sequence[str]) -> Column:
    for i, t in enumerate(terms):
        c = F.replace(c, F.lit(chr(0xE000 + i)), F.lit(t))
    return c
