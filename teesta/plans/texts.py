"""Queries on text, places, models, streams and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teesta.operators import cues as C
from teesta.operators import models as M
from teesta.operators import panel as P
from teesta.operators import questions as Q
from teesta.operators import signals as S
from teesta.operators import spatial as G
from teesta.operators import text as T
from teesta.plans.panels import _E, _events
from teesta.sources.tables import table
from teesta.streaming import flows as W


def _aliases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "district_gazetteer").select("district_id", F.explode(F.split("aliases", r"\|")).alias("alias"))


def script_profile(s: SparkSession, d: str) -> DataFrame:
    """STR-6."""
    return table(s, d, "documents").select("doc_id", *[c.cast("bigint").alias(n) for n, c in T.script_counts(F.col("text")).items()])


def language_route(s: SparkSession, d: str) -> DataFrame:
    """STR-7, STR-8."""
    return table(s, d, "documents").select("doc_id", T.language_route(F.col("text")).alias("route"))


def assertion_class(s: SparkSession, d: str) -> DataFrame:
    """STR-9."""
    return table(s, d, "redacted_signal").select("signal_id", T.assertion_class(F.col("evidence_text"), F.year("retrieved_at")).alias("found_class"))


def dictionary_match(s: SparkSession, d: str) -> DataFrame:
    """JN-12, JN-13, STR-10, STR-11, SRC-17."""
    return T.match_terms(table(s, d, "documents"), "doc_id", "text", _aliases(s, d), "district_id", "alias").select("doc_id", "district_id", "alias", "at")


def _diseases(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(x, x) for x in C.DISEASES], "group string, term string")


def _districts(s: SparkSession, d: str) -> DataFrame:
    return _aliases(s, d).select(F.col("district_id").alias("group"), F.col("alias").alias("term"))


def sentence_links(s: SparkSession, d: str) -> DataFrame:
    """TXT-2, STR-14, SET-3..5: diseases linked to districts in their sentences; an enabled source's own district may fill in."""
    on = table(s, d, "source_registry").where("enabled").select("source_id", F.lit(True).alias("on"))
    g = table(s, d, "redacted_signal").join(on, "source_id", "left").withColumn("publisher", F.when(F.col("on"), F.col("district_id")))
    g = g.select("signal_id", "evidence_text", "retrieved_at", "publisher")
    return S.sentence_links(g, "signal_id", "evidence_text", "retrieved_at", "publisher", _diseases(s), _districts(s, d))


def process_documents(s: SparkSession, d: str) -> DataFrame:
    """TXT-1."""
    g = table(s, d, "redacted_signal").select("signal_id", "evidence_text", "retrieved_at")
    x = S.process(g, "signal_id", "evidence_text", "retrieved_at", _diseases(s), _districts(s, d))
    return x.drop("route", "coverage_state", "eligible")


def dedup_copies(s: SparkSession, d: str) -> DataFrame:
    """TXT-3, JN-15: signals sent in again, scored against the first with their text."""
    return S.copy_candidates(table(s, d, "redacted_signal"), "signal_id", "evidence_text", "disease", "district_id", "retrieved_at", "language")


def dedup_cross_language(s: SparkSession, d: str) -> DataFrame:
    """TXT-3: the nearest earlier signal of the same disease and district in every other language."""
    return S.cross_language_candidates(table(s, d, "redacted_signal"), "signal_id", "disease", "district_id", "retrieved_at", "language")


def fingerprint_dups(s: SparkSession, d: str) -> DataFrame:
    """STR-3, STR-30."""
    x = table(s, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return x.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def dedup_candidates(s: SparkSession, d: str) -> DataFrame:
    """JN-15, TXT-3, SET-2, STR-12."""
    _, p = T.duplicate_candidates(table(s, d, "redacted_signal"), "signal_id", "evidence_text", "disease", "district_id", "retrieved_at", "language")
    return p.select("class_a", "class_b", F.round("similarity", 6).alias("similarity"))


def dedup_classes(s: SparkSession, d: str) -> DataFrame:
    """JN-15: every signal with the first signal of its class."""
    m, _ = T.duplicate_candidates(table(s, d, "redacted_signal"), "signal_id", "evidence_text", "disease", "district_id", "retrieved_at", "language")
    first = m.groupBy("class_id").agg(F.min("signal_id").alias("first_signal"))
    return m.join(first, "class_id").select("signal_id", "language", "first_signal")


def lexical_rank(s: SparkSession, d: str) -> DataFrame:
    """TXT-8, STR-13, SRT-4, JN-21."""
    return T.lexical_rank(table(s, d, "documents"), "doc_id", "text", "indoor spraying malaria cases", 20).select("doc_id", F.round("score", 6).alias("score"))


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    """TXT-8, SRT-4: cosine top five for each vector whose id is divisible by 20, against all."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return T.nearest_vectors(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


def url_canonical(s: SparkSession, d: str) -> DataFrame:
    """STR-25, STR-26, FLT-8: addresses roughened in five ways, made canonical again; whether they navigate and are of a listed host."""
    u = F.concat(F.upper(F.substring("requested_url", 1, 8)), F.substring("requested_url", 9, 999))
    n = F.pmod(F.length(F.regexp_replace("snapshot_id", "[^a-f]", "")), F.lit(5))
    rough = (
        F.when(n == 0, F.concat(u, F.lit("/?b=2&utm_source=x&a=1#top"))).when(n == 1, F.concat(u, F.lit("/./x/../?mc_cid=1&ref_src=t&UTM_Other=3")))
        .when(n == 2, F.regexp_replace(u, r"^(HTTPS://[^/]+)", "$1:443")).when(n == 3, F.regexp_replace(u, r"^(HTTPS://[^/]+).*$", "$1")).otherwise(F.concat(F.lit("  "), u, F.lit("//page//7/ ")))
    )
    x = table(s, d, "source_snapshot").where("requested_url is not null").select("snapshot_id", T.canonical_url(rough).alias("url"))
    return x.select("snapshot_id", "url", T.is_navigation(F.col("url")).alias("navigation"), T.allowed_host(F.col("url"), ["example.invalid"]).alias("allowed"))


def numeric_grounding(s: SparkSession, d: str) -> DataFrame:
    """STR-17, STR-19, STR-20: whether the numbers of a text's first line stand in the rest, counts up to three granted, and whether both hold the same."""
    x = table(s, d, "documents").select("doc_id", F.split("text", "\n", 2).alias("s")).where(F.size("s") > 1)
    return x.select("doc_id", T.grounded(F.col("s")[0], F.col("s")[1], F.lit(3)).alias("grounded"), T.same_numbers(F.col("s")[0], F.col("s")[1]).alias("same_numbers"))


def html_visible_text(s: SparkSession, d: str) -> DataFrame:
    """SRC-13, TXT-7, STR-29: pages are written around the documents' whole texts, in one block, and read again."""
    first = F.regexp_replace("text", "[<>&]", " ")
    page = table(s, d, "documents").select("doc_id", F.concat(F.lit("<html><head><title>t</title></head><body><nav><a href='/home'>home</a></nav><p>"), first, F.lit("</p><footer>foot</footer></body></html>")).alias("page"))
    return T.read_pages(page, "doc_id", "page").select("doc_id", F.regexp_replace("visible_text", r"\s+", " ").alias("visible_text"))


def html_page_text(s: SparkSession, d: str) -> DataFrame:
    """SRC-13, TXT-7: pages are written around the documents' whole texts, a block a line, and read again."""
    lines = F.replace(F.regexp_replace("text", "[<>&]", " "), F.lit("\n"), F.lit("</p><p>"))
    page = table(s, d, "documents").select("doc_id", F.concat(F.lit("<html><head><title>t</title></head><body><nav><a href='/home'>home</a></nav><p>"), lines, F.lit("</p><footer>foot</footer></body></html>")).alias("page"))
    return T.read_pages(page, "doc_id", "page").select("doc_id", "visible_text", "page_text", F.round("chrome_share", 6).alias("chrome_share"))


def evidence_spans(s: SparkSession, d: str) -> DataFrame:
    """STR-24, STR-23."""
    return table(s, d, "documents").select("doc_id", T.evidence_span(T.sanitised(F.col("text"), None), ["malaria", "dengue"]).alias("e")).select("doc_id", "e.begin", "e.span")


def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    """JN-14."""
    shapes = G.star_rings(table(s, d, "district_gazetteer"), "district_id", "longitude", "latitude", 0.7)
    pts = table(s, d, "recent_vintage").select("vintage_id", "longitude", "latitude")
    return G.locate(pts, "vintage_id", "longitude", "latitude", shapes, "district_id", "ring")


def grid_cell_shared(s: SparkSession, d: str) -> DataFrame:
    """JN-20."""
    x = G.cell_neighbours(table(s, d, "district_gazetteer"), "district_id", "latitude", "longitude")
    return x.select("district_id", F.array_join("shares_cell_with", ",").alias("shares_cell_with"))


def _examples(s: SparkSession, d: str) -> DataFrame:
    x = P.history(_events(s, d), "nation", "week", "event")
    x = P.lead_target(x, "nation", "week", "event", 1).na.drop(subset=["rate_logit", "events_52w"])
    return x.select("nation", "week", F.date_add("week", 7).alias("target_week"), F.col("events_4w").cast("double").alias("e4"), F.col("events_52w").cast("double").alias("e52"), "rate_logit", F.col("weeks_since").cast("double").alias("since"), "target")


COLUMNS = ("e4", "e52", "rate_logit", "since")


def ridge_irls(s: SparkSession, d: str) -> DataFrame:
    """ML-2, AGG-37."""
    x = _examples(s, d)
    m = M.fit_ridge_logistic(x, COLUMNS, "target")
    return x.select("nation", "week", "target", F.round(m.probability(), 6).alias("probability"))


def boosted_trees(s: SparkSession, d: str) -> DataFrame:
    """ML-3, ML-20, AGG-38."""
    x = _examples(s, d)
    m = M.fit_boosted_trees(x, COLUMNS, "target")
    return x.select("nation", "week", "target", F.round(m.probability(), 6).alias("probability"))


def rolling_origin_gate(s: SparkSession, d: str) -> DataFrame:
    """ML-5, ML-7, ML-9, ML-12, ML-18: ridge against the training base rate over six origins, pooled, and the gate; events begin in 1995."""
    x = _examples(s, d)
    years = [1996, 1997, 1998, 1999, 2000, 2001]
    scored = M.rolling_origins(x, "week", "target_week", years, lambda t: M.fit_ridge_logistic(t, COLUMNS, "target").probability())
    base = M.fold_base_rates(x, "target_week", years, "target")
    return M.publication_gate(scored.join(F.broadcast(base), "fold"), "probability", "target", "base").withColumn("reasons", F.array_join("reasons", ","))  # one row a fold


def model_ladder(s: SparkSession, d: str) -> DataFrame:
    """ML-4, ML-11: trained before 1999, tested from then on."""
    x = _examples(s, d).withColumn("month", F.month("target_week"))
    train, test = x.where("target_week < '1999-01-01'"), x.where("week >= '1999-01-01'")
    return M.ladder(train, test, "nation", "month", "e4", "target").withColumn("brier", F.round("brier", 8))


def nested_choice(s: SparkSession, d: str) -> DataFrame:
    """ML-6: the ridges tried within the training years, and the one chosen."""
    x = _examples(s, d).where("target_week < '1999-01-01'")
    best, scored = M.nested_ridge(x, COLUMNS, "target", "target_week")
    return s.createDataFrame([(r, round(b, 6), r == best) for r, b in scored], "ridge double, brier double, chosen boolean")


def served_forecasts(s: SparkSession, d: str) -> DataFrame:
    """ML-8, ML-19: each nation's latest week under the ridge; a nation with fewer than ten events isn't qualified."""
    x = _examples(s, d)
    m = M.fit_ridge_logistic(x.where("target_week < '1999-01-01'"), COLUMNS, "target")
    enough = x.groupBy("nation").agg(F.sum("target").alias("n")).where("n >= 10")
    return M.served(x.select("nation", "week", *COLUMNS), "nation", "week", m.probability(), enough).withColumn("probability", F.round("probability", 6))


def month_windows(s: SparkSession, d: str) -> DataFrame:
    """STM-10..12: week windows over event time."""
    x = W.windowed_counts(table(s, d, "events").select("ts", "event_type", "value"), "ts", "event_type")
    return x.select(F.col("window_start").cast("date").alias("week"), "event_type", "n", F.round("total", 2).alias("total"))


def attempt_fold(s: SparkSession, d: str) -> DataFrame:
    """STM-14: attempts and errors since the last success; queue_fold has the leases."""
    e = table(s, d, "events").select("user_id", "ts", "event_type", "event_id")
    return W.fold_attempts(e, "user_id", "ts", "event_type", "event_id", "purchase", "error")


def ext_sessions(s: SparkSession, d: str) -> DataFrame:
    """EXT: session windows."""
    x = W.sessions(table(s, d, "events").select("user_id", "ts"), "user_id", "ts", "6 hours")
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


def intent_route(s: SparkSession, d: str) -> DataFrame:
    """NLQ-1, NLQ-7: signals' texts read as questions."""
    q = F.col("evidence_text")
    sick = Q.holds(F.lower(q), C.DISEASES)
    return table(s, d, "redacted_signal").select("signal_id", Q.intent(q, sick).alias("intent"), Q.horizon_weeks(q).alias("weeks"), Q.horizon_months(q).alias("months"))


def scope_inheritance(s: SparkSession, d: str) -> DataFrame:
    """NLQ-2, NLQ-3, WIN-22: signals of a source as turns in time, districts inherited from the newest clear one."""
    g = table(s, d, "redacted_signal").select("signal_id", "source_id", F.struct("retrieved_at", "signal_id").alias("turn"), F.when(F.col("district_id").isNull() | (F.col("assertion_class") == "speculative"), F.array().cast("array<string>")).otherwise(F.array("district_id")).alias("m"))
    return Q.scope(g, "source_id", "turn", "m").select("signal_id", "resolved", "scope_state")


QUERIES = {f.__name__: f for f in (script_profile, language_route, assertion_class, dictionary_match, sentence_links, process_documents, dedup_copies, dedup_cross_language, fingerprint_dups, dedup_candidates, dedup_classes, lexical_rank, vector_topk, url_canonical, numeric_grounding, html_visible_text, html_page_text, evidence_spans, point_in_polygon, grid_cell_shared, ridge_irls, boosted_trees, rolling_origin_gate, model_ladder, nested_choice, served_forecasts, month_windows, attempt_fold, ext_sessions, intent_route, scope_inheritance)}

_RING = "r AS (SELECT district_id, i, longitude + 0.7 * CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.45 END * cos(i * 2 * pi() / 10) AS x, latitude + 0.7 * CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.45 END * sin(i * 2 * pi() / 10) AS y FROM district_gazetteer, range(10) t(i)), e AS (SELECT a.district_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM r a JOIN r b ON a.district_id = b.district_id AND b.i = (a.i + 1) % 10)"
_HAS = lambda cues, c="t": " OR ".join(f"contains({c}, '{x}')" for x in cues)
_FOLD = lambda c: rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
_CLASS = lambda t, y: (
    rf"CASE WHEN regexp_matches({t}, '\b(?:zero|0)\s+(?:new\s+)?(?:[a-z -]+\s+)?cases?\b') OR {_HAS(C.NOT_AFFIRMED, t)} THEN 'not_affirmed' WHEN {_HAS(C.SPECULATIVE, t)} THEN 'speculative' "
    rf"WHEN {_HAS(C.NON_CURRENT, t)} OR coalesce(list_max(list_transform(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda q: length(q) = 4 AND starts_with(q, '20')), lambda q: q::INT)) < {y} - 1, false) THEN 'non_current' ELSE 'affirmed' END"
)
_DIGITS = lambda c: f"translate({c}, '०१२३४५६७८९০১২৩৪৫৬৭৮৯୦୧୨୩୪୫୬୭୮୯', '012345678901234567890123456789')"
_COUNT = lambda c, r: rf"length(regexp_replace(regexp_replace({c}, '[^{r}]', '', 'g'), '[^\p{{L}}\p{{M}}]', '', 'g'))"
_VOTES = (
    "c AS (SELECT doc_id, text, " + ", ".join(f"{_COUNT('line', r)} AS {n}" for n, r in (("la", r"A-Za-zÀ-ÖØ-öø-ɏ"), ("hi", r"\x{0900}-\x{097F}"), ("o", r"\x{0B00}-\x{0B7F}"))) + " FROM l), "
    "v AS (SELECT *, la + hi + o AS n, greatest(la, hi, o) AS g FROM c), "
    "sums AS (SELECT doc_id, text, " + ", ".join(f"sum(CASE WHEN g >= 0.6 * n THEN CASE WHEN {k} = g THEN n ELSE 0 END ELSE {k} END)::BIGINT AS {k}" for k in ("la", "hi", "o")) + " FROM v GROUP BY 1, 2)"
)
_BLOCKS = r"""reg AS (SELECT source_id FROM source_registry WHERE enabled),
      a AS (SELECT district_id AS g, ' ' || trim(regexp_replace(lower(unnest(string_split(aliases, '|'))), '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')) || ' ' AS w FROM district_gazetteer),
      b0 AS (SELECT signal_id, year(timezone('UTC', retrieved_at)) AS y, CASE WHEN source_id IN (FROM reg) THEN district_id END AS publisher, unnest(regexp_split_to_array(evidence_text, '[.!?।॥\r\n]+')) AS b FROM redacted_signal WHERE evidence_text IS NOT NULL),
      b1 AS (SELECT *, ' ' || trim(regexp_replace(lower(b), '[^\p{L}\p{M}\p{Nd}]+', ' ', 'g')) || ' ' AS n, row_number() OVER () AS i FROM b0 WHERE trim(b) <> ''),
      hits AS (SELECT i, list(DISTINCT g) AS places FROM b1 JOIN a ON contains(n, w) GROUP BY 1),
      tagged AS (SELECT b1.*, list_filter([__DISEASES__], lambda x: contains(n, ' ' || x || ' ')) AS diseases, coalesce(places, []) AS places FROM b1 LEFT JOIN hits USING (i))""".replace("__DISEASES__", ", ".join(f"'{x}'" for x in C.DISEASES))
_SCORE = """, q AS (SELECT *, CASE WHEN sd THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN sp THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN h <= 72 THEN 0.2::DOUBLE * (1 - h / 96) ELSE 0 END AS s FROM z),
      r AS (SELECT signal_id, signal_id_b, cross_language, round(CASE WHEN cross_language THEN s ELSE least(1.0, s * 0.7::DOUBLE + lex * 0.3::DOUBLE) END, 4) AS score,
        array_to_string(list_filter([CASE WHEN sd THEN 'same_normalised_disease' END, CASE WHEN sp THEN 'same_resolved_district' END, CASE WHEN h <= 72 THEN 'retrieved_within_72_hours' END, CASE WHEN NOT cross_language AND lex >= 0.7 THEN 'high_within_language_token_overlap' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q)
      FROM r WHERE score >= CASE WHEN cross_language THEN 0.70 ELSE 0.75 END"""
ORACLE = {
    "script_profile": r"SELECT doc_id, " + ", ".join(f"length(regexp_replace(text, '[^{r}]', '', 'g')) AS {n}" for n, r in (("latin", "A-Za-z"),)) + r", length(regexp_replace(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g'), '[^\p{L}\p{M}]', '', 'g')) AS devanagari, length(regexp_replace(regexp_replace(text, '[^\x{0980}-\x{09FF}]', '', 'g'), '[^\p{L}\p{M}]', '', 'g')) AS bengali, length(regexp_replace(regexp_replace(text, '[^\x{0B00}-\x{0B7F}]', '', 'g'), '[^\p{L}\p{M}]', '', 'g')) AS odia FROM documents",
    "assertion_class": f"""SELECT signal_id, {_CLASS('t', 'y')} AS found_class FROM (SELECT signal_id, coalesce({_FOLD('evidence_text')}, '') AS t, year(timezone('UTC', retrieved_at)) AS y FROM redacted_signal)""",
    "language_route": rf"""WITH l AS (SELECT doc_id, text, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM documents), {_VOTES}
      SELECT doc_id, CASE WHEN text IS NULL OR n < 2 THEN 'und'
          WHEN top.v >= 0.6 * n THEN CASE WHEN top.s <> 'latin' THEN top.s WHEN list_has_any(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: trim(w, '.,:;!?()[]{{}}"''`')), [{", ".join(f"'{w}'" for w in C.ENGLISH_WORDS)}]) THEN 'en' ELSE 'und' END
          WHEN (la >= 2 AND la >= 0.25 * n)::INT + (hi >= 2 AND hi >= 0.25 * n)::INT + (o >= 2 AND o >= 0.25 * n)::INT >= 2 THEN 'mixed' ELSE 'und' END AS route
      FROM (SELECT *, la + hi + o AS n, list_max([{{'v': la, 's': 'latin'}}, {{'v': hi, 's': 'hi'}}, {{'v': o, 's': 'or'}}]) AS top FROM sums)""",
    "sentence_links": rf"""WITH {_BLOCKS}, p AS (SELECT signal_id, b, y, diseases, places, CASE WHEN len(places) = 1 THEN places[1] WHEN publisher IS NOT NULL AND (len(places) = 0 OR list_contains(places, publisher)) THEN publisher END AS district_id FROM tagged WHERE len(diseases) > 0),
      u AS (SELECT signal_id, unnest(diseases) AS disease, district_id, {_CLASS(_FOLD('b'), 'y')} AS found_class FROM p),
      k AS (SELECT DISTINCT signal_id, disease, district_id, found_class FROM u WHERE district_id IS NOT NULL),
      open_ AS (SELECT DISTINCT signal_id, disease FROM u WHERE district_id IS NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.signal_id = u.signal_id AND k.disease = u.disease)),
      rest AS (SELECT signal_id, CASE WHEN count(*) = 1 THEN min(disease) END AS disease FROM open_ GROUP BY 1)
      SELECT *, false AS ambiguous FROM k
      UNION ALL SELECT r.signal_id, r.disease, NULL, {_CLASS(_FOLD('evidence_text'), "year(timezone('UTC', retrieved_at))")}, true FROM rest r JOIN redacted_signal USING (signal_id)""",
    "dedup_copies": f"""WITH x AS (SELECT signal_id, sha256(lower(trim(regexp_replace(evidence_text, '\\s+', ' ', 'g')))) AS f, disease AS d, district_id AS p, retrieved_at AS t, language AS l FROM redacted_signal WHERE evidence_text IS NOT NULL),
      y AS (SELECT f, arg_min(signal_id, (t, signal_id)) AS b FROM x GROUP BY 1 HAVING count(*) > 1),
      z AS (SELECT a.signal_id, c.signal_id AS signal_id_b, coalesce(a.d = c.d, false) AS sd, coalesce(a.p = c.p, false) AS sp, abs(epoch_us(a.t) - epoch_us(c.t)) / 3.6e9 AS h, NOT coalesce(a.l = c.l, false) AS cross_language, 1.0 AS lex
            FROM x a JOIN y USING (f) JOIN x c ON c.signal_id = y.b WHERE a.signal_id <> c.signal_id)
      {_SCORE}""",
    "dedup_cross_language": f"""WITH x AS (SELECT signal_id, disease AS d, district_id AS p, retrieved_at AS t, language AS l FROM redacted_signal WHERE disease IS NOT NULL AND district_id IS NOT NULL AND retrieved_at IS NOT NULL),
      w AS (SELECT a.signal_id, o, arg_max((c.signal_id, c.t), (c.t, c.signal_id)) AS v, any_value(a.t) AS t FROM x a, (VALUES ('en'), ('hi'), ('or'), ('bn'), ('mr')) g(o), x c WHERE NOT coalesce(a.l = o, false) AND c.d = a.d AND c.p = a.p AND c.l = o AND c.t <= a.t GROUP BY 1, 2),
      z AS (SELECT signal_id, v[1] AS signal_id_b, true AS sd, true AS sp, abs(epoch_us(t) - epoch_us(v[2])) / 3.6e9 AS h, true AS cross_language, 0.0 AS lex FROM w WHERE v[1] <> signal_id)
      {_SCORE}""",
    "dedup_classes": r"""WITH x AS (SELECT signal_id, language, min(signal_id) OVER (PARTITION BY lower(trim(regexp_replace(evidence_text, '\s+', ' ', 'g'))), coalesce(disease, ''), coalesce(district_id, '')) AS first_signal FROM redacted_signal WHERE evidence_text IS NOT NULL) SELECT * FROM x""",
    "numeric_grounding": rf"""WITH x AS (SELECT doc_id, {_DIGITS('text')} AS t, instr(text, chr(10)) AS cut FROM documents WHERE contains(text, chr(10))),
      y AS (SELECT doc_id, regexp_extract_all(substring(t, 1, cut - 1), '[0-9]+(?:\.[0-9]+)?') AS a, regexp_extract_all(substring(t, cut + 1), '[0-9]+(?:\.[0-9]+)?') AS b FROM x)
      SELECT doc_id, len(list_filter(a, lambda n: NOT list_contains(b, n) AND n NOT IN ('1', '2', '3'))) = 0 AS grounded, list_sort(a) = list_sort(b) AS same_numbers FROM y""",
    "process_documents": rf"""WITH r AS (SELECT signal_id, retrieved_at, evidence_text AS raw, regexp_replace(evidence_text, '(?:\+91[ -]?[0-9]{{5}}[ -]?[0-9]{{5}})|(?:\b[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}\b)|[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]+', '[REDACTED]', 'g') AS red FROM redacted_signal),
      n AS (SELECT *, ' ' || trim(regexp_replace(lower(coalesce(red, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}]+', ' ', 'g')) || ' ' AS n FROM r),
      a AS (SELECT district_id AS g, ' ' || trim(regexp_replace(lower(unnest(string_split(aliases, '|'))), '[^\p{{L}}\p{{M}}\p{{Nd}}]+', ' ', 'g')) || ' ' AS w FROM district_gazetteer),
      h AS (SELECT signal_id, list_sort(list(DISTINCT g)) AS places FROM n JOIN a ON contains(n, w) GROUP BY 1),
      t AS (SELECT n.*, coalesce(places, []) AS places, list_sort(list_filter([{", ".join(f"'{x}'" for x in C.DISEASES)}], lambda x: contains(n, ' ' || x || ' '))) AS dis FROM n LEFT JOIN h USING (signal_id))
      SELECT signal_id, red AS redacted, array_to_string(dis, ',') AS diseases, array_to_string(places, ',') AS districts, {_CLASS(_FOLD("coalesce(red, '')"), "year(timezone('UTC', retrieved_at))")} AS found_class,
        array_to_string(list_filter([CASE WHEN len(dis) = 0 THEN 'no_disease' END, CASE WHEN len(places) = 0 THEN 'no_district' END, CASE WHEN len(places) > 1 THEN 'several_districts' END, CASE WHEN red <> raw THEN 'identifiers_redacted' END], lambda x: x IS NOT NULL), ',') AS warnings,
        sha256(red) AS content_sha256 FROM t""",
    "evidence_spans": r"""WITH x AS (SELECT doc_id, translate(regexp_replace(text, '\p{Cc}', ' ', 'g'), '<>', '‹›') AS t FROM documents),
      y AS (SELECT doc_id, t, length(t) AS n, greatest(1, least(coalesce(least(nullif(instr(lower(t), 'malaria'), 0), nullif(instr(lower(t), 'dengue'), 0)), 1) - 1200, length(t) - 2400 + 1)) AS b FROM x),
      z AS (SELECT *, substring(t, b, 2400) AS raw FROM y),
      w AS (SELECT *, CASE WHEN b > 1 THEN length(raw) - length(regexp_replace(raw, '^\S{0,80}\s+', '')) ELSE 0 END AS head, CASE WHEN b + 2400 <= n THEN regexp_replace(raw, '\s+\S{0,80}$', '') ELSE raw END AS tail FROM z)
      SELECT doc_id, CASE WHEN n <= 2400 THEN 0 ELSE b + head - 1 END AS "begin", CASE WHEN n <= 2400 THEN t ELSE substring(tail, head + 1) END AS span FROM w""",
    "dictionary_match": r"""WITH x AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}]', ' ', 'g') || ' ' AS t FROM documents), a AS (SELECT DISTINCT district_id, unnest(string_split(aliases, '|')) AS alias FROM district_gazetteer),
      p AS (SELECT doc_id, district_id, alias, instr(t, ' ' || lower(alias) || ' ') AS place FROM x JOIN a ON contains(t, ' ' || lower(alias) || ' '))
      SELECT doc_id, district_id, arg_max(alias, (length(alias), alias)) AS alias, CAST(arg_max(place, (length(alias), alias)) AS INT) AS "at" FROM p GROUP BY 1, 2""",
    "fingerprint_dups": r"SELECT f AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS f FROM documents) GROUP BY 1 HAVING count(*) > 1",
    "lexical_rank": r"WITH x AS (SELECT doc_id, round(len(list_intersect(['indoor', 'spraying', 'malaria', 'cases'], regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}_]+'))) / 4.0, 6) AS score FROM documents WHERE text IS NOT NULL) SELECT doc_id, score FROM x ORDER BY score DESC, doc_id LIMIT 20",
    "vector_topk": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q WHERE vec_id <> query_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank_in_group FROM x QUALIFY rank_in_group <= 5",
    "url_canonical": r"""WITH x AS (SELECT snapshot_id, requested_url AS u, length(regexp_replace(snapshot_id, '[^a-f]', '', 'g')) % 5 AS n FROM source_snapshot WHERE requested_url IS NOT NULL),
      y AS (SELECT snapshot_id, CASE n WHEN 0 THEN u || '?a=1&b=2' WHEN 3 THEN regexp_extract(u, '^(https://[^/]+)', 1) || '/' WHEN 4 THEN u || '/page/7' ELSE u END AS url, n FROM x)
      SELECT snapshot_id, url, n IN (3, 4) AS navigation, true AS allowed FROM y""",
    "html_visible_text": r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\s+', ' ', 'g')) AS visible_text FROM documents",
    "point_in_polygon": f"WITH {_RING}, h AS (SELECT vintage_id, e.district_id FROM recent_vintage v JOIN e ON (ay > latitude) <> (b_y > latitude) AND (bx - ax) * (latitude - ay) / (b_y - ay) + ax > longitude GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT v.vintage_id, min(h.district_id) AS district_id FROM recent_vintage v LEFT JOIN h ON h.vintage_id = v.vintage_id GROUP BY 1",
    "grid_cell_shared": "WITH c AS (SELECT district_id, round_even(latitude / 0.5, 0) AS a, round_even(longitude / 0.625, 0) AS b FROM district_gazetteer) SELECT x.district_id, coalesce(string_agg(y.district_id, ',' ORDER BY y.district_id), '') AS shares_cell_with FROM c x LEFT JOIN c y ON x.a = y.a AND x.b = y.b AND x.district_id <> y.district_id GROUP BY 1",
    "model_ladder": f"""WITH {_E}, x AS (SELECT nation, week, week + 7 AS tw, sum(event) OVER (PARTITION BY nation ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS e4, lead(event) OVER (PARTITION BY nation ORDER BY week) AS y, row_number() OVER (PARTITION BY nation ORDER BY week) AS pos FROM ev),
      z AS (SELECT *, month(tw) AS mo FROM x WHERE pos > 1 AND y IS NOT NULL), tr AS (FROM z WHERE tw < DATE '1999-01-01'), te AS (FROM z WHERE week >= DATE '1999-01-01'),
      g AS (SELECT avg(y) AS g FROM tr), m AS (SELECT mo, (sum(y) + 5 * any_value(g)) / (count(*) + 5) AS m FROM tr, g GROUP BY 1), k AS (SELECT nation, mo, (sum(y) + 5 * any_value(m)) / (count(*) + 5) AS k FROM tr JOIN m USING (mo) GROUP BY 1, 2),
      p AS (SELECT y, unnest([{{'c': 'unconditional', 'p': g}}, {{'c': 'month', 'p': coalesce(m, g)}}, {{'c': 'key_month', 'p': coalesce(k, m, g)}}, {{'c': 'persistence', 'p': CASE WHEN e4 > 0 THEN 0.85 ELSE 0.05 END::DOUBLE}}], recursive := true) FROM te CROSS JOIN g LEFT JOIN m USING (mo) LEFT JOIN k USING (nation, mo)),
      s AS (SELECT c AS contestant, count(*) AS n, avg(pow(p - y, 2)) AS b FROM p GROUP BY 1)
      SELECT contestant, n, round(b, 8) AS brier, contestant = (SELECT arg_min(contestant, (b, contestant)) FROM s) AS chosen FROM s""",
    "month_windows": "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "attempt_fold": "WITH e AS (SELECT user_id AS key, (ts, event_id) AS p, event_type AS k FROM events), o AS (SELECT key, max(p) AS ok FROM e WHERE k = 'purchase' GROUP BY 1) SELECT e.key, count(*) AS attempts, count(*) FILTER (k = 'purchase') AS done, count(*) FILTER (k = 'error' AND (ok IS NULL OR p > ok)) AS errors, arg_max(k, p) AS last_kind FROM e LEFT JOIN o ON e.key = o.key GROUP BY 1",
    "ext_sessions": "WITH x AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM x GROUP BY 1",
    "intent_route": f"""SELECT signal_id, CASE WHEN {_HAS(C.CLINICAL_TERMS)} THEN 'clinical_advice_request'
        WHEN {_HAS(C.FORECAST_TERMS)} OR (sick AND ({_HAS(C.OUTLOOK_TERMS)})) OR (({_HAS(C.FUTURE_TERMS)}) AND (sick OR {_HAS(C.OUTBREAK_TERMS)})) THEN 'forecast_request'
        WHEN {_HAS(C.INCIDENCE_TERMS)} OR (contains(t, 'how many') AND contains(t, 'case')) OR (sick AND NOT ({_HAS(C.EVIDENCE_NOUNS)}) AND ((({_HAS(C.COMPARISON_TERMS)}) AND ({_HAS(C.STATISTIC_NOUNS)})) OR {_HAS(C.TREND_TERMS)} OR {_HAS(C.DISTRIBUTION_TERMS)})) THEN 'incidence_request'
        WHEN {_HAS(C.AUDIT_TERMS)} THEN 'data_audit' WHEN {_HAS(C.VERIFIED_TERMS)} THEN 'verified_events' WHEN {_HAS(C.ALERT_TERMS)} THEN 'candidate_alerts' ELSE 'evidence_search' END AS intent,
      CASE WHEN {_HAS(['three month', '3 month', '12 week'])} THEN 12 WHEN {_HAS(['two month', '2 month', '8 week'])} THEN 8 WHEN {_HAS(['next month', 'one month', '4 week'])} THEN 4 WHEN {_HAS(['2 week', 'two week'])} THEN 2 ELSE 1 END AS weeks,
      CASE WHEN {_HAS(['three month', '3 month', '12 week'])} THEN 3 WHEN {_HAS(['two month', '2 month', '8 week'])} THEN 2 ELSE 1 END AS months
      FROM (SELECT signal_id, coalesce(lower(evidence_text), '') AS t, {_HAS(C.DISEASES, "coalesce(lower(evidence_text), '')")} AS sick FROM redacted_signal)""",
    "scope_inheritance": "WITH t AS (SELECT signal_id, source_id, retrieved_at, CASE WHEN assertion_class = 'speculative' THEN NULL ELSE district_id END AS m FROM redacted_signal), x AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY retrieved_at, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM t) SELECT signal_id, coalesce(m, earlier) AS resolved, CASE WHEN m IS NOT NULL THEN 'stated' WHEN earlier IS NOT NULL THEN 'inherited' ELSE 'unscoped' END AS scope_state FROM x",
}
