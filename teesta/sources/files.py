"""Files in and out: contracts on CSV, nested JSON, GeoJSON, feeds, wide monthly sheets, vintages with digests, registries, manifests.

Readers take paths Spark can list and give DataFrames; nothing is inferred from
the data, and what breaks a contract is an error or a typed row, never dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A file whose header isn't the agreed one."""


def read_csv_exact(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """A CSV of exactly these columns, in any order, all as text; blank cells are null. A byte-order mark is passed over.

    The first file's header settles the order; the header of every file is held
    against it as the file is read, and one that differs is an error, not a
    column misread.
    """
    head = spark.read.option("header", False).option("encoding", encoding).csv(path).limit(1).first()
    cells = [c or "" for c in head] if head else []
    names = [c.lstrip("\ufeff").strip() for c in cells]
    missing, unexpected = [c for c in columns if c not in names], [c for c in names if c not in columns]
    if missing or unexpected or len(names) != len(set(names)):
        raise ContractError(f"missing columns {missing}, unexpected columns {unexpected}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in cells])
    x = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", encoding).option("nullValue", "").csv(path)
    return x.toDF(*names).select(*columns)


def typed(df: DataFrame, kinds: dict[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, violations): columns cast to `kinds`; a text that can't be cast is null and named in a violation (key, column, raw)."""
    good = df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"))) for c, k in kinds.items()]))
    return good, df.select(key, F.explode(bad).alias("_v")).select(key, "_v.column", "_v.raw")


def read_daily_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Provider JSON of parameter to day to value: file, parameter, day, value, unit, is_fill_value; the file's own fill value is no value."""
    schema = "header struct<start:string,`end`:string,fill_value:double>, properties struct<parameter:map<string,map<string,double>>>, parameters map<string,struct<units:string>>"
    j = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), "header.fill_value", "parameters", F.explode("properties.parameter").alias("parameter", "_days"))
    d = j.select("file", "fill_value", "parameter", F.try_element_at("parameters", F.col("parameter"))["units"].alias("unit"), F.explode("_days").alias("_d", "_v"))
    fill = F.coalesce(F.col("_v") == F.col("fill_value"), F.lit(False))
    return d.select("file", "parameter", F.try_to_date("_d", "yyyyMMdd").alias("day"), F.when(~fill, F.col("_v")).alias("value"), "unit", fill.alias("is_fill_value"))


def grid_completeness(daily: DataFrame) -> DataFrame:
    """file, days, parameters, whole: whether every parameter has a row for every day from the first to the last."""
    a = daily.groupBy("file").agg(F.count_distinct("parameter").alias("parameters"), F.count_distinct("parameter", "day").alias("_cells"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"))
    return a.select("file", "days", "parameters", (F.col("_cells") == F.col("days") * F.col("parameters")).alias("whole"))


def read_ensemble(spark: SparkSession, path: str, variable: str, days: int) -> DataFrame:
    """file, member, day_no, value from arrays named <variable> and <variable>_memberNN; a member whose array is short or has a null is left out and named by `read_ensemble_gaps`."""
    j = spark.read.schema("daily map<string,array<string>>").option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.explode("daily").alias("name", "_a")).where(F.col("name").rlike(rf"^{variable}(_member\d+)?$"))
    number = F.regexp_extract("name", r"member(\d+)$", 1)
    m = j.select("file", F.when(number == "", 0).otherwise(number.try_cast("int")).alias("member"), F.transform("_a", lambda v: v.try_cast("double")).alias("_v"))
    whole = m.where((F.size("_v") >= days) & ~F.exists("_v", lambda v: v.isNull()))
    return whole.select("file", "member", F.posexplode("_v").alias("day_no", "value"))


def read_features(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """GeoJSON features: the named properties as text, and the outer rings, one row a ring; MultiPolygons give several."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").alias("j"))
    f = raw.select(F.explode("j.features").alias("f"))
    point = "array<double>"
    poly = F.from_json("f.geometry.coordinates", f"array<array<{point}>>")
    multi = F.from_json("f.geometry.coordinates", f"array<array<array<{point}>>>")
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.element_at(poly, 1))).when(F.col("f.geometry.type") == "MultiPolygon", F.transform(multi, lambda p: F.element_at(p, 1)))
    rings = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))))
    return f.select(*[F.try_element_at("f.properties", F.lit(p)).alias(p) for p in properties], F.explode_outer(rings).alias("ring"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS feed: title, link, pubDate, description."""
    schema = "title string, link string, pubDate string, description string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def unpivot_months(wide: DataFrame, ids: Sequence[str], header: str = r"^(?P<place>.+?)\s*\((?P<code>[A-Z]+)\)$", aliases: DataFrame | None = None) -> DataFrame:
    """Wide sheets to long: ids, place, value for every column that isn't an id. `aliases` (alias, place) names the columns' places; an unknown column is an error."""
    values = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(list(ids), values, "place", "value")
    if aliases is None:
        return long
    known = {r[0] for r in aliases.select("alias").distinct().collect()}  # as many rows as the sheet may have columns
    unknown = [c for c in values if c not in known]
    if unknown:
        raise ContractError(f"columns without a place: {unknown}")
    return long.withColumnRenamed("place", "alias").join(F.broadcast(aliases), "alias").select(*ids, "place", "value")


def verified_vintages(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """manifest rows with `content` and `digest_state`: ok, changed or absent. The manifest names object_name and sha256."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("object_name"), "content")
    j = manifest.join(files, "object_name", "left")
    return j.withColumn("digest_state", F.when(F.col("content").isNull(), "absent").when(F.sha2("content", 256) == F.lower("sha256"), "ok").otherwise("changed"))


def read_registry(spark: SparkSession, path: str, required: Sequence[str] = ("id", "name", "url")) -> DataFrame:
    """Sources of a JSON registry, one row each, with `problem`: a missing field or an id that stands twice."""
    s = "id string, name string, url string, kind string, languages array<string>, enabled boolean, allowed_hosts array<string>, minimum_interval_seconds int"
    r = spark.read.schema(f"sources array<struct<{', '.join(x.replace(' ', ':', 1) for x in s.split(', '))}>>").option("multiLine", True).json(path).select(F.inline("sources"))
    twice = r.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.trim(c) == "") for c in required])
    return r.join(twice, "id", "left").withColumn("problem", F.when(lacks, "missing_field").when(F.col("_twice"), "duplicate_id")).drop("_twice")


def scan_outbreak_ids(texts: DataFrame, key: str, text: str, state: str = "OR") -> DataFrame:
    """key, outbreak_id, district_code, year, week, serial of every id of the form <state>/<code>/<year>/<week>/<serial>, several to a line."""
    ids = F.regexp_extract_all(F.col(text), F.lit(rf"\b({state}/[A-Z]{{2,4}}/\d{{4}}/\d{{1,2}}/\d{{1,5}})\b"), 1)
    p = lambda i: F.element_at(F.split("outbreak_id", "/"), i)
    return texts.select(key, F.explode(ids).alias("outbreak_id")).select(key, "outbreak_id", p(2).alias("district_code"), p(3).cast("int").alias("year"), p(4).cast("int").alias("week"), p(5).cast("int").alias("serial"))


def latest_captures(captures: DataFrame) -> DataFrame:
    """Of each archived address the newest capture with status 200."""
    return captures.where(F.col("status") == "200").groupBy("original").agg(F.max_by(F.struct("timestamp", "digest", "mimetype"), "timestamp").alias("_c")).select("original", "_c.*")


def fiscal_month(fiscal_year: Column, month_no: Column) -> Column:
    """First day of a calendar month of a fiscal year that begins in April, '2023-24' style."""
    y = F.substring(fiscal_year, 1, 4).try_cast("int")
    return F.make_date(F.when(month_no >= 4, y).otherwise(y + 1), month_no, F.lit(1))


def sniffed(content: Column) -> Column:
    """Kind of a body by its first bytes."""
    h = F.upper(F.hex(F.substring(content, 1, 8)))
    return F.when(h.startswith("25504446"), "pdf").when(h.startswith("1F8B"), "gzip").when(h.startswith("504B0304"), "zip").when(h.rlike("^(3C21|3C68|3C48)"), "html").when(h.rlike("^(7B|5B)"), "json").otherwise("unknown")


def write_with_manifest(df: DataFrame, path: str, group: str, mode: str = "errorifexists") -> DataFrame:
    """Writes parquet and returns its manifest: rows, groups and an order-free digest over all rows, each as often as it stands."""
    df.write.mode(mode).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    h = F.xxhash64(*[F.col(c).cast("string") for c in back.columns])
    return back.agg(F.lit(path).alias("resource"), F.count(F.lit(1)).alias("row_count"), F.count_distinct(group).alias("group_count"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def collect_products(products: dict[str, DataFrame | Exception]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(union, failures): one product that failed doesn't drop the others."""
    good = [df.withColumn("product", F.lit(n)) for n, df in products.items() if isinstance(df, DataFrame)]
    failed = [(n, str(e)) for n, e in products.items() if not isinstance(e, DataFrame)]
    if not good:
        raise ContractError(f"every product failed: {failed}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good), failed
