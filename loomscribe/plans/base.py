"""Registration of queries, and fragments of SQL for what they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.functions.labels import STRATA, VERTICALS, canon_label, canon_vertical, known, not_blank
from loomscribe.functions.urls import site_of
from loomscribe.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def label_sql(c: str) -> str:
    s = rf"regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g')"
    return f"nullif({s}, '')"


def vertical_sql(c: str) -> str:
    s = label_sql(c)
    return f"CASE {s} WHEN 'saas' THEN 'software_saas' WHEN 'ecommerce' THEN 'ecommerce_retail' WHEN 'fintech' THEN 'fintech_insurance' WHEN 'other' THEN 'services_other' ELSE {s} END"


def host_sql(c: str) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '\s+', '', 'g')), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^.*@', ''), ':[0-9]*$', '')"
    return rf"nullif(regexp_replace({s}, '^\.+|\.+$', '', 'g'), '')"


def site_sql(c: str) -> str:
    return f"array_to_string(string_split({host_sql(c)}, '.')[-2:], '.')"


def in_sql(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: Distinct human posts, one row a doc_id: labels canonical, the longest text, the first snapshot.
POSTS_SQL = f"""posts AS (
  SELECT doc_id, min(CASE WHEN {label_sql('stratum')} IN {in_sql(STRATA)} THEN {label_sql('stratum')} END) AS stratum,
         min(CASE WHEN {vertical_sql('vertical')} IN {in_sql(VERTICALS)} THEN {vertical_sql('vertical')} END) AS vertical,
         min({site_sql('domain')}) AS site, max(story_human) AS text, min(title) AS title, min(url) AS url, max(words) AS words,
         min(CASE WHEN regexp_matches(snapshot_ts, '^[0-9]{{14}}$') THEN snapshot_ts END) AS snapshot_ts
  FROM story_human_frozen WHERE doc_id IS NOT NULL GROUP BY doc_id)"""


def posts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "story_human_frozen").where("doc_id IS NOT NULL")
    good_ts = F.when(F.col("snapshot_ts").rlike("^[0-9]{14}$"), F.col("snapshot_ts"))
    return s.groupBy("doc_id").agg(
        F.min(known(canon_label("stratum"), STRATA)).alias("stratum"), F.min(known(canon_vertical("vertical"), VERTICALS)).alias("vertical"),
        F.min(site_of("domain")).alias("site"), F.max("story_human").alias("text"), F.min("title").alias("title"), F.min("url").alias("url"),
        F.max("words").alias("words"), F.min(good_ts).alias("snapshot_ts"))


#: The last successful call for each post and source.
MIRRORS_SQL = f"""mir AS (
  SELECT doc_id, src AS source, arg_max(text, (call_id)) AS text, max(call_id) AS call_id FROM (
    SELECT doc_id, {label_sql('source')} AS src, call_id, text FROM mirrors WHERE text IS NOT NULL AND regexp_matches(text, '[^ \\t\\r\\n]')) GROUP BY 1, 2)"""


def mirror_texts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mirrors").where(F.col("text").rlike(r"[^ \t\r\n]"))
    return m.groupBy("doc_id", canon_label("source").alias("source")).agg(F.max_by("text", "call_id").alias("text"), F.max("call_id").alias("call_id"))


FEATURES = ("f01__yes", "f01__no", "f02__ord", "f03__list", "f03__prose", "f04__ord", "f05__yes", "f06__ord")

#: One row for each text of the encoded matrix, with two rule-based predictions of label_ai.
ENCODED_SQL = f"""enc AS (
  SELECT doc_id, {label_sql('source')} AS source, max(label_ai) AS label_ai, min({site_sql('domain')}) AS site, min({vertical_sql('vertical')}) AS vertical,
         min({label_sql('stratum')}) AS stratum, {', '.join(f'max({c})::DOUBLE AS {c}' for c in FEATURES)}
  FROM features_encoded WHERE doc_id IS NOT NULL GROUP BY 1, 2),
pred AS (SELECT *, coalesce(f02__ord, 0) + coalesce(f04__ord, 0) + coalesce(f06__ord, 0) + 2 * coalesce(f05__yes, 0) AS score,
         (coalesce(f02__ord, 0) + coalesce(f04__ord, 0) + coalesce(f06__ord, 0) + 2 * coalesce(f05__yes, 0) >= 4)::INT AS p1,
         (coalesce(f01__yes, 0) + coalesce(f03__list, 0) + coalesce(f05__yes, 0) >= 2)::INT AS p2 FROM enc)"""


def encoded(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "features_encoded").where("doc_id IS NOT NULL")
    return e.groupBy("doc_id", canon_label("source").alias("source")).agg(
        F.max("label_ai").alias("label_ai"), F.min(site_of("domain")).alias("site"), F.min(canon_vertical("vertical")).alias("vertical"),
        F.min(canon_label("stratum")).alias("stratum"), *[F.max(c).cast("double").alias(c) for c in FEATURES])


def predicted(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    e = encoded(spark, d).withColumn("score", z("f02__ord") + z("f04__ord") + z("f06__ord") + 2 * z("f05__yes"))
    return e.withColumn("p1", (F.col("score") >= 4).cast("int")).withColumn("p2", (z("f01__yes") + z("f03__list") + z("f05__yes") >= 2).cast("int"))


def r6(c):
    return F.round(c, 6)


__all__ = ["ENCODED_SQL", "FEATURES", "MIRRORS_SQL", "ORACLE", "POSTS_SQL", "QUERIES", "canon_label", "canon_vertical", "encoded", "host_sql", "in_sql", "known",
           "label_sql", "mirror_texts", "not_blank", "posts", "predicted", "query", "r6", "site_of", "site_sql", "table", "vertical_sql"]
