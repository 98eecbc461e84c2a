"""Sources, filters, joins, order-dependent picks, sets, scalars and text measures of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions import text as T
from loomscribe.functions.hashing import draw
from loomscribe.functions.style import MEASURES, style_sql, style_vector
from loomscribe.functions.urls import LEGAL_FORMS, company_key, host_of
from loomscribe.operators.dedup import greedy_near_duplicates
from loomscribe.operators.weights import tfidf
from loomscribe.operators.relational import capped, keep_last, keep_one, prefix_sum_split, quota, ranked_upto, running_sums
from loomscribe.plans.base import (MIRRORS_SQL, POSTS_SQL, canon_label, canon_vertical, host_sql, in_sql, known, label_sql, mirror_texts, posts, query, r6,
                                   site_of, site_sql, table, vertical_sql)
from loomscribe.runtime import cut, spread

WORDS2 = r"len(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]{{2,}}'))"
BLANKS = r"len(regexp_extract_all(coalesce({0}, ''), '[^ \t\r\n\f\x0b]+'))"
TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


def lang_sql(c: str) -> str:
    tok = TOKENS.format(c)
    v = {k: f"len(list_filter({tok}, lambda w: w IN {in_sql(ws)}))" for k, ws in T.STOP_WORDS.items()}
    top = f"greatest({', '.join(v.values())})"
    return f"CASE WHEN {top} = 0 THEN 'other' " + " ".join(f"WHEN {x} = {top} THEN '{k}'" for k, x in v.items()) + " END"


CASCADE_SQL = f"""WITH s AS (SELECT doc_id, nullif(lower(trim(source)), '') AS src, text, {WORDS2.format('text')} AS n, {lang_sql('text')} AS found FROM documents),
f AS (SELECT doc_id, src, found, n, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^ \\t\\r\\n]') THEN 'fetch' WHEN found <> 'en' THEN 'language'
        WHEN n < 60 OR n > 2500 THEN 'length' WHEN regexp_matches(text, '(?i)<div|<p>') THEN 'genre' END AS why FROM s),
k AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY src, why IS NULL ORDER BY doc_id) END AS rn FROM f),
r AS (SELECT found, CASE WHEN why IS NULL AND rn > 200 THEN 'cap' ELSE coalesce(why, 'kept') END AS why FROM k)
SELECT found AS language, why AS outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY found), 6) AS share FROM r GROUP BY 1, 2"""


@query(CASCADE_SQL)
def f12_drop_cascade(spark, d):
    """By language: what the ordered cascade fetch, language, length, genre, cap does with documents; the first failing reason counts."""
    t = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    s = t.select("doc_id", F.nullif(F.lower(F.trim("source")), F.lit("")).alias("src"), "text", T.word_count("text").alias("n"), T.language(T.language_votes("text")).alias("found"))
    why = (F.when(F.col("text").isNull() | ~F.col("text").rlike(r"[^ \t\r\n]"), "fetch").when(F.col("found") != "en", "language")
           .when(~F.col("n").between(60, 2500), "length").when(F.col("text").rlike(r"(?i)<div|<p>"), "genre"))
    f = cut(s.select("doc_id", "src", "found", why.alias("why")), "cascade")  # read three times below, without the texts
    # the cap needs only the 200 first kept rows of a source: Spark stops each group there before the shuffle
    kept = capped(f.where("why IS NULL").select("doc_id", "src", "found"), ["src"], [F.col("doc_id")], 200).groupBy("found").agg(F.count("*").alias("n"))
    total = f.groupBy("found", "why").agg(F.count("*").alias("n"))
    out = total.where("why IS NOT NULL").select("found", "why", "n").unionByName(kept.select("found", F.lit("kept").alias("why"), "n"))
    over = total.where("why IS NULL").select("found", F.col("n").alias("_all")).join(kept.withColumnRenamed("n", "_k"), "found", "left")
    over = over.select("found", F.lit("cap").alias("why"), (F.col("_all") - F.coalesce("_k", F.lit(0))).alias("n")).where("n > 0")
    out = out.unionByName(over)
    return out.select(F.col("found").alias("language"), F.col("why").alias("outcome"), "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("found"))).alias("share"))


@query()
def f12_cascade_with_near_duplicates(spark, d):
    """By source: the cascade with its near-duplicate step before the cap: a post is dropped if it is like one kept before it in its source."""
    t = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    s = t.select("doc_id", F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("-")).alias("src"), "text", T.word_count("text").alias("n"), T.language(T.language_votes("text")).alias("found"))
    why = (F.when(F.col("text").isNull() | ~F.col("text").rlike(r"[^ \t\r\n]"), "fetch").when(F.col("found") != "en", "language")
           .when(~F.col("n").between(60, 2500), "length").when(F.col("text").rlike(r"(?i)<div|<p>"), "genre"))
    f = cut(s.withColumn("why", why).select("doc_id", "src", "why", F.when(F.col("why").isNull(), F.col("text")).alias("text")), "cascade")
    alike = greedy_near_duplicates(f.where("why IS NULL"), "src", "doc_id", "text").where("NOT kept").select("src", "doc_id")
    dropped = f.where("why IS NOT NULL").select("src", "doc_id", "why").unionByName(alike.withColumn("why", F.lit("near_duplicate")))
    left = cut(f.select("src", "doc_id").join(dropped.select("src", "doc_id"), ["src", "doc_id"], "left_anti"), "left")
    kept = capped(left, ["src"], [F.col("doc_id")], 200).groupBy("src").agg(F.count("*").alias("k"))
    over = left.groupBy("src").agg(F.count("*").alias("n")).join(kept, "src")
    over = over.select("src", F.explode(F.array(F.struct(F.lit("kept").alias("why"), F.col("k").alias("n")), F.struct(F.lit("cap").alias("why"), (F.col("n") - F.col("k")).alias("n")))).alias("x")).select("src", "x.why", "x.n").where("n > 0")
    return dropped.groupBy("src", "why").agg(F.count("*").alias("n")).unionByName(over).select(F.col("src").alias("source"), F.col("why").alias("outcome"), "n")


@query(f"""SELECT coalesce({label_sql('stratum')}, '-') AS stratum, count(*) AS n, count(DISTINCT {host_sql('domain')}) AS hosts, count(nullif(trim(industry_raw), '')) AS with_industry
FROM site_frame WHERE nullif(trim(domain), '') IS NOT NULL GROUP BY 1""")
def src1_frame_reader(spark, d):
    t = table(spark, d, "site_frame").where(F.nullif(F.trim("domain"), F.lit("")).isNotNull())
    return t.groupBy(F.coalesce(canon_label("stratum"), F.lit("-")).alias("stratum")).agg(
        F.count("*").alias("n"), F.count_distinct(host_of("domain")).alias("hosts"), F.count(F.nullif(F.trim("industry_raw"), F.lit(""))).alias("with_industry"))


@query(f"""SELECT coalesce({vertical_sql('vertical')}, '-') AS vertical, count(*) AS n, sum(coalesce(try_cast(replace(trim(employees), ',', '') AS DOUBLE), 0))::BIGINT AS employees,
count(try_cast(replace(trim(employees), ',', '') AS DOUBLE)) AS numeric_rows FROM site_frame GROUP BY 1""")
def src3_numeric_coercion(spark, d):
    x = F.replace(F.trim("employees"), F.lit(","), F.lit("")).try_cast("double")
    return table(spark, d, "site_frame").groupBy(F.coalesce(canon_vertical("vertical"), F.lit("-")).alias("vertical")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(x, F.lit(0.0))).cast("long").alias("employees"), F.count(x).alias("numeric_rows"))


@query(f"""WITH {POSTS_SQL}, {MIRRORS_SQL}, u AS (SELECT doc_id, 'human' AS source, text FROM posts UNION ALL SELECT doc_id, source, text FROM mir)
SELECT source, count(*) AS n, sum({BLANKS.format('text')})::BIGINT AS words FROM u GROUP BY 1""")
def src17_text_union(spark, d):
    u = posts(spark, d).select("doc_id", F.lit("human").alias("source"), "text").unionByName(mirror_texts(spark, d).select("doc_id", "source", "text"))
    return u.groupBy("source").agg(F.count("*").alias("n"), F.sum(T.blank_count("text")).cast("long").alias("words"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length,
round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings""")
def src18_l2_normalise(spark, d):
    from loomscribe.operators.geometry import unit_vector

    e = table(spark, d, "embeddings")
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("vec_id", F.round(F.sqrt(sq), 5).alias("length"), F.round(F.element_at(unit_vector(F.col("embedding")), 1), 5).alias("first"))


@query(f"SELECT doc_id, length(x) AS n_chars, md5(x) AS text_md5 FROM (SELECT doc_id, {T.strip_tags_sql('text')} AS x FROM documents WHERE text LIKE '%<%>%')")
def x17_strip_tags(spark, d):
    t = table(spark, d, "documents").where(F.col("text").like("%<%>%"))
    return t.select("doc_id", T.strip_tags("text").alias("x")).select("doc_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("text_md5"))


_F1 = f"""WITH h AS (SELECT DISTINCT domain, {host_sql('domain')} AS host FROM (SELECT domain FROM site_frame UNION ALL SELECT domain FROM documents UNION ALL SELECT url FROM story_human_frozen)),
p AS (SELECT domain, string_split(host, '.') AS l FROM h WHERE host IS NOT NULL)
SELECT domain, array_to_string(CASE WHEN len(l) >= 3 AND l[-2] IN ('co','com','org','net','ac','gov','edu') AND length(l[-1]) <= 3 THEN l[-3:] ELSE l[-2:] END, '.') AS registered FROM p"""


@query(_F1)
def f1_registered_domain(spark, d):
    """The last two labels of a host, or three under a second-level public suffix."""
    x = table(spark, d, "site_frame").select("domain").unionAll(table(spark, d, "documents").select("domain")).unionAll(table(spark, d, "story_human_frozen").select("url"))
    h = x.distinct().select("domain", host_of("domain").alias("host")).where("host IS NOT NULL").withColumn("l", F.split("host", r"\."))
    deep = (F.size("l") >= 3) & F.try_element_at("l", F.lit(-2)).isin("co", "com", "org", "net", "ac", "gov", "edu") & (F.length(F.element_at("l", -1)) <= 3)
    return h.select("domain", F.when(deep, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)).alias("registered"))


@query(f"""SELECT host, count(*) AS n FROM (SELECT regexp_replace({host_sql('domain')}, '^www\\.', '') AS host FROM documents) WHERE host LIKE '%.%' GROUP BY 1""")
def f2_host_normalise(spark, d):
    h = table(spark, d, "documents").select(F.regexp_replace(host_of("domain"), r"^www\.", "").alias("host"))
    return h.where(F.contains("host", F.lit("."))).groupBy("host").agg(F.count("*").alias("n"))


RULES = (("health|clinic|pharma", "healthcare_life"), ("insur|bank|fintech|payment", "fintech_insurance"), ("software|it services|saas", "software_saas"),
         ("wholesale|retail|commerce", "ecommerce_retail"), ("logistic|freight|industr", "industrial_logistics"), ("educat|media|learning", "media_education"))


@query(f"""SELECT CASE {' '.join(f"WHEN regexp_matches(x, '{p}') THEN '{v}'" for p, v in RULES)} ELSE 'services_other' END AS rule_vertical, count(*) AS n
FROM (SELECT lower(coalesce(industry_raw, '') || ' ' || coalesce(company, '')) AS x FROM site_frame) GROUP BY 1""")
def f3_keyword_vertical(spark, d):
    """The first rule whose keyword stands in industry or company decides."""
    x = F.lower(F.concat(F.coalesce("industry_raw", F.lit("")), F.lit(" "), F.coalesce("company", F.lit(""))))
    c = F.coalesce(*[F.when(x.rlike(p), F.lit(v)) for p, v in RULES], F.lit("services_other"))
    return table(spark, d, "site_frame").groupBy(c.alias("rule_vertical")).agg(F.count("*").alias("n"))


_SLUG = r"regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '[^/]*$')"


# Parts of paths and endings of files that are no articles.
NO_ARTICLE_PATHS = ("tag", "tags", "category", "categories", "author", "page", "archive", "feed", "amp", "search")
NO_ARTICLE_FILES = ("xml", "json", "jpg", "jpeg", "png", "gif", "svg", "css", "js", "pdf")
NO_ARTICLE = f"/({'|'.join(NO_ARTICLE_PATHS)})/|[?#]|[.]({'|'.join(NO_ARTICLE_FILES)})$"


@query(f"""SELECT is_article, count(*) AS n, count(DISTINCT slug) AS slugs FROM (SELECT {_SLUG} AS slug,
 NOT regexp_matches(lower(url), '{NO_ARTICLE}') AND length({_SLUG}) >= 12 AND contains({_SLUG}, '-') AS is_article
 FROM story_human_frozen WHERE url IS NOT NULL) GROUP BY 1""")
def f4_article_url(spark, d):
    slug = F.substring_index(F.rtrim(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")), "/", -1)
    bad = F.lower("url").rlike(NO_ARTICLE)
    t = table(spark, d, "story_human_frozen").where("url IS NOT NULL").select(slug.alias("slug"), (~bad & (F.length(slug) >= 12) & F.contains(slug, F.lit("-"))).alias("is_article"))
    return t.groupBy("is_article").agg(F.count("*").alias("n"), F.count_distinct("slug").alias("slugs"))


@query(f"""SELECT place, count(*) AS n FROM (SELECT CASE WHEN regexp_matches({host_sql('url')}, '^(blog|news|resources)\\.') THEN {host_sql('url')}
 ELSE {host_sql('url')} || '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)/', 1) END AS place FROM story_human_frozen) WHERE place IS NOT NULL GROUP BY 1""")
def f5_blog_location(spark, d):
    """The blog subdomain, or host and first path part."""
    h = host_of("url")
    place = F.when(h.rlike(r"^(blog|news|resources)\."), h).otherwise(F.concat(h, F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]+)/", 1)))
    return table(spark, d, "story_human_frozen").select(place.alias("place")).where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("n"))


@query(f"""SELECT coalesce({label_sql('stratum')}, '-') AS stratum, count(*) AS n, count(*) FILTER (WHERE coalesce(try_cast(replace(trim(employees), ',', '') AS DOUBLE) <= 500, true)) AS kept FROM site_frame GROUP BY 1""")
def f7_size_filter(spark, d):
    """Firms of more than 500 people are dropped only where the number is one."""
    x = F.replace(F.trim("employees"), F.lit(","), F.lit("")).try_cast("double")
    return table(spark, d, "site_frame").groupBy(F.coalesce(canon_label("stratum"), F.lit("-")).alias("stratum")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(x <= 500, F.lit(True))).alias("kept"))


_P = "lower(concat_ws(' ', industry_raw, company))"


@query(f"""SELECT regexp_matches({_P}, 'staffing|wholesale|insurance') AND NOT regexp_matches({_P}, 'software|analytics') AS dropped, count(*) AS n, count(DISTINCT {site_sql('domain')}) AS sites FROM site_frame GROUP BY 1""")
def f8_persona_drop(spark, d):
    x = F.lower(F.concat_ws(" ", "industry_raw", "company"))
    return table(spark, d, "site_frame").groupBy((x.rlike("staffing|wholesale|insurance") & ~x.rlike("software|analytics")).alias("dropped")).agg(
        F.count("*").alias("n"), F.count_distinct(site_of("domain")).alias("sites"))


@query(f"""SELECT DISTINCT {site_sql('domain')} AS site, regexp_matches({_P}, 'staffing|wholesale|insurance') AND NOT regexp_matches({_P}, 'software|analytics') AS dropped FROM site_frame WHERE {site_sql('domain')} IS NOT NULL""")
def f8_persona_sets(spark, d):
    """The kept and the dropped sites themselves."""
    x = F.lower(F.concat_ws(" ", "industry_raw", "company"))
    t = table(spark, d, "site_frame").select(site_of("domain").alias("site"), (x.rlike("staffing|wholesale|insurance") & ~x.rlike("software|analytics")).alias("dropped"))
    return t.where("site IS NOT NULL").distinct()


@query(f"""SELECT matched, count(*) AS n FROM (SELECT len(list_filter(regexp_extract_all(lower(company), '[a-z0-9]+'), lambda w: length(w) >= 4 AND contains(replace({site_sql('domain')}, '-', ''), w))) > 0 AS matched
 FROM site_frame WHERE company IS NOT NULL AND {site_sql('domain')} IS NOT NULL) GROUP BY 1""")
def f9_name_in_domain(spark, d):
    """Whether a word of four or more letters of the name stands in the site's name."""
    t = table(spark, d, "site_frame").select(F.regexp_extract_all(F.lower("company"), F.lit("([a-z0-9]+)"), 1).alias("w"), F.replace(site_of("domain"), F.lit("-"), F.lit("")).alias("s"))
    t = t.where("w IS NOT NULL AND s IS NOT NULL")
    return t.groupBy(F.exists("w", lambda w: (F.length(w) >= 4) & F.contains(F.col("s"), w)).alias("matched")).agg(F.count("*").alias("n"))


@query(f"""WITH {POSTS_SQL} SELECT site, count(*) AS n_posts FROM posts WHERE words >= 100 AND site IN (SELECT {site_sql('domain')} FROM site_frame) GROUP BY 1 HAVING count(*) >= 2""")
def f10_keep_threshold(spark, d):
    frame = table(spark, d, "site_frame").select(site_of("domain").alias("site")).where("site IS NOT NULL").distinct()
    return posts(spark, d).where("words >= 100").join(frame, "site", "left_semi").groupBy("site").agg(F.count("*").alias("n_posts")).where("n_posts >= 2")


@query(r"""SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE regexp_matches(text, '[\x{00C2}-\x{00F4}](\s|$)|\x{FFFD}|Ã.|â€') GROUP BY 1""")
def f13_decode_damage(spark, d):
    t = table(spark, d, "documents").where(F.col("text").rlike(r"[\x{00C2}-\x{00F4}](\s|$)|\x{FFFD}|Ã.|â€"))
    return t.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))


@query(f"""SELECT {vertical_sql('vertical')} AS vertical, {label_sql('stratum')} AS stratum, count(*) AS n FROM story_human_frozen GROUP BY 1, 2""")
def f14_canonical_labels(spark, d):
    return table(spark, d, "story_human_frozen").groupBy(canon_vertical("vertical").alias("vertical"), canon_label("stratum").alias("stratum")).agg(F.count("*").alias("n"))


_ENT = "(?i)(^|[^a-z])(analytics|software|payments|clinics|staffing)([^a-z]|$)"


@query(f"""WITH {MIRRORS_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{_ENT}')) AS flagged, round(avg(regexp_matches(text, '{_ENT}')::INT), 6) AS rate FROM mir GROUP BY 1""")
def f17_entity_mentions(spark, d):
    hit = F.col("text").rlike(_ENT)
    return mirror_texts(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(hit).alias("flagged"), r6(F.avg(hit.cast("int"))).alias("rate"))


@query(f"""SELECT {label_sql('source')} AS source, CASE WHEN rewritten_text IS NULL OR NOT regexp_matches(rewritten_text, '[^ \\t\\r\\n]') THEN 'empty'
 WHEN regexp_matches(lower(rewritten_text[:200]), 'cannot|unable to|decline|won.t be able') THEN 'refusal' WHEN {BLANKS.format('rewritten_text')} < 60 THEN 'short'
 WHEN NOT regexp_matches(rewritten_text, '[.!?)"|][ \\t\\r\\n]*$') THEN 'open_end' ELSE 'ok' END AS state, count(DISTINCT call_id) AS n FROM rewrites GROUP BY 1, 2""")
def f18_degenerate_rewrites(spark, d):
    t = F.col("rewritten_text")
    state = (F.when(t.isNull() | ~t.rlike(r"[^ \t\r\n]"), "empty").when(F.lower(F.substring(t, 1, 200)).rlike("cannot|unable to|decline|won.t be able"), "refusal")
             .when(T.blank_count(t) < 60, "short").when(~t.rlike(r'[.!?)"|][ \t\r\n]*$'), "open_end").otherwise("ok"))
    return table(spark, d, "rewrites").groupBy(canon_label("source").alias("source"), state.alias("state")).agg(F.count_distinct("call_id").alias("n"))


_RATIO = f"{BLANKS.format('rewritten_text')}::DOUBLE / greatest({BLANKS.format('original_text')}, 1)"


@query(f"""SELECT {label_sql('source')} AS source, count(*) AS n, count(*) FILTER (WHERE {_RATIO} BETWEEN 0.6 AND 1.4) AS within, round(avg({_RATIO}), 6) AS mean_ratio FROM rewrites GROUP BY 1""")
def f19_length_drift(spark, d):
    r = T.blank_count("rewritten_text") / F.greatest(T.blank_count("original_text"), F.lit(1))
    t = table(spark, d, "rewrites").select(canon_label("source").alias("source"), r.alias("r"))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("r").between(0.6, 1.4)).alias("within"), r6(F.avg("r")).alias("mean_ratio"))


_TITLE = "lower(trim(split_part(title, ' | ', 1)))"
_LINE = r"lower(trim(regexp_replace(split_part(ltrim(text, chr(10) || ' '), chr(10), 1), '^#+ *', '')))"


@query(f"""WITH {POSTS_SQL} SELECT coalesce({_TITLE} = {_LINE} OR starts_with({_LINE}, {_TITLE}[:40]) OR (length({_LINE}) > 0 AND starts_with({_TITLE}, {_LINE}[:40])), false) AS has_title, count(*) AS n FROM posts GROUP BY 1""")
def f20_title_present(spark, d):
    p = posts(spark, d).select(F.lower(F.trim(F.substring_index("title", " | ", 1))).alias("t"),
                               F.lower(F.trim(F.regexp_replace(F.substring_index(F.ltrim("text", F.lit("\n ")), "\n", 1), "^#+ *", ""))).alias("l"))
    has = (F.col("t") == F.col("l")) | F.startswith("l", F.substring("t", 1, 40)) | ((F.length("l") > 0) & F.startswith("t", F.substring("l", 1, 40)))
    return p.groupBy(F.coalesce(has, F.lit(False)).alias("has_title")).agg(F.count("*").alias("n"))


@query(f"""SELECT coalesce(contains(lower(stratum), 'list'), false) AS listed, count(*) AS n FROM story_human_frozen GROUP BY 1""")
def f22_substratum(spark, d):
    return table(spark, d, "story_human_frozen").groupBy(F.coalesce(F.contains(F.lower("stratum"), F.lit("list")), F.lit(False)).alias("listed")).agg(F.count("*").alias("n"))


_SPLITS = f"sp AS (SELECT doc_id, min(CASE WHEN {label_sql('doc_split')} IN ('train','val','test') THEN {label_sql('doc_split')} END) AS split FROM splits WHERE doc_id IS NOT NULL GROUP BY 1)"


def doc_splits(spark, d):
    s = table(spark, d, "splits").where("doc_id IS NOT NULL")
    return s.groupBy("doc_id").agg(F.min(known(canon_label("doc_split"), ("train", "val", "test"))).alias("split"))


@query(f"""WITH {_SPLITS} SELECT {label_sql('source')} AS source, coalesce(split, '') AS split, count(*) AS n FROM features_encoded f LEFT JOIN sp USING (doc_id) GROUP BY 1, 2""")
def j1_split_lookup(spark, d):
    f = table(spark, d, "features_encoded").select("doc_id", canon_label("source").alias("source"))
    return f.join(doc_splits(spark, d), "doc_id", "left").groupBy("source", F.coalesce("split", F.lit("")).alias("split")).agg(F.count("*").alias("n"))


@query(f"""WITH {POSTS_SQL}, {MIRRORS_SQL}, s AS (SELECT DISTINCT source FROM mir), w AS (SELECT doc_id, source FROM posts, s)
SELECT source, count(*) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM mir m WHERE m.doc_id = w.doc_id AND m.source = w.source) GROUP BY 1""")
def j2_resume_worklist(spark, d):
    """Posts that still lack a text of each source; posts times the few sources, without the pairs that are done."""
    m = mirror_texts(spark, d).select("doc_id", "source")
    done = m.groupBy("source").agg(F.count("*").alias("_any"))
    work = posts(spark, d).select("doc_id").crossJoin(F.broadcast(done.select("source")))  # a handful of sources
    return work.join(m, ["doc_id", "source"], "left_anti").groupBy("source").agg(F.count("*").alias("missing"))


@query(f"""SELECT {label_sql('source')} AS source, count(*) AS n FROM mirrors WHERE doc_id IN (SELECT doc_id FROM rewrites) GROUP BY 1""")
def j3_semi_membership(spark, d):
    return table(spark, d, "mirrors").select("doc_id", canon_label("source").alias("source")).join(table(spark, d, "rewrites").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH {MIRRORS_SQL}, rw AS (SELECT doc_id, {label_sql('source')} AS source, max(call_id) AS call_id, arg_max(original_text, call_id) AS o FROM rewrites GROUP BY 1, 2)
SELECT source, count(*) AS n, count(*) FILTER (WHERE mir.text = rw.o) AS same_text FROM mir JOIN rw USING (doc_id, source) GROUP BY 1""")
def j4_composite_join(spark, d):
    rw = table(spark, d, "rewrites").groupBy("doc_id", canon_label("source").alias("source")).agg(F.max_by("original_text", "call_id").alias("o"))
    j = mirror_texts(spark, d).join(rw, ["doc_id", "source"])
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("o")).alias("same_text"))


@query(f"""WITH {MIRRORS_SQL}, w AS (SELECT doc_id, source, {BLANKS.format('text')} AS n FROM mir)
SELECT a.source AS source_a, b.source AS source_b, count(*) AS pairs, round(avg(a.n::DOUBLE / b.n), 6) AS mean_ratio FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.source < b.source GROUP BY 1, 2""")
def j6_pairs_within_prompt(spark, d):
    """Pairs of sources of one post; a post has at most one text a source, so its pairs are few."""
    w = mirror_texts(spark, d).select("doc_id", "source", T.blank_count("text").alias("n"))
    a, b = w.alias("a"), w.alias("b")
    j = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.source") < F.col("b.source")))
    return j.groupBy(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b")).agg(F.count("*").alias("pairs"), r6(F.avg(F.col("a.n") / F.col("b.n"))).alias("mean_ratio"))


def grams_sql(tok: str, n: int) -> str:
    return f"CASE WHEN len({tok}) >= {n} THEN list_distinct(list_transform(generate_series(1, len({tok}) - {n - 1}), lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))) ELSE [] END"


_COPY = f"""WITH r AS (SELECT call_id, min({label_sql('source')}) AS source, min({TOKENS.format('original_text')}) AS o, min({TOKENS.format('rewritten_text')}) AS w FROM rewrites WHERE original_text IS NOT NULL AND rewritten_text IS NOT NULL GROUP BY 1),
g AS (SELECT call_id, source, {grams_sql('o', 8)} AS go, {grams_sql('w', 8)} AS gw FROM r),
s AS (SELECT *, len(list_intersect(go, gw)) AS shared FROM g)"""


@query(_COPY + """ SELECT source, count(*) AS n, count(*) FILTER (WHERE shared > 0) AS any_shared, round(avg(CASE WHEN len(gw) = 0 THEN 1.0 ELSE shared::DOUBLE / len(gw) END), 6) AS mean_copy,
count(*) FILTER (WHERE CASE WHEN len(gw) = 0 THEN 1.0 ELSE shared::DOUBLE / len(gw) END > 0.9) AS copies FROM s GROUP BY 1""")
def x10_copy_fraction(spark, d):
    """Share of a rewording's distinct 8-grams that its original has."""
    r = table(spark, d, "rewrites").where("original_text IS NOT NULL AND rewritten_text IS NOT NULL")
    r = r.groupBy("call_id").agg(F.min(canon_label("source")).alias("source"), F.min(T.words("original_text")).alias("o"), F.min(T.words("rewritten_text")).alias("w"))
    g = r.select("source", T.ngrams(F.col("o"), 8).alias("go"), T.ngrams(F.col("w"), 8).alias("gw"))
    g = g.withColumn("shared", F.size(F.array_intersect("go", "gw"))).withColumn("f", F.when(F.size("gw") == 0, 1.0).otherwise(F.col("shared") / F.size("gw")))
    return g.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("shared") > 0).alias("any_shared"), r6(F.avg("f")).alias("mean_copy"), F.count_if(F.col("f") > 0.9).alias("copies"))


_J7 = f"""WITH {POSTS_SQL}, {MIRRORS_SQL}, h AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM posts), m AS (SELECT doc_id, source, {TOKENS.format('text')} AS t FROM mir),
hg AS (SELECT doc_id, {grams_sql('t', 13)} AS g FROM h), mg AS (SELECT doc_id, source, {grams_sql('t', 13)} AS g FROM m)
SELECT source, count(*) AS pairs, count(*) FILTER (WHERE list_has_any(hg.g, mg.g)) AS hits FROM hg JOIN mg USING (doc_id) GROUP BY 1"""


def shared_windows(h, m, n=13):
    """By source: mirrors, and those that share n words in a row with their post. Texts are joined; windows exist only inside the tasks, as places in the words."""
    both = h.join(m.select("doc_id", "source", "text"), "doc_id").select("source", T.words("post").alias("a"), T.words("text").alias("b"))
    grams = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.xxhash64(F.slice(c, i, n)))).otherwise(F.array().cast("array<bigint>"))
    met = both.select("source", "a", "b", F.arrays_overlap(grams(F.col("a")), grams(F.col("b"))).alias("hit"))
    sure = F.col("hit") & F.arrays_overlap(T.ngrams(F.col("a"), n), T.ngrams(F.col("b"), n))  # equal hashes are compared as words
    return met.groupBy("source").agg(F.count("*").alias("pairs"), F.count_if(sure).alias("hits"))


@query(_J7)
def j7_ngram_containment(spark, d):
    """Mirrors that repeat thirteen words of the post they were written from."""
    return shared_windows(posts(spark, d).select("doc_id", F.col("text").alias("post")), mirror_texts(spark, d))


@query(f"""WITH {POSTS_SQL}, {MIRRORS_SQL}, r AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('13|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM posts),
nx AS (SELECT a.doc_id, b.text AS other FROM r a JOIN r b ON b.k = a.k % a.n + 1), hg AS (SELECT doc_id, {TOKENS.format('other')} AS t FROM nx), m AS (SELECT doc_id, source, {TOKENS.format('text')} AS t FROM mir),
h2 AS (SELECT doc_id, {grams_sql('t', 13)} AS g FROM hg), m2 AS (SELECT doc_id, source, {grams_sql('t', 13)} AS g FROM m)
SELECT source, count(*) AS pairs, count(*) FILTER (WHERE list_has_any(h2.g, m2.g)) AS hits FROM h2 JOIN m2 USING (doc_id) GROUP BY 1""")
def j8_shuffled_control(spark, d):
    """The same against another post: the next one in hash order, the last against the first. Ranks come from bucket counts, not one window."""
    p = posts(spark, d).select("doc_id", "text", F.md5(F.concat(F.lit("13|"), "doc_id")).alias("h"))
    p = p.withColumn("b", F.substring("h", 1, 2))
    before = p.groupBy("b").agg(F.count("*").alias("c"))
    before = before.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy(F.lit(1))))
    r = p.join(F.broadcast(before), "b").withColumn("k", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", "doc_id")))  # 256 buckets
    nx = r.select("doc_id", (F.col("k") % F.col("n") + 1).alias("k")).join(r.select("k", F.col("text").alias("post")), "k")
    return shared_windows(nx.select("doc_id", "post"), mirror_texts(spark, d))


@query(f"""WITH {MIRRORS_SQL}, w AS (SELECT doc_id, source, {BLANKS.format('text')} AS n FROM mir)
SELECT doc_id, max(n) FILTER (WHERE source = 'aster') AS aster, max(n) FILTER (WHERE source = 'borel') AS borel, max(n) FILTER (WHERE source = 'cygne') AS cygne,
max(n) FILTER (WHERE source = 'dunlin') AS dunlin, max(n) FILTER (WHERE source = 'egret') AS egret FROM w GROUP BY 1 HAVING count(DISTINCT source) = 5""")
def j11_wide_pivot(spark, d):
    """Posts with a text of every source, their lengths side by side."""
    names = ["aster", "borel", "cygne", "dunlin", "egret"]
    w = mirror_texts(spark, d).select("doc_id", "source", T.blank_count("text").cast("long").alias("n"))
    return w.groupBy("doc_id").pivot("source", names).agg(F.max("n")).where(" AND ".join(f"{x} IS NOT NULL" for x in names))


@query(f"""WITH {POSTS_SQL}, {MIRRORS_SQL}, rw AS (SELECT doc_id, {label_sql('source')} AS source, arg_max(rewritten_text, call_id) AS text FROM rewrites WHERE rewritten_text IS NOT NULL GROUP BY 1, 2),
s AS (SELECT doc_id, 'human' AS source, text, 'kept' AS origin FROM posts UNION ALL SELECT m.doc_id, m.source, coalesce(rw.text, m.text), CASE WHEN rw.text IS NULL THEN 'kept' ELSE 'replaced' END FROM mir m LEFT JOIN rw USING (doc_id, source))
SELECT source, origin, count(*) AS n, sum({BLANKS.format('text')})::BIGINT AS words FROM s GROUP BY 1, 2""")
def j12_splice_rewrites(spark, d):
    """Mirrors replaced by their rewordings where there is one, human posts kept."""
    rw = table(spark, d, "rewrites").where("rewritten_text IS NOT NULL").groupBy("doc_id", canon_label("source").alias("source")).agg(F.max_by("rewritten_text", "call_id").alias("new"))
    m = mirror_texts(spark, d).join(rw, ["doc_id", "source"], "left").select("doc_id", "source", F.coalesce("new", "text").alias("text"), F.when(F.col("new").isNull(), "kept").otherwise("replaced").alias("origin"))
    s = posts(spark, d).select("doc_id", F.lit("human").alias("source"), "text", F.lit("kept").alias("origin")).unionByName(m)
    return s.groupBy("source", "origin").agg(F.count("*").alias("n"), F.sum(T.blank_count("text")).cast("long").alias("words"))


@query(f"""WITH {POSTS_SQL}, q AS (SELECT quantile_cont(words, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM posts)
SELECT len(list_filter(q.e, lambda x: x <= words)) AS bin, count(*) AS n, min(words) AS low, max(words) AS high FROM posts, q WHERE words IS NOT NULL GROUP BY 1""")
def j13_decile_bins(spark, d):
    p = posts(spark, d).where("words IS NOT NULL")
    e = p.agg(F.percentile("words", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("e"))
    b = p.crossJoin(F.broadcast(e)).select("words", F.size(F.filter("e", lambda x: x <= F.col("words"))).alias("bin"))  # e is one row
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("words").alias("low"), F.max("words").alias("high"))


@query(f"""SELECT {site_sql('domain')} AS site, arg_min({label_sql('stratum')}, (CASE {label_sql('stratum')} WHEN 'listed_large' THEN 1 WHEN 'funded_directory' THEN 2 WHEN 'growth_list' THEN 3 ELSE 4 END, source_ref)) AS stratum,
min((CASE {label_sql('stratum')} WHEN 'listed_large' THEN 1 WHEN 'funded_directory' THEN 2 WHEN 'growth_list' THEN 3 ELSE 4 END)) AS prio
FROM site_frame WHERE {site_sql('domain')} IS NOT NULL GROUP BY 1""")
def w4_priority_dedup(spark, d):
    """Of each site the row of its first stratum by priority."""
    s = canon_label("stratum")
    prio = F.when(s == "listed_large", 1).when(s == "funded_directory", 2).when(s == "growth_list", 3).otherwise(4)
    t = table(spark, d, "site_frame").select(site_of("domain").alias("site"), s.alias("stratum"), prio.alias("prio"), "source_ref").where("site IS NOT NULL")
    return keep_one(t, ["site"], [F.col("prio"), F.col("source_ref")]).select("site", "stratum", "prio")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def w5_keep_first(spark, d):
    return keep_one(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(f"""SELECT doc_id, source, call_id, retries FROM (SELECT doc_id, {label_sql('source')} AS source, call_id, retries, row_number() OVER (PARTITION BY doc_id, {label_sql('source')} ORDER BY call_id DESC, logged_at DESC) AS r FROM mirrors) WHERE r = 1""")
def w6_keep_last(spark, d):
    """Compaction of the call log: the last call for each post and source."""
    t = table(spark, d, "mirrors").select("doc_id", canon_label("source").alias("source"), "call_id", "retries", "logged_at")
    return keep_last(t, ["doc_id", "source"], [F.col("call_id"), F.col("logged_at")]).select("doc_id", "source", "call_id", "retries")


@query(f"""WITH {POSTS_SQL} SELECT site, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY snapshot_ts NULLS LAST, doc_id) AS r FROM posts WHERE words >= 100) WHERE r <= 12""")
def w7_cap_per_site(spark, d):
    p = posts(spark, d).where("words >= 100")
    return capped(p, ["site"], [F.col("snapshot_ts").asc_nulls_last(), F.col("doc_id")], 12).select("site", "doc_id")


@query()
def w8_greedy_near_duplicates(spark, d):
    """Order-dependent near duplicates within each source: five-word shingles, likeness 0.8 or more."""
    docs = spread(table(spark, d, "documents").select("source", "doc_id", "text")).select(F.coalesce(canon_label("source"), F.lit("-")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return greedy_near_duplicates(docs, "source", "doc_id", "text").where("NOT kept").select("source", "doc_id")


@query(f"""WITH {POSTS_SQL}, s AS (SELECT site, count(*) AS n FROM posts WHERE site IS NOT NULL GROUP BY 1),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('7|' || site), site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS b FROM s)
SELECT site, n, CASE WHEN b < 0.726 THEN 'train' WHEN b < 0.864 THEN 'val' ELSE 'test' END AS split FROM o""")
def w2_prefix_sum_split(spark, d):
    s = posts(spark, d).where("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("n"))
    order = [F.md5(F.concat(F.lit("7|"), "site")), F.col("site")]
    return prefix_sum_split(s, "n", order, (("train", 0.726), ("val", 0.864), ("test", 1.0))).select("site", "n", "split")


@query(f"""WITH {POSTS_SQL}, s AS (SELECT site, min(vertical) AS vertical, count(*) AS n FROM posts WHERE site IS NOT NULL GROUP BY 1), o AS (SELECT count(*) AS c FROM s WHERE coalesce(vertical <> 'software_saas', true)),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, site) AS r FROM s WHERE vertical = 'software_saas')
SELECT site, vertical, n FROM k, o WHERE r <= floor(0.25 / 0.75 * o.c + 1e-9) UNION ALL SELECT site, vertical, n FROM s WHERE coalesce(vertical <> 'software_saas', true)""")
def t1_quota(spark, d):
    """At most a quarter of the sites from one vertical, the largest first."""
    s = posts(spark, d).where("site IS NOT NULL").groupBy("site").agg(F.min("vertical").alias("vertical"), F.count("*").alias("n"))
    return quota(s, F.col("vertical") == "software_saas", [F.col("n").desc(), F.col("site")], 0.25).select("site", "vertical", "n")


@query("""SELECT source, doc_id, n_chars FROM (SELECT lower(trim(source)) AS source, doc_id, n_chars, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 20""")
def t2_top_n(spark, d):
    t = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), "doc_id", "n_chars")
    return capped(t, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 20)


@query("""WITH a AS (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY sum(round(value * 100)::BIGINT) DESC, user_id LIMIT 25), b AS (SELECT user_id FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 25)
SELECT count(*) AS shared, 25 AS k FROM a JOIN b USING (user_id)""")
def t3_top_k_overlap(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v")).orderBy(F.desc("v"), "user_id").limit(25)
    b = e.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("v")).orderBy(F.desc("v"), "user_id").limit(25)
    return a.select("user_id").join(b.select("user_id"), "user_id").agg(F.count("*").alias("shared")).withColumn("k", F.lit(25))


@query(f"""WITH {POSTS_SQL}, s AS (SELECT site, count(*) >= 3 AS ok FROM posts WHERE site IS NOT NULL GROUP BY 1), r AS (SELECT *, sum(ok::INT) OVER (ORDER BY site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT site, ok FROM r WHERE coalesce(before, 0) < 50""")
def t4_early_stop(spark, d):
    """Sites in order until fifty qualify."""
    s = posts(spark, d).where("site IS NOT NULL").groupBy("site").agg((F.count("*") >= 3).alias("ok"))
    return running_sums(s, [F.col("site")], {"before": F.col("ok").cast("int")}).where("before < 50").select("site", "ok")


@query("""SELECT doc_id FROM documents ORDER BY ('0x' || substr(md5('7|' || doc_id), 1, 8))::UBIGINT, doc_id LIMIT 100""")
def t5_seeded_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(draw(7, "doc_id"), "doc_id").limit(100)


@query(f"""WITH {POSTS_SQL}, c AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS t FROM posts WHERE stratum IS NOT NULL GROUP BY 1), k AS (SELECT stratum, greatest(1, round_even(300.0 * n / t, 0)) AS k FROM c),
r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || substr(md5('5|' || doc_id), 1, 8))::UBIGINT, doc_id) AS r FROM posts)
SELECT doc_id, stratum FROM r JOIN k USING (stratum) WHERE r <= k ORDER BY r, ('0x' || substr(md5('5|' || doc_id), 1, 8))::UBIGINT, doc_id LIMIT 300""")
def t6_stratified_sample(spark, d):
    """300 posts in proportion to the strata, at least one of each; what rounding adds is cut off from the last ranks."""
    p = posts(spark, d).where("stratum IS NOT NULL").select("doc_id", "stratum", draw(5, "doc_id").alias("h"))
    c = p.groupBy("stratum").agg(F.count("*").alias("n"))
    k = c.withColumn("k", F.greatest(F.lit(1), F.bround(F.lit(300.0) * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 0)))
    r = p.withColumn("r", F.row_number().over(W.partitionBy("stratum").orderBy("h", "doc_id"))).where("r <= 300")
    return r.join(F.broadcast(k), "stratum").where("r <= k").orderBy("r", "h", "doc_id").limit(300).select("doc_id", "stratum")  # a row a stratum


@query(f"""WITH {MIRRORS_SQL} SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('8|' || doc_id), 1, 8))::UBIGINT, doc_id) AS r FROM mir) WHERE r <= 50""")
def t8_sample_per_source(spark, d):
    m = mirror_texts(spark, d).select("doc_id", "source", draw(8, "doc_id").alias("h"))
    return capped(m, ["source"], [F.col("h"), F.col("doc_id")], 50).select("doc_id", "source")


_OWN = "('0x' || substr(md5('1|' || doc_id), 1, 8))::UBIGINT % 10 = 0"


@query(f"""WITH {POSTS_SQL}, p AS (SELECT doc_id, words, {_OWN} AS own FROM posts WHERE words IS NOT NULL), q AS (SELECT quantile_cont(words, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM p WHERE own),
b AS (SELECT doc_id, own, len(list_filter(q.e, lambda x: x <= words)) AS bin FROM p, q), hn AS (SELECT bin, count(*) AS n FROM b WHERE own GROUP BY 1),
r AS (SELECT doc_id, bin, row_number() OVER (PARTITION BY bin ORDER BY ('0x' || substr(md5('9|' || doc_id), 1, 8))::UBIGINT, doc_id) AS turn FROM b WHERE NOT own)
SELECT doc_id, bin, turn FROM r JOIN hn USING (bin) WHERE turn <= 5 * n""")
def t7_matched_sample(spark, d):
    """Posts matched by length to a tenth of the posts: of each of their length deciles the first five for each of them, in hash order."""
    p = posts(spark, d).where("words IS NOT NULL").select("doc_id", "words", (draw(1, "doc_id") % 10 == 0).alias("own"), draw(9, "doc_id").alias("h"))
    e = p.where("own").agg(F.percentile("words", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("e"))
    b = p.crossJoin(F.broadcast(e)).select("doc_id", "own", "h", F.size(F.filter("e", lambda x: x <= F.col("words"))).alias("bin"))  # e is one row
    hn = b.where("own").groupBy("bin").agg(F.count("*").alias("n"))
    return ranked_upto(b.where("NOT own"), ["bin"], "h", "doc_id", hn, 5 * F.col("n")).select("doc_id", "bin", F.col("rank").alias("turn"))


@query("""SELECT doc_id, k AS fraction_percent FROM (SELECT doc_id, b.k, row_number() OVER (PARTITION BY b.k ORDER BY ('0x' || substr(md5('4|' || b.k || '|' || doc_id), 1, 8))::UBIGINT, doc_id) AS r, count(*) OVER (PARTITION BY b.k) AS n FROM documents, (VALUES (25), (50), (75)) b(k)) WHERE r <= floor(k * n / 100.0)""")
def t9_fraction_subsets(spark, d):
    """A quarter, a half and three quarters of the documents, rounded down, in hash order."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (25, 50, 75)))).alias("fraction_percent")).withColumn("h", draw(4, "fraction_percent", "doc_id"))
    n = t.groupBy("fraction_percent").agg(F.count("*").alias("n"))
    return ranked_upto(t, ["fraction_percent"], "h", "doc_id", n, F.floor(F.col("fraction_percent") * F.col("n") / 100)).select("doc_id", "fraction_percent")


@query(f"""WITH a AS (SELECT {site_sql('domain')} AS s FROM site_frame), b AS (SELECT {site_sql('domain')} AS s FROM documents), c AS (SELECT {site_sql('domain')} AS s FROM splits)
SELECT 'union' AS op, count(*) AS n FROM (SELECT s FROM a UNION SELECT s FROM b UNION SELECT s FROM c) UNION ALL SELECT 'intersect', count(*) FROM (SELECT s FROM a INTERSECT SELECT s FROM b) UNION ALL
SELECT 'except', count(*) FROM (SELECT s FROM a EXCEPT SELECT s FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT s FROM a UNION ALL SELECT s FROM b UNION ALL SELECT s FROM c) UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT s FROM c)""")
def set_operations(spark, d):
    """SET1 to SET5 over the sites of three tables."""
    a, b, c = (table(spark, d, t).select(site_of("domain").alias("s")) for t in ("site_frame", "documents", "splits"))
    made = {"union": a.union(b).union(c).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.unionAll(b).unionAll(c), "distinct": c.distinct()}
    out = None
    for k, v in made.items():
        x = v.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
        out = x if out is None else out.unionAll(x)
    return out


@query(f"""SELECT doc_id, {WORDS2.format('text')} AS words, {BLANKS.format('text')} AS parts FROM documents""")
def c1_c2_word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"), T.blank_count("text").alias("parts"))


@query(f"""SELECT call_id, max(substr(sha1(concat_ws('|', doc_id, {label_sql('source')})), 1, 16)) AS key16, max(md5(text)) AS text_md5 FROM mirrors GROUP BY 1""")
def c7_c8_hash_keys(spark, d):
    return table(spark, d, "mirrors").groupBy("call_id").agg(F.max(F.substring(F.sha1(F.concat_ws("|", "doc_id", canon_label("source"))), 1, 16)).alias("key16"), F.max(F.md5("text")).alias("text_md5"))


@query(r"""SELECT doc_id, min(rtrim(lower(regexp_replace(url, '^[a-z]+://', '')), '/')) AS url_key, min(regexp_extract(rtrim(url, '/'), '[^/]*$')) AS slug,
coalesce(min(try_cast(substr(snapshot_ts, 1, 4) AS INT)), 0) AS year FROM story_human_frozen WHERE doc_id IS NOT NULL GROUP BY 1""")
def c9_c10_url_key_and_year(spark, d):
    s = table(spark, d, "story_human_frozen").where("doc_id IS NOT NULL")
    return s.groupBy("doc_id").agg(F.min(F.rtrim(F.lower(F.regexp_replace("url", "^[a-z]+://", "")), F.lit("/"))).alias("url_key"),
                                   F.min(F.substring_index(F.rtrim("url", F.lit("/")), "/", -1)).alias("slug"), F.coalesce(F.min(F.substring("snapshot_ts", 1, 4).try_cast("int")), F.lit(0)).alias("year"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')[1:30], ' ') AS head, trim(split_part(split_part(title, ' | ', 1), chr(10), 1)) AS title FROM documents""")
def c11_c12_title_and_head(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_words("text", 30).alias("head"), F.trim(F.substring_index(F.substring_index("title", " | ", 1), "\n", 1)).alias("title"))


@query("""SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::INT)::BIGINT AS k, count(DISTINCT json_extract(props, '$.k')::INT) AS values_seen FROM events GROUP BY 1""")
def c13_json_fields(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).cast("long").alias("k"), F.count_distinct(k).alias("values_seen"))


@query(f"""SELECT {site_sql('domain')} AS site, string_agg(DISTINCT {label_sql('stratum')}, '+' ORDER BY {label_sql('stratum')}) AS strata, count(DISTINCT {vertical_sql('vertical')}) AS verticals FROM site_frame WHERE {site_sql('domain')} IS NOT NULL GROUP BY 1""")
def a4_set_strings(spark, d):
    t = table(spark, d, "site_frame").select(site_of("domain").alias("site"), canon_label("stratum").alias("s"), canon_vertical("vertical").alias("v")).where("site IS NOT NULL")
    return t.groupBy("site").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("s")), "+"), F.lit("")).alias("strata"), F.count_distinct("v").alias("verticals"))


@query(f"""WITH {POSTS_SQL} SELECT vertical, string_agg(title, ' | ' ORDER BY doc_id) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY doc_id) AS r FROM posts WHERE title IS NOT NULL) WHERE r <= 3 GROUP BY 1""")
def a5_first_titles(spark, d):
    p = capped(posts(spark, d).where("title IS NOT NULL").select("vertical", "doc_id", "title"), ["vertical"], [F.col("doc_id")], 3)
    return p.groupBy("vertical").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "title"))), lambda x: x.title), " | ").alias("titles"))


@query(f"SELECT doc_id, length(x) AS n_chars, md5(x) AS text_md5 FROM (SELECT doc_id, {T.strip_markdown_sql('text')} AS x FROM documents)")
def x1_strip_markdown(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", T.strip_markdown("text").alias("x")).select("doc_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("text_md5"))


@query(f"SELECT doc_id, length(text) AS before, length(x) AS after, md5(x) AS text_md5 FROM (SELECT doc_id, text, {T.normalised_sql('text')} AS x FROM documents)")
def x3_normalised_texts(spark, d):
    """Markdown and page furniture removed, blanks collapsed: hash and length before and after, of every document."""
    t = table(spark, d, "documents").select("doc_id", F.length("text").alias("before"), T.normalised("text").alias("x"))
    return t.select("doc_id", "before", F.length("x").alias("after"), F.md5("x").alias("text_md5"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[^ \t\r\f]+')) <= 9 AND regexp_matches(x, '{T.FURNITURE}')) AS f FROM documents WHERE text IS NOT NULL)
SELECT len(f) AS dropped_lines, count(*) AS n FROM l GROUP BY 1""")
def x2_furniture_lines(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: (F.regexp_count(x, F.lit(r"[^ \t\r\f]+")) <= 9) & x.rlike(T.FURNITURE))
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.size(lines).alias("dropped_lines")).groupBy("dropped_lines").agg(F.count("*").alias("n"))


@query(rf"""WITH {MIRRORS_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?m)^[ \t]{{0,3}}#{{1,6}}[ \t]')) AS headings, count(*) FILTER (WHERE regexp_matches(text, '\*\*[^*\n]+\*\*')) AS bold FROM mir GROUP BY 1""")
def x4_marker_audit(spark, d):
    return mirror_texts(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"(?m)^[ \t]{0,3}#{1,6}[ \t]")).alias("headings"), F.count_if(F.col("text").rlike(r"\*\*[^*\n]+\*\*")).alias("bold"))


@query(f"""SELECT found, coalesce(nullif(lower(substr(trim(lang), 1, 2)), ''), '-') AS given, count(*) AS n FROM (SELECT lang, {lang_sql('text')} AS found FROM documents) GROUP BY 1, 2""")
def x5_language_id(spark, d):
    t = spread(table(spark, d, "documents").select("lang", "text")).select("lang", T.language(T.language_votes("text")).alias("found"))
    return t.groupBy("found", F.coalesce(F.nullif(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("")), F.lit("-")).alias("given")).agg(F.count("*").alias("n"))


_GENRE = r"lower(title || ' ' || replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '-', ' '))"


@query(f"""SELECT CASE WHEN regexp_matches({_GENRE}, 'version|changed|release|announc') THEN 'news' WHEN regexp_matches({_GENRE}, 'how to|mistake|example|checklist|question|lesson|planning|choosing') THEN 'informational' ELSE 'unknown' END AS genre, count(*) AS n
FROM story_human_frozen WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY 1""")
def x6_title_genre(spark, d):
    x = F.lower(F.concat("title", F.lit(" "), F.replace(F.substring_index(F.rtrim("url", F.lit("/")), "/", -1), F.lit("-"), F.lit(" "))))
    g = F.when(x.rlike("version|changed|release|announc"), "news").when(x.rlike("how to|mistake|example|checklist|question|lesson|planning|choosing"), "informational").otherwise("unknown")
    return table(spark, d, "story_human_frozen").where("title IS NOT NULL AND url IS NOT NULL").groupBy(g.alias("genre")).agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT call_id, min({TOKENS.format('original_text')}) AS o, min({TOKENS.format('rewritten_text')}) AS w FROM rewrites WHERE original_text IS NOT NULL AND rewritten_text IS NOT NULL GROUP BY 1),
g AS (SELECT call_id, {grams_sql('o', 5)} AS go, {grams_sql('w', 5)} AS gw FROM r) SELECT call_id, round(len(list_intersect(go, gw))::DOUBLE / greatest(len(list_distinct(list_concat(go, gw))), 1), 6) AS jaccard FROM g""")
def x7_shingle_jaccard(spark, d):
    """Likeness of a rewording and its original by five-word shingles, over whole texts."""
    r = table(spark, d, "rewrites").where("original_text IS NOT NULL AND rewritten_text IS NOT NULL")
    r = r.groupBy("call_id").agg(F.min(T.words("original_text")).alias("o"), F.min(T.words("rewritten_text")).alias("w"))
    g = r.select("call_id", T.ngrams(F.col("o"), 5).alias("go"), T.ngrams(F.col("w"), 5).alias("gw"))
    shared = F.size(F.array_intersect("go", "gw"))
    return g.select("call_id", r6(shared / F.greatest(F.size("go") + F.size("gw") - shared, F.lit(1))).alias("jaccard"))


@query(f"""WITH r AS (SELECT call_id, min({label_sql('source')}) AS source, min({TOKENS.format('original_text')}) AS o, min({TOKENS.format('rewritten_text')}) AS w FROM rewrites WHERE original_text IS NOT NULL AND rewritten_text IS NOT NULL GROUP BY 1),
g AS (SELECT source, {grams_sql('o', 8)} AS o8, {grams_sql('w', 8)} AS w8, {grams_sql('o', 30)} AS o30, {grams_sql('w', 30)} AS w30 FROM r), s AS (SELECT source, len(list_intersect(o8, w8)) AS s, len(o8) AS a, len(w8) AS b, list_has_any(o30, w30) AS span FROM g)
SELECT source, count(*) AS n, count(*) FILTER (WHERE span AND s >= 4 AND greatest(s::DOUBLE / greatest(a, 1), s::DOUBLE / greatest(b, 1)) >= 0.05) AS near_verbatim FROM s GROUP BY 1""")
def x9_near_verbatim(spark, d):
    """Shared 8-grams cover at least 5 % of one side, at least four of them, and thirty words in a row are shared."""
    r = table(spark, d, "rewrites").where("original_text IS NOT NULL AND rewritten_text IS NOT NULL")
    r = r.groupBy("call_id").agg(F.min(canon_label("source")).alias("source"), F.min(T.words("original_text")).alias("o"), F.min(T.words("rewritten_text")).alias("w"))
    g = r.select("source", *[T.ngrams(F.col(c), n).alias(f"{c}{n}") for c in "ow" for n in (8, 30)])
    s = F.size(F.array_intersect("o8", "w8"))
    cover = F.greatest(s / F.greatest(F.size("o8"), F.lit(1)), s / F.greatest(F.size("w8"), F.lit(1)))
    return g.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("o30", "w30") & (s >= 4) & (cover >= 0.05)).alias("near_verbatim"))


_V = "len(regexp_extract_all(lower(text), '[aeiouyäöüáéíóúàèêâîôû]+'))"
_STY = f"""WITH t AS (SELECT doc_id, text, {TOKENS.format('text')} AS w, len(regexp_extract_all(text, '[.!?]+(?:[ \\t\\r\\n]|$)')) AS s, {_V} AS syl FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, len(w) AS n, len(list_distinct(w)) AS v, list_sum(list_transform(w, lambda x: length(x))) AS chars FROM t)
SELECT doc_id, n AS n_words, s AS n_sentences, round(v::DOUBLE / n, 6) AS type_token, round(chars::DOUBLE / n, 6) AS word_length, round(n::DOUBLE / greatest(s, 1), 6) AS sentence_length, round(v / sqrt(n), 6) AS root_ttr,
round(206.835 - 1.015 * n / greatest(s, 1) - 84.6 * syl / n + 1e-7, 4) AS flesch, round(0.39 * n / greatest(s, 1) + 11.8 * syl / n - 15.59 + 1e-7, 4) AS grade, round(4.71 * chars / n + 0.5 * n / greatest(s, 1) - 21.43 + 1e-7, 4) AS ari,
round(len(regexp_extract_all(text, ','))::DOUBLE / n, 6) AS commas, round(len(regexp_extract_all(text, '[?]'))::DOUBLE / n, 6) AS questions, round(len(list_filter(w, lambda x: length(x) >= 7))::DOUBLE / n, 6) AS long_words FROM h WHERE n > 0"""


@query(_STY)
def x11_stylometry(spark, d):
    """Length, vocabulary, punctuation and readability measures of each document."""
    t = spread(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")).select("doc_id", "text", T.words("text").alias("w"), T.sentence_count("text").alias("s"), T.syllables("text").alias("syl"))
    t = t.select("*", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("v"), F.length(F.array_join("w", "")).alias("chars")).where("n > 0")
    n, s, syl, chars = F.col("n"), F.greatest("s", F.lit(1)), F.col("syl"), F.col("chars")
    return t.select("doc_id", n.alias("n_words"), F.col("s").alias("n_sentences"), r6(F.col("v") / n).alias("type_token"), r6(chars / n).alias("word_length"), r6(n / s).alias("sentence_length"), r6(F.col("v") / F.sqrt(n)).alias("root_ttr"),
                    F.round(206.835 - 1.015 * n / s - 84.6 * syl / n + 1e-7, 4).alias("flesch"), F.round(0.39 * n / s + 11.8 * syl / n - 15.59 + 1e-7, 4).alias("grade"), F.round(4.71 * chars / n + 0.5 * n / s - 21.43 + 1e-7, 4).alias("ari"),
                    r6(F.regexp_count("text", F.lit(",")) / n).alias("commas"), r6(F.regexp_count("text", F.lit("[?]")) / n).alias("questions"), r6(F.size(F.filter("w", lambda x: F.length(x) >= 7)) / n).alias("long_words"))


@query(style_sql())
def x11_style_vector(spark, d):
    """The full style vector of 144 measures of every document."""
    v = style_vector(spread(table(spark, d, "documents").select("doc_id", "text")))
    return v.select("doc_id", *[F.round(F.col(m) + 1e-9, 5).alias(m) for m in MEASURES])


_TFIDF = f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS w FROM t),
tf AS (SELECT doc_id, w, count(*) AS c FROM g GROUP BY 1, 2), df AS (SELECT w, count(*) AS d FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, w, (1 + ln(c)) * (ln((1 + n.n) / (1.0 + d)) + 1) AS x FROM tf JOIN df USING (w), n WHERE d >= 3)"""


@query(_TFIDF + " SELECT doc_id, count(*) AS terms, round(sqrt(sum(x * x)), 5) AS length, arg_max(w, (round(x, 6), w)) AS top_term, round(max(x) / sqrt(sum(x * x)), 5) AS top_weight FROM x GROUP BY 1")
def x14_tfidf(spark, d):
    """TF-IDF over all words and pairs of words in at least three documents: size, length before scaling, and heaviest term of each document's unit vector."""
    x = tfidf(spread(table(spark, d, "documents").select("doc_id", "text")))
    return x.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.first("length"), 5).alias("length"), F.max_by("term", F.struct(F.round(F.col("weight") * F.col("length"), 6), "term")).alias("top_term"), F.round(F.max("weight"), 5).alias("top_weight"))


@query(f"""WITH c AS (SELECT DISTINCT {site_sql('domain')} AS site, regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(company, '[.''’]', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '(?: (?:{'|'.join(LEGAL_FORMS)}))+$', ''), ' ', '', 'g') AS k FROM site_frame)
SELECT k AS company, count(*) AS sites FROM c WHERE k <> '' AND site IS NOT NULL GROUP BY 1""")
def l12_company_sites(spark, d):
    """Name to sites: how many sites each company has, names alike but for case, punctuation and legal form."""
    c = table(spark, d, "site_frame").select(site_of("domain").alias("site"), company_key("company").alias("company")).where("site IS NOT NULL AND company IS NOT NULL").distinct()
    return c.groupBy("company").agg(F.count("*").alias("sites"))
