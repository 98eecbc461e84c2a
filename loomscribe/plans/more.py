"""Smaller operators of the inventory: guards, lookups, canonical forms, annotation work-lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscribe.functions import text as T
from loomscribe.functions.hashing import draw
from loomscribe.operators import annotate as N
from loomscribe.operators import metrics as M
from loomscribe.operators.relational import capped
from loomscribe.plans import corpus, learning
from loomscribe.plans.base import ENCODED_SQL, FEATURES, ORACLE, POSTS_SQL, canon_label, encoded, label_sql, posts, predicted, query, r6, site_of, site_sql, table
from loomscribe.plans.corpus import BLANKS, TOKENS, grams_sql
from loomscribe.plans.stats import _VOTES, _f1_sql, votes
from loomscribe.runtime import spread

_SEASON = "CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m <= 5 THEN 'Spring' WHEN m <= 8 THEN 'Summer' ELSE 'Fall' END"


@query(f"""WITH {POSTS_SQL}, s AS (SELECT substr(snapshot_ts, 1, 4)::INT AS y, substr(snapshot_ts, 5, 2)::INT AS m FROM posts WHERE snapshot_ts IS NOT NULL), b AS (SELECT {_SEASON} || ' ' || y AS batch, y, m FROM s)
SELECT batch, count(*) AS n, bool_and(regexp_extract(batch, '[0-9]+')::INT * 4 + CASE split_part(batch, ' ', 1) WHEN 'Winter' THEN 0 WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 ELSE 3 END <= 2022 * 4) AS in_time FROM b GROUP BY 1""")
def f6_batch_guard(spark, d):
    """Batches named by season and year, and whether they are not later than Winter 2022."""
    p = posts(spark, d).where("snapshot_ts IS NOT NULL").select(F.substring("snapshot_ts", 1, 4).cast("int").alias("y"), F.substring("snapshot_ts", 5, 2).cast("int").alias("m"))
    season = F.when(F.col("m").isin(12, 1, 2), "Winter").when(F.col("m") <= 5, "Spring").when(F.col("m") <= 8, "Summer").otherwise("Fall")
    b = p.select(F.concat_ws(" ", season, F.col("y").cast("string")).alias("batch"))
    place = F.array_position(F.array(*map(F.lit, ("Winter", "Spring", "Summer", "Fall"))), F.split("batch", " ")[0]) - 1
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.bool_and(F.regexp_extract("batch", "[0-9]+", 0).cast("int") * 4 + place <= 2022 * 4).alias("in_time"))


@query(f"WITH {ENCODED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS col, count({c}) AS given FROM enc" for c in FEATURES if c[:3] in ("f01", "f03", "f05")))
def f15_f16_column_selection(spark, d):
    """Columns chosen by a pattern on their names."""
    chosen = encoded(spark, d).select(encoded(spark, d).colRegex("`f0[135]__.*`"))
    one = chosen.agg(*[F.count(c).alias(c) for c in chosen.columns])
    return one.unpivot([], chosen.columns, "col", "given")


_GIVEN = " + ".join(f"({c} IS NOT NULL)::INT" for c in FEATURES)


@query(f"""WITH {ENCODED_SQL}, g AS (SELECT doc_id, source, {_GIVEN} AS k FROM enc), h AS (SELECT doc_id, k AS h FROM g WHERE source = 'human')
SELECT source, count(*) AS n, count(*) FILTER (WHERE k >= 0.95 * h) AS fully_scored FROM g JOIN h USING (doc_id) WHERE source <> 'human' GROUP BY 1""")
def f21_fully_scored(spark, d):
    """Machine texts with at least 95 % of the answers that the human text of the post has."""
    k = sum((F.col(c).isNotNull().cast("int") for c in FEATURES[1:]), F.col(FEATURES[0]).isNotNull().cast("int"))
    g = encoded(spark, d).select("doc_id", "source", k.alias("k"))
    h = g.where("source = 'human'").select("doc_id", F.col("k").alias("h"))
    return g.where("source <> 'human'").join(h, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("k") >= 0.95 * F.col("h")).alias("fully_scored"))


@query(f"""WITH f AS (SELECT {site_sql('domain')} AS site, min({label_sql('stratum')}) AS s FROM site_frame WHERE {site_sql('domain')} IS NOT NULL GROUP BY 1)
SELECT coalesce(s, '-') AS stratum, count(*) AS n FROM (SELECT {site_sql('domain')} AS site FROM documents) d LEFT JOIN f USING (site) GROUP BY 1""")
def j5_left_outer(spark, d):
    f = table(spark, d, "site_frame").select(site_of("domain").alias("site"), canon_label("stratum").alias("s")).where("site IS NOT NULL").groupBy("site").agg(F.min("s").alias("s"))
    return table(spark, d, "documents").select(site_of("domain").alias("site")).join(f, "site", "left").groupBy(F.coalesce("s", F.lit("-")).alias("stratum")).agg(F.count("*").alias("n"))


@query(f"WITH {ENCODED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS dim, count(*) AS work, count(*) - count({c}) AS todo FROM enc" for c in FEATURES))
def j10_work_list(spark, d):
    """Texts times questions, and how many of them have no answer yet."""
    e = encoded(spark, d).select(*FEATURES)
    w = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("v")) for c in FEATURES])).alias("x")).select("x.*")
    return w.groupBy("dim").agg(F.count("*").alias("work"), F.count_if(F.col("v").isNull()).alias("todo"))


@query(f"""WITH {ENCODED_SQL}, b AS (SELECT *, ('0x' || substr(md5('31|' || doc_id), 1, 8))::UBIGINT % 5 AS bin FROM pred), {_f1_sql('b', 'label_ai', 'p1', 'bin')}, m AS (SELECT bin, avg(f1) AS f FROM f GROUP BY 1)
SELECT count(*) AS runs, round(avg(f), 6) AS mean, round(max(f) - min(f), 6) AS spread FROM m""")
def a17_run_spread(spark, d):
    """Mean and range of macro-F1 over five hash subsets."""
    b = predicted(spark, d).withColumn("bin", draw(31, "doc_id") % 5)
    return M.macro_f1(b, "label_ai", "p1", ["bin"]).agg(F.count("*").alias("runs"), r6(F.avg("macro_f1")).alias("mean"), r6(F.max("macro_f1") - F.min("macro_f1")).alias("spread"))


_FIELDS = ("company", "vertical", "region", "stratum", "industry_raw", "employees", "country", "source_ref")


@query(f"""SELECT coalesce({label_sql('stratum')}, '-') AS stratum, count(*) AS n, round(avg(({' + '.join(f"(nullif(trim({c}), '') IS NOT NULL)::INT" for c in _FIELDS)}) / {len(_FIELDS)}.0), 6) AS completeness FROM site_frame GROUP BY 1""")
def m22_completeness(spark, d):
    has = [F.nullif(F.trim(c), F.lit("")).isNotNull().cast("int") for c in _FIELDS]
    share = sum(has[1:], has[0]) / len(_FIELDS)
    return table(spark, d, "site_frame").groupBy(F.coalesce(canon_label("stratum"), F.lit("-")).alias("stratum")).agg(F.count("*").alias("n"), r6(F.avg(share)).alias("completeness"))


@query(f"""WITH {POSTS_SQL} SELECT vertical, count(*) AS n, count(*) FILTER (WHERE lower(title) = lower(trim(split_part(text, chr(10), 1))) OR contains(lower(text), lower(title))) AS soft_agree FROM posts WHERE title IS NOT NULL AND text IS NOT NULL GROUP BY 1""")
def m22_soft_agreement(spark, d):
    """Titles that equal or stand inside the text."""
    p = posts(spark, d).where("title IS NOT NULL AND text IS NOT NULL")
    return p.groupBy("vertical").agg(F.count("*").alias("n"), F.count_if((F.lower("title") == F.lower(F.trim(F.substring_index("text", "\n", 1)))) | F.contains(F.lower("text"), F.lower("title"))).alias("soft_agree"))


@query(f"""WITH {POSTS_SQL}, r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || substr(md5('6|' || doc_id), 1, 8))::UBIGINT, doc_id) AS turn FROM posts WHERE stratum IS NOT NULL)
SELECT doc_id, stratum, turn FROM r ORDER BY turn, stratum LIMIT 40""")
def w10_round_robin(spark, d):
    """Forty posts, one of each stratum in turn."""
    from pyspark.sql.window import Window as W

    p = posts(spark, d).where("stratum IS NOT NULL").select("doc_id", "stratum", draw(6, "doc_id").alias("h"))
    first = capped(p, ["stratum"], [F.col("h"), F.col("doc_id")], 40)
    return first.select("doc_id", "stratum", F.row_number().over(W.partitionBy("stratum").orderBy("h", "doc_id")).alias("turn")).orderBy("turn", "stratum").limit(40)


@query(f"""WITH {_VOTES} SELECT doc_id, string_agg(DISTINCT verdict, '|' ORDER BY verdict) AS canonical FROM v GROUP BY 1""")
def c3_canonical_answer(spark, d):
    """All answers of a document, lower case, sorted, joined by |."""
    return votes(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("verdict")), "|").alias("canonical"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(title, '[–—]', '-', 'g'), '[ \t\r\n]+', ' ', 'g')) AS title FROM documents""")
def c5_dashes_and_blanks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.regexp_replace("title", "[–—]", "-"), r"[ \t\r\n]+", " ")).alias("title"))


@query(f"""WITH {POSTS_SQL} SELECT greatest(round_even(words / 100.0, 0) * 100, 100)::INT AS rounded, count(*) AS n FROM posts WHERE words IS NOT NULL GROUP BY 1""")
def c6_round_to_hundred(spark, d):
    p = posts(spark, d).where("words IS NOT NULL")
    return p.groupBy(F.greatest(F.bround(F.col("words") / 100.0, 0) * 100, F.lit(100)).cast("int").alias("rounded")).agg(F.count("*").alias("n"))


@query(f"""WITH {ENCODED_SQL}, l AS (UNPIVOT (SELECT {', '.join(FEATURES)} FROM enc) ON {', '.join(FEATURES)} INTO NAME col VALUE v) SELECT split_part(col, '__', 1) AS feature, string_agg(DISTINCT split_part(col, '__', 2), '|' ORDER BY split_part(col, '__', 2)) AS menu, count(*) AS answers FROM l GROUP BY 1""")
def c14_c18_menus_from_names(spark, d):
    """Features and their values, read off the encoded columns."""
    l = learning.long_form(spark, d).withColumn("p", F.split("col", "__", 2))
    return l.groupBy(F.col("p")[0].alias("feature")).agg(F.array_join(F.array_sort(F.collect_set(F.col("p")[1])), "|").alias("menu"), F.count("*").alias("answers"))


@query(f"""WITH {_VOTES} SELECT CASE verdict WHEN 'ok' THEN 0 WHEN 'unsure' THEN 1 WHEN 'abusive' THEN 2 WHEN 'hateful' THEN 3 END AS place, count(*) AS n FROM v GROUP BY 1""")
def c15_ordinal_position(spark, d):
    """The position of a verdict in a menu; one outside it has none."""
    menu = F.array(*map(F.lit, ("ok", "unsure", "abusive", "hateful")))
    return votes(spark, d).groupBy((F.nullif(F.array_position(menu, F.col("verdict")), F.lit(0)) - 1).cast("int").alias("place")).agg(F.count("*").alias("n"))


@query(f"""WITH {POSTS_SQL} SELECT doc_id, md5('Write ' || greatest(round_even(words / 100.0, 0) * 100, 100)::INT || ' words for ' || coalesce(site, '?') || ': ' || coalesce(title, '-')) AS prompt_md5 FROM posts WHERE words IS NOT NULL""")
def c17_rendered_prompts(spark, d):
    n = F.greatest(F.bround(F.col("words") / 100.0, 0) * 100, F.lit(100)).cast("int")
    p = posts(spark, d).where("words IS NOT NULL")
    return p.select("doc_id", F.md5(F.format_string("Write %d words for %s: %s", n, F.coalesce("site", F.lit("?")), F.coalesce("title", F.lit("-")))).alias("prompt_md5"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len({grams_sql('t', 8)}) AS grams_8, len({grams_sql('t', 13)}) AS grams_13 FROM t""")
def x8_distinct_ngrams(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.words("text").alias("t"))
    return t.select("doc_id", F.size(T.ngrams(F.col("t"), 8)).alias("grams_8"), F.size(T.ngrams(F.col("t"), 13)).alias("grams_13"))


@query(f"WITH a AS ({ORACLE['j7_ngram_containment']}), b AS ({ORACLE['j8_shuffled_control']}) SELECT a.source, a.pairs, a.hits, b.hits AS control_hits, round(a.hits::DOUBLE / a.pairs, 6) AS rate FROM a JOIN b USING (source)")
def x15_memorisation(spark, d):
    """Mirrors that repeat their post, against the same for another post."""
    a = corpus.j7_ngram_containment(spark, d)
    b = corpus.j8_shuffled_control(spark, d).select("source", F.col("hits").alias("control_hits"))
    return a.join(b, "source").select("source", "pairs", "hits", "control_hits", r6(F.col("hits") / F.col("pairs")).alias("rate"))


@query(f"""WITH r AS (SELECT call_id, min(lower(trim(model))) AS model, min({BLANKS.format('original_text')}) AS o, min({BLANKS.format('rewritten_text')}) AS w FROM rewrites WHERE rewritten_text IS NOT NULL AND original_text IS NOT NULL GROUP BY 1)
SELECT model, count(*) AS n, round(avg(w::DOUBLE / greatest(o, 1)), 6) AS mean_ratio, round(quantile_cont(w::DOUBLE / greatest(o, 1), 0.5), 6) AS median_ratio, count(*) FILTER (WHERE w < 0.6 * o) AS short FROM r GROUP BY 1""")
def x16_attack_magnitude(spark, d):
    r = table(spark, d, "rewrites").where("rewritten_text IS NOT NULL AND original_text IS NOT NULL").groupBy("call_id").agg(
        F.min(F.lower(F.trim("model"))).alias("model"), F.min(T.blank_count("original_text")).alias("o"), F.min(T.blank_count("rewritten_text")).alias("w"))
    x = F.col("w") / F.greatest("o", F.lit(1))
    return r.groupBy("model").agg(F.count("*").alias("n"), r6(F.avg(x)).alias("mean_ratio"), r6(F.percentile(x, F.lit(0.5))).alias("median_ratio"), F.count_if(F.col("w") < 0.6 * F.col("o")).alias("short"))


@query(f"WITH g AS ({ORACLE['ml8_core_rule']}) SELECT count(*) FILTER (WHERE core) AS n_core, round(coalesce(sum(abs(gap)) FILTER (WHERE core), 0) / sum(abs(gap)), 5) AS core_share FROM g")
def ml10_core_share(spark, d):
    """Share of all gaps that core columns have."""
    g = learning.ml8_core_rule(spark, d)
    return g.agg(F.count_if("core").alias("n_core"), F.round(F.coalesce(F.sum(F.when(F.col("core"), F.abs("gap"))), F.lit(0.0)) / F.sum(F.abs("gap")), 5).alias("core_share"))


@query(f"WITH {ENCODED_SQL} SELECT count(*) AS n, bool_and(label_ai IN (0, 1)) AS labels_ok, count(*) = count(DISTINCT (doc_id, source)) AS keys_ok FROM enc")
def ml19_parity_assertion(spark, d):
    """What later steps rely on; assert_true fails the job where it does not hold."""
    e = encoded(spark, d)
    got = e.agg(F.count("*").alias("n"), F.bool_and(F.col("label_ai").isin(0, 1)).alias("labels_ok"), (F.count("*") == F.count_distinct("doc_id", F.coalesce("source", F.lit("")))).alias("keys_ok"))
    return got.where(F.assert_true(F.col("labels_ok") & F.col("keys_ok"), "labels or keys are broken").isNull())


@query(f"""SELECT answer, count(*) AS n FROM (SELECT CASE WHEN k = 0 THEN 'empty' WHEN k < 80 THEN 'short' WHEN k < 400 THEN 'medium' ELSE 'long' END AS answer FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n\f\x0b]+')) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM review_labels WHERE {label_sql('verdict')} IS NOT NULL AND doc_id IS NOT NULL))) GROUP BY 1""")
def l9_annotation_resume(spark, d):
    """Documents without a verdict, annotated by a rule in place of a model."""
    log = votes(spark, d).select("doc_id", F.col("verdict").alias("answer"))
    work = N.open_work(table(spark, d, "documents").select("doc_id", "text"), log, ["doc_id"])
    return N.annotate(work, ["doc_id"], "text", N.by_length).groupBy("answer").agg(F.count("*").alias("n"))


@query(f"""WITH {_VOTES} SELECT 'strict' AS rule, count(*) FILTER (WHERE a) AS kept, count(*) AS n FROM (SELECT bool_and(verdict = 'ok') AS a FROM v GROUP BY doc_id) UNION ALL SELECT 'inclusive', count(*) FILTER (WHERE a), count(*) FROM (SELECT bool_or(verdict = 'ok') AS a FROM v GROUP BY doc_id)""")
def l1_l7_two_votes(spark, d):
    v = votes(spark, d).select("doc_id", (F.col("verdict") == "ok").alias("keep"))
    one = lambda rule, strict: N.two_votes(v, ["doc_id"], strict).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "kept", "n")
    return one("strict", True).unionAll(one("inclusive", False))
