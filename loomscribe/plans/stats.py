"""Aggregates, agreement, classification and test statistics, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions import text as T
from loomscribe.functions.hashing import draw
from loomscribe.operators import metrics as M
from loomscribe.operators.relational import average_rank, keep_one, running_sums
from loomscribe.operators.resample import binary_macro_f1, bootstrap_counts, unit_counts
from loomscribe.plans.base import (ENCODED_SQL, FEATURES, MIRRORS_SQL, POSTS_SQL, canon_label, encoded, label_sql, mirror_texts, posts, predicted, query, r6, site_of, site_sql, table)
from loomscribe.plans.corpus import BLANKS, doc_splits

H = "('0x' || substr(md5({0}), 1, 8))::UBIGINT"


@query(f"SELECT {label_sql('source')} AS source, count(*) AS n FROM mirrors GROUP BY 1")
def a1_group_count(spark, d):
    return table(spark, d, "mirrors").groupBy(canon_label("source").alias("source")).agg(F.count("*").alias("n"))


@query(f"""SELECT {label_sql('source')} AS source, round(avg(words), 6) AS mean_words, max(words) AS max_words, sum(in_tokens)::BIGINT AS in_tokens, round(avg(latency_s), 6) AS latency FROM mirrors GROUP BY 1""")
def a2_group_means(spark, d):
    return table(spark, d, "mirrors").groupBy(canon_label("source").alias("source")).agg(r6(F.avg("words")).alias("mean_words"), F.max("words").alias("max_words"), F.sum("in_tokens").alias("in_tokens"), r6(F.avg("latency_s")).alias("latency"))


@query(f"""SELECT {label_sql('source')} AS source, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS failed, round(avg((text IS NULL)::INT), 6) AS failed_share, count(*) FILTER (WHERE retries > 0) AS retried FROM mirrors GROUP BY 1""")
def a3_conditional_shares(spark, d):
    return table(spark, d, "mirrors").groupBy(canon_label("source").alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("failed"), r6(F.avg(F.col("text").isNull().cast("int"))).alias("failed_share"), F.count_if(F.col("retries") > 0).alias("retried"))


@query(f"WITH {ENCODED_SQL}, m AS (SELECT doc_id, arg_max(source, (score, source)) AS top FROM pred GROUP BY 1) SELECT top, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1")
def a6_argmax_source(spark, d):
    """Which source has the highest score of its post, ties to the later name."""
    top = predicted(spark, d).groupBy("doc_id").agg(F.max_by("source", F.struct("score", "source")).alias("top"))
    return top.groupBy("top").agg(F.count("*").alias("n")).select("top", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


_VOTES = f"v AS (SELECT doc_id, rater, {label_sql('verdict')} AS verdict, labelled_at FROM review_labels WHERE doc_id IS NOT NULL AND {label_sql('verdict')} IS NOT NULL)"


def votes(spark, d):
    return table(spark, d, "review_labels").select("doc_id", "rater", canon_label("verdict").alias("verdict"), "labelled_at").where("doc_id IS NOT NULL AND verdict IS NOT NULL")


@query(f"""WITH {_VOTES}, c AS (SELECT doc_id, verdict, count(*) AS n, min(labelled_at) AS t FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t, verdict) AS r FROM c)
SELECT doc_id, verdict, n FROM r WHERE r = 1""")
def a7_majority_verdict(spark, d):
    c = votes(spark, d).groupBy("doc_id", "verdict").agg(F.count("*").alias("n"), F.min("labelled_at").alias("t"))
    return keep_one(c, ["doc_id"], [-F.col("n"), F.col("t"), F.col("verdict")]).select("doc_id", "verdict", "n")


@query(f"""WITH {_VOTES}, u AS (SELECT doc_id, count(*) AS n, count(DISTINCT verdict) AS k, bool_or(verdict = 'ok') AS any_ok, bool_and(verdict = 'ok') AS all_ok FROM v GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (WHERE n >= 2) AS rated_twice, round(avg((k = 1)::INT) FILTER (WHERE n >= 2), 6) AS unanimous, count(*) FILTER (WHERE any_ok) AS kept_by_any, count(*) FILTER (WHERE all_ok) AS kept_by_all FROM u""")
def a8_a9_unanimity_and_votes(spark, d):
    u = votes(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("verdict").alias("k"), F.bool_or(F.col("verdict") == "ok").alias("any_ok"), F.bool_and(F.col("verdict") == "ok").alias("all_ok"))
    return u.agg(F.count("*").alias("documents"), F.count_if(F.col("n") >= 2).alias("rated_twice"), r6(F.avg(F.when(F.col("n") >= 2, (F.col("k") == 1).cast("int")))).alias("unanimous"), F.count_if("any_ok").alias("kept_by_any"), F.count_if("all_ok").alias("kept_by_all"))


@query(f"""SELECT {label_sql('source')} AS source, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(quantile_cont(words, 0.25), 6) AS w25 FROM mirrors GROUP BY 1""")
def a10_quantiles(spark, d):
    return table(spark, d, "mirrors").groupBy(canon_label("source").alias("source")).agg(r6(F.percentile("latency_s", F.lit(0.5))).alias("p50"), r6(F.percentile("latency_s", F.lit(0.95))).alias("p95"), r6(F.percentile("words", F.lit(0.25))).alias("w25"))


@query(f"""WITH c AS (SELECT {label_sql('source')} AS source, words AS v, count(*) AS c FROM mirrors WHERE words IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY v) AS upto, sum(c) OVER (PARTITION BY source) AS n FROM c)
SELECT source, min(v) FILTER (WHERE upto > least(n - 1, floor(0.95 * n))) AS q95 FROM r GROUP BY 1""")
def a11_floor_quantile(spark, d):
    """The value at index floor(0.95 n), from counts of distinct values, so that no list of a group is built."""
    c = table(spark, d, "mirrors").where("words IS NOT NULL").groupBy(canon_label("source").alias("source"), F.col("words").alias("v")).agg(F.count("*").alias("c"))
    w = W.partitionBy("source")
    r = c.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    return r.where(F.col("upto") > F.least(F.col("n") - 1, F.floor(0.95 * F.col("n")))).groupBy("source").agg(F.min("v").alias("q95"))


_Z = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS sd, round(corr({c}, label_ai), 6) AS r FROM enc" for c in FEATURES)


@query(f"WITH {ENCODED_SQL} {_Z}")
def a12_a13_feature_moments(spark, d):
    """Mean, population deviation (1 where it is 0) and correlation with the label, of each feature, in one pass."""
    e = encoded(spark, d)
    sd = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    one = e.agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(sd(c)).alias("sd"), r6(F.corr(c, "label_ai")).alias("r")).alias(c) for c in FEATURES])
    return one.select(F.explode(F.array(*FEATURES)).alias("x")).select("x.*")


@query(f"""WITH {ENCODED_SQL}, g AS (SELECT avg(score) FILTER (WHERE label_ai = 0) AS h, avg(score) FILTER (WHERE label_ai = 1) AS a, stddev_pop(score) FILTER (WHERE label_ai = 0) AS sh, stddev_pop(score) FILTER (WHERE label_ai = 1) AS sa,
stddev_samp(score) FILTER (WHERE label_ai = 0) AS th, stddev_samp(score) FILTER (WHERE label_ai = 1) AS ta FROM pred) SELECT round(h, 6) AS human, round(a, 6) AS ai, round((a - h) / sqrt((sh * sh + sa * sa) / 2), 6) AS d_population, round((a - h) / sqrt((th * th + ta * ta) / 2), 6) AS d_sample FROM g""")
def a14_cohens_d(spark, d):
    x = lambda k: F.when(F.col("label_ai") == k, F.col("score"))
    g = predicted(spark, d).agg(F.avg(x(0)).alias("h"), F.avg(x(1)).alias("a"), F.stddev_pop(x(0)).alias("sh"), F.stddev_pop(x(1)).alias("sa"), F.stddev_samp(x(0)).alias("th"), F.stddev_samp(x(1)).alias("ta"))
    pooled = lambda p, q: F.sqrt((F.col(p) * F.col(p) + F.col(q) * F.col(q)) / 2)
    return g.select(r6("h").alias("human"), r6("a").alias("ai"), r6((F.col("a") - F.col("h")) / pooled("sh", "sa")).alias("d_population"), r6((F.col("a") - F.col("h")) / pooled("th", "ta")).alias("d_sample"))


@query(f"WITH {ENCODED_SQL} SELECT source, p1, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM pred GROUP BY 1, 2")
def a15_contingency(spark, d):
    t = predicted(spark, d).groupBy("source", "p1").agg(F.count("*").alias("n"))
    return t.select("source", "p1", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("source"))).alias("share"))


@query(f"""WITH m AS (SELECT DISTINCT call_id, {label_sql('source')} AS source, in_tokens, out_tokens, usd FROM mirrors)
SELECT source, count(*) AS calls, round(sum(in_tokens * 0.5 + out_tokens * 2.0) / 1e6, 6) AS priced, round(sum(usd), 4) AS logged, round(avg(in_tokens * 0.5 + out_tokens * 2.0) / 1e6 * 100000, 4) AS projected FROM m GROUP BY 1""")
def a18_usage_rollup(spark, d):
    """Token use of distinct calls weighed by in and out rates, its mean projected to 100,000 calls."""
    m = table(spark, d, "mirrors").select("call_id", canon_label("source").alias("source"), "in_tokens", "out_tokens", "usd").distinct()
    use = F.col("in_tokens") * 0.5 + F.col("out_tokens") * 2.0
    return m.groupBy("source").agg(F.count("*").alias("calls"), r6(F.sum(use) / 1e6).alias("priced"), F.round(F.sum("usd"), 4).alias("logged"), F.round(F.avg(use) / 1e6 * 100000, 4).alias("projected"))


@query(f"WITH {ENCODED_SQL} SELECT stratum, count(*) AS n, round(avg(score) FILTER (WHERE label_ai = 0) - avg(score) FILTER (WHERE label_ai = 1), 6) AS gap FROM pred WHERE stratum IS NOT NULL GROUP BY 1")
def a19_gap_by_stratum(spark, d):
    x = lambda k: F.avg(F.when(F.col("label_ai") == k, F.col("score")))
    return predicted(spark, d).where("stratum IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("n"), r6(x(0) - x(1)).alias("gap"))


@query(f"""WITH {POSTS_SQL}, s AS (SELECT site, count(*) AS probed, count(*) FILTER (WHERE words >= 100) AS usable FROM posts WHERE site IS NOT NULL GROUP BY 1),
u AS (SELECT {site_sql('url')} AS site, count(DISTINCT url) AS urls FROM story_human_frozen GROUP BY 1)
SELECT site, probed, usable, coalesce(urls, 0) AS urls, CASE WHEN probed = 0 THEN 0 ELSE round_even(usable::DOUBLE / probed * coalesce(urls, 0), 0) END::BIGINT AS estimated FROM s LEFT JOIN u USING (site)""")
def a20_extrapolated_yield(spark, d):
    """Usable posts that a site's addresses would give at the share of usable ones among those probed."""
    s = posts(spark, d).where("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("probed"), F.count_if(F.col("words") >= 100).alias("usable"))
    u = table(spark, d, "story_human_frozen").groupBy(site_of("url").alias("site")).agg(F.count_distinct("url").alias("urls"))
    s = s.join(u, "site", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    return s.select("site", "probed", "usable", "urls", F.coalesce(F.bround(F.try_divide("usable", "probed") * F.col("urls"), 0), F.lit(0)).cast("long").alias("estimated"))


def _f1_sql(src: str, y: str, p: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""c AS (SELECT {b}unnest(list_distinct([{y}::VARCHAR, {p}::VARCHAR])) AS class, {y}::VARCHAR AS y, {p}::VARCHAR AS p FROM {src}),
k AS (SELECT {b}class, count(*) FILTER (WHERE y = class AND p = class) AS tp, count(*) FILTER (WHERE y <> class AND p = class) AS fp, count(*) FILTER (WHERE y = class AND p <> class) AS fn FROM c GROUP BY {b}class),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM k)"""


@query(f"WITH {ENCODED_SQL}, {_f1_sql('pred', 'label_ai', 'p1')} SELECT round(avg(f1), 6) AS macro_f1, round(sum(tp) / sum(tp + fn), 6) AS accuracy FROM f")
def m1_macro_f1(spark, d):
    m = M.macro_f1(predicted(spark, d), "label_ai", "p1")
    return m.select(r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"))


@query(f"WITH {ENCODED_SQL}, {_f1_sql('pred', 'label_ai', 'p1', 'source')} SELECT source, class, tp, fp, fn, round(f1, 6) AS f1 FROM f")
def m2_class_f1_by_source(spark, d):
    return M.class_f1(predicted(spark, d), "label_ai", "p1", ["source"]).select("source", "class", "tp", "fp", "fn", r6("f1").alias("f1"))


@query(f"""WITH {ENCODED_SQL}, c AS (SELECT score, sum(label_ai) AS pos, count(*) AS n FROM pred GROUP BY 1), w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS all_ FROM c)
SELECT round(sum(pos * tp / all_::DOUBLE) / sum(pos), 6) AS auprc FROM w""")
def m3_average_precision(spark, d):
    return M.average_precision(predicted(spark, d), "label_ai", "score").select(r6("auprc").alias("auprc"))


@query(f"""WITH {ENCODED_SQL}, r AS (SELECT label_ai, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM pred)
SELECT round((sum(r) FILTER (WHERE label_ai = 1) - count(*) FILTER (WHERE label_ai = 1) * (count(*) FILTER (WHERE label_ai = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label_ai = 1) * count(*) FILTER (WHERE label_ai = 0)), 6) AS auc FROM r""")
def m4_roc_auc(spark, d):
    return M.roc_auc(predicted(spark, d), "label_ai", "score").select(r6("auc").alias("auc"))


_PAIR = f"""pr AS (SELECT doc_id, min(CASE WHEN x = 1 THEN verdict END) AS a, min(CASE WHEN x = 2 THEN verdict END) AS b FROM (
 SELECT doc_id, verdict, row_number() OVER (PARTITION BY doc_id ORDER BY rater) AS x FROM (SELECT doc_id, rater, arg_max(verdict, (labelled_at, verdict)) AS verdict FROM v WHERE rater IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)"""


def rater_pairs(spark, d):
    last = votes(spark, d).where("rater IS NOT NULL").groupBy("doc_id", "rater").agg(F.max_by("verdict", F.struct("labelled_at", "verdict")).alias("verdict"))
    x = last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rater", "verdict"))).alias("v"))  # a few raters a document
    return x.select("doc_id", F.try_element_at("v", F.lit(1)).verdict.alias("a"), F.try_element_at("v", F.lit(2)).verdict.alias("b"))


@query(f"""WITH {_VOTES}, {_PAIR}, t AS (SELECT a, b FROM pr WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS o FROM t),
e AS (SELECT sum(x.na * y.nb) AS e FROM (SELECT a AS k, count(*) AS na FROM t GROUP BY 1) x JOIN (SELECT b AS k, count(*) AS nb FROM t GROUP BY 1) y USING (k))
SELECT n, round(o::DOUBLE / n, 6) AS observed, round(e::DOUBLE / (n * n), 6) AS expected, round((o::DOUBLE / n - e::DOUBLE / (n * n)) / (1 - e::DOUBLE / (n * n)), 6) AS kappa FROM n, e""")
def m5_cohens_kappa(spark, d):
    k = M.cohens_kappa(rater_pairs(spark, d), "a", "b")
    return k.select("n", r6("observed").alias("observed"), r6("expected").alias("expected"), r6("kappa").alias("kappa"))


@query(f"""WITH {_VOTES}, l AS (SELECT doc_id, rater, arg_max(verdict, (labelled_at, verdict)) AS verdict FROM v WHERE rater IS NOT NULL GROUP BY 1, 2), n AS (SELECT doc_id, verdict, count(*) AS n FROM l GROUP BY 1, 2),
m AS (SELECT doc_id, sum(n) AS m FROM n GROUP BY 1 HAVING sum(n) >= 2), c AS (SELECT * FROM n JOIN m USING (doc_id)), o AS (SELECT sum(n * (m - n) / (m - 1.0)) / sum(n) AS o, sum(n) AS t, count(DISTINCT doc_id) AS u FROM c),
p AS (SELECT sum(s * s) AS q FROM (SELECT verdict, sum(n) AS s FROM c GROUP BY 1)) SELECT u AS units, t::BIGINT AS n_values, round(o, 6) AS observed, round(1 - q::DOUBLE / (t * t), 6) AS expected, round(1 - o / (1 - q::DOUBLE / (t * t)), 6) AS alpha FROM o, p""")
def m6_krippendorff_alpha(spark, d):
    last = votes(spark, d).where("rater IS NOT NULL").groupBy("doc_id", "rater").agg(F.max_by("verdict", F.struct("labelled_at", "verdict")).alias("verdict"))
    a = M.krippendorff_alpha(last, "doc_id", "verdict")
    return a.select("units", "n_values", *[r6(c).alias(c) for c in ("observed", "expected", "alpha")])


@query(f"""WITH {ENCODED_SQL}, l AS (UNPIVOT (SELECT {', '.join(f"coalesce({c}::VARCHAR, '-') AS {c}" for c in FEATURES)} FROM enc) ON {', '.join(FEATURES)} INTO NAME feature VALUE v), c AS (SELECT feature, v, count(*) AS n FROM l GROUP BY 1, 2)
SELECT feature, count(*) AS n_values, round(max(n) / sum(n), 6) AS top_share, round(coalesce(sum(n) FILTER (WHERE v = '-'), 0) / sum(n), 6) AS missing, CASE WHEN max(n) / sum(n) >= 0.98 THEN 'degenerate' WHEN coalesce(sum(n) FILTER (WHERE v = '-'), 0) / sum(n) > 0.1 THEN 'missing' ELSE 'kept' END AS state FROM c GROUP BY 1""")
def m7_feature_floor(spark, d):
    """Which features are degenerate (98 % one value) or too often missing."""
    e = encoded(spark, d).select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in FEATURES])
    c = e.unpivot([], list(FEATURES), "feature", "v").groupBy("feature", "v").agg(F.count("*").alias("n"))
    miss = F.coalesce(F.sum(F.when(F.col("v") == "-", F.col("n"))), F.lit(0)) / F.sum("n")
    top = F.max("n") / F.sum("n")
    g = c.groupBy("feature").agg(F.count("*").alias("n_values"), top.alias("t"), miss.alias("m"))
    return g.select("feature", "n_values", r6("t").alias("top_share"), r6("m").alias("missing"), F.when(F.col("t") >= 0.98, "degenerate").when(F.col("m") > 0.1, "missing").otherwise("kept").alias("state"))


@query(f"""WITH {_VOTES}, l AS (SELECT doc_id, rater, arg_max(verdict, (labelled_at, verdict)) AS verdict FROM v WHERE rater IS NOT NULL GROUP BY 1, 2), p AS (SELECT a.rater AS ra, b.rater AS rb, count(*) AS n, avg((a.verdict = b.verdict)::INT) AS s FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY 1, 2)
SELECT ra AS rater_a, rb AS rater_b, n, round(s, 6) AS agreement FROM p""")
def m8_pairwise_agreement(spark, d):
    l = votes(spark, d).where("rater IS NOT NULL").groupBy("doc_id", "rater").agg(F.max_by("verdict", F.struct("labelled_at", "verdict")).alias("v"))
    a, b = l.alias("a"), l.alias("b")
    j = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.rater") < F.col("b.rater")))
    return j.groupBy(F.col("a.rater").alias("rater_a"), F.col("b.rater").alias("rater_b")).agg(F.count("*").alias("n"), r6(F.avg((F.col("a.v") == F.col("b.v")).cast("int"))).alias("agreement"))


@query(f"WITH {ENCODED_SQL} SELECT source, count(*) AS n, round(avg(({' + '.join(f'({c} IS NOT NULL)::INT' for c in FEATURES)}) / {len(FEATURES)}.0), 6) AS coverage, count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}) AS full_rows FROM enc GROUP BY 1")
def m9_coverage(spark, d):
    given = sum((F.col(c).isNotNull().cast("int") for c in FEATURES[1:]), F.col(FEATURES[0]).isNotNull().cast("int"))
    return encoded(spark, d).withColumn("k", given).groupBy("source").agg(F.count("*").alias("n"), r6(F.avg(F.col("k") / len(FEATURES))).alias("coverage"), F.count_if(F.col("k") == len(FEATURES)).alias("full_rows"))


@query(f"""WITH {ENCODED_SQL}, p AS (SELECT doc_id, max(f02__ord) FILTER (WHERE source = 'human') AS h, max(f02__ord) FILTER (WHERE source = 'aster') AS a FROM enc GROUP BY 1)
SELECT count(*) AS n, round(avg((h = a)::INT), 6) AS exact, round(avg((abs(h - a) <= 1)::INT), 6) AS within_one FROM p WHERE h IS NOT NULL AND a IS NOT NULL""")
def m10_ordinal_agreement(spark, d):
    x = lambda s: F.max(F.when(F.col("source") == s, F.col("f02__ord")))
    p = encoded(spark, d).groupBy("doc_id").agg(x("human").alias("h"), x("aster").alias("a")).where("h IS NOT NULL AND a IS NOT NULL")
    return p.agg(F.count("*").alias("n"), r6(F.avg((F.col("h") == F.col("a")).cast("int"))).alias("exact"), r6(F.avg((F.abs(F.col("h") - F.col("a")) <= 1).cast("int"))).alias("within_one"))


_TVD = " UNION ALL ".join(f"SELECT '{c}' AS feature, (SELECT round(0.5 * sum(abs(h - a)), 6) FROM (SELECT coalesce({c}::VARCHAR, '-') AS v, count(*) FILTER (WHERE label_ai = 0)::DOUBLE / (SELECT count(*) FROM enc WHERE label_ai = 0) AS h, count(*) FILTER (WHERE label_ai = 1)::DOUBLE / (SELECT count(*) FROM enc WHERE label_ai = 1) AS a FROM enc GROUP BY 1)) AS tvd" for c in FEATURES)


@query(f"WITH {ENCODED_SQL} {_TVD}")
def m11_total_variation(spark, d):
    """Distance of the value distributions of human and machine texts, a missing answer being a value."""
    e = encoded(spark, d).select("label_ai", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in FEATURES])
    c = e.unpivot(["label_ai"], list(FEATURES), "feature", "v").groupBy("feature", "v").agg(F.count_if(F.col("label_ai") == 0).alias("h"), F.count_if(F.col("label_ai") == 1).alias("a"))
    w = W.partitionBy("feature")
    return c.withColumn("x", F.abs(F.col("h") / F.sum("h").over(w) - F.col("a") / F.sum("a").over(w))).groupBy("feature").agg(r6(F.sum("x") * 0.5).alias("tvd"))


NOISE_DRAWS = 40
_LONG_ANSWERS = "l AS (UNPIVOT (SELECT doc_id, source, " + ", ".join(f"coalesce({c}::VARCHAR, '-') AS {c}" for c in FEATURES) + f" FROM enc) ON {', '.join(FEATURES)} INTO NAME feature VALUE v)"


@query(f"""WITH {ENCODED_SQL}, {_LONG_ANSWERS},
d AS (SELECT b, doc_id, {H.format("'3|' || b || '|' || doc_id")} % 2 AS half FROM (SELECT DISTINCT doc_id FROM enc WHERE source = 'human'), generate_series(1, {NOISE_DRAWS}) g(b)),
c AS (SELECT b, feature, v, count(*) FILTER (WHERE half = 0)::DOUBLE AS x, count(*) FILTER (WHERE half = 1)::DOUBLE AS y FROM l JOIN d USING (doc_id) WHERE source = 'human' GROUP BY 1, 2, 3),
t AS (SELECT b, feature, 0.5 * sum(abs(x / greatest(sx, 1) - y / greatest(sy, 1))) AS tvd FROM (SELECT *, sum(x) OVER (PARTITION BY b, feature) AS sx, sum(y) OVER (PARTITION BY b, feature) AS sy FROM c) GROUP BY 1, 2),
n AS (SELECT feature, quantile_disc(tvd, 0.95) AS noise95 FROM t GROUP BY 1),
h AS (SELECT feature, v, count(*)::DOUBLE AS h FROM l WHERE source = 'human' GROUP BY 1, 2), hs AS (SELECT feature, sum(h) AS s FROM h GROUP BY 1),
a AS (SELECT source AS arm, feature, v, count(*)::DOUBLE AS a FROM l WHERE source <> 'human' GROUP BY 1, 2, 3), s AS (SELECT arm, feature, sum(a) AS s FROM a GROUP BY 1, 2),
x AS (SELECT s.arm, s.feature, h.v FROM s JOIN h USING (feature) UNION SELECT arm, feature, v FROM a),
r AS (SELECT x.arm, x.feature, 0.5 * sum(abs(coalesce(a.a, 0) / s.s - coalesce(h.h, 0) / hs.s)) AS tvd FROM x JOIN s USING (arm, feature) JOIN hs USING (feature) LEFT JOIN a ON a.arm = x.arm AND a.feature = x.feature AND a.v = x.v LEFT JOIN h ON h.feature = x.feature AND h.v = x.v GROUP BY 1, 2)
SELECT arm, feature, round(noise95, 6) AS noise95, round(2 * noise95 + 0.05, 6) AS threshold, round(tvd, 6) AS tvd, tvd > 2 * noise95 + 0.05 AS flagged FROM r JOIN n USING (feature)""")
def m12_noise_threshold(spark, d):
    """Features whose answers a source changes by more than noise: distance of its answers from those on human texts, against
    twice the 95th of forty distances between random halves of the human texts plus 0.05."""
    l = encoded(spark, d).select("doc_id", "source", *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in FEATURES]).unpivot(["doc_id", "source"], list(FEATURES), "feature", "v")
    human = l.where("source = 'human'")
    halves = human.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(NOISE_DRAWS)))).withColumn("half", draw(3, "b", "doc_id") % 2)
    c = halves.groupBy("b", "feature", "v").agg(F.count_if(F.col("half") == 0).alias("x"), F.count_if(F.col("half") == 1).alias("y"))
    noise = total_variation(c, ["b", "feature"], "x", "y").groupBy("feature").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY tvd)").alias("noise95"))
    arms = l.where("source <> 'human'").groupBy(F.col("source").alias("arm"), "feature", "v").agg(F.count("*").alias("x"))
    own = human.groupBy("feature", "v").agg(F.count("*").alias("y"))
    every = arms.select("arm", "feature").distinct().join(own.select("feature", "v"), "feature").unionByName(arms.select("arm", "feature", "v")).distinct()
    both = every.join(arms, ["arm", "feature", "v"], "left").join(own, ["feature", "v"], "left").fillna(0, ["x", "y"])
    r = total_variation(both, ["arm", "feature"], "x", "y").join(noise, "feature")
    limit = 2 * F.col("noise95") + 0.05
    return r.select("arm", "feature", r6("noise95").alias("noise95"), r6(limit).alias("threshold"), r6("tvd").alias("tvd"), (F.col("tvd") > limit).alias("flagged"))


def total_variation(counts, by, x, y):
    """(by, tvd): half the summed differences of the shares that values have of the counts x and y."""
    w = W.partitionBy(*by)
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1))
    return counts.withColumn("_d", F.abs(share(x) - share(y))).groupBy(*by).agg((F.sum("_d") * 0.5).alias("tvd"))


@query(f"WITH {ENCODED_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE p1 = label_ai AND p2 <> label_ai) AS only_first, count(*) FILTER (WHERE p1 <> label_ai AND p2 = label_ai) AS only_second, count(*) FILTER (WHERE p1 <> label_ai AND p2 <> label_ai) AS both_wrong, round(count(*) FILTER (WHERE p1 <> label_ai AND p2 <> label_ai)::DOUBLE / greatest(count(*) FILTER (WHERE p1 <> label_ai OR p2 <> label_ai), 1), 6) AS jaccard FROM pred")
def m13_m14_error_overlap(spark, d):
    a, b = F.col("p1") != F.col("label_ai"), F.col("p2") != F.col("label_ai")
    return predicted(spark, d).agg(F.count("*").alias("n"), F.count_if(~a & b).alias("only_first"), F.count_if(a & ~b).alias("only_second"), F.count_if(a & b).alias("both_wrong"), r6(F.count_if(a & b) / F.greatest(F.count_if(a | b), F.lit(1))).alias("jaccard"))


@query(f"""WITH {ENCODED_SQL}, c AS (SELECT count(*) FILTER (WHERE p1 = label_ai AND p2 <> label_ai) AS a, count(*) FILTER (WHERE p1 <> label_ai AND p2 = label_ai) AS b FROM pred)
SELECT a AS only_first, b AS only_second, printf('%.9e', CASE WHEN a + b = 0 THEN 1 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(a + b + 1.0) - lgamma(i + 1.0) - lgamma(a + b - i + 1.0) - (a + b) * ln(2.0))) FROM range(0, least(a, b) + 1) r(i))) END)::DOUBLE AS p FROM c""")
def m13_mcnemar(spark, d):
    """Exact two-sided p of the discordant pairs; only the two counts reach the driver."""
    r = m13_m14_error_overlap(spark, d).first()
    return spark.createDataFrame([(r["only_first"], r["only_second"], float(f"{M.mcnemar_p(r['only_first'], r['only_second']):.9e}"))], "only_first long, only_second long, p double")


@query(f"""WITH {ENCODED_SQL}, r AS (SELECT vertical, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM pred WHERE vertical IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n FROM r), g AS (SELECT count(*) AS k, sum(s * s / c) AS s FROM (SELECT vertical, sum(r) AS s, count(*) AS c FROM r GROUP BY 1)),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT score, count(*) AS c FROM pred WHERE vertical IS NOT NULL GROUP BY 1)) SELECT k AS groups, n::BIGINT AS n, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h FROM g, n, t""")
def m15_kruskal_wallis(spark, d):
    return M.kruskal_wallis(predicted(spark, d).where("vertical IS NOT NULL"), "vertical", "score").select("groups", "n", F.round("h", 4).alias("h"))


@query()
def m15_kruskal_wallis_p(spark, d):
    """The same over verticals with at least twenty texts, with the p of its chi-squared tail."""
    p = predicted(spark, d).where("vertical IS NOT NULL")
    enough = p.groupBy("vertical").agg(F.count("*").alias("n")).where("n >= 20").select("vertical")
    r = M.kruskal_wallis(p.join(F.broadcast(enough), "vertical", "left_semi"), "vertical", "score").first()  # a row a vertical
    tail = M.chi_squared_tail(r["h"], r["groups"] - 1) if r and r["h"] is not None and r["groups"] > 1 else None
    return spark.createDataFrame([(r["groups"], r["n"], round(r["h"], 4) if r["h"] is not None else None, tail)], "groups long, n long, h double, p double")


_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
_TIMES = " + ".join(f"(u >= {c})::INT" for c in _CUTS)


#: Replicates of every bootstrap.
REPLICATES = 10_000


def _boot_sql(p: str, replicates: int = REPLICATES) -> str:
    return f"""u{p} AS (SELECT coalesce(site, doc_id) AS unit, count(*) FILTER (WHERE label_ai = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE label_ai = 0 AND {p} = 1) AS fp, count(*) FILTER (WHERE label_ai = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE label_ai = 0 AND {p} = 0) AS tn FROM pred GROUP BY 1),
b{p} AS (SELECT b, sum(t * tp) AS tp, sum(t * fp) AS fp, sum(t * fn) AS fn, sum(t * tn) AS tn FROM (SELECT *, {_TIMES} AS t FROM (SELECT *, 4 * k + i + 1 AS b, ('0x' || substr(h, 1 + 8 * i, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT *, md5('11|' || unit || '|' || k) AS h FROM u{p}, generate_series(0, {(replicates - 1) // 4}) g(k)), (VALUES (0), (1), (2), (3)) v(i)) WHERE b <= {replicates}) GROUP BY 1),
f{p} AS (SELECT b, (coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f FROM b{p})"""


def _replicates(spark, d, p, n=REPLICATES):
    e = predicted(spark, d).withColumn("unit", F.coalesce("site", "doc_id"))
    return bootstrap_counts(unit_counts(e, "unit", "label_ai", p), "unit", n, 11).select("b", binary_macro_f1().alias("f"))


@query(f"WITH {ENCODED_SQL}, {_boot_sql('p1')} SELECT count(*) AS replicates, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.5), 6) AS middle, round(quantile_cont(f, 0.975), 6) AS high FROM fp1")
def m16_bootstrap_interval(spark, d):
    """Percentile interval of macro-F1 over sites drawn with replacement, from the four counts of each site."""
    q = lambda x: r6(F.percentile("f", F.lit(x)))
    return _replicates(spark, d, "p1").agg(F.count("*").alias("replicates"), q(0.025).alias("low"), q(0.5).alias("middle"), q(0.975).alias("high"))


@query(f"""WITH {ENCODED_SQL}, {_boot_sql('p1')}, {_boot_sql('p2')}, x AS (SELECT fp1.f - fp2.f AS x FROM fp1 JOIN fp2 USING (b)), s AS (SELECT quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, least(1.0, 2 * least(avg((x <= 0)::INT), avg((x >= 0)::INT))) AS p FROM x)
SELECT round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, CASE WHEN low > -0.02 AND high < 0.02 THEN 'equivalent' WHEN low >= -0.02 THEN 'stronger' ELSE 'not_shown' END AS verdict FROM s""")
def m17_m18_paired_bootstrap(spark, d):
    """Difference of two predictions on the same draws: interval, two-sided p (at most 1), equivalence within 0.02."""
    j = _replicates(spark, d, "p1").withColumnRenamed("f", "f1").join(_replicates(spark, d, "p2"), "b").withColumn("x", F.col("f1") - F.col("f"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("x") <= 0).cast("int")), F.avg((F.col("x") >= 0).cast("int"))))
    s = j.agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"), p.alias("p"))
    verdict = F.when((F.col("low") > -0.02) & (F.col("high") < 0.02), "equivalent").when(F.col("low") >= -0.02, "stronger").otherwise("not_shown")
    return s.select(r6("low").alias("low"), r6("high").alias("high"), r6("p").alias("p"), verdict.alias("verdict"))


@query(f"WITH {ENCODED_SQL} SELECT source, count(*) FILTER (WHERE p1 = 1 AND p2 = 0) AS to_human, count(*) FILTER (WHERE p1 = 0 AND p2 = 1) AS to_ai, count(*) FILTER (WHERE p2 = 0) AS predicted_human FROM pred GROUP BY 1")
def m19_flips(spark, d):
    return predicted(spark, d).groupBy("source").agg(F.count_if((F.col("p1") == 1) & (F.col("p2") == 0)).alias("to_human"), F.count_if((F.col("p1") == 0) & (F.col("p2") == 1)).alias("to_ai"), F.count_if(F.col("p2") == 0).alias("predicted_human"))


_OFF = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg(({c} NOT IN {menu})::INT), 6) AS off_rate FROM enc" for c, menu in (("f02__ord", "(0,1,2,3,4)"), ("f04__ord", "(0,1,2,3)"), ("f06__ord", "(0,1,2)")))


@query(f"WITH {ENCODED_SQL} {_OFF}")
def m20_off_option_rate(spark, d):
    """Share of answers outside a feature's menu."""
    menus = {"f02__ord": [0, 1, 2, 3, 4], "f04__ord": [0, 1, 2, 3], "f06__ord": [0, 1, 2]}
    one = encoded(spark, d).agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), r6(F.avg((~F.col(c).isin(*[float(x) for x in m])).cast("int"))).alias("off_rate")).alias(c) for c, m in menus.items()])
    return one.select(F.explode(F.array(*menus)).alias("x")).select("x.*")


@query(f"""WITH {POSTS_SQL}, {ENCODED_SQL}, s AS (SELECT DISTINCT source FROM enc), w AS (SELECT p.doc_id, s.source FROM posts p, s)
SELECT source, count(*) AS expected, count(e.doc_id) AS present, count(*) - count(e.doc_id) AS missing FROM w LEFT JOIN enc e USING (doc_id, source) GROUP BY 1""")
def m21_matrix_completeness(spark, d):
    """Expected texts (each post and source) against those in the matrix; expected counts need no product of the two."""
    n = posts(spark, d).agg(F.count("*").alias("expected"))
    e = encoded(spark, d).join(posts(spark, d).select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("present"))
    return e.crossJoin(F.broadcast(n)).select("source", "expected", "present", (F.col("expected") - F.col("present")).alias("missing"))  # n is one row


@query(f"""SELECT {label_sql('source')} AS source, count(*) AS n, round(avg((abs(words - target_words) <= 0.1 * target_words)::INT), 6) AS within FROM mirrors WHERE words IS NOT NULL AND target_words IS NOT NULL GROUP BY 1""")
def m23_length_adherence(spark, d):
    t = table(spark, d, "mirrors").where("words IS NOT NULL AND target_words IS NOT NULL")
    return t.groupBy(canon_label("source").alias("source")).agg(F.count("*").alias("n"), r6(F.avg((F.abs(F.col("words") - F.col("target_words")) <= 0.1 * F.col("target_words")).cast("int"))).alias("within"))


@query(f"""WITH {ENCODED_SQL}, q AS (SELECT quantile_cont(score, [0.3333333333333333, 0.6666666666666666]) AS e FROM pred), b AS (SELECT *, (score > e[1])::INT + (score > e[2])::INT AS bin FROM pred, q), {_f1_sql('b', 'label_ai', 'p2', 'bin')} SELECT bin, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1""")
def m24_tertile_f1(spark, d):
    p = predicted(spark, d)
    e = p.agg(F.percentile("score", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    b = p.crossJoin(F.broadcast(e)).withColumn("bin", (F.col("score") > F.col("e")[0]).cast("int") + (F.col("score") > F.col("e")[1]).cast("int"))  # e is one row
    return M.macro_f1(b, "label_ai", "p2", ["bin"]).select("bin", r6("macro_f1").alias("macro_f1"))


@query(f"""WITH {ENCODED_SQL}, h AS (SELECT score AS s, count(*) AS n FROM pred WHERE label_ai = 0 GROUP BY 1), t AS (SELECT sum(n) AS t FROM h) SELECT score, count(*) AS n, round((SELECT coalesce(sum(h.n), 0) FROM h WHERE h.s <= score) / (SELECT t FROM t), 6) AS percentile FROM pred GROUP BY 1""")
def w1_percentile_against_reference(spark, d):
    """Share of the human texts at or below each score, also for scores no human text has."""
    c = predicted(spark, d).groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("label_ai") == 0).alias("h"))
    total = c.agg(F.sum("h").alias("t"))
    c = running_sums(c, [F.col("score")], {"upto": F.col("h")}, inclusive=True).crossJoin(F.broadcast(total))  # total is one row
    return c.select("score", "n", r6(F.col("upto") / F.col("t")).alias("percentile"))


@query(f"""WITH {ENCODED_SQL}, l AS (UNPIVOT (SELECT source, {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} FROM enc GROUP BY 1) ON {', '.join(FEATURES)} INTO NAME feature VALUE v), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY v DESC) + (count(*) OVER (PARTITION BY source, v) - 1) / 2.0 AS rk, quantile_cont(v, 0.75) OVER (PARTITION BY source) AS q FROM l)
SELECT feature, round(avg((rk <= 3)::INT), 6) AS in_top3, round(avg((v >= q)::INT), 6) AS stability FROM r GROUP BY 1""")
def w3_rank_stability(spark, d):
    """How often a feature is among a source's three highest means, and at or above its upper quartile."""
    l = encoded(spark, d).groupBy("source").agg(*[F.avg(c).alias(c) for c in FEATURES]).unpivot(["source"], list(FEATURES), "feature", "v")
    q = l.groupBy("source").agg(F.percentile("v", F.lit(0.75)).alias("q"))
    r = l.withColumn("rk", average_rank("v", ["source"], descending=True)).join(q, "source")
    return r.groupBy("feature").agg(r6(F.avg((F.col("rk") <= 3).cast("int"))).alias("in_top3"), r6(F.avg((F.col("v") >= F.col("q")).cast("int"))).alias("stability"))
