"""Encoding, classifiers, geometry and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.hashing import draw
from loomscribe.operators import geometry as G
from loomscribe.operators import metrics as M
from loomscribe.operators import models as L
from loomscribe.operators.relational import running_sums
from loomscribe.plans.base import ENCODED_SQL, FEATURES, canon_label, encoded, mirror_texts, posts, predicted, query, r6, table
from loomscribe.plans.corpus import doc_splits
from loomscribe.runtime import cut

_LONG = f"l AS (UNPIVOT (SELECT doc_id, source, label_ai, {', '.join(FEATURES)} FROM enc) ON {', '.join(FEATURES)} INTO NAME col VALUE v)"


def long_form(spark, d):
    """(doc_id, source, label_ai, col, v) of every answer given."""
    e = encoded(spark, d).select("doc_id", "source", "label_ai", *FEATURES)
    return e.unpivot(["doc_id", "source", "label_ai"], list(FEATURES), "col", "v").where("v IS NOT NULL")


@query(f"""WITH {ENCODED_SQL}, {_LONG} SELECT split_part(col, '__', 1) AS feature, split_part(col, '__', 2) AS value, count(*) AS n, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v > 0) AS hits FROM l GROUP BY 1, 2""")
def ml1_encoded_long(spark, d):
    name = F.split("col", "__")
    return long_form(spark, d).groupBy(name[0].alias("feature"), name[1].alias("value")).agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), F.count_if(F.col("v") > 0).alias("hits"))


@query(f"""WITH o AS (SELECT doc_id, lower(trim(source)) AS src, CASE WHEN length(text) >= 4000 THEN 'long' WHEN length(text) >= 1000 THEN 'medium' WHEN text IS NOT NULL THEN 'short' END AS size, CASE WHEN regexp_matches(text, '(?m)^#') THEN 'yes' WHEN text IS NOT NULL THEN 'no' END AS heading FROM documents)
SELECT doc_id, CASE WHEN size IS NOT NULL THEN (size = 'short')::INT END AS size__short, CASE WHEN size IS NOT NULL THEN (size = 'medium')::INT END AS size__medium, CASE WHEN size IS NOT NULL THEN (size = 'long')::INT END AS size__long, CASE size WHEN 'short' THEN 0 WHEN 'medium' THEN 1 WHEN 'long' THEN 2 END AS size__ord,
CASE WHEN heading IS NOT NULL THEN (heading = 'yes')::INT END AS heading__yes FROM o""")
def ml1_encoder(spark, d):
    """Answers to columns: one-hot over a menu, ordinal position, null for the whole feature where there is no answer."""
    menu = ["short", "medium", "long"]
    n = F.length("text")
    o = table(spark, d, "documents").select("doc_id", F.when(n >= 4000, "long").when(n >= 1000, "medium").when(n.isNotNull(), "short").alias("size"),
                                            F.when(F.col("text").rlike("(?m)^#"), "yes").when(n.isNotNull(), "no").alias("heading"))
    hot = [F.when(F.col("size").isNotNull(), (F.col("size") == m).cast("int")).alias(f"size__{m}") for m in menu]
    position = F.nullif(F.array_position(F.array(*map(F.lit, menu)), F.col("size")), F.lit(0)) - 1
    return o.select("doc_id", *hot, position.cast("int").alias("size__ord"), F.when(F.col("heading").isNotNull(), (F.col("heading") == "yes").cast("int")).alias("heading__yes"))


@query(f"""WITH {ENCODED_SQL}, {_LONG}, v AS (SELECT *, CASE WHEN starts_with(col, 'f03__') OR starts_with(col, 'f05__') THEN 'style' ELSE 'structure' END AS variant FROM l)
SELECT variant, count(DISTINCT col) AS columns, count(*) AS answers, count(DISTINCT (doc_id, source)) AS texts FROM v GROUP BY 1""")
def ml2_variant_sets(spark, d):
    v = F.when(F.col("col").startswith("f03__") | F.col("col").startswith("f05__"), "style").otherwise("structure")
    return long_form(spark, d).groupBy(v.alias("variant")).agg(F.count_distinct("col").alias("columns"), F.count("*").alias("answers"), F.count_distinct("doc_id", "source").alias("texts"))


@query(f"""WITH {ENCODED_SQL}, {_LONG}, c AS (SELECT label_ai, col, avg(v) AS m FROM l GROUP BY 1, 2), x AS (SELECT l.label_ai, doc_id, source, sqrt(sum(pow(v - m, 2))) AS d FROM l JOIN c USING (label_ai, col) GROUP BY 1, 2, 3),
g AS (SELECT label_ai, avg(d) AS d, count(*) AS n FROM x GROUP BY 1), z AS (SELECT sqrt(sum(pow(a.m - b.m, 2))) AS z FROM c a JOIN c b USING (col) WHERE a.label_ai = 0 AND b.label_ai = 1)
SELECT label_ai, round(d, 6) AS mean_distance, n, round(d / (SELECT d FROM g WHERE label_ai = 0), 6) AS ratio_to_human, round(z, 6) AS between_centroids FROM g, z""")
def a16_dispersion(spark, d):
    """Mean distance of the texts of each label to their centroid, its ratio to that of human texts, and the distance of the two centroids."""
    l = long_form(spark, d).withColumn("item", F.concat_ws("|", "doc_id", "source"))
    x = G.dispersion(l, "label_ai", "item", "col", "v")
    c = l.groupBy("col").agg(*[F.avg(F.when(F.col("label_ai") == k, F.col("v"))).alias(f"m{k}") for k in (0, 1)])
    z = c.agg(F.sqrt(F.sum(F.pow(F.col("m0") - F.col("m1"), 2))).alias("z"))
    h = F.max(F.when(F.col("label_ai") == 0, F.col("mean_distance"))).over(W.partitionBy(F.lit(1)))  # two rows
    return x.withColumn("h", h).crossJoin(F.broadcast(z)).select("label_ai", r6("mean_distance").alias("mean_distance"), "n", r6(F.col("mean_distance") / F.col("h")).alias("ratio_to_human"), r6("z").alias("between_centroids"))  # z is one row


@query(f"""WITH {ENCODED_SQL}, {_LONG}, m AS (SELECT col, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS s FROM l GROUP BY 1)
SELECT source, col, count(*) AS n, round(avg((v - m) / s), 6) AS mean_z, round(max((v - m) / s), 6) AS most_z FROM l JOIN m USING (col) GROUP BY 1, 2""")
def a12_z_scores(spark, d):
    """Answers as z-scores of their column: mean and largest of each source."""
    l = long_form(spark, d)
    m = l.groupBy("col").agg(F.avg("v").alias("m"), F.when(F.stddev_pop("v") == 0, 1.0).otherwise(F.stddev_pop("v")).alias("s"))
    z = (F.col("v") - F.col("m")) / F.col("s")
    return l.join(F.broadcast(m), "col").groupBy("source", "col").agg(F.count("*").alias("n"), r6(F.avg(z)).alias("mean_z"), r6(F.max(z)).alias("most_z"))  # a row a column


def _queries_and_rows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"), "label")
    return e.where("id % 20 = 0"), e


_NN = """nn AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label AS lb, a.label AS la, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


@query(f"WITH {_NN} SELECT q AS query, r AS rank, id, round(dist, 5) AS distance FROM nn WHERE r <= 10")
def j9_nearest_neighbours(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 20, among all vectors, exact."""
    q, e = _queries_and_rows(spark, d)
    n = G.nearest(q, e, 10)
    return n.select("query", F.row_number().over(W.partitionBy("query").orderBy("distance", "id")).alias("rank"), "id", F.round("distance", 5).alias("distance"))


@query(f"WITH {_NN}, m AS (SELECT q, any_value(la) AS label, avg(dist) AS m FROM nn WHERE r <= 25 GROUP BY 1) SELECT q AS vec_id, label, round(m, 5) AS rarity, round(cume_dist() OVER (ORDER BY round(m, 9)), 6) AS percentile FROM m")
def ml11_rarity(spark, d):
    """Mean distance to the 25 nearest others, and its percentile among the queries."""
    q, e = _queries_and_rows(spark, d)
    m = G.nearest(q, e, 25).groupBy("query").agg(F.avg("distance").alias("m")).join(q.select(F.col("id").alias("query"), "label"), "query")
    c = m.groupBy(F.round("m", 9).alias("x")).agg(F.count("*").alias("n"))
    total = m.agg(F.count("*").alias("t"))
    c = running_sums(c, [F.col("x")], {"upto": F.col("n")}, inclusive=True).crossJoin(F.broadcast(total)).select("x", (F.col("upto") / F.col("t")).alias("percentile"))  # total is one row
    return m.withColumn("x", F.round("m", 9)).join(c, "x").select(F.col("query").alias("vec_id"), "label", F.round("m", 5).alias("rarity"), r6("percentile").alias("percentile"))


_TAILS = """b AS (SELECT 'all' AS basis, m FROM m UNION ALL SELECT 'first_label', m FROM m WHERE label = (SELECT min(label) FROM m)),
t AS (SELECT basis, unnest([5, 10, 25]) AS tail_percent, unnest(quantile_cont(m, [0.95, 0.9, 0.75])) AS t FROM b GROUP BY 1)"""


@query(f"""WITH {_NN}, m AS (SELECT q, any_value(la) AS label, avg(dist) AS m FROM nn WHERE r <= 25 GROUP BY 1), {_TAILS}
SELECT basis, tail_percent, label, count(*) AS n, count(*) FILTER (WHERE m >= t) AS in_tail FROM m, t GROUP BY 1, 2, 3""")
def ml12_rarity_tails(spark, d):
    """By label, how many vectors are among the rarest 5, 10 and 25 percent of all, and beyond the same quantiles of the first label alone."""
    q, e = _queries_and_rows(spark, d)
    m = G.nearest(q, e, 25).groupBy("query").agg(F.avg("distance").alias("m")).join(q.select(F.col("id").alias("query"), "label"), "query")
    first = F.col("label") == m.agg(F.min("label")).first()[0]
    at = F.percentile("m", F.array(*[F.lit(1 - s / 100.0) for s in (5, 10, 25)]))
    bases = m.agg(at.alias("q")).withColumn("basis", F.lit("all")).unionByName(m.where(first).agg(at.alias("q")).withColumn("basis", F.lit("first_label")))
    t = bases.select("basis", F.posexplode("q").alias("i", "t")).withColumn("tail_percent", F.element_at(F.array(*map(F.lit, (5, 10, 25))), F.col("i") + 1))
    return m.crossJoin(F.broadcast(t)).groupBy("basis", "tail_percent", "label").agg(F.count("*").alias("n"), F.count_if(F.col("m") >= F.col("t")).alias("in_tail"))  # t is six rows


@query(f"WITH {_NN} SELECT la AS label, count(*) AS n, round(avg(dist), 5) AS radius FROM nn WHERE r = 10 GROUP BY 1")
def ml13_neighbour_radius(spark, d):
    """Mean distance to the tenth nearest vector, by label."""
    q, e = _queries_and_rows(spark, d)
    n = G.nearest(q, e, 10).groupBy("query").agg(F.max("distance").alias("r"))
    return n.join(q.select(F.col("id").alias("query"), "label"), "query").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("radius"))


@query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
s AS (SELECT a.vec_id, a.label, max(list_dot_product(a.u, b.u)) AS best FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.label <> b.label GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg((best >= 0.3)::INT), 6) AS covered FROM s GROUP BY 1""")
def ml18_coverage(spark, d):
    """Share of the query vectors with a vector of another label at cosine 0.3 or more: the nearest unit vector decides."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), G.unit_vector(F.col("embedding")).alias("vec"), "label")
    near = G.nearest(e.where(F.col("id") % 20 == 0), e, 1, apart="label").join(e.select(F.col("id").alias("query"), "label"), "query")
    cos = (2 - F.col("distance") * F.col("distance")) / 2
    return near.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg((cos >= 0.3).cast("int"))).alias("covered"))


@query()
def ml14_discriminant_projection(spark, d):
    """Two Fisher axes of the labels: scatter matrices are aggregates; only one matrix a label reaches the driver."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def partial(batches):
        import pandas as pd

        acc = {}
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                m = np.stack(part["v"].to_numpy())
                n, s, o = acc.get(label, (0, 0.0, 0.0))
                acc[label] = (n + len(m), s + m.sum(axis=0), o + m.T @ m)
        yield pd.DataFrame([(k, n, s.tolist(), o.ravel().tolist()) for k, (n, s, o) in acc.items()], columns=["label", "n", "s", "o"])

    got: dict = {}
    for r in e.select("label", "v").mapInPandas(partial, "label int, n long, s array<double>, o array<double>").collect():
        n, s, o = got.get(r["label"], (0, 0.0, 0.0))
        k = len(r["s"])
        got[r["label"]] = (n + r["n"], s + np.array(r["s"]), o + np.array(r["o"]).reshape(k, k))
    axes = G.discriminant_axes([(k, n, s.tolist(), o.tolist()) for k, (n, s, o) in sorted(got.items())])
    dot = lambda a: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in a]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", "label", F.round(dot(axes[:, 0]), 6).alias("x"), F.round(dot(axes[:, 1]), 6).alias("y"))


_LINK = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.u, b.u) AS c FROM e a, e b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.3),
k AS (SELECT * FROM (VALUES (0.3), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95)) k(k)),
r(k, a, b) AS (SELECT k, vec_id, vec_id FROM e, k UNION SELECT r.k, r.a, p.b FROM r JOIN p ON p.a = r.b AND p.c >= r.k),
m AS (SELECT k, a, min(b) AS m FROM r GROUP BY 1, 2), l AS (SELECT a, count(*) AS links FROM p GROUP BY 1)
SELECT e.vec_id, max(m) FILTER (WHERE k = 0.3) AS cluster, coalesce(any_value(links), 0) AS links, """ + ", ".join(f"max(m) FILTER (WHERE k = {k / 100}) AS cluster_{k}" for k in (70, 75, 80, 85, 90, 95)) + " FROM e JOIN m ON m.a = e.vec_id LEFT JOIN l ON l.a = e.vec_id GROUP BY 1"


@query(_LINK)
def ml17_single_linkage(spark, d):
    """Each vector's single-linkage cluster at cosine 0.3 or more, its number of links, and its clusters at .70 to .95."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), G.unit_vector(F.col("embedding")).alias("vec"))
    return G.single_linkage(e, 0.3, (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)).withColumnRenamed("id", "vec_id")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings), l AS (SELECT vec_id, label, unnest(generate_series(1, 64)) AS i, unnest(u) AS x FROM e), s AS (SELECT label, i, sum(x) AS s FROM l GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
p AS (SELECT l.vec_id, l.label, s.label AS other, 1 - (sum(l.x * s.s) - CASE WHEN l.label = s.label THEN 1 ELSE 0 END) / (max(n.n) - CASE WHEN l.label = s.label THEN 1 ELSE 0 END) AS dist FROM l JOIN s USING (i) JOIN n ON n.label = s.label GROUP BY 1, 2, 3),
q AS (SELECT vec_id, label, max(dist) FILTER (WHERE label = other) AS a, min(dist) FILTER (WHERE label <> other) AS b FROM p GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM q GROUP BY 1""")
def m25_cosine_silhouette(spark, d):
    """Silhouette under cosine distance: the mean distance to a cluster follows from the sum of its unit vectors, so no pairs are made."""
    e = table(spark, d, "embeddings").select("vec_id", "label", G.unit_vector(F.col("embedding")).alias("u"))
    long = e.select("label", F.posexplode("u").alias("i", "x"))
    sums = long.groupBy("label", "i").agg(F.sum("x").alias("s")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p.s).alias("s"))
    sums = sums.join(e.groupBy("label").agg(F.count("*").alias("n")), "label").select(F.col("label").alias("other"), "s", "n")
    own = (F.col("label") == F.col("other")).cast("int")
    dot = F.aggregate(F.zip_with("u", "s", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    p = e.crossJoin(F.broadcast(sums)).select("vec_id", "label", "other", (1 - (dot - own) / (F.col("n") - own)).alias("dist"))  # a row a label
    q = p.groupBy("vec_id", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("dist"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("dist"))).alias("b"))
    return q.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 5).alias("silhouette"))


def _parts(spark, d, columns=FEATURES):
    e = L.assembled(predicted(spark, d), columns).join(doc_splits(spark, d), "doc_id").withColumn("label", F.col("label_ai").cast("double"))
    e = cut(e, "parts")  # fits read their rows many times
    return e.where("split = 'train'"), e.where("split = 'val'"), e.where("split = 'test'")


@query()
def ml3_boosted_trees(spark, d):
    """Macro-F1, accuracy and average precision of boosted trees, the configuration chosen on the validation split (ML4)."""
    from pyspark.ml.functions import vector_to_array

    train, val, test = _parts(spark, d)
    best = L.best_on_validation(train, val, "label", [{"trees": 5, "depth": 3}, {"trees": 10, "depth": 4}])
    got = L.boosted(train.unionByName(val), test, "label", **best).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    f1 = M.macro_f1(got.withColumn("y", F.col("label").cast("int")).withColumn("p", F.col("prediction").cast("int")), "y", "p")
    ap = M.average_precision(got, "label", "score")
    return f1.crossJoin(ap).select(F.lit(best["trees"]).alias("trees"), F.lit(best["depth"]).alias("depth"), r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"), r6("auprc").alias("auprc"))  # one row each


@query()
def ml5_six_way(spark, d):
    """Confusion of sources predicted by a random forest."""
    train, val, test = _parts(spark, d)
    names = ["aster", "borel", "cygne", "dunlin", "egret", "human"]
    code = F.array_position(F.array(*map(F.lit, names)), F.col("source")).cast("double") - 1
    fit = train.unionByName(val).withColumn("who", code).where("who >= 0")
    got = L.six_way(fit, test.withColumn("who", code).where("who >= 0"), "who")
    return got.groupBy("source", F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1).alias("predicted")).agg(F.count("*").alias("n"))


@query()
def ml6_length_logistic(spark, d):
    """Logistic regression on the feature score alone, classes weighed alike."""
    train, val, test = _parts(spark, d, ["score"])
    w = lambda x: x.withColumn("w", F.when(F.col("label") == 1, 0.2).otherwise(1.0))
    got = L.logistic(w(train.unionByName(val)), test, "label", "w")
    return M.macro_f1(got, "label", "prediction").select(r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"))


@query()
def ml7_permutation_importance(spark, d):
    """Loss of macro-F1 on the test split when a feature is replaced by another row's (not SHAP)."""
    from pyspark.ml.classification import GBTClassifier

    train, _, _ = _parts(spark, d)
    test = predicted(spark, d).join(doc_splits(spark, d), "doc_id").where("split = 'test'").withColumn("label", F.col("label_ai").cast("double"))
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=5, maxDepth=3, stepSize=0.2, seed=7).fit(train)
    rows = L.permutation_importance(model, test, list(FEATURES), "label")
    return spark.createDataFrame([(c, float(v)) for c, v in rows], "feature string, importance double").select("feature", r6("importance").alias("importance"))


@query(f"""WITH {ENCODED_SQL}, {_LONG}, s AS (SELECT col, max(v) AS top FROM l GROUP BY 1), m AS (SELECT col, source, avg(v / top) AS m FROM l JOIN s USING (col) WHERE top > 0 GROUP BY 1, 2),
g AS (SELECT col, max(m) FILTER (WHERE source = 'human') AS h, avg(m) FILTER (WHERE source <> 'human') AS a, max(m) FILTER (WHERE source <> 'human') - min(m) FILTER (WHERE source <> 'human') AS spread FROM m GROUP BY 1)
SELECT col, round(h - a, 6) AS gap, round(spread, 6) AS spread, abs(h - a) >= 0.2 AND spread <= 0.35 AS core FROM g""")
def ml8_core_rule(spark, d):
    """Gap of human and mean machine value (columns scaled by their maximum) and spread of the machines; core by both rules."""
    l = long_form(spark, d)
    top = l.groupBy("col").agg(F.max("v").alias("top")).where("top > 0")
    m = l.groupBy("col", "source").agg(F.avg("v").alias("v")).join(F.broadcast(top), "col").withColumn("m", F.col("v") / F.col("top"))  # a row a column
    ai = F.when(F.col("source") != "human", F.col("m"))
    g = m.groupBy("col").agg(F.max(F.when(F.col("source") == "human", F.col("m"))).alias("h"), F.avg(ai).alias("a"), (F.max(ai) - F.min(ai)).alias("spread"))
    return g.select("col", r6(F.col("h") - F.col("a")).alias("gap"), r6("spread").alias("spread"), ((F.abs(F.col("h") - F.col("a")) >= 0.2) & (F.col("spread") <= 0.35)).alias("core"))


@query(f"""WITH {ENCODED_SQL}, {_LONG}, m AS (SELECT col, source, avg(v) AS m FROM l GROUP BY 1, 2), x AS (SELECT *, m / sum(m) OVER (PARTITION BY col) AS share, row_number() OVER (PARTITION BY col ORDER BY m DESC, source) AS r FROM m) SELECT col, source AS top_source, round(share, 6) AS share FROM x WHERE r = 1""")
def ml9_fingerprints(spark, d):
    """Of each column the source with the highest mean, and its share of all means."""
    m = long_form(spark, d).groupBy("col", "source").agg(F.avg("v").alias("m"))
    g = m.groupBy("col").agg(F.sum("m").alias("t"), F.max_by(F.struct("source", "m"), F.struct("m", F.reverse("source"))).alias("x"))
    first = m.alias("m").join(g.select("col", "t", F.col("x.m").alias("top")).alias("g"), "col").where("m.m = g.top").groupBy("col").agg(F.min("source").alias("top_source"), F.first("top").alias("top"), F.first("t").alias("t"))
    return first.select("col", "top_source", r6(F.col("top") / F.col("t")).alias("share"))


_FOLDS = """s AS (SELECT coalesce(site, doc_id) AS g, count(*) AS n FROM pred GROUP BY 1), o AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, md5('21|' || g), g) - 1 AS r FROM s),
f AS (SELECT g, n, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM o)"""


def group_folds(spark, d):
    """(g, n, fold): sites by size, the largest first, dealt to five folds forth and back, so that the folds are alike in size."""
    s = predicted(spark, d).groupBy(F.coalesce("site", "doc_id").alias("g")).agg(F.count("*").alias("n"))
    r = running_sums(s, [F.desc("n"), F.md5(F.concat(F.lit("21|"), "g")), F.col("g")], {"r": F.lit(1)})
    at = F.col("r") % 5
    return r.select("g", "n", F.when(F.floor(F.col("r") / 5) % 2 == 0, at).otherwise(4 - at).cast("int").alias("fold"))


@query(f"WITH {ENCODED_SQL}, {_FOLDS} SELECT fold, count(*) AS groups, sum(n)::BIGINT AS n FROM f GROUP BY 1")
def ml15_group_folds(spark, d):
    """Five folds of nearly one size in which a site stands whole."""
    return group_folds(spark, d).groupBy("fold").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


@query()
def ml15_cross_validation(spark, d):
    """Macro-F1 on each fold of trees fitted on the others, their mean, and whether the mean is above that of always saying the most frequent label."""
    rows = predicted(spark, d).withColumn("g", F.coalesce("site", "doc_id")).join(group_folds(spark, d).select("g", "fold"), "g").withColumn("label", F.col("label_ai").cast("double"))
    e = cut(L.assembled(rows, FEATURES).select("fold", "label", "features"), "folds")
    most = e.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()["label"]
    plain = M.macro_f1(e.withColumn("prediction", F.lit(most)), "label", "prediction").first()["macro_f1"]
    got = [(k, float(M.macro_f1(L.boosted(e.where(F.col("fold") != k), e.where(F.col("fold") == k), "label", trees=5, depth=3), "label", "prediction").first()["macro_f1"])) for k in range(5)]
    mean = sum(f for _, f in got) / 5
    return spark.createDataFrame([(k, round(f, 6), round(mean, 6), mean > plain) for k, f in got], "fold int, macro_f1 double, mean double, learns boolean")


@query()
def ml16_learning_curve(spark, d):
    """Macro-F1 on the test split of trees fitted on a quarter, a half, three quarters and all of the training posts, with three seeds of the draw."""
    train, val, test = _parts(spark, d)
    fit = train.unionByName(val)
    out = []
    for percent in (25, 50, 75, 100):
        for seed in (1, 2, 3) if percent < 100 else (1,):
            part = fit.where(draw(seed, "doc_id") % 100 < percent)
            r = M.macro_f1(L.boosted(part, test, "label", trees=5, depth=3), "label", "prediction").first()
            out.append((percent, seed, float(r["macro_f1"])))
    return spark.createDataFrame(out, "percent int, seed int, macro_f1 double").select("percent", "seed", r6("macro_f1").alias("macro_f1"))


BOOTS, NULLS = 8, 4


@query()
def ml8_core_values(spark, d):
    """Core columns by all six conditions: mean importance in the upper quarter and above the 95th of fits to shuffled labels, in
    the upper quarter in 55 % and among the first three in 60 % of the fits, gap of human and machine values 0.2 or more, spread of the machines 0.35 or less.

    Importance is that of boosted trees (gain), over hash halves of the posts; share is a column's part of it.
    """
    from pyspark.ml.classification import GBTClassifier

    rows = predicted(spark, d).join(doc_splits(spark, d).where("split <> 'test'"), "doc_id").withColumn("label", F.col("label_ai").cast("double"))
    e = cut(L.assembled(rows, FEATURES).select("doc_id", "source", "label", "features"), "core")
    gbt = GBTClassifier(labelCol="y", featuresCol="features", maxIter=5, maxDepth=3, stepSize=0.2, seed=7)

    def importance(df) -> list[float]:
        v = gbt.fit(df).featureImportances.toArray()
        return [float(v[2 * i] + v[2 * i + 1]) for i in range(len(FEATURES))]  # a column and its indicator of nulls

    boots = [(b, c, x) for b in range(BOOTS) for c, x in zip(FEATURES, importance(e.where(draw(40 + b, "doc_id") % 2 == 0).withColumn("y", F.col("label"))))]
    share = e.agg(F.avg("label")).first()[0]
    shuffled = lambda b: (draw(80 + b, "doc_id", "source") < float(share) * 2**32).cast("double")
    nulls = [(b, c, x) for b in range(NULLS) for c, x in zip(FEATURES, importance(e.withColumn("y", shuffled(b))))]
    kind = "b int, col string, v double"
    s, z = spark.createDataFrame(boots, kind), spark.createDataFrame(nulls, kind)
    w = W.partitionBy("b")
    q = s.groupBy("b").agg(F.percentile("v", F.lit(0.75)).alias("q"))
    s = s.withColumn("r", F.rank().over(w.orderBy(F.desc("v")))).join(q, "b")
    m = s.groupBy("col").agg(F.avg("v").alias("importance"), F.avg((F.col("v") >= F.col("q")).cast("int")).alias("stability"), F.avg((F.col("r") <= 3).cast("int")).alias("in_top"))
    one = W.partitionBy(F.lit(1))  # a row a column
    m = m.withColumn("share", F.col("importance") / F.sum("importance").over(one)).join(m.agg(F.percentile("importance", F.lit(0.75)).alias("q75")), F.lit(True))
    m = m.join(z.groupBy("col").agg(F.percentile("v", F.lit(0.95)).alias("null95")), "col").join(ml8_core_rule(spark, d).select("col", "gap", "spread"), "col", "left")
    core = (F.col("importance") >= F.col("q75")) & (F.col("stability") >= 0.55) & (F.col("in_top") >= 0.6) & (F.col("importance") > F.col("null95")) & (F.abs("gap") >= 0.2) & (F.col("spread") <= 0.35)
    return m.select("col", *[r6(c).alias(c) for c in ("importance", "share", "stability", "in_top", "null95", "gap", "spread")], F.coalesce(core, F.lit(False)).alias("core"))


@query()
def ml16_ablation(spark, d):
    """Macro-F1 without each group of features, boosted trees of one configuration."""
    out = []
    for gone in ("none", "f01", "f02", "f03", "f04", "f05", "f06"):
        train, val, test = _parts(spark, d, [c for c in FEATURES if not c.startswith(gone)])
        r = M.macro_f1(L.boosted(train.unionByName(val), test, "label", trees=5, depth=3), "label", "prediction").first()
        out.append((gone, float(r["macro_f1"])))
    return spark.createDataFrame(out, "without string, macro_f1 double").select("without", r6("macro_f1").alias("macro_f1"))


@query(f"""WITH {ENCODED_SQL}, rw AS (SELECT DISTINCT doc_id, regexp_replace(lower(trim(source)), '[ -]+', '_', 'g') AS source FROM rewrites WHERE rewritten_text IS NOT NULL), x AS (SELECT pred.*, rw.doc_id IS NOT NULL AS attacked FROM pred LEFT JOIN rw USING (doc_id, source)),
c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE attacked) AS n_attacked, avg((p1 = label_ai)::INT) AS before, avg((CASE WHEN attacked THEN p2 ELSE p1 END = label_ai)::INT) AS after FROM x GROUP BY 1)
SELECT source, n, n_attacked, round(before, 6) AS accuracy_before, round(after, 6) AS accuracy_after FROM c""")
def ml20_durability(spark, d):
    """Accuracy by source before and after texts with a rewording take the second prediction."""
    rw = table(spark, d, "rewrites").where("rewritten_text IS NOT NULL").select("doc_id", F.regexp_replace(F.lower(F.trim("source")), "[ -]+", "_").alias("source"), F.lit(True).alias("attacked")).distinct()
    x = predicted(spark, d).join(rw, ["doc_id", "source"], "left").withColumn("attacked", F.coalesce("attacked", F.lit(False)))
    after = F.when(F.col("attacked"), F.col("p2")).otherwise(F.col("p1"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.count_if("attacked").alias("n_attacked"), r6(F.avg((F.col("p1") == F.col("label_ai")).cast("int"))).alias("accuracy_before"), r6(F.avg((after == F.col("label_ai")).cast("int"))).alias("accuracy_after"))


@query()
def ml10_core_importance(spark, d):
    """Share of all importance that the core columns of `ml8_core_values` have."""
    v = ml8_core_values(spark, d)
    return v.agg(F.count_if("core").alias("n_core"), r6(F.coalesce(F.sum(F.when(F.col("core"), F.col("share"))), F.lit(0.0))).alias("core_share"))


@query()
def ml20_frozen_model(spark, d):
    """Trees on style vectors, fitted on the training posts and their mirrors as they were, then asked about the test posts before and
    after mirrors are replaced by their rewordings: by source, accuracy before and after."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from loomscribe.functions.style import MEASURES, style_vector

    new = table(spark, d, "rewrites").where(F.col("rewritten_text").rlike(r"[^ \t\r\n]")).groupBy("doc_id", canon_label("source").alias("source")).agg(F.max_by("rewritten_text", "call_id").alias("new"))
    texts = posts(spark, d).select("doc_id", F.lit("human").alias("source"), "text").unionByName(mirror_texts(spark, d).select("doc_id", "source", "text"))
    split = doc_splits(spark, d).select("doc_id", "split").distinct()
    both = texts.join(split, "doc_id").join(new, ["doc_id", "source"], "left")
    was = both.select("doc_id", "source", "split", "text", F.lit("before").alias("stage"), F.col("new").isNotNull().alias("attacked"))
    now = both.where("split = 'test'").select("doc_id", "source", "split", F.coalesce("new", "text").alias("text"), F.lit("after").alias("stage"), F.col("new").isNotNull().alias("attacked"))
    v = style_vector(was.unionByName(now), keep=("doc_id", "source", "split", "stage", "attacked")).withColumn("label", (F.col("source") != "human").cast("double"))
    v = cut(VectorAssembler(inputCols=list(MEASURES), outputCol="features").transform(v).select("source", "split", "stage", "attacked", "label", "features"), "style")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=5, maxDepth=3, stepSize=0.2, seed=7).fit(v.where("split <> 'test' AND stage = 'before'"))
    got = model.transform(v.where("split = 'test'")).withColumn("right", (F.col("prediction") == F.col("label")).cast("int"))
    at = lambda s: F.avg(F.when(F.col("stage") == s, F.col("right")))
    return got.groupBy("source").agg(F.count_if(F.col("stage") == "before").alias("n"), F.count_if((F.col("stage") == "before") & F.col("attacked")).alias("n_attacked"), r6(at("before")).alias("accuracy_before"), r6(at("after")).alias("accuracy_after"))
