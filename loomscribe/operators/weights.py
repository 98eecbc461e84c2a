"""Term weights of texts as long tables: no vocabulary is held in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.text import words
from loomscribe.runtime import cut


def tfidf(docs: DataFrame, longest: int = 2, min_docs: int = 3, most_terms: int | None = None) -> DataFrame:
    """(doc_id, term, weight, length) of docs(doc_id, text): unit vectors of 1 + ln tf times smooth idf plus 1.

    Terms are runs of one to `longest` words that stand in at least min_docs documents; with most_terms only the most frequent
    ones (ties to the smaller term). length is the vector's length before it is scaled. Documents without a term have no rows;
    every row of docs counts as a document. Terms meet their counts in a join; a document's terms, its window, are its own words.
    """
    w = docs.select("doc_id", words("text").alias("w"))

    def runs(n):
        each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))
        return F.when(F.size("w") >= n, each).otherwise(F.array().cast("array<string>"))

    tf = cut(w.select("doc_id", F.explode(F.concat(F.col("w"), *map(runs, range(2, longest + 1)))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "tf")
    n = docs.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where(F.col("df") >= min_docs)
    if most_terms is not None:
        df = df.orderBy(F.desc("all"), "term").limit(most_terms)
    x = tf.join(df.select("term", "df"), "term").withColumn("x", (1 + F.log("tf")) * (F.log(F.lit(1 + n) / (1.0 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("doc_id")))
    return x.select("doc_id", "term", (F.col("x") / length).alias("weight"), length.alias("length"))
