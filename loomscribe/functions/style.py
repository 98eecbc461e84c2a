"""A style vector of 144 measures of a text, all in Spark columns: lengths, vocabulary, function words, punctuation, speech, readability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscribe.functions.text import PARTS

# The hundred function words, the marks that are counted, and those stripped from the ends of words.
FUNCTION_WORDS = (
    "the of and a to in is that it for on with as are was be this by an at or from but not have has had they you we "
    "he she i their its our your my his her them us him me who which what when where how why can could should would will may might must do "
    "does did done being been if then than so because while although though however therefore moreover also just only very "
    "more most much many some any all both each few no nor yet after before during between among through over").split()
MARKS = {"comma": ",", "semicolon": ";", "colon": ":", "question": "?", "exclamation": "!", "hyphen": "-", "open": "(", "close": ")", "quote": '"', "apostrophe": "'", "percent": "%", "dollar": "$"}
ENDS = ".,;:!?\"'()"

LENGTHS = ("n_words", "n_chars", "n_sentences", "word_mean", "word_sd", "word_max", "sentence_mean", "sentence_sd", "sentence_max", "sentence_min", "n_paragraphs", "paragraph_words")
VOCABULARY = ("type_token", "hapax", "dis", "yule_k", "root_ttr", "vocabulary_word_length", "long_words", "short_words")
SPEECH = ("quotes", "quotes_per_sentence", "quoted_words", "quote_length", "said", "asked_quotes")
READABILITY = ("flesch", "grade", "fog", "ari", "syllables_per_word", "many_syllables")
MEASURES = (*LENGTHS, *VOCABULARY, *(f"fw_{w}" for w in FUNCTION_WORDS), *(f"mark_{m}" for m in MARKS), *SPEECH, *READABILITY)


def _sd(n, total, squares):
    """Standard deviation from whole-number sums, without loss where all are equal."""
    return F.sqrt((n * squares - total * total).cast("double")) / n


def _count(text, what: str):
    """How often a string stands in a text, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def style_vector(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the 144 MEASURES of every text with at least one word; texts of other rows are left out."""
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    size = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    square = lambda c: F.transform(c, lambda x: x * x)
    t = docs.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_t"), F.lower(text).alias("_low"), F.regexp_extract_all(text, F.lit(f"({PARTS})"), 1).alias("_w")).where(F.size("_w") > 0)
    parts = F.filter(F.split("_t", r"[.!?]+[ \t\r\n]"), lambda x: x.rlike(PARTS))
    t = t.withColumns({
        "_tok": F.transform("_w", lambda x: F.btrim(F.lower(x), F.lit(ENDS))), "_wl": size("_w"),
        "_sl": F.transform(parts, lambda x: F.regexp_count(x, F.lit(PARTS)).cast("long")), "_q": F.regexp_extract_all("_t", F.lit('"([^"]{2,400})"'), 1)})
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("string").alias("p"), zero.alias("r"), zero.alias("one"), zero.alias("two"), zero.alias("sq"), zero.alias("v"), zero.alias("ch"))

    def closed(a):
        r = a["r"]
        return a["one"] + (r == 1).cast("long"), a["two"] + (r == 2).cast("long"), a["sq"] + r * r, a["v"] + (r > 0).cast("long"), a["ch"] + F.when(r > 0, F.length(a["p"])).otherwise(0).cast("long")

    def step(a, x):
        one, two, sq, v, ch = closed(a)
        same = F.coalesce(a["p"] == x, F.lit(False))
        return F.struct(x.alias("p"), F.when(same, a["r"] + 1).otherwise(F.lit(1).cast("long")).alias("r"), *[F.when(same, a[k]).otherwise(c).alias(k) for k, c in zip(("one", "two", "sq", "v", "ch"), (one, two, sq, v, ch))])

    def finish(a):
        return F.struct(*[c.alias(k) for k, c in zip(("one", "two", "sq", "v", "ch"), closed(a))])

    t = t.withColumns({
        "_v": F.aggregate(F.array_sort("_tok"), start, step, finish), "_syl": F.transform("_tok", lambda x: F.when(x == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouy]+")))).cast("long")),
        "_n": F.size("_w").cast("long"), "_s": F.greatest(F.size("_sl"), F.lit(1)).cast("long"), "_p": _count(F.col("_t"), "\n\n").cast("long") + 1, "_ql": F.transform("_q", lambda x: F.regexp_count(x, F.lit(PARTS)).cast("long"))})
    n, s, p = F.col("_n"), F.col("_s"), F.col("_p")
    k = F.greatest(F.size("_sl"), F.lit(1)).cast("long")
    chars, syl = F.length("_t").cast("long"), F.greatest(add(F.col("_syl")), F.lit(1).cast("long"))
    many = F.size(F.filter("_syl", lambda x: x >= 3)) / n
    nq = F.size("_q")
    asked = F.size(F.filter("_q", lambda x: x.rlike(r"[?][ \t\r\n]*$")))
    values = {
        "n_words": n, "n_chars": chars, "n_sentences": s, "word_mean": add(F.col("_wl")) / n, "word_sd": _sd(n, add(F.col("_wl")), add(square("_wl"))), "word_max": F.array_max("_wl"),
        "sentence_mean": add(F.col("_sl")) / k, "sentence_sd": _sd(k, add(F.col("_sl")), add(square("_sl"))), "sentence_max": F.coalesce(F.array_max("_sl"), zero), "sentence_min": F.coalesce(F.array_min("_sl"), zero),
        "n_paragraphs": p, "paragraph_words": n / p,
        "type_token": F.col("_v.v") / n, "hapax": F.col("_v.one") / n, "dis": F.col("_v.two") / n, "yule_k": F.lit(1e4) * (F.col("_v.sq") - n) / (n * n), "root_ttr": F.col("_v.v") / F.sqrt(n.cast("double")),
        "vocabulary_word_length": F.col("_v.ch") / F.col("_v.v"), "long_words": F.size(F.filter("_tok", lambda x: F.length(x) >= 7)) / n, "short_words": F.size(F.filter("_tok", lambda x: F.length(x) <= 3)) / n,
        **{f"fw_{w}": _count(F.col("_low"), f" {w} ") / n for w in FUNCTION_WORDS}, **{f"mark_{m}": _count(F.col("_t"), c) / n for m, c in MARKS.items()},
        "quotes": nq, "quotes_per_sentence": nq / s, "quoted_words": add(F.col("_ql")) / n, "quote_length": F.coalesce(F.try_divide(add(F.col("_ql")), nq), F.lit(0.0)),
        "said": _count(F.col("_low"), " said ") / s, "asked_quotes": asked / F.greatest(nq, F.lit(1)),
        "flesch": 206.835 - 1.015 * n / s - 84.6 * syl / n, "grade": 0.39 * n / s + 11.8 * syl / n - 15.59, "fog": 0.4 * (n / s + 100 * many), "ari": 4.71 * chars / n + 0.5 * n / s - 21.43,
        "syllables_per_word": syl / n, "many_syllables": many}
    return t.select(*keep, *[values[m].cast("double").alias(m) for m in MEASURES])


def style_sql(table: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    """The same measures in SQL, each rounded to 5 digits."""
    parts = PARTS.replace("\\", "\\")
    count = lambda c, w: f"((length({c}) - length(replace({c}, '{w.replace(chr(39), chr(39) * 2)}', ''))) / {float(len(w))})"
    sd = lambda n, x: f"sqrt(({n} * list_sum(list_transform({x}, lambda y: y * y)) - list_sum({x}) * list_sum({x}))::DOUBLE) / {n}"
    ends = ENDS.replace("'", "''")
    v = {
        "n_words": "n", "n_chars": "length(t)", "n_sentences": "s", "word_mean": "list_sum(wl)::DOUBLE / n", "word_sd": sd("n", "wl"), "word_max": "list_max(wl)", "sentence_mean": "coalesce(list_sum(sl), 0)::DOUBLE / s",
        "sentence_sd": f"coalesce({sd('s', 'sl')}, 0)", "sentence_max": "coalesce(list_max(sl), 0)", "sentence_min": "coalesce(list_min(sl), 0)", "n_paragraphs": "p", "paragraph_words": "n::DOUBLE / p",
        "type_token": "len(c)::DOUBLE / n", "hapax": "len(list_filter(c, lambda x: x = 1))::DOUBLE / n", "dis": "len(list_filter(c, lambda x: x = 2))::DOUBLE / n",
        "yule_k": "1e4 * (list_sum(list_transform(c, lambda x: x * x)) - n)::DOUBLE / (n * n)", "root_ttr": "len(c) / sqrt(n::DOUBLE)", "vocabulary_word_length": "list_sum(list_transform(list_distinct(tok), lambda x: length(x)))::DOUBLE / len(c)",
        "long_words": "len(list_filter(tok, lambda x: length(x) >= 7))::DOUBLE / n", "short_words": "len(list_filter(tok, lambda x: length(x) <= 3))::DOUBLE / n",
        **{f"fw_{w}": f"{count('low', f' {w} ')} / n" for w in FUNCTION_WORDS}, **{f"mark_{m}": f"{count('t', c)} / n" for m, c in MARKS.items()},
        "quotes": "len(q)", "quotes_per_sentence": "len(q)::DOUBLE / s", "quoted_words": "coalesce(list_sum(ql), 0)::DOUBLE / n", "quote_length": "coalesce(list_sum(ql)::DOUBLE / nullif(len(q), 0), 0)",
        "said": f"{count('low', ' said ')} / s", "asked_quotes": r"len(list_filter(q, lambda x: regexp_matches(x, '[?][ \t\r\n]*$')))::DOUBLE / greatest(len(q), 1)",
        "flesch": "206.835 - 1.015 * n / s - 84.6 * syl / n", "grade": "0.39 * n / s + 11.8 * syl / n - 15.59", "fog": "0.4 * (n::DOUBLE / s + 100.0 * many / n)", "ari": "4.71 * length(t) / n + 0.5 * n / s - 21.43",
        "syllables_per_word": "syl::DOUBLE / n", "many_syllables": "many::DOUBLE / n"}
    return rf"""WITH a AS (SELECT {key}, {text} AS t, lower({text}) AS low, regexp_extract_all({text}, '{parts}') AS w FROM {table} WHERE {text} IS NOT NULL),
b AS (SELECT *, len(w) AS n, list_transform(w, lambda x: trim(lower(x), '{ends}')) AS tok, list_transform(w, lambda x: length(x)) AS wl, list_transform(list_filter(string_split_regex(t, '[.!?]+[ \t\r\n]'), lambda x: regexp_matches(x, '{parts}')), lambda x: len(regexp_extract_all(x, '{parts}'))) AS sl,
 regexp_extract_all(t, '"([^"]{{2,400}})"', 1) AS q, ((length(t) - length(replace(t, chr(10) || chr(10), ''))) // 2) + 1 AS p FROM a WHERE len(w) > 0),
d AS (SELECT *, greatest(len(sl), 1) AS s, map_values(list_aggregate(tok, 'histogram')) AS c, list_transform(tok, lambda x: CASE WHEN x = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))) END) AS y, list_transform(q, lambda x: len(regexp_extract_all(x, '{parts}'))) AS ql FROM b),
e AS (SELECT *, greatest(list_sum(y), 1) AS syl, len(list_filter(y, lambda x: x >= 3)) AS many FROM d)
SELECT {key}, {', '.join(f"round(({x})::DOUBLE + 1e-9, 5) AS {m}" for m, x in v.items())} FROM e"""
