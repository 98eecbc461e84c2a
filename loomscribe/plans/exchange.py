"""Round trips: given tables written through the sinks, read back through the readers, and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomscribe.plans.base import canon_label, label_sql, query, r6, table
from loomscribe.runtime import workdir
from loomscribe.sources import readers, sinks

CONTRACT = ("domain", "company", "vertical", "region", "stratum", "industry_raw", "employees", "country", "source_ref")
_KEY = "nullif(trim({0}), '')"


def _place(spark, name: str) -> str:
    return f"{workdir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query(f"""SELECT coalesce({label_sql('stratum')}, '-') AS stratum, count(*) AS n, count(DISTINCT trim(company)) AS companies, count({_KEY.format('employees')}) AS with_employees
FROM site_frame WHERE {_KEY.format('domain')} IS NOT NULL GROUP BY 1""")
def snk1_csv_round_trip(spark, d):
    """The frame as a contract CSV and back."""
    path = _place(spark, "frame")
    t = table(spark, d, "site_frame").where(F.nullif(F.trim("domain"), F.lit("")).isNotNull())
    sinks.write_csv(t, path, CONTRACT)
    back = readers.csv_frame(spark, path)
    has = lambda c: F.nullif(F.trim(c), F.lit(""))
    return back.groupBy(F.coalesce(canon_label("stratum"), F.lit("-")).alias("stratum")).agg(F.count("*").alias("n"), F.count_distinct(has("company")).alias("companies"), F.count(has("employees")).alias("with_employees"))


@query(f"""SELECT {label_sql('source')} AS source, 2 * count(*) AS n, count(DISTINCT call_id) AS calls, 2 * sum(length(text)) AS chars FROM mirrors GROUP BY 1""")
def src5_json_log_round_trip(spark, d):
    """The call log appended twice as JSON lines and read back with its schema."""
    path = _place(spark, "log")
    t = table(spark, d, "mirrors").select("call_id", "source", "text")
    for _ in range(2):
        sinks.append_log(t, path)
    back = readers.json_log(spark, path, "call_id long, source string, text string")
    return back.groupBy(canon_label("source").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("call_id").alias("calls"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("""SELECT count(*) AS n, count(doc_id) AS ids, count(try_cast(seed AS VARCHAR)) AS seeds, 0 AS added, count(try_cast(domain AS DOUBLE)) AS cast_domains FROM splits""")
def snk5_migrated_schema(spark, d):
    """Old rows under the current schema: a new column is null, a column of another type is cast where it can be."""
    m = sinks.migrate(table(spark, d, "splits"), [("doc_id", "string"), ("seed", "string"), ("added", "double"), ("domain", "double")])
    return m.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.count("seed").alias("seeds"), F.count("added").alias("added"), F.count("domain").alias("cast_domains"))


@query(f"""SELECT coalesce({label_sql('source')}, '-') AS part, count(*) AS n, round(avg(f02__ord), 6) AS mean FROM features_encoded GROUP BY 1""")
def snk6_export_round_trip(spark, d):
    """The matrix exported by source, a folder each, and read back by folder."""
    path = _place(spark, "export")
    t = table(spark, d, "features_encoded").withColumn("part", F.coalesce(canon_label("source"), F.lit("-")))
    sinks.export_by(t.select("doc_id", "f02__ord", "part"), path, "part")
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), r6(F.avg("f02__ord")).alias("mean"))


@query("""SELECT 'splits' AS name, count(*) AS rows, true AS same FROM splits""")
def snk10_manifest(spark, d):
    """The digest of a table is that of the same rows in other files and another order."""
    path = _place(spark, "copy")
    t = table(spark, d, "splits")
    t.repartition(7, "doc_id").write.parquet(path)
    a, b = sinks.manifest(t, "splits"), sinks.manifest(spark.read.schema(t.schema).parquet(path), "splits")
    return a.join(b.select("name", F.col("digest").alias("other")), "name").select("name", "rows", (F.col("digest") == F.col("other")).alias("same"))


@query(f"""SELECT {label_sql('stratum')} AS stratum, count(*) AS n, sum(length(regexp_replace(trim(domain), '\\s+', ' ', 'g'))) AS chars FROM site_frame WHERE domain NOT LIKE '%<%' AND trim(domain) <> '' AND company NOT LIKE '%<%' GROUP BY 1""")
def src10_html_round_trip(spark, d):
    """Rows of the frame as rows of an HTML table and back as cells."""
    t = table(spark, d, "site_frame").where("domain NOT LIKE '%<%' AND trim(domain) <> '' AND company NOT LIKE '%<%'")
    page = F.concat(F.lit("<table class='x'><TR><TD>"), "domain", F.lit("</TD>\n<td align=left><b>"), "company", F.lit("</b></td></tr></table>"))
    rows = readers.html_rows(t.select(canon_label("stratum").alias("stratum"), page.alias("html")), "html", 2)
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), F.sum(F.length(F.get("cells", F.lit(0))).cast("long")).alias("chars"))


@query(r"""SELECT doc_id, regexp_replace(trim(title), '\s+', ' ', 'g') AS label, url FROM (SELECT doc_id, title, url, row_number() OVER (PARTITION BY doc_id ORDER BY url, title) AS r FROM story_human_frozen WHERE doc_id IS NOT NULL AND title NOT LIKE '%<%' AND trim(title) <> '' AND url NOT LIKE '%"%' AND url <> '') WHERE r = 1""")
def src12_links_round_trip(spark, d):
    """One link for each post, found again in a page with navigation around it."""
    t = table(spark, d, "story_human_frozen").where("""doc_id IS NOT NULL AND title NOT LIKE '%<%' AND trim(title) <> '' AND url NOT LIKE '%"%' AND url <> ''""")
    t = t.groupBy("doc_id").agg(F.min(F.struct("url", "title")).alias("x")).select("doc_id", "x.*")
    page = F.concat(F.lit('<a href="/">Home</a><p><a class="c" href="'), "url", F.lit('"><i>'), "title", F.lit("</i></a><a href='/p'>Privacy</a>"))
    return readers.html_links(t.select("doc_id", page.alias("html")), "html", key="doc_id").select("doc_id", "label", "url")


@query(r"""SELECT doc_id, left(regexp_replace(trim(title), '\s+', ' ', 'g'), 150) || ' | ' || 'About ' || doc_id AS head FROM documents WHERE title NOT LIKE '%<%' AND trim(title) <> ''""")
def src16_title_round_trip(spark, d):
    t = table(spark, d, "documents").where("title NOT LIKE '%<%' AND trim(title) <> ''")
    page = F.concat(F.lit("<head><title lang='en'>\n"), "title", F.lit("</title><meta content='About "), F.col("doc_id").cast("string"), F.lit("' name='description'></head>"))
    return t.select("doc_id", page.alias("html")).select("doc_id", readers.page_title("html").alias("head"))


@query(f"""SELECT {label_sql('source')} AS source, count(*) AS n, round(avg(words), 6) AS mean_words, 7 AS seed FROM mirrors GROUP BY 1""")
def snk7_json_report(spark, d):
    """A report of the call log with its facts, written and read back."""
    path = _place(spark, "report")
    t = table(spark, d, "mirrors").groupBy(canon_label("source").alias("source")).agg(F.count("*").alias("n"), r6(F.avg("words")).alias("mean_words"))
    sinks.json_report(t, path, seed=7)
    return spark.read.schema("source string, n long, mean_words double, seed int").json(path)


@query(f"""SELECT '| ' || coalesce({label_sql('source')}, '-') || ' | ' || count(*) || ' | ' || printf('%.3f', round(avg(words), 3)) || ' |' AS line FROM mirrors GROUP BY {label_sql('source')}""")
def snk8_markdown_rows(spark, d):
    t = table(spark, d, "mirrors").groupBy(canon_label("source").alias("source")).agg(F.count("*").alias("n"), F.round(F.avg("words"), 3).alias("words"))
    return sinks.markdown_rows(t)


@query(f"""SELECT {label_sql('stratum')} AS stratum, count(*) AS n, 5 AS files FROM site_frame WHERE {_KEY.format('domain')} IS NOT NULL GROUP BY 1""")
def src2_glob_round_trip(spark, d):
    """The frame in five files, found again by a pattern on their names."""
    path = _place(spark, "frame")
    t = table(spark, d, "site_frame").where(F.nullif(F.trim("domain"), F.lit("")).isNotNull())
    sinks.write_csv(t.repartition(5), path, CONTRACT)
    back = readers.csv_frame(spark, f"{path}/part-*.csv")
    files = back.agg(F.count_distinct("file_stem")).first()[0]
    return back.groupBy(canon_label("stratum").alias("stratum")).agg(F.count("*").alias("n"), F.lit(files).alias("files"))


@query(r"""SELECT substr(snapshot_ts, 1, 4) AS year, count(*) AS n, count(DISTINCT url) AS urls FROM story_human_frozen WHERE regexp_matches(snapshot_ts, '^[0-9]{14}$') AND regexp_matches(url, '^[^ ]+$') AND snapshot_ts <= '20221031' GROUP BY 1""")
def src13_archive_index(spark, d):
    """Snapshots as lines of an archive index, read back up to a day."""
    path = _place(spark, "index")
    t = table(spark, d, "story_human_frozen").where(F.col("snapshot_ts").rlike("^[0-9]{14}$") & F.col("url").rlike("^[^ ]+$"))
    t.select(F.concat_ws(" ", "snapshot_ts", "url", F.lit("text/html"), F.lit("200")).alias("value")).write.text(path)
    return readers.archive_lines(spark, path, "20221031").groupBy(F.substring("timestamp", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query(f"""SELECT coalesce({label_sql('stratum')}, '-') AS stratum, 5 * count(*) AS n, count(DISTINCT regexp_replace(trim(domain), '\\s+', ' ', 'g')) AS domains FROM site_frame WHERE domain NOT LIKE '%<%' AND trim(domain) <> '' GROUP BY 1""")
def src11_picked_tables(spark, d):
    """A page for each row of the frame, with a menu, a short table and one that names its site five times, which alone is picked."""
    t = table(spark, d, "site_frame").where("domain NOT LIKE '%<%' AND trim(domain) <> ''").withColumn("page_id", F.monotonically_increasing_id())
    row = F.concat(F.lit("<tr><td>"), "domain", F.lit("</td></tr>"))
    page = F.concat(F.lit("<table><tr><td>Menu</td></tr></table><table><tr><th>Domain</th></tr>"), row, F.lit("</table><TABLE id=x><tr><th>Domain</th></tr>"), F.repeat(row, F.lit(5)), F.lit("</TABLE>"))
    pages = t.select("page_id", F.concat_ws("|", F.coalesce(canon_label("stratum"), F.lit("-")), "page_id").alias("key"), page.alias("html"))
    rows = readers.pick_table(pages, "html", "(?i)<th>domain", 5, "key")
    return rows.groupBy(F.substring_index("key", "|", 1).alias("stratum")).agg(F.count("*").alias("n"), F.count_distinct(F.get("cells", F.lit(0))).alias("domains"))
