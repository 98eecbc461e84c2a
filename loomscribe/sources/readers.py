"""Readers of the corpus' file formats, each a DataFrame with a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomscribe.operators.relational import capped

FRAME = "domain string, company string, vertical string, region string, stratum string, industry_raw string, employees string, country string, source_ref string"


def csv_frame(spark: SparkSession, path: str, schema: str = FRAME, key: str = "domain") -> DataFrame:
    """CSV files of a frame as trimmed strings, blanks as null, rows without key left out; file_stem is the file's name."""
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    cols = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns]
    stem = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]*$", "")
    return raw.select(*cols, stem.alias("file_stem")).where(F.col(key).isNotNull())


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append log of JSON lines; blank lines and lines cut off by a crash are left out."""
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad IS NULL").drop("_bad")


def json_map(spark: SparkSession, path: str, field: str, key: str = "key", value: str = "value") -> DataFrame:
    """The entries of one map field of a JSON document, a row each."""
    raw = spark.read.schema(f"{field} map<string,string>").option("multiLine", True).json(path)
    return raw.select(F.explode(field).alias(key, value))


def fenced_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first fenced JSON block of each Markdown file, parsed."""
    raw = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", r"(?s)```json\s*(.*?)```", 1)
    return raw.select(F.from_json(block, schema).alias("x")).where("x IS NOT NULL").select("x.*")


def html_rows(pages: DataFrame, html: str, least_cells: int = 1) -> DataFrame:
    """Table rows of pages: one row for each <tr>, with its cells as an array of plain texts; other columns are kept."""
    piece = lambda c, tag: F.slice(F.split(c, tag), 2, 1_000_000)  # noqa: E731  what follows each opening tag
    rows = F.explode(piece(F.col(html), r"(?i)<tr\b[^>]*>"))
    cells = F.transform(piece(F.col("_tr"), r"(?i)<t[dh]\b[^>]*>"), lambda c: F.get(F.split(c, r"(?i)</(?:t[dhr]|table|tbody)\s*>"), F.lit(0)))
    note, tags = r"\[[0-9a-z]{1,3}\]", r"<[^<>]*>"
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, f"{note}|{tags}", ""), r"\s+", " ")))
    out = pages.select("*", rows.alias("_tr")).select("*", plain.alias("cells")).drop("_tr", html)
    return out.where(F.size("cells") >= least_cells)


def pick_table(pages: DataFrame, html: str, header: str, least_rows: int = 20, key: str = "page_id") -> DataFrame:
    """(key, cells): the rows below the header of each page's first table whose first row matches the pattern and that has at least least_rows rows."""
    tables = F.posexplode(F.slice(F.split(F.col(html), r"(?i)<table\b[^>]*>"), 2, 1_000_000)).alias("_at", "_table")
    t = pages.select(key, tables).withColumn("_table", F.get(F.split("_table", r"(?i)</table\s*>"), F.lit(0)))
    first = F.get(F.split("_table", r"(?i)</tr\s*>"), F.lit(0))
    t = t.where(first.rlike(header) & (F.regexp_count("_table", F.lit(r"(?i)<tr\b")) >= least_rows + 1))
    t = t.groupBy(key).agg(F.min_by("_table", "_at").alias("_table"))
    return html_rows(t.withColumn("_body", F.regexp_replace("_table", r"(?is)^.*?</tr\s*>", "")).select(key, "_body"), "_body")


def archive_lines(spark: SparkSession, path: str, upto: str = "99999999999999") -> DataFrame:
    """(timestamp, url, mimetype, status) of archive index files up to a time; headers and broken lines are left out.

    The files are read as text by all executors, wherever they lie.
    """
    part = F.split("value", " ")
    rows = spark.read.text(path).where((F.size(part) == 4) & part[3].rlike("^[0-9]+$") & (part[0] <= upto))
    return rows.select(part[0].alias("timestamp"), part[1].alias("url"), part[2].alias("mimetype"), part[3].cast("int").alias("status"))


def html_links(pages: DataFrame, html: str, per_page: int = 50, key: str = "page_id", reject: str = r"(?i)^(home|log ?in|sign up|privacy|terms|contact|next|previous|more)$") -> DataFrame:
    """Links of pages with their label, in order, labels of navigation left out, the first of each label, at most per_page a page."""
    pat = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    urls, labels = F.regexp_extract_all(html, F.lit(pat), 1), F.regexp_extract_all(html, F.lit(pat), 2)
    x = pages.select(key, F.posexplode(F.arrays_zip(urls.alias("u"), labels.alias("l"))).alias("place", "x"))
    x = x.select(key, "place", F.col("x.u").alias("url"), F.trim(F.regexp_replace(F.regexp_replace("x.l", "<[^>]+>", ""), r"\s+", " ")).alias("label"))
    x = x.where((F.col("label") != "") & ~F.col("label").rlike(reject))
    first = x.groupBy(key, F.lower("label").alias("_k")).agg(F.min_by(F.struct("place", "url", "label"), "place").alias("f")).select(key, "f.*")
    return capped(first, [key], [F.col("place")], per_page)


# How much of a page is read for its title, and how long title and description may be.
HEAD_CHARS, TITLE_CHARS, DESCRIPTION_CHARS = 20_000, 150, 200


def page_title(html: str) -> Column:
    """Title and meta description of a page, from the part of it that may hold them; the description's attributes in any order."""
    head = F.substring(html, 1, HEAD_CHARS)
    tidy = lambda c, n: F.nullif(F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n), F.lit(""))
    inside = F.substring_index(F.regexp_substr(head, F.lit(r"(?is)<title\b[^>]*>[^<]*")), ">", -1)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)(<meta\s[^>]*>)"), 1)
    about = F.filter(tags, lambda x: x.rlike(r"""(?i)\bname\s*=\s*["']?description\b"""))
    said = F.coalesce(F.get(about, F.lit(0)), F.lit(""))
    double, single = (F.regexp_extract(said, rf"(?is)\bcontent\s*=\s*{q}([^{q}]*){q}", 1) for q in ('"', "'"))
    return F.concat_ws(" | ", tidy(inside, TITLE_CHARS), tidy(F.coalesce(F.nullif(double, F.lit("")), single), DESCRIPTION_CHARS))


class ArchiveIndex(DataSource):
    """format("archive_index"): (timestamp, url, mimetype, status) of index files; one partition a file, as a live index has one a query.

    Options: paths (files separated by ;), upto (last timestamp). The first line of a file is a header.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_index"

    def schema(self) -> str:
        return "timestamp string, url string, mimetype string, status int"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("paths", "").split(";") if p]
        self.upto = options.get("upto", "99999999999999")

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value) as f:
            next(f, None)
            for line in f:
                parts = line.rstrip("\n").split(" ")
                if len(parts) == 4 and parts[3].isdigit() and parts[0] <= self.upto:
                    yield parts[0], parts[1], parts[2], int(parts[3])
