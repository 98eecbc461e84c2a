from pyspark.sql import functions as F

from loomscribe.functions import labels, text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f("c").alias("x")).first()["x"]


def test_labels(spark):
    for raw, want in [(" Software-SaaS ", "software_saas"), ("saas", "software_saas"), ("E-Commerce", "e_commerce"), ("", None), ("  ", None), (None, None), ("Other", "services_other")]:
        assert one(spark, raw, labels.canon_vertical) == want
    for raw, want in [(None, False), ("", False), (" \n", False), ("  ​", False), (" x", True)]:
        assert one(spark, raw, labels.not_blank) is want


def test_sites_and_companies(spark):
    for raw, want in [("HTTP://www.Acme.example:80/blog?q=1", "acme.example"), (" acme.example. ", "acme.example"), ("a.b.c.test", "c.test"), ("", None), (None, None), ("user@acme.test", "acme.test")]:
        assert one(spark, raw, urls.site_of) == want
    for raw, want in [("ACME  Tools, S.A.", "acmetools"), ("Acme Tools GmbH", "acmetools"), ("Inc.", "inc"), ("", None), (None, None), ("Müller & Söhne B.V.", "müllersöhne")]:
        assert one(spark, raw, urls.company_key) == want


def test_word_counts_and_grams(spark):
    assert one(spark, "naïve Straße a 12 b_c", text.word_count) == 4
    assert one(spark, None, text.word_count) == 0
    for n, want in [(1, []), (4, []), (5, ["w1 w2 w3 w4 w5"]), (6, ["w1 w2 w3 w4 w5", "w2 w3 w4 w5 w6"])]:
        df = spark.createDataFrame([([f"w{i + 1}" for i in range(n)],)], "t array<string>")
        assert df.select(text.ngrams(F.col("t"), 5).alias("g")).first()["g"] == want


def test_markdown_and_furniture(spark):
    cases = [("# Title\ntext", "Title\ntext"), ("**bold** and *it*", "bold and it"), ("- item\n2. two", "item\ntwo"), ("> quote", "quote"), ("`code`", "code"), ("![alt](x.png) after", " after"), ("[link](http://a) end", "link end"),
             ("a\n---\nb", "a\n\nb"), ("2 * 3 * 4 = 24", "2  3  4 = 24"), ("snake_case stays", "snake_case stays")]
    for raw, want in cases:
        assert one(spark, raw, text.strip_markdown) == want
    assert one(spark, "Table of contents\nreal line\nShare this post\nShare this with everyone in your team because it matters a lot", text.drop_furniture) == "real line\nShare this with everyone in your team because it matters a lot"
    assert one(spark, "  a \t b\n\n\n\nc  ", text.normalised) == "a b\n\nc"


def test_language(spark):
    df = spark.createDataFrame([("the cost of the work",), ("der Preis und die Arbeit",), ("les prix et la vente",), ("12 34",), (None,), ("",)], "c string")
    got = [r["x"] for r in df.select(text.language(text.language_votes("c")).alias("x")).collect()]
    assert got == ["en", "de", "fr", "other", "other", "other"]


def test_tags(spark):
    assert one(spark, "<div><p>A &amp; B</p><script>x()</script>C<br>D</div>", text.strip_tags).split() == ["A", "&", "B", "C", "D"]
