"""Pages' structured data: nesting, graphs, lists, broken pages."""

from pyspark.sql import functions as F

from shelfmark.operators import pages, structured
from shelfmark.plans import jobs

LD = '<script type="application/ld+json">%s</script>'


def facts(html):
    return structured.Page(html).facts()


def pairs(html):
    return [(p["name"], p["value"]) for p in facts(html)["pairs"]]


def test_products_at_any_depth():
    deep = '{"@graph":[{"@type":"WebPage"},{"@graph":[[{"@type":["A","Product"],"name":" In &  out ","mpn":7}]]}],"@type":"Product","name":"holder","model":"M","sku":"S"}'
    got = facts(LD % deep + LD % "[1, null, \"Product\"]" + LD % "{broken" + LD % "" + "<script>{\"@type\":\"Product\"}</script>")["products"]
    # those of a graph come before the object that holds it
    assert [(p["name"], p["model"]) for p in got] == [("In & out", "7"), ("holder", "M")]
    assert facts(LD % ('[' * 3000))["products"] == []


def test_properties_and_brands():
    one = '{"@type":"Product","brand":{"name":"B"},"additionalProperty":[{"name":"Цвет","value":"Белый"},{"name":"","value":"x"},"y",{"name":"N","value":null},{"name":"V","value":1.5}]}'
    html = LD % one + "<dl><dt>цвет</dt><dd>белый</dd><dt>Ещё</dt><dd>да</dd></dl>"
    got = facts(html)
    assert got["products"][0]["brand"] == "B" and [tuple(p.values()) for p in got["products"][0]["properties"]] == [("Цвет", "Белый"), ("N", ""), ("V", "1.5")]
    # what a product says already is no pair
    assert pairs(html) == [("Ещё", "да")]


def test_rows_within_rows():
    html = "<table><tr><td>outer</td><td>a <table><tr><th>inner</th><td>b</td></tr></table></td></tr><tr><td>one</td></tr><tr><div><td>x</td><td>y</td></div></tr></table>"
    assert pairs(html) == [("outer", "a inner b"), ("inner", "b"), ("x", "y")]
    assert pairs("<tr><td>a</td><td>b</td></tr>") == [] and pairs('<div class="big properties"><tr><td>a</td><td>b</td></tr></div>') == [("a", "b")]
    assert pairs("<table><tr><td>same</td><td>same</td></tr><tr><td></td><td>x</td></tr><tr><td>&lt;b&gt;</td><td>1<script>no</script><br/>2</td></tr></table>") == [("<b>", "1 2")]


def test_terms_and_their_definitions():
    assert pairs("<dl><dt>a</dt><dt>b</dt><p>x</p><dd>1</dd><dd>2</dd><dt>c</dt></dl><dt>d</dt><dd>3</dd>") == [("a", "1"), ("b", "1")]
    assert pairs("<dl><div><dt>a</dt></div><dd>1</dd></dl>") == []  # no sibling


def test_heading_crumbs_and_broken_pages():
    got = facts('<nav class="breadcrumbs x"><a>A</a><span><a>B<b>C</b></a></span><a>A</a><a> </a></nav><li itemprop="itemListElement"><a>D</a></li><a>no</a><h1>One <i>name</h1><h1>two</h1></nav></p>')
    assert got["crumbs"] == ["A", "B C", "D"] and got["heading"] == "One name"
    assert facts("<h1>unclosed <b>title")["heading"] == "unclosed title" and facts("<<<>>&#x;<!-- <h1>x</h1> --><![CDATA[ <h1>")["heading"] == ""
    assert facts("<div>" * 20_000 + "<table><tr><td>a</td><td>b</td></tr></table>")["pairs"] == [{"name": "a", "value": "b"}]


def test_last_field_that_says_anything_wins(spark):
    two = '[{"@type":"Product","name":"first","brand":"B","category":"C"},{"@type":"Product","name":"second","brand":"","sku":"S"}]'
    rows = [("u", LD % two + "<h1>h</h1>"), ("v", "<h1>h</h1><table><tr><td>SKU</td><td>7</td></tr></table>"), ("w", None), ("x", ""), ("u", LD % two)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "url string, html string, name string, pos int")
    got = {tuple(r) for r in pages.page_product(df).drop("attributes").collect()}
    assert got == {("u", "second", "S", "B", "C"), ("v", "h", "7", "", ""), ("w", "", "", "", ""), ("x", "", "", "", "")}
    t = spark.createDataFrame([(1, "c")], "template_id int, name string")
    assert {(r["url"], r["name"], r["template_id"]) for r in jobs.batch_from_pages(df, t).collect()} == {("u", "second", 1), ("v", "h", None), ("w", "", None), ("x", "", None)}
    assert pages.extract_jsonld(df).count() == 4 and pages.extract_pairs(df).count() == 1
    assert pages.page_fallbacks(df.where("url = 'v'")).select("model").first()[0] == "7"


def test_pages_without_any_stay_in_the_jvm(spark):
    assert spark.createDataFrame([("<p>no facts</p>",)], "html string").select(structured.page_facts(F.col("html")).alias("f")).first()["f"].asDict() == structured.NOTHING
