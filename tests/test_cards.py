"""Nested and broken cards."""

import pytest
from pyspark.sql import functions as F

from paperlake.sources import cards as C

ITEM = C.Rule(C.Select("li", css_class="paper"), {"title": C.Select(css_class="title"), "author": C.Select(css_class="author"), "link@href": C.Select("a")}, ("title",))


def plain(html, rule=ITEM):
    return [(c.number, c.parent, c.whole, c.problem, c.fields) for c in C.parse(html, rule)]


def test_plain_cards_and_text():
    html = """<ul><li class="paper new"><b class=title>A &amp; <i>B</i></b><span class="author">Ann
      Lee</span><span class='author'>Bo</span><a href="/x?a=1&amp;b=2">pdf</a><br/></li><li>other</li></ul>"""
    assert plain(html) == [(0, None, True, None, {"title": ["A & B"], "author": ["Ann Lee", "Bo"], "link": ["/x?a=1&b=2"]})]


def test_nested_cards_keep_their_own_fields():
    html = '<li class=paper><p class=title>Session</p><ul><li class=paper><p class=title>One</p><p class=author>Ann</p></li><li class=paper><p class=title>Two</p></li></ul><p class=author>Chair</p></li>'
    assert plain(html) == [
        (0, None, True, None, {"title": ["Session"], "author": ["Chair"]}), (1, 0, True, None, {"title": ["One"], "author": ["Ann"]}), (2, 0, True, None, {"title": ["Two"]}),
    ]


def test_missing_and_stray_end_tags():
    # the second item has no end tag, the third ends with its list, the last with the page
    html = '<ul><li class=paper><span class=title>A</b></span></li><li class=paper><p class=title>B<p class=author>Ann<li class=paper><div class=title>C</div></ul></section><li class=paper><em class=title>D'
    assert plain(html) == [
        (0, None, True, None, {"title": ["A"]}), (1, None, True, None, {"title": ["B"], "author": ["Ann"]}), (2, None, False, "no end", {"title": ["C"]}), (3, None, False, "no end", {"title": ["D"]}),
    ]


def test_what_is_no_text():
    html = '<li class=paper><div class=title>A<script>var x = "</li><b class=title>no</b>";</script><!-- <li class=paper> -->B<style>p{}</style></div></li>'
    assert plain(html) == [(0, None, True, None, {"title": ["AB"]})]


def test_problems():
    assert plain("<li class=paper><span class=author>Ann</span></li>")[0][3] == "no title"
    assert plain("<li class=paper><b class=title>A <i class=author>Ann</i></b></li>")[0][3:] == ("field author inside a field", {"author": ["Ann"], "title": ["A Ann"]})
    assert plain("") == plain("<li>no card</li>") == []


def test_other_selections():
    body = C.Rule(C.Select(class_part="maincardbody"), {"text": C.Select("div", attribute=("role", "main"))})
    assert plain('<div class="x MainCardBody-2"><div role=main>T</div><div role=side>S</div></div>', body) == [(0, None, True, None, {"text": ["T"]})]


def test_table_function(spark):
    rows = [(1, "<li class=paper><b class=title>A</b></li>" * 3, "u"), (2, None, "u"), (3, "", "u"), (4, "<li class=paper><b class=title>" + "x " * 200_000, "u")]
    found = C.cards(spark.createDataFrame(rows, "id long, html string, card_url string"), ITEM)
    got = {(r.id, r.card): (r.title, r.problem) for r in found.select("id", "card", C.one("title").alias("title"), "problem").collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, i): ("A", None) for i in range(3)}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (4, 0)} and len(got[4, 0][0]) == 399_999
    assert C.without_problems(found.filter("id = 1")).count() == 3
    with pytest.raises(Exception, match="no end"):
        C.without_problems(found).select(F.sum("card")).collect()


def test_in_sql(spark):
    spark.udtf.register("cards", C.Cards)
    rule = C.Rule(C.Select("p")).text()
    assert spark.sql("SELECT c.card FROM VALUES ('<p>a<p>b') v(h), LATERAL cards(v.h, :rule) c", {"rule": rule}).count() == 2
