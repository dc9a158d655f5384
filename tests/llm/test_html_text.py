import random
import time

import pytest

from capledger.llm.html_text import Weights, best_region, extract_texts, fit_weights, main_text

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def _page(i, body, extra=""):
    return (f'<!DOCTYPE html><html><head><title>Title {i}</title><style>p{{x:y}}</style><script>var t="</p><p>not text";</script></head><body><nav><ul><li><a href="/a">Home page</a></li>'
            f'<li><a>About us</a></li></ul></nav><div class="ad">Buy this now and save a lot of money</div><article><h1>Head {i}</h1>{body}</article>{extra}<footer>&copy; all rights are reserved here</footer></body></html>')


def _rows():
    text = "Some words of the article that go on for a while, as they do."
    return [(i, f"u{i}", _page(i, f"<p>{text} {i}</p><p><b>More</b> of   it &amp; so\non.<br>Next</p>"), "t", 1) for i in range(40)], text


@pytest.fixture(scope="module")
def weights(spark):
    rows, _ = _rows()
    return fit_weights(spark.createDataFrame(rows, SCHEMA))


def test_articles(spark, weights):
    rows, text = _rows()
    got = {r["page_id"]: r for r in extract_texts(spark.createDataFrame(rows, SCHEMA), weights).collect()}
    for i in range(40):
        want = f"Head {i}\n{text} {i}\nMore of it & so on. Next"
        assert (got[i]["text"], got[i]["n_chars"], got[i]["url"]) == (want, len(want), f"u{i}")


def test_what_is_not_the_article(weights):
    body = ('<p>One of the long paragraphs of this article.</p><aside>See also</aside><form><label>Mail</label><button>Go</button></form><script>x = "<p>no</p>"</script>'
            '<p>Another of the long paragraphs of this article.</p><div class="comments"><p>Great post, I have to say, and so do others.</p></div>')
    page = _page(1, body, '<section id="comments"><p>A reader wrote a long comment in this place, as readers do.</p></section><div class="cookie-notice">We use cookies on this site.</div>')
    assert main_text(page, weights) == "Head 1\nOne of the long paragraphs of this article.\nAnother of the long paragraphs of this article."


def test_markup_that_is_not_well_formed(weights):
    assert main_text(_page(1, "<p>First one is not closed<p>Second &lt;b&gt; &#233;&nbsp;&eacute; <!-- no <p>text</p> --> end <b>bold<p>Third</article>"), weights) == "Head 1\nFirst one is not closed\nSecond <b> é é end bold\nThird"
    cut = _page(1, "<p>Text of a page that was cut off").split("</article>")[0]
    assert main_text(cut, weights) == "Head 1\nText of a page that was cut off"
    assert main_text("<p>a < b and c > d", Weights()) == "a < b and c > d"
    assert main_text("<![CDATA[x < y]]> and <![if]> more words", Weights()) == "x < y and more words"
    assert main_text("plain words only", Weights()) == "plain words only"
    assert main_text("<script>only", Weights()) == main_text("<p></p>", Weights()) == ""


def test_region_is_the_best_of_all():
    r = random.Random(6)
    for _ in range(200):
        scores = [r.choice([-2.0, -1.0, 0.0, 1.0, 3.0]) for _ in range(r.randrange(12))]
        low, high = best_region(scores)
        best = max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        assert sum(scores[low:high]) == best


def test_odd_rows(spark, weights):
    rows, _ = _rows()
    long = _page(3, "<p>" + "word " * 100_000 + "</p>" + "<div>" * 2000 + "deep text")
    odd = spark.createDataFrame([(None, None, rows[0][2], "t", 1), (2, "u", None, "t", 1), (2, "u", "", None, None), (3, "u", long, "t", 1), (3, "u", long, "t", 1)], SCHEMA)
    got = extract_texts(odd, weights).collect()
    assert [r["page_id"] for r in got] == [None, 2, 2, 3, 3]
    assert got[0]["text"].startswith("Head 0\n") and got[1]["text"] == got[2]["text"] == ""
    assert got[3]["text"] == got[4]["text"] and len(got[3]["text"]) > 400_000 and got[3]["n_chars"] == len(got[3]["text"])
    assert extract_texts(odd.limit(0), fit_weights(odd.limit(0))).collect() == []


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "</span>" * 100_000, "<div><b>" * 50_000 + "<p>" * 50_000, "<ul><li>" * 50_000 + "<b><li>" * 50_000,
    "<head>" + "<body>" * 100_000, "<table><tr><td>" * 30_000 + "</p>" * 100_000, "<" * 200_000, "<a " * 100_000, "<!--" * 100_000, "<p '" * 100_000, "&amp" * 100_000,
    "</b>" * 200_000, "<script>" * 100_000, "<option>" * 100_000 + "</select>" * 100_000])
def test_many_unclosed_tags_take_no_long(page):
    began = time.perf_counter()
    main_text("<article>some words " + page + " and more", Weights())
    assert time.perf_counter() - began < 10
