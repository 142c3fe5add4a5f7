import base64
import hashlib
import os

import pytest

from keystrata.llm import html_crf as H
from keystrata.llm import warc as W


def test_segments():
    got = list(H.segments("<html><head><title>no</title></head><body><p>one <b>two</b>three<p>four<br>five<script>var x='</p>';</script><!-- c --><ul><li>a<li><a href=x>b</a></ul><p>&amp;&nbsp;&eacute;"))
    assert [x.text for x in got] == ["one twothree", "four", "five", "a", "b", "& é"]
    assert [x.path[-1][0] for x in got] == ["p", "p", "p", "li", "li", "p"]
    assert got[4].linked == 1 and got[0].linked == 0
    inner = list(H.segments('<p>a <b>x</b> <span class="ad-slot">b <i>c</i></span> d</p><p>e'))
    assert [(x.block, x.raw, [w for _, w in x.inline]) for x in inner] == [(0, "a x ", []), (0, "b c", [("ad", "slot")]), (0, " d", []), (1, "e", [])]
    assert [x.text for x in H.segments("<template><p>no</p></template><p>a <math><mi>x</mi></math> <object>b</object>")] == ["a x", "b"]


PLAIN = {
    "<article><p>A</p></article>": "A",
    "<article><p>A</p><p>B</p></article>": "A B",
    "<nav><a href=x>n</a></nav><article><p>A</p><p>B</p></article>": "A B",
    "<article><h1>T</h1><p>Some words are here.</p><ol><li>one<li>two three</ol></article>": "T Some words are here. one two three",
    "<article><p>Intro text is here.</p><p><a href=x>Only a link paragraph</a></p><p>More text.</p></article>": "Intro text is here. Only a link paragraph More text.",
    "<div><div><p>First paragraph of prose that has some length to it, and goes on.</p><p>Second paragraph of prose.</p></div></div>": "First paragraph of prose that has some length to it, and goes on. Second paragraph of prose.",
    "<body><div><div>First paragraph of prose that has some length.</div><div>Second paragraph of prose.</div></div></body>": "First paragraph of prose that has some length. Second paragraph of prose.",
    '<article><p>Before <span class="ad">Buy now!</span> after the advert.</p></article>': "Before after the advert.",
    '<article><p>Before <span class="hl">kept</span> after it.</p></article>': "Before kept after it.",
    "<p>Just a paragraph.</p>": "Just a paragraph.",
    "plain text only": "plain text only",
    "<body><nav><ul><li><a href=/>Home</a></li></ul></nav><div><p>Body text without any class name, in a plain div.</p><p>And one more.</p></div><footer>Copyright</footer></body>": "Body text without any class name, in a plain div. And one more.",
}


@pytest.mark.parametrize("html", PLAIN)
def test_plain_articles(html):
    assert H.model().extract(html) == PLAIN[html]


def test_other_sites():
    """Pages of another generator, whose class names the model has not seen: share of words found and of those that are right."""
    import random
    from collections import Counter

    r = random.Random(5)
    words = "alpha beta gamma delta house river mountain city people always never because through light".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."

    def noise():
        return r.choice([f"<nav class=qx><a href=/>{say(1)}</a> <a href=/>{say(2)}</a></nav>", f"<header class=zt><div>{say(2)}</div></header>", f"<aside class=kk><h4>{say(2)}</h4><p>{say(12)}</p></aside>", f"<footer id=uu><p>{say(8)}</p></footer>", f"<form class=vv><label>{say(2)}</label><button>{say(1)}</button></form>"])

    right = got_all = want_all = 0
    for _ in range(200):
        page, want = "".join(noise() for _ in range(r.randint(0, 3))), []
        outer = r.choice(["article", "main", "div class=blk", "section class=prt", "div"])
        page += f"<{outer}>"
        for _ in range(r.randint(1, 7)):
            tag, text = r.choice(["p", "p", "p", "h2", "li", "blockquote"]), say(r.randint(2, 40))
            want.append(text)
            page += f"<ol><li>{text}</li></ol>" if tag == "li" else f"<{tag}>{text}</{tag}>"
        page += f"</{outer.split()[0]}>" + "".join(noise() for _ in range(r.randint(0, 3)))
        got, all_ = H.model().extract(page).split(), " ".join(want).split()
        right += sum((Counter(got) & Counter(all_)).values())
        got_all, want_all = got_all + len(got), want_all + len(all_)
    assert right / got_all > 0.97 and right / want_all > 0.97


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "</p></div>", "<script>x", "<!-- ", "<p></p>", "<<<>>>", "<a" * 500])
def test_odd_pages(html):
    assert isinstance(H.model().extract(html), str)


def test_held_out_blocks():
    wrong = total = 0
    m = H.model()
    for page in H.training_pages(120, seed=77):
        blocks = H.labelled_blocks(page)
        got = m.decode([sum(m.weights.get(f, 0.0) for f in feats) for feats, _ in blocks])
        wrong += sum(a != b for a, (_, b) in zip(got, blocks, strict=True))
        total += len(blocks)
    assert wrong / total < 0.03


def test_viterbi_is_best_of_all():
    import itertools

    crf = H.Crf({}, {(-1, 0): 0.3, (-1, 1): -0.2, (0, 0): 0.5, (0, 1): -0.7, (1, 0): -0.4, (1, 1): 0.6})
    e = [0.4, -0.9, 0.8, -0.1, 0.2, -1.3]
    score = lambda ys: sum(crf.pairs[(ys[k - 1] if k else -1), y] + e[k] * y for k, y in enumerate(ys))
    assert tuple(crf.decode(e)) == max(itertools.product((0, 1), repeat=6), key=score)
    assert crf.decode([]) == []


def test_extraction(spark, tmp_path):
    page = (
        '<html><body><header class="site-header"><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        '<div class="cookie-consent">We use cookies.</div><article><h1>A heading here</h1><p>First  paragraph &amp; more text follows.</p>'
        "<div class='ad'>Buy this now</div><p>Second\nparagraph of the article, with a <a href=x>link</a> in it.</p></article>"
        '<section id="comments"><p>Nice article, thanks!</p></section><aside class="sidebar"><p>Related things</p></aside><footer>&copy; 2020 Site</footer></body></html>'
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<article><p>" + "word " * 200_000 + "</p></article>"), (4, "u", page), (None, "u", page)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars").write.parquet(str(tmp_path / "pages.parquet"))
    got = H.op3_html_extraction(spark, str(tmp_path)).collect()
    want = "A heading here First paragraph & more text follows. Second paragraph of the article, with a link in it."
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, set()).add(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == texts[None] == {want} and texts[2] == texts[3] == {""} and len(got) == 6
    assert " ".join(["word"] * 200_000) in texts[4]
    assert H.op3_html_extraction(spark, parquet_of(spark, [], tmp_path / "none")).count() == 0


def parquet_of(spark, rows, folder):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return str(folder)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_extraction_equals_the_article(spark):
    """Against a brute-force reading of the tables' pages, which have one article element each."""
    import html
    import re

    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
    got = {r.page_id: r.text for r in H.op3_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_arc_versions_parse_alike():
    for v in (1, 2):
        body = W.HTTP + b"a\nb\r\n\r\nc"
        data = W.arc_version_block(v, "f.arc") + W.arc_record(v, "f.arc", 9, "http://x/ y", body, "20240229010203") + W.arc_record(v, "f.arc", 10, None, W.HTTP)
        got = list(W.parse_arc(data))
        assert [g["content"] for g in got] == [body, W.HTTP] and got[0]["url"] == "http://x/%20y" and got[1]["url"] == "urn:missing"
        head, block = next(iter(W.parse_warc(W.warc_record(5, got[0], None))))
        assert block == body and head["warc-date"] == "2024-02-29T01:02:03Z" and head["warc-type"] == "response"
    with pytest.raises(ValueError):
        list(W.parse_arc(W.arc_version_block(1, "f") + b"u 0 1 t 99\nshort"))
    with pytest.raises(ValueError):
        list(W.parse_warc(W.warc_record(5, got[0], None).replace(b"HTTP/1.1", b"HTTP/9.9")))


def test_warc_contract(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SEGMENT_BYTES", 500)
    htmls = ["<p>a</p>", None, "", "<p>ä\n</p>", "<p>a</p>", "x" * 300_000, "<p>a</p>"]
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate(htmls)] + [(6, "again", "<p>a</p>"), (None, "n", "<p>a</p>"), (None, "n", "alone"), (6, "same id", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    df.selectExpr("*", "1 AS digest", "2 AS refers_to").write.parquet(str(tmp_path / "pages.parquet"))
    got = W.op9_warc(spark, str(tmp_path)).collect()
    want = []
    for page, _, h in rows:
        raw = (h or "").encode()
        best = max((p for p, _, x in rows if (x or "").encode() == raw and p is not None), default=None)
        revisit = best is not None and page != best
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    back = W.read_warc(W.arc_to_warc(W.to_arc(df, min_revisit=1 << 30))).collect()
    assert {r.record_type for r in back} == {"response"} and sorted(bytes(r.payload) for r in back) == sorted((h or "").encode() for *_, h in rows)
    assert W.read_warc(W.arc_to_warc(W.to_arc(df.where("page_id < 0")))).count() == 0
