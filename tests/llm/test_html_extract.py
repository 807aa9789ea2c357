from __future__ import annotations

import random
import time

import pytest

from stoneloom.llm import html_extract as op
from stoneloom.llm.html_extract import extract, main_text

P1 = "The first paragraph of the article is long enough to count, has commas, and says something about the matter at hand."
P2 = "The second one, just as long, goes on about it; it, too, has what prose has, and ends with a full stop at the end."
BODY = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p>"
WANT = f"Title\n\n{P1}\n\n{P2}"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body><article>{BODY}</article></body></html>",
        f"<body><nav><a href=/>Home</a></nav><main>{BODY}</main><footer><p>Legal, note, of length, here it is</p></footer>",
        f"<header><h1>Site name</h1></header><div id='content'>{BODY}</div><aside><p>Side, side, side, and more side text here</p></aside>",
        f"<div class='content'>{BODY}<div class='comments'><p>{P1} by a reader</p></div></div>",
        f"<div class='content'>{BODY}<section id=comment-list><p>{P1} by a reader</p></section></div>",
        f"<div>{BODY}<form><p>Give, us, your, name, and your mail address now</p></form></div>",
        f"<div>{BODY}<script>var a = '<p>{P1}</p>';</script><style>p {{}}</style><noscript><p>{P1}</p></noscript></div>",
        f"<div>{BODY}<div class='cookie-notice'><p>We, use, cookies, as all do, and so on</p></div></div>",
        f"<div>{BODY}<div class='adBox'>Buy, this, now</div><div style='display:none'>{P1}</div><p hidden>x</p></div>",
        f"<div role='navigation'><p>{P1}</p></div><div>{BODY}</div>",
        f"<article><header>By one, today, and more<h1>Title</h1></header><p>{P1}</p><p>{P2}</p></article>",
        f"<article><h1>Title</h1><p><b>{P1}<br><p>{P2}</article>",
        f"<article><div class='post-header'><h1>Title</h1>By one, at noon</div><p>{P1}</p><p>{P2}</p></article>",
        f"<div class=wrap><h1>Title</h1><div class='content has-sidebar'><div class=text><p>{P1}</p><p>{P2}</p></div></div></div><div>x</div>",
        f"<body><div class='content'>{BODY}</div><p>Copyright 2020</p><p><a href=x>More of this kind, and more, and more of it all</a></p>",
        f"<body><div id=top class=header><h1>Site</h1></div><div>{BODY}</div><ins class=adsbygoogle>Buy this, now</ins></body>",
        f"<article><h1>Title</h1><section><p>{P1}</p></section><section><p>{P2}</p></section></article>",
        f"<!-- <p>{P1}</p> --><div>{BODY}</div><ul class=menu><li><a href=a>One</a><li><a href=b>Two</a></ul>",
        f"<table><tr><td><a href=a>A</a> <a href=b>B</a><td>{BODY}</table>",
    ],
)
def test_article_only(html):
    assert main_text(html) == WANT


def test_references_and_white_space():
    html = f"<article><p>Fish &amp; chips &lt;b&gt; &eacute;&#233;&#xe9;\n\t and<br>more , {P1}</p><pre>a\n  b</pre></article>"
    assert main_text(html) == f"Fish & chips <b> ééé and more , {P1}\n\na b"


def test_loose_text_and_lists():
    html = f"<div><p>{P1}</p>loose <i>text</i> here<ul><li>One<li>Two <a href=x>link</a></ul><blockquote>{P2}</blockquote></div>"
    assert main_text(html) == f"{P1}\n\nloose text here\n\nOne\n\nTwo link\n\n{P2}"


@pytest.mark.parametrize(
    "html,want",
    [(None, ""), ("", ""), ("<html></html>", ""), ("just text", "just text"), ("a < b", "a < b"), ("<p>cut <b", "cut"), ("<script>x", ""), ("</div></p>x", "x"), ("<nav>x</nav>", ""), ("<p>é", "é")],
)
def test_odd_pages(html, want):
    assert main_text(html) == want


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + f"<p>{P1}</p>") == P1
    many = [f"{P1} {i}" for i in range(5000)]
    assert main_text("<article>" + "".join(f"<p>{x}" for x in many)) == "\n\n".join(many)


def test_short_sections_beside_a_long_one():
    long = [f"{P1} {i}, {P2} {P1[:150]}" for i in range(5)]
    short = f"{P1[:-1]}, and more of that."
    html = f"<body><div id=c><div>{''.join(f'<p>{x}</p>' for x in long)}</div><div><p>{short}</p></div><div><p><a href=x>{P1}</a></p></div><div>x</div></div></body>"
    assert main_text(html) == "\n\n".join([*long, short])


@pytest.mark.parametrize("says", ["section id='discussion'", "div class='legal-history'", "div class=warning", "div id=related-work"])
def test_topics_are_no_noise(says):
    kind = says.split()[0]
    part = f"<{says}><h2>Part</h2><p>{P2}</p></{kind}>"
    assert main_text(f"<article><h1>Title</h1><p>{P1}</p>{part}</article>") == f"Title\n\n{P1}\n\nPart\n\n{P2}"
    assert main_text(f"<div><h1>Title</h1><p>{P1}</p><p>{P1}</p>{part}</div>") == f"Title\n\n{P1}\n\n{P1}\n\nPart\n\n{P2}"
    # without prose, or with many links, the word counts
    for rest in ("<p>Of this kind</p>", f"<p><a href=x>{P1}</a></p><p>{P2}</p>"):
        assert main_text(f"<article>{BODY}<{says}>{rest}</{kind}></article>") == WANT


@pytest.mark.parametrize(
    "part,text",
    [
        (f"<p class=warning>{P2}</p>", P2),
        ("<p class=warning>Mind the gap</p>", "Mind the gap"),
        ("<p class=popular>It was liked</p>", "It was liked"),
        (f"<div class=legal><p>{P2}</p></div>", P2),
        (f"<section id=search><p>{P2}</p></section>", P2),
        (f"<div class=social-history><p>{P2}</p></div>", P2),
        ("<p>Let <math><mi>x</mi></math> be</p>", "Let x be"),
        ("<h2>References</h2><ul><li><a href=1>One, A book</a></li><li><a href=2>Two</a></li></ul>", "References\n\nOne, A book\n\nTwo"),
        ("<p>AT&<b>amp;</b>T</p>", "AT&amp;T"),
    ],
)
def test_nothing_inside_an_article_is_dropped(part, text):
    for around in ("article", "div", "main", "section", "td"):
        assert main_text(f"<body><{around}><h1>Title</h1><p>{P1}</p><p>{P1}</p>{part}</{around}></body>") == f"Title\n\n{P1}\n\n{P1}\n\n{text}", around


def test_scores_choose_between_articles():
    """The tag is a term of the score, not the answer: the teaser's article loses to the text without one."""
    teaser = "<article><h2>Other</h2><p><a href=x>Read it, and more</a></p></article>"
    html = f"<body><div>{teaser}</div><div><h1>Title</h1><p>{P1}</p><p>{P2}</p><p>{P1}</p></div></body>"
    assert main_text(html) == f"Title\n\n{P1}\n\n{P2}\n\n{P1}"


def test_levels_above_the_best_container():
    html = f"<body><div><div class=intro><p>{P1}</p></div><div><h1>Title</h1><div><p>{P2}</p><p>{P2}</p><p>{P1}</p></div></div></div><div><p>Short one.</p></div></body>"
    assert main_text(html) == f"{P1}\n\nTitle\n\n{P2}\n\n{P2}\n\n{P1}"


def naive_scores(nodes, blocks):
    """Every container's score by the definition, from the whole tree each time."""

    def under(node, top):
        while node and node is not top:
            if node.gone:
                return False
            node = node.parent
        return node is top

    def points(c):
        own = sum(op.points_of(t, k) for h, t, k in blocks if h.container is c and h.kind not in op.HEADINGS and not h.head)
        below = [points(x) for x in nodes if x is not c and x.parent and x.container is x and x.parent.container is c and not x.gone]
        below = [x for x in below if x]
        return own + (below[0] if len(below) == 1 and not own else sum(below) / 2)

    out = []
    for c in nodes:
        if c.container is c and not c.gone:
            held = [(t, k) for h, t, k in blocks if under(h, c) and not h.head]
            size, links = sum(len(t) for t, _ in held), sum(k for _, k in held)
            out.append((points(c) * c.boost * (1 - min(1, links / max(1, size)))))
    return out


def test_scores_against_the_definition():
    r = random.Random(3)
    for _ in range(60):
        html, open_ = "", []
        for _ in range(r.randint(1, 60)):
            kind = r.choice(["div", "div", "section", "article", "p", "ul", "li", "h2", "a", "td", "header", "div class=legal", "div class=content", "blockquote"])
            html += r.choice([f"<{kind}>", f"<{kind}>{P1[: r.randint(1, 110)]}", f"<{kind}>{r.choice([P1, P2])}</{kind.split()[0]}>", "</div>", "x, y"])
        nodes, blocks = op.tree_of(html)
        op.weigh(nodes, blocks)
        assert [x.score for x in nodes if x.container is x and not x.gone] == pytest.approx(naive_scores(nodes, blocks))


def test_time_is_in_proportion_to_the_page():
    def seconds(html):
        began = time.process_time()
        main_text(html)
        return time.process_time() - began

    for part in ("<div>word here,", "<b><p>word", "<div></section>x", "<ul><li>x"):
        assert seconds(part * 8_000) < 20 * max(0.01, seconds(part * 1_000)), part


def test_operator(spark, rows):
    df = spark.createDataFrame(
        [(1, "u", f"<article>{BODY}</article>", "clash"), (1, "u", f"<article>{BODY}</article>", "clash"), (None, None, None, None), (3, "v", "", "x")],
        "page_id long, url string, html string, text string",
    )
    assert rows(extract(df)) == [(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (3, "v", "", 0), (None, None, "", 0)]
    assert extract(df.limit(0)).count() == 0
