"""op5 through its query: pages made from known articles and chrome of many names, against the articles themselves."""

import html
import random

import pytest

from reelmark.llm import html_extraction

PAGES = "page_id long, url string, html string, path string, host int, dropped string"
OUTER = [
    "<header class='site-header'><h1>Logo</h1><a href=/>Home</a></header>", "<nav><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></nav>", "<div class='ad'>{u} buy now</div>", "<aside><p>{u} aside</p></aside>",
    "<div id=sidebar-left><p>{u} more</p></div>", "<form action=/s><label>Search</label><input><button>Go</button></form>", "<div role=navigation>{u}</div>", "<div style='display: none'>{u}</div>", "<footer><p>(c) us</p></footer>",
    "<div class='cookie-banner'><p>We use cookies</p><button>OK</button></div>", "<section id='comments'><p>{u} says a reader</p></section>", "<!-- <p>{u}</p> -->", "<style>p{{x:'{u}'}}</style>",
]
INNER = ["<div class='ad-slot-2'>{u}</div>", "<aside>{u}</aside>", "<div class='share-buttons'><a href=x>{u}</a></div>", "<script src=a.js/>var x='{u}';</script>", "<form><p>{u}</p></form>", "<ul class='comments-list'><li>{u}</ul>", "<nav>{u}</nav>"]
#: Names that hint at chrome, on text that only one page has: the article's own.
HINTED = ["alert", "legal-text", "related-work", "footnotes", "notice", "legal", "copyright-history", "modal-logic", "share-price", "comment-on-law", "banner-image", "widget-theory"]


def sentence(rng, n):
    return " ".join(rng.choice(["rain", "wheel", "é&<", "stone", "hill", "o'er", "東京", "salt", "quiet"]) + str(rng.randrange(1000)) for _ in range(n))


def page(rng, number, host, notice):
    """A page and the blocks of its article."""
    used = lambda parts: [p.format(u=sentence(rng, rng.randrange(2, 12))) for p in rng.sample(parts, rng.randrange(1, len(parts)))]
    blocks, body = [], []
    for _ in range(rng.randrange(5, 12)):
        text = sentence(rng, rng.randrange(6, 40))
        words = text.split()
        shown = html.escape(text).replace(" ", rng.choice([" ", "\n  ", " <b>", " <i></i> ", "<br>", " <!-- x --> "]), 1)
        tag = rng.choice(["p", "p", "h2", "li", "blockquote", "div", "section", "pre"])
        attribute = rng.choice(["", "", f' class="{rng.choice(HINTED)}"', ' id="part"'])
        if rng.random() < 0.2:
            shown += " <label>Fig 1</label> <noscript>plain</noscript>"
            words += ["Fig", "1", "plain"]
        body.append(f"<{tag}{attribute}>{shown}</{tag}>")
        blocks.append(" ".join(words))
        if rng.random() < 0.3:
            body += used(INNER)[:1]
    if notice:  # the same on all of the host's pages, inside the article
        body.insert(rng.randrange(len(body)), f"<div class='notice legal'><p>All rights with {host}</p></div>")
    chrome = used(OUTER)
    at = rng.randrange(len(chrome) + 1)
    article = f"<article class='post post-{number}'>{''.join(body)}</article>" if host.startswith("a") else f"<div class='story-{number}'>{''.join(body)}</div>"
    return f"<html><head><title>{sentence(rng, 3)}</title></head><body>{''.join(chrome[:at])}{article}{''.join(chrome[at:])}</body></html>", blocks


def test_query_finds_the_articles(spark, tmp_path):
    rng = random.Random(55)
    rows, expected = [], {}
    for i in range(240):
        host = rng.choice(["a.example", "a2.example", "b.example", "b2.example"])
        source, blocks = page(rng, i, host, notice=host in ("a2.example", "b2.example"))
        rows.append((i, f"http://{host}/{i}", source))
        expected[i] = "\n".join(blocks)
    rows += rows[:5] + [(900, None, None), (901, "http://a.example/none", ""), (902, "junk", "just text"), (903, "http://a.example/long", "<body><article class='post'><p>" + "long text " * 60_000 + "</p></article></body>"), (None, "http://c.example", "<p>only</p>")]
    expected |= {900: "", 901: "", 902: "just text", 903: ("long text " * 60_000).strip(), None: "only"}
    spark.createDataFrame([(*r, "p", 1, "d") for r in rows], PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = html_extraction.op5_html_extraction(spark, str(tmp_path))
    assert dict(found.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == expected[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html_extraction.op5_html_extraction(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("part, kept", [
    ('<div class="alert">A</div>', "A"), ('<section class="related-work"><p>B</p></section>', "B"), ('<p class="legal">C</p>', "C"), ('<div class="footnotes">E</div>', "E"), ("f <label>G</label> h", "f G h"), ("<button>I</button>", "I"),
    ("<noscript>J</noscript>", "J"), ("<textarea>K</textarea>", "K"), ('<script src="a.js"/>var leak=1;</script>L', "L"), ('<div class="ad">no</div>', None), ('<div id="comments">no</div>', None), ('<div class="ad-slot-3">no</div>', None), ("<svg/>N", "N"),
])
def test_names_do_not_cut_articles(part, kept):
    found = html_extraction.Page(f"<body><nav>x</nav><article><p>{'word ' * 30}</p>{part}</article><footer>y</footer></body>")
    assert found.text_at(found.best()[0]).split("\n")[1:] == ([kept] if kept else [])


def test_repeated_notices_go_and_single_ones_stay(spark):
    article = lambda i, more: f"<body><article><p>{f'words of {i} ' * 20}</p>{more}</article></body>"
    rows = [(i, "http://h.example", article(i, "<div class=notice>Same for all</div>")) for i in range(5)] + [(5, "http://h.example", article(5, "<div class=notice>Only here</div>"))]
    rows += [(10 + i, "http://g.example", article(i, f"<div class=notice>Own {i // 2 if i < 2 else i}</div>")) for i in range(6)]
    found = {r["page_id"]: r["text"].split("\n")[1:] for r in html_extraction.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(6)] == [[]] * 6 and all(len(found[10 + i]) == 1 for i in range(6))
