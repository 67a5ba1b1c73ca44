from html.parser import HTMLParser

import pytest

from basketlab.llm import main_text, queries
from basketlab.llm.main_text import stretches

P1 = "The river rose in the night and the lower fields stood under water until the morning came. " * 2
P2 = "Nobody had seen the like of it since the old bridge was built &amp; the mill moved uphill. " * 2
T1, T2 = P1.strip(), P2.strip().replace("&amp;", "&")
BODY = f"<p>{P1}</p><p>{P2}</p>"
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a><li><a href=/c>About</a></ul></nav>"
WHOLE = f"{T1}\n\n{T2}"

PAGES = {
    "article": (f"<html><head><title>T</title></head><body>{NAV}<article><h1>Flood</h1>{BODY}<p>End.</p></article><footer>&copy; x</footer>", f"Flood\n\n{WHOLE}\n\nEnd."),
    "unmarked": (f"<body>{NAV}<div id=wrap><div><h2>Flood</h2>{BODY}<p>End.</p></div></div><div><div><p>Copyright x</p></div></div></body>", f"Flood\n\n{WHOLE}\n\nEnd."),
    "links without nav": (f"<body><ul>{''.join(f'<li><a href=/{k}>Page number {k} of this site</a></li>' for k in range(30))}</ul><div>{BODY}</div></body>", WHOLE),
    "inside": (
        f"<main><article><header><h1><a href=/>Flood</a></h1><p>by me</p></header><p>{P1}</p><aside><h4>Aside</h4>{P2}</aside><div class='ad-box'>Buy {P1}</div><form><p>{P1}</p>"
        f"</form><p>{P2}</p><section class='comments'><h3>Comments</h3><article class=comment><p>{P1}</p></article></section></article></main>",
        f"Flood\n\n{WHOLE}",
    ),
    "names": (f"<div class='cookieNotice'><p>{P1}</p></div><div role=navigation>{P1}</div><div id='content'>{BODY}</div><div id=reader-comments><p>{P2}</p></div><p class=copyright>{P2}</p>", WHOLE),
    "misnested": (f"<article><p><b>Title<br>two<p>{P1}<p>{P2}</article>", f"Title two\n\n{WHOLE}"),
    "nav never closed": (f"<nav><ul><li>menu<article>{BODY}</article>", WHOLE),
    "quotes": (f"<article data-x='a > b' title=\"</p>\"><script>var t='</article>';</script><!-- <p>no</p> --><style>p{{}}</style>{BODY}</article>", WHOLE),
    "entities": ("<article><p>a &lt;b&gt; &amp;amp; &#233;&#x41;&nbsp;x  \n y &unknown; 1 < 2 &copy</p></article>", "a <b> &amp; éA x y &unknown; 1 < 2 ©"),
    "short": ("<article><p>The.</p></article>", "The."),
    "inline": ("<article><p>a<b>b</b>c <span class=share>share <span>it</span> now</span>d<a href=x>e</a></p><td>f<td>g</article>", "abc de\n\nf\n\ng"),
    "hidden": (f"<article>{BODY}<div hidden>{P1}</div><div style='display: none'>{P1}</div></article>", WHOLE),
    "text only": ("just words", "just words"),
    "unclosed tag": ("<article><p>one</p><p>two <a href='x", "one\n\ntwo <a href='x"),
    "nothing": (f"{NAV}<footer>{P1}</footer>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, expected = PAGES[name]
    assert main_text.main_text(page) == expected


def test_surge_and_dive():
    assert stretches([0, 90, 0, 0, 5, 0, 0, 0, 20, 0, 0, 0, 400, 3]) == [(1, 5), (12, 14)]
    assert stretches([3, 0, 0, 0, 1]) == [(0, 1)] and stretches([]) == [] and stretches([0, 0]) == []


def plain_stretches(lengths):
    """Line by line: a stretch goes on while one of the next three lines has text."""
    runs, now, gap = [], [], 0
    for k, n in enumerate(lengths):
        if n:
            now, gap = [*now, k] if gap < 3 or not now else (runs.append(now), [k])[1], 0
        else:
            gap += 1
    runs += [now] if now else []
    best = lambda r: max(sum(lengths[j : j + 3]) for j in range(max(0, r[0] - 2), r[-1] + 1))
    most = max(map(best, runs), default=0)
    return [(r[0], r[-1] + 1) for r in runs if best(r) >= min(86, most / 2)]


def test_stretches_equal_a_plain_version():
    import random

    rng = random.Random(4)
    for _ in range(400):
        lengths = [rng.choice([0, 0, 0, 1, 10, 60, 100]) for _ in range(rng.randint(0, 25))]
        assert stretches(lengths) == plain_stretches(lengths)


class Article(HTMLParser):
    """Text of the blocks of the article element, read by another parser."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_whole_query_equals_another_parser(spark):
    folder = "/root/testdata/sf0.01"
    expected = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        reader = Article()
        reader.feed(r.html)
        reader.close()
        expected[r.page_id] = "\n\n".join(filter(None, (" ".join(b.split()) for b in reader.blocks)))
    got = queries.op12_main_text(spark, folder).collect()
    assert {r.page_id: r.text for r in got} == expected and len(got) == len(expected)
    assert all(r.n_chars == len(r.text) for r in got)


def test_tables(spark):
    rows = [(1, "u", None, "m", 2), (1, "u", None, "m", 2), (None, None, "<p>" + "long word " * 400_000, None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_main int")
    got = main_text.extract(pages).orderBy(main_text.F.col("page_id").desc_nulls_last()).collect()
    assert [(r.text, r.main_text, r.n_main) for r in got[:2]] == [("m", "", 0)] * 2
    assert got[2].n_main == 10 * 400_000 - 1 and got[2].page_id is None
    assert main_text.extract(pages.limit(0)).count() == 0


def test_hostile_pages_end():
    for page in ("<a" * 200_000, "<a '\">" * 50_000, "<div>" * 100_000 + "x" + "</p>" * 100_000, "<!--" * 100_000, "<b x=\"" * 100_000):
        main_text.main_text(page)
