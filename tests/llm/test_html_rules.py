"""Main text of pages with all kinds of furniture."""

import re
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm import html
from tidemark.llm.html import main_text

PROSE = "This is the text of the article and it goes on for a while, so that the rules can see that it is prose."


def test_furniture_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) "<p>no</p>"</script></head><body class="has-sidebar">
      <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and you have to say that it is fine.</div>
      <main><article><h1>Title</h1><p>{PROSE} &amp; &eacute;<br>more   of
      it</p><p>Short.</p><div class="advert">Buy the thing that is on sale for the first time in the year.</div><aside>{PROSE}</aside><form>{PROSE}<input></form><!-- {PROSE} --><p>{PROSE}</p></article>
      <section id="comments"><article class="comment"><p>{PROSE}</p></article></section></main><div id=sidebar>{PROSE}</div><footer>&copy; {PROSE}</footer></body></html>"""
    assert main_text(page) == f"Title\n{PROSE} & é more of it\nShort.\n{PROSE}"


def test_without_an_article_mark():
    page = f"<body><div class=menu><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>{PROSE} {PROSE}</p><p>Brief words.</p><p>{PROSE} {PROSE}</p></div><p><a href=x>Read all of the other pages that we have</a></p></body>"
    assert main_text(page) == f"Head\n{PROSE} {PROSE}\nBrief words.\n{PROSE} {PROSE}"


def test_unclosed_menu_before_the_article():
    assert main_text(f"<nav><ul><li><a href=x>x</a><article><p>{PROSE}</article>") == PROSE


def test_text_without_stop_words_in_an_article():
    assert main_text("<article><p>Zyx%%% wvu*** tsr$$$</p><p>qpo</p></article>") == "Zyx%%% wvu*** tsr$$$\nqpo"


def test_links_within_an_article():
    page = f"<article><p>{PROSE}</p><p><a href=x>A whole sentence that is a link.</a></p><ul><li><a href=y>More</a></li><li><a href=z>Other pages</a></li></ul><ul><li>A point of the text.</li></ul><p>{PROSE}</p></article>"
    assert main_text(page) == f"{PROSE}\nA whole sentence that is a link.\nA point of the text.\n{PROSE}"


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\"", "</p><b>", "<b></i>", "<nav><article>", "<svg>", "<p><div><b><h1>", "<li><b>", "<!", '<a href="x>', "<td><p>", "word ", "<p>word"])
def test_a_megabyte_of_broken_markup(part):
    start = time.time()
    main_text(part * (1_000_000 // len(part)))
    assert time.time() - start < 30


def test_unended_tags_are_text():
    assert main_text(f'<article><p>{PROSE} <b {PROSE}') == f"{PROSE} <b {PROSE}"
    assert main_text(f"<article><p title='a > b'>{PROSE}</p><p title=\"it's\">{PROSE}</p><p>1 < 2 and {PROSE}</p>") == f"{PROSE}\n{PROSE}\n1 < 2 and {PROSE}"


ARTICLE = f"<h1>Heading of it</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p>"
ARTICLE_TEXT = f"Heading of it\n{PROSE}\nShort one.\n{PROSE}"
WRAPPERS = ["has-sidebar", "no-sidebar", "content-with-sidebar", "comments-open", "cookie-banner-active", "nav-open", "share-enabled", "page menu-closed", "login-page", "social-science", "ads-enabled", "hidden-xs-off", "market-share", "post comments-open", "banner", "widget-area"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_no_wrapper_drops_the_article(name):
    rest = f'<div class="comments"><p>{PROSE}</p></div><div class="site-sidebar"><p>{PROSE}</p></div><div class="cookieBanner">{PROSE}</div>'
    for tag in ("div", "section", "article"):
        for inner in (f"<main><article>{ARTICLE}</article></main>", f"<article>{ARTICLE}</article>", ARTICLE):
            for more in ("", rest):
                page = f'<html><body><nav><a href="x">Home</a></nav><{tag} class="{name}">{inner}{more}</{tag}><footer>Foot</footer></body></html>'
                assert main_text(page) == ARTICLE_TEXT, (tag, inner[:9], bool(more))


@pytest.mark.parametrize("name", ["comments", "comment-list", "site-sidebar", "related-posts", "cookieNotice", "ad-slot", "newsletter_box", "share-buttons", "sidebar-2", "breadcrumb"])
def test_furniture_by_name_goes(name):
    assert main_text(f'<main><p>{PROSE}</p><p>{PROSE}</p></main><div class="{name}"><article><p>{PROSE}</p></article></div>') == f"{PROSE}\n{PROSE}"
    assert main_text(f'<div><p>{PROSE}</p><p>{PROSE}</p></div><div id="{name}"><p>{PROSE}</p></div>') == f"{PROSE}\n{PROSE}"


def test_readers_may_write_more_than_the_author():
    assert main_text(f'<article><p>{PROSE}</p></article><section class="comments">{f"<p>{PROSE}</p>" * 30}</section>') == PROSE
    assert main_text(f'<div><p>{PROSE}</p><p>{PROSE}</p></div><section class="comments">{f"<p>{PROSE}</p>" * 10}</section>') == f"{PROSE}\n{PROSE}"


def test_short_and_unmarked_pages_keep_their_text():
    assert main_text("<p>Title</p><p>One sentence.</p>") == "Title\nOne sentence."
    assert main_text("bare text") == "bare text"
    assert main_text('<nav><a href="x">Home</a></nav><div>Few words</div><p><a href="y">All links</a></p>') == "Few words"
    assert main_text(f'<form id="whole"><div><p>{PROSE}</p></div></form>') == PROSE
    assert main_text(f"<div hidden><p>{PROSE}</p></div>") == PROSE


def test_other_languages():
    russian = "Это было в городе, и он сказал, что не знает, как это было, но все они в то время были на месте и не могли уйти. " * 4
    polish = "To jest tekst, który nie jest znany, i to nie jest tak, że on jest w tym mieście, ale to jest to, co się stało. " * 4
    for text in (russian, polish, "これは日本語の文章であり、空白がない。" * 20):
        text = text.strip()
        page = f'<nav><a href="x">Дом</a> <a href="y">About all of it</a></nav><div><h1>Kopf</h1><p>{text}</p><p>{text}</p></div><footer>2020</footer>'
        assert main_text(page) == f"Kopf\n{text}\n{text}"


class Tree(HTMLParser):
    """Blocks of a page by the standard library's parser: (text, linked, heading, item, signs from the root)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.parts = [], [], []

    def flush(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            names = [n for n, _ in self.open]
            self.found.append((text, sum(len(" ".join(t.split())) for t, linked in self.parts if linked), any(n in html.HEADINGS for n in names), "li" in names, tuple(self.open)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append((" ", False))
        if tag in html.VOID:
            return
        ends = html.CLOSES.get(tag) or ({"p"} if tag in html.BLOCKS else set())
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                del self.open[k:]
                break
            if self.open[k][0] in html.SCOPES:
                break
        self.open.append((tag, tuple(attrs)))

    def handle_endtag(self, tag):
        if tag in html.BLOCKS:
            self.flush()
        at = max((k for k, (n, _) in enumerate(self.open) if n == tag), default=-1)
        if at >= 0:
            del self.open[at:]

    def handle_data(self, data):
        if not any(n in html.RAW for n, _ in self.open):
            self.parts.append((data, any(n == "a" for n, _ in self.open)))


def plain_main_text(page):
    """Both passes by their definition, for pages of common markup: every block against every other."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.flush()
    found = []
    for text, linked, heading, item, path in tree.found:
        in_article = any(n in ("article", "main") for n, _ in path)
        out = any(n in html.OUT_TAGS or html.named_out(" ".join(v or "" for k, v in a if k in ("class", "id")), False) for n, a in path)
        found.append((text, linked / len(text), heading, item, out, in_article))
    marked = any(a and not o for *_, o, a in found)
    labels = []
    for text, links, heading, item, out, in_article in found:
        words = re.findall(r"[^\W_]+", text.lower())
        stops = sum(w in html.STOP_WORDS for w in words) / max(1, len(words))
        if out or (marked and not in_article):
            labels.append("bad")
        elif links > 0.4:
            labels.append("open" if marked and not item else "bad")
        else:
            labels.append("good" if len(text) >= 70 and stops >= 0.1 and (marked or len(text) >= 200 or stops >= 0.2) else "open")
    kept = []
    for k, (text, _, heading, _, _, in_article) in enumerate(found):
        label = labels[k]
        if label == "open":
            near = [(abs(j - k), j > k, labels[j]) for j, b in enumerate(found) if labels[j] != "open" and not b[4] and b[5] == in_article]
            after = sorted(x for x in near if x[1])[:1]
            least = [x for x in near if x[0] == min(near)[0]] if near else []
            if "good" not in labels:
                label = "good"
            elif heading and after:
                label = after[0][2]
            else:
                label = "good" if any(x[2] == "good" for x in least) else "bad"
        if label == "good":
            kept.append(text)
    return "\n".join(kept)


def test_pages_equal_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count()
    assert [r.page_id for r in rows if r.main_text != plain_main_text(r.html or "")] == []
    assert all(r.main_text for r in rows)
