"""Main-text extraction from web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. The first pass decides each block alone: from the
place it stands in (menus, headers, footers, asides, forms, adverts, notices and comments are
out; when the page marks its article, what lies outside of it is out), its share of stop words,
its length and its share of linked text. Short or unclear blocks stay open. In the second pass
open blocks take the label of their nearest decided neighbours in the same container.

A class or id puts an element out by whole words of it (``sidebar``, ``site-sidebar``,
``comment-list``), not by a state that mentions one (``has-sidebar``, ``comments-open``). And no
name, role, hiding or form puts out what the page is about: an element that holds most of the page's
prose stays in unless a marked article is left outside of it (``settle``).

Stop words are of four languages; a page with few of them gets its own, its frequent short words,
and a page without any of those either (scripts without spaces) is judged without them.

Defined results. Null or empty html gives an empty text. Broken markup is read leniently: an end
tag without a start is ignored, an unclosed comment or script runs to the end, a ``<`` that begins
no whole tag is text. A page without any block that reads as prose keeps its open blocks. Pages are read whole, in time that grows with their length whatever their
markup. Repeated rows have equal texts. At equal distances to a good and a bad neighbour a block is
kept. Extra columns are kept, but ``main_text`` is replaced. Empty table: empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tables import read, tidied

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on with as are be at by this from or an not have had but they his her you we she he which their were has been one all there would will more when who so no if out up what about into than "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les de et des en un une du que est pour qui dans au sur par il pas plus ce ne se sont avec son aux ont cette mais ou comme nous vous leur elle été "
    "el los las y del se que por con para una su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object title canvas audio video xmp noframes noembed".split())
OUT_TAGS = frozenset("nav header footer aside form head button select dialog menu fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs masthead footer sidebar sidebars widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist replies reply respond disqus "
    "pagination pager toolbar skip hidden copyright disclaimer".split()
)
#: Names that mean page furniture only outside of an article (an article has its own heading part).
OUT_NAMES_OUTSIDE = frozenset(("header", "topbar", "bottom"))
#: Of these, what readers wrote: it may be longer than the article.
READERS = frozenset("comment comments commentlist replies reply respond disqus".split())
#: Parts of a name that say what an element looks like and not what it is, and those that make it a state of the page.
SHAPES = frozenset(
    "list lists box boxes area areas bar bars wrap wrapper container containers inner outer section block blocks item items link links button buttons form slot slots unit units post posts article articles story stories body text group "
    "panel panels top bottom left right primary secondary holder row rows col cols column columns title heading icon icons toggle count meta author avatar thread overlay dialog message messages region zone placeholder frame card cards".split()
)
STATES = frozenset("has have no not non with without is in on off open opened close closed active inactive enabled disabled enable disable show shown hide visible collapsed expanded allowed".split())
#: A start of the key ends an open element of the values.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article main section div nav aside form header footer body blockquote td li".split())

NAME = re.compile(r"""(/?)([a-zA-Z][^\s/>"']*)""")
#: Attributes up to the end of a tag, where no quote holds a bracket.
PLAIN = re.compile(r"""[^<>"']*+(?:(?:"[^"<>]*+"|'[^'<>]*+')[^<>"']*+)*+>""")
SPECIAL = re.compile("[>\"']")
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+")

LONG, SHORT, MUCH_LINK, STOPS_LOW, STOPS_HIGH = 200, 70, 0.4, 0.1, 0.2
#: Shares of the page's prose from which an element stays in: any, and one of readers' words.
MOST, MOST_OF_READERS = 0.5, 0.9
#: Letters of the words, and how often they occur at least, that may serve as a page's own stop words.
OWN_LETTERS, OWN_TIMES = 4, 3


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    item: bool  # of a list
    out: bool
    scope: int  # 0 outside of an article, else its number
    doubt: int  # the innermost element around it that may put it out, or -1

    def links(self) -> float:
        """Share of characters in links."""
        return self.linked / max(1, len(self.text))


@dataclass
class Doubt:
    """An element that a name, role, hiding or form puts out, unless the page is about it."""

    outer: int  # the next such element around it, or -1
    readers: bool
    prose: int = 0
    marked: int = 0  # the part of the prose that is of a marked article
    out: bool = True


def named_out(names: str, inside: bool) -> set[str]:
    """The words of class names and ids that say that an element is page furniture."""
    found = set()
    for token in names.split():
        parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
        if len(parts) > 1 and not STATES.isdisjoint(parts):
            continue
        while len(parts) > 1 and parts[-1] in SHAPES and parts[-1] not in OUT_NAMES:
            parts.pop()
        if parts and (parts[-1] in OUT_NAMES or (not inside and parts[-1] in OUT_NAMES_OUTSIDE)):
            found.add(parts[-1])
    return found


def put_out(name: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is out by its tag, whether it is so by other signs, and whether those name readers' words."""
    if name in OUT_TAGS and not (name == "header" and inside):
        by_form = name in ("form", "fieldset")
        return not by_form, by_form, False
    if name in ("html", "body") or attrs.get("itemprop", "") == "articleBody":
        return False, False, False
    found = named_out(f"{attrs.get('class', '')} {attrs.get('id', '')}", inside)
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return False, bool(found) or hidden or attrs.get("role", "").lower() in OUT_ROLES, not found.isdisjoint(READERS)


def settle(found: list[Block], doubts: list[Doubt]) -> None:
    """Put out the blocks of all elements in doubt but those that the page is about."""
    whole = whole_marked = 0
    for b in found:
        if not b.out:
            prose = len(b.text) - b.linked
            marked = prose if b.scope else 0
            whole, whole_marked = whole + prose, whole_marked + marked
            if b.doubt >= 0:
                doubts[b.doubt].prose += prose
                doubts[b.doubt].marked += marked
    for d in reversed(doubts):  # inner ones come after outer ones
        if d.outer >= 0:
            doubts[d.outer].prose += d.prose
            doubts[d.outer].marked += d.marked
    for d in doubts:
        most = d.prose > (MOST_OF_READERS if d.readers else MOST) * whole
        d.out = (d.outer >= 0 and doubts[d.outer].out) or not (most and whole_marked - d.marked < SHORT)
    if doubts and not any(not b.out and (b.doubt < 0 or not doubts[b.doubt].out) and b.linked < len(b.text) for b in found):
        for d in doubts:  # nothing but elements in doubt: all but readers' words
            d.out = d.readers or (d.outer >= 0 and doubts[d.outer].out)
    for b in found:
        b.out = b.out or (b.doubt >= 0 and doubts[b.doubt].out)


class Tags:
    """Ends of tags, found in time that grows with the page and not with the tags that never end."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.open: set[int] = set()  # places from which no end is reached
        self.near = (0, -1)  # a stretch without anything special before its last character

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the attributes from ``at`` on, or -1; quotes hide it."""
        seen: list[int] = []
        while at <= max(self.last.values()):
            if self.near[0] <= at <= self.near[1]:
                k = self.near[1]
            else:
                k = SPECIAL.search(self.page, at).start()
                self.near = (at, k)
            if k in self.open:
                break
            c = self.page[k]
            if c == ">":
                return k
            seen.append(k)
            if k >= self.last[c]:
                break
            at = self.page.index(c, k + 1) + 1
        self.open.update(seen)
        return -1


#: Elements that an article can't lie within; where it seems to, the page never closed them.
UNCLOSED = frozenset(("nav", "header", "form", "menu", "head"))


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    # open elements: name, whether it puts its content out, whether it starts an article, whether it is in doubt
    stack: list[tuple[str, bool, bool, bool]] = []
    doubts: list[Doubt] = []
    doubted = [-1]  # numbers of open elements in doubt
    # where open elements stand in the stack: by name, those that bound the closing of others, those that put out
    places: dict[str, list[int]] = defaultdict(list)
    scopes: list[int] = []
    outs: list[int] = []
    text: list[str] = []
    state = {"linked": 0, "out": 0, "fixed": 0, "articles": 0, "scope": 0, "links": 0, "heading": 0, "items": 0}
    tags, unended = Tags(page), set()

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, state["linked"], state["heading"] > 0, state["items"] > 0, state["out"] > 0, state["scope"] if state["articles"] else 0, doubted[-1]))
        text.clear()
        state["linked"] = 0

    def close(k: int) -> None:
        for name, puts_out, article, doubt in stack[k:]:
            places[name].pop()
            if doubt:
                doubted.pop()
            if name in SCOPES:
                scopes.pop()
            if puts_out:
                outs.pop()
                state["out"] -= 1
                state["fixed"] -= name not in UNCLOSED
            state["articles"] -= article
            state["links"] -= name == "a"
            state["heading"] -= name in HEADINGS
            state["items"] -= name == "li"
        del stack[k:]

    def said(raw: str) -> None:
        if raw:
            plain = entities.unescape(raw)
            text.append(plain)
            if state["links"]:
                state["linked"] += len(" ".join(plain.split()))

    at, n, after = 0, len(page), 0  # text runs from ``at``; the next tag is looked for from ``after``
    while (k := page.find("<", after)) >= 0:
        m = NAME.match(page, k + 1)
        if m:
            plain = PLAIN.match(page, m.end())
            end = plain.end() - 1 if plain else tags.end(m.end())
        elif page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            end = end + 2 if end >= 0 else n
        else:
            end = page.index(">", k) if page.startswith(("<!", "<?", "</"), k) and k < tags.last[">"] else -1
        if end < 0:
            after = k + 1
            continue
        said(page[at:k])
        at = after = end + 1
        if not m:
            continue
        name, said_of = m[2].lower(), page[m.end() : end]
        if m[1]:
            if name in BLOCKS:
                flush()
            if places[name]:
                close(places[name][-1])
            elif name == "br":
                text.append(" ")
            continue
        if name in RAW:
            if not said_of.rstrip().endswith("/"):
                ended = None if name in unended else re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                if not ended:
                    unended.add(name)
                at = after = ended.end() if ended else (n if name in ("script", "style", "textarea", "title") else at)
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            text.append(" ")
        if name in VOID:
            continue
        closed = CLOSES.get(name) or ({"p"} if name in BLOCKS else ())
        top = max((places[x][-1] for x in closed if places[x]), default=-1)
        if top >= 0 and top >= (scopes[-1] if scopes else -1):
            close(top)
        attrs = {a.lower(): b or c or d for a, b, c, d in ATTR.findall(said_of)} if said_of.strip() else {}
        puts_out, doubt, readers = put_out(name, attrs, state["articles"] > 0)
        article = name in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "") == "articleBody"
        if article and not puts_out and state["out"] and not state["fixed"]:
            for i in outs:
                stack[i] = (stack[i][0], False, *stack[i][2:])
            outs.clear()
            state["out"] = 0
        article = article and not puts_out and not state["out"]
        state["scope"] += article and not state["articles"]
        places[name].append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        if puts_out:
            outs.append(len(stack))
            state["out"] += 1
            state["fixed"] += name not in UNCLOSED
        state["articles"] += article
        state["links"] += name == "a"
        state["heading"] += name in HEADINGS
        state["items"] += name == "li"
        if doubt:
            doubts.append(Doubt(doubted[-1], readers))
            doubted.append(len(doubts) - 1)
        stack.append((name, puts_out, article, doubt))
    said(page[at:])
    flush()
    settle(out, doubts)
    return out


def stop_words(found: list[Block], words_of: list[list[str]]) -> frozenset[str] | None:
    """The known stop words; with the page's own frequent short words, where it has few of them; None, where that doesn't help."""
    words = [w for b, own in zip(found, words_of, strict=True) if not b.out and b.links() <= MUCH_LINK for w in own]
    share = lambda known: sum(map(known.__contains__, words)) / max(1, len(words))
    if share(STOP_WORDS) >= STOPS_LOW:
        return STOP_WORDS
    often = Counter(w for w in words if len(w) <= OWN_LETTERS and not w.isdigit())
    own = STOP_WORDS.union(w for w, n in often.items() if n >= max(OWN_TIMES, len(words) / 200))
    return own if share(own) >= STOPS_LOW else None


def first_pass(found: list[Block]) -> list[bool | None]:
    """True or False where a block alone decides, None where it doesn't."""
    marked = any(b.scope and not b.out for b in found)
    words_of = [[] if b.out else WORD.findall(b.text.lower()) for b in found]
    known = stop_words(found, words_of)
    labels: list[bool | None] = []
    for b, words in zip(found, words_of, strict=True):
        length, links = len(b.text), b.links()
        stops = STOPS_HIGH if known is None else sum(map(known.__contains__, words)) / max(1, len(words))
        if b.out or (marked and not b.scope):
            labels.append(False)
        elif links > MUCH_LINK:
            # lists of links are menus; a linked sentence or heading within an article goes with what stands around it
            labels.append(None if marked and not b.item else False)
        elif length >= SHORT and stops >= STOPS_LOW:
            labels.append(True if marked or length >= LONG or stops >= STOPS_HIGH else None)
        else:
            labels.append(None)
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks inherit: both nearest decided neighbours of their container, or the nearer one; a heading, the next."""
    marked = any(b.scope and not b.out for b in found)

    def nearest(order: range) -> list[tuple[int, bool] | None]:
        last: dict[int, tuple[int, bool]] = {}
        out: list[tuple[int, bool] | None] = [None] * len(found)
        for i in order:
            out[i] = last.get(found[i].scope)
            if labels[i] is not None and not found[i].out:
                last[found[i].scope] = (i, labels[i])
        return out

    before, after = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    with_prose = {b.scope for x, b in zip(labels, found, strict=True) if x}
    out = []
    for k, label in enumerate(labels):
        if label is None:
            x, y = before[k], after[k]
            if not with_prose or (marked and found[k].scope not in with_prose):
                label = True  # nothing in this page or article reads as prose: all that isn't furniture is its text
            elif found[k].heading and y:
                label = y[1]
            elif x and y:
                label = x[1] if x[1] == y[1] or k - x[0] < y[0] - k else y[1] if y[0] - k < k - x[0] else True
            else:
                label = (x or y or (0, marked))[1]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, second_pass(found, first_pass(found)), strict=True) if good)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` added; a column of that name is replaced."""
    pages = pages.drop("main_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "main_text"])

    return pages.mapInArrow(tidied(run), T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op10_main_text": op10_main_text}
