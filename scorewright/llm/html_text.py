"""Main text of web pages by template deduction.

The pages of a host are made from a template. Its tokens are elements, told apart by the path of
elements that they stand in, and texts, told apart by their element and words. Tokens with the same
occurrence vector, their counts in each of the host's different pages, form an equivalence class. A
vector is compared by a hash that is combined over the pages, so a class is found by aggregation,
whatever the number of pages; pages that are equal count once. A class is valid if most pages hold it,
and valid classes nest as the paths of their tokens do. Those that a page holds once are the frame;
what stands in a token of the frame and in none below it is that token's slot.

The classes tell the template's texts: a text in one class with an element around it belongs to that
element on every page. The main text is in the slots of one token, found by going down the nesting from
the root: to the token below in which most of the text is that is neither a link nor the template's, as
long as no headings are left outside. Slots below it that hold just the template's texts, or are mostly
links or the same on most pages, go; what an element of running text holds in a slot that stays, stays. Marks
(element names, and names that say what an element is) take part as well: what an element marks as
menu, footer, advert and the like is no text of the template's slots; and a host of too few pages, or a
page that lacks the token, has only its marks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, texts_of

#: Elements by what they are to the main text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe object svg math canvas audio video map select option datalist button input textarea label fieldset nav footer aside dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCKS = "p"
MAIN = frozenset(("article", "main"))
#: A form is left out unless it holds an article, a title of the page or this share of the page's text.
FORM, TITLE, WHOLE = "form", "h1", 0.9
#: Words that mark what isn't the article, and words that may go with them in a class, id or role (fixed values).
CHROME = frozenset(
    """ad ads adsbygoogle advert adverts advertisement advertisements advertising alert alertdialog banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent
    contentinfo cookie cookies dialog disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications overlay pager
    pagination paywall popup promo promos promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored
    subscribe subscription toolbar topbar widget widgets form""".split()
)
LAYOUT = frozenset(
    """a and area article articles bar block body bottom box btn button buttons card cards center col column columns container content count default desktop entry fixed float form global
    google group head header heading hidden holder horizontal icon icons inline inner item items js left links link list main media message mobile module nested of off on open outer
    page panel policy popular post posts primary reader readers region right row section secondary site slot small sticky stories story tablet text this thread title to top
    tracking unit up user users vertical warning wrap wrapper x""".split()
)
#: An article of these words is none.
NO_ARTICLE = frozenset("ad ads advert adverts comment comments promo promos recommended related replies reply respond sponsored".split())
HEADER, HEADER_OF = "header", frozenset("site page top global main wrap wrapper container masthead inner outer section area bar".split())
HEADINGS = frozenset("h1 h2 h3".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements in so many open ones count as text of the last, as browsers do it at less.
DEEPEST = 4096
#: A token is of the template if this share of the host's pages holds it; it then needs so many pages.
SUPPORT, LEAST_PAGES = 0.5, 3
#: The share of the own text of a token that one below it must hold, and the share of links that makes a slot one of links.
DOMINANT, LINKS = 0.5, 0.5
#: Elements that hold text itself stay with the text around them, even if it is the same on most pages.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr figcaption".split())
#: Characters of templates that are broadcast; larger ones are joined by host.
MOST_BROADCAST = 16_000_000
PART = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Element:
    """An element, whose path is a hash of the names, ids and first classes from the root; digits in them count alike."""

    __slots__ = ("above", "chars", "chrome", "form", "heading", "links", "main", "name", "path", "print")

    def __init__(self, above: Element | None, path: int, name: str, chrome: bool, main: bool) -> None:
        self.above, self.path, self.name, self.chrome, self.main = above, path, name, chrome, main
        self.form = self if name == FORM else above and above.form
        self.chars = self.links = self.print = 0
        self.heading = name in HEADINGS and not chrome


class Block:
    """A run of text in one block element: the element, the text, and how many characters of it are links."""

    __slots__ = ("links", "of", "text")

    def __init__(self, of: Element) -> None:
        self.of, self.text, self.links = of, [], 0


class Marks(NamedTuple):
    """What a start tag says of its element: its step in a path, and whether it is left out, a header, the article."""

    step: str
    chrome: bool
    header: bool
    main: bool


def named(name: str, of: frozenset[str], among: frozenset[str]) -> bool:
    """Whether a class, id or role has a word of ``of`` and none but its and those of ``among``, prefixes of two letters aside."""
    words = {w.lower() for w in PART.findall(CAMEL.sub("-", name))}
    return not words.isdisjoint(of) and {w for w in words if len(w) > 2} <= of | among


@lru_cache(maxsize=20_000)
def _marks(name: str, attributes: str) -> Marks:
    given = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    classes = given.get("class", "").split()
    step = name + (f"#{given['id']}" if given.get("id") else "") + "".join(f".{c}" for c in classes[:1])
    step, names = re.sub("[0-9]+", "0", step), [*classes, given.get("id", ""), given.get("role", "")]
    if name in ("html", "body"):
        return Marks(step, False, False, False)
    chrome = name in SKIPPED or "hidden" in given or given.get("aria-hidden") == "true"
    if name != "main":
        chrome = chrome or any(named(n, NO_ARTICLE if name == "article" else CHROME, LAYOUT) for n in names)
    header = name == HEADER or name not in MAIN | HEADINGS and any(named(n, frozenset((HEADER,)), HEADER_OF) for n in names)
    return Marks(step, chrome, header, name in MAIN or given.get("role") in MAIN)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """(elements that aren't inline, the root first; blocks of text), in page order, however broken the page's markup is."""
    elements = [Element(None, 0, "", False, False)]
    blocks: list[Block] = []
    # name, element, inline, link
    stack: list[tuple[str, Element, bool, bool]] = [("", elements[0], False, False)]
    opened: Counter[str] = Counter()
    fresh, at, end = True, 0, len(page)

    def add(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        _, of, _, link = stack[-1]
        if of.chrome:
            return
        if fresh or blocks[-1].of is not of:
            if not raw.strip():
                return
            blocks.append(Block(of))
            fresh = False
        blocks[-1].text.append(raw)
        if link:
            blocks[-1].links += len(raw)

    def close(down_to: int) -> None:
        for gone in stack[down_to:]:
            opened[gone[0]] -= 1
        del stack[down_to:]

    while at < end:
        cut = page.find("<", at)
        if cut < 0:
            add(page[at:])
            break
        add(page[at:cut])
        if page.startswith("<!--", cut):
            to = page.find("-->", cut + 4)
            at = end if to < 0 else to + 3
            continue
        if page.startswith(("<!", "<?"), cut):
            to = page.find(">", cut)
            at = end if to < 0 else to + 1
            continue
        tag = TAG.match(page, cut) or LOOSE_TAG.match(page, cut)
        if tag is None:
            to = page.find(">", cut) if page.startswith("</", cut) else -1
            if to >= 0:
                at = to + 1
            else:
                add("<")
                at = cut + 1
            continue
        at = tag.end()
        name, closing = tag[2].lower(), bool(tag[1])
        inline = name in INLINE
        if name == "br":
            add(" ")
            continue
        if closing:
            if not opened[name]:
                fresh = fresh or not inline
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    fresh = fresh or any(not s[2] for s in stack[k:])
                    close(k)
                    break
                if inline and not stack[k][2]:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if name == "body" or stack[-1][0] == "head" and name not in HEAD:
            close(1 + (len(stack) > 1 and stack[1][0] == "html"))
        if not inline:
            fresh = True
            # a paragraph ends where a block begins, and an item where the next one does
            while len(stack) > 1 and (stack[-1][2] or stack[-1][0] == CLOSED_BY_BLOCKS or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                if stack[-1][2] and not opened[CLOSED_BY_BLOCKS]:
                    break
                close(len(stack) - 1)
        _, of, _, link = stack[-1]
        marks = _marks(name, tag[3])
        chrome = of.chrome or marks.chrome or marks.header and not of.main
        main = of.main or marks.main
        if not inline or chrome and not of.chrome:
            of = Element(of, xxhash.xxh3_64_intdigest(marks.step, of.path), name, chrome, main)
            elements.append(of)
        if name in VOID or inline and tag[3].endswith("/"):
            continue
        if name in RAW:
            to = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if to is None:
                break
            shut = page.find(">", to.end())
            at = end if shut < 0 else shut + 1
            continue
        if len(stack) < DEEPEST:
            stack.append((name, of, inline, link or name == "a"))
            opened[name] += 1
    return elements, _without_forms(elements, blocks)


def _without_forms(elements: list[Element], blocks: list[Block]) -> list[Block]:
    """The blocks that aren't in a form; a form around the page's text is none, and its elements stay."""
    own = {e for e in elements if e.form is not None and not e.form.main and not e.chrome and (e.name == TITLE or e.main)}
    forms = dict.fromkeys((e.form for e in elements if e.form is not None), 0)
    if not forms:
        return blocks
    for b in blocks:
        if b.of.form is not None:
            forms[b.of.form] += sum(map(len, b.text))
    total, kept = sum(len(t) for b in blocks for t in b.text), {e.form for e in own}
    kept |= {f for f, chars in forms.items() if chars >= WHOLE * total}
    for e in elements:
        if e.form is not None and e.form not in kept:
            e.chrome, e.heading = True, False
    return [b for b in blocks if b.of.form is None or b.of.form in kept]


def _text(raw: list[str]) -> str:
    joined = "".join(raw)
    return SPACE.sub(" ", html.unescape(joined) if "&" in joined else joined).strip()


def _signed(n: int) -> int:
    return (n & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def tokens(page: str) -> list[tuple]:
    """(path, path above or null, name, print of a text or null, number, characters, links, print of the text in it, heading, main) of a page's tokens.

    Elements come with what they hold in all; texts of elements that aren't in an article's are tokens too.
    """
    elements, blocks = parse(page)
    found: dict[tuple, list] = {}
    for b in blocks:
        text = _text(b.text)
        hashed, of = xxhash.xxh3_64_intdigest(text), b.of
        of.chars, of.links, of.print = of.chars + len(text), of.links + min(b.links, len(text)), of.print + hashed
        if text and not of.main:
            one = found.setdefault((of.path, None, None, _signed(hashed)), [0, 0, 0, 0, False, False])
            one[0] += 1
            one[1] += len(text)
    for e in reversed(elements):
        if e.above is not None:
            of = e.above
            of.chars, of.links, of.print, of.heading = of.chars + e.chars, of.links + e.links, of.print + e.print, of.heading or e.heading
        if e.chrome:
            continue
        one = found.setdefault((e.path, e.above.path if e.above else None, e.name, None), [0, 0, 0, 0, False, False])
        one[0], one[1], one[2], one[3] = one[0] + 1, one[1] + e.chars, one[2] + e.links, one[3] + e.print
        one[4], one[5] = one[4] or e.heading, one[5] or e.main
    return [(_signed(path), None if above is None else _signed(above), name, text, n, chars, links, _signed(inside), heading, main) for (path, above, name, text), (n, chars, links, inside, heading, main) in found.items()]


TOKEN = "host string, page long, path long, above long, name string, text long, n long, chars long, links long, inside long, heading boolean, main boolean"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(f.split() for f in TOKEN.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in kinds]
    for batch in small_batches(batches, 256):
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), texts_of(batch, "html"), strict=True):
            if page:
                own = _signed(xxhash.xxh3_64_intdigest(page))
                rows += ((host, own, *token) for token in tokens(page))
        columns = [*zip(*rows, strict=True)] or [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def classes(pages: DataFrame) -> DataFrame:
    """(host, path, above, name, text, class, pages, host_pages, once, chars, links, same, heading, main) of the tokens of valid classes.

    ``class`` is the equivalence class: the hash of the occurrence vector over the host's different pages, so
    rows that repeat a page change nothing; ``same`` counts the pages that share the token's commonest text.
    Nothing is gathered by host before it is aggregated by token, so a host with a third of all pages is no
    large group.
    """
    seen = pages.select(_host().alias("host"), "html").mapInArrow(_profile, TOKEN)
    keys = ("host", "path", "above", "name", "text")
    different = seen.groupBy(*keys, "inside", "page").agg(*(F.first(c).alias(c) for c in ("n", "chars", "links", "heading", "main")))
    of_text = different.groupBy(*keys, "inside").agg(
        F.count("*").alias("pages"),
        F.bit_xor(F.xxhash64("page", "n")).alias("class"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
        F.count_if("heading").alias("heading"),
        F.bool_or("main").alias("main"),
    )
    of_text = materialize(of_text, "tokens")
    hosts = of_text.where(F.col("text").isNull() & F.col("above").isNull()).groupBy("host").agg(F.sum("pages").alias("host_pages"))
    hosts = hosts.where(F.col("host_pages") >= LEAST_PAGES)
    # by token first, so that the rows that meet their host's number of pages are few, whatever the host
    out = of_text.groupBy(*keys).agg(
        F.bit_xor("class").alias("class"),
        F.sum("pages").alias("pages"),
        F.sum("once").alias("once"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
        F.max("pages").alias("same"),
        F.sum("heading").alias("heading"),
        F.bool_or("main").alias("main"),
    )
    return out.where(F.col("pages") >= LEAST_PAGES).join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))


class Template(NamedTuple):
    """Where a host's pages have their main text: below the path ``main``, but for the paths ``out`` and the texts ``(path, print)``."""

    main: int
    out: frozenset[int]
    texts: frozenset[tuple[int, int]]


def nested(valid: list[dict]) -> dict[int, list[dict]]:
    """The frame's tokens by the path that they stand in, from the root down."""
    below: dict[int | None, list[dict]] = {}
    for t in sorted(valid, key=lambda t: t["path"]):
        below.setdefault(t["above"], []).append(t)
    todo, out = [*below[None]], {}
    while todo:
        t = todo.pop()
        out[t["path"]] = [x for x in below.get(t["path"], ()) if x["once"] >= SUPPORT * x["host_pages"]]
        todo += below.get(t["path"], ())
    return out


def shared_texts(rows: list[dict]) -> list[dict]:
    """The texts of the template: those in an equivalence class that also holds an element around them.

    Such a text stands on just the pages, and as often on each, as that element does; one that comes and goes
    within its element is the pages' own, on however many of them it is.
    """
    above = {t["path"]: t["above"] for t in rows if t["text"] is None}
    classes = {t["path"]: t["class"] for t in rows if t["text"] is None}

    def around(path: int | None) -> Iterator[int]:
        while path in above:
            yield classes[path]
            path = above[path]

    return [t for t in rows if t["text"] is not None and t["class"] in around(t["path"])]


def fixed_chars(rows: list[dict], shared: list[dict]) -> dict[int, int]:
    """By path, the characters of the template's texts in an element and all that it holds."""
    above, out = {t["path"]: t["above"] for t in rows if t["text"] is None}, {}
    for t in shared:
        path = t["path"]
        while path in above:
            out[path] = out.get(path, 0) + t["chars"]
            path = above[path]
    return out


def dull(t: dict, fixed: dict[int, int]) -> bool:
    """Whether a token's slots hold just the template's texts, are mostly links or the same on most pages.

    Elements that hold text themselves never are; those with headings only if all in them is the template's.
    """
    if t["name"] in TEXT_ELEMENTS:
        return False
    whole = t["chars"] > 0 and fixed.get(t["path"], 0) >= WHOLE * t["chars"]
    same = t["same"] >= SUPPORT * t["pages"] and t["chars"] > 0
    return whole or not t["heading"] and (same or t["links"] > LINKS * t["chars"])


def slots(valid: list[dict], frame: dict[int, list[dict]], fixed: dict[int, int]) -> dict[int, int]:
    """Characters of own text in a token's slots and in those nested in it, without what dull ones hold."""
    of, own = {t["path"]: t for t in valid}, {}
    for path in reversed([*frame]):  # a token comes after the one that it stands in
        t = of[path]
        own[path] = 0 if dull(t, fixed) else t["chars"] - t["links"] - sum(x["chars"] - x["links"] - own[x["path"]] for x in frame[path])
    return own


def template(rows: list[dict]) -> Template:
    """The template of a host, from the tokens of its valid classes."""
    valid = [t for t in rows if t["text"] is None]
    frame, shared = nested(valid), shared_texts(rows)
    fixed = fixed_chars(rows, shared)
    own = slots(valid, frame, fixed)
    at = next(t for t in valid if t["above"] is None)
    while below := frame.get(at["path"]):
        best = next((t for t in below if t["main"]), max(below, key=lambda t: own[t["path"]]))
        outside = at["heading"] - best["heading"] >= SUPPORT * at["host_pages"]
        if at["main"] or not best["main"] and (own[best["path"]] <= DOMINANT * own[at["path"]] or outside):
            break
        at = best
    out, todo = set(), [*frame.get(at["path"], ())]
    while todo:
        t = todo.pop()
        if dull(t, fixed):
            out.add(t["path"])
        else:
            todo += frame.get(t["path"], ())
    holds_text = {t["path"] for t in valid if t["name"] in TEXT_ELEMENTS}
    texts = ((t["path"], t["text"]) for t in shared if t["path"] not in holds_text)
    return Template(at["path"], frozenset(out), frozenset(texts))


def templates(valid: DataFrame) -> DataFrame:
    """(host, main: long, out: array<long>, texts: array of path, print) from ``classes``; a host's valid tokens are at most twice those of its longest page."""
    each = valid.groupBy("host").agg(F.collect_list(F.struct("path", "above", "name", "text", "class", "pages", "host_pages", "once", "chars", "links", "same", "heading", "main")).alias("rows"))
    pair = pa.list_(pa.struct([("path", pa.int64()), ("print", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template(rows) for rows in batch.column(1).to_pylist()]
            texts = pa.array([[{"path": p, "print": t} for p, t in sorted(f.texts)] for f in found], pair)
            yield pa.record_batch([batch.column(0), pa.array([f.main for f in found], pa.int64()), pa.array([sorted(f.out) for f in found], pa.list_(pa.int64())), texts], names=["host", "main", "out", "texts"])

    return each.mapInArrow(run, "host string, main long, out array<long>, texts array<struct<path:long,print:long>>")


def main_text(page: str, of: Template | None = None) -> str:
    """The main text of a page by its host's template, or by its marks alone.

    Where the template's main token holds elements that are marked as the article, only those count. Texts
    of the template stay nevertheless if they are most of the page's main text, and slots that it leaves out
    if they are all of it: such a page is rather one of many copies.
    """
    _, blocks = parse(page)
    kept = [b for b in blocks if not b.of.chrome]
    if of is not None:
        places: dict[Element, tuple[bool, bool]] = {}

        def place(e: Element) -> tuple[bool, bool]:
            """Whether an element is in the template's main token, and in a path that is left out."""
            chain, up = [], e
            while up is not None and up not in places:
                chain.append(up)
                up = up.above
            inside, left = places[up] if up is not None else (False, False)
            for up in reversed(chain):
                path = _signed(up.path)
                inside, left = inside or path == of.main, left or path in of.out
                places[up] = inside, left
            return inside, left

        within = [b for b in kept if place(b.of)[0]]
        kept = within or kept
    if any(b.of.main for b in kept):
        kept = [b for b in kept if b.of.main]
    texts = [(b, _text(b.text)) for b in kept]
    if of is not None and within:
        texts = [(b, t) for b, t in texts if not place(b.of)[1]] or texts
        own = [(b, t) for b, t in texts if (_signed(b.of.path), _signed(xxhash.xxh3_64_intdigest(t))) not in of.texts]
        if 2 * sum(len(t) for _, t in own) >= sum(len(t) for _, t in texts):
            texts = own
    return "\n\n".join(t for _, t in texts if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 256):
        texts = []
        mains, outs, shared = (batch.column(k).to_pylist() for k in (3, 4, 5))
        for page, main, out, same in zip(texts_of(batch, "html"), mains, outs, shared, strict=True):
            of = None if main is None else Template(main, frozenset(out), frozenset((x["path"], x["print"]) for x in same))
            texts.append(main_text(page, of))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Text within a block has single blanks and no white space at its ends; blocks are in page order, an
    empty line between them. Null or empty html gives an empty text. Null or repeated page_ids and urls
    stay as they are, and pages that repeat a page count once for the template; extra columns are left out.
    """
    out = materialize(templates(classes(pages)), "templates")
    size = out.agg(F.sum(24 + 8 * F.size("out") + 16 * F.size("texts")).alias("n")).first()["n"] or 0
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    joined = rows.join(F.broadcast(out) if size <= MOST_BROADCAST else out, "host", "left").select("page_id", "url", "html", "main", "out", "texts")
    text = joined.mapInArrow(_extract, "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
