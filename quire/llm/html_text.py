"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements under their paths (names with classes, ids and roles) and its runs of text
under theirs. A token's occurrence vector says how often it stands in each page of the host; tokens with the same
vector form an equivalence class. Classes that span at least MIN_SUPPORT of the host's pages are valid if their
tokens stand once a page, in one order (checked on each page), and each under an element that is valid itself, so
that classes nest; a class needs two tokens, one of them an element. The valid classes are the template, and what lies
between their tokens are slots. Text tokens of the template (on hosts of MIN_PAGES pages or more), and text that stands
wherever its element does (one vector), are frame and not extracted, unless they are most of the slot.

The main slot is the innermost container of the template that holds most of the host's free text; where an article element
is one of those that do, it is the slot, whatever is inside. An article's own header stays. Inside the slot, slots of menus, headers, footers, sidebars, notices, adverts, forms and comments are left
out by their tag, or by a whole class, id or role unless nearly all free text of the page is in them; a class, id or
role of several words that has one of these names among them counts only where links outweigh free text. Ids of
headings name their topic and don't count. A page that lacks the host's slot is a host of its own.

A vector is kept as two sums of 32-bit halves of a hash of (page, count), with its support; all are summed up in the
worker before a row a token leaves it, so a host with a third of all pages is no hot group. The templates are
one row a host and join the pages, as a broadcast only if their measured size is under Spark's threshold. A page is
parsed twice, once for its tokens and once for its text, in time linear in its length.

Results: null html gives an empty text, a null or odd url the host of pages without one. Repeated pages are
extracted each and count each in the vectors. Ties of slots go to the deeper, then to the fuller, then to the least
path. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import html as html_entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import column, map_batches
from quire.session import materialise

MIN_SUPPORT, MOST, MIN_PAGES = 0.8, 0.6, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^<>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mstyle mpadded mphantom menclose mfenced mtable mtr mtd".split())
_CONTAINERS = frozenset("html body main article section div td center".split())
_JUNK_TAGS = frozenset("head nav header footer aside form menu dialog button select option fieldset".split()) | _RAW
_JUNK_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside comment comments disqus replies cookie cookies consent notice notices popup modal newsletter subscribe form search".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body main article section div td th ul ol dl table nav header footer aside form blockquote".split())

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Above this share of a page's free text no name makes an element junk; one of several words not even above the second.
NEARLY_ALL, HALF = 0.9, 0.5

ROOT = 1


class _Element:
    __slots__ = ("above", "article", "depth", "free", "index", "junk", "link", "linked", "name", "part", "path", "tag_junk", "whole")

    def __init__(self, name: str, path: int, above: _Element | None, depth: int, index: int, whole: bool = False, part: bool = False) -> None:
        self.name, self.path, self.above, self.depth, self.index, self.whole, self.part = name, path, above, depth, index, whole, part
        self.article = name == "article" or (above is not None and above.article)
        own_title = name == "header" and self.article  # an article's header holds its title
        self.tag_junk = (name in _JUNK_TAGS and not own_title) or (above is not None and above.tag_junk)
        self.junk = self.tag_junk
        self.link = name == "a" or (above is not None and above.link)
        self.free = self.linked = 0  # words below, outside what a tag makes junk


@functools.lru_cache(maxsize=1 << 14)
def _named(name: str, attributes: str) -> tuple[str, bool, bool]:
    """The token's label, and whether a whole class, id or role is a junk word, or a part of one between hyphens."""
    label, whole, part = name, False, False
    if attributes and "=" in attributes:
        found = sorted((k, (a or b or c).lower()) for k, a, b, c in ((m[0].lower(), *m[1:]) for m in _ATTRIBUTE.findall(attributes)) if k in ("class", "id", "role"))
        if found:
            label += "".join(f"[{k}={v}]" for k, v in found)
            if name not in ("html", "body", "article", "main"):
                names = [x for k, v in found if k != "id" or name not in _HEADINGS for x in v.split()]
                whole = any(x in _JUNK_WORDS for x in names)
                part = any(w in _JUNK_WORDS for x in names for w in re.split(r"[-_]", x))
    return label, whole, part


def _below(path: int, label: str) -> int:
    """The path of an element with this label under one of that path."""
    return xxhash.xxh64_intdigest(label, path & 0xFFFFFFFF) ^ (path << 1 & 0xFFFFFFFFFFFFFFFF)


def text_token(path: int, text: str) -> int:
    """The token of a run of text under a path."""
    return xxhash.xxh64_intdigest(text, 11) ^ path


OPEN, CLOSE, TEXT, BREAK = range(4)


class Page:
    """A parsed page: its elements and its events (kind, innermost element, text), in one pass linear in its length."""

    def __init__(self, page: str) -> None:
        root = self.root = _Element("#root", ROOT, None, 0, 0)
        self.elements: list[_Element] = []
        self.events: list[tuple[int, _Element, str]] = []
        self._parse(page, [root])
        for kind, element, text in self.events:
            if kind == TEXT:
                if not element.tag_junk:
                    n = len(text.split())
                    if element.link:
                        element.linked += n
                    else:
                        element.free += n
            elif kind == CLOSE:
                element.above.free += element.free
                element.above.linked += element.linked
        most = root.free
        for element in self.elements:
            if not element.junk:
                whole = element.whole and not element.free > NEARLY_ALL * most
                part = element.part and not element.whole and element.linked >= element.free and not element.free > HALF * most
                element.junk = element.above.junk or whole or part

    def _parse(self, page: str, stack: list[_Element]) -> None:
        emit, elements, match = self.events.append, self.elements, _TOKEN.match
        # where in the stack the open elements of each name and those that aren't inline are, so that nothing is searched for
        places: dict[str, list[int]] = {}
        blocks = [0]
        at = start = 0

        def close_to(k: int) -> None:
            while len(stack) > k:
                element = stack.pop()
                places[element.name].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()
                emit((CLOSE, element, ""))

        def innermost(names) -> int:
            return max((held[-1] for n in names if (held := places.get(n))), default=0)

        while (at := page.find("<", at)) >= 0:
            m = match(page, at)
            if m is None:  # a sign, not a tag
                at += 1
                continue
            if at > start:
                emit((TEXT, stack[-1], page[start:at]))
            at = start = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                held = places.get(name)
                if held and (name not in _INLINE or held[-1] > blocks[-1]):  # an inline end tag closes nothing beyond its block
                    close_to(held[-1])
                continue
            if name == "br":
                emit((BREAK, stack[-1], ""))
                continue
            if name in _VOID:
                continue
            if name not in _INLINE:
                shut = ("p", *_CLOSES.get(name, ()))
                k = innermost(shut)
                if k and k > innermost(_SCOPE.difference(shut)):
                    close_to(k)
                    while stack[-1].name in shut:
                        close_to(len(stack) - 1)
            above = stack[-1]
            label, whole, part = _named(name, m[3]) if m[3] else (name, False, False)
            element = _Element(name, _below(above.path, label), above, len(stack), len(self.events), whole, part)
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = start = len(page) if end is None else end.start()
            places.setdefault(name, []).append(len(stack))
            if name not in _INLINE:
                blocks.append(len(stack))
            stack.append(element)
            elements.append(element)
            emit((OPEN, element, ""))
        if start < len(page):
            emit((TEXT, stack[-1], page[start:]))
        close_to(1)

    def tokens(self) -> dict[int, list]:
        """By token: occurrences, free and linked words, junk, first event, depth, name and the token above; text runs have the name ''."""
        out: dict[int, list] = {ROOT: [1, self.root.free, self.root.linked, False, -1, 0, "#root", 0]}
        for e in self.elements:
            row = out.get(e.path)
            if row is None:
                out[e.path] = [1, e.free, e.linked, e.junk, e.index, e.depth, e.name, e.above.path]
            else:
                row[0] += 1
                row[1] += e.free
                row[2] += e.linked
        for i, (kind, e, text) in enumerate(self.events):
            if kind == TEXT and not e.tag_junk and (words := text.split()):
                token = text_token(e.path, " ".join(words))
                row = out.get(token)
                if row is None:
                    out[token] = [1, 0, 0, False, i, e.depth + 1, "", e.path]
                else:
                    row[0] += 1
        return out

    def text(self, main: int, template: Template | None = None) -> str | None:
        """The text of the slot `main` less the template's; None if the page lacks the slot."""
        pieces = self._pieces(main, template.fixed(self.tokens()) if template and template.has_text else frozenset())
        if pieces is None:
            return None
        blocks, gone, words = pieces
        if 2 * gone > words:  # what makes up most of the slot is no frame around it
            blocks = self._pieces(main, frozenset())[0]
        return "\n\n".join(blocks)

    def _pieces(self, main: int, fixed: frozenset[int] | set[int]) -> tuple[list[str], int, int] | None:
        """The blocks of the slot without the text tokens of `fixed`, their words left out and all words."""
        blocks: list[str] = []
        held: list[str] = []
        inside = gone = words = 0
        found = False

        def flush() -> None:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(text)
            held.clear()

        for kind, element, text in self.events:
            if kind == OPEN:
                if inside or (element.path == main and not element.junk):
                    inside += 1
                    found = True
                if held and element.name not in _INLINE:
                    flush()
            elif kind == CLOSE:
                if held and element.name not in _INLINE:
                    flush()
                inside -= inside > 0
            elif inside and not element.junk:
                if kind == BREAK:
                    held.append(" ")
                    continue
                if fixed:
                    n = text.split()
                    words += len(n)
                    if n and text_token(element.path, " ".join(n)) in fixed:
                        gone += len(n)
                        continue
                held.append(html_entities.unescape(text) if "&" in text else text)  # each run by itself: no reference reaches across a tag or comment
        flush()
        return (blocks, gone, words) if found else None


def choose(rows: list[tuple[int, int, int, int, str]]) -> int | None:
    """The slot among template containers, given (path, free words, linked words, depth, name): of those that hold MOST of
    the most text outside links the innermost; an article element among these goes before what is inside it."""
    most = max((r[1] - r[2] for r in rows), default=0)
    fit = [r for r in rows if r[1] - r[2] >= MOST * most]
    return max(fit, key=lambda r: (r[4] == "article", r[3], r[1], -r[0]))[0] if fit else None


class Template:
    """The valid classes of a host: constant text tokens of repeated elements, and classes of tokens once a page in their order."""

    def __init__(self, packed: bytes) -> None:
        values = np.frombuffer(packed, dtype="<u8").tolist()
        n = values[0]
        self.constant = set(values[1 : n + 1])
        self.classes: list[list[int]] = []
        self.text_of: list[set[int]] = []
        at = n + 1
        while at < len(values):
            size, texts = values[at], values[at + 1]
            self.classes.append(values[at + 2 : at + 2 + size])
            self.text_of.append(set(values[at + 2 + size : at + 2 + size + texts]))
            at += 2 + size + texts
        self.has_text = bool(self.constant or any(self.text_of))

    def fixed(self, tokens: dict[int, list]) -> set[int]:
        """The text tokens that are the template's on a page: of classes that it holds whole, once and in order."""
        out = set(self.constant)
        for members, texts in zip(self.classes, self.text_of):
            if texts:
                rows = [tokens.get(t) for t in members]
                if all(r is not None and r[0] == 1 for r in rows) and all(a[4] < b[4] for a, b in zip(rows, rows[1:])):
                    out |= texts
        return out


def fit_template(rows: list[dict]) -> tuple[int | None, bytes]:
    """The main slot and the packed template of one host, from its tokens of sufficient support.

    Tokens with one occurrence vector are a class. Its elements once a page are valid where the element above them is
    (so that classes nest), and the class is valid with two tokens at least, one of them an element. A text token is the
    template's in a valid class, or if the element around it has its vector: it stands wherever that element does."""
    kept = {ROOT}
    for r in sorted((r for r in rows if r["name"]), key=lambda r: r["depth"]):
        if r["once"] and r["above"] in kept:
            kept.add(r["token"])
    classes: dict[tuple[int, int, int], list[dict]] = {}
    for r in rows:
        classes.setdefault((r["pages"], r["low"], r["high"]), []).append(r)
    constant: list[int] = []
    packed: list[int] = []
    for _, members in sorted(classes.items()):
        elements = {r["token"] for r in members if r["name"]}
        valid = sorted((r for r in members if r["once"] and (r["token"] in kept if r["name"] else r["above"] in kept)), key=lambda r: (r["at"], r["token"]))
        texts = [r["token"] for r in valid if not r["name"]]
        if len(valid) >= 2 and len(texts) < len(valid):
            packed += [len(valid), len(texts), *(r["token"] for r in valid), *texts]
        constant += sorted(r["token"] for r in members if not r["name"] and not r["once"] and r["above"] in elements)
    slots = [(r["token"], r["free"], r["linked"], r["depth"], r["name"]) for r in rows if r["token"] in kept and r["name"] in _CONTAINERS and 2 * r["junk"] <= r["pages"]]
    return choose(slots), np.array([len(constant), *constant, *packed], dtype="<u8").tobytes()


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def extract(page: str | None, main: int | None, template: Template | None = None) -> str:
    """The main text; a page without the host's slot is judged by its own classes."""
    parsed = Page(page or "")
    text = parsed.text(main, template) if main is not None else None
    if text is None:
        seen: dict[int, list[_Element]] = {}
        for e in parsed.elements:
            seen.setdefault(e.path, []).append(e)
        own = choose([(p, e[0].free, e[0].linked, e[0].depth, e[0].name) for p, e in seen.items() if len(e) == 1 and not e[0].junk and e[0].name in _CONTAINERS])
        text = parsed.text(own) if own is not None else Page(f"<html>{page or ''}").text(_below(ROOT, "html"))
    return text or ""


_TOKENS = "host string, token long, pages long, low long, high long, once boolean, free long, linked long, junk long, at long, depth int, name string, above long"


def template_tokens(pages: DataFrame) -> DataFrame:
    """By host and token: pages (support), low and high (the occurrence vector), once (never twice in a page), free, linked,
    junk (pages where it is), at (sum of first events), depth, name ('' for text), above."""

    def work(batch: pa.RecordBatch) -> dict:
        sums: dict[tuple[str, int], list] = {}
        for url, page, key in zip(column(batch, "url").to_pylist(), column(batch, "html").to_pylist(), column(batch, "_k").to_pylist()):
            host = host_of(url)
            marks: dict[int, int] = {}
            for token, (count, free, linked, junk, at, depth, name, above) in Page(page or "").tokens().items():
                if count not in marks:
                    marks[count] = xxhash.xxh64_intdigest(f"{key},{count}", 7)
                mark = marks[count]
                row = sums.get((host, token))
                if row is None:
                    sums[(host, token)] = [1, mark & 0xFFFFFFFF, mark >> 32, count == 1, free, linked, int(junk), at, depth, name, above]
                    continue
                row[0] += 1
                row[1] += mark & 0xFFFFFFFF
                row[2] += mark >> 32
                row[3] &= count == 1
                row[4] += free
                row[5] += linked
                row[6] += junk
                row[7] += at
        keys, rows = list(sums), list(zip(*sums.values()))
        signed = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64))
        names = ("pages", "low", "high", "once", "free", "linked", "junk", "at", "depth", "name")
        return {"host": [k[0] for k in keys], "token": signed([k[1] for k in keys]), "above": signed(rows[10])} | {n: list(v) for n, v in zip(names, rows)}

    keyed = pages.select("url", "html", F.xxhash64("page_id", "url", "html").alias("_k"))
    sums = [F.sum(n).alias(n) for n in ("pages", "low", "high", "free", "linked", "junk", "at")]
    return map_batches(keyed, work, _TOKENS).groupBy("host", "token").agg(*sums, F.expr("bool_and(once)").alias("once"), F.min("depth").alias("depth"), F.min("name").alias("name"), F.min("above").alias("above"))


def templates(pages: DataFrame) -> DataFrame:
    """host, main (the token of its main slot) and template (packed) of each host; both from the tokens on MIN_SUPPORT of its pages."""
    tokens = materialise(template_tokens(pages), "tokens")
    totals = tokens.where(F.col("token") == ROOT).select("host", F.col("pages").alias("host_pages"))
    enough = (F.col("pages") >= MIN_SUPPORT * F.col("host_pages")) & ((F.col("name") != "") | (F.col("host_pages") >= MIN_PAGES))
    fields = ("token", "pages", "low", "high", "once", "free", "linked", "junk", "at", "depth", "name", "above")
    # a page has at least MIN_SUPPORT of these tokens on average, so a host's list is bounded by its pages' length
    by_host = tokens.join(totals, "host").where(enough).groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("rows"))

    def work(batch: pa.RecordBatch) -> dict:
        found = []
        for rows in column(batch, "rows").to_pylist():
            for r in rows:
                r["token"] &= 0xFFFFFFFFFFFFFFFF
                r["above"] &= 0xFFFFFFFFFFFFFFFF
            found.append(fit_template(rows))
        return {"host": column(batch, "host"), "main": pa.array(np.array([m or 0 for m, _ in found], dtype=np.uint64).view(np.int64)), "template": [t for _, t in found]}

    return map_batches(by_host, work, "host string, main long, template binary")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    hosts = materialise(templates(pages), "templates")
    found = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    joined = pages.select("page_id", "url", "html", found.alias("_host")).join(hosts.withColumnRenamed("host", "_host"), "_host", "left")

    def work(batch: pa.RecordBatch) -> dict:
        known: dict[bytes | None, Template | None] = {None: None}
        texts = []
        for page, main, packed in zip(column(batch, "html").to_pylist(), column(batch, "main").to_pylist(), column(batch, "template").to_pylist()):
            if packed not in known:
                known[packed] = Template(packed)
            texts.append(extract(page, main & 0xFFFFFFFFFFFFFFFF if main else None, known[packed]))
        return {"page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(joined, work, "page_id long, url string, text string, n_chars long")
