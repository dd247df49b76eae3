"""Main text of web pages by equivalence-class template deduction (operator 2).

1. Tokens: a page's elements, each by its path, and its short text blocks, by path and text. An element's path is written in
   three ways: by labels (tags with classes and ids), and by tags with their number among equal siblings, counted from the first and
   from the last; the latter tell the parts of a site apart whose markup has no names. Paths are hashes made from the parent's.
2. Occurrence vectors: how often each token occurs on each page of its host. Pages of a host with equal text are copies of
   one page and count once. Vectors aren't stored: the exclusive or of a hash of (page, count) over pages, with the numbers of pages
   and of occurrences, stands for one; it combines in any order, so a host of any size is counted with partial aggregation.
3. Equivalence classes: tokens of a host with the same vector, on half of the host's pages or more. A class nests into the
   template if its elements' parents belong to it already; its text tokens do if, besides, the class holds an element too. So a
   passage that many pages quote is no template by itself, while what a site prints with its own markup, or on every page, is.
   Text tokens of the template are boilerplate; inside the main slot only from LEAST_PAGES_MAIN distinct pages on.
4. Slots are what the template's elements enclose. From the page's root the search for the main slot goes down to the container (once
   a page) that holds at least MOST of the text that varies, as long as there is one; of the three ways to write paths the one
   that leads deepest is taken. Text outside the main slot is left out, but for the page's heading, articles, and paragraphs
   that stand right beside the slot. A page without the slot is read as a whole.
5. Names: menus, headers, footers, sidebars, forms, scripts and styles have elements of their own in HTML, which are left out; so are
   elements whose class or id says advert, cookie notice or reader comments. Names that articles use as well (notice, share,
   related ...) count only for elements of the host's template. An element that encloses the page's main heading is
   never left out by its name, nor is anything if no text would remain.
   A host with less than two distinct pages has no template: names decide alone there, and article or main elements
   are followed if they hold half of the page's text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. Null or empty
html gives an empty text; markup that is cut or not closed is read as far as it goes. Very long and very deep pages take time in
proportion. A null or odd url counts as a host of its own name. Ties between slots go to labels, then to the smaller hash. Rows that
repeat a page_id are extracted one by one. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A token belongs to a template if it is on this share of the host's pages, and on this many.
SHARE, LEAST_PAGES = 0.5, 2
#: Text inside the main slot must be on this many distinct pages as well: two that share a passage quote it or are near copies.
LEAST_PAGES_MAIN = 3
#: Text blocks longer than this are never boilerplate by repetition.
SHORT = 300
#: The main slot holds this share of its parent's varying text; article and main elements need this much.
MOST, MOST_TAGGED = 0.75, 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z]+")
_CUT = re.compile(r"<[/a-zA-Z!?][^<>]*\Z")

# Element names of the HTML standard by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math object".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd figure figcaption".split())
_LEFT_OUT = frozenset("nav footer aside form button select dialog menu head".split())
_MAIN = frozenset(("article", "main"))
_LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words of class and id attributes that name what isn't main text, always and in a site's template only.
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr nav navbar menu breadcrumb breadcrumbs sidebar footer masthead comments disqus replies newsletter subscribe popup modal".split())
_NAMES_TEMPLATE = frozenset("sponsor promo promotion banner notice notices navigation comment share sharing social related overlay".split())

#: Ways to write an element's path: labels, numbers from the last, numbers from the first; and text tokens.
LABELS, FROM_LAST, FROM_FIRST, TEXT = range(4)
#: Flags of tokens: in an article or main element; a container; named by a word that needs the template.
IS_MAIN, IS_CONTAINER, IS_NAMED = 1, 2, 4
_FIELDS = ["kind", "token", "parent", "parent_last", "parent_first", "flags", "count", "chars"]


class Page:
    """The elements of a page in order (parents first) and its text blocks (raw text, element)."""

    def __init__(self) -> None:
        self.parent, self.tag, self.label, self.role, self.blocks = [-1], [""], [""], [0], []

    def add(self, parent: int, tag: str, label: str, role: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.label.append(label)
        self.role.append(role)
        return len(self.parent) - 1

    def inherited(self, own: list[bool]) -> list[bool]:
        """Whether an element or one that encloses it has the property."""
        for i in range(1, len(own)):
            own[i] = own[i] or own[self.parent[i]]
        return own

    def enclosing(self, own: list[bool]) -> list[bool]:
        """Whether an element or one inside it has the property."""
        for i in range(len(own) - 1, 0, -1):
            if own[i]:
                own[self.parent[i]] = True
        return own

    def paths(self, kind: int) -> list[int]:
        """A hash of each element's path; 0 for the root."""
        n, out = len(self.parent), [0] * len(self.parent)
        names = self.label
        if kind != LABELS:
            seen: Counter = Counter()
            names = [""] * n
            for i in range(1, n) if kind == FROM_FIRST else range(n - 1, 0, -1):
                key = self.parent[i], self.tag[i]
                seen[key] += 1
                names[i] = f"{self.tag[i]}{seen[key]}"
        for i in range(1, n):
            out[i] = xxhash.xxh64_intdigest(names[i], out[self.parent[i]])
        return out


#: What an element's own tag and attributes say.
ROLE_OUT, ROLE_NAMED, ROLE_MAIN, ROLE_HEADER = 1, 2, 4, 8


def _role(tag: str, attributes: str) -> tuple[int, str]:
    """What an element's tag and attributes say about it, and its label."""
    role = (ROLE_OUT if tag in _LEFT_OUT else 0) | (ROLE_MAIN if tag in _MAIN else 0) | (ROLE_HEADER if tag == "header" else 0)
    label = tag
    if attributes.strip(" \t\r\n/"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                if value:
                    label += ("." if name == "class" else "#") + _DIGITS.sub("9", ".".join(value.split()))
                parts = frozenset(_PARTS.split(value))
                role |= (0 if _NAMES.isdisjoint(parts) else ROLE_OUT) | (0 if _NAMES_TEMPLATE.isdisjoint(parts) else ROLE_NAMED) | (ROLE_HEADER if "header" in parts else 0)
            elif name == "role":
                role |= (ROLE_OUT if value in _LEFT_OUT_ROLES else 0) | (ROLE_MAIN if value == "main" else 0)
            elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                role |= ROLE_OUT
    return role, label


def read_page(text: str) -> Page:
    """Elements and text blocks of a page, in one pass."""
    page, held, opened = Page(), [], Counter()
    stack: list[tuple[str, int]] = [("", 0)]  # (tag, the element that text stands in)
    at, n, low = 0, len(text), None

    def flush() -> None:
        if held:
            raw = "".join(held)
            held.clear()
            if raw and not raw.isspace():
                page.blocks.append((raw, stack[-1][1]))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            cut = _CUT.search(text, at)  # a tag that the page ends in isn't text
            held.append(text[at : cut.start()] if cut else text[at:])
            break
        if m.start() > at:
            held.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline = tag in _INLINE
        if m[1]:
            if tag in ("br", "hr"):
                held.append(" ")
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if not inline or stack[i][1] != stack[i - 1][1]:
                            flush()
                        while len(stack) > i:
                            pop()
                        break
                    if inline and stack[i][0] not in _INLINE:
                        break
            elif not inline:
                flush()
            continue
        if tag in _RAW:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            if low is None:
                low = text.lower() if text.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), text)
            end = low.find("</" + tag, at)
            close = text.find(">", end) if end >= 0 else -1
            at = n if close < 0 else close + 1
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        if inline:
            role, label = _role(tag, m[3]) if m[3] else (0, tag)
            element = stack[-1][1]
            if role:
                flush()
                element = page.add(element, tag, label, role)
            stack.append((tag, element))
            opened[tag] += 1
            continue
        flush()
        # a paragraph ends where a block begins, a list item where the next begins; inline elements left open end with them
        while len(stack) > 1 and (stack[-1][0] in _INLINE or stack[-1][0] == "p" or (tag == "li" and stack[-1][0] == "li")):
            pop()
        role, label = _role(tag, m[3])
        stack.append((tag, page.add(stack[-1][1], tag, label, role)))
        opened[tag] += 1
    flush()
    return page


def block_text(raw: str) -> str:
    return " ".join(_html.unescape(raw).split()) if "&" in raw else " ".join(raw.split())


class Furniture(NamedTuple):
    """By element: left out for its name, left out if its name counts, in an article or main element, in the page's heading."""

    out: list[bool]
    named: list[bool]
    main: list[bool]
    heading: list[bool]


def furniture(page: Page) -> Furniture:
    """What names say about a page's elements."""
    heads = [t == "h1" for t in page.tag]
    around = page.enclosing([h or t == "main" for h, t in zip(heads, page.tag, strict=True)])
    main = page.inherited([bool(r & ROLE_MAIN) for r in page.role])
    out = [False] * len(page.role)
    named = [False] * len(page.role)
    for i in range(1, len(out)):
        r = page.role[i]
        header = bool(r & ROLE_HEADER) and not main[page.parent[i]]
        out[i] = (header and not main[i]) or (bool(r & ROLE_OUT) and not around[i])
        named[i] = bool(r & ROLE_NAMED) and not around[i]
    out = page.inherited(out)
    if page.blocks and all(out[e] for _, e in page.blocks):  # nothing would remain
        out = [False] * len(out)
    return Furniture(out, named, [a and not b for a, b in zip(main, out, strict=True)], page.inherited(heads))


def text_tokens(page: Page, labels: list[int], blocks: list[tuple[str, int]]) -> list[int | None]:
    """The token of each short block; None for long ones."""
    return [xxhash.xxh64_intdigest(block_text(raw).encode("utf-8", "surrogatepass"), labels[e] ^ 1) if len(raw) <= SHORT else None for raw, e in blocks]


def page_tokens(text: str) -> tuple[bytes, np.ndarray]:
    """(digest of a page's text and where it stands, its tokens as rows of _FIELDS). The first row stands for the page as a whole."""
    page = read_page(text)
    about = furniture(page)
    blocks = [(raw, e) for raw, e in page.blocks if not about.out[e]]
    paths = [page.paths(k) for k in (LABELS, FROM_LAST, FROM_FIRST)]
    size = [0] * len(page.parent)
    digest = hashlib.blake2b(digest_size=16)
    for raw, e in blocks:
        size[e] += len(raw)
        digest.update(f"{paths[LABELS][e]} {block_text(raw)}\n".encode("utf-8", "surrogatepass"))
    for i in range(len(size) - 1, 0, -1):
        size[page.parent[i]] += size[i]
    rows: dict[tuple[int, int], list[int]] = {(LABELS, 0): [LABELS, 0, 0, 0, 0, 0, 1, size[0]]}
    for i in range(1, len(size)):
        if about.out[i]:
            continue
        flags = (IS_MAIN if about.main[i] else 0) | (0 if page.tag[i] in _FLOW or page.tag[i] in _INLINE else IS_CONTAINER) | (IS_NAMED if about.named[i] else 0)
        for kind in (LABELS, FROM_LAST, FROM_FIRST):
            if kind != LABELS and (page.tag[i] in _FLOW or page.tag[i] in _INLINE):
                continue  # only containers can be slots
            row = rows.setdefault((kind, paths[kind][i]), [kind, paths[kind][i], paths[kind][page.parent[i]], 0, 0, flags, 0, 0])
            row[6] += 1
            row[7] += size[i]
    for (raw, e), token in zip(blocks, text_tokens(page, paths[LABELS], blocks), strict=True):
        if token is not None:
            row = rows.setdefault((TEXT, token), [TEXT, token, *(paths[k][e] for k in (LABELS, FROM_LAST, FROM_FIRST)), IS_MAIN * about.main[e], 0, 0])
            row[6] += 1
            row[7] += len(raw)
    return digest.digest(), np.array(list(rows.values()), np.uint64)


def host_column():
    return F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit("")), F.lit("?"))


_TOKENS = "host string, kind int, token long, parent long, parent_last long, parent_first long, flags int, pages long, total long, vector long, chars long"
#: Tokens of one batch that are combined at a time.
_HELD = 200_000


def _combined(host: np.ndarray, rows: np.ndarray, vector: np.ndarray) -> pd.DataFrame:
    """Rows of one token of a host added up."""
    order = np.lexsort((rows[:, 1], rows[:, 0], host))
    host, rows, vector = host[order], rows[order], vector[order]
    new = np.ones(len(order), bool)
    new[1:] = (host[1:] != host[:-1]) | (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(rows[:, 2:6], at)  # a text token's place: any of those it has, but the same everywhere
    return pd.DataFrame({
        "host": host[at], "kind": rows[at, 0].astype(np.int32), "token": rows[at, 1].view(np.int64), "parent": low[:, 0].copy().view(np.int64), "parent_last": low[:, 1].copy().view(np.int64),
        "parent_first": low[:, 2].copy().view(np.int64), "flags": low[:, 3].astype(np.int32), "pages": np.diff(np.append(at, len(order))),
        "total": np.add.reduceat(rows[:, 6], at).astype(np.int64), "vector": np.bitwise_xor.reduceat(vector, at).view(np.int64), "chars": np.add.reduceat(rows[:, 7], at).astype(np.int64),
    })


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """pages, total, vector and chars of every token of a host; copies of a page count once. pages: (host, html)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [page_tokens(t) for t in pdf["html"].tolist()]
            yield pd.DataFrame({"host": pdf["host"], "digest": [d for d, _ in found], "tokens": [t.tobytes() for _, t in found]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, n = [], 0
            for host, digest, data in zip(pdf["host"].tolist(), pdf["digest"].tolist(), pdf["tokens"].tolist(), strict=True):
                rows = np.frombuffer(data, np.uint64).reshape(-1, len(_FIELDS))
                counts, back = np.unique(rows[:, 6], return_inverse=True)
                vector = np.array([xxhash.xxh64_intdigest(b"%s%d" % (bytes(digest), c)) for c in counts.tolist()], np.uint64)[back]
                held.append((np.full(len(rows), host, object), rows, vector))
                n += len(rows)
                if n >= _HELD:
                    yield _combined(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if held:
                yield _combined(*map(np.concatenate, zip(*held, strict=True)))

    # only tokens are shuffled, and copies meet before that; which copy's tokens stay doesn't depend on their order
    distinct = pages.mapInPandas(read, "host string, digest binary, tokens binary").groupBy("host", "digest").agg(F.min("tokens").alias("tokens"))
    summed = [f(c).alias(c) for f, cs in ((F.min, ("parent", "parent_last", "parent_first", "flags")), (F.sum, ("pages", "total", "chars")), (F.bit_xor, ("vector",))) for c in cs]
    return distinct.mapInPandas(run, _TOKENS).groupBy("host", "kind", "token").agg(*summed)


class Template(NamedTuple):
    """Of a host: which way its paths are written, the elements from the page's first to the main slot, boilerplate text tokens, and elements left out by name."""

    kind: int
    chain: list[int]
    boilerplate: list[int]
    named: list[int]


def deduce(tokens: list[dict], pages: int, chars: int) -> Template:
    """The template of a host from its frequent tokens (rows of occurrence_vectors), of so many distinct pages and characters."""
    classes: dict[tuple[int, int, int], list[dict]] = {}
    for t in tokens:
        classes.setdefault((t["pages"], t["total"], t["vector"]), []).append(t)
    template = {(k, 0) for k in (LABELS, FROM_LAST, FROM_FIRST)}
    elements: dict[tuple[int, int], dict] = {}
    text: list[dict] = []
    every = (pages, pages)
    for key, members in sorted(classes.items(), key=lambda x: (-x[0][0], x[0][1], x[0][2])):
        open_, nested = [t for t in members if t["kind"] != TEXT], True
        holds = key[:2] == every
        while nested:  # parents first, as far as they are in this class
            nested = [t for t in open_ if (t["kind"], t["parent"]) in template]
            open_ = [t for t in open_ if (t["kind"], t["parent"]) not in template]
            template |= {(t["kind"], t["token"]) for t in nested}
            elements |= {(t["kind"], t["token"]): t for t in nested}
            holds = holds or bool(nested)
        if holds:
            text += [t for t in members if t["kind"] == TEXT and (LABELS, t["parent"]) in template]
    parent_of = {LABELS: "parent", FROM_LAST: "parent_last", FROM_FIRST: "parent_first"}
    # below LEAST_PAGES_MAIN pages the main slot's text isn't boilerplate, so the slot is looked for without it first
    sure = [t for t in text if t["pages"] >= LEAST_PAGES_MAIN or not t["flags"] & IS_MAIN]
    best: tuple = ()
    for kind in (LABELS, FROM_LAST, FROM_FIRST):
        fixed: Counter = Counter()  # boilerplate inside an element
        for t in sure:
            e = t[parent_of[kind]]
            while True:
                fixed[e] += t["chars"]
                if not e or (kind, e) not in elements:
                    break
                e = elements[kind, e]["parent"]
        children: dict[int, list[dict]] = {}
        for (k, _), t in elements.items():
            if k == kind and t["flags"] & IS_CONTAINER and t["total"] == t["pages"]:
                children.setdefault(t["parent"], []).append(t)
        chain, whole = [], chars - fixed[0]
        while inner := children.get(chain[-1] if chain else 0):
            varying = lambda t: t["chars"] - fixed[t["token"]]  # noqa: B023, E731
            top = max(inner, key=lambda t: (varying(t), -t["token"]))
            if varying(top) <= 0 or varying(top) < whole * (MOST_TAGGED if top["flags"] & IS_MAIN else MOST):
                break
            chain.append(top["token"])
            whole = varying(top)
        best = max(best, (len(chain), whole, -kind, chain))
    kind, chain = -best[2], best[3]
    inside = lambda t: bool(chain) and _under(t[parent_of[kind]], chain[-1], kind, elements)
    boilerplate = sorted(t["token"] for t in text if t["pages"] >= LEAST_PAGES_MAIN or not (t["flags"] & IS_MAIN or inside(t)))
    named = sorted(t["token"] for (k, _), t in elements.items() if k == LABELS and t["flags"] & IS_NAMED)
    return Template(kind, chain, boilerplate, named)


def _under(element: int, top: int, kind: int, elements: dict[tuple[int, int], dict]) -> bool:
    while element and element != top:
        if (kind, element) not in elements:
            return False
        element = elements[kind, element]["parent"]
    return element == top


def templates(vectors: DataFrame) -> DataFrame:
    """(host, template) of every host of two distinct pages or more, the template as packed numbers. Frequent tokens only: at most 1 / SHARE pages' worth of them for a host."""
    whole = (F.col("kind") == LABELS) & (F.col("token") == 0)
    hosts = vectors.where(whole).select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    need = F.greatest(F.ceil(F.col("all_pages") * SHARE), F.lit(LEAST_PAGES))
    frequent = vectors.where(~whole & (F.col("pages") >= LEAST_PAGES)).join(hosts, "host").where(F.col("pages") >= need)
    columns = [c for c in _TOKENS.replace(",", "").split(" ")[2::2]]
    grouped = frequent.groupBy("host").agg(F.first("all_pages").alias("all_pages"), F.first("all_chars").alias("all_chars"), F.collect_list(F.struct(*columns)).alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [packed(deduce(list(t), int(p), int(c))) for t, p, c in zip(pdf["tokens"], pdf["all_pages"], pdf["all_chars"], strict=True)]
            yield pd.DataFrame({"host": pdf["host"], "template": found})

    return grouped.mapInPandas(run, "host string, template binary")


def packed(t: Template) -> bytes:
    return np.array([t.kind, len(t.chain), len(t.boilerplate), *t.chain, *t.boilerplate, *t.named], np.int64).tobytes()


def unpacked(data: bytes) -> Template:
    """A template for main_text(): unsigned numbers, as pages give them."""
    a = np.frombuffer(data, np.int64)
    kind, n, m = a[:3].tolist()
    rest = a[3:].view(np.uint64).tolist()
    return Template(kind, rest[:n], frozenset(rest[n : n + m]), frozenset(rest[n + m :]))


def main_text(text: str, template: Template | None = None) -> str:
    """The text of a page in its host's main slot; without a template what names leave."""
    page = read_page(text)
    about = furniture(page)
    out = about.out
    if template is None:
        out = page.inherited([a or b for a, b in zip(out, about.named, strict=True)])
        blocks = [b for b in page.blocks if not out[b[1]]] or [b for b in page.blocks if not about.out[b[1]]]
        tagged = [b for b in blocks if about.main[b[1]]]
        if 2 * sum(len(raw) for raw, _ in tagged) >= sum(len(raw) for raw, _ in blocks):
            blocks = tagged
    else:
        labels = page.paths(LABELS)
        if template.named:
            out = page.inherited([a or (b and p in template.named) for a, b, p in zip(out, about.named, labels, strict=True)])
        blocks = [b for b in page.blocks if not out[b[1]]]
        if template.boilerplate:
            blocks = [b for b, t in zip(blocks, text_tokens(page, labels, blocks), strict=True) if t is None or t not in template.boilerplate]
        if template.chain:
            blocks = _in_slot(page, about, template, labels, blocks)
    return " ".join(t for raw, _ in blocks if (t := block_text(raw)))


def _in_slot(page: Page, about: Furniture, template: Template, labels: list[int], blocks: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Blocks in the main slot, in headings and articles, and in paragraphs right beside it; all blocks on a page without the slot."""
    paths = labels if template.kind == LABELS else page.paths(template.kind)
    slot = page.inherited([p == template.chain[-1] for p in paths])
    if not any(slot):
        return blocks
    chain = {0, *template.chain}
    beside = [p in chain for p in paths]
    for i in range(1, len(beside)):  # flow elements right inside an element of the chain
        beside[i] = beside[i] or (beside[page.parent[i]] and page.tag[i] in _FLOW)
    return [(raw, e) for raw, e in blocks if slot[e] or about.main[e] or about.heading[e] or beside[e]]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    common.small_batches(pages.sparkSession, 200)
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", host_column().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    with common.temporary(pages.sparkSession):
        found = common.kept(templates(common.materialise(occurrence_vectors(rows.select("host", "html")), "html-vectors")), "html-templates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, Template] = {}
        for pdf in batches:
            text = []
            for page, data in zip(pdf["html"].tolist(), pdf["template"].tolist(), strict=True):
                if data is not None and data not in known:
                    known = {} if len(known) >= 256 else known
                    known[data] = unpacked(data)
                text.append(main_text(page, None if data is None else known[data]))
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": np.array([len(t) for t in text], np.int64)})

    # Spark broadcasts the templates while their files are below the broadcast threshold; else adaptive execution splits hot hosts.
    # A template is smaller than a page of its host, so rows that carry it as one packed value at most double.
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
