"""Main text of web pages, with site template removal.

A page is parsed into its elements. Every subtree with text is hashed, wherever it is on
the page; Spark counts the pages of each host that hold it, copies of one page counted
once, and subtrees that recur on many pages of their host are deleted. Paragraphs
inside an element that the page itself marks as its article are text, however often
they recur: only boxes in it can be template. What is left is the text: where a host has pages to
compare, no mark of an article is asked for. A page of a host with few pages has nothing to be
compared with; of it the marked article is taken, if there is one. Menus and adverts vary:
what markup names as no part of an article (menus, headers, footers, asides, adverts, notices,
comments) goes also where it does not recur.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A subtree is template if so many different pages of its host hold it,
MIN_PAGES = 4
#: and, but for what lies outside the article that a page marks, so large a share of them
MIN_SHARE = 0.3
#: or so many of them.
MANY_PAGES = 1000
_SLICE_CHARS = 4_000_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Names that tell what a page has, not what the element is.
_LAYOUT = re.compile(r"(?:no|has|with|without|is)[-_]")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th tr tbody thead figcaption".split())
#: What is no text of a page at all.
GONE = frozenset("form script style noscript template iframe svg canvas button select textarea input head title noembed noframes audio video".split())
#: Elements that are no part of an article.
ASIDE = frozenset("nav footer aside menu dialog".split())
#: Names in class, id or role that are no part of an article: outside one also as a word of a longer name.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments disqus respond reply replies newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay widget pagination pager skip search contentinfo complementary".split()
)
#: Those that count inside an article too: adverts, notices, menus (also of buttons), sidebars, forms and reader comments.
INSIDE = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo cookie cookies consent gdpr notice notices nav navbar navigation menu breadcrumb breadcrumbs sidebar newsletter share sharing comment comments".split())
#: Longer names that stand for one of them inside an article too.
_KIND = re.compile(r"(?:ads?|advert|advertisement|sponsored|promo|cookie|consent|comments?|newsletter|share|sharing|nav|menu|sidebar)[-_](?:box|block|slot|unit|banner|bar|list|section|wrapper|container|widget|buttons?|links?|form|area|posts|articles|signup)|(?:site|page|main|top|bottom|side|social|reader|user|post)[-_](?:nav|menu|header|footer|sidebar|share|comments?|ads?)")
#: Elements that end an open one of the same kind, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Page:
    """The elements of a page: tag, parent, whether no text (gone) or named as no part of an article, and its pieces of text in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.gone, self.named, self.marked = ["#"], [-1], [False], [False], [False]
        self.count: dict[str, int] = {}  # open elements of each name: what is not open need not be looked for
        self.parts: list[tuple[int, str | None]] = []  # (element, text); None: a block begins or ends
        stack, at, end = [0], 0, len(html)
        search = _TAG.search
        while at < end:
            m = search(html, at)
            self._text(stack[-1], html[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            self._open(stack, name, m[3] if m[2] else m[6])
            if name in RAW and not (m[3] or "").endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
                self._close(stack, name)

    def _text(self, node: int, text: str) -> None:
        if text:
            self.parts.append((node, htmllib.unescape(text) if "&" in text else text))

    def _open(self, stack: list[int], name: str, attrs: str) -> None:
        tag = self.tag
        if name == "br":
            self.parts.append((stack[-1], " "))
            return
        block = name not in INLINE
        if block and self.count.get("p"):
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if tag[stack[i]] == "p":
                    self._pop(stack, i)
                    break
                if tag[stack[i]] not in INLINE:
                    break
        if name in CLOSES and any(self.count.get(x) for x in CLOSES[name][0]):
            ends, until = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if tag[stack[i]] in until:
                    break
                if tag[stack[i]] in ends:
                    self._pop(stack, i)
                    break
        node = len(tag)
        tag.append(name)
        self.parent.append(stack[-1])
        inside = self.marked[stack[-1]]
        gone = name in GONE
        named = name in ASIDE or (name == "header" and not inside)
        marked = inside
        if attrs and not gone and "=" in attrs:
            for key, value in _ATTR.findall(attrs):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    own = [x for x in value.split() if not _LAYOUT.match(x)]
                    if inside:
                        named = named or any(x.lower() in INSIDE or _KIND.fullmatch(x.lower()) for x in own)
                    else:
                        words = {w.lower() for x in own for w in _WORD.findall(x)}
                        named = named or not words.isdisjoint(NAMES) or ("header" in words and name not in ("article", "main", "body", "html"))
                elif key == "itemprop" and value.lower() == "articlebody":
                    marked = True
            if name in ("html", "body", "main", "article"):
                named = named and name == "article" and bool(re.search(r"comment|promo|sponsor|related", attrs))
        self.gone.append(gone)
        self.named.append(named)
        self.marked.append(marked or name in ("article", "main"))
        if block:
            self.parts.append((stack[-1], None))
        if name not in VOID and not attrs.endswith("/") or name in RAW:
            stack.append(node)
            self.count[name] = self.count.get(name, 0) + 1

    def _pop(self, stack: list[int], i: int) -> None:
        for node in stack[i:]:
            if self.tag[node] not in INLINE:
                self.parts.append((self.parent[node], None))
                break
        for node in stack[i:]:
            self.count[self.tag[node]] -= 1
        del stack[i:]

    def _close(self, stack: list[int], name: str) -> None:
        if not self.count.get(name):
            return
        for i in range(len(stack) - 1, 0, -1):
            own = self.tag[stack[i]]
            if own == name:
                self._pop(stack, i)
                return
            if name in INLINE and own not in INLINE:
                return

    def article(self, dead: list[bool]) -> list[bool]:
        """Whether each element is in the part that holds the article: articles, else main, else everything."""
        out = [False] * len(self.tag)
        for kind in (("article",), ("main",), None):
            for i in range(len(self.tag)):
                out[i] = not dead[i] and (kind is None or self.tag[i] in kind or (kind[0] == "article" and self._body(i)) or (i > 0 and out[self.parent[i]]))
            if kind is None or any(out[node] and text and not text.isspace() for node, text in self.parts):
                return out
        return out

    def _body(self, i: int) -> bool:
        """Whether an attribute marks an element as an article's body."""
        return self.marked[i] and not self.marked[self.parent[i]] and self.tag[i] != "main"

    def below(self, *marks: list[bool]) -> list[bool]:
        """Whether an element or one that it is in has one of the marks."""
        out = [False]
        for i in range(1, len(self.tag)):
            out.append(out[self.parent[i]] or any(x[i] for x in marks))
        return out

    def candidate(self, i: int) -> bool:
        """Whether an element may be template: blocks, but for text blocks inside a marked article and what holds the page."""
        tag = self.tag[i]
        if tag in INLINE or tag in ("html", "body", "main", "article", "#"):
            return False
        return not (self.marked[self.parent[i]] and tag in LEAF)

    def hashes(self) -> list[int]:
        """A hash of each subtree: its tags and its text, white space aside."""
        inner: list[list[str]] = [[] for _ in self.tag]
        for node, text in self.parts:
            if text:
                inner[node].append("".join(text.split()))
        for i in range(len(self.tag) - 1, 0, -1):
            inner[i].reverse()
        out = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):  # children come after their parents
            body = "\x01".join(inner[i])
            out[i] = xxhash.xxh3_64_intdigest(f"{self.tag[i]}\x02{body}") if body else 0
            if i and body:
                inner[self.parent[i]].append(f"{out[i]:x}")
        return [h - (1 << 64) if h >= 1 << 63 else h for h in out]

    def text(self, template: frozenset = frozenset(), compared: bool = False) -> tuple[str, int, int]:
        """The main text, and the characters that were left out as template and for other reasons (scripts and the like aside).

        Of a page that was ``compared`` with others of its host, it is what template and
        names leave; of one that wasn't, the part that holds the article.
        """
        hashes = self.hashes() if template else None
        same = self.below([bool(hashes) and hashes[i] in template and self.candidate(i) for i in range(len(self.tag))])
        gone = self.below(self.gone)
        dead = self.below(self.gone, self.named, same)
        inside = [not x for x in dead] if compared else self.article(dead)
        blocks, now, cut, other = [], [], 0, 0
        for node, text in self.parts:
            if text is None:
                blocks.append(now)
                now = []
            elif inside[node] and not dead[node]:
                now.append(text)
            elif not gone[node]:
                n = sum(map(len, text.split()))
                cut, other = (cut + n, other) if same[node] else (cut, other + n)
        blocks.append(now)
        lines = (" ".join("".join(x).split()) for x in blocks if x)
        return "\n".join(x for x in lines if x), cut, other

    def candidates(self) -> dict[int, bool]:
        """Hashes of the subtrees with text that may be template, and whether they lie outside the article that the page marks."""
        gone, hashes, holds = self.below(self.gone), self.hashes(), [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            holds[self.parent[i]] |= holds[i] or (self.marked[i] and not self.marked[self.parent[i]])
        marks, out = any(self.marked), {}
        for i, h in enumerate(hashes):
            if h and not gone[i] and not holds[i] and self.candidate(i):
                out[h] = out.get(h, True) and marks and not self.marked[i]
        return out


def _slices(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    at, chars = 0, 0
    for i in range(batch.num_rows):
        chars += len(batch.column(col)[i].as_buffer() or b"") if batch.column(col)[i].is_valid else 0
        if chars >= _SLICE_CHARS or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at)
            at, chars = i + 1, 0


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of pages, and host, text (the main text, blocks joined by a line feed), template_chars and other_chars.

    The last two count the characters, white space aside, that were left out because
    their subtree recurs on the host, and for what markup says. A null or empty html
    gives an empty text; pages of a null or unreadable url have no host to be compared in, and
    nothing of them is template. Rows that repeat count as one page and get the same
    text. Columns of those four names are replaced; others may have any name but
    those that begin with __fw_.
    """
    new = ("host", "text", "template_chars", "other_chars")
    keep = [c for c in pages.columns if c not in new]
    host = F.nullif(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    own = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("__fw_host"), F.xxhash64(F.col(f"`{html_col}`")).alias("__fw_page"))
    rows = own.where(F.col("__fw_host").isNotNull() & (F.length(F.col(f"`{html_col}`")) > 0)).select(F.col("__fw_host").alias("host"), F.col("__fw_page").alias("page"), F.col(f"`{html_col}`").alias("html"))

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                found = [sorted(Page(x).candidates().items()) for x in part.column(2).to_pylist()]
                held = [pa.array([[x[i] for x in one] for one in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *held], ["host", "page", "hashes", "outside"])

    held = rows.mapInArrow(subtrees, "host string, page long, hashes array<long>, outside array<boolean>")
    held = materialize(held.groupBy("host", "page").agg(F.first("hashes").alias("hashes"), F.first("outside").alias("outside")), "subtrees")
    pages_of = materialize(held.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).withColumnRenamed("host", "p_host"), "hosts")
    each = held.select("host", "page", F.explode(F.arrays_zip("hashes", "outside")).alias("x")).select("host", "page", F.col("x.hashes").alias("hash"), F.col("x.outside").alias("outside"))
    often = each.groupBy("host", "hash").agg(F.count("*").alias("n"), F.count_if("outside").alias("n_outside")).where(F.col("n") >= min_pages)
    often = often.join(pages_of, F.col("host") == F.col("p_host"))
    often = often.where((F.col("n_outside") >= min_pages) | (F.col("n") >= F.col("pages") * min_share) | (F.col("n") >= MANY_PAGES)).select(F.col("host").alias("t_host"), F.col("hash").alias("t_hash"))
    # pages that were compared have a list, if an empty one
    compared = held.join(pages_of, F.col("host") == F.col("p_host")).select("host", "page", F.lit(None).cast("long").alias("hash"))
    drop = each.join(often, (F.col("host") == F.col("t_host")) & (F.col("hash") == F.col("t_hash")))
    drop = drop.select("host", "page", "hash").union(compared).groupBy(F.col("host").alias("__fw_d_host"), F.col("page").alias("__fw_d_page")).agg(F.collect_set("hash").alias("__fw_drop"))
    at = keep.index(html_col)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                drops = part.column(len(keep) + 1).to_pylist()
                out = [Page(x).text(frozenset(d or ()), d is not None) if x else ("", 0, 0) for x, d in zip(part.column(at).to_pylist(), drops, strict=True)]
                cols = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep) + 1], *cols], [*keep, *new])

    both = own.join(drop, (F.col("__fw_page") == F.col("__fw_d_page")) & (F.col("__fw_host") == F.col("__fw_d_host")), "left").select(*[F.col(f"`{c}`") for c in keep], F.col("__fw_host").alias("host"), "__fw_drop")
    return both.mapInArrow(texts, both.drop("__fw_drop").schema.add("text", "string").add("template_chars", "long").add("other_chars", "long"))
