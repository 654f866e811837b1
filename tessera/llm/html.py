"""Main text of web pages by composite text density.

A page becomes a tree of nodes. Each node has C characters of text, T tags, LC characters and LT
tags in links below it. Its composite density is

    C / T * log_b(C / LC * T / LT),  b = ln(C / nLC * LC + LCbody / Cbody * C + e),  nLC = C - LC

with 1 in place of zeros: characters for each tag, lowered where links hold them. The node with
the largest sum of its block children's densities holds the main text. Of that node's path to the body,
the first element that can be a whole article is taken, with all it holds: the article element around it if
there is one; else the first that isn't a part of a text itself, as lists, tables, quotes and sections are.
The smallest density on the path is the threshold: siblings on the path that reach it are main text as well, and
so are headings there that stand before it, blocks of the same tag and class that aren't mostly links, and
what stands between these. Where a page has one article element (or one main element) whose text isn't mostly
links, the node is looked for within it.

Parts that a page marks as menus, headers, footers, asides, forms, adverts, notices or comments never count. A
class or id marks an element only by a name's first or last word, and not where it says that there
is or isn't such a part (has-sidebar, ad-free); never an article, nor an element with most of the
page's text unless an article or main element stands outside it, or it is comments within an element with
a text of its own. Density decides on the rest.

Defined results: a null, empty or textless html gives an empty text; unclosed, wrongly nested and
cut-off markup is read as browsers read it, as far as text goes, in time in proportion to its length, however
deep; each repeated row has its own result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
      | <(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>
      | <[!?/][^>]*+(?:>|\Z)
      | <[a-zA-Z][^>]*+\Z""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset(f"h{k}" for k in range(1, 7)) | {"hgroup"}
#: A start tag in the value's set closes an open element of that name.
_P_CLOSERS = BLOCKS - frozenset("body caption dd dt head html legend li option optgroup tbody tfoot thead tr".split())
CLOSED_BY = {"p": _P_CLOSERS | {"li", "dd", "dt"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}} | {f"h{k}": {f"h{j}" for j in range(1, 7)} for k in range(1, 7)}
CLOSES = {tag: tuple(name for name, by in CLOSED_BY.items() if tag in by) for tag in frozenset().union(*CLOSED_BY.values())}
#: Elements that are part of a text, not a whole one.
PARTS = frozenset("section p ul ol dl li dd dt dir table tbody thead tfoot tr caption blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 hgroup address details summary center fieldset legend".split())
#: Elements that the search for an element to close doesn't leave.
_SCOPE = frozenset("table td th caption button object html body article section div ul ol dl main aside nav footer header form".split())
LEFT_OUT = frozenset("nav aside footer form script style noscript template iframe head title button select textarea svg math object canvas audio video dialog menu noembed noframes xmp".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer footers colophon masthead comment comments commentlist discussion discussions disqus respond replies share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager skip paywall".split()
)
#: What readers wrote: left out of an element with text beside headings and this, however much it is.
COMMENTS = frozenset("comment comments commentlist discussion discussions disqus respond replies".split())
#: A name with one of these says what a part has, or hasn't.
ABOUT = frozenset("has have with without no not non hide hides free less enabled disabled enable disable".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_ID = re.compile(r"""\b(?:id|style|data-[\w-]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Page:
    """Nodes in page order, each with its parent, and what stands in them: ``pieces`` has (node,
    text) for text and (node, None) where an element starts, in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out = ["#root"], [-1], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self._inside = [False]  # within an article or main element
        self._named = [0]  # left out by a class or id, if at all
        self._look = [""]  # the tag with its attributes but for ids
        self._read(source)
        if any(self._named):
            self._leave_out_named()

    def _leave_out_named(self) -> None:
        n = len(self.tag)
        size, plain, last = [0] * n, [0] * n, list(range(n))
        for node, text in self.pieces:
            if text is not None and not self.out[node]:
                size[node] += sum(map(len, text.split()))
                plain[node] = size[node] * (self.tag[node] not in HEADINGS)
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
            plain[self.parent[k]] += plain[k]
            last[self.parent[k]] = max(last[self.parent[k]], last[k])
        marked = [k for k in range(n) if self.tag[k] in ("article", "main") and size[k] and not self.out[k]]
        for k in range(1, n):
            if self._named[k] and 2 * size[k] > size[0]:
                within = bisect.bisect_right(marked, last[k]) - bisect.bisect_left(marked, k)
                # outside are those that neither stand within it nor around it
                around = [a for a in marked if a < k <= last[a]] if within < len(marked) else []
                most = within + len(around) == len(marked) and not (self._named[k] > 1 and any(plain[a] > plain[k] for a in (self.parent[k], *around)))
            else:
                most = False
            self.out[k] = self.out[k] or self.out[self.parent[k]] or bool(self._named[k] and not most)

    def _is_named(self, tag: str, attrs: str, at: int) -> int:
        """2 for comments, 1 for other parts to leave out, else 0."""
        if tag in ("html", "body", "main", "article"):
            return 0
        for m in _ATTR.finditer(attrs):
            if m[1].lower() in ("class", "id"):
                for name in (m[2] or m[3] or m[4] or "").split():
                    words = [w.lower() for w in _WORDS.findall(name)]
                    ends = {words[0], words[-1]} if words and not ABOUT & set(words) else set()
                    if ends & NAMES or ("header" in ends and not self._inside[at]):
                        return 2 if ends & COMMENTS else 1
        return 0

    def _left_out(self, tag: str, attrs: str, at: int) -> bool:
        if self.out[at] or tag in LEFT_OUT:
            return True
        if tag in ("html", "body", "main"):
            return False
        if tag == "header" and not self._inside[at]:
            return True
        if not attrs or attrs.isspace():
            return False
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if (
                (name == "role" and value.lower() in ROLES)
                or name == "hidden"
                or (name == "aria-hidden" and value.lower() == "true")
                or (name == "style" and _HIDDEN.search(value))
            ):
                return True
        return False

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        #: places in the stack of open elements of each name, and of those that end a search
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self.pieces.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                self.pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if m["end"] or m["end2"]:
                self._close(stack, tag)
            elif tag:
                at = self._open(stack, tag, m["attrs"] if m["tag"] else m["attrs2"], source, at)

    def _cut(self, stack: list[int], place: int) -> None:
        """Closes what is open from a place in the stack on."""
        for node in reversed(stack[place:]):
            self._places[self.tag[node]].pop()
        while self._scopes and self._scopes[-1] >= place:
            self._scopes.pop()
        del stack[place:]

    def _close(self, stack: list[int], tag: str) -> None:
        own = self._places.get(tag)
        if own and (tag in BLOCKS or not self._scopes or self._scopes[-1] <= own[-1]):
            self._cut(stack, own[-1])

    def _open(self, stack: list[int], tag: str, attrs: str, source: str, at: int) -> int:
        # the innermost open element that this one closes, not beyond an element that ends the search
        closed = max((p[-1] for name in CLOSES.get(tag, ()) if (p := self._places.get(name))), default=0)
        if closed and closed >= (self._scopes[-1] if self._scopes else 0):
            self._cut(stack, closed)
        node, above = len(self.tag), stack[-1]
        self.tag.append(tag)
        self.parent.append(above)
        self.out.append(self._left_out(tag, attrs, above))
        self._named.append(0 if self.out[node] else self._is_named(tag, attrs or "", above))
        self._inside.append(self._inside[above] or tag in ("article", "main"))
        self._look.append(f"{tag} {_ID.sub('', attrs).strip().lower()}" if attrs else tag)
        self.pieces.append((node, None))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            return len(source) if end is None else end.start()
        if tag not in VOID:
            self._places.setdefault(tag, []).append(len(stack))
            if tag in _SCOPE:
                self._scopes.append(len(stack))
            stack.append(node)
        return at

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density of each node, and the sum of its children's. Parts that are left out
        count in the body's share of link text only."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        all_chars = all_links = 0
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        for node, text in self.pieces:
            if text is not None:
                size = sum(map(len, text.split()))
                all_chars += size
                all_links += size * in_link[node]
                if not self.out[node]:
                    chars[node] += size
                    link_chars[node] += size * in_link[node]
        density, total = [0.0] * n, [0.0] * n
        self._chars, self._link_chars = chars, link_chars
        ratio = all_links / max(1, all_chars)
        for k in range(n - 1, -1, -1):
            if self.out[k]:
                continue
            c, t, lc, lt = chars[k], max(1, tags[k]), link_chars[k], max(1, link_tags[k])
            if c:
                base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
                density[k] = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1.05))
            if k:
                p = self.parent[k]
                chars[p] += c
                link_chars[p] += lc
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + (self.tag[k] == "a")
                if self.tag[k] in BLOCKS or self.tag[k] in ("td", "th"):  # text in line belongs to its block
                    total[p] += density[k]
        return density, total

    def _is_text(self, k: int) -> bool:
        """Whether an element has text that isn't mostly links."""
        return self._chars[k] > 0 and 2 * self._link_chars[k] <= self._chars[k]

    def _the_one(self, name: str) -> int | None:
        """The page's only element of a name with text of its own kind, if it has just one; elements of that
        name inside it don't count."""
        within, found = [False] * len(self.tag), []
        for k in range(1, len(self.tag)):
            within[k] = within[self.parent[k]] or self.tag[self.parent[k]] == name
            if self.tag[k] == name and not within[k] and not self.out[k] and self._is_text(k):
                found.append(k)
        return found[0] if len(found) == 1 else None

    def main(self) -> tuple[set[int], float]:
        """The roots of the main text's subtrees, and the threshold."""
        density, total = self.densities()
        kept = [k for k in range(len(self.tag)) if not self.out[k]]
        if not any(total[k] for k in kept):
            return {0}, 0.0
        article, main = self._the_one("article"), self._the_one("main")
        inside = [False] * len(self.tag)
        within = article if article is not None else main if main is not None else 0
        for k in range(within, len(self.tag)):
            inside[k] = k == within or (k > 0 and inside[self.parent[k]])
        best = max((k for k in kept if inside[k]), key=lambda k: (total[k], density[k], -k))
        body = self.tag.index("body") if "body" in self.tag else 0
        path = [best]
        while path[-1] not in (body, 0):
            path.append(self.parent[path[-1]])
        threshold = min(density[k] for k in path)
        own = next((k for k in path if self.tag[k] == "article"), None)
        if own is not None:
            return {own}, threshold
        rise = 0
        while rise + 1 < len(path) and self.tag[path[rise]] in PARTS:
            rise += 1
        top, on_path = path[rise], set(path)
        beside: dict[int, list[int]] = {k: [] for k in path[rise + 1 :]}
        for k in kept:
            if k and self.parent[k] in beside and (k == top or (k in on_path or self.tag[k] in BLOCKS)):
                beside[self.parent[k]].append(k)
        roots = {top}
        for blocks in beside.values():
            chosen = [k in on_path or density[k] >= threshold or (k < top and self.tag[k] in HEADINGS) or (self._look[k] == self._look[top] and self._is_text(k)) for k in blocks]
            if any(chosen):
                first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
                chosen = [c or (first < j < last and self._is_text(blocks[j])) for j, c in enumerate(chosen)]
            roots.update(k for k, c in zip(blocks, chosen, strict=True) if c and (k == top or k not in on_path))
        return roots, threshold

    def text(self) -> str:
        """Blocks of the main text in page order, one to a line."""
        roots, _ = self.main()
        n = len(self.tag)
        inside, block = [False] * n, [0] * n
        for k in range(n):
            inside[k] = not self.out[k] and (k in roots or (k > 0 and inside[self.parent[k]]))
            block[k] = k if k == 0 or self.tag[k] in BLOCKS else block[self.parent[k]]
        lines: list[list[str]] = []
        last = None
        for node, text in self.pieces:
            if text is None:
                if self.tag[node] in BLOCKS:
                    last = None
                    continue
                text = " " if self.tag[node] in ("br", "td", "th") else ""
            if inside[node] and text:
                if block[node] != last:
                    lines.append([])
                    last = block[node]
                lines[-1].append(text)
        return "\n".join(x for x in (_SPACE.sub(" ", entities.unescape("".join(line))).strip() for line in lines) if x)


def _extract(batches):
    for batch in batches:
        texts = [Page(source).text() if source else "" for source in (x.as_py() for x in batch.column("html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


_NODE = "page_id long, node long, parent long, tag string, left_out boolean, density double, density_sum double, main boolean"


def _nodes(batches):
    for batch in batches:
        for page_id, source in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
            page = Page(source.as_py() or "")
            density, total = page.densities()
            roots, _ = page.main()
            n = len(page.tag)
            cols = ([page_id] * n, range(n), page.parent, page.tag, page.out, density, total, [k in roots for k in range(n)])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _NODE.split(", ")])


def node_densities(pages: DataFrame) -> DataFrame:
    """A row for each DOM node of every page: its composite density and its children's sum."""
    return pages.select("page_id", "html").mapInArrow(_nodes, _NODE)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
