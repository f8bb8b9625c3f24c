"""Main text of web pages by a consensus of each host's pages.

Every page scores its containers by the running text in them. Hosts vote on the containers' generalised paths, the tags
and classes on the way from the root with numbers taken out. Each page is then read again with that of its paths that
its host gave most votes to: what it finds is widened to the article that holds it, or step by step while it gains less
than it has, so that leads, unlike sections and headlines beside the winning container stay.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names of the markup language, and words that name page furniture.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = set("nav header footer aside form button select menu dialog fieldset datalist object audio video canvas head".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_ALWAYS = set("html body main article".split())
_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner promo promos promotion sponsor sponsored "
    "cookie cookies cookiebar consent gdpr notice alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead topbar footer comment comments commentlist disqus respond replies reply share sharing social "
    "related recommended newsletter subscribe signup login search widget toolbar pagination pager skip copyright legal hidden".split()
)
#: Words that say where or in what furniture stands, those that deny it or tell a layout, and those of an article's own header.
_AROUND = set(
    "site page main top bottom left right global primary secondary inner outer block box bar container wrapper wrap area list link "
    "links section slot unit content body text title row item items button icon icons form first last fixed sticky mobile desktop".split()
)
_DENIED = set("has no with without is not non".split())
_OWN = set("entry post article content story".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements left out up to their end; where one has no end, only its tag.
_SKIPPED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("noscript", "template", "iframe", "svg", "math", "object")}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements that end by themselves where another of these starts.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"},
}
_LISTS = {"ul", "ol", "dl", "table"}
_HEADED = ("article", "main")


@lru_cache(65_536)
def _names_furniture(names: str) -> bool:
    """Whether one of some class names or ids is a word for page furniture, ends in one, or says where it stands.

    A word for furniture among others is none: ``share-price``, ``has-sidebar``, ``entry-header``.
    """
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        if not words or words[0] in _DENIED or (words[-1] == "header" and words[0] in _OWN):
            continue
        if words[-1] in _NAMES or (words[0] in _NAMES and all(w in _NAMES or w in _AROUND for w in words)):
            return True
    return False


class Page:
    """Elements and blocks of a page. Malformed, cut off or empty markup gives what can be read of it."""

    def __init__(self, html: str):
        #: Of each element: parent, hash of its generalised path, whether it is furniture, tag.
        self.parent, self.path, self.out, self.tag = [-1], [b""], [False], [""]
        #: (element, text, characters in links)
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._linked, self._open_tags = [0], [], 0, Counter()
        last, endless = 0, set()
        while m := _TOKEN.search(html, last):
            if m.start() > last:
                self._add(html[last : m.start()])
            last = m.end()
            if not m[3]:
                continue
            tag = m[3].lower()
            if tag in _SKIPPED:
                end = None if m[2] or m[4].endswith("/") or tag in endless else _SKIPPED[tag].search(html, last)
                if end:
                    last = end.end()
                elif not m[2] and not m[4].endswith("/"):
                    endless.add(tag)
            elif m[2]:
                self._close({tag})
            else:
                self._open(tag, m[4] or "")
        self._add(html[last:])
        self._flush()

    def _add(self, text: str) -> None:
        if not self.out[self._stack[-1]]:
            self._text.append(text)
            if self._open_tags["a"]:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                at = self._stack[-1]
                while self.tag[at] and self.tag[at] not in _BLOCK:
                    at = self.parent[at]
                self.blocks.append((at, text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br" or tag == "wbr":
            self._add(" " if tag == "br" else "")
            return
        if tag in _BLOCK:
            self._flush()
            self._close({"p"})
            if tag in _CLOSES:
                self._close(_CLOSES[tag], within=_LISTS | {"select"})
        if tag in _VOID:
            return
        above = self._stack[-1]
        headed = tag == "header" and any(self._open_tags[t] for t in _HEADED)  # an article's own
        name, out = tag, self.out[above] or (tag in _FURNITURE and not headed)
        if rest.strip(" /"):
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
            classes = found.get("class", "")
            if tag not in _ALWAYS:
                out = out or _names_furniture(classes) or _names_furniture(found.get("id", "")) or (
                    found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden") == "true"
                    or "display:none" in found.get("style", "").replace(" ", "")
                )
            name = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.split()})])
        if out and not self.out[above]:
            self._flush()
        self.parent.append(above)
        self.path.append(hashlib.blake2b(self.path[above] + name.encode("utf-8", "replace"), digest_size=8).digest())
        self.out.append(out)
        self.tag.append(tag)
        self._stack.append(len(self.parent) - 1)
        self._open_tags[tag] += 1
        if rest.endswith("/") and tag not in _BLOCK:
            self._close({tag})

    def _close(self, tags: set[str], within: set[str] = frozenset()) -> None:
        if not any(self._open_tags[tag] for tag in tags):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in tags:
                if tags & _BLOCK or any(self.tag[i] in _BLOCK for i in self._stack[depth:]):
                    self._flush()
                self._open_tags.subtract(self.tag[i] for i in self._stack[depth:])
                del self._stack[depth:]
                return
            if tag in within:
                return

    def scores(self) -> dict[bytes, float]:
        """Running text below each path: blocks count for what holds them, and by half for what holds that."""
        by_element: dict[int, float] = defaultdict(float)
        for running, (element, text, linked) in zip(self._running(), self.blocks):
            if not running:
                continue
            if self.tag[element] in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6"):
                element = self.parent[element]
            by_element[element] += len(text) - linked
            if element > 0:
                by_element[self.parent[element]] += (len(text) - linked) / 2
        out: dict[bytes, float] = defaultdict(float)
        for element, score in by_element.items():
            out[self.path[element]] += score
        return out

    def _running(self) -> list[bool]:
        """Which blocks aren't in a list that is mostly links."""
        lists: dict[int, list[int]] = {}
        of = []
        nearest = [0] * len(self.parent)
        for element in range(1, len(self.parent)):
            nearest[element] = element if self.tag[element] in _LISTS else nearest[self.parent[element]]
        for element, text, linked in self.blocks:
            at = nearest[element]
            of.append(at)
            if at:
                total = lists.setdefault(at, [0, 0])
                total[0] += len(text)
                total[1] += linked
        return [not at or 2 * lists[at][1] <= lists[at][0] for at in of]

    def _inside(self, roots: set[int]) -> list[bool]:
        inside = [False] * len(self.parent)
        for element, above in enumerate(self.parent):
            inside[element] = element in roots or (above >= 0 and inside[above])
        return inside

    def text(self, path: bytes) -> str:
        """Blocks of the article around the elements with this path, in page order.

        That is the article or main element that holds them, or else what they grow to while each step up adds no more
        running text than there is. Lists of links count inside the elements, or inside an article element. A first-level
        heading before the article, beside it or beside what holds it, is its headline where it has none.
        """
        core = {element for element, own in enumerate(self.path) if own == path}
        running = self._running()
        size = [0] * len(self.parent)
        for good, (element, text, _) in zip(running, self.blocks):
            size[element] += len(text) if good else 0
        for element in range(len(self.parent) - 1, 0, -1):
            size[self.parent[element]] += size[element]
        holder = [0] * len(self.parent)  # the nearest article, or else main element
        for element in range(1, len(self.parent)):
            above = holder[self.parent[element]]
            own = self.tag[element] == "article" or (self.tag[element] == "main" and self.tag[above] != "article")
            holder[element] = element if own else above
        roots = {holder[element] for element in core if holder[element]}
        grown = {element for element in core if not holder[element]}
        while grown:
            gains: dict[int, int] = defaultdict(int)
            for element in grown:
                gains[self.parent[element]] += size[element]
            wider = {above for above, held in gains.items() if above >= 0 and size[above] <= 2 * held}
            if not wider:
                break
            grown = wider | {element for element in grown if self.parent[element] not in wider}
        roots |= grown
        inside = self._inside(roots)
        listed = self._inside(core | {element for element in roots if self.tag[element] == "article"})
        chosen = [inside[e] and (good or listed[e]) for good, (e, _, _) in zip(running, self.blocks)]
        if not any(take and self.tag[e] == "h1" for take, (e, _, _) in zip(chosen, self.blocks)):
            first, around, at = min(roots), set(), self.parent[min(roots)]
            while at >= 0:
                around.add(at)
                at = self.parent[at]
            heads = [
                i for i, (e, _, _) in enumerate(self.blocks) if e < first and self.tag[e] == "h1" and self.parent[e] in around
            ]
            for i in heads[-1:]:
                chosen[i] = True
        return "\n\n".join(text for take, (_, text, _) in zip(chosen, self.blocks) if take)


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with a key: rows alike in all columns share it, and their text."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    key = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), "html"), 256)
    return pages.select(F.col("page_id"), F.col("url"), F.col("html"), host.alias("host"), F.unhex(key).alias("key"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(key, host, path, score): every page's containers, a path as the hash of its steps; of a page all scores are parts of its best one's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = []
                part = batch.slice(a, 64)
                for key, host, html in zip(*(part.column(c).to_pylist() for c in ("key", "host", "html"))):
                    found = Page(html or "").scores()
                    best = max(found.values(), default=0)
                    rows += [(key, host, path, score / best) for path, score in found.items() if score > 0]
                kinds = [pa.binary(), pa.string(), pa.binary(), pa.float64()]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "host", "path", "score"])

    return _keyed(pages).select("key", "host", "html").mapInArrow(run, "key binary, host string, path binary, score double")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Blocks are joined by an empty line, white space inside one is one space, character references are decoded. Furniture
    is told by element, role and class names (``_names_furniture``); of an element without end that would leave out the
    rest of the page only the tag counts. Null or empty html, or a page without running text: empty text. A null url is a
    host of its own. Repeated rows each come out. Empty table: no rows. Further columns of ``pages`` don't matter.
    """
    containers = host_paths(pages)
    votes = containers.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("votes"))
    chosen = (
        containers.join(votes, ["host", "path"])
        .groupBy("key").agg(F.max(F.struct("votes", "score", "path")).alias("best")).select("key", F.col("best.path").alias("path"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [
                    "" if path is None else Page(html or "").text(path)
                    for html, path in zip(part.column("html").to_pylist(), part.column("path").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    both = _keyed(pages).drop("host").join(chosen, "key", "left").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", "path")
    return both.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
