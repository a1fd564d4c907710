"""Main text of web pages by consensus on container paths per host.

Every page is cut into text blocks inside nested containers; boilerplate
elements (by tag, role, or a class or id name made of nothing but boilerplate
and layout words) hold no blocks.  Headings and the header of an article are
never boilerplate by name.

Each page reports its areas, an area being the blocks right inside the containers
of one generalised path (tags with class names, digits replaced by ``#``).  An
area is suspect on a host if at least ``SEEN`` pages there have it and it is
mostly links, or says the same on most of them (every text on ``SEEN`` pages on
average; copies of a page count once).  Then each page scores its containers by
the text of areas that are neither suspect nor links, and votes for the deepest
one that holds it all; the host's path has the most votes (then the score, then
the path).  Suspect areas off that path are boilerplate.  Spark counts both.

Every page is then extracted again: without the boilerplate areas of its host,
from the elements on the host's path if all that is left but link blocks lies
there, else from the page's own choice.  So text is lost only as an element
known by name, as an area the host repeats, or as a block of links outside of
the article; a host with several templates loses none.

Votes and areas are partial sums, so a host with most of the pages is no hot
key, and pages are not shuffled as long as the result is under the broadcast
limit.

Blocks have their references decoded and white space turned into single
spaces; ``br`` and table cells are white space.  Null or empty html gives
empty text.  Null urls are one host.  Repeated rows each give a result.
"""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import BROADCAST_BYTES, materialize, table_bytes

#: Pages that must have an area, and repeat its texts on average, before it counts as boilerplate.
SEEN = 3

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody thead tfoot tr ul".split()
)
CONTAINER = set("body article main section div".split())
CLOSES_P = BLOCK - {"html", "body", "tr", "tbody", "thead", "tfoot"}
# An opening tag closes an open element of these, up to a border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
}
P_BORDER = {"table", "td", "th", "caption", "button", "object", "template", "html"}

# What is no part of an article.
DROP_TAGS = set(
    "head nav header footer aside form script style title textarea iframe noembed noframes xmp noscript template svg "
    "button select option input dialog menu object embed video audio canvas map".split()
)
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROP_NAMES = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar banner footer sidebar sidebars aside widget widgets "
    "ad ads adv advert adverts advertisement advertisements advertising adbox sponsor sponsored promo promotion promoted cookie cookies "
    "consent gdpr notice notices notification alert popup popover modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending comment comments commentlist disqus respond reply replies "
    "discussion pagination pager toolbar skip hidden form search".split()
)
# Words that say where or how something stands; with one of the names above they make a name of boilerplate.
LAYOUT_WORDS = set(
    "area bar block bottom box button buttons center cell col column container content group holder home inner item items layout left "
    "link links list main mobile module outer page panel primary right row secondary site slot stick sticky strip sub text top unit user "
    "users view wrap wrapper zone posts stories articles icons global desktop fixed".split()
)
KEPT_TAGS = set("html body main h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = {"article", "main"}
NAMED_WORDS = DROP_NAMES | LAYOUT_WORDS

TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.DOTALL)
# Whole attributes, so that no name is found inside another one or a value.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+|=", re.DOTALL)
READ_ATTRIBUTES = {"class", "id", "role", "hidden", "aria-hidden", "style"}
ID_TAGS = {"div", "ul", "ol"}  # ids of sections, headings and others are often slugs of an article
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
DIGITS = re.compile(r"\d+")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text) if text.strip() else ():
        if m[1] and (name := m[1].lower()) in READ_ATTRIBUTES:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROP_TAGS:
        return True
    if not attributes or tag in KEPT_TAGS:
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return True
    if attributes.get("role", "").lower() in DROP_ROLES:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '') if tag in ID_TAGS else ''}".split():
        words = {w.lower() for w in NAME_WORDS.findall(name) if not w.isdigit()}
        if words & DROP_NAMES and words <= NAMED_WORDS:
            return True
    return False


def _digest(blocks: list[str]) -> int:
    said = hashlib.blake2b("\n".join(blocks).encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(said.digest(), "big", signed=True)


class Page:
    """Blocks of one page in order, and its containers as ranges of blocks."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.owner: list[int] = []  # innermost container of each block, -1 for none
        self.links: list[int] = []  # characters of each block that are link text
        self.containers: list[list] = []  # path, first block, end block
        self._inside = [-1]
        self._articles = 0
        self._stack: list[tuple[str, str, bool, int, bool]] = [("", "", False, -1, False)]
        self._text: list[str] = []
        self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append(text)
                self.owner.append(self._inside[-1])
                self.links.append(min(self._linked, len(text)))
            self._text, self._linked = [], 0

    def _add(self, text: str) -> None:
        _, _, dropped, _, link = self._stack[-1]
        if dropped or not text:
            return
        text = html.unescape(text) if "&" in text else text
        self._text.append(text)
        if link:
            self._linked += len(text.strip())

    def _pop_to(self, depth: int) -> None:
        """Close all elements above ``depth``."""
        while len(self._stack) > depth:
            tag, _, dropped, container, _ = self._stack.pop()
            if tag in BLOCK:
                self._flush()
            elif tag in ("td", "th"):
                self._text.append(" ")
            if container >= 0:
                self.containers[container][2] = len(self.blocks)
                self._inside.pop()
            if tag in ARTICLE_TAGS and not dropped:
                self._articles -= 1

    def _find(self, tags: set[str], border: set[str]) -> int:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[depth][0]
            if tag in tags:
                return depth
            if tag in border:
                return 0
        return 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and (depth := self._find({"p"}, P_BORDER)):
            self._pop_to(depth)
        if tag in CLOSES and (depth := self._find(*CLOSES[tag])):
            self._pop_to(depth)
        if tag in BLOCK:
            self._flush()
        elif tag in ("br", "td", "th"):
            self._text.append(" ")
        if tag in VOID:
            return
        given = _attributes(attributes)
        _, path, dropped, _, link = self._stack[-1]
        classes = ".".join(sorted({DIGITS.sub("#", c) for c in given.get("class", "").split()}))
        path = f"{path}/{tag}.{classes}" if classes else f"{path}/{tag}"
        dropped = dropped or _dropped("div" if tag == "header" and self._articles else tag, given)
        container = -1
        if tag in CONTAINER and not dropped:
            container = len(self.containers)
            self.containers.append([path, len(self.blocks), len(self.blocks)])
            self._inside.append(container)
        if tag in ARTICLE_TAGS and not dropped:
            self._articles += 1
        self._stack.append((tag, path, dropped, container, link or tag == "a"))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if depth := self._find({tag}, set()):
                    self._pop_to(depth)
            else:
                self._open(tag, m[3])
                if tag in RAW:
                    close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                    at = close.start() if close else size
        self._pop_to(1)
        self._flush()

    def is_link(self, block: int) -> bool:
        return 2 * self.links[block] > len(self.blocks[block])

    def areas(self) -> dict[str, tuple[int, int, int]]:
        """Per container path the digest, size and link characters of the blocks right inside."""
        found: dict[str, list[int]] = {}
        for block, owner in enumerate(self.owner):
            if owner >= 0:
                found.setdefault(self.containers[owner][0], []).append(block)
        out = {}
        for path, blocks in found.items():
            out[path] = _digest([self.blocks[b] for b in blocks]), sum(len(self.blocks[b]) for b in blocks), sum(self.links[b] for b in blocks)
        return out

    def choice(self, kept: list[int]) -> list | None:
        """The deepest container with nothing but link blocks of ``kept`` outside; none if there is no other text."""
        words = [b for b in kept if not self.is_link(b)]
        best = None
        for c in self.containers if words else ():  # parents come before what they contain
            if c[1] <= words[0] and words[-1] < c[2]:
                best = c
        return best

    def _on(self, path: str) -> set[int]:
        return {b for c in self.containers if path and c[0] == path for b in range(c[1], c[2])}

    def text(self, path: str = "", areas: frozenset[str] | set[str] = frozenset()) -> str:
        """The article: blocks off the areas named, in the elements on ``path`` or the page's own choice."""
        on = self._on(path)
        known = [False if o < 0 else self.containers[o][0] in areas for o in self.owner]
        kept = [b for b in range(len(self.blocks)) if b in on or not known[b]] or list(range(len(self.blocks)))
        if not on or any(b not in on and not self.is_link(b) for b in kept):
            best = self.choice(kept)
            on = set(range(best[1], best[2])) if best else set(kept)
        return "\n".join(self.blocks[b] for b in kept if b in on)


def extract(source: str | None, path: str | None = None, areas: str | None = None) -> str:
    """The article of a page; ``path`` and ``areas`` (one a line) are its host's."""
    return Page(source).text(path or "", set((areas or "").split("\n")) - {""}) if source else ""


def common_path(areas: list[dict], suspect: set[str]) -> tuple[str, int]:
    """Path and score of the deepest container around all text of a page that is neither suspect nor links."""
    left = [a for a in areas if a["area"] not in suspect and 2 * a["links"] <= a["size"]]
    path: list[str] = left[0]["area"].split("/") if left else []
    for a in left[1:]:
        other = a["area"].split("/")
        same = next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))
        path = path[:same]
    return "/".join(path), sum(2 * a["size"] - a["links"] for a in left)


def host_of(url_col: str) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url_col, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def _small(hosts: DataFrame, *texts: str) -> DataFrame:
    """Marked for broadcast if measured to be small."""
    return F.broadcast(hosts) if table_bytes(hosts, *texts) <= BROADCAST_BYTES else hosts


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path and areas: each host's winning container path and its boilerplate areas, one a line."""

    @F.pandas_udf("page long, areas array<struct<area:string,digest:long,size:long,links:long>>")
    def read(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for page in (Page(s or "") for s in sources):
            rows.append((_digest(page.blocks), [dict(zip(("area", "digest", "size", "links"), (p, *a))) for p, a in page.areas().items()]))
        return pd.DataFrame(rows, columns=["page", "areas"])

    @F.pandas_udf("path string, score long")
    def vote(areas: pd.Series, suspects: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([common_path(a, set((s or "").split("\n"))) for a, s in zip(areas, suspects)], columns=["path", "score"])

    seen = materialize(pages.select(host_of(url_col).alias("host"), read(F.col(html_col)).alias("v")).select("host", "v.*"), "areas")
    once = seen.groupBy("host", "page").agg(F.first("areas").alias("areas"))
    said = once.select("host", F.inline("areas")).groupBy("host", "area", "digest")
    said = said.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    told = said.groupBy("host", "area").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    poor = told.where((F.col("n") >= SEEN) & ((2 * F.col("links") > F.col("size")) | (F.col("texts") * SEEN <= F.col("n"))))
    poor = poor.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("area")), "\n").alias("suspect"))
    poor = materialize(poor, "suspects")
    voted = seen.join(_small(poor, "host", "suspect"), "host", "left").select("host", vote("areas", "suspect").alias("v")).select("host", "v.*")
    counted = voted.where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    won = counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best")).select("host", "best.path")
    inside = lambda a: F.startswith(F.concat(a, F.lit("/")), F.concat("path", F.lit("/")))
    off = F.filter(F.split("suspect", "\n"), lambda a: ~F.coalesce(inside(a), F.lit(False)))
    return won.join(poor, "host", "full").select("host", "path", F.array_join(off, "\n").alias("areas"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars and path (the host's) of every page."""

    @F.pandas_udf("string")
    def main_text(sources: pd.Series, paths: pd.Series, areas: pd.Series) -> pd.Series:
        return pd.Series([extract(*row) for row in zip(sources, paths, areas)], dtype=object)

    hosts = materialize(host_paths(pages, url_col, html_col).withColumnRenamed("host", "_host"), "hosts")
    hosts = _small(hosts, "_host", "path", "areas")
    known = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"), host_of(url_col).alias("_host"))
    out = known.join(hosts, "_host", "left").select(id_col, url_col, main_text("_html", "path", "areas").alias("text"), "path")
    return out.select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), "path")
