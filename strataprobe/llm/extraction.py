"""Main text of web pages by consensus of a host's pages.

Each page scores its containers by how much running text they hold and names the best one by its path of tags and generalised
classes. Spark counts these votes by host. Then each page is cut again at the path that most pages of its host voted for and that it
has, so that a page whose comments or sidebar outweigh a short article follows its siblings; a page that has none of
these paths keeps its own best container.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bytes, row_bytes, table, written

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption col colgroup dd dt frameset html legend li optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: What a start tag closes: (tags that it ends, tags beyond which it doesn't look).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
WALLS = frozenset("table td th caption template".split())

#: Tags that hold no article text, and roles and class words that say the same of any element.
NO_TEXT = frozenset("audio button canvas datalist dialog embed head iframe input noembed noframes noscript object script select style svg template textarea title video".split())
ASIDE = frozenset("aside footer form nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ADS = frozenset("ad ads adbanner adbox adsense adslot adunit adv advert advertisement advertisements advertising adverts promo promoted promotion promotions sponsor sponsored sponsors".split())
COMMENTS = frozenset("comment commentlist comments discussion disqus feedback guestbook replies reply respond responses".split())
OTHERS = frozenset(
    "aside banner consent copyright footer gdpr login masthead menu menubar menus modal nav navigation notice notices notification overlay pager pagination paywall popular popup "
    "rail recommendations recommended related search searchbox searchform share sharing signup sitemap skiplink social submenu subscribe subscription toolbar topbar trending widget widgets".split()
)
#: How words begin that say so too.
STEMS = ("adsby", "advert", "breadcrumb", "cookie", "navbar", "newsletter", "sidebar", "sponsor")
#: A word after one of these tells what a container has, not what it is.
HAS = frozenset("has have hide no not show with without".split())
POST = frozenset("article entry post story".split())
CONTENT = POST | frozenset("content text title".split())
HOLDERS = frozenset("article body center div main root section td".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^=>]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?P<close>>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SENTENCE_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


def general(name: str) -> str:
    """A class or id with the parts that differ from page to page starred: those with a digit in them."""
    return "-".join("*" if any(c.isdigit() for c in part) else part for part in re.split(r"[-_:.]+", name.lower()) if part)


def words_of(names: str) -> set[str]:
    """The words of classes and ids that tell what an element is."""
    out = set()
    for name in names.split():
        before = ""
        for w in PIECE.findall(name):
            w = w.lower()
            if before not in HAS:
                out.add(w)
            before = w
    return out


class Page:
    """A page as a tree: for each node its tag, parent and names, and the texts and block borders in page order."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attrs = ["root"], [-1], [""]
        #: (node, text), or (node, None) where a block begins or ends.
        self.items: list[tuple[int, str | None]] = []
        self._stack, self._open = [0], {"root": 1}
        at, n = 0, len(html)
        search = TOKEN.search
        while at < n:
            m = search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m.group("tag")
            if tag is None or not m.group("close"):
                continue
            tag = tag.lower()
            if m.group("end"):
                self._end(tag)
                continue
            self._start(tag, m.group("attrs"))
            if tag in RAW:
                stop = RAW_END[tag].search(html, at)
                at = stop.start() if stop else n
        self._read_names()

    def _push(self, tag: str, attrs: str) -> int:
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.attrs.append(attrs)
        return len(self.tags) - 1

    def _pop(self) -> None:
        node = self._stack.pop()
        tag = self.tags[node]
        self._open[tag] -= 1
        if tag in BLOCKS:
            self.items.append((node, None))

    def _pop_to(self, wanted: Iterable[str], walls: Iterable[str]) -> None:
        """Closes the nearest open element of the wanted tags, if no wall stands before it."""
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag in wanted:
                while len(self._stack) > k:
                    self._pop()
                return
            if tag in walls:
                return

    def _text(self, text: str) -> None:
        if self._open.get("head") and text.strip():
            self._pop_to({"head"}, ())
        self.items.append((self._stack[-1], unescape(text) if "&" in text else text))

    def _start(self, tag: str, attrs: str) -> None:
        opened = self._open
        if opened.get("head") and tag not in HEAD_ONLY and tag != "head":
            self._pop_to({"head"}, ())
        if tag in ("html", "head", "body") and opened.get(tag):
            return
        if tag in CLOSES_P and opened.get("p"):
            self._pop_to({"p"}, WALLS | {"button"})
        if tag in HEADINGS and self.tags[self._stack[-1]] in HEADINGS:
            self._pop()
        if tag in ENDS and any(opened.get(t) for t in ENDS[tag][0]):
            wanted, walls = ENDS[tag]
            while any(opened.get(t) for t in wanted):
                before = len(self._stack)
                self._pop_to(wanted, walls)
                if len(self._stack) == before:
                    break
        node = self._push(tag, attrs)
        if tag in BLOCKS:
            self.items.append((node, None))
        elif tag == "br":
            self.items.append((node, " "))
        if tag not in VOID and not (attrs.endswith("/") and (opened.get("svg") or opened.get("math"))):
            self._stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag == "br":  # as browsers take it
            self.items.append((self._stack[-1], " "))
        if not self._open.get(tag) or tag in ("html", "body"):
            return
        if tag in HEADINGS:
            self._pop_to(HEADINGS, WALLS)
        elif tag in BLOCKS or tag in WALLS:
            inner = tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "table")
            self._pop_to({tag}, {"table"} if inner else WALLS)
        else:
            for k in range(len(self._stack) - 1, 0, -1):
                here = self.tags[self._stack[k]]
                if here == tag:
                    if any(self.tags[x] in BLOCKS for x in self._stack[k + 1 :]):  # ends here, what is open in it goes on
                        del self._stack[k]
                        self._open[tag] -= 1
                    else:
                        self._pop_to({tag}, ())
                    return
                if here in WALLS:
                    return

    def _read_names(self) -> None:
        """names (classes and id), role and hidden of the nodes that have any."""
        self.names: dict[int, str] = {}
        self.classes: dict[int, str] = {}
        self.role: dict[int, str] = {}
        self.hidden: set[int] = set()
        for node, attrs in enumerate(self.attrs):
            if not attrs or not TELLING.search(attrs):
                continue
            found: dict[str, str] = {}
            for key, a, b, c in ATTRIBUTE.findall(attrs):
                found.setdefault(key.lower(), a or b or c)
            names = f"{found.get('class', '')} {found.get('id', '')}"
            if names.strip():
                self.names[node] = unescape(names)
                self.classes[node] = unescape(found["class"] if found.get("class", "").strip() else "#" + found.get("id", ""))
            if "role" in found:
                self.role[node] = found["role"].lower()
            if "hidden" in found or HIDDEN.search(found.get("style", "")):
                self.hidden.add(node)

    def label(self, node: int) -> str:
        """Tag and generalised classes; the id where there is no class."""
        names = sorted({general(c) for c in self.classes.get(node, "").split()} - {""})
        return ".".join([self.tags[node], *names])

    def path(self, node: int) -> str:
        """Labels from the top; html and body, which may go without saying, are left out."""
        out = []
        while node > 0:
            if self.tags[node] not in ("html", "body"):
                out.append(self.label(node))
            node = self.parents[node]
        return " > ".join(reversed(out))

    def path_keys(self) -> list[bytes]:
        """A key of each node's path, made from its parent's."""
        keys = [b""]
        for node in range(1, len(self.tags)):
            above = keys[self.parents[node]]
            keys.append(above if self.tags[node] in ("html", "body") else key_step(above, self.label(node)))
        return keys

    def dropped(self) -> list[bool]:
        """Which nodes lie in what is no article text: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
        styles, hidden parts and comments. Wrappers of an article are not dropped for a class they carry."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        says = {node: words_of(names) for node, names in self.names.items()}
        none: set[str] = set()
        holds = [False] * n  # an article or main that is none of a comment's or advert's
        headed = [False] * n
        for node in range(n - 1, 0, -1):
            if tags[node] in ("article", "main") and not says.get(node, none) & (ADS | COMMENTS):
                holds[node] = True
            if tags[node] == "h1":
                headed[node] = True
            up = parents[node]
            holds[up] = holds[up] or holds[node]
            headed[up] = headed[up] or headed[node]
        out = [False] * n
        within = [False] * n  # an article or main, or what its class calls a post
        headings = [False] * n  # in a header of an article: headings alone count
        for node in range(1, n):
            up, tag = parents[node], tags[node]
            words = says.get(node, none)
            within[node] = within[up] or tag in ("article", "main") or bool(words & POST)
            if out[up]:
                out[node] = True
                continue
            own = tag in ("article", "main", "html", "body")
            bad = tag in NO_TEXT or node in self.hidden
            bad = bad or (tag in ASIDE and not (tag == "form" and (holds[node] or headed[node])))
            bad = bad or (not own and not holds[node] and (self.role.get(node) in ROLES or bool(words & OTHERS) or any(w.startswith(STEMS) for w in words)))
            bad = bad or (tag not in ("html", "body") and (tag == "article" or not holds[node]) and bool(words & (ADS | COMMENTS)))
            header = not own and not holds[node] and (tag == "header" or "header" in words) and tag not in HEADINGS
            headings[node] = headings[up]
            if header and not bad:
                if within[node] or words & CONTENT:
                    headings[node] = True
                else:
                    bad = True
            out[node] = bad
        if any(headings):
            shown = [False] * n
            for node in range(1, n):
                shown[node] = shown[parents[node]] or tags[node] in HEADINGS
            out = [gone or (headings[k] and not shown[k]) for k, gone in enumerate(out)]
        return out

    def blocks(self, keep: list[bool]) -> list[tuple[int, str]]:
        """(node of the first text, text) of the blocks made of kept nodes' texts; white space as one space, empty ones left out."""
        out, parts, first = [], [], 0
        for node, text in self.items:
            if text is None:
                if parts:
                    line = " ".join("".join(parts).split())
                    if line:
                        out.append((first, line))
                    parts = []
            elif keep[node]:
                if not parts:
                    first = node
                parts.append(text)
        if parts and (line := " ".join("".join(parts).split())):
            out.append((first, line))
        return out

    def masses(self, gone: list[bool]) -> list[int]:
        """Code points of running text under each node: those outside links, a third for what is no sentence."""
        n = len(self.tags)
        linked = [False] * n
        for node in range(1, n):
            linked[node] = linked[self.parents[node]] or self.tags[node] == "a"
        mass = [0] * n
        for node, line in self.blocks([not (g or k) for g, k in zip(gone, linked)]):
            prose = SENTENCE_END.search(line) or line.count(" ") >= 9
            mass[node] += 3 * len(line) if prose else len(line)
        for node in range(n - 1, 0, -1):
            mass[self.parents[node]] += mass[node]
        return mass

    def best(self, gone: list[bool], mass: list[int]) -> int:
        """The container of the main text: the article with most of it if articles hold a third, else the innermost container
        that holds three fifths of what the one around it does, unless all the rest are headings: these are its title."""
        articles = [k for k, tag in enumerate(self.tags) if tag == "article" and not gone[k]]
        if articles:
            top = max(articles, key=lambda k: (mass[k], -k))
            held = [False] * len(self.tags)  # below an article
            for node in range(1, len(self.tags)):
                held[node] = held[self.parents[node]] or self.tags[self.parents[node]] == "article"
            if 3 * sum(mass[k] for k in articles if not held[k]) >= mass[0] and mass[top]:
                return top
        children: dict[int, list[int]] = {}
        for node in range(1, len(self.tags)):
            if mass[node]:
                children.setdefault(self.parents[node], []).append(node)
        own = list(mass)
        last = list(range(len(self.tags)))  # the last node below each; nodes are numbered in page order
        titled = [False] * len(self.tags)
        for k in range(len(self.tags) - 1, 0, -1):
            own[self.parents[k]] -= mass[k]
            last[self.parents[k]] = max(last[self.parents[k]], last[k])
        for k in range(1, len(self.tags)):
            titled[k] = titled[self.parents[k]] or self.tags[k] in HEADINGS
        texts = [0, *itertools.accumulate(x > 0 for x in own)]  # how many nodes before each have text, and text that is no heading
        plain = [0, *itertools.accumulate(x > 0 and not t for x, t in zip(own, titled))]
        beside = lambda count, node, big: count[last[node] + 1] - count[node] - count[last[big] + 1] + count[big]
        node = here = 0
        while inner := children.get(here):
            big = max(inner, key=lambda k: (mass[k], -k))
            if 5 * mass[big] < 3 * mass[node]:
                break
            if node and beside(texts, node, big) and not beside(plain, node, big):
                break
            here = big
            if self.tags[big] in HOLDERS or self.tags[big] not in BLOCKS and "-" in self.tags[big]:
                node = big
        return node

    def text(self, roots: Iterable[int], gone: list[bool]) -> str:
        """The kept text under these nodes, in page order, a line for each block."""
        inside = [False] * len(self.tags)
        for k in roots:
            inside[k] = True
        for node in range(1, len(self.tags)):
            inside[node] = inside[node] or inside[self.parents[node]]
        return "\n".join(line for _, line in self.blocks([i and not g for i, g in zip(inside, gone)]))


def key_step(above: bytes, label: str) -> bytes:
    return hashlib.blake2b(above + label.encode("utf-8", "replace"), digest_size=8).digest()


def path_key(path: str) -> bytes:
    key = b""
    for label in path.split(" > ") if path else ():
        key = key_step(key, label)
    return key


def vote(html: str | None) -> tuple[str, int]:
    """The path of a page's best container and its running text; mass 0 if there is none."""
    page = Page(html or "")
    gone = page.dropped()
    mass = page.masses(gone)
    best = page.best(gone, mass)
    return page.path(best), mass[best]


def extract(html: str | None, paths: list[str] | None = None) -> str:
    """Main text: under the first of the paths that leads to text on this page, else in its own best container."""
    page = Page(html or "")
    gone = page.dropped()
    if paths:
        keys = page.path_keys()
        for path in paths:
            wanted = path_key(path)
            roots = [k for k, key in enumerate(keys) if key == wanted and not gone[k]]
            if roots and (text := page.text(roots, gone)):
                return text
    mass = page.masses(gone)
    return page.text([page.best(gone, mass)], gone)


def host_of(url):
    """The lower-cased host of a url column; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), F.lit("")))


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, pages, mass: how many pages of each host found their main text under each path."""

    def run(batches):
        for batch in batches:
            hosts, paths, masses = [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                path, mass = vote(html)
                if mass:
                    hosts.append(host), paths.append(path), masses.append(mass)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(masses, pa.int64())], ["host", "path", "mass"])

    given = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).where("host <> ''")
    return given.mapInArrow(run, "host string, path string, mass long").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("mass").alias("mass"))


def winning_paths(votes: DataFrame, percent: int = 1) -> DataFrame:
    """host, paths: those with `percent` of the host's votes or more, so 100 at most by default, most votes first (then most
    text, then by name)."""
    total = votes.groupBy("host").agg(F.sum("pages").alias("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("p"), (-F.col("mass")).alias("m"), "path")))
    return votes.join(total, "host").where(F.col("pages") * 100 >= F.col("all") * percent).groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("paths"))


#: Parts over which the pages of a host are dealt where its paths are joined by merging.
DEAL = 32


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, paths of every row: the article's blocks joined by \\n, and the host's winning paths.

    A null or empty html, and one without main text, give ''. Pages of no host (null url, or one without ://) stand alone, by
    their own best container. Rows repeat as often as they are given; null ids stay; other columns are ignored; an empty
    table gives no rows. Pages of any length are taken whole."""
    kind = pages.schema[id_col].dataType.simpleString()
    url_kind = pages.schema[url_col].dataType.simpleString()
    votes = written(host_votes(pages, url_col, html_col), "votes")
    winners = written(winning_paths(votes), "winners")
    given = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    given = given.withColumn("host", host_of(F.col("url")))
    if winners.rows * row_bytes(winners) > broadcast_bytes(pages.sparkSession):
        dealt = winners.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
        met = given.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(DEAL)).cast("int")).join(dealt, ["host", "part"], "left")
    else:
        met = given.join(winners, "host", "left")

    def run(batches):
        for batch in batches:
            texts = [extract(html, paths) for html, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("paths")], ["page_id", "url", "text", "paths"])

    return met.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url {url_kind}, text string, paths array<string>")


def op13_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
