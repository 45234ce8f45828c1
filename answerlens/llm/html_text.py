"""Main text of web pages by paths on which the pages of a host agree.

Every page's containers are scored by the running text directly inside them. A page votes for the path of its best one,
written as tags and classes with digits taken out. Votes are summed per host and path in Spark; the paths that get at
least ``LEAST_SHARE`` of a host's votes win. Each page is then extracted again from the first winning path it has, and
from its own best container if it has none.

Votes are combined before they are shuffled, so a host with most of the pages is no burden. The winners are a few rows a
host; they are broadcast if there are at most ``MOST_BROADCAST`` of them, else joined, where a large host is split.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from answerlens.llm.common import set_aside, settled, tuned

LEAST_SHARE = 0.1
MOST_BROADCAST = 20_000
# Longer paths are named by a digest.
_NAMED = 200

# Content that runs to the end of the page where its end tag is missing, and content that is markup then.
_RAW = "script|style|textarea|title"
_CLOSED = frozenset("noscript template iframe object svg math select".split())
# Tags that say nothing: what a head holds is void or raw.
_PLAIN = frozenset(["head"])
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_DIGITS = re.compile(r"\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("body div article section main td center".split())
_BLOCKS = _CONTAINERS | frozenset(
    "html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption"
    " header footer nav aside form fieldset address details summary hr hgroup".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
_NOT_MAIN = frozenset("nav footer aside form button menu dialog fieldset label".split())
# Names that speak against an element, but not as ``has-``, ``no-`` or ``with-`` something, or something ``-open``.
_NOT_MAIN_NAMES = re.compile(
    r"(?:^|\s|(?<!\bhas)(?<!\bno)(?<!\bwith)[_-])(?:nav(?:bar|igation)?|menu|site-?header|page-?header|top-?bar|masthead|footer|side-?bar|aside|ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|sign-?up|login|comments?|replies|respond|disqus|discussion"
    r"|share|sharing|social|related|recommend(?:ed|ations)?|breadcrumbs?|pagination|pager|search|toolbar|widget|skip-?link)(?:$|[\s_]|-(?!open\b|closed\b|enabled\b|disabled\b|on\b|off\b))",
    re.I,
)
_NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
# What an opening tag closes, up to the nearest of its own surroundings.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


def _lowered(html: str) -> str:
    """Lower case that keeps every place: ASCII letters only."""
    return html.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}


def _named(path: str) -> str:
    """The path, or, if it is long, a digest that stands for it, so that deep pages do not grow with the square of their depth."""
    return path if len(path) <= _NAMED else "#" + blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest()


class Page:
    """Blocks of a page in order, each with the containers that hold it."""

    def __init__(self, html: str):
        #: per container: path, parent, whether an article or main element
        self.paths: list[str] = [""]
        self.parents: list[int] = [0]
        self.strong: list[bool] = [False]
        #: per block: text, container, characters inside links, whether prose, and the nearest doubtful element (0: none)
        self.blocks: list[tuple[str, int, int, bool, int]] = []
        #: per doubtful element, one whose name speaks against it: the doubtful element around it
        self.doubts: list[int] = [0]
        self._read(html)
        self._settle_doubts()

    def _settle_doubts(self) -> None:
        """Leave out the blocks of doubtful elements.

        Not so where there is no article outside the element and it holds one, or most of the page's running text: then
        its name speaks of the page's layout.
        """
        if len(self.doubts) == 1:
            return
        n = len(self.doubts)
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):
            inside[i] = self.strong[i] or (i > 0 and inside[parent])
        running, articles = [0] * n, [0] * n
        for text, container, linked, prose, doubt in self.blocks:
            size = max(0, len(text) - 2 * linked) if prose or inside[container] else 0
            running[doubt] += size
            articles[doubt] += len(text) if inside[container] else 0
        # An element comes after the one around it; the first entry is then the whole page.
        for i in range(n - 1, 0, -1):
            running[self.doubts[i]] += running[i]
            articles[self.doubts[i]] += articles[i]
        out = [False] * n
        for i in range(1, n):
            spared = articles[i] == articles[0] and (articles[i] > 0 or 2 * running[i] > running[0])
            out[i] = out[self.doubts[i]] or not spared
        self.blocks = [b for b in self.blocks if not out[b[4]]]

    def _read(self, html: str) -> None:
        # Open elements: tag, container, whether outside the main text, whether inside a link, whether prose, nearest doubt.
        stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, 0)]
        text: list[str] = []
        linked = 0

        def flush():
            nonlocal linked
            if text:
                joined = " ".join(unescape("".join(text)).split())
                if joined:
                    self.blocks.append((joined, stack[-1][1], linked, stack[-1][4], stack[-1][5]))
                text.clear()
            linked = 0

        def close_to(depth):
            del stack[depth:]

        def add(part):
            nonlocal linked
            if part and not stack[-1][2]:
                text.append(part)
                if stack[-1][3]:
                    linked += len(part.strip())

        at, lowered, unclosed = 0, None, set()
        while m := _TOKEN.search(html, at):
            add(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"] and m["raw"].lower() != "title":
                    add(" ")
                continue
            tag = tag.lower()
            if tag in _PLAIN:
                continue
            if tag in _CLOSED:
                if m["end"] or m["attrs"].endswith("/") or tag in unclosed:
                    continue
                lowered = lowered or _lowered(html)
                end = lowered.find(f"</{tag}", at)
                if end < 0:
                    unclosed.add(tag)
                else:
                    end = html.find(">", end)
                    at = end + 1 if end >= 0 else len(html)
                    add(" ")
                continue
            if m["end"]:
                if tag in _BLOCKS:
                    flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        flush() if any(x[0] in _BLOCKS for x in stack[depth:]) else None
                        close_to(depth)
                        break
                    # An inline end tag does not reach out of its block.
                    if tag not in _BLOCKS and stack[depth][0] in _BLOCKS:
                        break
                continue
            if tag == "br":
                add(" ")
                continue
            if tag in _BLOCKS:
                flush()
                for depth in range(len(stack) - 1, 0, -1):
                    # A block inside a paragraph ends it, as it ends a heading that was left open.
                    if stack[depth][0] == "p":
                        close_to(depth)
                        break
                    if stack[depth][0] in _BLOCKS:
                        break
                if tag in _CLOSES:
                    ends, until = _CLOSES[tag]
                    found = 0
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] in until:
                            break
                        if stack[depth][0] in ends:
                            found = depth
                    if found:
                        close_to(found)
            if tag in _VOID:
                continue
            _, container, out, link, prose, doubt = stack[-1]
            names = ""
            if "=" in m["attrs"]:
                attrs = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m["attrs"])}
                names = attrs.get("class", "")
                out = out or attrs.get("role", "").lower() in _NOT_MAIN_ROLES
                if tag not in ("html", "body", "article", "main") and not out:
                    if any(_NOT_MAIN_NAMES.search(attrs.get(k, "")) for k in ("class", "id")):
                        self.doubts.append(doubt)
                        doubt = len(self.doubts) - 1
            in_article = any(x[0] in ("article", "main") for x in stack)
            out = out or tag in _NOT_MAIN or (tag == "header" and not in_article)
            if tag in _CONTAINERS and not out:
                label = ".".join([tag, *_DIGITS.sub("#", names).lower().split()])
                self.paths.append(_named(f"{self.paths[container]}/{label}"))
                self.parents.append(container)
                self.strong.append(tag in ("article", "main"))
                container = len(self.paths) - 1
            stack.append((tag, container, out, link or tag == "a", tag in _PROSE or (prose and tag not in _BLOCKS), doubt))
        add(html[at:])
        flush()

    def best(self) -> int:
        """The container with most running text: its own, and half of that right below it. Ties: the first."""
        scores = [0.0] * len(self.paths)
        for text, container, linked, prose, _ in self.blocks:
            own = (len(text) - 2 * min(linked, len(text))) * (1.0 if prose else 0.3)
            scores[container] += own
            scores[self.parents[container]] += own / 2 if container else 0
        scores = [s * (2 if strong else 1) for s, strong in zip(scores, self.strong, strict=True)]
        return max(range(len(scores)), key=scores.__getitem__)

    def text(self, roots: set[int]) -> str:
        """The blocks inside the given containers, in page order."""
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):
            inside[i] = i in roots or (i > 0 and inside[parent])
        return "\n".join(text for text, container, *_ in self.blocks if inside[container])


def main_text(html: str, winners: list[str]) -> str:
    page = Page(html)
    for path in winners:
        if roots := {i for i, p in enumerate(page.paths) if p == path}:
            if found := page.text(roots):
                return found
    return page.text({page.best()}) if page.blocks else ""


def host(url: str) -> Column:
    """The host of a URL, lower-cased, without port and a leading ``www.``; empty if there is none."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.lower(found), r"^www\.", "")


def winning_paths(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, winners): the paths of a host with ``least_share`` of its votes, by votes; ``pages`` has host and html.

    No more than one over the share can have so many, which bounds what is gathered per host; the share must be over 0.
    """

    def vote(batches):
        for batch in batches:
            paths = []
            for html in batch.column("html"):
                page = Page(html.as_py() or "")
                paths.append(page.paths[page.best()] if page.blocks else None)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string").where("path is not null")
    counted = settled(votes.groupBy("host", "path").agg(F.count("*").alias("n")), "path-votes")
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    won = counted.join(totals, "host").where(F.col("n") >= least_share * F.col("total"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), F.col("path").alias("path"))))
    return won.groupBy("host").agg(order["path"].alias("winners"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """The rows of ``pages``, all columns, with the main text. A null html counts as empty and gives an empty text.

    Pages without a host in their URL vote together. A column named like ``text_col`` is replaced; no other name can clash.
    An empty table gives no row.
    """
    pages = pages.drop(text_col)
    names = pages.columns
    pages, _ = set_aside(pages, url_col, html_col)
    known = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html"))
    winners = settled(winning_paths(known), "winning-paths")
    if winners.count() <= MOST_BROADCAST:
        winners = F.broadcast(winners)
    joined = pages.withColumn("_host", host(url_col)).join(winners.select(F.col("host").alias("_of"), F.col("winners").alias("_winners")), F.col("_host") == F.col("_of"), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in pages.columns), "_winners")
    place = pages.columns.index(html_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "", w.as_py() or []) for h, w in zip(batch.column(place), batch.column("_winners"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, text_col])

    fields = [StructField(name, field.dataType) for name, field in zip(names, pages.schema.fields, strict=True)]
    return joined.mapInArrow(run, StructType(fields).add(text_col, StringType()))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = tuned(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    # The html goes no further than the extraction.
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
