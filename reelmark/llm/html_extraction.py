"""HTML extraction by consensus host paths.

Every page is cut into containers, each with a generalised path of tags and classes. A page
scores its containers by text, links and names and votes for the best; the votes are added
up per host in Spark. Each host's pages are then extracted again from the containers at the
path that won there; a page without a container at that path falls back on its own best.

What goes from inside a container: elements that are chrome by tag, role or being hidden, and those
whose class or id says nothing but what chrome they are (``ad-slot``, ``comments``). A name that only
hints at chrome (``legal-text``, ``alert``) removes nothing by itself: its path is put to the host's vote,
and goes where most of the host's pages that have it share its text with another page.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmark.llm.common import Scratch, table, text_or_empty
from reelmark.llm.url_filters import host_of

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title iframe noframes xmp svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
BOILERPLATE = frozenset("nav aside footer header form menu select input dialog object embed canvas audio video head".split())
#: Opening one of the keys ends an open element of the values.
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements whose opening ends an open paragraph, and those beyond which nothing is ended by implication.
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
SCOPE = frozenset("html body table td th ul ol dl select article section main div aside nav footer header form blockquote".split())
#: Words in class and id names that hint at what isn't the article.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|side-?bar|foot\w*|masthead|site-?header|page-?header|top-?bar|comments?|disqus|repl(?:y|ies)|respond|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share\w*|social|related|recommend\w*|widgets?|toolbar|pager|pagination|copyright|legal|disclaimer|skip\w*)(?=$|[\s_-])",
    re.I,
)
#: Words that name chrome, and those that may stand beside them; a name of only such words, one of the first among them, is chrome.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar comments disqus replies respond cookie cookies consent "
    "gdpr popup newsletter subscribe subscription signup login share sharing social toolbar pager pagination".split()
)
BESIDE = frozenset(
    "box block list slot unit area wrap wrapper container inner outer section top bottom left right main site page post header bar banner item items link links button buttons icons form thread reader user notice overlay modal widget "
    "primary secondary global mobile desktop content n".split()
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body|text)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar alertdialog".split())

#: Characters of a path beyond which its hash stands for it, so that deep pages take no quadratic space.
LONGEST_PATH = 2000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[\s_-]+")
#: How much of its score a container keeps whose name, or a name around it, hints at chrome.
HINTED = 0.2


class Element:
    """An open or closed element: its path, whether it is noise or its name hints at that, and its place among the blocks."""

    __slots__ = ("tag", "path", "noise", "hinted", "first", "last")

    def __init__(self, tag: str, path: str, noise: bool, hinted: bool, first: int):
        self.tag, self.path, self.noise, self.hinted, self.first, self.last = tag, path, noise, hinted, first, first


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html_entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes of a path step, without what differs from page to page: ids and numbers."""
    classes = sorted({_DIGITS.sub("N", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def _is_noise(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in BOILERPLATE and not (tag == "header" and inside_article):
        return True
    if not attributes:
        return False
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    if hidden or attributes.get("role", "").lower() in ROLES:
        return True
    return _may_be_named(tag) and any(_names_chrome(name) for name in [*attributes.get("class", "").split(), attributes.get("id", "")])


def _may_be_named(tag: str) -> bool:
    return tag not in ("body", "html", "article", "main")


def _names_chrome(name: str) -> bool:
    """Whether a class or id is made of words for chrome and words beside them alone."""
    parts = [p for p in _PART.split(_DIGITS.sub("", name.lower())) if p]
    return any(p in CHROME for p in parts) and all(p in CHROME or p in BESIDE for p in parts)


def _hints(tag: str, attributes: dict[str, str]) -> bool:
    return bool(attributes) and _may_be_named(tag) and bool(HINT.search(f"{attributes.get('class', '')} {attributes.get('id', '')}"))


class Page:
    """A parsed page: blocks of (text, link characters), containers and elements put to the vote, with the blocks they span.

    ``dropped`` are the paths that the host's vote removes.
    """

    def __init__(self, source: str, dropped: frozenset[str] = frozenset()):
        self.blocks: list[tuple[str, int]] = []
        self.containers: list[Element] = []
        self.nominated: list[Element] = []
        self._dropped = dropped
        self._parts: list[str] = []
        self._linked = 0
        self._open_tags: Counter[str] = Counter()
        self._parse(source)

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            self.blocks.append((text, self._linked))
        self._parts, self._linked = [], 0

    def _close(self, stack: list[Element], down_to: int) -> None:
        """Close the elements from the top of the stack down to place ``down_to``."""
        if any(e.tag in BLOCK for e in stack[down_to:]):
            self._flush()
        for element in stack[down_to:]:
            element.last = len(self.blocks)
            self._open_tags[element.tag] -= 1
        del stack[down_to:]

    def _parse(self, source: str) -> None:
        stack: list[Element] = []
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            self._text(source[at : m.start() if m else end], stack)
            if not m:
                break
            at = m.end()
            tag = m[1]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), stack)
                continue
            tag = tag.lower()
            if m[0][1] == "/":
                if not self._open_tags[tag]:
                    if tag == "p":
                        self._flush()
                    continue
                for place in range(len(stack) - 1, -1, -1):
                    if stack[place].tag == tag:
                        self._close(stack, place)
                        break
                    if stack[place].tag in SCOPE and tag not in SCOPE:
                        break  # a stray end tag doesn't close what stands around it
                continue
            if tag in RAW:
                if tag != "svg" or not m[0].endswith("/>"):  # elsewhere a slash closes nothing
                    close = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*|/)?>", re.I).search(source, at)
                    at = close.end() if close else end
                continue
            self._open(tag, m[2], stack)
            if m[0].endswith("/>") and tag not in BLOCK and stack and stack[-1].tag == tag:
                self._open_tags[stack.pop().tag] -= 1
        self._close(stack, 0)
        self._flush()

    def _open(self, tag: str, source: str, stack: list[Element]) -> None:
        if tag == "br" or tag == "wbr":
            self._parts.append(" " if tag == "br" else "")
            return
        ends = IMPLIED_END.get(tag, ())
        ends = {*ends, "p"} if tag in ENDS_P else ends
        for place in range(len(stack) - 1, -1, -1) if any(self._open_tags[t] for t in ends) else ():
            if stack[place].tag in ends:
                self._close(stack, place)
                break
            if stack[place].tag in SCOPE:
                break
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        parent = stack[-1] if stack else None
        attributes = _attributes(source) if source.strip() else {}
        inside = tag == "header" and self._open_tags["article"] + self._open_tags["main"] > 0
        noise = (parent.noise if parent else False) or _is_noise(tag, attributes, inside)
        path = f"{parent.path}>{_step(tag, attributes)}" if parent and tag in BLOCK else parent.path if parent else _step(tag, attributes)
        if len(path) > LONGEST_PATH:
            path = "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()
        hinted = not noise and tag in BLOCK and _hints(tag, attributes)
        noise = noise or (hinted and path in self._dropped)
        element = Element(tag, path, noise, hinted or bool(parent and parent.hinted), len(self.blocks))
        if hinted and not noise:
            self.nominated.append(element)
        if tag in CONTAINER and not noise:
            self.containers.append(element)
        stack.append(element)
        self._open_tags[tag] += 1

    def _text(self, text: str, stack: list[Element]) -> None:
        if not text or (stack and stack[-1].noise):
            return
        text = html_entities.unescape(text) if "&" in text else text
        self._parts.append(text)
        if self._open_tags["a"]:
            self._linked += len(text)

    def score(self, element: Element) -> float:
        """Text outside links, more for articles, less for a container that holds one of them."""
        blocks = self.blocks[element.first : element.last]
        plain = sum(len(text) - 2 * linked for text, linked in blocks)
        weight = {"article": 2.0, "main": 1.5, "body": 0.7}.get(element.tag, 1.0)
        return plain * weight * (1.3 if LIKELY.search(element.path.rpartition(">")[2]) else 1.0) * (HINTED if element.hinted else 1.0)

    def best(self) -> tuple[str, float] | None:
        """Path and score of the page's best container; ties go to the first one, which is the outermost."""
        scored = [(self.score(e), e.path) for e in self.containers if e.last > e.first]
        if not scored:
            return None
        score, path = max(scored, key=lambda x: x[0])
        return path, score

    def text_at(self, path: str | None) -> str | None:
        """Blocks of the containers at the path, in page order; None if there is none."""
        spans = [(e.first, e.last) for e in self.containers if e.path == path and e.last > e.first]
        if not spans:
            return None
        found, upto = [], 0
        for first, last in spans:
            found += [text for text, _ in self.blocks[max(first, upto) : last]]
            upto = max(upto, last)
        return "\n".join(found)

    def digest(self, element: Element) -> str:
        return hashlib.md5("\n".join(text for text, _ in self.blocks[element.first : element.last]).encode("utf-8", "surrogatepass")).hexdigest()

    def key(self) -> str:
        """What copies of a page have in common: the digest of its longest block."""
        longest = max((text for text, _ in self.blocks), key=lambda t: (len(t), t), default="")
        return hashlib.md5(longest.encode("utf-8", "surrogatepass")).hexdigest()

    def all_text(self) -> str:
        return "\n".join(text for text, _ in self.blocks)


VOTES = "host string, path string, digest string, votes long, score double, low string, high string"


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, digest, votes, score, low, high): without a digest the pages' best containers, with one the texts of nominated elements.

    ``low`` and ``high`` are the least and greatest keys of the pages, which copies of a page have in
    common. Each task adds up its pages' votes before the shuffle, so that a hot host sends few rows.
    """

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found: dict[tuple[str, str, str | None], list] = {}
            for host, source in zip(rows.host, rows.html):
                page = Page(source)
                best, key = page.best(), page.key()
                cast = [(best[0], None, best[1])] if best else []
                cast += {(e.path, page.digest(e), 0.0) for e in page.nominated if e.last > e.first}
                for path, digest, score in cast:
                    held = found.setdefault((host, path, digest), [0, 0.0, key, key])
                    held[0] += 1
                    held[1] += round(score)
                    held[2:] = min(held[2], key), max(held[3], key)
            yield pd.DataFrame([(*key, *held) for key, held in found.items()], columns=["host", "path", "digest", "votes", "score", "low", "high"])

    votes = pages.select(host_of(F.col("url")).alias("host"), text_or_empty("html").alias("html")).mapInPandas(vote, VOTES)
    return votes.groupBy("host", "path", "digest").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"), F.min("low").alias("low"), F.max("high").alias("high"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path, dropped): the path with the most votes of each host (ties go by score, then the shorter, then first path), and the paths that its vote removes.

    A nominated path goes if most of the host's pages that have it share its text with another page;
    copies of one page, which have their longest block in common, don't count as others.
    """
    best = F.max_by("path", F.struct("votes", "score", -F.length("path"), F.col("path")))
    winners = votes.where("digest IS NULL").groupBy("host").agg(best.alias("path"))
    shares = votes.where("digest IS NOT NULL").groupBy("host", "path").agg(F.sum("votes").alias("pages"), F.sum(F.when(F.col("low") < F.col("high"), F.col("votes")).otherwise(0)).alias("repeated"))
    dropped = shares.where(F.col("repeated") * 2 > F.col("pages")).groupBy("host").agg(F.collect_set("path").alias("dropped"))
    return winners.join(dropped, "host", "left")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, path, consensus) of every page.

    A page takes the containers at its host's winning path, else its own best container, else all
    text outside boilerplate; ``consensus`` says whether the host's path was used. Null, empty and
    text-less pages give an empty text. Pages without a host vote among themselves. Rows that repeat
    a page are extracted as often, and count as pages in the votes.
    """
    paths = Scratch(spark, "html").write(winning_paths(host_votes(pages)))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), text_or_empty("html").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for source, path, dropped in zip(rows.html, rows.path, rows.dropped):
                page = Page(source, frozenset(dropped) if dropped is not None else frozenset())
                text, used = page.text_at(path), path
                if text is None:
                    best = page.best()
                    used = best[0] if best else None
                    text = page.text_at(used) if best else page.all_text()
                found.append((text, used, used is not None and used == path))
            yield pd.concat([rows[["page_id", "url"]].reset_index(drop=True), pd.DataFrame(found, columns=["text", "path", "consensus"])], axis=1)

    joined = rows.join(paths, "host", "left").select("page_id", "url", "html", "path", "dropped")
    return joined.mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, path string, consensus boolean")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points; rows as in ``extract``."""
    found = extract(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
