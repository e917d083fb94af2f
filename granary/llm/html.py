"""Operator 7: main text of web pages, with a host suffix array for boilerplate.

Each page is read once.  Markup, scripts, styles, forms and the elements that say by tag,
class, id or role that they are menus, headers, footers, sidebars, notices, adverts or
reader comments go, inside an article too, however long they are; so do articles that say
it (cards, teasers, comments).  A header inside an article stays: it holds the article's
title.  Three exceptions, none of them for comments: where all main elements of a page lie
in such elements, those around the longest stay; a form with most of the text of a page
without main element stays; and where nothing else is left, names count for nothing that
wrappers of whole pages bear too.  The blocks of an article or main element are the page's
text.

Tags are read as browsers read them: a quote inside an unquoted value or a name is
part of it, and an element that is never closed ends with the element around it.

Text outside an article or main element, and all text of a page that has none, is
open: it may be boilerplate.  The open token streams of a host's pages are sequences
of a suffix array (see ``suffixes``), sorted by host and tokens.  Where suffixes of
``MIN_PAGES`` or more different pages share ``RUN`` tokens or more, that is a long
repeated substring; the tokens that such substrings cover are removed and the unique
runs kept.  A page of fewer tokens is compared as a whole.  Suffixes are cut into ranges
by tokens and place, not by host, and the pages of an interval are pre-aggregated, so
a host with a third of all pages is spread over all tasks.

The suffix array does not touch the inside of an article element: articles of one
host quote and copy one another, and a repeated passage there is text, not
boilerplate.

Null html counts as empty; its text is empty; an empty table gives an empty result.
Pages of equal html count once, so that copies of a page do not make its text
boilerplate.  Repeated rows are returned each.  A very long page is one row of its
task.  Other columns are not passed through, so their names cannot clash.
"""

from __future__ import annotations

import functools
import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, string_buffer, table, word_hashes, word_spans, written
from .suffixes import KEY, WIDTH, intervals, keys_of, sorted_suffixes

RUN, MIN_PAGES = 8, 3

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)|[^>])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<]*\Z""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACES = re.compile(r"\s+")
#: Their content is neither text nor tags.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
#: Their content is not text.
HIDDEN = {"noscript", "template", "svg", "math", "object", "head", "canvas", "audio", "video", "select", "option", "button"}
#: Elements that are not part of the article.
DROPPED = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "search"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Classes, ids or roles that say the same of an element.
_DROPPED_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice gdpr newsletter subscribe subscription share sharing social related recommended popup modal overlay pagination pager toolbar login signup contentinfo complementary "
    "site-header page-header site-footer page-footer main-nav site-nav main-menu nav-menu nav-bar side-bar".split()
)
_COMMENTS = {"comment", "comments", "disqus"}
#: Of compounds such as left-sidebar or user-comments the last part says what an element is ...
_LAST = set("comment comments sidebar ad ads advert adverts advertisement menu nav navbar breadcrumb breadcrumbs newsletter popup".split())
#: ... or the first one, where the last is a mere container, as in ad-box or cookie-bar ...
_FIRST = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr login menu nav newsletter pagination popup promo recommended related share sharing sidebar signup social sponsor sponsored subscribe".split())
_CONTAINERS = set(
    "area articles banner bar block body box button buttons card cards container content form frame holder icons inner item items label left link links list message modal news notice outer panel placeholder popup posts right section slot space stories thread top bottom unit widget wrap wrapper zone".split()
)
#: ... unless the compound tells a state of a wrapper, as in has-sidebar or with-header.
_STATES = {"has", "have", "with", "without", "no", "not", "is", "hide", "show", "open", "close", "closed"}
#: Names that wrappers of a whole page bear too: these are excepted where nothing else is left.
_AMBIGUOUS = set("header masthead banner share sharing social related overlay modal contentinfo complementary site-header page-header".split())
_MAIN_WORDS = {"articlebody", "main"}
_SHORT = set("p h1 h2 h3 h4 h5 h6 span a b i em strong li td".split())
#: An unclosed one of these ends where a block begins.
_OPEN_ENDED = {"p", "li", "dt", "dd", "td", "th", "option"}


def _words(attributes: str) -> tuple[set[str], set[str]]:
    """(values of class and id, values of role and itemprop)."""
    names, roles = set(), set()
    for kind, value in _NAMES.findall(attributes):
        value = value.strip("\"'").lower()
        if kind.lower() in ("class", "id"):
            names.update(_SPACES.split(value.replace("_", "-")))
        else:
            roles.update(value.split())
    return names, roles


#: What an element says of itself: nothing, dropped, dropped by an ambiguous name only, comments.
NOTHING, DROP, UNSURE, COMMENTS = range(4)


def _meaning(word: str) -> int:
    first, _, rest = word.partition("-")
    if word in _COMMENTS:
        return COMMENTS
    if word in _DROPPED_WORDS:
        return UNSURE if word in _AMBIGUOUS else DROP
    last = rest.rpartition("-")[2]
    if rest and first not in _STATES and (last in _LAST or first in _FIRST and last in _CONTAINERS):
        return COMMENTS if last in _COMMENTS or first in _COMMENTS else DROP
    return NOTHING


@functools.lru_cache(maxsize=1 << 14)
def said(tag: str, attributes: str) -> int:
    """What tag and attributes say of an element."""
    kinds = {DROP} if tag in DROPPED else set()
    if attributes and tag not in ("html", "body"):
        names, roles = _words(attributes)
        if tag in _SHORT:
            names, roles = names - {"header", "menu", "banner", "notice", "related"}, set()
        kinds |= {_meaning(w) for w in names | roles}
    return next((k for k in (COMMENTS, DROP, UNSURE) if k in kinds), NOTHING)


@functools.lru_cache(maxsize=1 << 14)
def _is_main(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or ("role" in attributes or "itemprop" in attributes) and bool(_words(attributes)[1] & _MAIN_WORDS)


class Page:
    """The tags of a page: where the element ends that each one opens, what it says of itself, and which of them stay for what they hold."""

    def __init__(self, html: str):
        self.html = html
        self.tags: list[tuple[int, int, str, bool, str]] = []  # start, end, name ("" for what is skipped), closing, attributes
        at = 0
        while m := _TAG.search(html, at):
            at, name, closing, attributes = m.end(), (m[2] or "").lower(), bool(m[1]), m[3] or ""
            if name in RAW:
                if not closing and not attributes.endswith("/"):
                    end = _CLOSING[name].search(html, at)
                    at = end.end() if end else len(html) if name in ("script", "style") else at
                name = ""
            self.tags.append((m.start(), at, name, closing, attributes))
        self.ends = [0] * len(self.tags)
        self.said = [NOTHING] * len(self.tags)
        self.free: list[int] = []  # main elements in no element that is dropped
        self.marked: list[int] = []  # those that are, but not among comments
        self.forms: list[int] = []
        self._read()
        self.stays = self._stays()

    def _read(self) -> None:
        stack: list[tuple[str, int, int]] = []  # name, tag, what it and the elements around it say

        def close(k: int, i: int) -> None:
            while len(stack) > k:
                self.ends[stack.pop()[1]] = i

        for i, (_, _, name, closing, attributes) in enumerate(self.tags):
            if not name:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k, i)
                        break
                continue
            if stack and (stack[-1][0] in ("p", "head") and name in BLOCKS and name != "br" or stack[-1][0] == name and name in _OPEN_ENDED):
                close(len(stack) - 1, i)
            if name in _VOID or attributes.endswith("/"):
                self.ends[i] = i
                continue
            self.said[i] = own = said(name, attributes)
            around = max(stack[-1][2] if stack else NOTHING, own)
            stack.append((name, i, around))
            if name == "form":
                self.forms.append(i)
            if _is_main(name, attributes) and around != COMMENTS:
                (self.marked if around else self.free).append(i)
        close(0, len(self.tags))

    def _size(self, i: int, j: int) -> int:
        """Characters of text, without white space, from tag i to tag j."""
        ends = [t[0] for t in self.tags[i + 1 : j + 1]] + [len(self.html)] * (j >= len(self.tags))
        return sum(len("".join(self.html[t[1] : end].split())) for t, end in zip(self.tags[i:j], ends, strict=False))

    def _stays(self) -> set[int]:
        """Elements that would be dropped but hold the page's only main text.

        A page with a main element outside of all of them has none.  Where all main
        elements lie in some, those around the longest one stay.  Where there is no main
        element at all, a form stays that has most of the page's text, as forms are put
        around whole pages.
        """
        if self.free:
            return set()
        if self.marked:
            best = max(self.marked, key=lambda i: (self._size(i, self.ends[i]), -i))
            return {i for i, k in enumerate(self.said[: best + 1]) if k and self.ends[i] >= self.ends[best]}
        whole = self._size(0, len(self.tags)) if self.forms else 0
        return {i for i in self.forms if 2 * self._size(i, self.ends[i]) > whole and self.said[i] != COMMENTS}


def blocks(html: str) -> tuple[list[str], list[bool]]:
    """The text blocks of a page in order, and whether each lies in an article or main element.

    If nothing is left, elements stay that are dropped for an ambiguous name alone.
    """
    page = Page(html)
    out, inside = _blocks(page, (DROP, UNSURE, COMMENTS))
    return (out, inside) if out or UNSURE not in page.said else _blocks(page, (DROP, COMMENTS))


def _blocks(page: Page, drops: tuple[int, ...]) -> tuple[list[str], list[bool]]:
    html = page.html
    out, inside, parts = [], [], []
    main: list[int] = []  # where the open main elements end

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(text)
                inside.append(bool(main))
            parts.clear()

    i = at = 0
    while i < len(page.tags):
        start, end, name, closing, attributes = page.tags[i]
        if start > at:
            parts.append(html[at:start])
        at = end
        while main and main[-1] <= i:
            flush()
            main.pop()
        if name in BLOCKS:
            flush()
        if name and not closing and page.ends[i] > i:
            dropped = name in HIDDEN or page.said[i] in drops and i not in page.stays and not (name == "header" and main and said("div", attributes) == NOTHING)
            if dropped:
                if name not in HIDDEN:
                    flush()
                i = page.ends[i]
                at = page.tags[i][0] if i < len(page.tags) else len(html)
                continue
            if _is_main(name, attributes):
                flush()
                main.append(page.ends[i])
        i += 1
    parts.append(html[at:])
    flush()
    return out, inside


def _host(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def _read(batches):
    """(row, url, html) -> (row, host, texts, inside, open): the blocks of each page, and those that are open as one text."""
    for batch in batches:
        hosts = [_host(url) for url in batch.column(1).to_pylist()]
        found = [blocks(page or "") for page in batch.column(2).to_pylist()]
        texts, insides = [t for t, _ in found], [i for _, i in found]
        rest = [" ".join(t for t, i in zip(*f, strict=True) if not i) for f in found]
        columns = [pa.array(hosts, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(insides, pa.list_(pa.bool_())), pa.array(rest, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "host", "texts", "inside", "open"])


def _suffixes(batches, run: int):
    """(ih, th, host, open) -> (KEY, key, depth): the token suffixes of each page that have run tokens, or all of a shorter page as one symbol."""
    for batch in batches:
        data, offsets = string_buffer(batch.column(3))
        starts, ends, first = word_spans(data, offsets)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        host = np.array([xxhash.xxh3_64_intdigest(h or "") for h in batch.column(2).to_pylist()], np.uint64)
        ids = np.stack([mixed(word_hashes(data, starts, ends, k) ^ host[doc]) for k in (0, 1)], axis=1)
        at = np.flatnonzero(np.arange(len(doc)) + run <= first[1:][doc])
        short = np.flatnonzero((n > 0) & (n < run))
        whole = [xxhash.xxh3_128_digest(bytes(data[offsets[d] : offsets[d + 1]]), seed=int(host[d])) for d in short]
        ids = np.concatenate([ids, np.frombuffer(b"".join(whole), np.uint64).reshape(-1, 2)])
        places = np.concatenate([at, len(doc) + np.arange(len(short))])
        lens = np.concatenate([np.full(len(at), run), np.ones(len(short), np.int64)])
        take = pa.array(np.concatenate([doc[at], short]))
        pos = np.concatenate([at - first[:-1][doc[at]], np.zeros(len(short), np.int64)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int64()), keys_of(ids, places, lens), pa.array(lens, pa.int64())], names=[*KEY, "key", "depth"]
        )


def _unique_runs(run: int):
    """(row, texts, inside, hits) -> (row, text): open blocks without the tokens under repeated runs, the others whole."""

    def cut(batches):
        for batch in batches:
            texts = []
            for blocks_, inside, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = set()
                for p in hits or []:
                    gone.update(range(p, p + run))
                n, kept = 0, []
                for block, whole in zip(blocks_, inside, strict=True):
                    if whole:
                        kept.append(block)
                        continue
                    tokens = word_tokens(block)
                    left = [t for i, t in enumerate(tokens, n) if i not in gone]
                    n += len(tokens)
                    if left:
                        kept.append(" ".join(left) if len(left) < len(tokens) else block)
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return cut


def word_tokens(block: str) -> list[str]:
    """The tokens of a block as word_spans finds them."""
    return [t for t in re.split(r"[\x20\x09-\x0D]+", block) if t]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """(id_col, url_col, text) of every page."""
    if run > WIDTH:
        raise ValueError(f"a run has {WIDTH} tokens at most")
    page = F.xxhash64(F.col(html_col).isNull(), F.col(html_col))
    row = F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(url_col).isNull(), F.col(url_col)).alias("ih"), page.alias("th"))
    rows = pages.select(row.alias("row"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["row"].dataType.simpleString()
    read = written(rows.mapInArrow(_read, f"row {kind}, host string, texts array<string>, inside array<boolean>, open string"))
    has_open = read.filter("open <> ''")
    suffixes = has_open.select("row.ih", "row.th", "host", "open").mapInArrow(functools.partial(_suffixes, run=run), "ih long, th long, pos long, key binary, depth long")
    array = sorted_suffixes(suffixes).drop("key").filter(F.greatest("lcp", "after") >= F.col("depth"))
    found = written(intervals(array))
    pages_of = found.groupBy("interval", "th").agg(F.lit(1).alias("one")).groupBy("interval").agg(F.count("*").alias("n"))
    repeated = written(pages_of.filter(F.col("n") >= min_pages).select("interval"))
    hits = written(found.join(repeated, "interval").groupBy("ih", "th").agg(F.collect_set("pos").alias("hits")))
    own = has_open.select("row.ih", "row.th", "row", "texts", "inside").join(hits, ["ih", "th"], "left").select("row", "texts", "inside", "hits")
    text = read.filter("open = ''").select("row", F.array_join("texts", "\n").alias("text")).union(own.mapInArrow(_unique_runs(run), f"row {kind}, text string"))
    return text.select(F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), "text")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
