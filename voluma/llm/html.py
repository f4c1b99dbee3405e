"""Main text of web pages: site template removal by recurring subtrees, and removal of elements that are no article text.

A first pass hashes the block elements of every page (tag, class, id, text and subtrees) and sketches their words.  Spark counts,
per host, the different articles beside which each subtree stands; copies of one article count once, and so do all near copies:
articles whose text outside recurring subtrees has hardly a word, or a sketch like another article's.  However much of a page
recurs, it so counts by the text that is its own.  Subtrees that stand beside many different articles of their host are the
site's template: the second pass deletes them, together with elements whose tag, role, class or id says that they are menus,
headers, footers, sidebars, notices, adverts, forms, scripts or comments.  A paragraph, heading or list item may be quoted by many
articles, so it counts as template only where it stands on most of the host's pages.  What an article or main element holds may
be quoted by others too and is never template.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import measured, stored, text_slices

#: A subtree is template if it stands beside so many different articles of its host at least, and beside this part of them; a
#: single block of text (a paragraph and the like) beside that part.
LEAST_ARTICLES, LEAST_SHARE, LEAST_TEXT_SHARE = 3, 0.1, 0.5
#: Template hashes, or hosts, that may be broadcast: 16 bytes each.  More are joined by a shuffle, with each host dealt over so many parts.
BROADCAST_ROWS, SALTS = 200_000, 64
#: Words of a shingle of a sketch; smallest hashes a sketch keeps, and how many of them two near copies share at the same place.
SHINGLE, BANDS, BAND = 4, 4, 3
SEEDS = np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: An article needs so many words of its own to count apart from near copies.
LEAST_OWN = 6
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: HTML elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp img".split())
SKIPPED = frozenset("head nav header footer aside form script style noscript template iframe object embed svg canvas button select textarea input option dialog menu title audio video map noembed noframes".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of a class or id that mark what is no article text.
SKIPPED_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination sidebar sidebars masthead header topbar toolbar footer
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social
    related recommended widget widgets comment comments commentlist disqus respond replies form search copyright skip hidden""".split()
)
#: Words that may stand beside those in a class that marks a part of an article as none of its text.
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons container content element group icon icons inner item items left link links list module outer panel post posts right row section slot top unit wrap wrapper".split())
#: Elements that hold one block of text.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption address summary".split())
#: Elements that end an open one of the same group, and what that group may not reach past.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article main section div table ul ol dl body html td th blockquote nav header footer aside form".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _says_skipped(attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class or id says so: by any of its words, but in an article by all words of a name that are not neutral."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in SKIPPED_WORDS for w in words) and (not in_article or all(w in SKIPPED_WORDS or w in NEUTRAL_WORDS and words[0] in SKIPPED_WORDS for w in words)):
            return True
    return False


def _is_skipped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return tag == "article" and "comment" in attributes.get("class", "").lower()
    if attributes.get("role", "").lower() in SKIPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"]):
        return True
    return _says_skipped(attributes, in_article)


class Page:
    """Blocks of text of a page, outside skipped elements, and the hashes of its block elements."""

    def __init__(self, html: str, template: frozenset[int] = frozenset()):
        self.template = template
        self.blocks: list[tuple[bool, bool, str]] = []  # in an article, in main, text
        self.hashes: dict[int, bool] = {}  # and whether it is one block of text
        self.owner: dict[int, int] = {}  # block -> the innermost hashed subtree around it
        self.unowned: list[int] = []  # blocks without one so far
        self.text: list[str] = []
        self.stack: list[list] = []  # tag, is block, first block, hash parts, skipped, in article, in main
        self.has_article = self.has_main = False
        at = 0
        while found := TOKEN.search(html, at):
            self._text(html[at : found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if tag and (found[1] or found[4]):
                self._end(tag)
            elif tag:
                raw = found[3] or found[6] or ""
                self._start(tag, raw)
                if tag in RAW:
                    close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(html, at)
                    at = close.end() if close else len(html)
                    self._end(tag)
        self._text(html[at:])
        while self.stack:
            self._pop()
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1][4]):
            self.text.append(raw)

    def _flush(self) -> None:
        if self.text:
            block = " ".join(unescape("".join(self.text)).split())
            self.text.clear()
            if block:
                top = self.stack[-1] if self.stack else None
                self.unowned.append(len(self.blocks))
                self.blocks.append((top[5] if top else False, top[6] if top else False, block))
                if top:
                    top[3].append(block)

    def _start(self, tag: str, raw: str) -> None:
        block = tag not in INLINE
        if block:
            self._implied(tag)
            self._flush()
        if tag in VOID:
            return
        attributes = _attributes(raw) if raw and not raw.isspace() else {}
        top = self.stack[-1] if self.stack else None
        article, main = bool(top and top[5]), bool(top and top[6])
        skipped = bool(top and top[4]) or _is_skipped(tag, attributes, article or main)
        if not skipped and tag == "article":
            article = self.has_article = True
        if not skipped and (tag == "main" or attributes.get("role") == "main"):
            main = self.has_main = True
        mark = f"<{tag} {attributes.get('class', '')} {attributes.get('id', '')}>" if block else ""
        self.stack.append([tag, block, len(self.blocks), [mark], skipped, article, main])
        if skipped and not block and not (top and top[4]):
            self._flush()

    def _implied(self, tag: str) -> None:
        """Ends an open paragraph, list item or cell that this start tag closes."""
        closed = CLOSES.get(tag, ())
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == "p" and tag not in VOID or name in closed:
                while len(self.stack) > i:
                    self._pop()
            elif name in SCOPES:
                return

    def _end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in INLINE and self.stack[i][1]:
                return

    def _pop(self) -> None:
        if self.stack[-1][1]:
            self._flush()
        tag, block, first, parts, skipped, article, main = self.stack.pop()
        if not block or skipped:
            if not block and len(parts) > 1 and self.stack:
                self.stack[-1][3] += parts[1:]
            return
        if len(parts) > 1 and tag not in ("html", "body", "article", "main"):
            key = int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            self.hashes[key] = tag in TEXT_TAGS
            while self.unowned and self.unowned[-1] >= first:
                self.owner[self.unowned.pop()] = key
            if key in self.template and not (article or main):
                del self.blocks[first:]
            if self.stack:
                self.stack[-1][3].append(str(key))
        elif len(parts) > 1 and self.stack:
            self.stack[-1][3] += parts

    def own_words(self) -> dict[int, list[str]]:
        """Words of the main text that stand in each hashed subtree but in none inside it; those in no subtree at 0."""
        at = 0 if self.has_article else 1 if self.has_main else None
        out: dict[int, list[str]] = {0: [], **{key: [] for key in self.hashes}}
        for i, block in enumerate(self.blocks):
            if at is None or block[at]:
                out[self.owner.get(i, 0)] += block[2].split()
        return out

    def main_text(self) -> str:
        """Of articles if there are any, else of main, else of all that is left."""
        at = 0 if self.has_article else 1 if self.has_main else None
        return " ".join(b[2] for b in self.blocks if at is None or b[at])


def _sketches(texts: list[list[str]]) -> np.ndarray:
    """Of each text's words (one at least) the smallest values of BANDS * BAND hash functions over its shingles; fewer words than
    a shingle's are one."""
    codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for words in texts for w in words], np.uint64)
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at, shingles = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    for i in range(SHINGLE):
        code = np.append(codes[i:], np.zeros(min(i, len(codes)), np.uint64))
        shingles = (shingles ^ np.where(at + i < ends, code, np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
        shingles ^= shingles >> np.uint64(29)
    starts = np.cumsum(sizes) - sizes
    last = np.repeat(starts + np.maximum(sizes - SHINGLE, 0), sizes)  # the last word that begins a shingle
    out = np.zeros((len(texts), BANDS * BAND), np.int32)
    for k in range(BANDS * BAND):
        values = (shingles ^ SEEDS[k]) * np.uint64(0xBF58476D1CE4E5B9)
        values = ((values ^ (values >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)
        values[at > last] = np.iinfo(np.int32).max
        out[:, k] = np.minimum.reduceat(values, starts)
    return out


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole, 1)):
        articles, counts, keys, text, words = [], [], [], [], []
        for html in batch.column(1).to_pylist():
            page = Page(html or "")
            articles.append(int.from_bytes(hashlib.blake2b(page.main_text().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
            own = page.own_words()
            counts.append(len(own))
            keys += own
            text += [page.hashes.get(key, False) for key in own]
            words += own.values()
        sizes = np.array([len(w) for w in words], np.int64)
        held = sizes > 0
        sketches = _sketches([w for w in words if w]) if held.any() else np.zeros((0, BANDS * BAND), np.int32)
        ends = np.concatenate([[0], np.cumsum(held) * (BANDS * BAND)])
        sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~held, False)), pa.array(sketches.ravel()))
        entries = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes), sketch, pa.array(text, pa.bool_())], ["subtree", "words", "sketch", "text"])
        subtrees = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), entries)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(articles, pa.int64()), subtrees], ["host", "article", "subtrees"])


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null or none: empty."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """host (hash), subtree: the hashes of the subtrees that recur beside many different articles of the host.

    A page without a host belongs to the empty one.  Null html holds no subtree.  Repeated pages count once.
    """
    rows = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), html_col)
    rows = rows.mapInArrow(_hasher, "host long, article long, subtrees array<struct<subtree:long,words:long,sketch:array<int>,text:boolean>>")
    # The entry 0 of every page counts the host's different articles and has the words that stand in no subtree.
    each = rows.select("host", "article", F.explode("subtrees").alias("e")).select("host", "article", "e.*")
    each = stored(each.groupBy("host", "article", "subtree").agg(F.max("words").alias("words"), F.max("sketch").alias("sketch"), F.max("text").alias("text")), "subtrees")
    recurring = _recurring(each.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.max("text").alias("text")), broadcast_rows)
    recurring = recurring.select("host", "subtree", F.lit(True).alias("recurs"))
    marked = _on_host(each, recurring, ["subtree"], F.col("article"), broadcast_rows, "left")
    own = F.col("recurs").isNull() | (F.col("subtree") == 0)
    slots = [F.min(F.when(own, F.col("sketch")[i])).alias(f"s{i}") for i in range(BANDS * BAND)]
    held = F.collect_list(F.when(F.col("recurs"), F.struct("subtree", "text"))).alias("held")
    articles = marked.groupBy("host", "article").agg(F.sum(F.when(own, F.col("words"))).alias("words"), *slots, held)
    # A host without a recurring subtree has no template.
    articles = stored(articles.where(F.size("held") > 0), "articles")
    enough = F.col("words") >= LEAST_OWN
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"s{b * BAND + i}" for i in range(BAND)]) for b in range(BANDS)])
    banded = articles.where(enough).select("host", "article", F.explode(bands).alias("band"))
    shared = banded.groupBy("host", "band").agg(F.min("article").alias("first"), F.max("article").alias("last")).where("first <> last")
    near = _on_host(banded, shared.select("host", "band"), ["band"], F.col("article"), broadcast_rows).select("host", "article").distinct()
    apart = articles.join(near.withColumn("near", F.lit(True)), ["host", "article"], "left")
    apart = apart.withColumn("near", F.coalesce("near", ~enough))
    # All near copies count as one article, so what only they share is no template.
    single = apart.select("host", "near", F.explode("held").alias("e")).select("host", "near", "e.*")
    n = F.count_if(~F.col("near")) + F.max(F.col("near").cast("long"))
    found = single.groupBy("host", "subtree").agg(n.alias("n"), F.max("text").alias("text"))
    return _recurring(found, broadcast_rows).where("subtree <> 0").select("host", "subtree")


def _on_host(rows: DataFrame, table: DataFrame, keys: list[str], deal: Column, broadcast_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined by host and ``keys`` with a table that is broadcast if small; else every host is dealt over SALTS parts."""
    table, small = measured(table, "hosts", broadcast_rows)
    if small:
        return rows.join(table, ["host", *keys], how)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int"))
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(table, ["host", *keys, "_salt"], how).drop("_salt")


def _recurring(counts: DataFrame, broadcast_rows: int) -> DataFrame:
    """The counts (host, subtree, n, text) that reach the bounds; the entry 0 of a host too."""
    counts = stored(counts.where(F.col("n") >= LEAST_ARTICLES), "recurring")
    by_host = counts.where("subtree = 0").select("host", F.col("n").alias("articles"))
    share = F.when(F.col("text"), LEAST_TEXT_SHARE).otherwise(LEAST_SHARE)
    return _on_host(counts, by_host, [], F.col("subtree"), broadcast_rows).where(F.col("n") >= share * F.col("articles")).drop("articles")


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole, whole.schema.get_field_index("_html"))):
        html, template = batch.column("_html").to_pylist(), batch.column("_template").to_pylist()
        texts = [Page(h or "", frozenset(t or ())).main_text() for h, t in zip(html, template)]
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("_html", "_template")]
        columns = [batch.column(i) for i in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*[batch.schema.names[i] for i in keep], "main_text", "main_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per page: page_id, url, main_text (blocks joined by one space; empty if none), main_chars (its code points).

    Null html: empty text.  Pages without a host share one.  Repeated rows give repeated results and count once as an article;
    an empty table gives none; pages of any length are read whole; other columns are not read.
    """
    host = F.xxhash64(host_of(F.col(url_col))).alias("host")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host, F.col(html_col).alias("_html"))
    found = stored(site_templates(pages, url_col, html_col, broadcast_rows), "templates")
    template = found.groupBy("host").agg(F.collect_list("subtree").alias("_template"))
    # The pages stay where they are if the hashes of all templates are few.
    most = broadcast_rows if found.count() <= broadcast_rows else -1
    joined = _on_host(rows, template, [], F.struct("page_id", "url"), most, "left")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in ("page_id", "url"))
    return joined.select("page_id", "url", "_html", "_template").mapInArrow(_extractor, kinds + ", main_text string, main_chars long")
