"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: its tags, each in the role that its path gives it, and its whole
text blocks. Tokens whose counts agree on every page of a host share an occurrence vector and form
an equivalence class; the vectors are compared by 128-bit fingerprints, sums over pages that Spark
adds up before it shuffles, so no host's pages ever meet in one place. A class is valid if it
stands on enough pages and its tokens keep one order on all of them; valid classes, nested by
their paths, are the template. What remains of a page are its slots: constant text of the template
and slots that hold links only are left out, as are the elements that markup names as boilerplate.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fits_broadcast, load, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[a-zA-Z/!?](?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL)
TAG = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9:-]*)")
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements whose content is not text at all; it ends only at the closing tag.
RAW = frozenset("script style noscript template iframe textarea svg math object canvas".split())
#: Elements that are never part of the article.
ASIDE = frozenset("head title nav aside footer form button select option menu dialog label fieldset".split()) | RAW
#: Words in class, id or role that name boilerplate.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"sidebar|side|aside|menu|nav|navbar|navigation|breadcrumb\w*|footer|masthead|toolbar|share|sharing|social|related|recommended|"
    r"subscribe|newsletter|signup|login|search|comment|comments|commentlist|disqus|replies|reply|respond|pagination|pager|widget|skip|complementary|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: An open p ends where one of these starts.
ENDS_P = BLOCK - {"br", "option"}


def fingerprint(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def parse(page: str) -> tuple[list[tuple[str, bool, bool, bool, str]], list[str]]:
    """Blocks (path, aside, in article, all links, text) in page order, and the paths of all start tags.

    Unclosed and misnested tags are taken as browsers do for the cases that matter here: a block
    ends an open p, an end tag closes up to its element if that is open, and is ignored otherwise.
    Class words are weak evidence: those of elements around the article count only if another
    article stands outside such elements, and those of a page without article only if they leave text.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # name, aside by tag, article, aside by class words
    found, paths = [], []
    pieces: list[tuple[str, bool]] = []
    where = ("", False, False, False, False)
    raw = ""

    def flush() -> None:
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            found.append((*where, all(link or not t.strip() for t, link in pieces), text))
        pieces.clear()

    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            if not raw:
                if not pieces:
                    at = next((i for i, x in enumerate(stack) if x[2]), len(stack))
                    where = ("/".join(x[0] for x in stack if x[0] in BLOCK), any(x[1] for x in stack), at < len(stack), any(x[3] for x in stack[:at]), any(x[3] for x in stack[at:]))
                pieces.append((entities.unescape(token), any(x[0] == "a" for x in stack)))
            continue
        tag = TAG.match(token)
        if not tag:
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        if raw:
            if closing and name == raw:
                raw = ""
            continue
        if name in BLOCK:
            flush()
        if closing:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in ENDS_P and any(x[0] == "p" for x in stack):
            at = max(i for i, x in enumerate(stack) if x[0] == "p")
            if not any(x[0] in ENDS_P for x in stack[at + 1:]):
                del stack[at:]
        named = " ".join(a or b or c for _, a, b, c in NAMES.findall(token)) if "=" in token else ""
        article = name in ("article", "main") or "articlebody" in named.lower()
        inside = any(x[2] for x in stack)
        aside = name in ASIDE or (name == "header" and not inside)
        weak = bool(named and name not in ("html", "body", "article", "main") and ASIDE_WORDS.search(named))
        paths.append("/".join([*(x[0] for x in stack), name]) + (f".{named}" if named else ""))
        if name in RAW:
            if not token.endswith("/>"):
                raw = name
        elif name not in VOID and not token.endswith("/>"):
            stack.append((name, aside, article, weak))
    flush()
    article = any(x[2] for x in found)
    around = any(x[2] == article and not (x[1] or x[3] or x[4]) for x in found)
    blocks = [(path, aside or within or (outside and (around or inside != article)), inside, link, text) for path, aside, inside, outside, within, link, text in found]
    return blocks, paths


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, token, n, first, is_text, link): the distinct tokens of each page."""
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("host", "page", "token", "n", "first", "is_text", "link")}
        for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
            seen: dict[int, list] = {}
            blocks, paths = parse(text or "")
            for i, p in enumerate(paths):
                seen.setdefault(fingerprint("T" + p), [0, i, False, False])[0] += 1
            for i, (path, _, _, link, words) in enumerate(blocks):
                seen.setdefault(fingerprint(f"X{path}|{words}"), [0, i, True, False])[0] += 1
                x = seen.setdefault(fingerprint("S" + path), [0, i, False, True])
                x[0] += 1
                x[3] = x[3] and link
            for token, (n, first, is_text, link) in seen.items():
                for c, v in zip(rows, (host, page, token, n, first, is_text, link), strict=True):
                    rows[c].append(v)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(rows, types, strict=True)], names=list(rows))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, content): a hash of the text blocks of the article, or of all if there is none."""
    for batch in batches:
        out = []
        for text in batch.column("html").to_pylist():
            blocks, _ = parse(text or "")
            article = any(b[2] for b in blocks)
            out.append(fingerprint("\n".join(b[4] for b in blocks if not b[1] and b[2] == article)))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(out, pa.int64())], names=["host", "page", "content"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


def one_of_each(t: DataFrame, broadcast_mb: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages whose content no other page of their host has, one of each content that several have, and (host, pages) of both.

    Rows of the second that are equal are all there.
    """
    info = stored(t.mapInArrow(_contents, "host string, page bigint, content bigint"))
    groups = info.groupBy("host", "content").agg(F.count(F.lit(1)).alias("rows"), F.min("page").alias("keep"))
    counts = groups.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    groups = groups.where("rows > 1")
    copies = cut(info.join(groups, ["host", "content"]).select("page", (F.col("page") == F.col("keep")).alias("keep")).distinct())
    hint = F.broadcast if fits_broadcast(copies, F.lit(16), broadcast_mb) else (lambda x: x)
    return t.join(hint(copies.select("page")), "page", "left_anti"), t.join(hint(copies.where("keep").select("page")), "page", "left_semi"), counts


def deduce_templates(pages: DataFrame, min_pages: int = 5, share: float = 0.6, broadcast_mb: float = 32) -> DataFrame:
    """(host, drop array<bigint>): fingerprints of what is template on the pages of each host.

    A class of tokens is valid if it stands on at least min_pages pages of the host and on `share`
    of them, and its tokens come in one order on all these pages. Of valid classes the constant text
    blocks are dropped, and slots whose text is links on every page. Pages of equal content are one page.
    """
    page = F.xxhash64("page_id", "url", "html")
    t = pages.select(host_of(F.col("url")).alias("host"), page.alias("page"), "html")
    single, copied, counts = one_of_each(t, broadcast_mb)
    kinds = "host string, page bigint, token bigint, n bigint, first bigint, is_text boolean, link boolean"
    single, copied = (x.select("host", "page", "html").mapInArrow(_tokens, kinds) for x in (single, copied))
    t = single.unionByName(copied.distinct())
    # Fingerprint of the vector of counts over pages: sums that can be added up in any order.
    vector = [F.sum(F.pmod(F.xxhash64("page", "n", F.lit(salt)), F.lit(1 << 40))) for salt in (1, 2)]
    place = F.sum(F.pmod(F.xxhash64("page", "first"), F.lit(1 << 40)))
    by = t.groupBy("host", "token").agg(F.count(F.lit(1)).alias("df"), vector[0].alias("v1"), vector[1].alias("v2"), place.alias("place"),
                                        F.min("first").alias("lo"), F.max("first").alias("hi"), F.bool_and("link").alias("link"), F.bool_or("is_text").alias("is_text"))
    by = by.join(counts, "host").where((F.col("df") >= min_pages) & (F.col("df") >= F.col("pages") * share))
    # One order on all pages: tokens of a class with equal first places everywhere, or disjoint ranges of them.
    classes = by.groupBy("host", "df", "v1", "v2").agg(
        F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_list(F.struct("lo", "hi", "token", "is_text", "link", "place"))).alias("m"))
    ordered = F.filter("m", lambda x, i: (i == 0) | (F.try_element_at("m", i)["hi"] <= x["lo"]) | (F.try_element_at("m", i)["place"] == x["place"]) | x["link"])
    kept = classes.select("host", F.explode(ordered).alias("x")).where("x.is_text or x.link")
    return kept.groupBy("host").agg(F.collect_set("x.token").alias("drop"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, drop in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            blocks, _ = parse(text or "")
            article = any(b[2] for b in blocks)
            gone = set(drop or ())
            keep = []
            for path, aside, inside, link, words in blocks:
                if aside or (article and not inside):
                    continue
                # What stands in the article is never template, however often it recurs.
                if gone and not inside and (fingerprint(f"X{path}|{words}") in gone or (link and fingerprint("S" + path) in gone)):
                    continue
                keep.append(words)
            out.append(" ".join(keep))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, min_pages: int = 5, share: float = 0.6, broadcast_mb: float = 32) -> DataFrame:
    """One row (page_id, url, text) for each page; text is empty where nothing is left.

    Null pages are empty; null or odd urls share one host of their own. Repeated rows and pages
    of equal content count as one page of their host; each gets its text. An empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    found = cut(deduce_templates(pages, min_pages, share, broadcast_mb))
    small = fits_broadcast(found, F.lit(64) + F.octet_length("host") + 8 * F.size("drop"), broadcast_mb)
    at = pages.withColumn("host", host_of(F.col("url"))).join(F.broadcast(found) if small else found, "host", "left")
    return at.select("page_id", "url", "html", "drop").mapInArrow(_extract, "page_id bigint, url string, text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(load(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
