"""Operator 2. Main text of web pages, with site templates removed.

A page is read into a tree. Every element's subtree is hashed (tag, class, own words and the hashes of what is in it, in
their order); Spark counts for each host on how
many different pages a subtree stands, and subtrees that recur are deleted. Elements that are never main text by their
tag, role, class or id (menus, footers, adverts, forms, reader comments) are deleted as well. What counts as different
pages is told by the words of the main element, so that copies of one article don't make it a template; paragraphs and
headings inside the main element are never taken for a template.

Defined results: null or empty html gives the empty string; a null or odd url is a host of its own; repeated rows give
repeated results and count as one page; other columns don't matter. Markup that doesn't close is read as browsers do:
a block ends an open paragraph, an end tag closes all inside it, and an end tag without a start is skipped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table

#: A subtree is a template on a host if it stands on so many different pages of it and on this share of them.
MIN_PAGES = 5
MIN_SHARE = 0.1
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form head button dialog menu noscript".split())
WORDS_NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|sidebar|comments?|respond|menu|nav|navbar|breadcrumbs?|footer|masthead|share|sharing|social|newsletter|subscribe|related|popup|modal|pagination|disclaimer)(?:$|[\s_-]|\d)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr tbody b i em strong a span article main body html".split())
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("at", "inside", "key", "main", "never", "parts", "tag")

    def __init__(self, tag: str, attributes: str, at: int, inside: bool):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        role, names = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}".strip()
        self.tag, self.at, self.inside, self.key = tag, at, inside, names
        self.parts: list[str] = []  # words and the hashes of subtrees
        self.main = tag in ("article", "main") or role in ("main", "article")
        hidden = "hidden" in found or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes or "") or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.never = tag in NEVER or role in ROLES or tag == "header" and not inside or bool(hidden) or bool(names and tag not in ("html", "body") and WORDS_NEVER.search(names))


def read(page: str) -> tuple[list[tuple[str, bool, bool, int]], list[tuple[int, int, int]]]:
    """Pieces of text and subtrees of a page.

    A piece is (text, never: an element around it is never main text, in the main element, number of its block); a
    subtree is (hash, first piece, piece after its last), for elements that may be templates.
    """
    pieces: list[tuple[str, bool, bool, int]] = []
    trees: list[tuple[int, int, int]] = []
    stack: list[Element] = []
    block, never, main = 0, 0, 0

    def close(e: Element) -> None:
        nonlocal never, main
        never -= e.never
        main -= e.main
        whole = xxhash.xxh3_64_intdigest(f"{e.tag}\0{e.key}\0" + "\0".join(e.parts))
        if stack:
            stack[-1].parts.append(f"\1{whole:x}")
        if len(pieces) > e.at and not e.main and not (e.tag in TEXTUAL and e.inside) and (e.tag in BLOCKS or e.key) and e.tag not in ("body", "html") and (not e.inside or e.key):
            if not any(p[2] for p in pieces[e.at :]) or e.inside:
                trees.append((whole - 2**63, e.at, len(pieces)))

    def put(text: str) -> None:
        if text:
            if stack and (words := text.split()):
                stack[-1].parts.append(" ".join(words))
            pieces.append((entities.unescape(text) if "&" in text else text, never > 0, main > 0, block))

    end = 0
    for m in TOKEN.finditer(page):
        put(page[end : m.start()])
        end = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            put(" ")
        if tag in BLOCKS:
            block += 1
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)
            if at >= 0:
                while len(stack) > at:
                    close(stack.pop())
        elif tag not in VOID and not m[4].endswith("/"):
            if tag in BLOCKS:
                for opened in ("p", tag) if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else ("p",):
                    limit = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in ("ul", "ol", "table", "div", "article", "section", "body", "main", "dl") or stack[i].tag == opened), -1)
                    if limit >= 0 and stack[limit].tag == opened:
                        while len(stack) > limit:
                            close(stack.pop())
            e = Element(tag, m[4], len(pieces), main > 0)
            stack.append(e)
            never += e.never
            main += e.main
    put(page[end:])
    while stack:
        close(stack.pop())
    return pieces, trees


def main_text(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the main element (of the whole page, if it has none), without templates and what is never main text."""
    pieces, trees = read(page or "")
    gone = set()
    for h, a, b in trees:
        if h in templates:
            gone.update(range(a, b))
    only = any(p[2] and not p[1] and p[0].strip() for p in pieces)
    blocks: dict[int, list[str]] = {}
    for i, (text, never, main, block) in enumerate(pieces):
        if not never and i not in gone and (main or not only):
            blocks.setdefault(block, []).append(text)
    lines = (SPACE.sub(" ", "".join(x)).strip() for x in blocks.values())
    return "\n".join(x for x in lines if x)


TREES = "rid long, host long, page long, trees array<long>"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        rows = []
        for rid, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            host = re.sub(r"^[a-z]+://|[/?#:].*$", "", (url or "").lower(), flags=re.S)
            pieces, trees = read(page or "")
            words = " ".join(p[0] for p in pieces if p[2]) or " ".join(p[0] for p in pieces)
            rows.append((rid, xxhash.xxh3_64_intdigest(host) - 2**63, xxhash.xxh3_64_intdigest(words) - 2**63, list({h for h, _, _ in trees})))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], ["rid", "host", "page", "trees"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in bounded(batches):
        z = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(z, pa.binary())], ["page_id", "rid", "url", "z"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in bounded(batches):
        texts = [main_text(open_.decompress(z).decode("utf-8", "surrogatepass"), set(t or ())) for z, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame) -> DataFrame:
    """(rid, templates: hashes of the subtrees to delete) of the pages that have any."""
    read_ = cut(pages.select("rid", "url", "html").mapInArrow(_trees, TREES))  # pages are read into trees once for this
    each = read_.select("rid", "host", "page", F.explode("trees").alias("tree"))
    hosts = read_.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    often = each.groupBy("host", "tree").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= MIN_PAGES)
    often = often.join(hosts, "host").where(F.col("n") >= MIN_SHARE * F.col("pages")).select("host", "tree")
    return each.join(often, ["host", "tree"]).groupBy("rid").agg(F.collect_set("tree").alias("templates"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("page_id", "url", "html").alias("rid"), "html", "url")
    # pages travel compressed to where their templates are known
    packed = rows.mapInArrow(_packed, "page_id long, rid long, url string, z binary")
    return packed.join(templates(rows), "rid", "left").select("page_id", "url", "z", "templates").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
