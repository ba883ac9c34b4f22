"""Main text of web pages: templates deduced from equivalence classes of tokens over a host's pages, and the slots they leave."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored

#: Least tokens of a template, and of a class that fewer than CLASS_SHARE of a host's pages have; least different pages of a class.
CLASS_SIZE, CLASS_PAGES = 3, 10
#: Share of a host's different pages from which a class is template whatever its size.
CLASS_SHARE = 0.5

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object video audio canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("ul ol dl table select body article section div".split())

#: Elements, roles and words of class or id names that mark what isn't the article.
ASIDE_TAGS = frozenset("nav footer aside form button select option dialog menu head datalist".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager share sharing social related recommended recommendations widget "
    "comment comments commentlist disqus respond reply replies paywall skip search".split()
)
HEADER_WORDS = frozenset({"header", "masthead", "topbar"})
CONTENT_WORDS = frozenset("content post entry article story main".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[^\s_-]+")


@dataclass
class Block:
    path: str
    text: str
    article: int  # 3 in an article, 2 in main, 1 in an element named as content, 0 elsewhere
    at: int = 0  # start tags that stand before the text's end


def _marks(tag: str, attrs: str, inside: int) -> tuple[bool, int]:
    """Whether an element isn't part of the article, and how far it is marked as the article (see Block)."""
    level = 3 if tag == "article" else 2 if tag == "main" else 0
    if tag in ASIDE_TAGS or tag == "header" and inside < 3:
        return True, level
    if not attrs or attrs == "/":
        return False, level
    aside = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            aside |= value in ASIDE_ROLES
            level = max(level, 2 * (value == "main"))
        elif name in ("class", "id"):
            for whole in value.split():
                parts = _NAME.findall(whole)
                if parts and parts[0] not in ("has", "with", "no", "without"):
                    aside |= parts[0] in ASIDE_WORDS or parts[-1] in ASIDE_WORDS or bool(HEADER_WORDS & {parts[0], parts[-1]}) and inside < 3
                    level = max(level, bool(CONTENT_WORDS & {parts[0], parts[-1]}))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            aside = True
    return aside and tag not in ("html", "body", "main"), level


def scan(page: str) -> tuple[list[str], list[Block]]:
    """(structure, blocks): the paths of all start tags in order, and the blocks of text that aren't marked as outside of the
    article, white space as one space. A path is the names of the open elements, each with its class."""
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]  # tag, path, aside, level
    structure: list[str] = []
    blocks: list[Block] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            _, path, aside, level = next((x for x in reversed(stack) if x[0] not in INLINE), stack[0])
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text and not aside:
                blocks.append(Block(path, text, level, len(structure)))

    def close(names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text_end = m.start() if m else n
        if text_end > at and not stack[-1][2]:
            buffer.append(page[at:text_end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            if any(x[0] == tag for x in stack):
                close({tag}, frozenset())
            continue
        attrs = m[3] if m[2] else m[6]
        if tag not in INLINE and tag != "br":
            flush()
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED and tag != "p":
            close(IMPLIED[tag], SCOPE)
        _, path, aside, inside = stack[-1]
        off, level = _marks(tag, attrs, inside)
        named = re.search(r"class\s*=\s*[\"']?([^\"'>]*)", attrs) if attrs else None
        path = f"{path}/{tag}.{named[1]}" if named else f"{path}/{tag}"
        structure.append(path)
        if tag == "br":
            buffer.append(" ")
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
            if end and (shut := page.find(">", at)) >= 0:
                at = shut + 1
        elif tag not in VOID:
            stack.append((tag, path, aside or off, max(inside, level)))
    flush()
    return structure, blocks


def _token(kind: str, what: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{what}") - (1 << 63)


#: Stands once for every page that has tokens.
PAGE_TOKEN = _token("page", "")


def text_token(block: Block) -> int:
    return _token("text ", f"{block.path} {block.text}")


def sequence(page: str) -> list[int]:
    """The tokens of a page in order: start tags and blocks of text, each with its path."""
    structure, blocks = scan(page)
    out, k = [], 0
    for i, path in enumerate(structure):
        while k < len(blocks) and blocks[k].at <= i:
            out.append(text_token(blocks[k]))
            k += 1
        out.append(_token("tag ", path))
    return out + [text_token(b) for b in blocks[k:]]


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, n, at): occurrences of each token on each page and the place of the first; PAGE_TOKEN stands before all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found, counts, places = [], [], []
                for page in part.column("html").to_pylist():
                    seen: Counter[int] = Counter()
                    first: dict[int, int] = {}
                    for at, token in enumerate(sequence(page or "")):
                        seen[token] += 1
                        first.setdefault(token, at)
                    if seen:
                        seen[PAGE_TOKEN], first[PAGE_TOKEN] = 1, -1
                    found.append(list(seen))
                    counts.append(list(seen.values()))
                    places.append([first[t] for t in seen])
                arrays = [pa.array(x, pa.list_(pa.int64())) for x in (found, counts, places)]
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("page"), *arrays], names=["host", "page", "token", "n", "at"])

    got = pages.mapInArrow(run, "host string, page bigint, token array<bigint>, n array<bigint>, at array<bigint>")
    return got.select("host", "page", F.explode(F.arrays_zip("token", "n", "at")).alias("t")).select("host", "page", "t.token", "t.n", "t.at")


def classes(pages: DataFrame) -> DataFrame:
    """(host, pages, vector, tokens): the equivalence classes of each host's tokens. Tokens are of one class if they have the same
    occurrence vector: how often each page has them. A vector is known by its number of pages and by the combined hashes of
    page and count, which add up on the map side, so no task holds a host's pages. A class's tokens stand in the order of their
    first places on one page, the same for all of them. Classes of few pages are left out."""
    vector = F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    found = tokens(pages).groupBy("host", "token").agg(F.count("*").alias("pages"), vector, F.min(F.struct("page", "at")).alias("first")).where(F.col("pages") >= CLASS_PAGES * CLASS_SHARE)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first", "token"))), lambda x: x["token"])
    return found.groupBy("host", "pages", "vector").agg(ordered.alias("tokens"))


def faults(page: list[int], owner: dict[int, tuple[int, int]], sizes: list[int]) -> set[tuple[int, int]]:
    """(class, place): where classes must be cut to be ordered and nested on a page. owner: class and place of a token; classes
    are numbered from the least to the greatest.

    A class is ordered if its tokens come as first, second, ..., last, once for every occurrence, before any comes again. Two
    classes are nested if neither has a token between two tokens of an occurrence that reaches beyond it; of two that cross,
    the lesser is cut there. Pieces of what is ordered and nested are so, too, so cuts of all pages add up.
    """
    events = [(at, *owner[t]) for at, t in enumerate(page) if t in owner]
    places: dict[int, list[list[int]]] = {}
    for at, c, i in events:
        places.setdefault(c, [[] for _ in range(sizes[c])])[i].append(at)
    cuts: set[tuple[int, int]] = set()
    begins: dict[int, list[int]] = {}
    for c, of in places.items():
        start, begin = 0, [0]
        for i in range(1, sizes[c]):
            in_turn = all(x < y for x, y in zip(of[i - 1], of[i], strict=False)) and all(y < x for x, y in zip(of[start][1:], of[i], strict=False))
            if not in_turn:
                cuts.add((c, i))
                start = i
            begin.append(start)
        begins[c] = begin
    opened: list[list[int]] = []  # class, start of its piece, last place seen
    for _, c, i in events:
        begin = begins[c][i]
        at = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][:2] == [c, begin]), None) if i > begin else None
        if at is not None:
            for other in opened[at + 1 :]:
                cuts.add((other[0], other[2] + 1) if other[0] < c else (c, i))
            opened[at + 1 :] = [x for x in opened[at + 1 :] if x[0] >= c]
            del opened[at]
        if i + 1 < sizes[c] and begins[c][i + 1] == begin:
            # a piece that went on stays where it was opened; one that was cut, or has just begun, lies within all others
            opened.insert(len(opened) if at is None or (c, i) in cuts else at, [c, begin, i])
    return cuts


def pieces(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Classes cut where a page shows them out of order or crossing a greater class (see faults), so that all of them are ordered
    and nested. Pages send the places of cuts, which are distinct on the map side."""
    known = F.sort_array(F.collect_list(F.struct("pages", F.size("tokens").alias("size"), "vector", "tokens")))
    held = stored(found.where(F.size("tokens") > 1).groupBy("host").agg(known.alias("classes")), "held-classes")
    placed = pages.join(sized(held), "host").select("host", "html", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: dict[str, tuple] = {}
            out: set[tuple] = set()
            for host, page, classes_ in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("classes"), strict=True):
                if host not in owners:
                    of = classes_.as_py()
                    owners[host] = of, {t: (c, i) for c, x in enumerate(of) for i, t in enumerate(x["tokens"])}, [x["size"] for x in of]
                of, owner, sizes = owners[host]
                out.update((host, of[c]["pages"], of[c]["vector"], i) for c, i in faults(sequence(page.as_py()), owner, sizes))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=["host", "pages", "vector", "cut"])

    cuts = placed.mapInArrow(run, "host string, pages bigint, vector bigint, cut int").distinct().groupBy("host", "pages", "vector").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    got = found.join(sized(stored(cuts, "cuts")), ["host", "pages", "vector"], "left")
    ends = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("tokens")))
    parts = F.transform(F.sequence(F.lit(0), F.size("ends") - 2), lambda k: F.slice("tokens", F.get("ends", k) + 1, F.get("ends", k + 1) - F.get("ends", k)))
    return got.withColumn("ends", ends).withColumn("tokens", F.explode(parts)).drop("ends", "cuts")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's valid classes: the classes of CLASS_SHARE of the host's different pages or
    more, and those of CLASS_PAGES or more that have CLASS_SIZE tokens, such as a box that some pages have. Valid classes are
    ordered and nested on every page; one that isn't is cut into pieces that are, and its pieces are held to the same sizes.

    Pages without tokens don't count, so a page without the frame, or an empty one, takes no host's template away. A host with
    too few pages, or too few such tokens, has no template. All tokens of a class stand on one page, so a class is no larger
    than a page.
    """
    found = stored(classes(pages), "classes")
    n_pages = found.where(F.array_contains("tokens", F.lit(PAGE_TOKEN))).select("host", F.col("pages").alias("all")).where(F.col("all") >= CLASS_PAGES)
    found = found.join(sized(stored(n_pages, "hosts")), "host").withColumn("tokens", F.array_remove("tokens", PAGE_TOKEN))
    large = (F.col("pages") >= CLASS_SHARE * F.col("all")) | ((F.col("pages") >= CLASS_PAGES) & (F.size("tokens") >= CLASS_SIZE))
    valid = pieces(pages, stored(found.where(large & (F.size("tokens") > 0)), "large-classes")).where(large)
    return valid.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("template")).where(F.size("template") >= CLASS_SIZE)


def choose(blocks: list[Block], template: set[int]) -> list[str]:
    """The texts of the slots in marked regions (article, main, named as content), together; of all slots if those outside hold
    more text. A text that every page of a host has inside an article element is what its articles say (a host may hold one
    article many times), so template isn't dropped there."""
    slots = [b for b in blocks if b.article == 3 or not template or text_token(b) not in template]
    marked = [b for b in slots if b.article]
    if 2 * sum(len(b.text) for b in marked) < sum(len(b.text) for b in slots):
        marked = slots
    return [b.text for b in marked]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text, n_chars, host.

    1. Pages are cut into tokens; tokens with one occurrence vector over a host's pages are an equivalence class.
    2. The valid classes, ordered and nested on every page, are the host's template; the rest is slots.
    3. Slots inside elements that mark menus, headers, footers, sidebars, notices, adverts, forms or reader comments are left
       out. Slots in an article, main or an element named as content are taken, unless the slots outside hold more text: then all.
    Character references are decoded, white space inside a block becomes one space, blocks are joined by a blank line.

    A null or empty page gives an empty text; a null url has the host '' and stays null. Copies of a page count once in the
    vectors. Repeated rows stay. No rows give no rows; other columns are not read. Counting combines on the map side, so a
    host may hold any share of the pages.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    # one copy of each page of a host: the smallest id that has it
    first = rows.select("host", F.xxhash64("html").alias("page"), "id").where("id IS NOT NULL").groupBy("host", "page").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("host", "page", "first")
    copied = stored(first, "copied-pages")
    lone = rows.select("id", "host", F.xxhash64("html").alias("page"), "html").where("html IS NOT NULL AND id IS NOT NULL").join(sized(copied), ["host", "page"], "left").where("first IS NULL OR first = id").select("host", "page", "html")
    found = stored(templates(lone), "templates")
    placed = rows.join(sized(found), "host", "left").select("id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                known: dict[str, set[int]] = {}
                for page, host, template in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), part.column("template"), strict=True):
                    if host not in known:
                        known[host] = set(template.as_py() or ())
                    texts.append("\n\n".join(choose(scan(page or "")[1], known[host])))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), part.column("host")], names=[id_col, "url", "text", "n_chars", "host"])

    return placed.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint, host string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
