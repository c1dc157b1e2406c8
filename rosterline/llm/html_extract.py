"""Main text of web pages by equivalence-class template deduction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
#: elements whose content is no text of the page
SKIPPED = frozenset("script style title textarea noscript iframe template svg select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: elements that end tags of other elements do not close
WALL = frozenset("article main nav aside header footer form body html table".split())
STRUCTURE = WALL | frozenset("div section ul ol dl li td th tr tbody thead tfoot blockquote figure fieldset details".split())
#: elements that a start tag of the same group closes
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol dl table menu".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: words of class, id or role that mark parts beside the article
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments disqus respond replies reply social share sharing related recommended widget toolbar pagination pager "
    "search copyright complementary contentinfo banner".split())
#: the same, but inside an article they may hold its title
HEAD_WORDS = frozenset("header masthead topbar".split())
#: classes and ids that mark adverts and reader comments inside articles too, whatever the template says
PLAIN_WORDS = frozenset("ad ads advert adverts advertisement sponsored comments disqus replies respond".split())
#: share of a host's pages on which a token of its template stands, and pages it needs
FREQUENT, PAGES = 0.5, 3


class Block(NamedTuple):
    path: str
    region: str
    noise: bool
    text: str
    linked: int
    #: elements inside the article that hold the block and whose names hint at noise: key, and whether the names leave little doubt
    hints: tuple[tuple[str, bool], ...] = ()


class Element:
    __slots__ = ("tag", "path", "region", "noise", "hints")

    def __init__(self, tag: str, path: str, region: str, noise: bool, hints: tuple = ()):
        self.tag, self.path, self.region, self.noise, self.hints = tag, path, region, noise, hints


def read_page(page: str | None) -> tuple[list[Block], Counter]:
    """Text blocks in page order, and how often each element path occurs.

    A path names the open block elements with their classes (those of the page
    itself, ``html`` and ``body``, left out).  Unclosed and
    stray tags are repaired: paragraphs end where the next block starts, list
    items and cells where the next one does, and an end tag reaches its start
    tag only within the nearest section.
    """
    page = page or ""
    stack = [Element("", "", "", False)]
    blocks: list[Block] = []
    seen: Counter = Counter()
    buffer: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                top = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
                blocks.append(Block(top.path, top.region, stack[-1].noise, text, linked, stack[-1].hints))
            buffer.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            buffer.append(text)
            if in_link:
                linked += len(text)

    def close(names, walls):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    while True:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
                close({name}, (WALL if name in STRUCTURE else STRUCTURE) - {name})
            elif name == "a":
                in_link = False
            elif name not in VOID:
                close({name}, BLOCK)
            continue
        if name in SKIPPED:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                buffer.append(" ")
            continue
        if name == "a":
            in_link = True
        if name in BLOCK:
            flush()
            in_link = in_link and name not in STRUCTURE
            close({"p"}, STRUCTURE)
            if name in SIBLINGS:
                close(SIBLINGS[name], LISTS | WALL)
            if re.fullmatch("h[1-6]", name):
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, STRUCTURE)
        parent = stack[-1]
        attrs: dict[str, str] = {}
        for key, value in ATTRIBUTE.findall(m[3] or m[6] or ""):
            attrs.setdefault(key.lower(), value.strip("\"'"))
        region, noise = parent.region, parent.noise or marks_noise(name, attrs, bool(parent.region))
        path, hints = parent.path, parent.hints
        if name in BLOCK:
            classes = "" if name in ("html", "body") else re.sub(r"\d+", "#", ".".join(attrs.get("class", "").split()))
            path = f"{path}>{name}{'.' + classes if classes else ''}"
            seen[path] += 1
            if not noise and (name in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"):
                region = path
        if parent.region and attrs and not noise and (doubt := hints_noise(attrs)) is not None:
            key = f"{path}>{name}.{attrs.get('class', '')}#{attrs.get('id', '')}"
            hints = (*hints, (re.sub(r"\d+", "#", key), not doubt))
        if not (m[3] or m[6] or "").endswith("/") or name in BLOCK:
            stack.append(Element(name, path, region, noise, hints))
    flush()
    return blocks, seen


def words_of(text: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", text.lower())) - {""}


def marks_noise(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element lies beside the article by its kind, or is hidden; outside articles also by its class, id or role."""
    if name in NOISE_TAGS or name == "header" and not inside:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    words = words_of(" ".join(attrs.get(k, "") for k in ("class", "id", "role")))
    if name == "article":
        return bool(words & {"comment", "comments"})
    if name in ("body", "html", "main"):
        return False
    if inside:
        return bool(PLAIN_WORDS & {*attrs.get("class", "").lower().split(), attrs.get("id", "").lower()})
    return bool(words & NOISE_WORDS or words & HEAD_WORDS)


def hints_noise(attrs: dict[str, str]) -> bool | None:
    """Whether the names of an element inside an article hint at noise: None if not, else whether other words leave doubt.

    Headings have ids and prose has classes of their own ("related work"), so
    a word alone decides nothing: the host's template does, or, where a host
    has too few pages for one, names in which every class tells.
    """
    classes = attrs.get("class", "").lower().split()
    names, role = words_of(attrs.get("id", "")), words_of(attrs.get("role", ""))
    if not (words_of(" ".join(classes)) | names | role) & NOISE_WORDS:
        return None
    return not (bool(classes) and all(words_of(c) & NOISE_WORDS for c in classes) or bool(names) and names <= NOISE_WORDS or bool(role & NOISE_WORDS))


def host_of(url: str = "url"):
    """Host of an address, lower-cased; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def page_tokens(pages: DataFrame) -> DataFrame:
    """Tokens of each page with their count: element paths, and the first occurrence of each text under its path.

    ``article`` marks paths that are an article element.  Texts inside articles are tokens like others.
    The empty path stands once for every page; paths after an ``@`` are elements inside articles whose names hint at noise.
    """

    def run(batches):
        for b in batches:
            out = []
            for host, page in zip(b.column("host").to_pylist(), b.column("html")):
                blocks, seen = read_page(page.as_py())
                chars, linked, texts = Counter(), Counter(), Counter()
                for x in blocks:
                    if not x.noise:
                        chars[x.path] += len(x.text)
                        linked[x.path] += min(x.linked, len(x.text))
                        texts[(x.path, x.text)] += len(x.text)
                articles = {x.region for x in blocks if x.region}
                key = hash_page(blocks)
                out.append((host, "", None, 1, key, 0, 0, False))
                for path, n in seen.items():
                    out.append((host, path, None, n, key, chars[path], linked[path], path in articles))
                for hint in {k for x in blocks if not x.noise for k, _ in x.hints}:
                    out.append((host, "@" + hint, None, 1, key, 0, 0, False))
                for (path, text), n in texts.items():
                    out.append((host, path, hash_text(text), 1, key, n, 0, False))
            if out:
                names = ["host", "path", "text", "n", "page", "chars", "linked", "article"]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return pages.select("host", "html").mapInArrow(
        run, "host string, path string, text long, n long, page long, chars long, linked long, article boolean")


def hash_text(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def hash_page(blocks: list[Block]) -> int:
    """Hash of what a page says beside its noise; equal for copies whose scripts, adverts or menus differ."""
    kept = [b for b in blocks if not b.noise]
    kept = [b for b in kept if not b.hints] or kept
    return hash_text("\0".join(f"{b.path}\0{b.text}" for b in kept))


def templates(pages: DataFrame) -> DataFrame:
    """Template of each host: ``region`` (path of the slot that holds the article, or null), ``fixed`` (texts of the template, hashed)
    and ``frames`` (elements of the template inside articles whose names hint at noise; null where the host has too few pages).

    The occurrence vector of a token says how often it stands on each page of
    its host.  It is never built: a token carries the number of its pages and
    an exclusive-or of hashes of (page, count), so tokens of equal vectors
    meet as an equivalence class although no task holds a host's pages.  Valid
    classes are frequent (half of the host's pages, three at least).  Texts of
    valid classes belong to the template, inside articles too.  Classes of
    element paths nest by their paths; of the paths that stand once on each of
    their pages and hold most of the text that changes, the slot of the
    article is an article element if there is one, else the innermost.

    Elements with telling names are the template's if three pages have them: an
    advert's text changes and it need not stand on half of the pages, but prose
    does not repeat the names of its elements from page to page.

    Copies of a page say nothing about the template: pages of equal content
    count once per host.
    """
    tokens = page_tokens(pages).groupBy("host", "path", "text", "page").agg(*[F.min(c).alias(c) for c in ("n", "chars", "linked", "article")])
    vector = [F.count("*").alias("pages"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
              F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("article").alias("article")]
    counted = settle(
        tokens.groupBy("host", "path", "text").agg(*vector).withColumn("is_text", F.col("text").isNotNull())
        .filter((F.col("pages") >= PAGES) | (F.col("path") == "") & ~F.col("is_text")), "html-tokens")
    whole = (F.col("path") == "") & ~F.col("is_text")
    total = counted.filter(whole).select("host", F.col("pages").alias("host_pages"))
    hint = F.col("path").startswith("@")
    frequent = counted.filter(~whole & ~hint).join(total, "host").filter(F.col("pages") >= FREQUENT * F.col("host_pages"))
    # equivalence classes: tokens of one vector; a class of a path that stands once per page can hold slots
    classes = frequent.groupBy("host", "vector", "pages").agg(F.count("*").alias("size"))
    valid = frequent.join(classes, ["host", "vector", "pages"]).filter("size >= 2")
    holders = valid.filter("not is_text and n = pages").select("host", F.col("path").alias("holder"), "article")
    # text that changes: that of a path without its template texts
    same = valid.filter("is_text").groupBy("host", "path").agg(F.sum("chars").alias("same"))
    slots = (
        frequent.filter("not is_text and chars > 0 and linked < 0.5 * chars").join(same, ["host", "path"], "left")
        .select("host", "path", (F.col("chars") - F.coalesce("same", F.lit(0))).alias("chars")).filter("chars > 0")
    )
    # text of a path counts for the path and all above it; paths are short lists
    parts = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ">"))
    volume = slots.withColumn("holder", F.explode(above)).groupBy("host", "holder").agg(F.sum("chars").alias("chars"))
    all_text = slots.groupBy("host").agg(F.sum("chars").alias("all_chars"))
    region = (
        volume.join(holders, ["host", "holder"]).join(all_text, "host").filter("chars >= 0.6 * all_chars")
        .groupBy("host").agg(F.max(F.struct("article", F.size(F.split("holder", ">")), "holder")).getField("holder").alias("region"))
    )
    fixed = valid.filter("is_text").groupBy("host").agg(F.collect_set("text").alias("fixed"))
    frames = counted.filter(hint).groupBy("host").agg(F.collect_set(F.substring("path", 2, 1 << 30)).alias("frames"))
    none = F.array().cast("array<string>")
    found = total.join(region, "host", "left").join(fixed, "host", "left").join(frames, "host", "left")
    return settle(
        found.select("host", "region", "fixed", F.when(F.col("host_pages") >= PAGES, F.coalesce("frames", none)).alias("frames")), "html-templates")


def main_text(blocks: list[Block], region: str | None, fixed: set[int], hash_text, frames: set[str] | None = None) -> str:
    """Slots of a page that remain: the host's slot, without template texts or noise.

    A page that lacks the slot, or a host without one, falls back to the
    article element of the page, then to all its text that is not mostly
    links; template texts are left out there too.  Elements inside the article
    whose names hint at noise go if they are the template's (``frames``); without
    a template, if their names leave little doubt.
    """
    blocks = [b for b in blocks if not any(sure if frames is None else key in frames for key, sure in b.hints)]
    chars, linked = Counter(), Counter()
    for b in blocks:
        if not b.noise:
            chars[b.path] += len(b.text)
            linked[b.path] += min(b.linked, len(b.text))
    clean = [b for b in blocks if not b.noise and (b.region or linked[b.path] < 0.5 * chars[b.path])]
    held = [b for b in clean if region and (b.path == region or b.path.startswith(region + ">"))]
    held = held or [b for b in clean if b.region] or clean
    return "\n".join(b.text for b in held if hash_text(b.text) not in fixed)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one line feed.  Null and empty pages give an
    empty text.  Pages without a host share no template and are read by
    themselves.  Repeated rows give equal results; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))
    known = templates(rows.filter("host is not null"))
    # small template tables are broadcast by their size on disk, others are joined by shuffle
    joined = rows.join(known, "host", "left")

    def run(batches):
        for b in batches:
            texts = []
            rules = (b.column(c).to_pylist() for c in ("region", "fixed", "frames"))
            for page, region, fixed, frames in zip(b.column("html"), *rules):
                texts.append(main_text(
                    read_page(page.as_py())[0], region, set(fixed or ()), hash_text, None if frames is None else set(frames)))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "region", "fixed", "frames").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
