"""Main text of pages by templates deduced from equivalence classes of tokens.

The tokens of a page are the opening tags of its containers, each with the path of containers around it,
and its text blocks, with their path. The occurrence vector of a token over the pages of a host is kept
as a count of pages and a sum of hashes of (page, occurrences), which partial sums add up however many
pages a host has. Tokens with one vector form an equivalence class. A class is valid if it holds container
tags and occurs in several different pages and half of those of its host. Text blocks in a valid class belong
to the template, whatever place they have. Classes are neither ordered nor nested: the main text is not a gap
between their tokens, but the text in the articles of a page, or else the innermost container around all other
text of the host's pages that is no link and more than a short line alone in its container. Menus, headers,
footers, side bars, forms, adverts and comments are known by the containers they lie in.
"""

from __future__ import annotations

import hashlib
import html as references
import pickle
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, task_count
from . import blocks as B

#: A template text stands on so many different pages at least, and on this share of its host's.
LEAST_PAGES, LEAST_SHARE = 4, 0.5
#: Template files that a task holds at a time, pages judged at a time.
HELD, ROWS = 64, 500
#: A line of so many words and letters at most that is alone in its container may stay outside the slot.
LINE_WORDS, LINE_LETTERS = 3, 16

# fixed values: HTML's elements by their use, and common names of containers without main text
CONTAINERS = frozenset("html head body main article section div nav header footer aside form table ul ol dl "
                       "menu dialog fieldset details figure blockquote".split())
SKIPPED = frozenset("script style noscript template iframe svg canvas object select textarea button head "
                    "title annotation".split())
BOILERPLATE = frozenset("nav header footer aside menu head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img math semantics mrow mi mo mn ms mtext mspace "
                   "mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover annotation".split())
WHOLE = frozenset("ul ol dl menu table blockquote figure details".split())
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = re.compile(  # a whole word of a class, an id or a role
    r"(?:(?:site|page|main|left|right|top|bottom|primary|secondary|global|user)[_-])?"
    r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|sidebar\w*|side|widgets?|nav(?:bar|igation)?|menus?|"
    r"breadcrumbs?|header|footer|masthead|copyright|comments?|disqus|reply|replies|respond|cookies?|consent|"
    r"gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|shar(?:e|ing)|socials?|"
    r"related|recommend(?:ed|ations?)|pagination|pager|toolbar|skip)"
    r"(?:[_-](?:left|right|top|bottom|primary|secondary|list|box|bar|area|container|wrap|wrapper|inner|block|section|"
    r"banner|links?|nav|menu|posts?|articles?|buttons?|\d+))*", re.I)
COMMENTS = re.compile(  # of containers that hold what readers say, however much of a page that is
    r"(?:(?:user|reader|post|article|page)s?[_-])?(?:comments|discussions?|repl(?:y|ies)|disqus|respond)"
    r"(?:[_-](?:list|area|box|section|thread|wrap|wrapper|container))*|comments?(?:[_-](?:list|area|box|section|thread|"
    r"wrap|wrapper|container|form|body|text))+", re.I)
ANSWERS = re.compile(r"(?:comments?|repl(?:y|ies)|teasers?)(?:[_-](?:list|box|item|body|\d+))*", re.I)
#: Elements that are boilerplate unless most of a page stands in them, as containers with such names are.
LIKELY = frozenset("form dialog fieldset".split())

# a tag ends at the first > outside quoted values; elements whose body is no markup are one token up to their own end tag
_VALUES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe)(?=[\s/>]){_VALUES}(?<!/)>.*?"
    rf"(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<[a-zA-Z/!?]{_VALUES}(?:>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(.*?)>?\Z", re.S)
_HINT = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: What page-specific words hold, and what divides the parts of a path.
_OWN = re.compile(r"[\d.#!?\x00\x01]")


class Block:
    """A text block: containers around it, text, length of its linked part, whether a headline."""

    __slots__ = ("path", "text", "linked", "headline")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, headline: bool = False) -> None:
        self.path, self.text, self.linked, self.headline = path, text, linked, headline


def _step(name: str, rest: str) -> str:
    """Element, words of class and role, and id of a container, without words that hold digits; ``!`` marks one without main text or with comments, ``?`` one that its name says so of.
    Wrappers of a whole page never are, and they and articles have no hints."""
    hints: dict[str, list[str]] = {"class": [], "id": [], "role": []}
    for m in _HINT.finditer(rest):
        hints[m[1].lower()] += (m[2] or m[3] or m[4] or "").lower().split()
    names = ANSWERS if name == "article" else NAMES
    if "main" in hints["role"]:
        name = "main"
    page = name in ("html", "body", "main")
    named = not page and any(names.fullmatch(w) for words in hints.values() for w in words)
    said = not page and name != "article" and any(COMMENTS.fullmatch(w) for w in hints["class"] + hints["id"])
    mark = "!" if name in BOILERPLATE or said else "?" if named or name in LIKELY else ""
    if page or name == "article":
        return mark + name
    kinds = sorted({w for w in hints["class"] + hints["role"] if not _OWN.search(w)})
    ids = [w for w in hints["id"] if not _OWN.search(w)]
    return f"{mark}{name}" + (f".{' '.join(kinds)}" if kinds else "") + (f"#{' '.join(ids)}" if ids else "")


def _plain(path: tuple[str, ...]) -> str:
    """Path of a token: without ids, which may be those of one page."""
    return "\x01".join(s.partition("#")[0] for s in path)


def parse(page: str | None) -> tuple[list[Block], list[tuple[str, ...]]]:
    """Text blocks in page order, and the path of each container that opens."""
    found: list[Block] = []
    opened: list[tuple[str, ...]] = []
    path: list[tuple[str, str]] = []
    steps: tuple[str, ...] = ()
    text: list[str] = []
    linked = links = 0
    skipping, headline = "", False

    def close_block() -> None:
        nonlocal linked
        whole = " ".join(references.unescape("".join(text)).split())
        if whole:
            found.append(Block(steps, whole, linked, headline))
        text.clear()
        linked = 0

    page, at = page or "", 0
    for found_token in _TOKEN.finditer(page):
        token, between, at = found_token[0], page[at:found_token.start()], found_token.end()
        if between and not skipping:
            text.append(between)
            linked += len(between) if links else 0
        if token.startswith("<!--"):
            continue
        if found_token[1]:
            if not skipping:
                close_block()
            continue
        m = _TAG.match(token)
        if not m:
            continue
        shut, name, rest = bool(m[1]), m[2].lower(), m[3]
        if skipping:
            if shut and name == skipping:
                skipping = ""
            continue
        if name in SKIPPED and name != "head":
            if not shut and not rest.rstrip().endswith("/"):
                if name not in INLINE:
                    close_block()
                skipping = name
            continue
        if name == "a":
            links = 0 if shut else 1
        if name in INLINE:
            continue
        close_block()
        headline = not shut and name in HEADLINES or headline and name in VOID
        if name in VOID or name not in CONTAINERS and name != "head":
            continue
        if shut:
            if any(n == name for n, _ in path):
                while path.pop()[0] != name:
                    pass
                links = 0
        else:
            path.append((name, _step(name, rest)))
        steps = tuple(s for _, s in path)
        if not shut:
            opened.append(steps)
    if not skipping:
        text.append(page[at:])
        linked += len(page) - at if links else 0
    close_block()
    return found, opened


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "little", signed=True)


def _is_article(path: tuple[str, ...]) -> bool:
    return any(re.match(r"(?:article|main)(?:\.|$)", s) for s in path)


def _is_boilerplate(path: tuple[str, ...]) -> bool:
    """A marked container, but not the header of an article that holds its headline."""
    return any(s.startswith("!") and not (s.startswith("!header") and _is_article(path[:i])) for i, s in enumerate(path))


def _content(blocks: list[Block]) -> list[Block]:
    """Blocks outside boilerplate. A name is no more than a hint: what holds most of a page's unlinked text is none."""
    blocks = [b for b in blocks if not _is_boilerplate(b.path)]
    below: Counter = Counter()
    for b in blocks:
        for i, step in enumerate(b.path):
            if step.startswith("?"):
                below[b.path[:i + 1]] += max(0, len(b.text) - b.linked)
    if not below:
        return blocks
    half = sum(max(0, len(b.text) - b.linked) for b in blocks) / 2
    return [b for b in blocks if not any(s.startswith("?") and below[b.path[:i + 1]] <= half for i, s in enumerate(b.path))]


def _element(step: str) -> str:
    return re.split(r"[.#]", step.lstrip("!?"))[0]


def _weights(blocks: list[Block]) -> list[int]:
    """Unlinked letters of each block; none for a short line alone in its container, as a badge is.

    Headlines, entries of lists and tables, and text that stands in the body itself always count.
    """
    beside = Counter(b.path for b in blocks)

    def alone(b: Block) -> bool:
        return (not b.headline and beside[b.path] == 1 and len(b.text) <= LINE_LETTERS
                and len(b.text.split()) <= LINE_WORDS and _element(b.path[-1] if b.path else "body") not in ("html", "body")
                and not any(_element(s) in WHOLE for s in b.path))

    return [0 if alone(b) else max(0, len(b.text) - b.linked) for b in blocks]


def _common(first: tuple[str, ...], last: tuple[str, ...]) -> tuple[str, ...]:
    """Innermost container around both paths, not inside a list, table or quote."""
    n = 0
    while n < min(len(first), len(last)) and first[n] == last[n] and _element(first[n]) not in WHOLE:
        n += 1
    return first[:n]


def _slot(paths: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The innermost container around all these paths, if there are any."""
    return [_common(min(paths), max(paths))] if paths else []


def _tokens(page: str | None) -> tuple[int, list[tuple[int, bool, str | None, int, int, int]]]:
    """Key of a page by its text, and of each token key, whether a tag, path, weight, weight of the page, occurrences.

    Markup, comments, scripts and boilerplate are not part of the key. Weight is that of text in articles, if there are
    any. The path is that of text that counts in a page without articles.
    """
    blocks, opened = parse(page)
    out: dict[int, list] = {}
    for path in opened:
        out.setdefault(_key("t", _plain(path)), [True, None, 0, 0])[3] += 1
    blocks = _content(blocks)
    articles = any(_is_article(b.path) for b in blocks)
    weights = [w if not articles or _is_article(b.path) else 0 for b, w in zip(blocks, _weights(blocks))]
    paths: dict[int, list[tuple[str, ...]]] = {}
    for b, weight in zip(blocks, weights):
        key = _key("x", _plain(b.path), b.text)
        row = out.setdefault(key, [False, None, 0, 0])
        row[2] += weight
        row[3] += 1
        if weight and not articles:
            paths.setdefault(key, []).append(b.path)
    for key, held in paths.items():
        out[key][1] = "\x01".join(_slot(held)[0])
    whole = sum(weights)
    return _key(*(b.text for b in blocks)), [(k, tag, path, w, whole, n) for k, (tag, path, w, n) in out.items()]


def classes_of(pages: DataFrame) -> DataFrame:
    """``host, token, pages, chars, around, low, high``: the texts in valid classes, and a row of token 0 a host for all
    others. ``low`` and ``high`` are the least and greatest path, whose common part is that of all paths between.

    A text in a valid class stands on LEAST_SHARE of its host's pages, so a host has no more rows than some pages have
    texts, whatever ids and names its pages have.
    """
    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for host, page in zip(f["host"], f["html"]):
                key, found = _tokens(page)
                rows += [(host, key, *t) for t in found]
            yield pd.DataFrame(rows, columns=["host", "page", "token", "tag", "path", "chars", "around", "n"])

    seen = pages.mapInPandas(tokens, "host string, page long, token long, tag boolean, path string, chars long, "
                                     "around long, n long")
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    # a page may come many times: the same vector entry, so one row per (token, page)
    entries = seen.groupBy("host", "token", "page").agg(
        F.first("tag").alias("tag"), F.min("path").alias("low"), F.max("path").alias("high"),
        F.max("chars").alias("chars"), F.max("around").alias("around"), F.max("n").alias("n"))
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)"))
    classes = entries.groupBy("host", "token").agg(
        F.first("tag").alias("tag"), *ends, F.sum("chars").alias("chars"), F.sum("around").alias("around"),
        F.count(F.lit(1)).alias("pages"), vector.cast("string").alias("vector"))
    # tokens of few pages can be no template: only their greatest number of pages and ends of paths go on
    classes = cut_lineage(
        classes.withColumn("rare", F.col("pages") < LEAST_PAGES)
        .withColumn("token", F.when(F.col("rare"), 0).otherwise(F.col("token")))
        .withColumn("vector", F.when(~F.col("rare"), F.col("vector")))
        .groupBy("host", "tag", "token", "vector")
        .agg(*ends, F.sum("chars").alias("chars"), F.sum("around").alias("around"), F.max("pages").alias("pages")),
        "classes")
    tags = classes.filter("tag")
    totals = tags.groupBy("host").agg(F.max("pages").alias("total"))
    valid = (tags.filter("vector is not null").select("host", "vector", "pages").distinct().join(totals, "host")
             .filter(F.col("pages") >= LEAST_SHARE * F.col("total")).select("host", "vector", F.lit(True).alias("valid")))
    return (classes.filter("not tag").join(valid, ["host", "vector"], "left")
            .withColumn("token", F.when(F.col("valid"), F.col("token")).otherwise(0))
            .groupBy("host", "token")
            .agg(F.max("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("around").alias("around"), *ends))


def deduce(pages: DataFrame, home: str, files: int) -> DataFrame:
    """Template files of all hosts: keys of template texts, main slots. ``pages``: host, html.

    Pages of a host with equal text count once, so that copies of one article do not look like a template. Nor do near
    copies: texts of one set of pages that are most of the text of those pages are none.
    """
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        templates = {}
        for host, texts in rows.groupby("host"):
            fixed = texts["token"] != 0
            of_set = texts[fixed].groupby(["pages", "around"])["chars"].transform("sum")  # one set of pages, one sum around
            fixed &= 2 * of_set.reindex(texts.index, fill_value=0) <= texts["around"]
            ends = texts.loc[~fixed, ["low", "high"]].to_numpy().ravel()
            slot = _slot([tuple(p.split("\x01")) if p else () for p in ends if isinstance(p, str)])
            templates[host] = (frozenset(int(t) for t in texts.loc[fixed, "token"]), slot)
        uri = f"{home}/{int(rows['file'].iloc[0]):05d}"
        B.put(uri, pickle.dumps(templates))
        return pd.DataFrame({"uri": [uri]})

    return (classes_of(pages).withColumn("file", F.pmod(F.xxhash64("host"), F.lit(files)).cast("int"))
            .groupBy("file").applyInPandas(write, "uri string"))


def main_text(page: str | None, template: tuple[frozenset, list]) -> str:
    """Blocks of the articles, or else of the main slots, without template texts, joined by one space."""
    fixed, slots = template
    blocks = _content(parse(page)[0])
    own = [b for b in blocks if _is_article(b.path)]
    own = own or [b for b in blocks if any(b.path[:len(s)] == s for s in slots)]
    if not own:  # a page of another build than its host's
        slots = _slot([b.path for b, weight in zip(blocks, _weights(blocks)) if weight]) or [()]
        own = [b for b in blocks if any(b.path[:len(s)] == s for s in slots)]
    return " ".join(b.text for b in own if _key("x", _plain(b.path), b.text) not in fixed)


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page.

    Null or empty pages have an empty text. Pages without a URL, or with one that has no host, are taken as
    of one host. Markup that is cut off at the end of a page ends there. Repeated rows give repeated rows; equal
    pages count once for the template. Other columns are ignored.
    """
    spark = pages.sparkSession
    B.bounded_batches(spark)
    home, files = B.folder(spark, "templates"), task_count(spark)
    host = F.pandas_udf(lambda urls: urls.map(lambda u: host_of(u if isinstance(u, str) else None)), "string")
    rows = pages.select(B.numbered(id_column).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).withColumn("host", host("url"))
    deduce(rows.select("host", "html"), home, files).count()
    held: OrderedDict[int, dict] = OrderedDict()

    def template_of(host: str, file: int) -> tuple[frozenset, list]:
        if file not in held:
            try:
                held[file] = pickle.loads(B.get(f"{home}/{file:05d}"))
            except FileNotFoundError:
                held[file] = {}
            if len(held) > HELD:
                held.popitem(last=False)
        return held[file].get(host, (frozenset(), []))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                part = f.iloc[at:at + ROWS]
                text = [main_text(p, template_of(h, n)) for p, h, n in zip(part["html"], part["host"], part["file"])]
                yield part[["page_id", "url"]].assign(text=text)

    placed = rows.withColumn("file", F.pmod(F.xxhash64("host"), F.lit(files)).cast("int"))
    return placed.mapInPandas(judge, "page_id long, url string, text string").withColumn(
        "page_id", B.renamed("page_id"))
