"""Main text of web pages with site-template removal.

A tolerant tokenizer builds the element nesting of a page. Elements that are never
article text (scripts, menus, footers, forms, and boxes whose class or id says
so; inside an article only by whole names that are certain) are left out. Every
other container's subtree is hashed; the hashes are counted per host in Spark, and
subtrees that recur on many pages of the host are deleted when the page is read the
second time. A subtree's hash is that of all its blocks in both readings, so of
nested ones the outermost goes whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: A subtree is a template if at least this many pages of different text of the host hold it,
#: and at least the root of the number of those pages: a share that falls with the host's size.
MIN_PAGES = 5

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "object", "select", "xmp", "noembed", "noframes"}
NEVER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "audio", "video", "canvas", "fieldset"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {"html", "body", "article", "main", "section", "div", "header", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
         "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption",
         "address", "details", "summary", "center", "hgroup", "search"} | NEVER
ROOTS = {"article", "main"}
#: What opening a tag closes, if it stands inside the same container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "tbody": {"tr", "td", "th", "p"}, "tfoot": {"tr", "td", "th", "p"}}
#: Containers whose recurrence counts; inside an article, paragraphs and headings never do.
OUTSIDE = BLOCK - ROOTS - {"html", "body"}
INSIDE = {"div", "section", "ul", "ol", "dl", "table", "figure", "header", "address", "details"}
#: Words of a class or id that name something other than the article, outside of it; the
#: second list's only if they are the whole name, as they are also parts of names of content.
BOX = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|"
    r"navbar|nav|navigation|breadcrumbs?|pagination|pager|footer|masthead|site-header|page-header|comments?|commentlist|disqus)(?=$|[\s_-])|"
    r"(?:^|(?<=\s))(?:notice|notification|alert|overlay|signup|login|widget|menu|header|toolbar|share|sharing|social|related|recommended|"
    r"replies|respond)(?=$|\s)", re.I)
#: Whole classes or ids that name such a box for certain, also inside an article.
SURE = re.compile(
    r"(?:^|(?<=\s))(?:ads?|adsbygoogle|ad[_-]?(?:box|slot|unit|banner|container|wrapper|inline|block|space|break)|(?:inline|banner|text)[_-]ads?|"
    r"advert(?:s|isements?|ising)?(?:[_-][\w-]+)?|sponsored(?:[_-](?:content|posts?|links?|box))?|"
    r"promos?(?:[_-](?:box|banner|block|bar|card|unit))?|notices?|(?:site|legal|privacy|subscription|paywall)[_-](?:notice|banner|message)|"
    r"(?:cookie|cookies|consent|gdpr)[_-](?:notice|banner|bar|box|popup|message)|newsletter|newsletter[_-](?:box|form|signup)|popup|modal|"
    r"sidebar(?:[_-][\w-]*)?|side-bar|(?:left|right|site|page|main)[_-]sidebar|widget[_-]area|(?:main|top|site)[_-]menu|navbar|navigation|"
    r"breadcrumbs?|pagination|pager|site[_-](?:nav|navigation|header|footer)|"
    r"social[_-](?:share|sharing|links|icons|buttons|media)|share[_-](?:buttons?|bar|box|links|icons)|sharedaddy|"
    r"(?:related|recommended)[_-](?:posts?|articles?|stories|links)|comments|(?:user|reader|visitor)[_-]comments?|"
    r"comments?[_-]?list|comments?[_-](?:area|section|thread|box|wrapper|container)|disqus(?:_thread)?|replies|respond)"
    r"(?=$|\s)", re.I)
#: An article of this class is a reader's, not the page's.
COMMENT = re.compile(r"(?:^|(?<=\s))(?:(?:user|reader)-)?comments?(?:-\d+|-body)?(?=$|\s)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Quotes count behind an equals sign only, as in ``<p title=it's>``.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)?+)?+""")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: Elements that hold everything up to their end tag; a page may also forget that tag.
OPTIONAL_END = {"noscript", "template", "svg", "annotation", "annotation-xml", "object", "select"}
#: A subtree's hash follows from the sums of a polynomial over its blocks' hashes.
PRIME, BASE = (1 << 61) - 1, 0x1D8F3A57C6B42E91


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of a name; no value: empty."""
    found: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return found


def _left_out(tag: str, attrs: str, in_root: bool) -> bool:
    if tag in NEVER or tag == "header" and not in_root:
        return True
    if tag in ("html", "body") or not TELLING.search(attrs):
        return False
    has = attributes(attrs)
    names = [has[n] for n in ("class", "id") if n in has]
    if tag in ROOTS:
        return any(COMMENT.search(n) for n in names)
    return ("hidden" in has or has.get("aria-hidden", "").lower() == "true" or has.get("role", "").strip().lower() in ROLES
            or any(SURE.search(n) or not in_root and BOX.search(n) for n in names) or bool(NOT_SHOWN.search(has.get("style", ""))))


def parse(page: str | None, templates: frozenset | set = frozenset()) -> tuple[list[str], list[int]]:
    """(blocks of the main text, hashes of the subtrees that may be templates).

    If the page has an ``article`` or ``main`` element, the text is what stands in
    those; else in the whole page. ``br`` is white space. Open elements end with the page.
    Time and memory grow with the page's length, however deep its elements are nested.
    """
    if not page:
        return [], []
    blocks: list[tuple[str, bool]] = []  # text, inside a root
    sums = [0]  # of the polynomial, before each block and behind the last
    gone: list[tuple[int, int]] = []  # spans of blocks of templates; they still count for the hashes of what holds them
    words: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, first block, inside a root before it
    inside_of: Counter[str] = Counter()  # tags on the stack
    endless: set[str] = set()  # tags without an end tag in the rest of the page
    hashes: set[int] = set()
    out = 0  # depth of the outermost element that is left out; 0: none
    root = found = False

    def flush() -> None:
        if words:
            if text := " ".join(entities.unescape("".join(words)).split()):
                blocks.append((text, root))
                sums.append((sums[-1] * BASE + xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))) % PRIME)
            words.clear()

    def close(depth: int) -> None:
        nonlocal out, root
        while len(stack) > depth:
            flush()
            tag, first, before = stack.pop()
            inside_of[tag] -= 1
            if out > len(stack):
                out = 0
            root = before
            if first < len(blocks) and not out and tag in (INSIDE if root else OUTSIDE):
                n = len(blocks) - first
                h = xxhash.xxh64_intdigest(f"{tag} {n} {(sums[-1] - sums[first] * pow(BASE, n, PRIME)) % PRIME}") - (1 << 63)
                if h in templates:
                    while gone and gone[-1][0] >= first:  # of templates that it holds
                        gone.pop()
                    gone.append((first, len(blocks)))
                else:
                    hashes.add(h)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not out:
            words.append(page[at:lt])
        if lt == end:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = TAG.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):  # a tag that the page's end cuts off
                break
            if not out:
                words.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if inside_of[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if tag not in endless and not (tag == "svg" and m[3].endswith("/")):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                after = page.find(">", stop.end()) if stop else -1
                if after >= 0:
                    at = after + 1
                elif tag in OPTIONAL_END:
                    endless.add(tag)
                else:
                    at = end
            if not out:
                words.append(" ")
            continue
        if tag in VOID:
            if not out:
                words.append(" ")
                if tag == "hr":
                    flush()
            continue
        skip = not out and _left_out(tag, m[3], root)
        if tag in BLOCK:
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            for name in range(len(stack) - 1, -1, -1):
                if stack[name][0] not in CLOSES.get(tag, ()):
                    break
                close(name)
            flush()
        if tag in BLOCK or skip:
            stack.append((tag, len(blocks), root))
            inside_of[tag] += 1
            if skip:
                flush()
                out = len(stack)
            elif tag in ROOTS and not out:
                root = found = True
    close(0)
    flush()
    kept, at = [], 0
    for first, last in [*gone, (len(blocks), len(blocks))]:
        kept += [t for t, inside in blocks[at:first] if inside or not found]
        at = last
    return kept, sorted(hashes)


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [parse(h) for h in pdf["html"]]
        yield pd.DataFrame({"host": pdf["host"], "page": pdf["page"], "hashes": [hashes for _, hashes in parsed], "content": [
            xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63) for texts, _ in parsed]})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [
            "\n".join(parse(h, frozenset(t) if t is not None else frozenset())[0]) for h, t in zip(pdf["html"], pdf["hashes"], strict=True)]})


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page, hashes, content for every row of ``pages`` (host, page, html) whose html is not empty."""
    return written(pages.where("html <> ''").select("host", "page", "html").mapInPandas(
        _hashes, "host string, page long, hashes array<long>, content long"), "subtrees")


def site_templates(seen: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, hash: the subtrees that recur in at least ``min_pages`` contents of a host
    and the root of their number. Pages of one text are one content and count a subtree once."""
    # A null hash counts the contents themselves.
    each = seen.select("host", "content", F.explode(F.concat("hashes", F.array(F.lit(None).cast("long")))).alias("hash")).distinct()
    counts = written(each.groupBy("host", "hash").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("hash").isNull()), "subtree-counts")
    hosts = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    return counts.where("hash IS NOT NULL").join(hosts, "host").where(F.col("n") >= F.sqrt("pages")).select("host", "hash")


def page_templates(seen: DataFrame, templates: DataFrame) -> DataFrame:
    """host, page, hashes: the templates that a page holds, for pages with any."""
    each = seen.select("host", "page", F.explode("hashes").alias("hash"))
    return each.join(templates, ["host", "hash"], "left_semi").groupBy("host", "page").agg(F.collect_set("hash").alias("hashes"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null or empty html gives the empty text. The host is the url's, in lower
    case; pages without one form a site of their own. Copies of a page, repeated
    rows or under other urls, count as one page of the site. Other columns are ignored.
    Long and deeply nested pages are read whole in one pass each time; a page must
    fit in a task, a site need not.
    """
    hosted = pages.select("page_id", "url", "html", F.xxhash64("html").alias("page"), F.coalesce(F.regexp_extract(
        F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")).alias("host"))
    seen = subtrees(hosted)
    templates = written(site_templates(seen), "site-templates")
    held = written(page_templates(seen, templates), "page-templates")
    texts = (hosted.join(held.hint("shuffle_hash"), ["host", "page"], "left").select("page_id", "url", "html", "hashes")
             .mapInPandas(_texts, "page_id long, url string, text string"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
