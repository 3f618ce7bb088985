"""Main text of web pages, without what a site repeats on its pages.

Every page is parsed into a tree of elements; each subtree has a hash of its tag and content. The
hashes are counted per host in Spark, over pages of different content (copies of one page count
once). A subtree that recurs on many of a host's pages is template and is deleted: on at least
`share` of them (and `least` pages) where a page marks no article, and on at least half inside a
marked article, whose paragraphs may well be quoted elsewhere. Elements whose tag, role or class
names say navigation, header, footer, side matter, notice, advert, form or comments go as well; a
class name says so only if all its words do or name a mere container (related-posts, but not
related-work), or if it begins or ends with comments or ends with advert (user-comment, inline-ad). Inside a
marked article a single word that may be its subject (related, legal, teaser) says nothing.

The templates of a host are few: each is on a fixed share of the host's pages, so their number is
bounded by the size of a page. They are joined to pages by broadcast if the number of all templates,
which is checked, is small, and else by a join on host and salt, so that a hot host spreads over tasks.

Pages are read in one pass: a tag ends at the first > outside quotes; where quotes are never closed,
at the next > whatever the quotes, from there to the end of the page.

Edge cases: a null or empty html has an empty text; a null or odd url has the host ''; repeated
rows have equal results and count once as templates; very long pages are parsed whole; unclosed and
stray tags are tolerated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

START = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>""")  # possessive: never tries another way
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Element names of the HTML standard by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("html body td th tr tbody thead tfoot option optgroup legend".split())
DROPPED = RAW | set("head nav footer aside form button select input svg canvas object embed audio video map menu dialog label fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note".split())
#: Words in class and id names that mark what is no article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner banners cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar comment comments commentlist disqus reply replies respond discussion related recommended recommendations share sharing social popup modal overlay "
    "widget widgets toolbar pagination pager login signup signin search skip teaser teasers copyright legal disclaimer form".split()
)
#: Words in class names beside those, for what holds them.
HOLDERS = set(
    "area bar block body bottom box button buttons col column container content feed foot global group head holder icons inner item items left link links list "
    "main module outer page panel post posts primary region right row secondary section site slot stories story strip thread top unit wrap wrapper zone".split()
)
#: Of those words, the ones that may as well be what an article is about, or a part of it.
AMBIGUOUS = set("teaser teasers discussion legal related form search skip disclaimer copyright share sharing social promo promotion promoted recommended recommendations reply replies respond header banner banners overlay subscription".split())
COMMENTS = set("comment comments commentlist disqus".split())
ADS = set("ad ads advert adverts advertisement".split())
#: How surely attributes say that an element is no part of an article: outside one only; by the first or last
#: word of a name; by all of it.
HINT, AFFIX, SURE = 1, 2, 3
#: A start tag closes an open element of the same group, up to the group's container.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class Element:
    __slots__ = ("tag", "marked", "children", "hash", "core")

    def __init__(self, tag: str, marked: int):
        self.tag, self.marked, self.children, self.hash, self.core = tag, marked, [], 0, False


def says_so(words: list[str]) -> bool:
    return any(w in NAMES for w in words) and all(w in NAMES or w in HOLDERS or w.isdigit() for w in words)


def named(token: str) -> int:
    """How surely a class or id name says that an element is no part of an article."""
    words = [w.lower() for w in NAME.findall(token)]
    if says_so(words):
        return HINT if len(words) == 1 and words[0] in AMBIGUOUS else SURE
    return AFFIX if words and (words[0] in COMMENTS or words[-1] in COMMENTS or words[-1] in ADS) else 0


def marked_by(attributes: str) -> int:
    """How surely attributes say that an element is no part of an article, 0 if they don't. They are read as
    pairs of names and values, so that nothing is found inside a value or another name."""
    most = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            most = max([most, *map(named, value.split())])
        elif (
            key == "hidden"
            or key == "role" and value.strip().lower() in ROLES
            or key == "aria-hidden" and value.lower() == "true"
            or key == "style" and "display:none" in value.replace(" ", "").lower()
        ):
            most = SURE
    return most


def tags(source: str) -> Generator[tuple[int, int, str, str], int | None, None]:
    """(start, end, name, attributes) of tags and comments in order; the name of an end tag begins with
    / and that of a comment is empty. A tag that is passed on may be followed by send(place): the
    search goes on there."""
    at, loose = 0, False
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            found = (start, end + 3 if end >= 0 else len(source), "", "")
        elif source.startswith(("<!", "<?"), start):
            end = source.find(">", start)
            found = (start, end + 1, "", "") if end >= 0 else None
        elif m := START.match(source, start + 1):
            rest = None if loose else REST.match(source, m.end())
            loose = loose or rest is None
            end = source.find(">", m.end()) + 1 if loose else rest.end()
            found = (start, end, m[0].lower(), source[m.end() : end - 1]) if end else None
            if not end:  # no > any more, so no tag
                return
        else:
            found = None
        if found:
            at = (yield found) or found[1]
        else:
            at = start + 1


def parse(source: str) -> Element:
    """The tree of a page; children are elements and decoded strings."""
    root = Element("#page", 0)
    stack = [root]
    opened: Counter = Counter()
    at, n = 0, len(source)

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    found = tags(source)
    after = None
    while True:
        try:
            start, stop, name, attributes = found.send(after)
        except StopIteration:
            break
        after = None
        if start > at:
            stack[-1].children.append(entities.unescape(source[at:start]))
        at = stop
        if not name:
            continue
        if name[0] == "/":
            tag = name[1:]
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "table", "body") and tag not in ("article", "main", "table", "body", "html"):
                    break
            continue
        tag = name
        closes, fence = SIBLINGS.get(tag, ()), FENCES.get(tag, ())
        if tag in CLOSES_P:
            closes, fence = (*closes, "p"), {*fence, "td", "th", "li", "div", "article", "section", "button", "table"} - set(closes)
        for k in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closes) else ():
            if stack[k].tag in closes:
                close(k)
                if stack[-1].tag not in closes:
                    break
            elif stack[k].tag in fence:
                break
        element = Element(tag, marked_by(attributes))
        stack[-1].children.append(element)
        if tag in RAW:
            # Only the whole name ends it: </scripture> is text of a script.
            last = re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*+)?+(?:>|\Z)", re.I).search(source, at)
            at = after = last.end() if last else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
            opened[tag] += 1
    if n > at:
        stack[-1].children.append(entities.unescape(source[at:]))
    return root


def weigh(node: Element, out: set[int]) -> None:
    """Hash every subtree that holds text, and note which hold an article. Children come first."""
    work = [(node, False)]
    while work:
        e, done = work.pop()
        if not done:
            work.append((e, True))
            work += [(c, False) for c in e.children if type(c) is not str]
            continue
        text = False
        parts = [e.tag]
        for c in e.children:
            if type(c) is str:
                words = " ".join(c.split())
                text = text or bool(words)
                parts.append(words)
            else:
                e.core = e.core or c.core
                text = text or bool(c.hash)
                parts.append(str(c.hash))
        e.core = e.core or e.tag in ("article", "main")
        if text:
            e.hash = xxhash.xxh3_64_intdigest("\x00".join(parts)) >> 1 or 1
            out.add(e.hash)


def is_dropped(e: Element, inside: bool) -> bool:
    if e.tag in DROPPED:
        return not (e.core and e.tag in ("form", "fieldset"))
    if e.tag == "header":
        return not inside and not e.core
    if e.tag == "article":
        return e.marked == SURE
    # A name may stand on what wraps the article; that stays.
    return (e.marked > HINT or e.marked == HINT and not inside) and not e.core and e.tag not in ("html", "body")


def extract(root: Element, templates: dict[int, bool]) -> str:
    """Text of the page's articles, or of the page if none is marked. templates: hash -> whether it is
    on half of the host's pages."""
    blocks: list[str] = []
    line: list[str] = []

    def end_block():
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    marked = any_article(root)
    work: list = [(root, False, False)]
    while work:
        item, inside, running = work.pop()
        if item is None:
            end_block()
        elif type(item) is str:
            if inside or not marked:
                line.append(item)
        elif item.tag == "br":
            line.append(" ")
        else:
            block = item.tag in BLOCK
            recurs = item.hash in templates and not item.core and (templates[item.hash] or not marked)
            if is_dropped(item, inside) or recurs and (block or not running):
                if block:
                    end_block()
                continue
            inner = inside or item.tag in ("article", "main")
            if block:
                end_block()
                work.append((None, False, False))
                running = has_own_text(item, templates)
            work += [(c, inner, running) for c in reversed(item.children)]
    end_block()
    return "\n".join(blocks)


def has_own_text(block: Element, templates: dict[int, bool]) -> bool:
    """Whether a block has running text that is in no recurring element."""
    return any(bool(c.strip()) if type(c) is str else c.hash and c.tag not in BLOCK and c.hash not in templates for c in block.children)


def any_article(root: Element) -> bool:
    """Whether an article or main element is left when what is dropped is gone."""
    work = [root]
    while work:
        e = work.pop()
        if e.tag in ("article", "main") and not is_dropped(e, False):
            return True
        work += [c for c in e.children if type(c) is not str and c.core and not is_dropped(c, False)]
    return False


def count_subtrees(pages: DataFrame) -> DataFrame:
    """host, content (hash of a whole page), hashes of its subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, hashes = [], []
            for source in b.column(1):
                found: set[int] = set()
                root = parse(source.as_py() or "")
                weigh(root, found)
                content.append(root.hash)
                hashes.append(sorted(found - {root.hash}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "content", "hashes"])

    return pages.select("host", "html").mapInArrow(run, "host string, content long, hashes array<long>")


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def site_templates(pages: DataFrame, share: float, least: int) -> DataFrame:
    """host, templates array<struct<hash, strong>>: bounded per host by page size over share."""
    seen = count_subtrees(pages)
    # Pages of one content count once; combined before the shuffle, so copies cost nothing there.
    once = materialize(seen.groupBy("host", "content").agg(F.first("hashes").alias("hashes")), "subtrees")
    totals = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = once.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = counts.join(totals, "host").where(F.col("n") >= share * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list(F.struct("hash", (F.col("n") >= 0.5 * F.col("pages")).alias("strong"))).alias("templates"))


def main_text(pages: DataFrame, share: float = 0.2, least: int = 4, broadcast_templates: int = 1_000_000, salts: int = 32) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    templates = materialize(site_templates(rows, share, least), "templates")
    # A host and its templates take some bytes each: the bound is about 16 MB.
    if (templates.agg(F.sum(F.size("templates") + 4)).first()[0] or 0) <= broadcast_templates:
        joined = rows.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "_salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, known in zip(b.column(2), b.column(3)):
                root = parse(source.as_py() or "")
                weigh(root, set())
                texts.append(extract(root, {t["hash"]: t["strong"] for t in known.as_py() or ()}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "templates").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
