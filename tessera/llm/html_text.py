"""Main text of HTML pages by consensus paths of a host.

1. Each page is cut into blocks with the path of open elements above them. Parts that are never main
   text (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles,
   comments) are known by tag, role or class words. Every other container is scored by its own and its
   paragraphs' text, links counting against it.
2. Paths are generalised: tag and class words of the containers and tags of the rest, digits taken out; of
   a deep path the upper part is written as its hash, so that paths do not grow with depth.
   In Spark each host's pages vote: the scores of a path are summed over the host, and the best path wins
   (ties: longer support, then name).
3. Pages are read again; the host's winning path gives the container, widened to the outermost article
   or main around it, or to the outermost container that adds mostly text that is no link. A page without
   it falls back to its own best container, and one without any to all its text.

Every step is linear in the page, however deep its elements are nested. Formulas, drawings' labels,
embedded objects' fallback text and preformatted raw text are content.

Defined results: null html has the empty text; a null or hostless url belongs to the host ''. Repeated
rows vote and are extracted each; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, written

#: Largest table of winning paths, in bytes, that is sent to all tasks; a larger one is joined by host.
BROADCAST_BYTES = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is passed over, and those whose content is text to the letter.
RAW = frozenset("script style noscript template title iframe noframes".split())
LITERAL = frozenset("textarea xmp".split())
DROPPED_TAGS = frozenset("head nav aside footer form select button dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsored sponsor promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget related recommended share sharing social comment comments commentlist respond "
    "disqus replies footer header masthead cookie cookies consent notice notices alert popup modal newsletter "
    "subscribe signup login pagination pager toolbar skip".split()
)
#: Words of a class or id that mark main text even beside a dropped word.
KEPT_WORDS = frozenset("article content main post entry story body text".split())
#: Dropped words that a kept word beside them does not save.
NEVER_KEPT = frozenset("ad ads advert comment comments nav menu sidebar".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td textarea tfoot th thead "
    "tr ul xmp br".split()
)
CONTAINERS = frozenset("article main section div body td center".split())
MAIN = frozenset(("article", "main"))
#: Characters of a path above which its upper part is hashed.
PATH_CHARS = 200
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 li".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - frozenset("html body br".split()) | {"p"}
SAME_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def class_words(attrs: dict[str, str]) -> list[str]:
    return re.findall(r"[a-z]+", DIGITS.sub("", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower())


class Element:
    """An open tag with what it hands down: the container it lies in, and marks on the way to it."""

    __slots__ = "tag path name dropped words links paragraphs parent order container link paragraph in_main".split()

    def __init__(self, tag: str, label: str, parent: Element | None, dropped: bool, order: int):
        self.tag, self.parent, self.dropped, self.order = tag, parent, dropped, order
        above = "" if parent is None else parent.name
        if len(above) > PATH_CHARS:
            above = "~" + hashlib.blake2b(above.encode("utf-8", "replace"), digest_size=8).hexdigest()
        self.name = f"{above}>{label}" if above else label
        self.words = self.links = self.paragraphs = 0.0
        self.path, self.container = None, None if parent is None else parent.container
        self.link = self.paragraph = False
        self.in_main = parent is not None and parent.in_main or tag in MAIN
        if tag in CONTAINERS:
            self.path, self.container = self.name, self
        elif parent is not None:
            self.link, self.paragraph = parent.link or tag == "a", parent.paragraph or tag in PARAGRAPHS


def is_dropped(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true"
    if hidden or tag in DROPPED_TAGS or (tag == "header" and not inside_main):
        return True
    if attrs.get("role", "").lower() in DROPPED_ROLES or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    names = set(class_words(attrs))
    if tag in ("html", "body", "main", "article"):
        return tag == "article" and bool({"comment", "comments", "reply"} & names)
    return bool(DROPPED_WORDS & names) and not (KEPT_WORDS & names and not NEVER_KEPT & names)


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """All elements, and the pieces of kept text, each with its innermost element; a None text ends a block."""
    root = Element("", "", None, False, 0)
    elements, pieces, stack = [root], [], [root]
    opened: dict[str, int] = {}  # how many of each tag are open
    at, n = 0, len(page)

    def text(raw: str, literal: bool = False):
        if raw and not stack[-1].dropped:
            pieces.append((stack[-1], raw if literal else html_lib.unescape(raw)))

    def close(k: int):
        if any(e.tag in BLOCKS for e in stack[k:]):
            pieces.append((stack[k - 1], None))
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "main", "body", "td", "table") and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            pieces.append((stack[-1], None))
        if tag in VOID:
            continue
        ends = [t for t in SAME_ENDS.get(tag, ()) if opened.get(t)]
        paragraph = tag in ENDS_P and opened.get("p")
        for k in range(len(stack) - 1, 0, -1) if ends or paragraph else ():
            t = stack[k].tag
            if t in ends or (t == "p" and paragraph):
                close(k)
                break
            if t in BLOCKS and t != "p":
                break
        attrs = attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag in RAW or tag in LITERAL:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in LITERAL and not is_dropped(tag, attrs, stack[-1].in_main):
                text(page[at : end.start() if end else n], tag == "xmp")
                pieces.append((stack[-1], None))
            at = end.end() if end else n
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        dropped = stack[-1].dropped or is_dropped(tag, attrs, stack[-1].in_main)
        label = ".".join([tag, *sorted(set(class_words(attrs)))]) if tag in CONTAINERS else tag
        stack.append(Element(tag, label, stack[-1], dropped, len(elements)))
        elements.append(stack[-1])
        opened[tag] = opened.get(tag, 0) + 1
    return elements, pieces


def scored(elements: list[Element], pieces: list[tuple[Element, str | None]]) -> dict[str, tuple[float, int]]:
    """Score and order of first appearance of each container path of a page.

    Text counts fully for the innermost container and half as much for each one further out, so that the
    one that holds the paragraphs wins over the page around it.
    """
    for e, t in pieces:
        if t is None or e.container is None:
            continue
        size, x = len(t.split()), e.container
        if e.link:
            x.links += size
        else:
            x.words += size
            x.paragraphs += size * 0.5 * e.paragraph
    # elements stand after their parents: what a container holds is whole before it is handed up
    for e in reversed(elements):
        above = e.parent.container if e.path is not None else None
        if above is not None:
            above.words += e.words / 2
            above.links += e.links / 2
            above.paragraphs += e.paragraphs / 2
    out: dict[str, tuple[float, int]] = {}
    for e in elements:
        if e.path is not None and not e.dropped:
            score = e.words + e.paragraphs - e.links
            score *= 2.0 if e.tag in MAIN else 0.5 if e.tag == "body" else 1.0
            if score > 0:
                old = out.get(e.path)
                out[e.path] = (score + (old[0] if old else 0.0), old[1] if old else e.order)
    return out


def joined(elements: list[Element], pieces: list[tuple[Element, str | None]], path: str | None) -> str:
    """The text of the blocks below ``path`` (all blocks if None), in page order."""
    inside = [path is None] * len(elements)
    if path is not None:
        for e in elements[1:]:
            inside[e.order] = inside[e.parent.order] or e.path == path
    blocks, held = [], []
    for e, t in pieces:
        if t is None:
            blocks.append("".join(held))
            held = []
        elif inside[e.order]:
            held.append(t)
    blocks.append("".join(held))
    return " ".join(b for b in (SPACE.sub(" ", x).strip() for x in blocks) if b)


def outermost(elements: list[Element], pieces: list[tuple[Element, str | None]], path: str) -> str:
    """The path of the whole main part that ``path`` lies in.

    Its outermost article or main; without one, the outermost container inside the body that adds more
    text than link text to it.
    """
    e = next((x for x in elements if x.path == path and not x.dropped), None)
    above, main = [], None
    while e is not None:
        if e.tag in MAIN:
            main = e.path
        if e.path is not None and e.tag != "body" and e.path != path:
            above.append(e.path)
        e = e.parent
    if main is not None or not above:
        return main or path
    # elements stand after their parents: links are handed down, words up (those of ``path`` stay there)
    link, words, added = [False] * len(elements), [0] * len(elements), dict.fromkeys(above, 0)
    for x in elements[1:]:
        link[x.order] = x.tag == "a" or link[x.parent.order]
    for x, t in pieces:
        if t is not None:
            words[x.order] += -len(t.split()) if link[x.order] else len(t.split())
    for x in reversed(elements[1:]):
        if x.path is None or x.path != path:
            words[x.parent.order] += words[x.order]
            if x.path in added:
                added[x.path] += words[x.order]
    return next((k for k in reversed(above) if added[k] > 0), path)


def extract(page: str | None, path: str | None) -> str:
    """The page's main text: of the host's path, else of its own best container, else all its text."""
    elements, pieces = parse(page or "")
    if path is None or not any(e.path == path and not e.dropped for e in elements):
        own = scored(elements, pieces)
        path = max(own, key=lambda k: (own[k][0], -own[k][1])) if own else None
    return joined(elements, pieces, path if path is None else outermost(elements, pieces, path))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of (host, path), summed over the batch."""
    for b in batches:
        held: dict[tuple[str, str], list] = {}
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            if not page:
                continue
            found = scored(*parse(page))
            total = sum(s for s, _ in found.values()) or 1.0
            for path, (score, _) in found.items():  # a page has one vote, shared by its containers
                h = held.setdefault((host, path), [0.0, 0])
                h[0] += score / total
                h[1] += 1
        # whole numbers add up alike in any order
        yield pa.RecordBatch.from_pydict(
            {
                "host": pa.array([k[0] for k in held], pa.string()),
                "path": pa.array([k[1] for k in held], pa.string()),
                "score": pa.array([round(v[0] * 1_000_000) for v in held.values()], pa.int64()),
                "pages": pa.array([v[1] for v in held.values()], pa.int64()),
            }
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)
        text = pa.array([extract(page, path) for page, path in rows], pa.string())
        columns = [b.column("page_id"), b.column("url"), text, b.column("path")]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host: host, path, score, pages."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, score bigint, pages bigint")
    votes = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages"))
    best = F.max_by(F.struct("path", "score", "pages"), F.struct("score", "pages", "path"))
    return votes.groupBy("host").agg(best.alias("b")).select("host", "b.*")


#: The host of a url, after the scheme and a user's name.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and the path used."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), HOST, 1)), F.lit(""))
    own = (F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    pages = pages.select(*own, host.alias("host"))
    paths = written(host_paths(pages)).select("host", "path")
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    with_path = pages.join(F.broadcast(paths) if size <= BROADCAST_BYTES else paths, "host", "left")
    id_type = pages.schema["page_id"].dataType.simpleString()
    found = with_path.select("page_id", "url", "html", "path")
    found = found.mapInArrow(_extract, f"page_id {id_type}, url string, text string, path string")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "path")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


ORACLE = {
    "op10_html_text": r"""
with a as (select page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '') t from pages),
b as (select page_id, url, regexp_replace(regexp_replace(t, '<(?:/?(?:p|h1|h2|h3|li|ul|div)\b|br\b)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') t from a),
c as (select page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') t from b)
select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) "text", length(trim(regexp_replace(t, '\s+', ' ', 'g')))::bigint n_chars from c"""
}
QUERIES = {"op10_html_text": op10_html_text}
