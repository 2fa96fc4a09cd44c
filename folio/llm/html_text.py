"""Operator 1: main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table
from .textbatch import chunks

#: Elements by role (HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SKIPPED = frozenset("head script style title template noscript iframe object embed svg canvas audio video button input select textarea option label nav footer aside menu dialog noembed noframes xmp plaintext annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr thead tbody tfoot legend".split())
#: A start tag on the left closes an open element on the right, up to the nearest of its container.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
INLINE_SCOPE = frozenset("a b i em strong span small big u s code font abbr cite q sub sup mark tt kbd samp var time label".split())
#: Words in class, id or role that mark what is not the article. They count as whole words of the attribute.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail widget footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies reviews notice notices cookie cookies consent gdpr banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager copyright legal disclaimer skip search alert toc tags contentinfo complementary".split())
#: The same in German, French and Spanish, without accents as names have them.
NOISE |= frozenset("kommentar kommentare leserkommentare kopfzeile fusszeile seitenleiste werbung anzeige anzeigen menue commentaire commentaires entete publicite comentario comentarios cabecera publicidad anuncio anuncios".split())
#: Headings of readers' comments, with or without their number, in the four languages.
_COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|your|leave a|post a|add a|all) )?(?:comments?|replies|responses|kommentare?|leserkommentare?|antworten|commentaires?|réactions|réponses|comentarios?|respuestas|reacciones)(?:\s*[(\[:]?\s*\d*\s*[)\]]?)?\W*", re.I)
#: Those that are topics as well: as a part of a longer name they mark nothing if the element holds prose.
TOPICS = frozenset("search legal tags alert share sharing social related reviews notice notices skip respond reply replies promotion".split())
LEAST_PROSE = 140
#: Elements that are furniture of the page or of a form unless they hold the article; headers within an article may hold its title.
FURNITURE = frozenset("form fieldset header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Links of a list within an article that is not part of it.
LEAST_LINKS = 3
#: Where a label is a word of the text, and no name of a control.
PROSE = frozenset("p li dd td".split())
KEEPS_NOISE = frozenset("html body article main".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, marked: str | None = None):
        self.tag, self.parent, self.noise, self.marked = tag, parent, noise, marked
        self.children: list[Node | str] = []


def _noisy(tag: str, attrs: str) -> bool:
    if tag in SKIPPED:
        return True
    if not attrs or tag in KEEPS_NOISE:
        return False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("hidden", "aria-hidden") and (name == "hidden" or (m[2] or m[3] or m[4]) == "true"):
            return True
        value = m[2] or m[3] or m[4] or ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _marked(tag: str, attrs: str) -> str | None:
    """"name" if class, id or role are words of NOISE or the element is FURNITURE, "part" if only parts of longer names are such words, "topic" if these are all TOPICS."""
    found = "name" if tag in FURNITURE else None
    for m in _ATTR.finditer(attrs) if attrs and tag not in SKIPPED else ():
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
                noise = [w for w in parts if w in NOISE]
                if noise and len(noise) == len(parts):
                    return "name"
                if noise and found != "name":
                    found = "part" if found == "part" or not TOPICS.issuperset(noise) else "topic"
    return found


def parse(page: str) -> Node:
    """A tree of elements and decoded texts. Missing and wrong end tags are mended as browsers do for common cases; nothing raises."""
    root = Node("#root", None)
    at, pos, n = root, 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            at.children.append(entities.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.children.append(entities.unescape(page[pos : m.start()]))
        pos = m.end()
        end, name, attrs = m.group(1, 2, 3) if m[2] is not None else m.group(4, 5, 6) if m[5] is not None else (None, None, None)  # the second where a quote is never closed
        if name is None:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if end:  # end tag: closes up to its own start, which inline elements do not look for beyond a block
            up = at
            while up is not root and up.tag != tag:
                if tag in INLINE_SCOPE and up.tag in BLOCKS:
                    up = root
                    break
                up = up.parent
            if up is not root:
                at = up.parent
            elif tag in ("p", "br"):
                at.children.append(Node(tag, at))
            continue
        if tag in ("html", "body") and root.children:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                continue
        if tag == "body" or tag in BLOCKS and at.tag == "head":
            up = at
            while up is not root and up.tag != "head":
                up = up.parent
            if up is not root:
                at = up.parent
        if tag in CLOSES_P:
            up = at
            while up is not root and (up.tag == "p" or up.tag in INLINE_SCOPE):
                if up.tag == "p":
                    at = up.parent
                    break
                up = up.parent
        if tag in IMPLIED:
            closes, inside = IMPLIED[tag]
            up = at
            while up is not root and up.tag not in inside:
                if up.tag in closes:
                    at = up.parent
                up = up.parent
        node = Node(tag, at, _noisy(tag, attrs) and not (tag == "label" and at.tag in PROSE), _marked(tag, attrs))
        at.children.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS and tag not in RAW and tag not in INLINE_SCOPE:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)[^>]*(?:>|$)", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        at = node
    return root


def _walk(root: Node):
    """Nodes without noise, children before parents, without recursion: pages may nest deeper than Python calls can."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node) and not c.noise]
    return reversed(order)


def settle(root: Node) -> None:
    """Marked elements become noise, except those around the article or main element with the most unlinked text, or, where a page has none,
    around two thirds of its unlinked text. A name that is in part a topic's, and within an article any name of which only a part is noise, does not count on prose;
    nor does a header with a heading count within an article. Marked articles, as of comments, do not count as such, and are noise if they are smaller than the largest that does."""
    order = list(_walk(root))
    if not any(x.marked for x in order):
        return
    for x in order:
        x.chars = x.link_chars = 0
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(_SPACE.sub(" ", c).strip())
            elif not c.noise:
                x.chars, x.link_chars = x.chars + c.chars, x.link_chars + c.link_chars
        if x.tag == "a":
            x.link_chars = x.chars
    named = [x for x in reversed(order) if x.tag in ("article", "main") and not x.marked and x.chars > x.link_chars]
    up = max(named, key=lambda x: x.chars - x.link_chars, default=None)
    around, largest = set(), up.chars - up.link_chars if up is not None else 0
    while up is not None:
        around.add(id(up))
        up = up.parent
    within = {id(x) for x in named}
    whole = root.chars - root.link_chars
    for x in reversed(order):  # parents first
        if x.parent is not None and id(x.parent) in within:
            within.add(id(x))
        plain = x.chars - x.link_chars
        if x.marked and (x.tag not in KEEPS_NOISE or x.tag == "article" and plain < largest):
            wraps = id(x) in around if named else 0 < 2 * whole <= 3 * plain
            prose = plain >= LEAST_PROSE and 2 * x.link_chars <= x.chars and (x.marked == "topic" or x.marked == "part" and id(x) in within)
            titled = x.tag == "header" and id(x) in within and any(isinstance(c, Node) and c.tag in HEADINGS for c in _below(x))
            x.noise = not (wraps or prose or titled)


def _text(x: Node) -> str:
    return _SPACE.sub(" ", "".join(c for c in _flat(x))).strip()


def _flat(x: Node):
    stack: list = [x]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            yield c
        elif not c.noise:
            stack += reversed(c.children)


def silence_comments(root: Node) -> None:
    """Readers' comments that no name marks: a heading that says so, and behind it blocks of one shape (an element, a class) but no paragraphs of its parent's own, are noise.
    An article about comments goes on in paragraphs, which stay."""
    for x in list(_walk(root)):
        if x.tag not in HEADINGS or x.noise or x.parent is None or not _COMMENTS.fullmatch(_text(x)):
            continue
        row = x.parent.children
        rest = row[next(i for i, c in enumerate(row) if c is x) + 1 :]
        upto = next((i for i, c in enumerate(rest) if isinstance(c, Node) and c.tag in HEADINGS and c.tag <= x.tag), len(rest))
        after = [c for c in rest[:upto] if isinstance(c, Node) and not c.noise]
        if after and not any(c.tag == "p" for c in after) and not any(isinstance(c, str) and c.strip() for c in rest[:upto]):
            for c in (x, *after):
                c.noise = True


def _below(x: Node):
    stack = [c for c in x.children if isinstance(c, Node)]
    while stack:
        c = stack.pop()
        yield c
        stack += [d for d in c.children if isinstance(d, Node)]


def measure(root: Node) -> Node | None:
    """Characters, tags, linked characters and tags of every node without noise; then its density and the sum of its children's. Returns the body."""
    body = None
    for x in _walk(root):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(_SPACE.sub(" ", c).strip())
            elif not c.noise:
                x.chars, x.tags = x.chars + c.chars, x.tags + c.tags + 1
                x.link_chars, x.link_tags = x.link_chars + c.link_chars, x.link_tags + c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
        if x.tag == "body":
            body = x
    top = body or root
    share = top.link_chars / max(1, top.chars)
    for x in _walk(root):
        # composite density: characters a tag, lowered by the share of linked characters and tags
        x.density = x.total = 0.0
        if x.chars:
            tags, links = max(1, x.tags), max(1, x.link_chars)
            plain = max(1, x.chars - x.link_chars)
            base = math.log(x.chars * x.link_chars / plain + share * x.chars + math.e)
            x.density = x.chars / tags * math.log(max(1.0 + 1e-9, x.chars / links * tags / max(1, x.link_tags))) / max(base, 1e-9)
        x.total = sum(c.density for c in x.children if isinstance(c, Node) and not c.noise)
    return body


def main_node(root: Node) -> Node:
    """The content subtree.

    It starts at the node with the largest sum of its children's densities. Half the smallest density on the path from there to the body is
    the threshold. The subtree grows along that path to the body; where it lies in an article or main element, see `_of_articles`. On the way all siblings
    but those that are mostly links are kept while siblings at least as dense as the threshold add a fifth of its plain text, or a heading stands
    before it. From the first parent where neither holds, blocks are kept by themselves, see `chosen`.
    """
    settle(root)
    silence_comments(root)
    body = measure(root)
    top = body or root
    best = max((x for x in _walk(top) if x.chars), key=lambda x: (x.total, x.chars - x.link_chars), default=top)
    path, up = [best], best
    while up is not top:
        up = up.parent
        path.append(up)
    threshold = min(x.density for x in path) / 2
    if any(x.tag in ("article", "main") for x in path):
        return _of_articles(path, threshold)
    now, whole = best, True
    for above in path[1:]:
        here = above.children.index(now)
        others = [c for c in above.children if isinstance(c, Node) and c is not now and not c.noise and c.chars]
        added = sum(c.chars - c.link_chars for c in others if c.density >= threshold) + sum(len(c.strip()) for c in above.children if isinstance(c, str))
        headed = any(isinstance(c, Node) and c.tag in ("h1", "h2") and not c.noise for c in above.children[:here])
        whole = whole and (headed or added >= 0.2 * (now.chars - now.link_chars))
        kept = None if whole else chosen(above, now, threshold)
        for c in others:
            c.noise = 2 * c.link_chars > c.chars or kept is not None and c.tag in BLOCKS and id(c) not in kept
        now = above
    return now


def _drop_heading(x: Node) -> None:
    """The heading right before a list that went has nothing left to stand over."""
    while x.parent is not None:
        row = x.parent.children
        before = [c for c in row[: next(i for i, c in enumerate(row) if c is x)] if not (isinstance(c, str) and not c.strip() or isinstance(c, Node) and c.noise)]
        if before:
            if isinstance(before[-1], Node) and before[-1].tag in HEADINGS and before[-1].tag != "h1":
                before[-1].noise = True
            return
        if x.parent.tag in ("article", "main", "body"):
            return
        x = x.parent


def _of_articles(path: list[Node], threshold: float) -> Node:
    """Growth where the path from the densest node to the body leads through article or main elements.

    Up to the first of them, all is kept but lists of links that are less dense than the threshold. From there on, of what stands beside the path further articles are added that
    reach the threshold and a fifth of the text so far, and within a main element the title before its article and prose that reaches the threshold: a lead, an epilogue.
    """
    named = [x.tag in ("article", "main") for x in path]
    first, links = named.index(True), {}
    inner = path[: first + 1]
    for x in _walk(path[first]):
        links[id(x)] = (x.tag == "a") + sum(links.get(id(c), 0) for c in x.children if isinstance(c, Node) and not c.noise)
    kept = {id(x) for x in inner}
    for x in list(_walk(path[first])):
        if id(x) not in kept and x.tag in BLOCKS and x.chars and 2 * x.link_chars > x.chars and x.density < threshold and links[id(x)] >= LEAST_LINKS:
            x.noise = True
            _drop_heading(x)
    now = path[first]
    titled = any(c.tag == "h1" and not c.noise for c in _walk(now))
    for k, above in enumerate(path[first + 1 :], first + 1):
        here, plain = above.children.index(now), now.chars - now.link_chars
        inside = any(named[k:])  # of a main element
        for i, c in enumerate(above.children):
            if c is now:
                continue
            if isinstance(c, str):
                above.children[i] = " "
            elif not c.noise:
                more = c.tag == "article" and c.density >= threshold and 5 * (c.chars - c.link_chars) >= plain
                title = inside and not titled and i < here and c.tag == "h1" and not c.link_chars
                prose = inside and c.tag in BLOCKS and c.tag != "article" and c.density >= threshold and c.chars - c.link_chars >= LEAST_PROSE and not c.link_chars
                c.noise = not (more or title or prose)
                titled = titled or title
        now = above
    return now


def chosen(above: Node, now: Node, threshold: float) -> set[int]:
    """Blocks of a parent that belong to the text of its child `now`, of those that are not mostly links: those at least as dense as the threshold,
    all between kept ones, and link-free paragraphs and headings next to kept ones. Parts made of paragraphs count as such below the body."""
    row = [c for c in above.children if isinstance(c, Node) and (c is now or not c.noise and c.chars and c.tag in BLOCKS and 2 * c.link_chars <= c.chars)]
    kept = [i for i, c in enumerate(row) if c is now or c.density >= threshold]
    first, last = kept[0], kept[-1]

    def paragraph(c: Node) -> bool:
        within = above.tag not in ("body", "#root") and any(isinstance(x, Node) and x.tag == "p" for x in c.children)
        return not c.link_chars and (c.tag == "p" or within)

    while first and (paragraph(row[first - 1]) or row[first - 1].tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
        first -= 1
    while last + 1 < len(row) and paragraph(row[last + 1]):
        last += 1
    return {id(c) for c in row[first : last + 1]}


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order, white space as one space; noise left out. A line break within a block is a space."""
    out: list[str] = []
    part: list[str] = []

    def close():
        text = _SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            part.append(x)
        elif x.noise and x is not node:
            if x.tag in BLOCKS:
                close()
        elif x.tag == "br":
            part.append(" ")
        elif x.tag in BLOCKS:
            close()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    close()
    return out


def extract(page: str | None) -> str:
    """Main text of a page; empty for null and empty pages and where nothing is left."""
    if not page:
        return ""
    return "\n\n".join(blocks(main_node(parse(page))))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page. One page at a time, no shuffle; a page's tree is all that is held.

    Null or empty html gives an empty text. Broken markup is mended, cut pages end where they end. Repeated rows are extracted each, null ids and urls kept;
    of nodes that are equally dense the first in page order is the seed. An empty table gives no rows; further columns of pages are ignored, whatever their names.
    """
    rows = pages.select(F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("row"), F.col(html_col).alias("html"))

    def extracted(batches):
        for b, texts in chunks(batches, text="html"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(t) for t in texts], pa.string())], names=["row", "text"])

    out = in_arrow(rows, extracted, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
