"""HTML to text: by expressions where a body is flattened, by one parse per page where its blocks matter."""

from __future__ import annotations

import html as htmllib
import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from . import text as T

MARK = "\ue000"
# Elements without text, blocks that break lines, elements that end an open paragraph, and elements that never close.
DROPPED = ("script", "style", "nav", "footer", "noscript")
BLOCKS = frozenset("div p br li ul ol table tr td th h1 h2 h3 h4 h5 h6 blockquote pre section article header footer hr dt dd".split())
END_PARAGRAPH = frozenset(
    "address article aside blockquote center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


# An ampersand that may begin a character reference, with the reference if a semicolon ends it; and what stands for one that doesn't, a code point that no text has.
_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")
OPEN = "\ufdd0"


def hide_open(text: str) -> str:
    """``text`` with OPEN for ampersands of references that no semicolon ends, so that they aren't decoded."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else OPEN + m[0][1:], text) if "&" in text else text


def show_open(text: str) -> str:
    return text.replace(OPEN, "&")


def decode_closed(text: str) -> str:
    """Character references that end in a semicolon decoded."""
    return show_open(htmllib.unescape(hide_open(text)))


def _decoder(decode):
    @F.arrow_udf(StringType())
    def decoded(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else decode(t) if "&" in t else t for t in text.to_pylist()], pa.string())

    return decoded


#: Character references decoded, for which Spark has no function: as browsers do, where some names need no semicolon, or only those that end in one.
unescape, unescape_closed = _decoder(htmllib.unescape), _decoder(decode_closed)


def body_nodes(df: DataFrame, html: str, into: str, keep_comments: bool = True, open_references: bool = True) -> DataFrame:
    """``df`` with the stripped, non-empty text nodes of the body in the array ``into``.

    Comments count as text unless ``keep_comments`` is off. ``&amp`` is a reference as ``&amp;`` is, unless ``open_references`` is off.
    """
    kept = F.col(html)
    for tag in DROPPED:
        kept = F.regexp_replace(kept, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    body = F.regexp_extract(kept, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
    body = F.when(kept.rlike(r"(?i)<body\b"), body).otherwise(kept)
    body = F.regexp_replace(body, r"(?is)<!doctype[^>]*>", MARK)
    body = F.regexp_replace(body, "<!--|-->", MARK) if keep_comments else F.regexp_replace(body, "(?s)<!--.*?-->", MARK)
    marked = F.regexp_replace(body, "<[^>]*>", MARK)
    return (
        df.withColumn("__marked", marked)
        .withColumn("__plain", (unescape if open_references else unescape_closed)(F.col("__marked")))
        .withColumn(into, F.filter(F.transform(F.split("__plain", MARK, -1), T.strip), lambda x: F.length(x) > 0))
        .drop("__marked", "__plain")
    )


def clean_html(df: DataFrame, html: str, into: str, zero_width: str = "parity", keep_comments: bool = True, open_references: bool = True) -> DataFrame:
    """``df`` with the cleaned text of the body in ``into``: its text nodes joined by blanks; '' for empty or null input.

    Walking from a body, which isn't a block, joins everything below it on one line, so the tree's shape
    doesn't matter.
    """
    nodes = body_nodes(df, html, "__nodes", keep_comments, open_references).withColumn("__joined", F.array_join("__nodes", " "))
    return T.clean_text(nodes, "__joined", into, zero_width).withColumn(into, F.coalesce(into, F.lit(""))).drop("__nodes", "__joined")


class Node:
    """An element, or a text or comment node (``tag`` None)."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag, parent=None, attrs=(), text=""):
        self.tag, self.parent, self.attrs, self.text, self.children = tag, parent, dict(attrs), text, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def texts(self) -> list[str]:
        return [n.text for n in self.walk() if n.tag is None]

    def drop(self) -> None:
        if self.parent is not None and self in self.parent.children:
            self.parent.children.remove(self)


class _Builder(HTMLParser):
    CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

    def __init__(self, shown=str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.shown = shown

    def handle_starttag(self, tag, attrs):
        if self.at.tag in self.CLOSES.get(tag, ()) or (self.at.tag == "p" and tag in END_PARAGRAPH):
            self.at = self.at.parent
        node = Node(tag, self.at, [(k, v and self.shown(v)) for k, v in attrs])
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(Node(None, self.at, text=self.shown(data)))

    handle_comment = handle_data


def parse(html: str, open_references: bool = True) -> Node:
    builder = _Builder() if open_references else _Builder(show_open)
    builder.feed(html if open_references else hide_open(html))
    builder.close()
    return builder.root


def block_lines(root: Node) -> list[str]:
    """Lines of an element: a block breaks the line where all elements between it and the root are blocks."""
    lines: list[str] = []
    run: list[str] = []

    def end():
        if run:
            lines.append(" ".join(run))
            run.clear()

    stack = [(c, True) for c in reversed(root.children)] if root.tag in BLOCKS or root.tag is None else [(c, False) for c in reversed(root.children)]
    while stack:
        node, breaking = stack.pop()
        if node is None:
            end()
        elif node.tag is None:
            if node.text.strip():
                run.append(node.text.strip())
        elif breaking and node.tag in BLOCKS:
            end()
            stack.append((None, True))
            stack.extend((c, True) for c in reversed(node.children))
        else:
            stack.extend((c, False) for c in reversed(node.children))
    end()
    return lines


def element_text(root: Node) -> str:
    """Block lines with white space squeezed, without empty ones."""
    return "\n".join(x for x in (" ".join(line.split()) for line in block_lines(root)) if x)


def find(root: Node, tag: str, cls: str | None = None) -> Node | None:
    return next((n for n in root.walk() if n.tag == tag and (cls is None or n.has_class(cls))), None)


# Where a detail page has its title and content, and the layout inside the content.
TITLE, CONTENT, CONTENT_PARENT = ("a", "title_topicdisplay"), ("div", "divmain"), ("div", "col-md-9")
LAYOUT_CLASSES = ("breadcrumb", "share", "toolbar", "social-links", "print")
REMOVED = ("nav", "footer", "script", "style")


def page_facts(html: str | None, open_references: bool = True) -> dict | None:
    """Title, content text, text nodes and anchors of a detail page, from one parse."""
    if html is None:
        return None
    root = parse(html, open_references)
    for n in list(root.walk()):
        if n.tag in REMOVED:
            n.drop()
    title = find(root, *TITLE)
    content = find(root, *CONTENT) or find(root, *CONTENT_PARENT) or find(root, "body")
    if content is not None:
        for n in list(content.walk()):
            if n is not content and n.tag and (n.tag == "form" or (n.tag == "div" and n.has_class("bgtitle")) or any(map(n.has_class, LAYOUT_CLASSES))):
                n.drop()
    words = lambda node: " ".join(t.strip() for t in node.texts() if t.strip())
    return {
        "title": words(title) if title else "",
        "content_text": element_text(content) if content else "",
        "nodes": root.texts(),
        "links": [{"href": (n.attrs.get("href") or "").strip(), "text": words(n)} for n in content.walk() if n.tag == "a" and "href" in n.attrs] if content else [],
    }


PAGE = StructType().add("title", StringType()).add("content_text", StringType()).add("nodes", ArrayType(StringType())).add("links", ArrayType(StructType().add("href", StringType()).add("text", StringType())))
_PAGE_TYPE = pa.struct([("title", pa.string()), ("content_text", pa.string()), ("nodes", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))])


def _pager(open_references: bool):
    @F.arrow_udf(PAGE)
    def facts(html: pa.Array) -> pa.Array:
        return pa.array([page_facts(h, open_references) for h in html.to_pylist()], _PAGE_TYPE)

    return facts


#: The facts of pages; in ``page_closed`` only references that end in a semicolon are decoded.
page, page_closed = _pager(True), _pager(False)


@F.arrow_udf(StringType())
def block_text(html: pa.Array) -> pa.Array:
    """Text of an HTML fragment walked from its outermost element, with real line breaks."""

    def one(h):
        root = parse(h)
        tops = [n for n in root.children if n.tag]
        return element_text(tops[0] if len(tops) == 1 else root)

    return pa.array([None if h is None else one(h) for h in html.to_pylist()], pa.string())


def published(facts: Column) -> Column:
    from .dates import sniff_date

    return sniff_date(facts["nodes"])


