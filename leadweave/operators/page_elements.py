"""Captured pages to element arrays.

The one job that runs Python. Each page becomes one row carrying its nodes in document order,
so everything computed per page afterwards is an array expression on the same row and needs no
shuffle. The raw HTML does not travel past this job unless asked for.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadweave import fixed_values as fv

# One struct per element and per text node ('#text'), numbered in document order from 0. ``last`` is
# the number of the last node inside it (its own if it is empty), so a subtree is a slice of the
# array and an ancestor test compares two numbers; ``line`` counts block boundaries passed.
ELEMENT = T.StructType([
    T.StructField("node", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
])

# FIXED VALUES of the HTML syntax: elements without content, raw-text elements, and the open
# elements that a new start tag closes implicitly.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset({"script", "style", "title", "textarea"})
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
BLOCK = frozenset(fv.BLOCK_TAGS)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.DOTALL
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


NO_ATTRIBUTES: dict[str, str] = {}  # of every text node


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), html_entities.unescape(value) if "&" in value else value)
    return found


def page_nodes(source: str) -> list[tuple]:
    """Nodes of one page in document order (comments dropped, unclosed tags tolerated)."""
    nodes: list[tuple] = []
    last: list[int] = []
    open_nodes: list[tuple[str, int]] = []
    line = position = 0

    def close(down_to: int) -> None:
        nonlocal line
        while len(open_nodes) > down_to:
            tag, node = open_nodes.pop()
            last[node] = len(nodes) - 1
            line += tag in BLOCK

    def add(tag: str, attrs: dict[str, str], text: str) -> int:
        node = len(nodes)
        nodes.append((node, open_nodes[-1][1] if open_nodes else -1, tag, attrs, text, line))
        last.append(node)
        return node

    def add_text(text: str) -> None:
        if text:
            add("#text", NO_ATTRIBUTES, html_entities.unescape(text) if "&" in text else text)

    while True:
        token = TOKEN.search(source, position)
        add_text(source[position : token.start() if token else len(source)])
        if token is None:
            break
        position = token.end()
        tag = (token.group(2) or "").lower()
        if not tag:
            continue
        if token.group(1):
            depth = next((i for i in range(len(open_nodes) - 1, -1, -1) if open_nodes[i][0] == tag), None)
            if depth is not None:
                close(depth)
            continue
        implied = CLOSED_BY.get(tag, ())
        while open_nodes and (open_nodes[-1][0] in implied or (open_nodes[-1][0] == "p" and tag in CLOSES_P)):
            close(len(open_nodes) - 1)
        line += tag in BLOCK
        attrs = _attributes(token.group(3))
        if tag in RAW_TEXT:
            end = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(source, position)
            body = source[position : end.start() if end else len(source)]
            position = end.end() if end else len(source)
            node = add(tag, attrs, body if tag in ("script", "style") else "")
            if tag in ("title", "textarea") and body:
                nodes.append((node + 1, node, "#text", NO_ATTRIBUTES, html_entities.unescape(body), line))
                last.append(node + 1)
                last[node] = node + 1
            continue
        node = add(tag, attrs, "")
        if tag in VOID:
            line += tag in BLOCK
        else:
            open_nodes.append((tag, node))
    close(0)
    return [(*node, end) for node, end in zip(nodes, last, strict=True)]


_ARROW_ELEMENT = [
    ("node", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("line", pa.int32()), ("last", pa.int32()),
]


def _elements_column(sources: list[str | None]) -> pa.Array:
    """Element arrays of a batch, built column by column."""
    flat: list[tuple] = []
    offsets = [0]
    for source in sources:
        flat.extend(page_nodes(source or ""))
        offsets.append(len(flat))
    columns = list(zip(*flat)) if flat else [[] for _ in _ARROW_ELEMENT]
    arrays = [
        pa.array([list(value.items()) for value in values] if name == "attrs" else list(values), kind)
        for (name, kind), values in zip(_ARROW_ELEMENT, columns)
    ]
    structs = pa.StructArray.from_arrays(arrays, fields=[pa.field(name, kind) for name, kind in _ARROW_ELEMENT])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def byte_ranges(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of a string or binary column that hold about ``most`` bytes each, at least one row."""
    begin, held = 0, 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        if at > begin and held + size > most:
            yield begin, at
            begin, held = at, 0
        held += size
    if begin < len(values):
        yield begin, len(values)


def parse_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None, batch_bytes: int = 1 << 19) -> DataFrame:
    """Replace the HTML column by ``elements``; ``keep`` names the columns that travel along.

    Elements leave the worker every ``batch_bytes`` of HTML, so a batch of large pages never piles up.
    """
    kept = keep if keep is not None else [c for c in pages.columns if c != html]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("elements", T.ArrayType(ELEMENT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in byte_ranges(batch.column(html), batch_bytes):
                part = batch.slice(begin, end - begin)
                elements = _elements_column(part.column(html).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [elements], names=[*kept, "elements"])

    columns = kept if html in kept else kept + [html]
    return pages.select(*columns).mapInArrow(run, schema)
