"""Problem 6: splitting oversized items at natural boundaries.

A text is parsed into a tree (sections by headings, blocks, list lines,
sentences, clauses, words). Sibling subtrees are merged up to the limit, only
nodes above it are entered, and a heading stays with what it heads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 150

#: Words whose point doesn't end a sentence.
ABBREVIATIONS = frozenset(
    "approx ca cf e.g i.e eg ie etc vs viz resp fig figs tab tabs no nos vol ch sec sect eq ref refs ed eds p pp al dr prof mr mrs ms. st max min avg est incl excl".split()
)
_MARK = re.compile(r"[.!?…。！？｡]+[\"'”’»)\]}」』）】》]*")
_WIDE = "。！？｡"
_OPEN = "\"'“‘«([{「『（【《„-–—*•"


@dataclass
class Node:
    """A span [start, end) of the text; `kind` is root, section, block, line, sentence, clause or word, `head` where its headings end."""

    kind: str
    start: int
    end: int
    head: int = 0
    children: list[Node] = field(default_factory=list)


def sentence_ends(text: str) -> list[int]:
    """Ends (exclusive) of the sentences of a text, closing quotes and brackets included; the last ends the text.

    A mark ends a sentence if the text ends there or a new sentence can begin:
    an upper-case letter, an ideograph, or an opening sign before one. A point
    of an abbreviation, in a number, or before a small letter doesn't.
    """
    ends = []
    n = len(text.rstrip())
    for m in _MARK.finditer(text, 0, n):
        at = m.end()
        if at >= n:
            break
        marks = m.group().rstrip("\"'”’»)]}」』）】》")
        if any(c in _WIDE for c in marks):
            ends.append(at)
            continue
        k = at
        while k < n and text[k].isspace():
            k += 1
        spaced, j = k > at, k
        while j < n and text[j] in _OPEN:
            j += 1
        if j >= n:
            continue
        nxt = text[j]
        if marks == ".":
            w = m.start()
            while w > 0 and (text[w - 1].isalpha() or text[w - 1] == "."):
                w -= 1
            word = text[w : m.start()].lower()
            if at == m.start() + 1 and word in ABBREVIATIONS:
                continue
            if not spaced and (w == m.start() and at == m.start() + 1 and nxt.isdigit()):
                continue
        if nxt.isupper() or "㐀" <= nxt <= "鿿" or nxt.istitle():
            ends.append(at)
        elif nxt.isdigit() and spaced and (marks != "." or len(word) >= 4 or at > m.start() + 1):
            ends.append(at)
    return [*ends, n] if n else []


def _cuts(text: str, node: Node, pattern: re.Pattern, kind: str) -> list[Node]:
    """Children of a span, cut behind each match of the pattern; together they cover it."""
    out, at = [], node.start
    for m in pattern.finditer(text, node.start, node.end):
        if at < m.end() < node.end:
            out.append(Node(kind, at, m.end()))
            at = m.end()
    return [*out, Node(kind, at, node.end)]


_BLOCK, _LINE = re.compile(r"\n[ \t\r]*\n\s*"), re.compile(r"\n+")
_CLAUSE, _WORD = re.compile(r"[;:,，；：、]\s*|\s[-–—]\s"), re.compile(r"\s+")
_MARKED = re.compile(r"(?m)^#{1,6}[ \t]+\S.*$|<h[1-6]\b", re.I)
#: The next finer kind of a node that has only itself as a child.
_FINER = {"root": "section", "section": "block", "block": "line", "line": "sentence", "sentence": "clause", "clause": "word"}


def _headings(text: str, node: Node) -> list[tuple[int, int, int]]:
    """(start, end, level) of the headings in a span."""
    out = []
    for m in _MARKED.finditer(text, node.start, node.end):
        if text[m.start()] == "#":
            out.append((m.start(), m.end(), len(m.group()) - len(m.group().lstrip("#"))))
        else:
            level = int(text[m.start() + 2])
            close = re.compile(rf"</h{level}\s*>", re.I).search(text, m.end(), node.end)
            out.append((m.start(), close.end() if close else text.find("\n", m.end(), node.end) % (node.end + 1), level))
    return out


def _sections(text: str, node: Node) -> list[Node]:
    """Sections under the highest headings of a span; a section's own sub-headings part it when it is entered in turn."""
    heads = [h for h in _headings(text, node) if h[0] >= node.head]
    if not heads:
        return [Node("section", node.start, node.end, node.head)]
    top = min(h[2] for h in heads)
    own = [h for h in heads if h[2] == top]
    first = [Node("section", node.start, own[0][0], node.head)] if own[0][0] > node.start and text[node.start : own[0][0]].strip() else []
    if not first:
        own[0] = (node.start, *own[0][1:])
    return first + [Node("root", a, b, e) for (a, e, _), b in zip(own, [*(h[0] for h in own[1:]), node.end], strict=True)]


def expand(text: str, node: Node) -> list[Node]:
    """The children of a node, made when it is entered; they cover it, and the first holds its headings and what follows them."""
    if node.kind == "root":
        kids = _sections(text, node)
    elif node.kind == "section":
        kids = _cuts(text, node, _BLOCK, "block")
    elif node.kind == "block":
        # lines are children only where every line end is a sentence end too, or the next line begins an entry (lists); else they would part a sentence
        ends = {*_ends(text, node)}
        breaks = [m for m in _LINE.finditer(text, node.start, node.end) if m.end() < node.end]
        if breaks and all(m.end() <= node.head or len(text[node.start : m.start()].rstrip()) + node.start in ends or text[m.end() : m.end() + 1] in "-*•|<" for m in breaks):
            kids = _cuts(text, node, _LINE, "line")
        else:
            kids = _sentences(text, node)
    elif node.kind == "line":
        kids = _sentences(text, node)
    elif node.kind == "sentence":
        kids = _cuts(text, node, _CLAUSE, "clause")
    elif node.kind == "clause":
        kids = _cuts(text, node, _WORD, "word")
    else:
        return []
    # a first child that is headings only is joined with the next; one that begins with headings knows where they end
    while len(kids) > 1 and not text[max(node.head, kids[0].start) : kids[0].end].strip() and node.head > kids[0].start:
        kids[:2] = [Node(kids[1].kind, kids[0].start, kids[1].end, max(node.head, kids[1].head))]
    if kids and not kids[0].head:
        kids[0].head = node.head
    return kids


def _ends(text: str, node: Node) -> list[int]:
    return [node.start + e for e in sentence_ends(text[node.start : node.end])]


def _sentences(text: str, node: Node) -> list[Node]:
    ends = _ends(text, node)
    stops = [*ends[:-1], node.end] if ends else [node.end]
    return [Node("sentence", a, b) for a, b in zip([node.start, *stops[:-1]], stops, strict=True) if b > a]


def paragraph_tree(text: str) -> Node:
    """The tree of a paragraph, its sentences or list lines made."""
    root = Node("block", 0, len(text))
    root.children = expand(text, root)
    return root


def sentence_nodes(text: str, node: Node) -> Iterator[Node]:
    """The sentences of a tree, in order."""
    if node.kind == "sentence":
        yield node
    else:
        for kid in node.children or expand(text, node):
            yield from sentence_nodes(text, kid)


def _size(text: str, start: int, end: int) -> int:
    """Length without white space at the end."""
    while end > start and text[end - 1].isspace():
        end -= 1
    return end - start


def pack(text: str, node: Node, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start, end, fresh): text[start:end] has at most `limit` characters and repeats text[start:fresh] of the piece before.

    The children of a node above the limit are merged with their neighbours as
    long as a piece holds them with its repeated part; a child that is itself
    above the limit ends the piece and is entered. Only whole sentences or,
    where the last is longer, whole words of at most `overlap` characters are
    repeated. A single word above the limit is cut hard.
    """
    pieces: list[tuple[int, int, int]] = []

    def lead(at: int, size: int) -> int:
        room = min(overlap, limit - size)
        return _back(text, at, pieces[-1][2], room) if pieces and room > 0 and pieces[-1][1] == at else at

    stack: list[tuple[list[Node], int]] = [([node], 0)]
    fresh = start = end = node.start  # of the open piece
    while stack:
        kids, k = stack.pop()
        if k == len(kids):
            if end > fresh:
                pieces.append((start, end, fresh))
            fresh = start = end
            continue
        kid = kids[k]
        stack.append((kids, k + 1))
        size = _size(text, kid.start, kid.end)
        if size <= limit:
            if end > fresh and _size(text, start, kid.end) > limit:
                pieces.append((start, end, fresh))
                fresh = end
            if end == fresh:
                fresh, start = kid.start, lead(kid.start, size)
            end = kid.end
            continue
        if end > fresh:
            pieces.append((start, end, fresh))
        fresh = start = end = kid.start
        below = kid.children or expand(text, kid)
        if len(below) == 1 and kid.kind != "word":
            below = [Node(_FINER[kid.kind], kid.start, kid.end, kid.head)]
        elif len(below) <= 1:
            below = [Node("word", a, min(a + limit, kid.end)) for a in range(kid.start, kid.end, limit)]
        stack.append((below, 0))
    out = [(s, f + _size(text, f, e), f) for s, e, f in pieces if text[f:e].strip()]
    return out or [(node.start, node.start, node.start)]


def _back(text: str, end: int, floor: int, overlap: int) -> int:
    """Where the repeated end of a piece begins: a sentence's start if one lies near enough, else a word's."""
    lo = max(floor, end - overlap)
    window = text[lo:end]
    inner = sentence_ends(window)[:-1]
    if inner:
        return lo + inner[0]
    m = _WORD.search(window)
    return lo + m.end() if m and m.end() < len(window) else end


def _paragraphs(text: str, limit: int) -> Iterator[tuple[int, str]]:
    for k, p in enumerate(text.split("\n\n")):
        if len(p) > limit:
            yield k, p


def _apply(chapters: DataFrame, rows, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for r in rows(i, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], types[k]) for k in range(len(names))], names)

    digital = chapters.filter(F.coalesce(F.col("source_format"), F.lit("")) != "pdf_scan").select(F.col("id").cast("string"), F.col("text"))
    return digital.mapInArrow(run, schema)


def boundaries(chapters: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, paragraph_index, cut_at): each sentence end of each paragraph above the limit. Null and blank texts give none."""

    def rows(i, t):
        for k, p in _paragraphs(t, limit):
            for s in sentence_nodes(p, paragraph_tree(p)):
                yield i, k, _size(p, 0, s.end)

    return _apply(chapters, rows, "id string, paragraph_index int, cut_at int", ["id", "paragraph_index", "cut_at"], [pa.string(), pa.int32(), pa.int32()])


def pieces(chapters: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, paragraph_index, chunk_index, start, fresh, text): the pieces of each paragraph above the limit.

    `fresh` is where the text not repeated from the piece before begins;
    concatenating text from `fresh` on gives the paragraph back.
    """

    def rows(i, t):
        for k, p in _paragraphs(t, limit):
            for c, (s, e, f) in enumerate(pack(p, paragraph_tree(p), limit, overlap)):
                yield i, k, c, s, f, p[s:e]

    return _apply(
        chapters, rows, "id string, paragraph_index int, chunk_index int, start int, fresh int, text string",
        ["id", "paragraph_index", "chunk_index", "start", "fresh", "text"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()],
    )


def sections(chapters: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, start, fresh, text): whole digital chapters as pieces of their structure tree (headings, blocks, lists).

    Chapters within the limit are one piece; null and blank texts give none.
    """

    def rows(i, t):
        if t.strip():
            for c, (s, e, f) in enumerate(pack(t, Node("root", 0, len(t)), limit, overlap)):
                yield i, c, s, f, t[s:e]

    return _apply(chapters, rows, "id string, chunk_index int, start int, fresh int, text string", ["id", "chunk_index", "start", "fresh", "text"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()])
