"""Operator 1: main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; scripts, styles and comments are dropped. Pass one looks at each block by
itself: link density, length and stop-word density make it good, bad, or ambiguous (a short block without links, or one
of middling stop-word density). In pass two every ambiguous block takes the label of its nearest decided neighbour,
counted in blocks; where the nearest ones on both sides are equally far and differ, or where none is decided, the block is bad.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

#: Most link characters of a block that may be text, as a share.
LINK_DENSITY = 0.2
#: Characters below which a block is too short to tell.
SHORT = 70
#: Stop words by words: from HIGH on a block is text, below LOW it is not.
STOP_LOW, STOP_HIGH = 0.08, 0.16

STOP_WORDS = frozenset(
    """a about all also an and are as at be because been but by can could do for from had has have he her him his how i if in into is it its
    just like me more my no not of on one only or other our out she so some than that the their them then there these they this to up was we
    were what when which who will with would you your
    der die das den dem des ein eine einer eines und oder ist im in zu mit von auf für an nicht sich auch als es aus bei nach wie wird dass sie er
    le la les un une des du de et ou est au aux en dans par pour pas que qui sur avec ce se sont il elle nous vous plus ne
    el los las una unos y o es en con por para del al que se no su lo como más pero sus le ya este""".split()
)

_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_SKIP = "script|style|noscript|template|textarea|svg|iframe"
_PIECE = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<({_SKIP})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*>")
_BLANK = re.compile(r"\s+")
_EDGES = ".,;:!?\"'()[]{}<>#$%&*+/=@\\^_`|~«»“”„¿¡…-–—"


@dataclass
class Block:
    text: str
    tag: str
    links: int  # characters within links


def blocks(page: str) -> list[Block]:
    """The non-blank blocks of a page in order, blanks collapsed."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    tag, anchors = "", 0

    def close() -> None:
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                inner = _BLANK.sub(" ", html.unescape("".join(linked))).strip()
                out.append(Block(text, tag, len(inner)))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if anchors:
                linked.append(text)

    at = 0
    for m in _PIECE.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            anchors = max(0, anchors - 1) if m[2] else anchors + 1
        elif name in _BLOCK:
            close()
            tag = "" if m[2] else name
            anchors = 0
    add(page[at:])
    close()
    return out


def classify(block: Block) -> str:
    """Pass one: good, bad or ambiguous."""
    n = len(block.text)
    if block.tag == "title" or block.links > LINK_DENSITY * n or "©" in block.text:
        return "bad"
    if n < SHORT:
        return "ambiguous"
    words = block.text.lower().split()
    share = sum(w.strip(_EDGES) in STOP_WORDS for w in words) / len(words)
    return "good" if share >= STOP_HIGH else "bad" if share < STOP_LOW else "ambiguous"


def resolve(labels: list[str]) -> list[str]:
    """Pass two: ambiguous blocks take the label of the nearest decided one."""
    far = len(labels) + 1
    before, after = [(far, "")] * len(labels), [(far, "")] * len(labels)
    last = (far, "")
    for k, x in enumerate(labels):
        last = (0, x) if x != "ambiguous" else (last[0] + 1, last[1])
        before[k] = last
    last = (far, "")
    for k in range(len(labels) - 1, -1, -1):
        last = (0, labels[k]) if labels[k] != "ambiguous" else (last[0] + 1, last[1])
        after[k] = last
    out = []
    for k, x in enumerate(labels):
        if x == "ambiguous":
            (d, a), (e, b) = before[k], after[k]
            if not a and not b:
                x = "bad"
            elif not a or b and e < d:
                x = b
            elif not b or d < e:
                x = a
            else:
                x = a if a == b else "bad"
        out.append(x)
    return out


def extract(page: str) -> tuple[str, int, int, int]:
    """Text, blocks, good blocks, blocks that were ambiguous."""
    found = blocks(page)
    first = [classify(b) for b in found]
    final = resolve(first)
    good = [b.text for b, x in zip(found, final) if x == "good"]
    return "\n".join(good), len(found), len(good), first.count("ambiguous")


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int32()), ("n_good", pa.int32()), ("n_ambiguous", pa.int32())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            got = [(None, 0, 0, 0) if x is None else extract(x) for x in part.column(2).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], schema=_OUT)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks, n_good, n_ambiguous) of every row, in one pass and without a shuffle.

    A null page has a null text; an empty one, or one without good blocks, an empty text. Unclosed scripts and comments
    run to the end of the page; a "<" that opens no tag is text. Null ids and urls stay null, repeated rows give
    repeated results, other columns are ignored.
    """
    return pick(pages, page_id="long", url="string", html="string").mapInArrow(_run, "page_id long, url string, text string, n_blocks int, n_good int, n_ambiguous int")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
