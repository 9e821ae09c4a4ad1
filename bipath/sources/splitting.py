"""The outer elements of one large XML or JSON file, read by many tasks.

Spark reads a text file in byte ranges and cuts it at a separator, here the character that opens a tag or an object, so no
record is longer than the text between two of them. What a range begins in (a comment, a string, an element some levels
deep) is not known to the task that reads it. So the file is read twice. The first pass notes for each range and each state
it may begin in the state it ends in and how the depth changes. These notes, one short row per range and state, are
added up from the start of each file. The second pass then knows the state and depth each range begins with, and cuts
it at depth one. An element over a range's end comes as parts, which are put together by a group of the few of one element.

Nothing is guessed from how an opening looks, and no text moves but for those parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bipath.runtime import ship, written

TEXT = "text"  # the state at the start of a file
OPEN, ALONE, CLOSE = 1, 0, -1
Events = list[tuple[int, int, int]]  # (first byte, byte after the last, one of the above)


@dataclass(frozen=True)
class Grammar:
    """How to find the elements.

    ``separator`` is the one character that any opening begins with. ``scan`` takes bytes that begin with it (or with the
    file) and the state at their begin, and gives the openings and closings with the state at their end. With ``filler``, bytes
    between elements other than these are elements of their own, so that a reader can reject them.
    """

    separator: str
    states: tuple[str, ...]
    scan: Callable[[bytes, str], tuple[Events, str]]
    filler: bytes | None = None


def xml_elements(tag: str) -> Grammar:
    """The outermost elements of name ``tag``; comments, CDATA and processing instructions are no markup."""
    name = re.escape(tag.encode())
    mark = re.compile(
        rb"<!--|<!\[CDATA\[|<\?|<(/?)" + name + rb"(?=[\s/>])(?:((?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*)>)?"
    )
    ends = {"comment": b"-->", "cdata": b"]]>", "instruction": b"?>"}
    begins = {b"<!--": "comment", b"<![CDATA[": "cdata", b"<?": "instruction"}

    def scan(data: bytes, state: str) -> tuple[Events, str]:
        events, at = [], 0
        while True:
            if state != TEXT:
                end = data.find(ends[state], at)
                if end < 0:
                    return events, state
                at, state = end + len(ends[state]), TEXT
            found = mark.search(data, at)
            if found is None:
                return events, state
            at = found.end()
            if found[1] is None:
                state = begins[found[0]]
            elif found[1]:
                events.append((found.start(), at, CLOSE))
            else:
                # An opening that never ends is one, so that its element is found to be broken and not lost.
                events.append((found.start(), at, ALONE if (found[2] or b"").endswith(b"/") else OPEN))

    return Grammar("<", (TEXT, *ends), scan)


def _unescaped_quotes(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(codes == 0x22)
    after = quotes[(quotes > 0) & (codes[np.maximum(quotes, 1) - 1] == 0x5C)]
    if len(after):
        # A quote is escaped by an odd run of backslashes.
        runs = np.array([q - _run_start(data, q) for q in after.tolist()])
        quotes = np.setdiff1d(quotes, after[runs % 2 == 1], assume_unique=True)
    return quotes


def _run_start(data: bytes, end: int) -> int:
    while end and data[end - 1] == 0x5C:
        end -= 1
    return end


def _scan_json(data: bytes, state: str) -> tuple[Events, str]:
    codes = np.frombuffer(data, np.uint8)
    quotes = _unescaped_quotes(data)
    inside = state != TEXT
    braces = np.flatnonzero((codes == 0x7B) | (codes == 0x7D))
    outer = braces[(np.searchsorted(quotes, braces) + inside) % 2 == 0]
    steps = np.where(codes[outer] == 0x7B, OPEN, CLOSE)
    events = list(zip(outer.tolist(), (outer + 1).tolist(), steps.tolist()))
    return events, "string" if (len(quotes) + inside) % 2 else TEXT


# Objects of a file of lines, of arrays, or both: what stands outside of all objects only parts them.
JSON_OBJECTS = Grammar("{", (TEXT, "string"), _scan_json, b" \t\r\n,[]\xef\xbb\xbf")


def _ranges(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(file, first byte of the range, bytes): consecutive pieces of each range, cut before a separator."""
    last = None
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(2).to_pylist()
        at = 0
        while at < len(values):
            here = (files[at], blocks[at])
            stop = at + 1
            while stop < len(values) and blocks[stop] == here[1] and files[stop] == here[0]:
                stop += 1
            data = separator.join(values[at:stop])
            # Each record but the first of a file stands after a separator.
            yield (*here, data if here[1] == 0 and here != last else separator + data)
            last, at = here, stop


def _survey(grammar: Grammar):
    """Per range and state at its begin: the state at its end, the change of depth, and the lowest depth on the way."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, notes = None, {}

        def told():
            return pa.RecordBatch.from_pylist(
                [{"file": here[0], "block": here[1], "start": s, "state": n[0], "change": n[1], "low": n[2]} for s, n in notes.items()]
            )

        for file, block, data in _ranges(batches, grammar.separator.encode()):
            if (file, block) != here:
                if here is not None:
                    yield told()
                here, notes = (file, block), {s: (s, 0, 0) for s in (grammar.states if block else (TEXT,))}
            known: dict[str, tuple] = {}
            for start, (state, change, low) in notes.items():
                if state not in known:
                    events, end = grammar.scan(data, state)
                    steps = np.cumsum([step for *_, step in events]) if events else np.zeros(1, np.int64)
                    known[state] = (end, int(steps[-1]), int(min(steps.min(), 0)))
                end, more, lowest = known[state]
                notes[start] = (end, change + more, min(low, change + lowest))
        if here is not None:
            yield told()

    return survey


def _entries(notes: list) -> dict[tuple[str, int], tuple[str, int, int]]:
    """(file, range) -> (state, depth, the range in which the element open there began)."""
    by_range: dict[tuple[str, int], dict] = {}
    for n in notes:
        by_range.setdefault((n["file"], n["block"]), {})[n["start"]] = n
    entries, file = {}, None
    for key in sorted(by_range):
        if key[0] != file:
            file, state, depth, owner = key[0], TEXT, 0, -1
        entries[key] = (state, depth, owner)
        note = by_range[key][state]
        # A closing without an opening leaves the depth at 0.
        least = depth + note["low"]
        ended = least <= 0
        depth = depth + note["change"] + max(0, -least)
        state, owner = note["state"], (key[1] if ended else owner)
    return entries


_PIECE = "file string, owner long, part long, element string"


def _cut(grammar: Grammar, shared):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        here, state, depth, owner, held, between = None, TEXT, 0, -1, [], []

        def rows(pieces):
            columns = list(zip(*pieces)) or [[], [], [], []]
            texts = [x.decode("utf-8", "replace") for x in columns[3]]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(texts, pa.string())],
                names=["file", "owner", "part", "element"],
            )

        def rest():
            """What is left at the end of a range: a part of an element, or bytes between elements."""
            if depth:
                return [(here[0], owner, here[1], b"".join(held))]
            return stray()

        def stray():
            found = b"".join(between).strip(grammar.filler) if grammar.filler is not None else b""
            between.clear()
            return [(None, None, None, found)] if found else []

        for file, block, data in _ranges(batches, grammar.separator.encode()):
            found = []
            if (file, block) != here:
                if here is not None:
                    found += rest()
                here = (file, block)
                if here not in entries:
                    raise ValueError(f"the ranges of {file} changed between two reads of it; read it again")
                state, depth, owner = entries[here]
                held, between = [], []
            events, state = grammar.scan(data, state)
            at = 0  # where the bytes begin that are neither held nor between
            for first, last, step in events:
                if depth == 0 and step != CLOSE:
                    between.append(data[at:first])
                    found += stray()
                    at = first
                    if step == ALONE:
                        found.append((None, None, None, data[first:last]))
                        at = last
                    else:
                        depth, owner = 1, block
                elif step == OPEN:
                    depth += 1
                elif step == CLOSE and depth:
                    depth -= 1
                    if depth == 0:
                        held.append(data[at:last])
                        whole = b"".join(held)
                        # An element that began in another range is a part of it here.
                        found.append((None, None, None, whole) if owner == block else (file, owner, block, whole))
                        held, at = [], last
            (held if depth else between).append(data[at:])
            if grammar.filler is None:
                between.clear()
            if found:
                yield rows(found)
        if here is not None:
            yield rows(rest())

    return cut


def split_elements(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """(element): the text of each outermost element under ``path``, a written table.

    An element that never closes goes to the end of its file. Bytes that are no UTF-8 become replacement characters. A
    task holds one Arrow batch of the file and one element.
    """
    ship(spark)
    records = spark.read.option("lineSep", grammar.separator).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )
    notes = records.mapInArrow(_survey(grammar), "file string, block long, start string, state string, change long, low long")
    shared = spark.sparkContext.broadcast(_entries(notes.collect()))
    pieces = written(records.mapInArrow(_cut(grammar, shared), _PIECE), "elements")
    shared.unpersist()
    whole = pieces.filter(F.col("file").isNull()).select("element")
    parts = pieces.filter(F.col("file").isNotNull()).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("part", "element"))).alias("parts")
    )
    return whole.unionByName(parts.select(F.array_join("parts.element", "").alias("element")))
