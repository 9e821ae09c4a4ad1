"""Line dedup: two Bloom filters, and exact confirmation of what they suspect.

1. **Filters.** Every task sets the bits of its lines' keys in two Bloom filters of one shape: a bit that is set anew goes
   into the once-seen filter, one that was set before into the twice-seen filter. The filters of the tasks meet block by
   block: a bit that two once-seen filters hold is seen twice. A key that occurs twice anywhere has
   all its bits in the twice-seen filter; other keys are there only by chance.
2. **Suspects.** Only the twice-seen filter goes back to the tasks. Documents without a suspected line are done where they are
   read. The others go on, with the digests of their suspected lines.
3. **Confirmation.** A digest's documents are counted, pre-aggregated where they are read, and its last document is found. The
   most frequent digests, a fixed number, are broadcast, so the rest that meet by a shuffle hold a
   small share of the lines each. What is to be dropped goes back to its document by the row's own key.

The filters take ``BITS_PER_LINE`` bits for each line that could hold a key, up to ``MOST_BITS`` (32 MB for each). That is the bound of
what is collected and broadcast. Where more lines come, more of them are suspected by chance and confirmed by the
shuffle; the result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.streams import batch_of, column, longs, signed
from bipath.llm.words import _BYTE_POWERS, _BYTE_VALUE, _LOWER, _SPACE, mix, pieces, sha256_hex, text_bytes
from bipath.runtime import written

LEAST_CHARACTERS = 40
LEAST_DOCUMENTS = 5
BITS_PER_LINE = 16
HASHES = 4
MOST_BITS = 1 << 28
BLOCK_BITS = 1 << 17  # of the filters, as they are merged
HEAVY_DIGESTS = 1000  # the most frequent repeated lines, which are broadcast
NO_ID = -(1 << 63)


class Lines:
    """The lines of a batch of texts; those of row r are ``first[r]:first[r + 1]``.

    ``start`` and ``end`` bound the whole line, ``left`` and ``right`` its key without outer white space, as
    byte offsets into ``data``. ``long`` tells the keys of at least ``least`` code points.
    """

    def __init__(self, texts: pa.Array, least: int):
        self.data, offsets = text_bytes(texts)
        size = len(self.data)
        breaks = np.flatnonzero(self.data == 0x0A)
        # A line begins where a text does and after each break, and ends at each break and where a text does.
        self.start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        counts = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
        self.first = np.concatenate([[0], np.cumsum(counts)])
        solid = np.flatnonzero(~_SPACE[self.data]) if size else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        any_left = hi > lo
        solid = np.append(solid, size)
        self.left = np.where(any_left, solid[lo], self.start)
        self.right = np.where(any_left, solid[np.maximum(hi, 1) - 1] + 1, self.start)
        letters = np.zeros(size + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=letters[1:])
        self.long = letters[self.right] - letters[self.left] >= least

    def rows(self) -> np.ndarray:
        """The row of each line."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the keys, A-Z as a-z."""
        up, down = _BYTE_POWERS.upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[_LOWER[self.data]] * up[: len(self.data)], out=total[1:])
        value = (total[self.right] - total[self.left]) * down[self.left]
        return mix(value ^ (self.right - self.left).astype(np.uint64))

    def key(self, line: int) -> bytes:
        return _LOWER[self.data[self.left[line] : self.right[line]]].tobytes()


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(keys, HASHES) positions of each key in a filter of ``bits`` bits, a power of two."""
    step = mix(hashes) | np.uint64(1)
    return (hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


class Filter:
    """The once-seen and the twice-seen filter of a task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        positions, counts = np.unique(bit_positions(hashes, self.bits), return_counts=True)
        positions = positions.astype(np.int64)
        again = (counts > 1) | has_bits(self.once, positions)
        _set(self.twice, positions[again])
        _set(self.once, positions)


def has_bits(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bits[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def _set(bits: np.ndarray, positions: np.ndarray) -> None:
    """Sets ascending, distinct positions."""
    if len(positions):
        at = positions >> 3
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        values = np.left_shift(np.uint8(1), (positions & 7).astype(np.uint8))
        bits[at[first]] |= np.bitwise_or.reduceat(values, first)


def suspected(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which keys have all their bits in the twice-seen filter."""
    if not len(hashes):
        return np.zeros(0, bool)
    positions = bit_positions(hashes, len(twice) * 8).astype(np.int64)
    return has_bits(twice, positions.ravel()).reshape(positions.shape).all(axis=1)


# --- filters ----------------------------------------------------------------------------------------------------

_BLOCK = "block int, once binary, twice binary"


def _pack(bits: np.ndarray) -> bytes:
    return pa.compress(bits.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)


def _local_filters(bits: int, least: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Filter(bits)
        for batch in pieces(batches, "text"):
            lines = Lines(column(batch, "text"), least)
            found.add(lines.hashes()[lines.long])
        size = min(BLOCK_BITS, bits) // 8
        for block in range(bits // 8 // size):
            once, twice = (x[block * size : (block + 1) * size] for x in (found.once, found.twice))
            if once.any():
                yield batch_of(
                    block=pa.array([block], pa.int32()),
                    once=pa.array([_pack(once)], pa.binary()), twice=pa.array([_pack(twice)], pa.binary()),
                )

    return build


def _merged(bits: int):
    """(block, twice): the twice-seen bits of all tasks; holds one block."""
    size = min(BLOCK_BITS, bits) // 8

    def rows(batches):
        for batch in batches:
            yield from zip(*(column(batch, c).to_pylist() for c in ("block", "once", "twice")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in groupby(rows(batches), key=lambda r: r[0]):
            once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
            for _, one, two in parts:
                one = _unpack(one, size)
                twice |= _unpack(two, size) | (once & one)
                once |= one
            yield batch_of(block=pa.array([block], pa.int32()), twice=pa.array([_pack(twice)], pa.binary()))

    return merge


def filter_bits(texts: DataFrame, least: int, most: int = MOST_BITS) -> int:
    """The size of each filter: a power of two for the lines that may hold a key, at most ``most``."""
    size = F.octet_length("text")
    held = F.least(F.floor(size / least), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    lines = texts.filter(size >= least).agg(F.sum(held)).first()[0] or 0
    return min(most, max(1 << 13, 1 << (BITS_PER_LINE * int(lines)).bit_length()))


def twice_seen(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """The bits of the twice-seen filter of all texts: ``bits`` / 8 bytes, which is the bound of what the driver gets."""
    local = texts.mapInArrow(_local_filters(bits, least), _BLOCK)
    merged = local.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(bits), "block int, twice binary")
    size = min(BLOCK_BITS, bits) // 8
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        whole[row["block"] * size : (row["block"] + 1) * size] = _unpack(bytes(row["twice"]), size)
    return whole


# --- suspects, confirmation ---------------------------------------------------------------------------------------

_RESULT = "n_lines long, n_dropped long, kept_sha256 string, kept string"


def _suspects(filter_of, least: int, with_text: bool):
    """Rows without a suspected line are settled; the others keep their text and list the digests of those lines."""
    listed = pa.list_(pa.struct([("line", pa.int64()), ("digest", pa.binary())]))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(pa.decompress(*filter_of.value, codec="zstd"), np.uint8)
        for batch in pieces(batches, "text"):
            texts = column(batch, "text")
            lines = Lines(texts, least)
            at = np.flatnonzero(lines.long)
            at = at[suspected(twice, lines.hashes()[at])]
            rows = lines.rows()[at]
            held = np.bincount(rows, minlength=batch.num_rows) > 0
            out = [[] if h else None for h in held.tolist()]
            for line, row in zip(at.tolist(), rows.tolist()):
                digest = hashlib.blake2b(lines.key(line), digest_size=16).digest()
                out[row].append({"line": line - int(lines.first[row]), "digest": digest})
            whole = [None if h else (t or "") for h, t in zip(held.tolist(), texts.to_pylist())]
            yield batch_of(
                doc_id=column(batch, "doc_id"),
                suspects=pa.array(out, listed),
                text=pa.array([t if h else None for h, t in zip(held.tolist(), texts.to_pylist())], pa.string()),
                n_lines=np.diff(lines.first),
                n_dropped=np.zeros(batch.num_rows, np.int64),
                kept_sha256=pa.array([None if t is None else sha256_hex(t.encode()) for t in whole], pa.string()),
                kept=pa.array(whole if with_text else [None] * batch.num_rows, pa.string()),
            )

    return suspects


def _cut(with_text: bool):
    """Texts without their dropped lines."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n_dropped, digests, kept = [], [], []
            for text, dropped in zip(column(batch, "text"), column(batch, "dropped")):
                gone = set(dropped.as_py() or ())
                whole = (text.as_py() or "").encode()
                if gone:
                    whole = b"\n".join(x for i, x in enumerate(whole.split(b"\n")) if i not in gone)
                n_dropped.append(len(gone))
                digests.append(sha256_hex(whole))
                kept.append(whole.decode() if with_text else None)
            yield batch_of(
                doc_id=column(batch, "doc_id"), n_lines=column(batch, "n_lines"), n_dropped=pa.array(n_dropped, pa.int64()),
                kept_sha256=pa.array(digests, pa.string()), kept=pa.array(kept, pa.string()),
            )

    return cut


def line_dedup(
    documents: DataFrame,
    least_characters: int = LEAST_CHARACTERS,
    least_documents: int = LEAST_DOCUMENTS,
    with_text: bool = True,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept): one row for each row of ``documents``.

    Lines end at ``\\n`` alone. A line's key is the line without white space (``\\x20``, ``\\x09``-``\\x0D``) at both ends, A-Z
    lower-cased. A key of at least ``least_characters`` code points that ``least_documents`` documents hold loses all its lines but
    those of the greatest doc_id that holds it, where all of them stay.

    A null or empty text is one empty line. Rows with one doc_id are one document; rows without an id are together
    one that comes before all others. Other columns are ignored. ``kept`` is null without ``with_text``. Keys are
    compared by 64-bit hashes in the filters, which can only suspect too much, and by 128-bit digests after that.
    """
    if least_documents < 2:
        raise ValueError("a line of a single document is not repeated")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = filter_bits(source, least_characters, most_bits)
    twice = twice_seen(source.select("text"), bits, least_characters).tobytes()
    shared = source.sparkSession.sparkContext.broadcast((pa.compress(twice, codec="zstd", asbytes=True), len(twice)))
    listed = "suspects array<struct<line:long,digest:binary>>"
    read = written(
        source.mapInArrow(_suspects(shared, least_characters, with_text), f"doc_id long, {listed}, text string, {_RESULT}")
        .withColumn("row", F.monotonically_increasing_id()),
        "line-suspects",
    )
    shared.unpersist()
    lines = read.select("row", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.explode("suspects").alias("s"))
    lines = lines.select("row", "id", "s.line", "s.digest")
    counts = lines.groupBy("digest").agg(F.count_distinct("id").alias("n"), F.count(F.lit(1)).alias("size"), F.max("id").alias("last"))
    repeated = written(counts.filter(F.col("n") >= least_documents), "repeated-lines")
    heavy = repeated.orderBy(F.col("size").desc(), "digest").limit(HEAVY_DIGESTS).select("digest", "last")
    heavy = F.broadcast(written(heavy, "heavy-lines"))
    light = lines.join(heavy, "digest", "left_anti").join(repeated.select("digest", "last"), "digest")
    both = lines.join(heavy, "digest").unionByName(light).filter(F.col("id") != F.col("last"))
    dropped = both.groupBy("row").agg(F.collect_set("line").alias("dropped"))
    settled = read.filter(F.col("suspects").isNull())
    rest = read.filter(F.col("suspects").isNotNull()).select("row", "doc_id", "text", "n_lines").join(dropped, "row", "left")
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]
    return settled.select(names).unionByName(rest.mapInArrow(_cut(with_text), f"doc_id long, {_RESULT}").select(names))
