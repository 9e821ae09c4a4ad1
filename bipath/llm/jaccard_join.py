"""Size-aware heavy-light similarity join on sets of word shingles, with components of the links.

Two sets of sizes s and t have a Jaccard similarity of at least p % when they share at least
c(s, t) = ceil(p (s + t) / (100 + p)) shingles.

- **Light sets** (at most ``boundary`` shingles) enumerate their subsets of the fixed sizes c(s, t). Two light
  sets link exactly when they share a subset of size c(s, t), so no further check is needed; within the
  holders of one subset, a star around the smallest set links all that belong together.
- **Heavy sets** scan inverted lists. In an order of all shingles that puts common ones last, two linked sets
  share one of their first s - c + 1, so only lists of those are kept, for heavy sets and for light ones near
  the boundary. A row whose list holds no set of a fitting size goes at once. Within a list, the parity of a
  set's shingles over as many bits or more gives a lower bound of how far two sets differ and rules pairs out.
- The **boundary** is where enumerating a set's subsets costs more than scanning its lists, by
  the counts of a sample of the documents.

Candidates leave a list as a forest, not as pairs, so groups of near copies stay linear in output. Sets that
candidates connect are compared in full, in square blocks of bounded size, and the verified links again leave
a block as a forest. Equal sets are one set from the start. No candidate is dropped.

A list or cluster of several blocks first meets a few pivots of its own. The sets that link with the best pivot
are in one component, so pairs among them need no look; only pairs with one of the others do. The work of a
large group of near copies thus grows with its size, and with its square only for what no pivot reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bipath.llm.components import connected_components, spanning_forest
from bipath.llm.hot import left_join_spread
from bipath.llm.streams import batch_of, changes, column, longs, routed, run_starts, signed, unsigned, whole_groups
from bipath.llm.words import mix, ngrams, pieces, words_of
from bipath.runtime import written

PERCENT = 90
SHINGLE = 3
SAMPLE_DOCUMENTS = 2_000  # read by the cost estimate; more than this only makes it finer
COMMON_SHINGLES = 50_000  # most shingles that the order puts last
LARGEST_BOUNDARY = 24
LEAST_BITS = 1024
BLOCK = 512  # sets in one side of a compared block
LIST_BLOCK = 2_048  # rows in one side of a compared block of an inverted list
PIVOTS = 3  # of a group of several blocks
_SUBSET = np.uint64(0xA24BAED4963EE407)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64))


def overlap(s, t, percent: int):
    """The least number of common shingles of linked sets of sizes s and t."""
    return -((-percent * (s + t)) // (100 + percent))


def _fits(small, large, percent: int):
    return 100 * small >= percent * large


@lru_cache(maxsize=None)
def subset_sizes(n: int, percent: int) -> tuple[int, ...]:
    partners = range(math.ceil(percent * n / 100), 100 * n // percent + 1)
    return tuple(sorted({overlap(n, t, percent) for t in partners if overlap(n, t, percent) <= n}))


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


def prefix_length(n, percent: int):
    """How many of the first shingles one has to look at: all links need percent % of the larger set."""
    return n + (-percent * n) // 100 + 1


# -- sets ------------------------------------------------------------------------------------


class Sets:
    """The shingle sets of a batch: ``values[first[i]:first[i + 1]]`` is sorted and distinct."""

    def __init__(self, texts: pa.Array, size: int):
        words = words_of(texts, lower=True)
        grams, _, docs = ngrams(words, size)
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < size))
        # The whole of a shorter text is its one shingle.
        whole = [mix(words.hashes[a:b] + _PLACE[: b - a]).sum(dtype=np.uint64) for a, b in zip(words.first[short], words.first[short + 1])]
        grams = np.concatenate([grams, mix(np.array(whole, np.uint64))])
        docs = np.concatenate([docs, short])
        order = np.lexsort((grams, docs))
        grams, docs = grams[order], docs[order]
        once = changes(docs, grams)
        self.values, self.owner = grams[once], docs[once]
        self.first = np.searchsorted(self.owner, np.arange(len(count) + 1))
        self.n = np.diff(self.first)
        total = np.zeros(len(self.values) + 1, np.uint64)
        np.cumsum(mix(self.values ^ _SUBSET), out=total[1:])
        keys = total[self.first[1:]] - total[self.first[:-1]]
        self.key = signed(mix(keys + self.n.astype(np.uint64)))

    def parity(self) -> pa.Array:
        """For each set, which of its bits an odd number of its shingles fall on; larger sets have more bits."""
        bits = parity_bits(self.n)
        first = np.concatenate([[0], np.cumsum(bits)])
        spot = first[self.owner] + ((self.values >> np.uint64(20)).astype(np.int64) & (bits[self.owner] - 1))
        odd = np.bincount(spot, minlength=int(first[-1])).astype(np.uint8) & 1
        packed = np.packbits(odd).tobytes()
        return pa.array([packed[i // 8 : j // 8] for i, j in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())


def parity_bits(n: np.ndarray) -> np.ndarray:
    """A power of two that is at least the size of the set, and LEAST_BITS."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _describe(shingle: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = Sets(column(batch, "text"), shingle)
            yield batch_of(
                doc_id=column(batch, "doc_id"),
                n=sets.n.astype(np.int64),
                t=pa.array(sets.key, mask=sets.n == 0),
                parity=sets.parity(),
            )

    return describe


# -- order and boundary ------------------------------------------------------------------------


def _tokens(shingle: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch_of(token=signed(Sets(column(batch, "text"), shingle).values))

    return tokens


def common_shingles(source: DataFrame, shingle: int, documents: int) -> np.ndarray:
    """At most COMMON_SHINGLES shingles of a sample that come in one document of a thousand or more.

    They only set the order of the shingles, so neither the sample nor the bound changes a result.
    """
    share = SAMPLE_DOCUMENTS / max(documents, 1)
    chosen = source.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    counts = chosen.mapInArrow(_tokens(shingle), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    most = counts.filter(F.col("n") >= max(3, SAMPLE_DOCUMENTS // 1000)).orderBy(F.desc("n"), "token").limit(COMMON_SHINGLES)
    rows = most.toArrow()
    return np.sort(unsigned(rows.column("token").to_numpy()))


def light_boundary(sizes: dict[int, int], documents: int, percent: int) -> int:
    """The largest size up to which a set's subsets cost no more than the scan of its lists.

    A list of a common shingle is taken to hold the sets of a fitting size among one document of a
    thousand; ``sizes`` counts the sets of each size up to LARGEST_BOUNDARY.
    """
    boundary = 0
    for n in range(1, LARGEST_BOUNDARY + 1):
        near = sum(sizes.get(m, 0) for m in range(n, 100 * n // percent + 1))
        scan = prefix_length(n, percent) * (1 + near / 1000)
        if subset_count(n, percent) > max(scan, 2):
            break
        boundary = n
    return boundary


# -- candidates ------------------------------------------------------------------------------


def _postings(shingle: int, percent: int, boundary: int, common):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in pieces(batches, "text"):
            sets = Sets(column(batch, "text"), shingle)
            _, once = np.unique(sets.key, return_index=True)
            fresh = np.zeros(len(sets.n), bool)
            fresh[once] = True
            fresh &= sets.n > 0
            light = sets.n <= boundary
            listed = fresh & (100 * sets.n // percent > boundary)  # heavy, or may meet a heavy set
            use = listed[sets.owner]
            values, owner = sets.values[use], sets.owner[use]
            late = np.isin(values, last)
            order = np.lexsort((values, late, owner))
            values, owner = values[order], owner[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            head = place < prefix_length(sets.n[owner], percent)
            keys, own, sizes = [values[head]], [owner[head]], [np.zeros(head.sum(), np.int64)]
            for i in np.flatnonzero(fresh & light):
                parts = mix(sets.values[sets.first[i] : sets.first[i + 1]] ^ _SUBSET)
                for c in subset_sizes(int(sets.n[i]), percent):
                    gone = np.array(list(combinations(range(len(parts)), len(parts) - c)), np.int64)
                    rest = np.full(len(gone), parts.sum(), np.uint64)
                    if gone.size:
                        rest = rest - parts[gone].sum(axis=1, dtype=np.uint64)
                    keys.append(mix(rest + np.uint64(c * int(_SUBSET) % (1 << 64))))
                    own.append(np.full(len(rest), i))
                    sizes.append(np.full(len(rest), c))
            own = np.concatenate(own)
            yield batch_of(
                route=signed(np.concatenate(keys)),
                subset=np.concatenate(sizes).astype(np.int32),
                n=sets.n[own].astype(np.int32),
                t=sets.key[own],
            )

    return postings


def _meetings(percent: int):
    """Rows of a list that have a row of a fitting size next to them; links of a shared subset."""

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, None
        for batch in batches:
            rows = [longs(batch, c) for c in ("route", "subset", "n", "t")]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, [*rows, np.zeros(len(rows[0]), bool)])]
            else:
                rows.append(np.zeros(len(rows[0]), bool))
            keep = changes(*rows[:4])
            route, subset, n, t, met = (r[keep] for r in rows)
            near = (route[1:] == route[:-1]) & (subset[1:] == subset[:-1]) & _fits(n[:-1], n[1:], percent)
            met[1:] |= near
            met[:-1] |= near
            done = slice(0, len(route) - 1)
            listed = met[done] & (subset[done] == 0)
            yield batch_of(
                route=route[done][listed], n=n[done][listed].astype(np.int32),
                a=t[done][listed], b=pa.nulls(int(listed.sum()), pa.int64()),
            )
            # The smallest holder of a subset is the centre of its star.
            first = run_starts(changes(route, subset))
            centre_n, centre_t = n[first], t[first]
            if head is not None:
                centre_n[first == 0], centre_t[first == 0] = head
            linked = (subset > 0) & (t != centre_t) & (overlap(n, centre_n, percent) <= subset)
            if held is not None:
                linked[0] = False  # was handled with its own batch
            yield batch_of(
                route=pa.nulls(int(linked.sum()), pa.int64()), n=pa.nulls(int(linked.sum()), pa.int32()),
                a=t[linked], b=centre_t[linked],
            )
            head = centre_n[-1], centre_t[-1]
            held = [r[-1:] for r in (route, subset, n, t, met)]
        if held is not None and held[4][0] and held[1][0] == 0:
            yield batch_of(route=held[0], n=held[2].astype(np.int32), a=held[3], b=pa.nulls(1, pa.int64()))

    return meetings


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


class Parities:
    """The parities of the rows of a block, by their number of bits, to compare one row with others."""

    def __init__(self, raw: list[bytes]):
        self.own = [np.frombuffer(r, np.uint64) for r in raw]
        words = np.array([len(o) for o in self.own])
        self.classes = []
        for size in np.unique(words):
            rows = np.flatnonzero(words == size)
            matrix = np.array([self.own[i] for i in rows])
            self.classes.append((int(size), rows, matrix, _folded(matrix)))

    def apart(self, i: int, js: np.ndarray) -> np.ndarray:
        """A lower bound of how many shingles only one of row i and each row of js (sorted) has."""
        out, mine = np.zeros(len(js), np.int64), self.own[i]
        for size, rows, matrix, half in self.classes:
            at = np.searchsorted(rows, js)
            here = np.flatnonzero(rows[np.minimum(at, len(rows) - 1)] == js)
            if not len(here):
                continue
            # Sizes that fit differ by less than half, so bits differ by one doubling at most.
            if size == len(mine):
                other, own = matrix[at[here]], mine
            elif size == 2 * len(mine):
                other, own = half[at[here]], mine
            elif 2 * size == len(mine):
                other, own = matrix[at[here]], _folded(mine)
            else:
                continue
            out[here] = np.bitwise_count(other ^ own).sum(axis=1, dtype=np.int64)
        return out


def _proposals(percent: int):
    """A forest over the pairs of each list block that size and parity do not rule out."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        cols = {c: table.column(c).to_numpy() for c in ("route", "bi", "bj", "own", "n", "t")}
        parity = table.column("parity")
        new = np.append(np.flatnonzero(changes(cols["route"], cols["bi"], cols["bj"])), table.num_rows)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(new[:-1], new[1:]):
            if hi - lo < 2:
                continue
            n, t, own = cols["n"][lo:hi].astype(np.int64), cols["t"][lo:hi], cols["own"][lo:hi]
            across = cols["bi"][lo] != cols["bj"][lo]
            parities = Parities(parity.slice(lo, hi - lo).to_pylist())
            for i in range(hi - lo - 1):
                js = slice(i + 1, hi - lo)
                fits = _fits(np.minimum(n[i], n[js]), np.maximum(n[i], n[js]), percent) & (t[js] != t[i])
                if across:
                    fits &= own[js] != own[i]
                js = np.flatnonzero(fits) + i + 1
                if not len(js):
                    continue
                js = js[parities.apart(i, js) <= n[i] + n[js] - 2 * overlap(n[i], n[js], percent)]
                if len(js):
                    left.append(np.full(len(js), t[i]))
                    right.append(t[js])
            if sum(map(len, left)) > 1 << 20:
                left, right = ([x] for x in spanning_forest(np.concatenate(left), np.concatenate(right)))
        a, b = spanning_forest(np.concatenate(left), np.concatenate(right))
        yield batch_of(a=a, b=b)

    def proposals(batches):
        yield from whole_groups(batches, ["route", "bi", "bj"], work)

    return proposals


def _near_pivots(percent: int):
    """(route, t, pivot): rows of a list block that size and parity do not part from a pivot of the list."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("route", "bi")]
        n, t, is_pivot = (table.column(c).to_numpy() for c in ("n", "t", "is_pivot"))
        n, parity = n.astype(np.int64), table.column("parity")
        new = np.append(np.flatnonzero(changes(*keys)), table.num_rows)
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        for lo, hi in zip(new[:-1], new[1:]):
            parities = Parities(parity.slice(lo, hi - lo).to_pylist())
            size, own = n[lo:hi], is_pivot[lo:hi]
            for i in np.flatnonzero(own):
                js = np.flatnonzero(~own & _fits(np.minimum(size[i], size), np.maximum(size[i], size), percent))
                js = js[parities.apart(i, js) <= size[i] + size[js] - 2 * overlap(size[i], size[js], percent)]
                for rows, values in zip(found, (keys[0][lo + js], t[lo + js], np.full(len(js), t[lo + i]))):
                    rows.append(values)
        route, node, pivot = map(np.concatenate, found)
        yield batch_of(route=route, t=node, pivot=pivot)

    def near(batches):
        yield from whole_groups(batches, ["route", "bi"], work)

    return near


# -- groups in blocks --------------------------------------------------------------------------


def _with_pivots(rows: DataFrame, group: str, block: int) -> DataFrame:
    """The rows of groups of several blocks, each in its block ``bi``, and the group's pivots in all of them."""
    pivots = F.array_distinct(F.array(*(F.min_by("t", F.xxhash64("t", F.lit(i))) for i in range(PIVOTS))))
    count = F.ceil(F.count(F.lit(1)) / block).cast("int")
    large = rows.groupBy(group).agg(count.alias("blocks"), pivots.alias("pivots")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("t", F.lit(3)), F.col("blocks")).cast("int")
    members = rows.join(large.select(group, "blocks"), group).withColumns({"bi": own, "is_pivot": F.lit(False)})
    chosen = large.select(group, "blocks", F.explode("pivots").alias("t")).join(rows, [group, "t"])
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return members.unionByName(chosen.withColumns({"bi": every, "is_pivot": F.lit(True)})).drop("blocks")


def _settled(links: DataFrame, group: str) -> DataFrame:
    """(group, t, pivot) of the rows that link with the pivot that most rows of their group link with."""
    tally = links.groupBy(group, "pivot").agg(F.count(F.lit(1)).alias("links"))
    best = tally.groupBy(group).agg(F.max_by("pivot", F.struct("links", "pivot")).alias("pivot"))
    return links.join(best, [group, "pivot"]).select(group, "t", "pivot")


def _placed(rows: DataFrame, settled: DataFrame, group: str, block: int) -> DataFrame:
    """Each row with its own block and the last block it meets: open rows meet all blocks, settled ones the open."""
    marks = settled.select(group, "t", F.lit(True).alias("settled"))
    marked = rows.join(marks, [group, "t"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    count = lambda of: F.ceil(F.count_if(of) / block).cast("int")
    blocks = marked.groupBy(group).agg(count(~F.col("settled")).alias("open"), count(F.col("settled")).alias("shut"))
    among = lambda n: F.pmod(F.xxhash64("t", F.lit(3)), F.greatest(F.col(n), F.lit(1))).cast("int")
    own = F.when(F.col("settled"), F.col("open") + among("shut")).otherwise(among("open"))
    last = F.col("open") - 1 + F.when(F.col("settled"), 0).otherwise(F.col("shut"))
    placed = marked.join(blocks, group).withColumns({"own": own, "last": last})
    return placed.filter("last >= 0").drop("settled", "open", "shut")


def _in_blocks(placed: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks (bi <= bj) that it takes part in."""
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return met.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("last", "other")


# -- verification ------------------------------------------------------------------------------


def _values(shingle: int):
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = Sets(column(batch, "text"), shingle)
            # A doc_id may have come with several texts: only the row of this very set stands for it.
            own = np.flatnonzero((sets.n > 0) & (sets.key == longs(batch, "t")))
            raw = [sets.values[sets.first[i] : sets.first[i + 1]].tobytes() for i in own]
            rest = {c: column(batch, c).take(pa.array(own)) for c in batch.schema.names if c != "text"}
            yield batch_of(**rest, n=sets.n[own].astype(np.int32), shingles=pa.array(raw, pa.binary()))

    return values


def _linked_pivots(percent: int):
    """(cluster, t, pivot): rows of a cluster block that are similar to a pivot of the cluster."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("cluster", "bi")]
        n, t, is_pivot = (table.column(c).to_numpy() for c in ("n", "t", "is_pivot"))
        n, shingles = n.astype(np.int64), table.column("shingles")
        new = np.append(np.flatnonzero(changes(*keys)), table.num_rows)
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        for lo, hi in zip(new[:-1], new[1:]):
            sets = [np.frombuffer(shingles[i].as_py(), np.uint64) for i in range(lo, hi)]
            members = np.flatnonzero(~is_pivot[lo:hi])
            if not len(members):
                continue
            values = np.concatenate([sets[j] for j in members])
            owner = np.repeat(np.arange(len(members)), n[lo + members])
            for i in np.flatnonzero(is_pivot[lo:hi]):
                common = np.bincount(owner[np.isin(values, sets[i])], minlength=len(members))
                js = members[100 * common >= percent * (n[lo + i] + n[lo + members] - common)]
                for rows, ids in zip(found, (keys[0][lo + js], t[lo + js], np.full(len(js), t[lo + i]))):
                    rows.append(ids)
        cluster, node, pivot = map(np.concatenate, found)
        yield batch_of(cluster=cluster, t=node, pivot=pivot)

    def linked(batches):
        yield from whole_groups(batches, ["cluster", "bi"], work)

    return linked


def _verified(percent: int):
    """A forest over the pairs of each cluster block that are similar, all shingles compared."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("cluster", "bi", "bj")]
        t, n, own = (table.column(c).to_numpy() for c in ("t", "n", "own"))
        n = n.astype(np.int64)
        shingles = table.column("shingles")
        new = np.append(np.flatnonzero(changes(*keys)), table.num_rows)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(new[:-1], new[1:]):
            if hi - lo < 2:
                continue
            common = _intersections([np.frombuffer(shingles[i].as_py(), np.uint64) for i in range(lo, hi)])
            size = n[lo:hi]
            linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
            i, j = np.nonzero(np.triu(linked, 1))
            if keys[1][lo] != keys[2][lo]:
                apart = own[lo:hi][i] != own[lo:hi][j]
                i, j = i[apart], j[apart]
            a, b = spanning_forest(t[lo:hi][i], t[lo:hi][j])
            left.append(a)
            right.append(b)
        yield batch_of(a=np.concatenate(left), b=np.concatenate(right))

    def verified(batches):
        yield from whole_groups(batches, ["cluster", "bi", "bj"], work)

    return verified


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of membership columns a slice at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[code] > 1
    owner, code = owner[use], shared[code[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = max(1, (2 << 20) // len(sets))
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [at, at + width])
        member = np.zeros((len(sets), width), np.float32)
        member[owner[a:b], code[a:b] - at] = 1
        out += member @ member.T
    return out.astype(np.int64)


# -- the join ----------------------------------------------------------------------------------


def jaccard_components(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``documents``.

    ``documents`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Documents link when 100 *
    intersection >= ``percent`` * union; the component is the least doc_id that links reach. A null text, or
    one without words, has the empty set and links with nothing. Repeated rows get equal results; where one
    doc_id comes with several texts, each row has the component of its own text. Rows with a null
    doc_id take part in no link, and their component is null.
    """
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = written(
        source.mapInArrow(_describe(shingle), "doc_id long, n long, t long, parity binary"), "shingle-sets"
    )
    live = described.filter(F.col("doc_id").isNotNull() & F.col("t").isNotNull())
    counts = live.groupBy(F.least("n", F.lit(LARGEST_BOUNDARY * 2)).alias("n")).agg(F.count(F.lit(1)).alias("sets"))
    sizes = {r["n"]: r["sets"] for r in counts.collect()}
    total = sum(sizes.values())
    boundary = light_boundary(sizes, total, percent)
    common = spark.sparkContext.broadcast(common_shingles(source, shingle, total))

    known = source.filter(F.col("doc_id").isNotNull())
    postings = known.mapInArrow(_postings(shingle, percent, boundary, common), "route long, subset int, n int, t long")
    met = written(
        routed(postings, "route", "subset", "n", "t").mapInArrow(
            _meetings(percent), "route long, n int, a long, b long"
        ),
        "meetings",
    )
    # One row per set: its first document and its parity.
    sets = live.groupBy("t").agg(F.min_by("parity", "doc_id").alias("parity"), F.min("doc_id").alias("first"))
    parities = sets.select("t", "parity")
    listed = met.filter(F.col("b").isNull()).select("route", "n", F.col("a").alias("t"))
    near = (
        _with_pivots(listed, "route", LIST_BLOCK)
        .join(parities, "t")
        .repartition("route", "bi")
        .sortWithinPartitions("route", "bi")
        .mapInArrow(_near_pivots(percent), "route long, t long, pivot long")
    )
    near = _settled(written(near, "near-pivots"), "route")
    lists = _in_blocks(_placed(listed, near, "route", LIST_BLOCK)).join(parities, "t")
    proposed = (
        lists.repartition("route", "bi", "bj")
        .sortWithinPartitions("route", "bi", "bj")
        .mapInArrow(_proposals(percent), "a long, b long")
    )
    proposed = proposed.unionByName(near.select(F.col("t").alias("a"), F.col("pivot").alias("b")).filter("a <> b"))
    clusters = written(connected_components(proposed), "clusters")
    members = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("t")).unionByName(
        clusters.select(F.col("component").alias("cluster"), F.col("component").alias("t")).distinct()
    )

    def compared(rows: DataFrame, places: str) -> DataFrame:
        """The shingles of each row, from the text of the first document that has the set."""
        # Written, so that the planner knows its size and moves the texts only where it must.
        firsts = written(rows.join(sets.select("t", F.col("first").alias("doc_id")), "t"), "firsts")
        texts = known.join(firsts, "doc_id").select(*rows.columns, "text")
        return texts.mapInArrow(_values(shingle), f"{places}, n int, shingles binary")

    linked_pivots = (
        compared(_with_pivots(members, "cluster", BLOCK), "cluster long, t long, bi int, is_pivot boolean")
        .repartition("cluster", "bi")
        .sortWithinPartitions("cluster", "bi")
        .mapInArrow(_linked_pivots(percent), "cluster long, t long, pivot long")
    )
    settled = _settled(written(linked_pivots, "linked-pivots"), "cluster")
    verified = (
        _in_blocks(compared(_placed(members, settled, "cluster", BLOCK), "cluster long, t long, own int, last int"))
        .repartition("cluster", "bi", "bj")
        .sortWithinPartitions("cluster", "bi", "bj")
        .mapInArrow(_verified(percent), "a long, b long")
    )
    verified = verified.unionByName(settled.select(F.col("t").alias("a"), F.col("pivot").alias("b")).filter("a <> b"))
    subsets = met.filter(F.col("b").isNotNull()).select("a", "b")
    found = written(connected_components(verified.unionByName(subsets)), "components")
    linked = sets.select("t", "first").join(found.withColumnRenamed("node", "t"), "t", "left")
    linked = linked.select("t", "first", F.coalesce("component", "t").alias("group"))
    least = linked.groupBy("group").agg(F.min("first").alias("component_id"))
    labels = linked.join(least, "group").select("t", "component_id")
    return left_join_spread(described, labels, "t", "doc_id").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
