"""Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

A leaf is the digest of one row. The leaves of a tree (here: a language) stand in rank order; every ``fanout``
consecutive nodes become the digest of their digests until one is left, the subroot. The subroots form one more
such tree, whose last node is the root.

The DAG is stored as digest-to-children records, those of ``fanout ** digits`` neighbouring nodes in one row (a
page), under the digest of the page's own top node. A page is built by one task from a bounded group, so
neither a tree that holds most rows nor many small ones change the work of a task.

Requests name a tree and a rank. They descend together: a step joins the distinct rank prefixes that are asked
for with the record of the digest reached there, takes ``digits`` rank digits inside the page, collects the
children that were not selected, and goes on to the next page. The path of a page is carried once for all
requests below it, and only the last step unfolds it for each leaf, reversed, as a proof runs from the leaf to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bipath.llm.streams import column
from bipath.operators.indexing import dense_index
from bipath.runtime import written

FANOUT = 2
DIGITS = 6  # rank digits of a page
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
OUTPUT_ROWS = 2048  # rows of a batch that a task gives back

_PATH = "array<struct<place:int,others:array<string>>>"
_PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    shown = [v.cast("string") for v in values]
    sized = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]
    return F.sha2(F.concat(*sized), 256)


@dataclass
class Manifest:
    """``leaves`` (tree, rank, n, digest and the columns kept), ``trees`` (tree, subroot, hops, place), the records
    (digest, depth, node, children) by height of their pages, those of the subroots' tree as well, and the root."""

    leaves: DataFrame
    trees: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    root: str | None
    fanout: int
    digits: int


# --- building ---------------------------------------------------------------------------------------------------


def _raise(level: list[str], fanout: int, depth: int | None) -> tuple[str, int, list[tuple[str, list[str]]]]:
    """(top digest, levels climbed, records) over ``depth`` levels, or up to a single node."""
    records, climbed = [], 0
    while len(level) > 1 if depth is None else climbed < depth:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        level = [digest_of(run) for run in runs]
        records += zip(level, runs)
        climbed += 1
    return level[0], climbed, records


_PAGES = "tree string, rank long, n long, digest string, depth int, node array<string>, children array<array<string>>"


def _pages(fanout: int, digits: int):
    width = fanout**digits

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("digest", "depth", "node", "children")}
            for row in batch.select(["n", "members"]).to_pylist():
                level = [m["digest"] for m in row["members"]]
                top, depth, records = _raise(level, fanout, None if row["n"] <= width else digits)
                out["digest"].append(top)
                out["depth"].append(depth)
                out["node"].append([d for d, _ in records])
                out["children"].append([c for _, c in records])
            n = [-(-x // width) for x in column(batch, "n").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "tree"), column(batch, "page"), pa.array(n, pa.int64()),
                    pa.array(out["digest"], pa.string()), pa.array(out["depth"], pa.int32()),
                    pa.array(out["node"], pa.list_(pa.string())), pa.array(out["children"], pa.list_(pa.list_(pa.string()))),
                ],
                names=["tree", "rank", "n", "digest", "depth", "node", "children"],
            )

    return pages


def build(leaves: DataFrame, fanout: int, digits: int) -> tuple[list[DataFrame], DataFrame]:
    """(records by height, (tree, digest, hops)) of ``leaves`` (tree, rank, n, digest); n is the tree's number of leaves.

    Each round raises all trees by one page; it ends when none has two nodes left.
    """
    width, hops = fanout**digits, 0
    records, roots = [], []
    level = leaves.select("tree", "rank", "n", "digest")
    while True:
        hops += 1
        grouped = level.groupBy("tree", F.floor(F.col("rank") / width).cast("long").alias("page")).agg(
            F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("members")
        )
        made = written(grouped.mapInArrow(_pages(fanout, digits), _PAGES), "merkle-pages")
        records.append(made.select("digest", "depth", "node", "children"))
        roots.append(made.filter("n = 1").select("tree", "digest", F.lit(hops).alias("hops")))
        level = made.filter("n > 1").select("tree", "rank", "n", "digest")
        if level.isEmpty():
            break
    return records, reduce(DataFrame.unionByName, roots)


def manifest(
    documents: DataFrame,
    columns: tuple[str, ...] = LEAF_COLUMNS,
    tree: str = "lang",
    order: str = "doc_id",
    keep: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    digits: int = DIGITS,
) -> Manifest:
    """The manifest of ``documents``: a leaf for each row, a tree for each value of ``tree`` (null first, then by bytes).

    Leaves ascend by ``order`` (null first); rows that are equal in it ascend by their digest, and equal rows are
    leaves of their own. ``keep`` names further columns that go along with the leaves. Other columns are ignored.
    An empty table has no leaf and no root. Texts are hashed where they are read and never shuffled.
    """
    extra = {f"kept_{k}": c for k, c in (keep or {}).items()}
    hashed = documents.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("order"),
        leaf_digest(*(F.col(c) for c in columns)).alias("leaf"),
        *(c.alias(k) for k, c in extra.items()),
    )
    placed = dense_index(hashed, F.col("tree"), F.col("order").asc_nulls_first(), F.col("leaf"), name="at")
    sizes = written(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    leaves = written(
        placed.join(sizes, "tree").select(
            "tree", (F.col("at") - F.col("first")).alias("rank"), "n", F.col("leaf").alias("digest"), *extra
        ),
        "merkle-leaves",
    )
    records, subroots = build(leaves, fanout, digits)
    trees = written(dense_index(subroots.withColumnRenamed("digest", "subroot"), F.col("tree"), name="place"), "merkle-subroots")
    above = trees.select(
        F.lit("").alias("tree"), F.col("place").alias("rank"), F.lit(trees.count()).alias("n"), F.col("subroot").alias("digest")
    )
    top_records, top = build(above, fanout, digits)
    root = top.first()
    return Manifest(leaves, trees, records, top_records, root["digest"] if root else None, fanout, digits)


# --- descent ----------------------------------------------------------------------------------------------------


def _walk(children_of: dict[str, list[str]], top: str, offset: int, depth: int, fanout: int):
    """(digest reached, path from the top down) of the node at ``offset`` below ``top``; (None, []) if there is none."""
    path, at = [], top
    if offset >= fanout**depth:
        return None, path
    for place in range(depth - 1, -1, -1):
        digit = offset // fanout**place % fanout
        run = children_of[at]
        if digit >= len(run):
            return None, []
        path.append({"place": digit, "others": run[:digit] + run[digit + 1 :]})
        at = run[digit]
    return at, path


def _rows(batch: pa.RecordBatch, fanout: int):
    """(row, its requests with the digest and the path from the root to each)."""
    for row in batch.to_pylist():
        children_of = dict(zip(row["node"], row["children"]))
        below = []
        for asked in row["asked"]:
            at, path = _walk(children_of, row["digest"], asked["offset"], row["depth"], fanout)
            if at is not None:
                below.append((asked, at, row["path"] + path))
        yield row, below


_STATE = f"tree string, subroot string, page long, digest string, path {_PATH}"


def _step(width: int, fanout: int):
    """From a page to those of its nodes that are asked for."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = {k: [] for k in ("tree", "subroot", "page", "digest", "path")}
                for row, below in _rows(batch.slice(i, 1), fanout):
                    for asked, at, path in below:
                        out["tree"].append(row["tree"])
                        out["subroot"].append(row["subroot"])
                        out["page"].append(row["page"] * width + asked["offset"])
                        out["digest"].append(at)
                        out["path"].append(path)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["tree"], pa.string()), pa.array(out["subroot"], pa.string()), pa.array(out["page"], pa.int64()),
                     pa.array(out["digest"], pa.string()), pa.array(out["path"], _PATH_TYPE)],
                    names=list(out),
                )

    return step


def fold(digest: str, path: list[dict]) -> str:
    """The root that follows from a leaf's digest and its path, nearest level first."""
    for level in path:
        run = level["others"]
        digest = digest_of([*run[: level["place"]], digest, *run[level["place"] :]])
    return digest


_PROOF = "tree string, rank long, id {id}, leaf string, subroot string, proof array<string>, proof_sha256 string, folded_root string"


def _prove(width: int, fanout: int, with_proof: bool, id_type: pa.DataType):
    """The last step: the leaf of each request, its proof, and the root that its claimed digest folds to."""

    def flush(out):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(out["tree"], pa.string()), pa.array(out["rank"], pa.int64()), pa.array(out["id"], id_type),
                pa.array(out["leaf"], pa.string()), pa.array(out["subroot"], pa.string()), pa.array(out["proof"], pa.list_(pa.string())),
                pa.array(out["proof_sha256"], pa.string()), pa.array(out["folded_root"], pa.string()),
            ],
            names=list(out),
        )

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tree", "rank", "id", "leaf", "subroot", "proof", "proof_sha256", "folded_root")
        out = {k: [] for k in names}
        for batch in batches:
            for i in range(batch.num_rows):
                for row, below in _rows(batch.slice(i, 1), fanout):
                    for asked, leaf, path in below:
                        path = path[::-1]
                        proof = [d for level in path for d in level["others"]]
                        claimed = leaf if asked["claimed"] is None else asked["claimed"]
                        values = (row["tree"], row["page"] * width + asked["offset"], asked["id"], leaf, row["subroot"],
                                  proof if with_proof else None, digest_of(proof), fold(claimed, path))
                        for k, v in zip(names, values):
                            out[k].append(v)
                if len(out["tree"]) >= OUTPUT_ROWS:
                    yield flush(out)
                    out = {k: [] for k in names}
        if out["tree"]:
            yield flush(out)

    return prove


def _descend(start: DataFrame, records: list[DataFrame], asked: DataFrame, width: int, step, last) -> DataFrame:
    """What ``last`` makes of the requests ``asked`` (tree, page, asked: array of struct with offset).

    ``start`` is (tree, subroot, hops, digest, path). All trees of one height step down together, and a smaller tree comes in
    where the larger ones have reached its height. Pages are found by their digest alone.
    """
    wanted = [asked]
    for _ in records[1:]:
        page, offset = F.floor(F.col("page") / width).cast("long"), (F.col("page") % width).cast("int")
        wanted.append(written(
            wanted[-1].groupBy("tree", page.alias("page")).agg(F.collect_list(F.struct(offset.alias("offset"))).alias("asked")),
            "merkle-wanted",
        ))
    state = None
    for height in range(len(records), 0, -1):
        new = start.filter(F.col("hops") == height).select("tree", "subroot", F.lit(0).cast("long").alias("page"), "digest", "path")
        state = new if state is None else state.unionByName(new)
        unique = records[height - 1].dropDuplicates(["digest"])
        joined = state.join(wanted[height - 1], ["tree", "page"]).join(unique, "digest")
        joined = joined.select("tree", "subroot", "page", "digest", "path", "asked", "depth", "node", "children")
        if height > 1:
            state = written(joined.mapInArrow(*step), "merkle-paths")
    return joined.mapInArrow(*last)


def proofs(made: Manifest, requests: DataFrame, with_proof: bool = True) -> DataFrame:
    """(tree, rank, id, leaf, subroot, proof, proof_sha256, folded_root, root, verified) for each row of ``requests``.

    ``requests`` holds tree, rank, id (any value to know a request by) and claimed, the digest to be checked; a null
    stands for the stored leaf. Requests for a tree or rank that is not there are left out. Those for one page stay together, so
    ask for a rank a bounded number of times. ``proof`` lists the siblings from the leaf's level through the subroot to
    the root, each level from left to right; it is null without ``with_proof``. proof_sha256 is the digest of their
    concatenation, that of nothing where there are none. ``verified`` says whether the claimed leaf folds to the root.
    """
    width = made.fanout**made.digits
    page = F.floor(F.col("rank") / width).cast("long").alias("page")
    offset = (F.col("rank") % width).cast("int").alias("offset")
    step = (_step(width, made.fanout), _STATE)
    # Paths to the subroots, which are as many as there are trees.
    places = made.trees.select(F.lit("").alias("tree"), F.col("place").alias("rank"))
    places = places.groupBy("tree", page).agg(F.collect_list(F.struct(offset)).alias("asked"))
    start = requests.sparkSession.createDataFrame(
        [("", None, len(made.top_records), made.root, [])] if made.root else [],
        f"tree string, subroot string, hops int, digest string, path {_PATH}",
    )
    above = _descend(start, made.top_records, places, width, step, step)
    reached = above.select(F.col("page").alias("place"), "path")
    start = made.trees.join(reached, "place").select("tree", "subroot", "hops", F.col("subroot").alias("digest"), "path")
    start = written(start, "merkle-tops")
    asked = requests.filter((F.col("rank") >= 0) & F.col("tree").isNotNull())
    groups = asked.groupBy("tree", page).agg(F.collect_list(F.struct(offset, "id", "claimed")).alias("asked"))
    groups = written(groups, "merkle-requests")
    id_type = requests.schema["id"].dataType
    last = (_prove(width, made.fanout, with_proof, to_arrow_type(id_type)), _PROOF.format(id=id_type.simpleString()))
    found = _descend(start, made.records, groups, width, step, last)
    root = F.lit(made.root).cast("string")
    return found.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)
