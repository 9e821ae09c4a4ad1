"""Mixing sources to target weights, with DataFrame functions alone.

The words of a source are laid end to end and cut into blocks of ``BLOCK`` words. A source's target says how often it
goes round all its blocks, and how many words of one more round it takes; that makes its slots. All slots get a
place in the output by a pseudorandom permutation and every ``SHARD`` places are a shard, so the source
counts of a shard are a multinomial draw, given that the totals are the targets. The slots of one round map to
blocks through a permutation of the source's block numbers, and slots and documents meet by block number. What comes
out are the packed shards: every place of a shard with the parts of documents that fill it. How many words the mix takes of
a document is counted there.

Permutations are swap-or-not shuffles: a few rounds of arithmetic and one hash each, on any range, with no table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bipath.operators.indexing import dense_index, running_total
from bipath.runtime import written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK = 512
SHARD = 1_024
ROUNDS = 24
CHUNK = 1 << 14  # slots that one task places
SEED = 20
WORD = "[^\\x20\\x09-\\x0D]+"


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1 that ``key`` chooses."""

    def step(at: Column, r: Column) -> Column:
        turn = F.pmod(F.xxhash64(F.lit(SEED), r, *key), n)
        other = F.pmod(turn - at, n)
        swap = F.xxhash64(F.lit(-SEED), r, *key, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(src, source, source_size, target) of (source, size): shares of all words by weight, at most ``most`` times.

    Sources in code point order, null last, take the weights in turn. With the sources sorted by size over
    weight, those at their limit come first; the words they leave over are shared by weight among the others.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = dense_index(totals, F.col("source").asc_nulls_last(), name="src")
    turn = F.pmod("src", F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    numbered = written(
        numbered.select("src", "source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "sources"
    )
    order = [F.col("cap") / F.col("w"), F.col("src")]
    before = running_total(numbered, *order, value="cap", name="cap_before")
    # Weights sum exactly as whole numbers of a millionth.
    before = before.withColumn("wi", F.round(F.col("w") * 1_000_000).cast("long"))
    before = written(running_total(before, *order, value="wi", name="w_before"), "filled")
    whole = before.agg(F.sum("source_size").alias("all"), F.sum("wi").alias("w")).first()
    every = F.lit(whole["all"] or 0) - F.col("cap_before")
    level = every / ((F.lit(whole["w"] or 1) - F.col("w_before")) / 1_000_000)
    # The level of the first source below its limit holds for all from there on.
    free = before.withColumn("level", level).filter(F.col("level") * F.col("w") <= F.col("cap"))
    final = free.agg(F.min_by("level", F.struct("cap_before", "w_before")).alias("final")).first()["final"]
    target = F.least(F.lit(final or 0.0) * F.col("w"), F.col("cap").cast("double"))
    return before.select("src", "source", "source_size", target.alias("target"))


def slots(targets: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, place, src, block, take): every slot of the mix, and how many words from a block's start it takes."""
    size, target = F.col("source_size"), F.floor(F.col("target") + 1e-6)
    plan = targets.filter("source_size > 0").select(
        "src",
        F.ceil(size / block).alias("blocks"),
        F.floor(size / block).alias("full"),
        F.col("source_size"),
        F.floor(target / size).alias("rounds"),
        F.pmod(target, size).alias("rest"),
    )
    plan = plan.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block))
    plan = running_total(plan, F.col("src"), value="slots", name="base")
    everything = plan.agg(F.sum("slots")).first()[0] or 1
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)))
    # A few rows here become all slots, so the number of tasks follows the slots and not the rows.
    chunks = plan.filter("slots > 0").withColumn("chunk", chunk).repartition(-(-everything // CHUNK), "src", "chunk")
    inside = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1)
    each = chunks.withColumn("j", F.explode(inside))
    each = each.withColumn("round", F.least(F.floor(F.col("j") / F.col("blocks")), F.col("rounds")))
    each = each.withColumn("x", F.col("j") - F.col("round") * F.col("blocks"))
    each = each.withColumn("whole_round", F.col("round") < F.col("rounds"))
    each = each.withColumn("range", F.when(F.col("whole_round"), F.col("blocks")).otherwise(F.greatest("full", F.lit(1))))
    moved = permuted(F.col("x"), F.col("range"), F.col("src"), F.col("round"))
    number = F.when(F.col("x") < F.col("range"), moved).otherwise(F.col("x"))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - number * block)
    take = F.when(F.col("whole_round"), length).otherwise(F.least(length, F.col("rest") - F.col("x") * block))
    place = permuted(F.col("base") + F.col("j"), F.lit(everything), F.lit(-1))
    return each.select(
        F.floor(place / shard).alias("shard"), place.alias("place"), "src", number.alias("block"), take.alias("take")
    )


def sized_documents(documents: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_TIMES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pieces, slots). pieces: (uid, doc_id, source, size, source_size, target, src, block, lo, hi), the part [lo, hi) of a
    block's words that each document row makes up; a row without words has one piece with a null block."""
    rows = written(sized_documents(documents).withColumn("uid", F.monotonically_increasing_id()), "sized")
    targets = written(source_targets(rows, weights, most), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    laid = running_total(rows, *order, value="size", name="before")
    laid = laid.join(targets, laid["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    earlier = running_total(targets.select("src", "source_size"), F.col("src"), value="source_size", name="base").select("src", "base")
    laid = laid.join(earlier, "src").withColumn("start", F.col("before") - F.col("base"))
    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, span)))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return (
        pieces.select("uid", "doc_id", "source", "size", "source_size", "target", "src", "block", lo.alias("lo"), hi.alias("hi")),
        # Written, as a plan can't tell how many slots a few sources make and would broadcast them all.
        written(slots(targets, block), "slots"),
    )


def packed_shards(pieces: DataFrame, drawn: DataFrame) -> DataFrame:
    """(shard, place, src, block, uid, doc_id, lo, hi): the parts [lo, hi) of a block's words that fill each slot.

    A block comes in one slot of each round and holds ``BLOCK`` words at most, so few rows meet under one block.
    """
    parts = pieces.select("src", "block", "uid", "doc_id", "lo", "hi")
    filled = drawn.join(parts, ["src", "block"]).withColumn("hi", F.least("hi", "take")).filter("hi > lo")
    return filled.select("shard", "place", "src", "block", "uid", "doc_id", "lo", "hi")


def mixed_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_TIMES, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source): a row for each row of ``documents``.

    taken counts the words of the row in all packed shards, repeats included. ``documents`` needs doc_id, text and source;
    other columns are ignored. A null or empty text has size 0 and is never taken; a source without words has
    target 0. A null source is a source of its own. The result depends on the rows alone, so reruns agree;
    equal rows may swap their counts.
    """
    pieces, drawn = mix(documents, weights, most, block)
    pieces = written(pieces, "pieces")
    packed = packed_shards(pieces, drawn).groupBy("uid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    rows = pieces.select("uid", "doc_id", "size", "source_size", "target", "source").dropDuplicates(["uid"])
    return rows.join(packed, "uid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source"
    )
