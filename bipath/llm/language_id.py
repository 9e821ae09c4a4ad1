"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a labelled sample. A text is parsed
from left to right into phrases, each the longest match in that automaton; the fewer phrases, the closer the
text is to the language. With c phrases over m symbols and a sample of n symbols the cross entropy is about
c * log2(n) / m bits a symbol, and the language with the least wins.

Every label is learned. Symbols are lower-cased letters and one mark for each run of anything else. An automaton knows
the letters of its own sample, and any other letter is a phrase of its own there. The automata are packed
tables of numbers whose size follows the sample and not the alphabet; they are broadcast in blocks of languages, one
of which a task holds at a time. A task parses all windows of its batch against the languages of a block in step, one
symbol at a time. Windows of ``SPAN`` symbols bound the number of steps. A phrase that goes over a window's end is counted once,
in the window it begins in; the next phrase then begins with the next window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from bipath.llm.samples import held_out, position, remainder
from bipath.llm.streams import batch_of, column
from bipath.llm.words import pieces
from bipath.runtime import written

SYMBOLS = 20_000  # of each language's sample, about; its automaton has at most twice as many states
DOCUMENTS = 64  # most documents in a language's sample
PASSAGE = 300  # characters of one place of a document in the sample
LANGUAGES = 24  # of one broadcast block
SPAN = 1_024
UNKNOWN = "und"
PIECE = 1 << 20  # bytes of text that are parsed together
_MARK, _OTHER = 0, 1
_NONE, _DEAD = 0, 1
_TRIES = 64  # places for a row that are looked at together


@dataclass
class Model:
    """A block of languages. State s goes with symbol c to ``table[base[s] + c]`` if ``owner`` there is s.

    Without ``base`` the table is a plain one, states x symbols.
    """

    languages: list[str]
    letters: str  # of all the samples
    table: np.ndarray  # uint16: states, the automata one after the other
    root: np.ndarray  # uint16: languages x symbols
    offset: np.ndarray  # where the states of each automaton begin
    bits: np.ndarray  # log2 of each sample's size
    base: np.ndarray | None = None
    owner: np.ndarray | None = None  # uint16; 0 where nothing is

    def __post_init__(self):
        if self.base is None:
            states, width = self.table.shape
            inside = np.arange(states) - np.repeat(self.offset, np.diff(np.append(self.offset, states)))
            self.base, self.owner = np.arange(states) * width, np.repeat(inside.astype(np.uint16), width)
            self.table = self.table.reshape(-1)


def _transitions(symbols: list[int]) -> list[dict[int, int]]:
    """The automaton of all substrings of ``symbols``: what follows each state, the root first."""
    follow: list[dict[int, int]] = [{}]
    longest, link, last = [0], [-1], 0
    for c in symbols:
        state = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = state
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return follow


def _root(follow: list[dict[int, int]], width: int) -> np.ndarray:
    root = np.full(width, _DEAD, np.uint16)
    for c, to in follow[0].items():
        root[c] = to + 1
    return root


def suffix_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, those of the root) of the automaton of all substrings of ``symbols``, as a plain table.

    State 0 stands for "no such substring" and state 1 accepts nothing more.
    """
    follow = _transitions(symbols)
    # Root 0 is never entered, so states 1, 2, ... become 2, 3, ...
    table = np.zeros((len(follow) + 1, width), np.uint16)
    for state, edges in enumerate(follow):
        if state:
            for c, to in edges.items():
                table[state + 1, c] = to + 1
    return table, _root(follow, width)


def packed_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, table, transitions of the root): the rows of the plain table laid over each other.

    Rows with most symbols come first, each where all its cells are free; those with one symbol fill the gaps. The last
    ``width`` cells are empty, so that no lookup leaves the automaton.
    """
    follow = _transitions(symbols)
    base = np.zeros(len(follow) + 1, np.int64)
    rows = sorted((s for s in range(1, len(follow)) if len(follow[s]) > 1), key=lambda s: -len(follow[s]))
    single = [s for s in range(1, len(follow)) if len(follow[s]) == 1]
    cells = sum(len(follow[s]) for s in rows) + len(single)
    free = np.ones(cells + 2 * width + _TRIES, bool)
    at, size = 0, 0
    for s in rows:
        own = np.fromiter(follow[s], np.int64)
        at, size = (at, size) if len(own) == size else (0, len(own))
        while True:
            if at + _TRIES + width > len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            fits = free[np.arange(at, at + _TRIES)[:, None] + own].all(axis=1)
            if fits.any():
                break
            at += _TRIES
        at += int(np.argmax(fits))
        free[at + own] = False
        base[s + 1] = at
    gaps = np.flatnonzero(np.append(free[width:], np.ones(len(single), bool)))[: len(single)] + width
    base[np.array(single, np.int64) + 1] = gaps - np.array([next(iter(follow[s])) for s in single], np.int64)
    owner = np.zeros(int(base.max()) + 2 * width, np.uint16)
    table = np.zeros(len(owner), np.uint16)
    for s in range(1, len(follow)):
        for c, to in follow[s].items():
            owner[base[s + 1] + c] = s + 1
            table[base[s + 1] + c] = to + 1
    return base, owner, table, _root(follow, width)


_LOOKUPS: dict[str, np.ndarray] = {}


def _lookup(letters: str) -> np.ndarray:
    """Symbol of each code point; surrogates and non-letters are marks."""
    if "" not in _LOOKUPS:
        plain = np.full(0x110000, _MARK, np.uint8)
        for point in range(0x110000):
            if chr(point).isalpha():
                plain[point] = _OTHER
        _LOOKUPS[""] = plain
    if letters not in _LOOKUPS:
        for old in [k for k in _LOOKUPS if k]:
            del _LOOKUPS[old]
        codes = _LOOKUPS[""].astype(np.min_scalar_type(len(letters) + 1))
        codes[[ord(letter) for letter in letters]] = np.arange(2, len(letters) + 2)
        _LOOKUPS[letters] = codes
    return _LOOKUPS[letters]


def symbols_of(texts: list[str], letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, where each text begins, letters in each text); a mark opens and ends each text."""
    padded = [f" {t.lower()} " for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in padded])])
    codes = _lookup(letters)[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != _MARK
    counted = np.add.reduceat(keep, begin[:-1], dtype=np.int64) if texts else begin[:0]
    keep[1:] |= codes[:-1] != _MARK
    keep[begin[:-1]] = True
    size = np.add.reduceat(keep, begin[:-1], dtype=np.int64) if texts else begin[:0]
    return codes[keep], np.concatenate([[0], np.cumsum(size)]), counted


def phrases(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of phrases of each text in each language."""
    size = np.diff(first)
    windows = -(-size // SPAN)
    owner = np.repeat(np.arange(len(size)), windows)
    start = first[owner] + SPAN * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows))
    length = np.minimum(SPAN, first[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    many = len(model.languages)
    # The first phrase of a later window goes on with the last of the window before.
    counts = np.repeat((start == first[owner]).astype(np.int64)[None, :], many, axis=0)
    states = np.zeros((many, len(owner)), np.int64)
    alive = len(owner)
    ends = np.searchsorted(-length, -np.arange(int(length[0]) if alive else 0), "left")
    for step in range(len(ends)):
        alive = int(ends[step])
        now = symbols[start[:alive] + step]
        for k in range(many):
            fresh = model.root[k, now]
            if step == 0:
                states[k, :alive] = fresh
                continue
            state = states[k, :alive]
            at = model.base[state + model.offset[k]] + now
            missed = (model.owner[at] != state) | (model.table[at] == _NONE)
            counts[k, :alive] += missed
            states[k, :alive] = np.where(missed, fresh, model.table[at])
    out = np.zeros((many, len(size)), np.int64)
    for k in range(many):
        out[k] = np.bincount(owner, weights=counts[k], minlength=len(size))
    return out


def _passages(text: str, number: Column) -> Column:
    """``number`` passages of ``PASSAGE`` characters, one at a pseudorandom place of each of as many equal parts of the
    text, or the text whole if it is no longer than they are."""
    strip = F.length(text) / number

    def passage(k):
        place = F.shiftrightunsigned(F.xxhash64("doc_id", k), 11) / F.lit(float(1 << 53))
        return F.substr(text, F.floor(k * strip + place * (strip - PASSAGE)).cast("int") + 1, F.lit(PASSAGE))

    parts = F.transform(F.sequence(F.lit(0), number - 1), passage)
    return F.when(F.length(text) <= number * PASSAGE, F.col(text)).otherwise(F.array_join(parts, " "))


def _sample(documents: DataFrame) -> DataFrame:
    """(lang, text, nth): passages of at most ``DOCUMENTS`` rows of each lang that are not held out and hold a letter.

    The passages come from all over the whole texts; the fewer rows a lang has, the more of each.
    """
    rows = documents.filter((remainder() != 1) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = rows.select("doc_id", "lang", "text").withColumn("place", position("doc_id"))
    tally = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    drawn = rows.join(F.broadcast(tally), "lang").filter(F.col("place") <= F.greatest(F.lit(1.5 * DOCUMENTS) / F.col("n"), "least"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    drawn = drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= DOCUMENTS)
    many = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    number = F.greatest(F.lit(1), F.floor(F.lit(SYMBOLS) / (many * PASSAGE))).cast("int")
    drawn = drawn.withColumn("number", number)
    return drawn.select("lang", _passages("text", F.col("number")).alias("text"), "nth")


def learn(documents: DataFrame) -> Iterator[Model]:
    """Models of blocks of languages, in alphabetical order: every lang of rows that are not held out and hold a letter.

    The rows of a language's sample are bounded, and the driver holds one block at a time.
    """
    sample = written(_sample(documents), "language-sample")
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    for at in range(0, len(names), LANGUAGES):
        block = names[at : at + LANGUAGES]
        texts = {lang: [] for lang in block}
        for r in sample.filter(F.col("lang").isin(block)).orderBy("lang", "nth").collect():
            texts[r["lang"]].append(r["text"])
        letters = "".join(sorted({c for own in texts.values() for t in own for c in t.lower() if c.isalpha()}))
        # The cut only meets letters that become two when lower-cased: states are numbered by 16 bits.
        symbols = [symbols_of(own, letters)[0][: 3 * SYMBOLS // 2].tolist() for own in texts.values()]
        bases, owners, tables, roots = zip(*(packed_automaton(own, len(letters) + 2) for own in symbols))
        begin = np.cumsum([0, *(len(t) for t in tables)])
        yield Model(
            block, letters, np.concatenate(tables), np.array(roots), np.cumsum([0, *(len(b) for b in bases)])[:-1],
            np.log2([max(len(own), 2) for own in symbols]),
            np.concatenate([b + at for b, at in zip(bases, begin)]), np.concatenate(owners),
        )


def _predict(shared, name: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, name, PIECE):
            texts = [t or "" for t in column(batch, name).to_pylist()]
            n = len(texts)
            best, known, length = np.full(n, UNKNOWN, object), np.zeros(n, bool), np.zeros(n)
            least, second = np.full(n, np.inf), np.full(n, np.inf)
            for block in shared:
                model = block.value
                symbols, first, letters = symbols_of(texts, model.letters)
                known, size = letters > 0, np.diff(first)
                count = phrases(model, symbols, first)
                for k, language in enumerate(model.languages):
                    entropy = count[k] * model.bits[k] / size
                    better = known & (entropy < least)
                    second = np.where(better, least, np.minimum(second, entropy))
                    least = np.where(better, entropy, least)
                    length = np.where(better, size / count[k], length)
                    best[better] = language
                if len(shared) > 1:
                    # The worker reads the block again from its file; else it would keep all blocks.
                    vars(block).pop("_value", None)
            score = np.zeros(n)
            score[known] = 1 - least[known] / second[known]
            columns = {f: column(batch, f) for f in batch.schema.names}
            yield batch_of(
                **columns,
                lang_pred=pa.array(best.tolist(), pa.string()),
                score=pa.array(score, pa.float64()),
                phrase_length=pa.array(length, pa.float64()),
            )

    return predict


def identify_language(documents: DataFrame, models: Iterable[Model], text: str = "text") -> DataFrame:
    """``documents`` (with ``text``) plus lang_pred, score and phrase_length.

    score is how much lower the entropy of the best language is than that of the second, from 0 (a
    tie, which goes to the first in alphabetical order) to 1. phrase_length is the mean number of symbols
    of a phrase. Null texts, texts without a letter, and all texts when nothing was learned
    are ``und`` with 0. Columns of these names in the input are replaced.
    """
    shared = [documents.sparkSession.sparkContext.broadcast(model) for model in models]
    kept = documents.drop("lang_pred", "score", "phrase_length")
    schema = T.StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("phrase_length", "double")
    return kept.mapInArrow(_predict(shared, text), schema)


def language_of_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, phrase_length), learned from the rows that are not held out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = identify_language(rows.select("doc_id", "text"), learn(rows))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_length")
