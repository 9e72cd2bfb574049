"""Language identification by cross-parsing: the language in whose labelled text a document falls into the fewest phrases.

A suffix automaton of a language's text recognises all of its substrings. A document is parsed greedily: each phrase is
the longest match from where the last one ended. With n_L bytes of text, c phrases cost c * log2(n_L) bits; divided by
the document's bytes, that estimates its cross entropy with the language. Automata become transition arrays over byte
classes, numbered breadth-first, and all blocks of a slice of documents step through them side by side. A text is parsed
in blocks of BLOCK bytes, so that a long one is no chain of its own; that adds a phrase a block, for each language alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Labelled documents for each language, characters of all of them together, languages.
SAMPLE, CHARS, LANGUAGES = 64, 192 << 10, 200
BLOCK = 256
UNKNOWN = "und"

#: A-Z as a-z, other ASCII as a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of text; state 0 begins."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        now = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:  # q's short and long substrings part
                twin = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[now] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = now
    return moves


class Parser:
    """An automaton as an array: next[state + class] is the next state, 0 if there is none. The row of 0 has no moves, so a phrase begins there."""

    def __init__(self, text: bytes, classes: np.ndarray, width: int):
        moves = suffix_automaton(text)
        order, place = [0], {0: 2}
        for s in order:  # breadth-first: states near the root lie close together
            for c in sorted(moves[s]):
                if (t := moves[s][c]) not in place:
                    place[t] = len(order) + 2
                    order.append(t)
        self.cost = np.log2(max(2, len(text)))
        table = np.zeros((len(order) + 2, width), np.int32)
        for s in order:
            for c, t in moves[s].items():
                table[place[s], classes[c]] = place[t] * width
        table[:, width - 1] = width  # the class of padding: to row 1 and no further
        self.next = table.ravel()
        self.begin = table[2].copy()
        self.begin[width - 1] = width

    def phrases(self, steps: np.ndarray) -> np.ndarray:
        """steps (positions, blocks) of classes -> phrases of each block."""
        state = np.zeros(steps.shape[1], np.int32)
        count = np.zeros(steps.shape[1], np.int32)
        for c in steps:
            state = self.next.take(state + c)
            new = np.flatnonzero(state == 0)
            count[new] += 1
            state[new] = self.begin.take(c[new])
        return count


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and what isn't ASCII, with one space for any run of the rest, and the offsets of the texts in that."""
    out = _FOLD[data]
    keep = out != 32
    keep[1:] |= out[:-1] != 32
    keep[at[:-1][at[:-1] < len(keep)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


class Languages:
    def __init__(self, texts: tuple[tuple[str, bytes], ...]):
        """texts: (language, folded text); one automaton for each."""
        self.names = [x for x, _ in texts]
        known = sorted({b for _, t in texts for b in t})
        self.width = len(known) + 2  # and one for unknown bytes, one for padding
        self.classes = np.full(256, len(known), np.int32)
        self.classes[known] = np.arange(len(known))
        self.parsers = [Parser(t, self.classes, self.width) for _, t in texts]

    def bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(documents, languages): bits a byte of folded text; infinite for empty texts."""
        data, at = folded(data, at)
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        first = np.cumsum(blocks) - blocks
        begin = np.repeat(at[:-1], blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * BLOCK
        left = np.minimum(np.repeat(at[1:], blocks) - begin, BLOCK)
        inside = np.arange(BLOCK) < left[:, None]
        steps = np.full((len(begin), BLOCK), self.width - 1, np.int32)
        steps[inside] = self.classes[data]
        steps = np.ascontiguousarray(steps.T)
        out = np.full((len(size), len(self.parsers)), np.inf)
        some = np.flatnonzero(blocks)
        for k, p in enumerate(self.parsers):
            if len(some):
                out[some, k] = np.add.reduceat(p.phrases(steps), first[some]) * p.cost / size[some]
        return out


@lru_cache(maxsize=2)
def _languages(texts: tuple[tuple[str, bytes], ...]) -> Languages:
    return Languages(texts)


def _lettered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    count = np.concatenate([[0], np.cumsum(_LETTER[_FOLD[data]])])
    out = count[at[1:]] > count[at[:-1]]
    for d in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[d] = any(c.isalpha() for c in data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def remainder(docs_id="doc_id"):
    return F.crc32(F.col(docs_id).cast("string")) % 4


def learn(labelled: DataFrame, sample: int = SAMPLE, chars: int = CHARS, languages: int = LANGUAGES) -> tuple[tuple[str, bytes], ...]:
    """labelled (doc_id, lang, text), lang and text not null -> (language, text) of at most `sample` whole texts each.

    The texts are those of the smallest hashes, each that still fits into `chars`; only a text longer than all of that is
    cut, at a hashed place. A count for each language first tells below which hash there are enough, so that only few rows
    are ordered. Of more than `languages` languages, those with the most labelled rows are learned, of equal ones the
    first by name; texts in another one go to the nearest of these. The result goes to every task: it is at most
    `languages` * `chars` characters.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return ()
    below = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int(min(2**63 - 1, -(2**63) + 2**64 * 3 * sample / r.n)))])
    hashed = labelled.withColumn("h", F.xxhash64("doc_id", F.lit(4))).where(F.col("h") <= below[F.col("lang")])
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    fitting = hashed.select("lang", "h", "doc_id", F.col("text").substr((F.pmod(F.shiftright("h", 7), room) + 1).cast("int"), F.lit(chars)).alias("piece"))
    ranked = fitting.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "piece"))).alias("all"))

    def add(own: Column, x: Column) -> Column:
        size = own["size"] + F.length(x["piece"])
        return F.when(size <= chars, F.struct(size.alias("size"), F.concat(own["text"], F.lit(" "), x["piece"]).alias("text"))).otherwise(own)

    own = F.aggregate(F.slice("all", 1, sample), F.struct(F.lit(0).alias("size"), F.lit("").alias("text")), add)
    rows = sorted((r.lang, r.text) for r in ranked.select("lang", own["text"].alias("text")).collect())
    raw = [(lang, np.frombuffer(t.encode(), np.uint8)) for lang, t in rows]
    texts = [(lang, folded(t, np.array([0, len(t)]))[0].tobytes()) for lang, t in raw]
    return tuple((lang, t) for lang, t in texts if t.strip())


def predict(docs: DataFrame, texts: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score), a row for each row, from the text alone.

    A null text, one without a letter and, if nothing was learned, any text are 'und' with score 0. score is by which
    share the best language needs fewer bits than the next; 1 if there is just one. Of equal ones the first by name wins.
    Repeated and null doc_ids don't matter; an empty table gives an empty one.
    """

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        known = _lettered(data, at) if texts else np.zeros(len(at) - 1, bool)
        best, score = np.zeros(len(known), np.int64), np.zeros(len(known))
        names: list[str] = []
        if known.any():
            model = _languages(texts)
            names = model.names
            bits = model.bits(data, at)
            best = bits.argmin(axis=1)
            if len(names) > 1:
                two = np.partition(bits[known], 1, axis=1)
                score[known] = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
            else:
                score[known] = 1.0
        lang = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_slices(docs.select("doc_id", "text"), kernel, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> (doc_id, held_out, lang_pred, score); learns from the labelled rows that aren't held out."""
    held = F.coalesce(remainder() == 2, F.lit(False))
    texts = learn(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held).select("doc_id", "lang", "text"))
    return predict(docs, texts).select("doc_id", held.alias("held_out"), "lang_pred", "score")
