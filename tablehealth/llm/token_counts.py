"""Exact token counts at every prefix of a text, by dynamic programming over the vocabulary.

The encoding of a prefix ends in one piece; what stands before that piece is the encoding of the shorter prefix. So the
count at a place is the count where its last piece starts, plus one, and the last piece is the only one that stays
unmerged next to the last piece of the shorter prefix. Whether two pieces stay apart is found by merging the two of
them alone. Truncation and budget questions are then lookups in the stored counts; nothing is encoded again.

Segments (words with their mark) are independent, so their counts are found once while a worker remembers them and
added up. Runs of marks have their own rule: their pieces share one score, below all others, and merge from the left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.llm.sentencepiece_bpe import MARK, REMEMBERED, Merger, merger

_SHORT = 64
_NONE = -1  # no piece in front: the start, or a character outside the vocabulary


class PrefixCounter:
    """Counts of all prefixes of segments of one vocabulary."""

    def __init__(self, tool: Merger):
        self.tool = tool
        self.apart: dict[int, bool] = {}
        self.width = len(tool.texts)
        self.endings = ahocorasick.Automaton()
        for text, i in tool.pieces.items():
            self.endings.add_word(text, (len(text), i))
        self.endings.make_automaton()
        self.known: dict[str, bytes | list[int]] = {}
        self.runs = [len(tool.symbols(MARK * n)) if n else 0 for n in range(8 * tool.longest + 1)]
        start = 2 * tool.longest
        periods = (p for p in range(1, start + 1) if all(self.runs[n + p] == self.runs[n] + self.runs[start + p] - self.runs[start] for n in range(start, len(self.runs) - p)))
        self.period = next(periods)
        self.step = self.runs[start + self.period] - self.runs[start]

    def run(self, n: int) -> int:
        """Tokens of ``n`` marks alone."""
        known = len(self.runs)
        if n < known:
            return self.runs[n]
        turns = -(-(n - known + 1) // self.period)
        return self.runs[n - turns * self.period] + turns * self.step

    def prefixes(self, segment: str) -> bytes | list[int]:
        """Token count of segment[:i] for i = 1 .. len(segment); as bytes where they fit."""
        found = self.known.get(segment)
        if found is None:
            found = self._prefixes(segment)
            if len(segment) <= _SHORT:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                if max(found) < 256:
                    found = bytes(found)
                self.known[segment] = found
        return found

    def _prefixes(self, segment: str) -> list[int]:
        marks = len(segment) - len(segment.lstrip(MARK))
        if marks < 2:
            return self._word(segment)[0][1:]
        runs = [self.run(n) for n in range(1, marks + 1)]
        if marks == len(segment):
            return runs
        counts, starts = self._word(segment[marks - 1:])
        alone = [False, True]  # whether the prefix's encoding starts with a mark alone
        for end in range(2, len(counts)):
            alone.append(starts[end] > 0 and alone[starts[end]])
        joined, bare = self.run(marks - 1), self.run(marks) - 1
        # the last mark belongs to the word, unless it stays alone: then it merges with the run
        return runs + [(bare if alone[end] else joined) + counts[end] for end in range(2, len(counts))]

    def _word(self, word: str) -> tuple[list[int], list[int]]:
        """Counts of word[:end], and where the last piece of each starts, for end = 0 .. len(word)."""
        n = len(word)
        counts, starts, lasts = [0] * (n + 1), [0] * (n + 1), [_NONE] * (n + 1)
        apart, width = self.apart, self.width
        done = 0
        for at, (size, piece) in self.endings.iter(word):
            end = at + 1
            if counts[end]:
                continue
            while done < at:
                done += 1
                if not counts[done]:
                    self._outside(word, done, counts, starts)
            left = lasts[end - size]
            stays = apart.get(left * width + piece)
            if stays if stays is not None else self._apart(left, piece):
                counts[end], starts[end], lasts[end] = counts[end - size] + 1, end - size, piece
        for end in range(done + 1, n + 1):
            if not counts[end]:
                self._outside(word, end, counts, starts)
        return counts, starts

    @staticmethod
    def _outside(word: str, end: int, counts: list[int], starts: list[int]) -> None:
        """A character outside the vocabulary: one token a byte, and nothing merges with it."""
        counts[end], starts[end] = counts[end - 1] + len(word[end - 1].encode()), end - 1

    def _apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are side by side; without a left one, whether the right one stays whole."""
        if len(self.apart) > REMEMBERED:
            self.apart.clear()
        texts = [self.tool.texts[i] for i in (left, right) if i != _NONE]
        found = self.apart[left * self.width + right] = self.tool.symbols("".join(texts)) == texts
        return found

    def text(self, text: str | None) -> list[int]:
        """Token counts of text[:i] for i = 0 .. len(text)."""
        counts, base = [0], 0
        for segment in self.tool.split(text):
            own = self.prefixes(segment)
            counts += [base + n for n in own]
            base = counts[-1]
        # the mark in front is not a character of the text, and the empty text has no tokens
        return [0, *counts[2:]]

    def within(self, text: str | None, budget: int) -> tuple[int, int]:
        """(tokens of the text, length of its longest prefix of at most ``budget`` tokens)."""
        base, place, best = 0, -1, 0
        for segment in self.tool.split(text):
            own = self.prefixes(segment)
            if base < budget:
                if base + own[-1] <= budget:
                    best = place + len(own)
                else:
                    best = next((place + i + 1 for i in range(len(own) - 1, -1, -1) if base + own[i] <= budget), best)
            base += own[-1]
            place += len(own)
        return base, max(best, 0)


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(merger(model))


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, counts, where counts[i] is the token count of the text's first i characters.

    Null and empty texts have the single count 0. To be stored, and asked by ``tokens_of_prefix`` and ``longest_prefix``.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(model)
        for batch in batches:
            counts = pa.array([tool.text(text) for text in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts], names=["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {key}, counts array<int>")


def tokens_of_prefix(counts: Column, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters; null beyond the text's length."""
    return F.get(counts, characters if isinstance(characters, Column) else F.lit(characters))


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = F.filter(F.transform(counts, lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull())
    return F.array_max(fits)


def token_counts(docs: DataFrame, model: str, *, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, fitting_chars.

    ``fitting_chars`` is the length of the longest prefix of at most ``limit`` tokens. Null and empty texts have no bytes
    and no tokens. Repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(model)
        for batch in batches:
            found = [tool.within(text, limit) for text in batch.column("text").to_pylist()]
            tokens, fitting = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens, fitting], names=["doc_id", "n_bytes", "n_tokens", "fitting_chars"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    done = sized.mapInArrow(counted, f"doc_id {key}, n_bytes bigint, n_tokens bigint, fitting_chars bigint")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars")
