"""SentencePiece encoding and decoding for merge-type vocabularies.

``Merger`` encodes by an agenda: all adjacent pairs of symbols whose joint text is a piece wait in a heap ordered by the
piece's score, then by place; the best pair is merged and its new neighbours join the agenda; entries whose symbols have
changed meanwhile are passed over. What remains outside the vocabulary becomes byte pieces.

If no piece has a word mark after another character, no merge crosses from a word to the next mark, and none from a word
to a punctuation mark unless a piece has both in a row; so a text is the sequence of its segments. Segments repeat, so each is encoded once per worker while it is remembered; every newly
encoded segment of an Arrow batch is compared with the sentencepiece library, ids and decoded text, before the batch's
results are returned. A worker remembers up to ``REMEMBERED`` short segments and then starts anew: memory is bounded, and
results don't depend on it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

MARK = "▁"
REMEMBERED = 400_000
_SHORT = 64
_ROWS = 256  # rows of an Arrow batch that are worked on together
_TOGETHER = 500  # segments compared in one call
_FLAT = 24  # symbols up to which a plain list is the faster agenda


class Merger:
    """A merge-type vocabulary read from a model file."""

    def __init__(self, model: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.vocab_size())
        self.texts = [sp.id_to_piece(i) for i in ids]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.values = {i: byte for byte, i in self.bytes.items()}
        self.pieces = {self.texts[i]: i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.order = {text: -sp.get_score(i) for text, i in self.pieces.items()}
        if len(self.bytes) != 256 or sp.normalize(" ﬁ\n") != MARK + MARK + "ﬁ\n":
            raise ValueError("the model must have byte fallback, a dummy prefix and no normalisation")
        self.longest = max(map(len, self.pieces))
        apart = not any(MARK in text.lstrip(MARK) for text in self.pieces) and not any("\n" in text for text in self.pieces)
        # a piece that goes from these characters on to ASCII punctuation forbids a cut between the two
        joined = {a for text in self.pieces for a, b in zip(text, text[1:]) if b in string.punctuation}
        stop, onward = re.escape(string.punctuation), re.escape("".join(sorted(joined)))
        before_stop = f"{MARK}*[^{MARK}\n{stop}]++(?=[{stop}])(?<![{onward}])|" if onward else ""
        self.segments = re.compile(f"{before_stop}{MARK}*[^{MARK}\n]+|{MARK}+|\n+" if apart else r"(?s:.+)")
        self.known: dict[str, str] = {}  # a segment's ids, comma-joined

    def split(self, text: str | None) -> list[str]:
        """The segments of a text, marks for spaces and a mark in front; none for null and empty texts."""
        return self.segments.findall(MARK + text.replace(" ", MARK)) if text else []

    def symbols(self, segment: str) -> list[str]:
        """The pieces, or single characters outside the vocabulary, into which a segment is merged."""
        found = list(segment)
        if len(found) <= _FLAT:
            return self._short(found)
        last = len(found) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        order, agenda = self.order, []
        for left in range(last):
            if (rank := order.get(segment[left:left + 2])) is not None:
                agenda.append((rank, left, left + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = found[left], found[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            found[left], found[right] = a + b, ""
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                if (rank := order.get(a + b + found[following])) is not None:
                    heapq.heappush(agenda, (rank, left, following, size + len(found[following])))
            if (preceding := before[left]) >= 0 and (rank := order.get(found[preceding] + a + b)) is not None:
                heapq.heappush(agenda, (rank, preceding, left, size + len(found[preceding])))
        return [x for x in found if x]

    def _short(self, found: list[str]) -> list[str]:
        """The same for a few symbols: the agenda is the list of the adjacent pairs' ranks in place order."""
        rank, never = self.order.get, float("inf")
        agenda = [rank(a + b, never) for a, b in zip(found, found[1:])]
        while agenda and (best := min(agenda)) != never:
            i = agenda.index(best)
            joint = found[i] + found[i + 1]
            found[i:i + 2] = [joint]
            del agenda[i]
            if i:
                agenda[i - 1] = rank(found[i - 1] + joint, never)
            if i < len(agenda):
                agenda[i] = rank(joint + found[i + 1], never)
        return found

    def encode(self, segment: str) -> list[int]:
        ids: list[int] = []
        for text in self.symbols(segment):
            if (i := self.pieces.get(text)) is not None:
                ids.append(i)
            else:
                ids.extend(self.bytes[byte] for byte in text.encode())
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids of whole characters, with the mark in front still as a space."""
        out = bytearray()
        for i in ids:
            if (byte := self.values.get(i)) is not None:
                out.append(byte)
            else:
                out += self.texts[i].replace(MARK, " ").encode()
        return out.decode()

    def confirm(self, segments: list[str], ids: list[list[int]]) -> None:
        """Compare ids and decoded texts with the library's; newlines keep the segments apart."""
        newline = self.bytes[10]
        for at in range(0, len(segments), _TOGETHER):
            text = "".join("\n" + s for s in segments[at:at + _TOGETHER]).replace(MARK, " ")
            mine = [self.pieces[MARK]]
            for own in ids[at:at + _TOGETHER]:
                mine.append(newline)
                mine += own
            theirs = self.library.encode(text)
            if mine != theirs or self.library.decode(theirs) != text or self.decode(mine)[1:] != text:
                raise ValueError(f"the library encodes or decodes otherwise, within {text!r}")


@lru_cache(maxsize=2)
def merger(model: str) -> Merger:
    return Merger(model)


def encoded(batches: Iterator[pa.RecordBatch], model: str, outputs: tuple[str, ...], keep: tuple[str, ...] = ("doc_id",)) -> Iterator[pa.RecordBatch]:
    """Add n_tokens and the asked ones of ids, ids_sha256, decoded, decoded_sha256 to the kept columns of the batches."""
    tool = merger(model)
    known = tool.known
    for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, max(1, whole.num_rows), _ROWS)):
        rows: list[tuple] = []
        fresh: dict[str, list[int]] = {}

        def learn(segment: str) -> str:
            ids = fresh[segment] = tool.encode(segment)
            joined = ",".join(map(str, ids))
            if len(segment) <= _SHORT:
                known[segment] = joined
            return joined

        for text in batch.column("text").to_pylist():
            if len(known) > REMEMBERED:
                known.clear()
            segments = tool.split(text)
            parts = list(map(known.get, segments))
            if None in parts:
                parts = [known.get(s) or learn(s) for s in segments]
            ids = ",".join(parts)
            # each segment decodes to itself with its marks as spaces, which confirm() makes sure of
            decoded = "".join(segments).replace(MARK, " ")[1:]
            row = {"n_tokens": ids.count(",") + 1 if ids else 0}
            if "ids" in outputs:
                row["ids"] = np.array(ids.split(",") if ids else [], np.int32)
            if "decoded" in outputs:
                row["decoded"] = decoded
            if "ids_sha256" in outputs:
                row["ids_sha256"] = hashlib.sha256(ids.encode()).hexdigest()
            if "decoded_sha256" in outputs:
                row["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
            rows.append(tuple(row[name] for name in ("n_tokens", *outputs)))
        if fresh:
            tool.confirm(list(fresh), list(fresh.values()))
        columns = list(zip(*rows)) if rows else [()] * (1 + len(outputs))
        types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        names = ("n_tokens", *outputs)
        added = [pa.array(list(c), types.get(n, pa.string())) for c, n in zip(columns, names)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *added], names=[*keep, *names])


def encode_documents(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens and the asked ones of ids, decoded, ids_sha256, decoded_sha256.

    Ids are those of the sentencepiece library without begin, end or sampling; decoded is the library's decode of them.
    Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each; an empty table gives an
    empty result; other columns are ignored. ``model`` is a path that every executor has.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens bigint" + "".join(f", {name} {kinds[name]}" for name in outputs)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encoded(batches, model, outputs), schema)


def with_tokens(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with n_tokens and token_ids beside its own columns (of the same names, the new ones hold)."""
    own = [f for f in docs.schema.fields if f.name not in ("token_ids", "n_tokens")]
    names = [f.name for f in own]
    inner = tuple(name if name == "text" else f"c{i}" for i, name in enumerate(names))  # no name can clash on the way
    schema = StructType([StructField(name, f.dataType, f.nullable) for name, f in zip(inner, own)]
                        + [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))])
    rows = docs.select(*[F.col(f"`{name}`").alias(new) for name, new in zip(names, inner)])
    return rows.mapInArrow(lambda batches: encoded(batches, model, ("ids",), inner), schema).toDF(*names, "n_tokens", "token_ids")
