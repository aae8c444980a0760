"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text starts with a space mark and has each space replaced by one. No piece of such a vocabulary
goes on past the start of a new run of marks (``Vocabulary`` checks this), so a text falls into
units, each a run of marks and what follows it. A unit's adjacent symbol pairs that form a piece
stand on an agenda ordered by score, then by place (a heap; for short units a list by place); the best pair is merged and its new
neighbours join the agenda until none is left. Symbols outside the vocabulary become their UTF-8
bytes. Two characters that stand side by side in no piece part a unit further ("word" and ","),
and these parts are remembered up to a bound, as words recur. The sentencepiece library encodes
and decodes, too, each unit that is not remembered yet, so each unit of every text is checked,
and in every Arrow batch whole texts (the first and every ``CHECK_EVERY``-th); ``decode`` checks
the first and every ``CHECK_EVERY``-th list of ids. A difference is an error.

Defined results: null is encoded like empty text, as no ids; texts of any length are encoded
whole (memory beyond the text itself follows its longest unit); equal rows give equal results; an
empty table gives an empty table; columns of the input keep their names and values.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
REMEMBERED = 300_000  # units and parts for each Python worker, and as many that came before them
LONGEST = 48  # characters of a unit that is remembered
SHORT = 32  # characters up to which the agenda is a list in order of place
CHECK_EVERY = 64
TEXTS = 256  # texts whose ids are Python objects at a time, and whose new units are checked together

_NORMAL, _BYTE = 1, 6
_NEVER = float("inf")  # the score of a pair that is no piece
_unit = re.compile(f"{MARK}+[^{MARK}]*")


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = message[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        elif kind == 2:
            size, i = number(i)
            value, i = message[i : i + size], i + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, i = message[i : i + size], i + size
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and bytes of a model file: BPE, identity normalisation, byte fallback."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}  # of normal pieces; smaller is merged earlier
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes: dict[int, int] = {}
        self.silent: set[int] = set()  # control pieces decode to nothing
        for field, value in _fields(model):
            if field == 1:
                self._add(dict(_fields(value)))
            elif field == 2:
                kind = dict(_fields(value))
                if kind.get(3) != 2 or not kind.get(35):
                    raise ValueError("not a BPE model with byte fallback")
            elif field == 3:
                how = dict(_fields(value))
                if how.get(2) or how.get(4, 1) or not how.get(3, 1):
                    raise ValueError("the model changes texts before it encodes them")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("the model has pieces that span words")
        self.together = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.numbers = [str(i) for i in range(len(self.pieces))]
        self.spelled = [p.replace(MARK, " ") for p in self.pieces]
        self.special = set(range(len(self.pieces))) - set(self.ids.values())

    def parted(self, unit: str) -> list[str]:
        """unit, cut between all characters that stand side by side in no piece."""
        together = self.together
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in together]
        if not cuts:
            return [unit]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def _add(self, piece: dict) -> None:
        at, text, kind = len(self.pieces), piece[1].decode(), piece.get(3, _NORMAL)
        self.pieces.append(text)
        if kind == _NORMAL:
            self.rank[text] = -struct.unpack("<f", piece[2])[0]
            self.ids[text] = at
        elif kind == _BYTE:
            value = int(text[3:5], 16)
            self.byte_ids[value], self.bytes[at] = at, value
        elif kind == 3:
            self.silent.add(at)
        elif kind != 2:
            raise ValueError(f"pieces of type {kind} are not supported")

    def merge(self, text: str) -> list[int]:
        """Ids of one unit by the agenda."""
        symbols = self._merged(text) if len(text) <= SHORT else self._merged_long(text)
        found: list[int] = []
        for s in symbols:
            at = self.ids.get(s)
            if at is None:
                found += [self.byte_ids[b] for b in s.encode()]
            else:
                found.append(at)
        return found

    def _merged(self, text: str) -> list[str]:
        """The symbols of a short unit. The agenda holds a score for each pair, in order of place:
        the first of the best is what a heap would give."""
        score = self.rank.get
        symbols = list(text)
        agenda = [score(text[i : i + 2], _NEVER) for i in range(len(text) - 1)]
        while agenda:
            best = min(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)
            pair = symbols[i] + symbols.pop(i + 1)
            symbols[i] = pair
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(pair + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + pair, _NEVER)
        return symbols

    def _merged_long(self, text: str) -> list[str]:
        """The symbols of a unit of any length, with a heap."""
        rank = self.rank
        symbols = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [text[i : i + 2] for i in range(n - 1)]
        agenda = [(rank[p], i, p) for i, p in enumerate(pairs) if p in rank]
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            left = symbols[i]
            j = after[i]
            # Spans only grow: the pair is still there if its text is.
            if left is None or j >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heappush(agenda, (rank[new], i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heappush(agenda, (rank[new], h, new))
        return [s for s in symbols if s is not None]

    def plain(self, ids: list[int]) -> str:
        """The text of ids, with a space for each mark; bytes that are no UTF-8 become U+FFFD."""
        if self.special.isdisjoint(ids):
            return "".join([self.spelled[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i in self.special else self.spelled[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


class _Units(dict):
    """Unit without its first mark, or part of a unit after a mark sign -> (its ids as text, its
    plain text). What is missing is encoded, and units are checked against the library.

    When it is full, its entries are set aside in place of those set aside before, and come back
    when they are asked for again: words that recur stay, those that came once go."""

    def __init__(self, vocabulary: Vocabulary, library):
        super().__init__()
        self.vocabulary, self.library = vocabulary, library
        self.unchecked: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def __missing__(self, unit: str) -> tuple[str, str]:
        if unit in self.older:
            return self._keep(unit, self.older[unit])
        v = self.vocabulary
        parts = [MARK + unit] if unit.isalpha() else v.parted(MARK + unit)
        if len(parts) == 1:
            value = self.one(MARK + unit)
        else:
            # A part never starts with a mark but the first, so keys of both kinds differ.
            head, *rest = parts
            found = [self[head[1:]] if len(head) > 1 else self.one(head)]
            for p in rest:
                key = "\0" + p
                if key in self or key in self.older:
                    found.append(self[key])
                else:
                    found.append(self._keep(key, self.one(p)))
            value = ",".join([f[0] for f in found]), "".join([f[1] for f in found])
        self.unchecked[unit] = value
        return self._keep(unit, value)

    def check(self) -> None:
        """Raises if the library encodes or decodes a unit that was encoded since otherwise: one
        call of the library for all of them."""
        found, self.unchecked = self.unchecked, {}
        if "" in found:  # a mark alone is one text with the word before it
            text, plain = found.pop("")
            both = [*self.library.encode("a"), *map(int, text.split(","))]
            if both != self.library.encode("a ") or "a" + plain != self.library.decode(both):
                raise ValueError("sentencepiece encodes or decodes a mark otherwise")
        if not found:
            return
        lists = self.library.encode(list(found), num_threads=1)
        plains = self.library.decode(lists, num_threads=1)
        numbers = self.vocabulary.numbers
        for (unit, value), ids, plain in zip(found.items(), lists, plains):
            if value[0] != ",".join([numbers[i] for i in ids]) or value[1] != " " + plain:
                raise ValueError(f"sentencepiece encodes or decodes {unit[:200]!r} otherwise")

    def one(self, part: str) -> tuple[str, str]:
        v = self.vocabulary
        ids = v.merge(part)
        return ",".join([v.numbers[i] for i in ids]), v.plain(ids)

    def _keep(self, key: str, value: tuple[str, str]) -> tuple[str, str]:
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes and decodes texts with one model; can check itself against the library."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.vocabulary = Vocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.units = _Units(self.vocabulary, self.library)

    def parts(self, text: str | None) -> list[tuple[str, str]]:
        """(ids as text, plain text) of each unit."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text or "\0" in text:
            units = [u[1:] for u in _unit.findall(MARK + text.replace(" ", MARK))]
            if "\0" in text:
                return [p for u in units for p in self._uncached(u)]
        else:
            units = text.split(" ")
        return list(map(self.units.__getitem__, units))

    def _uncached(self, unit: str) -> list[tuple[str, str]]:
        found = [self.units.one(p) for p in self.vocabulary.parted(MARK + unit)]
        self.units.unchecked[unit] = ",".join([f[0] for f in found]), "".join([f[1] for f in found])
        return found

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, all of its new units checked."""
        ids = self.ids(text).tolist()
        self.units.check()
        return ids

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text; the next check() looks at its new units."""
        parts = self.parts(text)
        if not parts:
            return np.empty(0, np.int32)
        return np.fromstring(",".join([p[0] for p in parts]), np.int32, sep=",")

    def decode(self, ids: list[int]) -> str:
        plain = self.vocabulary.plain(ids)
        return plain[1:] if plain[:1] == " " else plain

    def check(self, texts: list[str | None]) -> None:
        """Raises if the library encodes or decodes a new unit, or every CHECK_EVERY-th text,
        otherwise."""
        self.units.check()
        for text in texts[::CHECK_EVERY]:
            ids = self.ids(text).tolist()
            if ids != self.library.encode(text or "") or self.decode(ids) != self.library.decode(ids):
                raise ValueError(f"sentencepiece encodes or decodes {text[:200]!r} otherwise")

    def check_ids(self, lists: list[list[int] | None]) -> None:
        """Raises if the library decodes every CHECK_EVERY-th list otherwise."""
        for ids in lists[::CHECK_EVERY]:
            if ids is not None and self.decode(ids) != self.library.decode(ids):
                raise ValueError(f"sentencepiece decodes {ids[:50]} otherwise")


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder for a model; kept for the next task."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def encode(docs: DataFrame, model_path: str, name: str = "ids", text: str = "text") -> DataFrame:
    """docs with a column of token ids. The model (under a megabyte) travels with the tasks."""
    model = Path(model_path).read_bytes()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(model)
        for batch in batches:
            found = []
            for at in range(0, len(batch), TEXTS):
                texts = batch.slice(at, TEXTS).to_pylist()
                found.append(pa.array([own.ids(t) for t in texts], pa.list_(pa.int32())))
                own.check(texts)
            yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(name, ids_of(F.col(text)))


def decode(frame: DataFrame, model_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """frame with the text of a column of ids; null ids give null."""
    model = Path(model_path).read_bytes()

    @F.arrow_udf(T.StringType())
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(model)
        for batch in batches:
            found = []
            for at in range(0, len(batch), TEXTS):
                lists = batch.slice(at, TEXTS).to_pylist()
                found.append(pa.array([None if x is None else own.decode(x) for x in lists], pa.string()))
                own.check_ids(lists)
            yield pa.concat_arrays(found) if found else pa.array([], pa.string())

    return frame.withColumn(name, text_of(F.col(ids)))


_digest = pa.struct(
    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and decoded again."""
    model = Path(model_path).read_bytes()

    @F.arrow_udf(
        T.StructType()
        .add("n_tokens", T.LongType())
        .add("ids_sha256", T.StringType())
        .add("decoded_sha256", T.StringType())
    )
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(model)
        for batch in batches:
            texts, rows = batch.to_pylist(), []
            for k, t in enumerate(texts, 1):
                if k % TEXTS == 0:
                    own.units.check()
                parts = own.parts(t)
                ids = ",".join([p[0] for p in parts])
                plain = "".join([p[1] for p in parts])[1:]
                rows.append(
                    {
                        "n_tokens": ids.count(",") + 1 if ids else 0,
                        "ids_sha256": sha256(ids.encode()).hexdigest(),
                        "decoded_sha256": sha256(plain.encode()).hexdigest(),
                    }
                )
            own.check(texts)
            yield pa.array(rows, _digest)

    return docs.select("doc_id", digest(F.col(text)).alias("d")).select("doc_id", "d.*")
