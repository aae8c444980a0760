"""Token ids in compressed block files, in the order of document ids.

Texts are dealt to tasks by ranges of doc_id and encoded in order. A task cuts its ids into
stripes of about ``STRIPE`` ids, at ends of documents, and a stripe into blocks that id_coder
codes side by side; each block is reset and has a checksum of its ids. A stripe is a row of a
Parquet table, so any store that Spark writes to will do and a repeated task leaves no parts:

    shard, stripe     place in the order: shards follow each other, and stripes within them
    doc_ids, lengths  the documents of the stripe, and their numbers of ids
    n_ids             ids in the stripe; the last block is filled up with zeros
    sizes, crcs       bytes of each block, and crc32 of its ids as little-endian 32-bit numbers
    payload           the blocks

Defined results: null is encoded as empty text; a null doc_id comes first; rows with one doc_id
follow the order of a hash of their text; a text is never cut, so a stripe grows with the longest
one; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import work_folder
from sigloom.llm.id_coder import decode_lanes, encode_lanes

STRIPE = 6_000_000
LANES = 2_048
LEAST_STEPS = 512
REMEMBERED = 150_000  # pieces of text, and as many that came before them
TOGETHER = 256  # pieces that the library encodes as one text
LONGEST = 64  # characters of a piece that is remembered

FORMAT = (
    "shard int, stripe int, doc_ids array<{id}>, lengths array<long>, n_ids long, "
    "sizes array<int>, crcs array<long>, payload binary"
)

#: Before a space between two other characters, every text can be cut: no pre-token of a byte-level
#: vocabulary goes on past such a space, as a space only ever begins one.
_cut = re.compile(r"(?<=\S)(?= \S)")
#: A piece before and after which a text of such pieces can be cut.
_joins = re.compile(r" \S(?:.*\S)?", re.DOTALL)
_odd = re.compile(r"\s[^\S ]|[^\S ]\s|  |^ | $")


class Tokenizer:
    """Ids of whole texts, from the remembered ids of their pieces."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        import tokenizers

        self.library = tokenizers.Tokenizer.from_buffer(model)
        if self.library.get_vocab_size() > 0xFFFF:
            raise ValueError("ids do not fit in 16 bits")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        added = self.library.get_added_tokens_decoder()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.encode()) if i in added else len(token)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if _odd.search(text):
            return _cut.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.pieces(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {p: self.known[p] for p in wanted.difference(new)}
        back = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in back)
        new = sorted(new - back)
        self._learn(new)
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), np.uint16) for c in cut]
        for piece in new:
            if len(piece) > LONGEST:
                del self.known[piece]
        return found


    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces. Those that can be cut apart again are encoded as one text and
        told apart by the bytes of the ids; where an id spans two of them, they are encoded alone."""
        alone, joined = [], []
        for p in pieces:
            (joined if _joins.fullmatch(p) else alone).append(p)
        groups = [joined[at : at + TOGETHER] for at in range(0, len(joined), TOGETHER)]
        for at in range(0, len(groups), 40):
            some = groups[at : at + 40]
            coded = self.library.encode_batch_fast(["".join(g) for g in some], add_special_tokens=False)
            for group, e in zip(some, coded, strict=True):
                ids = np.array(e.ids, np.uint16)
                ends = np.cumsum(self.sizes[ids])
                last = np.cumsum([len(p.encode()) for p in group])
                cuts = np.searchsorted(ends, last)
                if cuts[-1] != len(ids) - 1 or (ends[cuts] != last).any():
                    alone += group
                    continue
                data, at_ = ids.tobytes(), 0
                for piece, to in zip(group, ((cuts + 1) * 2).tolist(), strict=True):
                    self.known[piece], at_ = data[at_:to], to
        for at in range(0, len(alone), 10_000):
            some = alone[at : at + 10_000]
            coded = self.library.encode_batch_fast(some, add_special_tokens=False)
            for piece, e in zip(some, coded, strict=True):
                self.known[piece] = np.array(e.ids, np.uint16).tobytes()


_tokenizers: dict[bytes, Tokenizer] = {}


def tokenizer(model: bytes) -> Tokenizer:
    """The worker's tokenizer for a model; kept for the next task."""
    if model not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[model] = Tokenizer(model)
    return _tokenizers[model]


def _crc(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())


def _coded(ids: np.ndarray) -> tuple[list[int], list[int], bytes]:
    lanes = max(1, min(LANES, len(ids) // LEAST_STEPS))
    steps = -(-len(ids) // lanes)
    filled = np.zeros(lanes * steps, np.uint16)
    filled[: len(ids)] = ids
    rows = filled.reshape(lanes, steps)
    blocks = encode_lanes(rows)
    return [len(b) for b in blocks], [_crc(r) for r in rows], b"".join(blocks)


def _decoded(n: int, sizes: list[int], crcs: list[int], payload: bytes) -> np.ndarray:
    ends = np.cumsum(sizes)
    blocks = [payload[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)]
    rows = decode_lanes(blocks, -(-n // len(blocks)))
    for i, (row, crc) in enumerate(zip(rows, crcs, strict=True)):
        if _crc(row) != crc:
            raise ValueError(f"block {i} is damaged")
    return rows.reshape(-1)[:n]


def write(docs: DataFrame, model_path: str, path: str, end_id: int | None = None) -> None:
    """Encodes ``text`` of docs and writes the ids, each text followed by end_id, to ``path``."""
    model = Path(model_path).read_bytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([] if end_id is None else [end_id], np.uint16)

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, number = tokenizer(model), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0
        id_type = pa.int64()

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            sizes, crcs, payload = _coded(ids) if len(ids) else ([], [], b"")
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([names], pa.list_(id_type)),
                pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                pa.array([len(ids)], pa.int64()),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([crcs], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(
                columns, names=[c.split()[0] for c in FORMAT.split(", ")]
            )

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                for name, ids in zip(
                    part.column("doc_id").to_pylist(),
                    own.encode(part.column("text").to_pylist()),
                    strict=True,
                ):
                    names.append(name)
                    held.append(np.concatenate([ids, last]))
                    size += len(held[-1])
                    if size >= STRIPE:
                        yield row()
                        names, held, size, number = [], [], 0, number + 1
        if names:
            yield row()

    (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(stripes, FORMAT.format(id=kind))
        .write.parquet(path)
    )


def read(spark, path: str) -> DataFrame:
    """(shard, stripe, doc_id, at, ids): at counts the ids of the stripe before a document."""
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if not r["n_ids"]:
                    ids = np.empty(0, np.uint16)
                else:
                    ids = _decoded(r["n_ids"], r["sizes"], r["crcs"], r["payload"])
                ends = np.concatenate([[0], np.cumsum(r["lengths"])]).astype(np.int64)
                n = len(r["lengths"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, r["shard"], np.int32)),
                        pa.array(np.full(n, r["stripe"], np.int32)),
                        pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        pa.array(ends[:-1]),
                        pa.ListArray.from_arrays(
                            pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))
                        ),
                    ],
                    names=["shard", "stripe", "doc_id", "at", "ids"],
                )

    return table.mapInArrow(
        documents, f"shard int, stripe int, doc_id {kind}, at long, ids array<int>"
    )


@F.arrow_udf(T.LongType())
def _ids_crc32(ids: pa.Array) -> pa.Array:
    offsets = ids.offsets.to_numpy()
    values = np.asarray(ids.values, "<u4")
    return pa.array(
        [crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
        pa.int64(),
    )


def starts(spark, path: str) -> DataFrame:
    """(shard, stripe, before): ids of all stripes before one. The driver holds a number for each
    shard, of which there are as many as tasks that wrote."""
    sizes = spark.read.parquet(path).select("shard", "stripe", "n_ids")
    before, total = {}, 0
    for r in sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        before[r["shard"]] = total
        total += r["n"]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "shard int, ahead long")
    own = Window.partitionBy("shard").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(
        offsets, "shard"
    ).select("shard", "stripe", (F.col("ahead") + F.col("own")).alias("before"))


def report(docs: DataFrame, model_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files read back."""
    spark = docs.sparkSession
    path = work_folder(spark, "token-ids")
    write(docs, model_path, path, end_id)
    found = read(spark, path).select(
        "shard", "stripe", "doc_id", "at",
        F.size("ids").cast("long").alias("n_tokens"), _ids_crc32("ids").alias("ids_crc32"),
    )
    return found.join(starts(spark, path), ["shard", "stripe"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
