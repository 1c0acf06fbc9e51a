"""Hierarchical multi-length packing (operator 1)."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, texts_of
from .tokens import encoder, read_spec

TIERS = (2048, 1024, 512, 256)
#: Ids that a task packs at a time.
WINDOW_IDS = 1 << 20
#: Padded ids of a step group, and so sequences of a tier in it.
STEP_IDS = 1 << 15

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids array<int>"


@dataclass
class Sequence:
    tier: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, length
    used: int = 0

    def add(self, piece: tuple[int, int, int]) -> None:
        self.pieces.append(piece)
        self.used += piece[2]

    @property
    def cost(self) -> int:
        """Attention within documents grows with the square of a piece."""
        return sum(n * n for _, _, n in self.pieces)


class _Pool:
    """Pieces of one tier by length; best(n) takes the longest of at most n."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # length, document, start

    def put(self, doc: int, start: int, length: int) -> None:
        bisect.insort(self.items, (length, doc, start))

    def best(self, most: int) -> tuple[int, int, int] | None:
        at = bisect.bisect_right(self.items, (most, 1 << 62, 1 << 62)) - 1
        return self._piece(self.items.pop(at)) if at >= 0 else None

    def shortest(self) -> tuple[int, int, int] | None:
        return self._piece(self.items.pop(0)) if self.items else None

    def longest(self) -> tuple[int, int, int] | None:
        return self._piece(self.items.pop()) if self.items else None

    @staticmethod
    def _piece(item: tuple[int, int, int]) -> tuple[int, int, int]:
        return item[1], item[2], item[0]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[Sequence], list[tuple[int, int, int]]]:
    """Pack documents of the given lengths; the sequences, and the pieces that fill no sequence.

    Whole windows of the longest tier are cut off long documents. What is left of a
    document goes to the shortest tier that holds it. From the longest tier down, a
    sequence opens with the longest piece of its tier, and its gap is filled from the
    shorter tiers, the longest piece that fits first; when none fits, the shortest piece
    left is cut so that the sequence ends full, and its rest is routed anew. A tier that runs
    out of pieces passes its unfilled ones down. Every sequence is exactly as long as its tier.
    """
    out: list[Sequence] = []
    pools = {t: _Pool() for t in tiers}
    order = sorted(tiers, reverse=True)

    def route(doc: int, start: int, length: int) -> None:
        while length >= order[0]:
            out.append(Sequence(order[0]))
            out[-1].add((doc, start, order[0]))
            start, length = start + order[0], length - order[0]
        if length:
            pools[min(t for t in order if t >= length)].put(doc, start, length)

    for doc, length in enumerate(lengths):
        route(doc, 0, length)
    for k, tier in enumerate(order):
        left = sum(n for t in order[k:] for n, _, _ in pools[t].items)
        while left >= tier and (first := pools[tier].longest()):
            sequence = Sequence(tier)
            sequence.add(first)
            while gap := tier - sequence.used:
                piece = next((p for t in order[k:] if (p := pools[t].best(gap))), None)
                if piece is None:
                    doc, start, length = next(p for t in reversed(order[k:]) if (p := pools[t].shortest()))
                    piece = (doc, start, gap)
                    route(doc, start + gap, length - gap)
                sequence.add(piece)
            left -= tier
            out.append(sequence)
        if k + 1 < len(order):  # too little for one more of this tier: cut to the next
            while piece := pools[tier].longest():
                doc, start, length = piece
                for at in range(0, length, order[k + 1]):
                    pools[order[k + 1]].put(doc, start + at, min(order[k + 1], length - at))
    return out, [_Pool._piece(x) for t in order for x in pools[t].items]


def pack_rest(rest: list[tuple[int, int, int]]) -> list[Sequence]:
    """The last pieces of a task in full sequences whose lengths are the powers of two of their sum."""
    total = sum(n for _, _, n in rest)
    out: list[Sequence] = []
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            out.append(Sequence(1 << bit))
            while gap := out[-1].tier - out[-1].used:
                doc, start, length = rest[0]
                out[-1].add((doc, start, min(gap, length)))
                rest = [(doc, start + gap, length - gap), *rest[1:]] if length > gap else rest[1:]
    return out


def step_groups(sequences: list[Sequence], first: int, step_ids: int = STEP_IDS) -> list[int]:
    """A group number per sequence: one tier a group, dealt back and forth by attention cost."""
    groups = [0] * len(sequences)
    for tier in sorted({s.tier for s in sequences}, reverse=True):
        own = sorted((i for i, s in enumerate(sequences) if s.tier == tier), key=lambda i: -sequences[i].cost)
        n = -(-len(own) * tier // step_ids)
        for k, i in enumerate(own):
            lap, at = divmod(k, n)
            groups[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack_documents(docs: DataFrame, tokenizer_path: str, separator_id: int = 1, tiers: tuple[int, ...] = TIERS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most the longest tier, one row per piece.

    A document's ids end with `separator_id`. Each input partition is packed in one pass, a
    bounded window of ids at a time, without a shuffle; what fills no sequence waits for the next
    window, and a partition's last pieces make sequences of smaller powers of two, so none is padded. step_group numbers groups of
    equal padded size and like attention cost. Sequence numbers hold the partition, so a task
    that runs again gives the same rows. Null or empty text is the separator alone; a null
    id stays null, rows with the same id are packed each for itself, an empty table gives no row.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(spec.value), TaskContext.get().partitionId() << 36
        tail = np.array([separator_id], dtype=np.uint32)
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        spans: list[tuple[int, int]] = []  # what is left of each held document: from, length
        n_seq = n_group = held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal names, ids, spans, n_seq, n_group, held
            sequences, rest = pack([n for _, n in spans], tiers)
            if last and rest:
                sequences += pack_rest(rest)
            groups = step_groups(sequences, n_group)
            rows: list[list] = [[] for _ in range(10)]
            for s, group in zip(sequences, groups, strict=True):
                offset = 0
                for doc, start, length in s.pieces:
                    at = spans[doc][0] + start
                    own = ids[doc][at : at + length]
                    for column, value in zip(rows, (names[doc], at, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids[doc]), base + n_seq, offset, s.tier, base + group, own.astype(np.int32) if with_ids else None), strict=True):
                        column.append(value)
                    offset += length
                n_seq += 1
            n_group = max(groups, default=n_group - 1) + 1
            kinds = [*[pa.int64()] * 7, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            columns = [c.split()[0] for c in SCHEMA.split(", ")]
            for at in range(0, len(rows[0]), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(r[at : at + 2000], k) for r, k in zip(rows, kinds, strict=True)], names=columns)
            keep = [] if last else rest
            names, ids, spans = [names[d] for d, _, _ in keep], [ids[d] for d, _, _ in keep], [(spans[d][0] + s, n) for d, s, n in keep]
            held = sum(n for _, n in spans)

        for batch in steps(batches, 64):
            for name, own in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch, "text")), strict=True):
                names.append(name)
                ids.append(np.concatenate([own, tail]))
                spans.append((0, len(ids[-1])))
                held += len(ids[-1])
                if held >= WINDOW_IDS:
                    yield from flush(False)
        yield from flush(True)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("ids")
