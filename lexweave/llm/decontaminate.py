"""Benchmark decontamination with one Aho-Corasick automaton (operator 6)."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, steps, written

WINDOW_WORDS = 10
#: Words of the items that one automaton takes (with one piece of an item more), and bytes of item texts that one pass over the documents broadcasts.
PACK_WORDS, SHARE_BYTES = 200_000, 32 << 20
#: Text of the documents that several automata scan in turn before the next documents are taken.
CHUNK_BYTES = 32 << 20

#: A-Z to a-z, and every byte outside words to a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Stands for every word that no item has.
_OTHER = "\0"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WordAutomaton:
    """Aho-Corasick automaton over the windows of some items; its letters are words, each of the items' words one character."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW_WORDS):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for name, text in items:
            coded = "".join(map(self._letter, words(text)))
            for i in range(max(1, len(coded) - size + 1) if coded else 0):
                owners.setdefault(coded[i : i + size], set()).add(name)
        self.automaton = ahocorasick.Automaton()
        for window, names in owners.items():
            self.automaton.add_word(window, (len(window), tuple(sorted(names))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def _letter(self, word: bytes) -> str:
        at = len(self.letters) + 1
        return self.letters.setdefault(word, chr(at if at < 0xD800 else at + 0x800))

    def hits(self, own: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """First word, word after the last, and items of every window in a text's words."""
        if self.empty or not own:
            return
        get = self.letters.get
        for last, (n, names) in self.automaton.iter("".join([get(w, _OTHER) for w in own])):
            yield last - n + 1, last + 1, names


_BUILT: dict[tuple[str, int, int], WordAutomaton] = {}


def _automaton(packs: list[list[tuple[str, str | None]]], k: int, name: str, size: int) -> WordAutomaton:
    """This worker's automaton for one pack; only the last one built is kept."""
    if (name, k, size) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, k, size] = WordAutomaton(packs[k], size)
    return _BUILT[name, k, size]


def _pieces(text: str | None, size: int) -> Iterator[str]:
    """An item of up to PACK_WORDS windows as it is, a longer one as runs of words that share all but one word of a window."""
    own = words(text)
    if len(own) - size < PACK_WORDS:
        yield text or ""
        return
    for at in range(0, len(own) - size + 1, PACK_WORDS):
        yield b" ".join(own[at : at + PACK_WORDS + size - 1]).decode()


def _shares(benchmark: DataFrame, item_id: str, item_text: str, size: int = WINDOW_WORDS) -> Iterator[list[list[tuple[str, str | None]]]]:
    """The items in packs of about PACK_WORDS words, as many at a time as SHARE_BYTES hold; longer items come in several pieces."""
    packs: list[list[tuple[str, str | None]]] = [[]]
    held = in_pack = 0
    for row in benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator():
        for piece in _pieces(row[1], size):
            if held >= SHARE_BYTES:
                yield packs
                packs, held, in_pack = [[]], 0, 0
            elif in_pack >= PACK_WORDS:
                packs.append([])
                in_pack = 0
            packs[-1].append((row[0] or "", piece))
            in_pack += len(words(piece))
            held += len(piece.encode())
    yield packs


_HITS = "array<struct<first: int, after: int, items: array<string>>>"


def _scanner(shared, size: int):
    """A function over batches that adds the hits of the broadcast packs to the column `hits` and sets `n_words`."""
    name = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("items", pa.list_(pa.string()))]))

    def scan(held: list[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        found = [[[] if h is None else [(x["first"], x["after"], x["items"]) for x in h] for h in batch.column("hits").to_pylist()] for batch in held]
        sizes = [[0] * batch.num_rows for batch in held]
        order = range(len(shared.value))
        for k in order if turn % 2 == 0 else reversed(order):
            automaton = _automaton(shared.value, k, name, size)
            for batch, hits, n in zip(held, found, sizes, strict=True):
                for i, text in enumerate(batch.column("text").to_pylist()):
                    own = words(text)
                    n[i] = len(own)
                    hits[i].extend(automaton.hits(own))
        for batch, hits, n in zip(held, found, sizes, strict=True):
            fresh = {"hits": pa.array([[{"first": a, "after": b, "items": list(names)} for a, b, names in x] for x in hits], kind), "n_words": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_arrays([fresh.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        used = turn = 0
        for batch in steps(batches):
            held.append(batch)
            used += batch.column("text").nbytes
            if used >= CHUNK_BYTES or len(shared.value) == 1:
                yield from scan(held, turn)
                held, used, turn = [], 0, turn + 1
        if held:
            yield from scan(held, turn)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, with_spans: bool = True, carry: bool = False, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark windows in every whole text, one row per document.

    Words are lower-cased in A-Z only. The workers build the automata from broadcast item texts. Items of more than PACK_WORDS
    words make several automata, used in turn on one chunk of documents after another; those of more than SHARE_BYTES
    are scanned for in several passes, each of which writes the documents with what it found, so neither the driver
    nor a worker ever holds more. spans gives the character offsets of maximal hit runs in the original
    text, `carry` adds the input row as the struct `row`. Null or empty text has no words; null item texts have no windows; repeated items
    count once by their id; an empty benchmark hits nothing; rows with the same id are scanned each for itself; an empty table gives no row.
    """
    spark, row = docs.sparkSession, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast(_HITS).alias("hits"), F.lit(0).cast("long").alias("n_words"), *row)
    shared = scan = before = None
    for packs in _shares(benchmark, item_id, item_text, size):
        if shared is not None:
            rows = written(rows.mapInArrow(scan, rows.schema), "scanned")
            shared.destroy()
            if before is not None:
                discard(before)
            before = rows
        shared = spark.sparkContext.broadcast(packs)
        scan = _scanner(shared, size)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            out = []
            for doc, text, n, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n_words", "hits")), strict=True):
                edges = np.zeros(n + 1, dtype=np.int64)
                for x in hits:
                    edges[x["first"]] += 1
                    edges[x["after"]] -= 1
                mask = np.cumsum(edges)[:-1] > 0
                spans = []
                if with_spans and hits:
                    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                listed = sorted({name for x in hits for name in x["items"]})
                out.append({"doc_id": doc, "n_words": n, "n_hit": int(mask.sum()), "n_items": len(listed), "items_sha256": hashlib.sha256(",".join(listed).encode()).hexdigest(), "contaminated": bool(hits), "items": listed, "spans": spans})
            found = pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))
            yield pa.RecordBatch.from_arrays([*found.columns, batch.column("row")], names=[*found.schema.names, "row"]) if carry else found

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, end: long>>")
    return rows.mapInArrow(report, T.StructType([*schema.fields, *([T.StructField("row", rows.schema["row"].dataType)] if carry else [])]))
