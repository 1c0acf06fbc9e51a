"""SimHash near-duplicates with pigeonring filtering (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, texts_of, written
from .components import connected_components

SEED = 42
#: The ring of segments: 64 bits in seven runs.
RING = 7
_EDGES = [round(i * 64 / RING) for i in range(RING + 1)]
SEGMENTS = [((1 << (b - a)) - 1) << a for a, b in zip(_EDGES, _EDGES[1:], strict=False)]
#: Up to so many fingerprints of a key are compared with each other; more go by neighbours in bits.
KEY_MOST = 48
#: Fingerprints whose keys one task spells out, so that its sums stay small.
TASK_PRINTS = 8192
_SHINGLE_BLOCK = 1 << 16
_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles in order, in blocks; of fewer words, of the whole sequence; of none, nothing."""
    own = text.encode("utf-8", "surrogatepass").translate(_ASCII).split()
    if not own:
        return
    line = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(own) - width + 1)
    last = ends[min(width, len(own)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLE_BLOCK):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : min(n, at + _SHINGLE_BLOCK)].tolist(), last[at : at + _SHINGLE_BLOCK].tolist(), strict=False)], dtype="<u8")


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    """The number whose bits are those set in over half of n."""
    return int(np.packbits((total * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 4) -> int:
    """64 bits, each set if set in over half the XXH64 values of the word shingles."""
    total, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        total += bits_of(hashes)
        n += len(hashes)
    return majority(total, n)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long); null text has no words and so 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            got = np.array([fingerprint(t, width) for t in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def chain_masks(budget: int) -> list[tuple[int, int, int]]:
    """(key number, start of the chain, mask) such that close fingerprints agree on some mask.

    On a ring of m segments with at most `budget` differing bits in all, some chain of consecutive
    segments has, for each of its prefixes of l segments, at most floor(l * budget / m) differing bits
    (Qin and Xiao, 2018). The prefix with the last budget below 3 is put into keys: its
    first segment must agree, and as few errors as its prefixes allow leave at least two more
    segments clean, so every pair of those that may be all that is clean makes a key.
    """
    free = [l * budget // RING for l in range(1, RING + 1)]
    long = max(l for l in range(1, RING + 1) if free[l - 1] <= 2)
    faults = [set(f) for k in range(free[long - 1] + 1) for f in combinations(range(1, long), k) if all(sum(x < l for x in f) <= free[l - 1] for l in range(1, long + 1))]
    pairs: list[tuple[int, ...]] = []
    size = min(2, long - 1 - free[long - 1])
    for fault in faults:  # greedily: a pair outside each possible set of faulty segments
        if not any(fault.isdisjoint(p) for p in pairs):
            pairs.append(next(p for p in combinations(range(1, long), size) if fault.isdisjoint(p)))
    seen: dict[int, int] = {}
    for start in range(RING):
        for p in pairs:
            mask = SEGMENTS[start] | sum(SEGMENTS[(start + x) % RING] for x in p)
            seen.setdefault(mask, start)
    return [(i, start, mask) for i, (mask, start) in enumerate(sorted(seen.items()))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _viable(diff: Column, budget: int) -> Column:
    """Some start has a chain round the ring within its proportional budget at every length."""
    counts = [F.bit_count(diff.bitwiseAND(F.lit(_signed(s)))) for s in SEGMENTS]
    starts = None
    for start in range(RING):
        total, fits = None, None
        for l in range(1, RING + 1):
            c = counts[(start + l - 1) % RING]
            total = c if total is None else total + c
            ok = total <= l * budget // RING
            fits = ok if fits is None else fits & ok
        starts = fits if starts is None else starts | fits
    return starts


def near_links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at `budget` or fewer differing bits.

    Every pair within the budget is found or joined by a path of found links:
    fingerprints with a common key meet where at most KEY_MOST share it, are filtered by the
    chains and then by all 64 bits. Those of fuller keys spell out every fingerprint within half the
    budget of their own and link to the least that spells out the same one: two at 2h bits or fewer
    have a fingerprint within h of both, so nothing is lost, and the work grows with their number alone.
    (The path through a shared one joins fingerprints up to 2h apart only.)
    """
    half = (budget + 1) // 2
    if budget % 2:
        raise ValueError("an even budget is needed")
    masks = chain_masks(budget)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, _, m in masks])
    spread = prints.repartition(max(1, -(-prints.count() // TASK_PRINTS)), "fp")
    keyed = spread.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = written(keyed.join(sizes.hint("merge"), "key"), "simhash-keys")
    calm = shared.where(F.col("n") <= KEY_MOST).select("key", "fp")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    met = calm.withColumnRenamed("fp", "a").join(calm.withColumnRenamed("fp", "b").hint("merge"), "key").where(F.col("a") < F.col("b"))
    links = met.where(_viable(diff, budget)).where(F.bit_count(diff) <= budget).select("a", "b")
    flips = [0, *(sum(1 << i for i in c) for n in range(1, half + 1) for c in combinations(range(64), n))]
    busy = shared.where(F.col("n") > KEY_MOST).select("fp").distinct()
    spelled = busy.select("fp", F.explode(F.array(*[F.lit(_signed(f)) for f in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = spelled.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where(F.col("a") < F.col("top")).select("near", "a")
    through = spelled.join(least.hint("merge"), "near").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return links.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row.

    Rows with one fingerprint are one class; links are sought between classes. Documents without
    words have fingerprint zero and are linked like any other. Copies never multiply: a
    class counts once. Rows with a null id are grouped too but name no component, unless all ids
    are null, when it is null; rows with the same id each give a row. An empty table gives none.
    """
    prints = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    groups = connected_components(near_links(classes.select("fp"), budget))
    joined = classes.join(groups.hint("merge"), classes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = joined.join(named.hint("merge"), "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(labels.hint("merge"), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")

