"""Trie of conversations in succinct level-order shards, with the rollups of every node.

Paths (the labels of a conversation's turns) are sorted by range, so a shard is a run of neighbouring paths and holds about as
much as any other, however many conversations share their first turns. Only the nodes on a shard's first and last path can
reach into other shards; these upper levels are merged apart from the rest, by the hash of their prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Turns of different paths that a shard is meant to hold: at most, and at least before shards outnumber the partitions.
SHARD_TURNS, LEAST_TURNS = 1_000_000, 20_000
#: A conversation takes its first turns, fewer than this many, from the first conversation of its hundred.
HEADS = 6
NOTHING = hashlib.sha256(b"").digest()

SHARD = "shard int, bits binary, nodes long, labels binary, sizes binary, ends binary, firsts binary, counts binary, digests binary"
OPEN = "shard int, node long, key binary, parent binary, depth long, conv_id long, n_convs long, size long, children long, leaves long, saved long, digest binary"
MERGED = "shard int, node long, owner boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, digest binary"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, digest binary"


@dataclass
class Louds:
    """A tree in level order: each node's number of children in unary, one bit a child and a zero."""

    bits: np.ndarray

    @classmethod
    def of_degrees(cls, degree: np.ndarray) -> Louds:
        bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
        bits[np.cumsum(degree) + np.arange(len(degree))] = 0
        return cls(bits)

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(self.bits == 0)
        return np.diff(zeros, prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Parent of each node: the zeros before the one that stands for it; -1 for the root."""
        ones = np.flatnonzero(self.bits)
        return np.r_[-1, ones - np.arange(len(ones))]

    def levels(self) -> list[tuple[int, int]]:
        """First and last (exclusive) node of each level."""
        reach = np.r_[0, np.cumsum(self.degrees())] + 1
        out, a, b = [], 0, 1
        while a < b:
            out.append((a, b))
            a, b = int(reach[a]), int(reach[b])
        return out


def rolled_up(parents: np.ndarray, levels: list[tuple[int, int]], values: np.ndarray, ufunc=np.add) -> np.ndarray:
    """Each node's value joined with those of all nodes below, level by level from the deepest."""
    out = values.copy()
    for a, b in reversed(levels[1:]):
        ufunc.at(out, parents[a:b], out[a:b])
    return out


def build_levels(labels: np.ndarray, lengths: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
    """Tree of sorted different paths; for each node the place of its label in `labels` (-1: root), for each path its last node."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, np.int64)
    same = np.ones(len(lengths), bool)
    if len(same):
        same[0] = False
    active = np.arange(len(lengths))
    makers, base, nodes = np.zeros(1, np.int64), 0, 1
    parents, spots = [np.array([-1])], [np.array([-1])]
    ends = np.zeros(len(lengths), np.int64)
    depth = 0
    while True:
        depth += 1
        active = active[lengths[active] >= depth]
        if not len(active):
            break
        spot = starts[active] + depth - 1
        before = active - 1
        kept = same[active] & (lengths[before] >= depth)
        kept[kept] = labels[spot[kept]] == labels[starts[before[kept]] + depth - 1]
        same[active] = kept
        fresh = active[~kept]
        parents.append(base + np.searchsorted(makers, fresh, "right") - 1)
        spots.append(spot[~kept])
        makers, base = fresh, nodes
        nodes += len(fresh)
        done = active[lengths[active] == depth]
        ends[done] = base + np.searchsorted(makers, done, "right") - 1
    parent = np.concatenate(parents)
    return Louds.of_degrees(np.bincount(parent[1:], minlength=nodes)), np.concatenate(spots), ends


def labelled_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path: of each conversation the labels and text lengths of its turns, by turn (null first), then by label.

    A label is 16 bytes of the SHA-256 of role and text; texts don't travel. Turns without conv_id go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", label.alias("label"), F.length(text).alias("n")).alias("t"))
    path = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["label"].alias("label"), t["n"].alias("n")))
    return turns.groupBy("conv_id").agg(path.alias("path"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation with its first turns from the first conversation of its hundred, if there is one."""
    heads = paths.where(F.pmod("conv_id", F.lit(100)) == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, HEADS - 1).alias("head"))
    own = paths.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(100)), "h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")})
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("path", 1, 0))
    tail = F.slice("path", F.col("h") + 1, F.size("path"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, tail).alias("path"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of equal keys: first id, number, SHA-256 of the ids; ids come sorted and are never held together."""
    key, first, n, code = None, 0, 0, None
    names = ["first", "n", "digest"]
    for batch in batches:
        keys = np.column_stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()])
        ids = batch.column("conv_id").to_pylist()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own = tuple(keys[a].tolist())
            if own != key:
                if code is not None:
                    out.append((first, n, code.digest()))
                key, first, n, code = own, ids[a], 0, hashlib.sha256()
            code.update((("," if n else "") + ",".join(map(str, ids[a:b]))).encode())
            n += b - a
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=names)
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([n]), pa.array([code.digest()], pa.binary())], names=names)


def different_paths(members: DataFrame) -> DataFrame:
    """path, first, n, digest: each different path once, with its least conversation, their number and the digest of their ids.

    The digest is one pass over sorted ids, which SHA-256 asks for; equal paths meet as ids of eight bytes in one sorted run.
    """
    keyed = members.select(F.xxhash64("path").alias("k1"), F.xxhash64(F.lit(1), "path").alias("k2"), "conv_id")
    runs = keyed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    found = runs.mapInArrow(_digests, "first long, n long, digest binary")
    return found.join(members.withColumnRenamed("conv_id", "first"), "first").select("path", "first", "n", "digest")


def louds_shards(paths: DataFrame, shards: int) -> DataFrame:
    """One row a shard (SHARD): the bits, the labels and sizes of its nodes in level order, and what ends at which node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        lists = table.column("path").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        turns = lists.flatten()
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        labels = np.array(turns.field("label").to_pylist(), "V16") if len(turns) else np.zeros(0, "V16")
        sizes = turns.field("n").to_numpy(zero_copy_only=False)
        tree, spots, ends = build_levels(labels, lengths)
        part = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
        row = {
            "shard": TaskContext.get().partitionId(), "bits": np.packbits(tree.bits).tobytes(), "nodes": len(spots), "labels": bytes(16) + labels[spots[1:]].tobytes(), "sizes": part(np.r_[0, sizes[spots[1:]]], "<i4"), "ends": part(ends, "<i8"),
            "firsts": part(table.column("first").to_numpy(), "<i8"), "counts": part(table.column("n").to_numpy(), "<i8"), "digests": b"".join(table.column("digest").to_pylist()),
        }
        yield pa.RecordBatch.from_pylist([row], schema=_arrow(SHARD))

    return paths.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(run, SHARD)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in schema.split(", "))])


class Shard:
    """A shard's tree with its rollups; `open` are the nodes on its first and last path."""

    def __init__(self, row: dict):
        n = row["nodes"]
        self.tree = Louds(np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=2 * n - 1))
        self.labels = np.frombuffer(row["labels"], "V16")
        self.sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        ends, firsts, counts = (np.frombuffer(row[k], "<i8") for k in ("ends", "firsts", "counts"))
        self.parents, self.degree, self.levels = self.tree.parents(), self.tree.degrees(), self.tree.levels()
        self.depth = np.repeat(np.arange(len(self.levels)), [b - a for a, b in self.levels])
        least, members = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        least[ends], members[ends] = firsts, counts
        self.conv = rolled_up(self.parents, self.levels, least, np.minimum)
        self.members = rolled_up(self.parents, self.levels, members)
        self.open = np.zeros(n, bool)
        for at in (int(ends[0]), int(ends[-1])):
            while at >= 0 and not self.open[at]:
                self.open[at] = True
                at = int(self.parents[at])
        # What open nodes hold of their own is known only after the merge.
        inner = ~self.open
        self.leaves = rolled_up(self.parents, self.levels, ((self.degree == 0) & inner).astype(np.int64))
        self.saved = rolled_up(self.parents, self.levels, np.where(inner, (self.members - 1) * self.sizes, 0))
        self.digest = np.full(n, None, object)
        self.digest[ends] = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]


def open_nodes(shards: DataFrame) -> DataFrame:
    """What each shard knows of the nodes that it may share (OPEN)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                s = Shard(row)
                at = np.flatnonzero(s.open)
                keys = {-1: b""}
                for v in at.tolist():
                    keys[v] = hashlib.blake2b(keys[int(s.parents[v])] + s.labels[v].tobytes(), digest_size=16).digest()
                closed_children = np.bincount(s.parents[1:][~s.open[1:]], minlength=len(s.open))
                columns = [np.full(len(at), row["shard"]), at, [keys[v] for v in at.tolist()], [keys[int(s.parents[v])] for v in at.tolist()], s.depth[at], s.conv[at], s.members[at], s.sizes[at], closed_children[at], s.leaves[at], s.saved[at], s.digest[at].tolist()]
                schema = _arrow(OPEN)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return shards.mapInArrow(run, OPEN)


def merge_upper(x: pd.DataFrame) -> pd.DataFrame:
    """Open nodes of all shards as one tree, rolled up; each shard's node gets the merged values (MERGED).

    Its rows are two paths a shard, so they follow the number of shards, not of conversations.
    """
    x = x.sort_values(["depth", "key", "shard"], kind="stable").reset_index(drop=True)
    number, keys = pd.factorize(x["key"], sort=False)  # in order of depth
    n = len(keys)
    head = x.groupby(number, sort=True).agg({"depth": "first", "parent": "first", "size": "first", "conv_id": "min", "n_convs": "sum", "children": "sum", "leaves": "sum", "saved": "sum", "digest": "first"})
    at = {k: i for i, k in enumerate(keys)}
    parents = np.array([at.get(p, -1) for p in head["parent"]], np.int64)
    children = head["children"].to_numpy() + np.bincount(parents[1:], minlength=n)
    bounds = np.searchsorted(head["depth"].to_numpy(), np.arange(int(head["depth"].max()) + 2))
    levels = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    members, conv = head["n_convs"].to_numpy(), head["conv_id"].to_numpy()
    # Sums from below an open node already hold those of the open nodes' closed children, on every level above.
    below_leaves, below_saved = head["leaves"].to_numpy().copy(), head["saved"].to_numpy().copy()
    np.subtract.at(below_leaves, parents[1:], head["leaves"].to_numpy()[1:])
    np.subtract.at(below_saved, parents[1:], head["saved"].to_numpy()[1:])
    leaves = rolled_up(parents, levels, below_leaves + (children == 0))
    saved = rolled_up(parents, levels, below_saved + (members - 1) * head["size"].to_numpy())
    above = pd.array([None if p < 0 else int(conv[p]) for p in parents], "Int64")
    digest = head["digest"].to_numpy()
    out = pd.DataFrame({"shard": x["shard"], "node": x["node"], "owner": np.r_[True, number[1:] != number[:-1]]})
    for name, values in (("conv_id", conv), ("depth", head["depth"].to_numpy()), ("parent_conv_id", above), ("n_convs", members), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved), ("digest", digest)):
        out[name] = values[number]
    return out


def inner_nodes(shards: DataFrame, merged: DataFrame) -> DataFrame:
    """The nodes that one shard holds alone (NODE)."""

    def run(own: pa.Table, shared: pa.Table) -> pa.Table:
        schema = _arrow(NODE)
        if not own.num_rows:
            return schema.empty_table()
        s = Shard(own.slice(0, 1).to_pylist()[0])
        conv = s.conv.copy()
        conv[shared.column("node").to_numpy()] = shared.column("conv_id").to_numpy()
        at = np.flatnonzero(~s.open)
        columns = [conv[at], s.depth[at], conv[s.parents[at]], s.members[at], s.degree[at], s.leaves[at], s.saved[at], s.digest[at].tolist()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return shards.groupBy("shard").cogroup(merged.select("shard", "node", "conv_id").groupBy("shard")).applyInArrow(run, NODE)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Null roles and texts are empty; turns of one place go by their labels, equal rows are turns of their own; turns without
    conv_id go. An empty table has no node, not even the root. A conversation's labels (16 bytes a turn) meet in one row.
    """
    members = written(rebuilt(labelled_paths(conversations)), "rebuilt")
    turns = members.agg(F.sum(F.size("path"))).first()[0]
    if turns is None:
        return conversations.sparkSession.createDataFrame([], NODE.replace("digest binary", "ends_sha256 string"))
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-turns // shard_turns), min(partitions, -(-turns // least_turns)), 1)
    trees = written(louds_shards(different_paths(members), shards), "louds")
    merged = written(open_nodes(trees).groupBy(F.lit("upper")).applyInPandas(merge_upper, MERGED), "upper")
    nodes = inner_nodes(trees, merged).unionByName(merged.where("owner").select(*[c.split()[0] for c in NODE.split(", ")]))
    return nodes.withColumn("digest", F.lower(F.hex(F.coalesce("digest", F.lit(NOTHING))))).withColumnRenamed("digest", "ends_sha256")
