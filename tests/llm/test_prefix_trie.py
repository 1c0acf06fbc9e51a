"""The trie of conversations against SQL and against all prefixes written out."""

import duckdb
import numpy as np
import pytest

from lexweave.llm.oracles import PREFIX_TRIE
from lexweave.llm.prefix_trie import Louds, build_levels, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def compared(spark, rows, **sizes):
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.sql(f"select {', '.join(COLUMNS)} from ({PREFIX_TRIE})").fetchall()
    df = spark.createDataFrame([(*r, "x", i, None) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, path string, label int, shard int")
    got = [tuple(r) for r in prefix_trie(df, **sizes).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


ODD = [(1, None, None, "a"), (1, 0, "user", None), (1, 1, "user", ""), (2, 5, "b", "long é" * 900), (2, 5, "b", "long é" * 900), (None, 0, "user", "lost"), (3, 0, "", "a"), (100, 0, "u", "one"), (103, 0, "u", "one"), (103, 1, "v", "two"), (250, 0, "a:b", "c"), (251, 0, "a", "b:c")]


@pytest.mark.parametrize("shard_turns", [1_000_000, 3])
def test_odd_rows(spark, shard_turns):
    got = compared(spark, ODD, shard_turns=shard_turns)
    assert next(r for r in got if r[1] == 0)[2] is None


def test_many_shards_share_their_upper_levels(spark):
    """A third of the conversations is one, another third begins alike; some are long and copied, one is without turns."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(0, 460):
        kind = c % 3
        words = ["same"] * 9 if kind == 0 else ["same"] * int(rng.integers(1, 5)) + [str(w) for w in rng.integers(0, 3, rng.integers(0, 5))] if kind == 1 else [str(w) for w in rng.integers(0, 4, rng.integers(1, 7))]
        words = words + ["tail"] * 60 if c % 50 == 7 else words
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", w) for i, w in enumerate(words)]
    rows += [(c, 0, "user", "alone") for c in range(1001, 1040)]  # their hundred has no first conversation
    compared(spark, rows, shard_turns=40)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = prefix_trie(none)
    assert out.columns == COLUMNS and out.count() == 0


def test_level_order_tree():
    paths = [b"", b"a", b"ab", b"abc", b"b", b"bd", b"be"]
    labels = np.array([bytes([x]) for p in paths for x in p], "V16")
    tree, spots, ends = build_levels(labels, np.array([len(p) for p in paths]))
    assert tree.parents().tolist() == [-1, 0, 0, 1, 2, 2, 3]
    assert tree.degrees().tolist() == [2, 1, 2, 1, 0, 0, 0]
    assert [bytes(labels[s])[:1] for s in spots[1:]] == [b"a", b"b", b"b", b"d", b"e", b"c"]
    assert ends.tolist() == [0, 1, 3, 6, 2, 4, 5]
    assert tree.levels() == [(0, 1), (1, 3), (3, 6), (6, 7)]
    assert Louds.of_degrees(tree.degrees()).bits.tolist() == tree.bits.tolist() == [1, 1, 0, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0]
