"""Matches of whole batches of token lists against one list at a time."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.operators import metrics
from lexweave.operators.token_codes import match_lists, match_many
from lexweave.plans import queries


def walk(steps, through, strict):
    at = n = 0
    for token in steps:
        if token in through[at:]:
            at, n = through.index(token, at) + 1, n + 1
        elif strict:
            break
    return n


def bag(rng, n, kinds):
    return [rng.choice([None, *"abcdefgh"][:kinds]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_batches(seed):
    rng = random.Random(seed)
    through = [None if rng.random() < 0.1 else bag(rng, rng.randrange(12), rng.randrange(1, 9)) for _ in range(80)]
    lists = [None if rng.random() < 0.1 else bag(rng, rng.randrange(12), rng.randrange(1, 9)) for _ in range(80)]
    kind = pa.list_(pa.string())
    for strict in (False, True):
        both, steps = match_lists(pa.array(through, kind), pa.array(lists, kind), strict)
        assert both.tolist() == [(Counter(a or []) & Counter(b or [])).total() for a, b in zip(through, lists, strict=True)]
        assert steps.tolist() == [walk(b or [], a or [], strict) for a, b in zip(through, lists, strict=True)]
    many = [[lists[rng.randrange(80)] for _ in range(rng.randrange(4))] for _ in range(80)]
    got = match_many(pa.array(through, kind), pa.array(many, pa.list_(kind))).to_pylist()
    assert got == [[{"unordered": (Counter(a or []) & Counter(b or [])).total(), "ordered": walk(b or [], a or [], False)} for b in bs] for a, bs in zip(through, many, strict=True)]
    empty = pa.array([], kind)
    assert match_many(empty, pa.array([], pa.list_(kind))).to_pylist() == [] and match_lists(empty, empty)[1].tolist() == []


def test_long_pairs():
    """100,000 tokens a side, few different ones or all different; beside many short pairs."""
    rng = random.Random(1)
    long = [rng.choice("abcdef") for _ in range(100_000)]
    other = [rng.choice("abcdefg") for _ in range(100_000)]
    names = [f"w{i}" for i in range(100_000)]
    kind = pa.list_(pa.string())
    through, lists = [long, names, *[["a", "b"]] * 5000], [other, names[::-1], *[["b", "a"]] * 5000]
    start = time.perf_counter()
    both, steps = match_lists(pa.array(through, kind), pa.array(lists, kind))
    assert time.perf_counter() - start < 60
    assert both[:3].tolist() == [(Counter(long) & Counter(other)).total(), 100_000, 2] and steps[1:3].tolist() == [1, 1]
    at = n = 0
    for token in other:
        k = next((j for j in range(at, len(long)) if long[j] == token), None) if token != "g" else None
        at, n = (at, n) if k is None else (k + 1, n + 1)
    assert steps[0] == n


def test_columns_and_long_rows(spark):
    words = ["w%d" % (i % 977) for i in range(100_000)]
    df = spark.createDataFrame([(1, words, words[::2]), (2, ["a", "b", "c"], ["c", "a", "b"]), (3, [], ["a"]), (4, None, None)], "id int, s array<string>, o array<string>")
    pick = lambda m: m["matched"]
    got = df.select("id", pick(metrics.ordered_match_output_driven(F.col("s"), F.col("o"))).alias("out"), pick(metrics.ordered_match_source_driven(F.col("s"), F.col("o"))).alias("src")).collect()
    assert {r["id"]: (r["out"], r["src"]) for r in got} == {1: (walk(words[::2], words, False), walk(words, words[::2], True)), 2: (1, 2), 3: (0, 0), 4: (0, 0)}


def test_a_source_is_cut_once(spark):
    """The plan cuts each system's source into words once, however many fields there are, and deals no text out."""
    merged = queries._merged(spark, "/root/testdata/sf0.001")
    fields = {"headword": "string", "definition": "string", "pronunciations": "array", "etymology": "string", "examples": "array"}
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = metrics.field_metrics(merged, fields)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_extract_all(") == 2 + 2 * len(fields)  # a source a system, and each output
    generate = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert "source_text" not in generate and "regexp" not in generate and "_src_rule" in generate
