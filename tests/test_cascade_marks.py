"""Rules out of reach are left out without a change of any record."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import cascade

PIECES = ["a", "Foo", " bar", "/x/", "/", "//", ", ", ",", " see ", " ſee ", "SEE", ".", "?", " n. ", "n., ", " adj.", " also ", " alſo ", " ALSO ", " in the phrase ", " İn the phrase ", " ın the expreſſion ", " are commonly used ", " abbreviation for ", " abbrevıation for ", "“q”", ":", "$", " (old)", "; ", " < Lat. See X", " likeK ", " or ", "1. "]


@pytest.mark.parametrize("profile", ["src", "v12"])
def test_same_records(spark, profile, monkeypatch):
    rng = random.Random(profile)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9))) for _ in range(900)] + ["", None, " ", "foo /x/ n., in the phrase a b", "foo /x/, İn the expreſſion a b", "foo, see.", "foo, see$"]
    df = spark.createDataFrame(list(enumerate(texts)), "para_id int, text string").repartition(4).cache()
    got = sorted(cascade.parse(df, profile).collect())
    with monkeypatch.context() as m:
        m.setattr(cascade, "NEEDS", dict.fromkeys(cascade.NEEDS, ()))
        want = sorted(cascade.parse(df, profile).collect())
    assert got == want
    assert {r["rule_branch"] for r in got} >= {f"C{i}" for i in (1, 2, 3, 5, 6, 7, 8, 9, 11, 12, 13, 15)}


def test_fewer_patterns(spark):
    df = spark.createDataFrame([(1, "gaffer thing"), (2, "gaffer n. a boss"), (3, "craic /kræk/ n. fun"), (4, "foo, see BAR")], "para_id int, text string")
    got = {r["para_id"]: (r["rule"], r["in_order"], r["in_reach"]) for r in cascade.pattern_evaluations(df).collect()}
    assert got == {1: ("C15", 15, 1), 2: ("C12", 12, 1), 3: ("C11", 11, 1), 4: ("C3", 3, 1)}


def test_bits(spark):
    row = spark.range(1).select(cascade.marks(T.normalize_entry_text(F.lit("A, ſEE ın the b."))).alias("b")).first()["b"]
    assert {m for i, m in enumerate(cascade.MARKS) if row >> i & 1} == {",", "see", "in the ", "."}


def test_patterns_stand_once(spark):
    """A rule's pattern is tried in one place (C3 and C9 look at a group too) and its groups are cut in one; a plan with copies for rounds and fields makes methods that the JVM never compiles."""
    df = spark.createDataFrame([(1, "gaffer n. a boss")], "para_id int, text string")
    for profile in ("src", "v12"):
        plan = cascade.parse(df, profile)._jdf.queryExecution().optimizedPlan().toString()
        known = [r for r in cascade.rules(F.col("t"), F.col("t"), profile) if r.pattern]
        found = {r.name: plan.count(r.pattern) for r in known}
        assert len(found) == 14 and all(0 < n <= 4 for n in found.values()), found


def test_texts_of_one_pass(spark):
    """A normalised text holds no white space but blanks, so the mark between groups can't be in it."""
    points = [chr(i) for i in range(1, 0x3100)]
    df = spark.createDataFrame([(f"a{c}b /x{c}/ n. c{c}{c}d",) for c in points], "t string").select(T.normalize_entry_text("t").alias("t"))
    assert df.where(F.contains("t", F.lit(cascade.PART)) | F.col("t").rlike("(?U)[\\s\\x1c-\\x1f&&[^ ]]")).count() == 0
