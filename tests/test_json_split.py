"""Large JSON lists and objects cut into entries by blocks."""

import json
import random

import pytest

from lexweave.sources import readers
from lexweave.sources.json_split import split_json


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", ",", ",,", "[", "]", "{", "}", ":", "a", "é", "\n", " ", "\\\\", '\\"', " ", "😀"]) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("form", ["list", "pretty", "object", "pretty object"])
@pytest.mark.parametrize("block", ["300", "100000"])
def test_any_text_in_any_blocks(spark, tmp_path, form, block):
    rng = random.Random(form + block)
    entries = [(f"e{i}", odd_text(rng)) for i in range(50)]
    value = dict(entries) if "object" in form else [{"entry_id": k, "entry_text": t, "more": [1, {"x": [t, "]}"]}]} for k, t in entries]
    path = tmp_path / "in.json"
    path.write_text("\n " * (form == "pretty") + json.dumps(value, indent=3 if "pretty" in form else None, ensure_ascii=rng.random() < 0.5) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = readers.read_entries(spark, str(path), with_place=True).orderBy("place").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r["entry_id"], r["entry_text"]) for r in rows] == entries


def test_small_and_broken_files(spark, tmp_path):
    def read(text):
        (tmp_path / "x.json").write_text(text)
        return [tuple(r) for r in readers.read_entries(spark, str(tmp_path / "x.json")).collect()]

    assert read("[]") == read("{}") == read(" [ ] ") == []
    assert read('[{"entry_id": "1", "entry_text": null}]') == [("1", None)] and read('{"a": "b"}') == [("a", "b")]
    for text in ('[{"entry_id": "1"}', '{"a": "b', '"text"', "[1, 2"):
        with pytest.raises(Exception):  # noqa: B017
            read(text)
    with pytest.raises(Exception, match="MALFORMED"):
        read('[{"entry_id": "1"}, {"entry_id" 2}]')


def test_a_line_of_many_blocks(spark, tmp_path):
    """One line of 24 MB in blocks of 256 KB: many tasks, and no row beyond an entry's length; several files at once."""
    entries = [{"entry_id": str(i), "entry_text": ("word, " * 30 + '"q" ') * (40 if i % 1000 == 0 else 1)} for i in range(120_000)]
    half = len(entries) // 2
    (tmp_path / "a.json").write_text(json.dumps(entries[:half]))
    (tmp_path / "b.json").write_text(json.dumps({e["entry_id"]: e["entry_text"] for e in entries[half:]}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        got = split_json(spark, str(tmp_path / "*.json"))
        assert got.rdd.getNumPartitions() > 40
        longest = got.selectExpr("max(length(text)) as n").first()["n"]
        rows = {r["entry_id"]: len(r["entry_text"]) for r in readers.read_entries(spark, str(tmp_path / "a.json")).collect()}
        assert got.count() == len(entries)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert longest < 20_000 and rows == {e["entry_id"]: len(e["entry_text"]) for e in entries[:half]}
