"""Expressions against Python, golden entries, readers, writers, extraction and the registry."""

import json
import re
import unicodedata
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexweave.config import load_config
from lexweave.functions import arrays as A
from lexweave.functions import text as T
from lexweave.operators import audit, cascade, compare, extract, metrics, normalize
from lexweave.operators.runs import Registry, compare_runs
from lexweave.plans import cli
from lexweave.schemas import MODEL_RECORD, RULE_RECORD
from lexweave.sources import readers, sinks
from lexweave.sources.xlsx import workbook
from lexweave.streaming.extract import extract_stream

ODD = [None, "", "  ", " a  b\u001c", "\u001c", "Straße ﬁne Ⅷ", "‘x’ “y” – —", "a , b ;c /x/ , /y/", "ſt x", "it\u0085is"]


def values(spark, f, items=ODD):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def py_clean(x):
    if x is None or not x.strip():
        return None
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).replace(" ", " ")).strip() or None


def test_text_functions_follow_python(spark):
    assert values(spark, T.clean_text) == [py_clean(x) for x in ODD]
    assert values(spark, T.match_text) == [(py_clean(x) or "").casefold().translate(str.maketrans("’‘“”–—", "''\"\"--")) for x in ODD]
    py = lambda x: re.sub(r"\s+([,.;:])", r"\1", re.sub(r"/\s*,\s*/", "/, /", re.sub(r"\s+", " ", x.strip())))
    assert values(spark, T.normalize_entry_text) == [x if x is None else py(x) for x in ODD]
    assert values(spark, lambda c: T.is_nullish(c)) == [x is None or not x.strip() for x in ODD]
    assert values(spark, T.int_from_id, ["hde_00042", "1.0", "-5", "x", None, " 7 "]) == [42, 0, 5, None, None, 7]
    assert values(spark, lambda c: T.user_prompt("E: {{ entry_text }}.", c), [" a "]) == ["E: a."]


def test_plain_ranges_are_nfkc_stable():
    stable = re.compile(T._STABLE)
    assert all(unicodedata.normalize("NFKC", c) == c for c in map(chr, range(0x3000)) if stable.match(c))


GOLDEN = [
    ("craic /kræk/ n. fun, enjoyment.", "C11", "craic", "kræk", "n.", "fun, enjoyment", 0.90),
    ("gaffer n. an old man or boss.", "C12", "gaffer", None, "n.", "an old man or boss", 0.78),
    ("bog standard adj. completely ordinary; unremarkable.", "C12", "bog standard", None, "adj.", "completely ordinary; unremarkable", 0.78),
    ("foo n. an old man, or boss.", "C9", "foo n. an old man", None, None, "or boss", 0.83),
    ("foo, see.", "C9", "foo", None, None, "see", 0.83),
    ("foo // bar", "C15", "foo", None, None, "foo // bar", 0.2),
    ("", "C15", "", None, None, "", 0.2),
]


def test_golden_entries(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "para_id int, text string")
    got = cascade.parse(df).orderBy("para_id").select("rule_branch", "headword", "pronunciation", "part_of_speech", "definition", "parse_confidence").collect()
    assert [tuple(r) for r in got] == [g[1:] for g in GOLDEN]


def test_profiles_and_refs(spark):
    df = spark.createDataFrame([(1, "foo, see."), (2, "foo, see BAR; BAZ."), (3, "foo /f/ also fu, fo etc. n. a thing"), (4, "foo, n. a thing"), (5, "foo /f/ n."), (6, "a /b/, /c/, /d/, /e/, /g/ 2. n. x See Y < z \"q\"")], "para_id int, text string")
    v12 = {r["para_id"]: r for r in cascade.parse(df, "v12").collect()}
    src = {r["para_id"]: r for r in cascade.parse(df).collect()}
    assert (v12[1]["rule_branch"], v12[1]["parse_confidence"]) == ("C4", 0.6)
    assert src[2]["cross_references"] == ["BAR", "BAZ"] and src[2]["parse_confidence"] == 1.0
    assert v12[3]["variant_forms"] == ["fu", "fo"] and v12[3]["part_of_speech"] == "n."
    assert src[4]["headword"] == "foo," and src[5]["parse_confidence"] == 0.72
    assert [src[6][f"pronunciation_{i}"] for i in (2, 3, 4)] == ["c", "d", "e"] and src[6]["definition"].startswith("2. ")


def test_arrays(spark):
    df = spark.createDataFrame([(["/a/", " b ", None, "a", ""],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(A.clean_pronunciations("x")).collect()] == [["a", "b"], []]
    assert [r[0] for r in df.select(A.exact_list_match("x", F.array().cast("array<string>"))).collect()] == [False, True]
    assert [r[0] for r in df.select(A.to_text_list("x")).collect()] == [["/a/", "b", "a"], []]
    assert values(spark, A.ensure_list, ["a", " ", None]) == [["a"], [], []]


def test_lists_are_normalised_and_folded(spark):
    df = spark.createDataFrame([(["ﬁne", "Ａ", "x²", None, "fine"],), (["ΑᾼΣ", "Straße", "STRASSE"],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(A.clean_list("x")).collect()] == [["fine", "A", "x2"], ["ΑᾼΣ", "Straße", "STRASSE"], []]
    assert [r[0] for r in df.select(A.clean_pos("x")).collect()] == [["fine", "a", "x2"], ["ΑᾼΣ".casefold(), "strasse"], []]
    assert [r[0] for r in df.select(A.to_text_list("x")).collect()] == [["fine", "a", "x2", "", "fine"][:3] + ["fine"], ["ΑᾼΣ".casefold(), "strasse", "strasse"], []]
    inline = T.phrase_containment(T.match_text(F.lit("ﬁNE words ᾼ")), F.array(F.lit("Fine"), F.lit("αι")))
    assert df.select(inline).first()[0] and not df.select(T.phrase_containment(T.match_text(F.lit("x")), "x")).first()[0]


def test_merge_keeps_null_keys(spark):
    a = spark.createDataFrame([(1, "t", "h"), (2, "u", "h"), (None, "n", "h")], "entry_id int, source_text string, headword string")
    b = spark.createDataFrame([(1, "T", "h"), (3, "u", "h"), (None, "n", "h")], a.schema)
    got = compare.merge_outputs(a, b, fields=["source_text", "headword"])
    assert sorted((r["_merge"], r["source_text_exact_match"]) for r in got.collect()) == [("both", True), ("both", True), ("left_only", False), ("right_only", False)]


def test_metrics(spark):
    df = spark.createDataFrame([("a b c a".split(), "a a x c".split()), ([], ["z"])], "s array<string>, o array<string>")
    r = df.select(metrics.unordered_match(F.col("s"), F.col("o")).alias("m"), metrics.ordered_match_source_driven(F.col("s"), F.col("o"))["matched"].alias("src"), metrics.ordered_match_output_driven(F.col("s"), F.col("o"))["matched"].alias("out")).collect()
    assert (r[0]["m"]["precision"], r[0]["m"]["recall"], dict(r[0]["m"]["extra"]), dict(r[0]["m"]["missing"])) == (0.75, 0.75, {"x": 1}, {"b": 1})
    assert (r[0]["src"], r[0]["out"]) == (1, 2) and r[1]["m"]["recall"] is None


def test_audit_flags(spark):
    df = spark.createDataFrame([(1, "A"), (2, "AB & C"), (3, "x" * 1300 + ". " + "y " * 9), (4, "one two three four five six seven."), (5, "A")], "para_id int, text string")
    got = {r["para_id"]: r for r in audit.audit(df, duplicates=True).collect()}
    assert got[1]["flag_single_letter_header"] and got[1]["is_duplicate"] and got[5]["duplicate_group"] == 1
    assert got[2]["flag_all_caps_short"] is False and got[3]["flag_long"] and not got[4]["needs_review"]


def docx(path, paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")


def test_sources(spark, tmp_path):
    docx(tmp_path / "a.docx", ["A", " ", "craic /kræk/ n. fun."])
    (tmp_path / "other.txt").write_text("no document")
    assert readers.docx_paragraphs(spark, str(tmp_path)).count() == 2
    assert [(r["para_id"], r["text"]) for r in readers.docx_paragraphs(spark, str(tmp_path / "a.docx")).orderBy("para_id").collect()] == [(1, "A"), (3, "craic /kræk/ n. fun.")]
    forms = {"l.json": json.dumps([{"entry_id": "1", "entry_text": "a"}], indent=1), "m.json": json.dumps({"1": "a"}), "n.jsonl": '{"entry_id": "1", "entry_text": "a"}\n\n'}
    for name, body in forms.items():
        (tmp_path / name).write_text(body)
        assert [tuple(r) for r in readers.read_entries(spark, str(tmp_path / name)).collect()] == [("1", "a")]
    with pytest.raises(ValueError):
        readers.read_entries(spark, "x.xml")
    (tmp_path / "done.jsonl").write_text('{"entry_id": "4"}\nbroken\n{"entry_id": 4}\n')
    assert [r[0] for r in readers.done_ids(spark, str(tmp_path / "done.jsonl")).collect()] == ["4"]
    assert readers.done_ids(spark, str(tmp_path / "none")).count() == 0 and readers.load_map(None) == {}
    df = spark.createDataFrame([(float("nan"), ["a"], None, (float("nan"), 1), {"k": float("nan")})], "x double, y array<string>, z string, s struct<d: double, i: int>, m map<string, double>")
    sinks.write_jsonl(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"x": None, "y": ["a"], "z": None, "s": {"d": None, "i": 1}, "m": {"k": None}}
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["y"] == '["a"]'


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ["a"], True, "x < & \x01y"), (2, 1.5, None, None, None)], "i int, d double, l array<string>, b boolean, s string")
    sinks.write_workbook({"merged": df.orderBy("i"), "a/b" + "c" * 40: df.limit(0)}, str(tmp_path / "b.xlsx"))
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    assert {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"} <= set(parts)
    assert [s.get("name") for s in parts["xl/workbook.xml"][0]] == ["merged", "a_b" + "c" * 28]
    cells = [["".join(c.itertext()) for c in row] for row in parts["xl/worksheets/sheet1.xml"][0]]
    assert cells == [["i", "d", "l", "b", "s"], ["1", "", '["a"]', "1", "x < & y"], ["2", "1.5", "", "", ""]]
    workbook(str(tmp_path / "c.xlsx"), {"s": (["h"], [[i] for i in range(5)])}, most_rows=3)
    with zipfile.ZipFile(tmp_path / "c.xlsx") as z:
        assert [len(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml"))[0]) for k in (1, 2, 3)] == [3, 3, 2]


def test_batches_follow_the_input(spark, tmp_path):
    for name, body in {"a.json": json.dumps([{"entry_id": i, "entry_text": "good"} for i in ("b10", "b9", "b1")]), "b.json": json.dumps({i: "good" for i in ("b10", "b9", "b1")}), "c.jsonl": "".join(json.dumps({"entry_id": i, "entry_text": "good"}) + "\n" for i in ("b10", "b9", "b1"))}.items():
        (tmp_path / name).write_text(body)
        entries = readers.read_entries(spark, str(tmp_path / name), with_place=True)
        done = spark.createDataFrame([("b9",)], "entry_id string")
        assert [r["entry_id"] for r in extract.next_batch(entries, done, 0, 1, "place").collect()] == ["b10"]
        assert [r["entry_id"] for r in extract.next_batch(entries, done, 0, None).collect()] == ["b1", "b10"]


def stub():
    return lambda system, user: '{"headword": "h", "definition": "d", "part_of_speech": "n."}' if "good" in user else "none"


def test_command_lines(spark, tmp_path):
    docx(tmp_path / "a.docx", ["craic /kræk/ n. fun.", "gaffer n. a boss."])
    p = lambda x: str(tmp_path / x)
    for name, text in {"sys": "S", "prompt": "P {{ entry_text }}", "in.json": json.dumps({"1": "good", "2": "bad", "3": "good"})}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "c.yaml").write_text(json.dumps({"input_path": p("a.docx"), "output_jsonl": p("rules"), "audit_output": p("audit")}))
    cli.run_rules(spark, load_config(tmp_path / "c.yaml"))
    assert spark.read.schema(RULE_RECORD).json(p("rules")).count() == 2
    (tmp_path / "m.yaml").write_text(json.dumps({"input_path": p("in.json"), "output_jsonl": p("model"), "error_jsonl": p("bad"), "system_prompt": p("sys"), "parser_prompt": p("prompt"), "max_new_rows": 2}))
    config = load_config(tmp_path / "m.yaml")
    for _ in range(2):
        cli.run_model(spark, config, lambda: stub())
    assert sorted(r[0] for r in spark.read.schema(MODEL_RECORD).json(p("model")).select("entry_id").collect()) == ["1", "3"]
    (tmp_path / "e.yaml").write_text(json.dumps({"rule_output": p("rules"), "genai_output": p("model"), "merged_jsonl": p("merged"), "presence_csv": p("presence"), "exact_match_csv": p("exact"), "report_dir": p("report")}))
    cli.run_evaluation(spark, load_config(tmp_path / "e.yaml"))
    assert spark.read.json(p("merged")).groupBy("_merge").count().count() == 3
    assert spark.read.csv(p("presence"), header=True).count() == 11


def test_stream(spark, tmp_path):
    p = lambda x: str(tmp_path / x)
    (tmp_path / "in").mkdir()
    for i, text in enumerate(["good", "bad"]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"entry_id": str(i), "entry_text": text}))
        extract_stream(spark, p("in"), p("good"), p("bad"), p("check"), lambda: stub(), "S", "{{ entry_text }}").awaitTermination(120)
    assert [r[0] for r in spark.read.schema("entry_id string").json(p("good")).collect()] == ["0"]
    assert [r[0] for r in spark.read.schema("entry_id string").json(p("bad")).collect()] == ["1"]


def test_registry_and_diff(spark, tmp_path):
    runs = Registry(spark, str(tmp_path / "registry"))
    assert [runs.start("p", "1"), runs.start("p", "2")] == [1, 2]
    runs.update(2, n_records=5)
    assert {r["run_id"]: (r["previous_run_id"], r["n_records"]) for r in runs.frame().collect()} == {1: (None, None), 2: (1, 5)}
    assert runs.previous(2).first()["run_id"] == 1
    old = spark.createDataFrame([(1, "a", "x", ["p"]), (2, "b", "x", ["p"]), (3, "c", None, None)], "para_id int, source_text string, headword string, examples array<string>")
    new = spark.createDataFrame([(1, "A", "x", ["p"]), (2, "b", "x", ["q"]), (4, "d", "x", [])], old.schema)
    got = {r["para_id"]: (r["change_status"], r["changed_columns"], r["source_changed"]) for r in compare_runs(old, new, compare=["headword", "examples"]).collect()}
    assert got == {1: ("unchanged", [], True), 2: ("changed", ["examples"], False), 3: ("removed", [], False), 4: ("added", [], False)}


def test_normalise_model_forms(spark):
    df = spark.read.schema(MODEL_RECORD).json(spark.sparkContext.parallelize(['{"entry_id": "x7", "source_text": " s ", "data": {"headword": "H", "part_of_speech": "N."}}', '{"entry_id": "8", "data": {"part_of_speech": ["n.", "V."], "region_mentions": ["Cork", null]}}']))
    got = normalize.normalize_model(normalize.flatten_model(df), 1).orderBy("entry_id").collect()
    assert [r["entry_id"] for r in got] == [8, 9] and [r["part_of_speech"] for r in got] == [["n."], ["n.", "v."]] and got[1]["region_mentions"] == ["Cork"]
    assert extract.next_batch(spark.createDataFrame([("1", "a")], "entry_id string, entry_text string"), spark.createDataFrame([(1,)], "entry_id int")).count() == 0
