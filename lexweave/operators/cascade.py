"""Ordered rules that turn an entry's text into a lexical record, as column expressions.

The first rule that fits wins. A rule has a test, and an expression for each field it sets; every
field of the record is one CASE over the chosen rule. Patterns are tried only where the text holds
what they can't do without. Two repair rules rewrite the text and start again, at most three times.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import number_rows
from .spreading import spread

REPAIRS = 3
STRINGS = ("headword_raw", "headword", "variant_forms_raw", "pronunciation", "pronunciation_2", "pronunciation_3", "pronunciation_4", "part_of_speech", "definition", "etymology")
ARRAYS = ("variant_forms", "grammatical_labels", "cross_references", "parse_notes")
# Abbreviations that get their dot back before a comma.
UNDOTTED = "adj|adv|prep|conj|pron|part|int|interj|voc|phr|n|v|num|excl|exclam"
RECORD = ["entry_id", "para_id", "id", "source_text", *STRINGS[:2], "variant_forms_raw", "variant_forms", *STRINGS[3:8], "grammatical_labels", "definition", "etymology", "cross_references", "examples", "region_mentions", "entry_type", "parse_confidence", "parse_notes", "rule_branch", "repair_depth"]


#: What a text must hold, in lower case, for a rule's pattern to have a chance; a rule needs all that are listed for it.
NEEDS = {
    "C1": ("/", "see"), "C2": (".", "see"), "C3": (",", "see"), "C4": (",", "see"), "C5": ("/", ",", "in the "), "C6": (",", "in the "), "C7": ("are commonly used",), "C8": ("abbreviation for",),
    "C9": (",",), "C10": ("/", "?", "."), "C11": ("/",), "C12": (".",), "C13": ("also",), "C14": ("/",), "C15": (),
}
MARKS = tuple(dict.fromkeys(m for needs in NEEDS.values() for m in needs))


def folded(t: Column) -> Column:
    """A text in lower case; the four letters that a pattern without case takes for s, i and k, though lower() doesn't, go first."""
    return F.lower(F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, "İıſK", "iisk")))


def _bits(low: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(low, F.lit(m)), 1 << i).otherwise(0) for i, m in enumerate(MARKS)])


def marks(t: Column) -> Column:
    """Bits for the MARKS that a text holds."""
    return _bits(folded(t))


def reachable(name: str, bits: Column) -> Column:
    """Whether a text with these bits can fit the rule at all."""
    mask = sum(1 << MARKS.index(m) for m in NEEDS[name])
    return bits.bitwiseAND(F.lit(mask)) == mask


def pattern_evaluations(records: DataFrame, profile: str = "src", text_col: str = "text", id_col: str = "para_id") -> DataFrame:
    """id, rule of the first round, and how many patterns are tried for it: in order, and with the rules out of reach left out."""
    own = spread(records.select(id_col, text_col)).select(id_col, T.normalize_entry_text(F.coalesce(text_col, F.lit(""))).alias("_text")).withColumn("_bits", marks(F.col("_text")))
    known = rules(F.col("_text"), F.col("_text"), profile)
    own = own.withColumn("_rule", _first(known, F.col("_bits")))
    tried = F.size(F.filter(F.slice(F.array(*[reachable(r.name, F.col("_bits")) for r in known]), F.lit(1), F.col("_rule")), lambda x: x))
    return own.select(id_col, _named(known, F.col("_rule")).alias("rule"), F.col("_rule").alias("in_order"), tried.alias("in_reach"))


def _first(known: list[Rule], bits: Column) -> Column:
    """The place, from 1, of the first rule that fits."""
    place = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(known, 1))):
        place = F.when(reachable(rule.name, bits) & rule.test, i).otherwise(place)
    return place


def _named(known: list[Rule], place: Column) -> Column:
    return F.get(F.array(*[F.lit(r.name) for r in known]), place - 1)


@dataclass
class Rule:
    """A test, the pattern and number of the groups that its fields are made from, and the tail that holds definition and etymology."""

    name: str
    test: Column
    pattern: str | None = None
    groups: int = 0
    fields: dict[str, Column] = field(default_factory=dict)
    tail: Column | None = None
    entry_type: str = "lexical"
    confidence: Column | float = 0.5
    note: str | None = None


#: White space but blanks is gone from a normalised text, so this can part its groups.
PART = "\x1f"


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*[F.nullif(x, F.lit("")) for x in items])) if items else F.array().cast("array<string>")


def _matched(t: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern from one match, each followed by PART but the last; a text that doesn't fit stays as it is.

    For patterns that begin with ^, over texts without PART.
    """
    return F.regexp_replace(t, pattern, PART.join(f"${i + 1}" for i in range(groups)) + (PART if groups == 1 else ""))


def _parts(matched: Column) -> Column:
    return F.split(matched, PART, -1)


def _parts_of_match(t: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern in a text, or null where it doesn't fit."""
    return T.let(_matched(t, pattern, groups), lambda m: F.when(F.contains(m, F.lit(PART)), _parts(m)))


def _lemma(raw: Column) -> dict[str, Column]:
    return {"headword_raw": raw, "headword": F.lower(raw)}


def rules(t: Column, original: Column, profile: str) -> list[Rule]:
    """The rules in order; their fields are made from `_groups`, the groups of the chosen rule, and columns of _staged().

    Texts are normalised, so a blank is the only white space at the ends of a group.
    Fixed values: the patterns, confidences and notes of every rule below.
    """
    pos = T.pos_pattern(profile)
    packed = pos.replace(" ", "")
    dash = "‑" if profile == "src" else "-"
    trim = lambda c: F.btrim(c, F.lit(" ,."))
    see = r"see\s+(.+?)\.?$"
    g = lambda i: F.get("_groups", F.lit(i - 1))
    out: list[Rule] = []

    def rule(name: str, pattern: str, groups: int, *more, test: Column | None = None, **named) -> None:
        fits = t.rlike(pattern)
        out.append(Rule(name, fits if test is None else fits & test, pattern, groups, *more, **named))

    p = rf"(?iu)^([^/]{{1,140}}?)\s*/([^/]+?)/\s*,?\s*{see}"
    rule("C1", p, 3, {**_lemma(trim(g(1))), "pronunciation": F.trim(g(2)), "cross_references": T.split_cross_references(g(3))}, entry_type="cross_reference", confidence=1.0, note=f"Parsed as cross{dash}reference entry with pronunciation")

    p = rf"(?iu)^([^/,.]{{1,140}}?)\s+({pos})\s*{see}"
    rule("C2", p, 3, {**_lemma(trim(g(1))), "part_of_speech": F.trim(g(2)), "cross_references": T.split_cross_references(g(3))}, entry_type="cross_reference", confidence=1.0, note=f"Parsed as cross{dash}reference entry with POS")

    p = rf"(?iu)^([^,]{{1,140}}?)\s*,\s*{see}"
    lemma = trim(F.regexp_extract(t, p, 1))
    rule("C3", p, 2, {**_lemma(trim(g(1))), "cross_references": T.split_cross_references(g(2))}, test=~lemma.rlike(f"(?iu){pos}") & ~lemma.rlike('[/:“"]'), entry_type="cross_reference", confidence=1.0, note=f"Parsed as cross{dash}reference entry")

    p = r"(?iu)^(.+?),\s*see\.?" + (r"\$" if profile == "src" else "$")
    rule("C4", p, 1, _lemma(trim(g(1))), entry_type="cross_reference", confidence=0.6, note=f"Incomplete cross{dash}reference target")

    labelled = f"Parsed as phrase/expression{dash}labelled entry"
    p = rf"(?iu)^([^/]+?)\s*/([^/]+)/(?:\s+({packed}))?\s*,\s*(in the phrase|in the expression)\s+(.+)$"
    more = {"cross_references": _inline(t)}
    rule("C5", p, 5, {**_lemma(F.trim(g(1))), "pronunciation": F.trim(g(2)), "part_of_speech": F.nullif(F.trim(g(3)), F.lit("")), "grammatical_labels": _list(F.lower(g(4))), **more}, tail=g(5), confidence=0.96, note=labelled)

    p = r"(?iu)^([^,]{1,140}),\s*(in the phrase|in the expression)\s*(.+)$"
    rule("C6", p, 3, {**_lemma(F.trim(g(1))), "grammatical_labels": _list(F.lower(g(2))), **more}, tail=g(3), confidence=0.90, note=labelled)

    p = r"(?iu)^([^,/]{1,140}?)\s+are commonly used\s+(.+)$"
    rule("C7", p, 2, {**_lemma(trim(g(1))), "grammatical_labels": _list(F.lit("are commonly used")), "definition": trim(g(2))}, entry_type="grammatical_note", confidence=0.82, note=f"Parsed as grammatical{dash}note entry")

    p = r"(?iu)^([A-Z][A-Z0-9&.'-]{1,20})\s+(abbreviation for)\s+(.+)$"
    rule("C8", p, 3, {**_lemma(F.trim(g(1))), "grammatical_labels": _list(F.lower(g(2))), "definition": trim(g(3))}, confidence=0.95)

    p = r"^([^/]{1,140}?)(?:\s*\(([^)]*)\))?,\s*(.+)$"
    rule("C9", p, 3, {**_lemma(F.trim(g(1))), "grammatical_labels": _list(F.trim(g(2)))}, test=~F.trim(F.regexp_extract(t, p, 3)).rlike(rf"(?U)^{pos}\b"), tail=g(3), confidence=0.83, note=f"Parsed as comma{dash}definition entry")

    rule("C10", rf"^(.+?)\s*/([^/]+?)\?\s+({pos}.+)$", 3)

    rule("C11", PRONOUNCED, 3, _pronounced(t), tail=F.when(F.col("_labelled").isNotNull(), _labelled(3)).otherwise(F.col("_rest")), confidence=F.when(F.col("_labelled").isNotNull(), 0.90).otherwise(0.72))

    rule("C12", rf"^([^/]{{1,120}}?)\s+({pos}.+)$", 2, {**_lemma(F.trim(g(1))), "part_of_speech": _labelled(1), "grammatical_labels": _list(_labelled(2))}, tail=_labelled(3), confidence=0.78)

    p = r"(?iu)^([^/]{1,120}?)\s+also\s+([^/]{1,120}?)\s+(.+)$"
    head, variant = F.trim(g(1)), F.trim(g(2))
    rule("C13", p, 3, {**_lemma(head), "variant_forms_raw": F.concat(head, F.lit(" also "), variant), "variant_forms": _list(variant)}, tail=g(3), confidence=0.74, note=f"Parsed as variant{dash}without{dash}pronunciation entry")

    rule("C14", r"^(.+?)\s+([^ ]+/)\s*(.+)$", 3)

    first = F.substring_index(t, " ", 1)
    out.append(Rule("C15", F.lit(True), fields={**_lemma(first), "definition": original if profile == "src" else t}, entry_type="unparsed", confidence=0.2, note="Could not confidently parse entry structure"))
    return out


def _inline(t: Column) -> Column:
    return F.when(F.contains(t, F.lit("ee ")), T.inline_cross_references(t))


def _dotted(rest: Column) -> Column:
    return F.when(F.contains(rest, F.lit(",")), F.regexp_replace(rest, rf"(?iu)^({UNDOTTED})\s*,", "$1.,")).otherwise(rest)


PRONOUNCED = r"^(.+?)\s*/([^/]+)/(.*)$"


def _staged(df: DataFrame, profile: str, c11: Column, c12: Column) -> DataFrame:
    """Columns that C11 builds step by step: `lemma /pron/ rest`, further pronunciations, variants, sense number.

    C12 shares the last step, the label at the start. Each step is a column of its own, so no expression holds another
    twice; each pattern is matched once, and only where the text holds its signs.
    """
    pos = T.pos_pattern(profile)
    part = lambda c, i: F.get(c, F.lit(i - 1))
    holds = lambda c, *signs: reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in signs])
    run = r"^((?:\s*,\s*/[^/]+/)*)(.*)$"
    df = df.withColumns({"_left": F.when(c11, F.trim(part("_groups", 1))), "_rest": F.when(c11, F.trim(part("_groups", 3)))})
    pieces = F.transform(F.split("_left", r"(?U)\s+also\s+|,\s*"), lambda x: F.trim(x))
    df = df.withColumns({"_pieces": F.when(holds("_left", "also", ","), pieces).otherwise(F.array("_left")), "_run": F.when(holds("_rest", "/"), _parts_of_match(F.col("_rest"), run, 2))})
    df = df.withColumns({
        "_extra": F.when(F.col("_run").isNotNull(), F.transform(F.regexp_extract_all(part("_run", 1), F.lit("/([^/]+)/"), F.lit(1)), lambda x: F.trim(x))),
        "_head": F.lower(part("_pieces", 1)),
        "_split": part("_pieces", 1) != F.col("_left"),
        "_rest": F.btrim(F.when(F.col("_run").isNotNull(), part("_run", 2)).otherwise(F.col("_rest")), F.lit(" ,;")),
    })
    others = F.filter("_pieces", lambda v: (v != "") & (F.lower(v) != F.col("_head")))
    df = df.withColumns({"_variants": F.when(F.col("_split"), others).otherwise(_list()), "_raw": F.when(F.col("_split"), F.col("_left"))})
    if profile != "src":  # in `src` the look-ahead can never be met
        lead = rf"(?iu)^((?:also|sometimes also)\s+.*?)(?=\s+{pos}(?:\s|,|$))"
        also = F.col("_bits").bitwiseAND(F.lit(1 << MARKS.index("also"))) != 0
        df = df.withColumn("_lead", F.when(also & F.col("_rest").rlike(lead), F.regexp_extract("_rest", lead, 1)))
        clean = F.regexp_replace(F.trim("_lead"), r"(?iu)^(?:also|sometimes also)\s+", "")
        df = df.withColumn("_clean", F.btrim(F.regexp_replace(F.trim(clean), "/[^/]+/", ""), F.lit(" ,;")))
        df = df.withColumn("_clean", F.btrim(F.regexp_replace("_clean", r"(?iuU)\betc\.$", ""), F.lit(" ,;")))
        more = F.filter(F.transform(F.split("_clean", r"(?U),\s*|\s+or\s+"), lambda v: F.btrim(v, F.lit(" .;,"))), lambda v: (v != "") & (F.lower(v) != F.col("_head")))
        found = F.col("_lead").isNotNull()
        df = df.withColumns({
            "_variants": F.when(found, F.concat("_variants", F.array_except(more, "_variants"))).otherwise(F.col("_variants")),
            "_raw": F.when(found, F.concat_ws("; ", "_raw", F.trim("_lead"))).otherwise(F.col("_raw")),
            "_rest": F.when(found, F.ltrim(F.substring("_rest", F.length("_lead") + 1, F.length("_rest")), F.lit(" ,;"))).otherwise(F.col("_rest")),
        })
    df = df.withColumn("_numbered", _parts_of_match(F.col("_rest"), r"^(\d+\.)\s*(.+)$", 2))
    sense = F.col("_numbered").isNotNull()
    plain = F.when(c12, F.trim(part("_groups", 2))).otherwise(F.when(sense, F.trim(part("_numbered", 2))).otherwise(F.col("_rest")))
    df = df.withColumns({"_sense": part("_numbered", 1), "_rest": T.let(plain, _dotted)})
    return df.withColumn("_labelled", _parts_of_match(F.col("_rest"), rf"^({pos})(?:\s*\(([^)]*)\))?(.*)$", 3))


def _labelled(i: int) -> Column:
    """The label at the start, what follows it in brackets, and the rest; each empty where there is no label."""
    part = F.coalesce(F.get("_labelled", F.lit(i - 1)), F.lit(""))
    return F.ltrim(part, F.lit(" ,")) if i == 3 else F.trim(part)


def _pronounced(t: Column) -> dict[str, Column]:
    """Fields of C11 over the columns of _staged()."""
    known, definition = F.col("_labelled").isNotNull(), F.col("_both.definition")
    return {
        "headword_raw": F.col("_left"),
        "headword": F.col("_head"),
        "variant_forms_raw": F.col("_raw"),
        "variant_forms": F.col("_variants"),
        "pronunciation": F.trim(F.get("_groups", F.lit(1))),
        **{f"pronunciation_{i + 2}": F.get("_extra", F.lit(i)) for i in range(3)},
        "part_of_speech": F.when(known, _labelled(1)),
        "grammatical_labels": F.when(known, _list(_labelled(2))).otherwise(_list()),
        "definition": F.when(F.col("_sense").isNotNull() & definition.isNotNull(), F.concat("_sense", F.lit(" "), definition)).otherwise(definition),
        "cross_references": _inline(t),
        "parse_notes": F.when(known, _list()).otherwise(_list(F.lit("POS not confidently parsed"))),
    }


# What a repair notes, and the confidence it keeps at least.
NOTES = {"C10": ("Recovered malformed pronunciation closer", 0.78), "C14": ("Recovered malformed pronunciation delimiter", 0.75)}


PLACE = {name: i for i, name in enumerate(NEEDS, 1)}


def _groups(chosen: list[Rule], t: Column, rule: Column) -> Column:
    """The groups of the row's rule from one match; null where it is not among the chosen."""
    matched = F.lit(None).cast("string")
    for r in chosen:
        matched = F.when(rule == PLACE[r.name], _matched(t, r.pattern, r.groups)).otherwise(matched)
    return T.let(matched, _parts)


def _settled(t: Column, original: Column, profile: str) -> Column:
    """Struct (text, original, trail, rule, bits, again) of an entry once no repair is left to do.

    The rounds are one fold, so the rules stand in the plan once; unrolled they make one method that the JVM never compiles.
    """

    def state(text, original, trail, rule, bits, again) -> Column:
        kinds = {"text": "string", "original": "string", "trail": "array<string>", "rule": "int", "bits": "int", "again": "boolean"}
        return F.struct(*[v.cast(kind).alias(k) for v, (k, kind) in zip((text, original, trail, rule, bits, again), kinds.items(), strict=True)])

    def repaired(s: Column, last: Column, bits: Column, rule: Column, g: Column, known: list[Rule]) -> Column:
        part = lambda i: F.get(g, F.lit(i - 1))
        pron = F.when(rule == PLACE["C10"], F.trim(part(2))).otherwise(F.trim(F.rtrim(part(2), F.lit("/"))))
        fixed = F.concat(part(1), F.lit(" /"), pron, F.lit("/ "), part(3))
        stuck = state(s["text"], s["original"], s["trail"], F.lit(PLACE["C15"]), bits, F.lit(False))
        more = lambda f, n: state(n, f, F.concat(F.array(_named(known, rule)), s["trail"]), rule, bits, F.lit(True))
        return T.let(fixed, lambda f: T.let(T.normalize_entry_text(f), lambda n: F.when(last | (n == s["text"]), stuck).otherwise(more(f, n))))

    def round_of(s: Column, depth: Column) -> Column:
        known = rules(s["text"], s["original"], profile)
        repairs = [r for r in known if r.name in NOTES]
        done = lambda bits, rule: state(s["text"], s["original"], s["trail"], rule, bits, F.lit(False))
        judged = lambda bits, rule: F.when(rule.isin(*[PLACE[n] for n in NOTES]), T.let(_groups(repairs, s["text"], rule), lambda g: repaired(s, depth == REPAIRS, bits, rule, g, known))).otherwise(done(bits, rule))
        tried = T.let(folded(s["text"]), lambda low: T.let(_bits(low), lambda bits: T.let(_first(known, bits), lambda rule: judged(bits, rule))))
        return F.when(s["again"], tried).otherwise(s)

    none = F.lit(None)
    return F.aggregate(F.array(*[F.lit(i) for i in range(REPAIRS + 1)]), state(t, original, F.array(), none, none, F.lit(True)), round_of)


def parse(df: DataFrame, profile: str = "src", text_col: str = "text", id_col: str = "para_id", renumber: bool = False) -> DataFrame:
    """One record for each row of (para_id, text).

    Null text is parsed as empty. With `renumber` ids count the rows by the order of their ids, then of their texts.
    A text that a repair leaves as it was, or that needs a fourth repair, is unparsed.
    """
    df = df.select(id_col, text_col)
    df = number_rows(df, id_col, text_col, name="_number", keep=[text_col]) if renumber else spread(df)
    own = df.select(F.col("_number" if renumber else id_col).cast("int").alias("para_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_original"))
    own = own.withColumn("_text", T.normalize_entry_text("_original")).withColumn("_state", _settled(F.col("_text"), F.col("_original"), profile))
    own = own.select("para_id", *[F.col(f"_state.{c}").alias(f"_{c}") for c in ("text", "original", "trail", "rule", "bits")])
    known = rules(F.col("_text"), F.col("_original"), profile)
    is_rule = lambda name: F.col("_rule") == PLACE[name]
    own = own.withColumn("_groups", _groups([r for r in known if r.fields and r.pattern], F.col("_text"), F.col("_rule")))
    own = _staged(own, profile, is_rule("C11"), is_rule("C12"))

    def pick(value) -> Column:
        out = None
        for rule in known:
            v = value(rule)
            if v is not None:
                out = F.when(is_rule(rule.name), v) if out is None else out.when(is_rule(rule.name), v)
        return out

    own = own.withColumn("_both", T.let(F.trim(pick(lambda r: r.tail)), lambda tail: T.split_definition_etymology(tail, stripped=True)))
    tailed = {"definition": F.col("_both.definition"), "etymology": F.col("_both.etymology")}
    fields = {r.name: (tailed if r.tail is not None else {}) | r.fields for r in known}
    columns = {c: pick(lambda r, c=c: fields[r.name].get(c)) for c in STRINGS}
    columns |= {c: F.coalesce(pick(lambda r, c=c: fields[r.name].get(c)), _list()) for c in ARRAYS[:-1]}
    notes = F.coalesce(pick(lambda r: _list(F.lit(r.note)) if r.note else r.fields.get("parse_notes")), _list())
    trail = F.transform("_trail", lambda x: F.when(x == "C10", NOTES["C10"][0]).otherwise(NOTES["C14"][0]))
    least = F.greatest(*[F.when(F.array_contains("_trail", n), v).otherwise(0.0) for n, (_, v) in NOTES.items()])
    columns["parse_notes"] = F.when(F.size("_trail") == 0, notes).otherwise(F.concat(notes, trail))
    columns["parse_confidence"] = F.greatest(pick(lambda r: r.confidence if isinstance(r.confidence, Column) else F.lit(r.confidence)), least)
    columns["entry_type"] = pick(lambda r: F.lit(r.entry_type))
    columns |= {"entry_id": F.col("para_id"), "para_id": F.col("para_id"), "id": T.id_format("para_id"), "source_text": F.col("_text"), "examples": T.extract_examples("_text"), "region_mentions": T.extract_region_mentions("_text"), "rule_branch": _named(known, F.col("_rule")), "repair_depth": F.size("_trail")}
    return own.select(*[columns[c].alias(c) for c in RECORD])
