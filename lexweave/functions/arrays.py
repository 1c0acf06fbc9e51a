"""Array, map and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, clean_text, col, fold_items, match_items, normalize_items, strip

NONE = "array<string>"


def ensure_list(c: Column | str, kind: str = "string") -> Column:
    """An array as it is or empty, a scalar as an array of one, nothing as an empty one."""
    c = col(c)
    if kind == "array":
        return F.coalesce(c, F.array().cast(NONE))
    return F.when(c.isNull() | (strip(c) == ""), F.array().cast(NONE)).otherwise(F.array(c))


def unique_keep_order(c: Column | str) -> Column:
    return F.array_distinct(col(c))


def _cleaned(c: Column | str) -> Column:
    items = F.transform(F.coalesce(col(c), F.array().cast(NONE)), lambda x: clean_text(x, False))
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull()))


def clean_list(c: Column | str) -> Column:
    """Each item in NFKC and cleaned, nothing dropped but nulls and repeats."""
    return _cleaned(normalize_items(c))


def exact_list_match(a: Column | str, b: Column | str) -> Column:
    return clean_list(a) == clean_list(b)


def clean_pronunciations(c: Column | str) -> Column:
    return _cleaned(F.transform(clean_list(c), lambda x: F.btrim(x, F.lit("/"))))


def clean_pos(c: Column | str) -> Column:
    return F.array_distinct(F.transform(_cleaned(fold_items(c)), casefold))


def clean_cross_refs(c: Column | str) -> Column:
    return F.array_distinct(F.transform(clean_list(c), F.upper))


def clean_examples(c: Column | str) -> Column:
    return clean_list(c)


def clean_region_values(c: Column | str, kind: str = "struct", profile: str = "v12") -> Column:
    """Structs (code, place) as code and place in turn (`v12`) or as their printed form (`src`)."""
    c = col(c)
    if kind == "string":
        return clean_list(c)
    if profile == "src":
        return clean_list(F.transform(c, lambda x: F.format_string("{'code': '%s', 'place': '%s'}", x["code"], x["place"])))
    return clean_list(F.flatten(F.transform(c, lambda x: F.array(x["code"], x["place"]))))


def rule_pronunciations(*columns: str) -> Column:
    return clean_pronunciations(F.array_compact(F.array(*columns)))


def apply_mapping(c: Column | str, mapping: dict[str, str] | Column | None) -> Column:
    """Each item by the map, itself where the map has none."""
    c = col(c)
    if mapping is None or (isinstance(mapping, dict) and not mapping):
        return F.array_distinct(F.array_compact(c))
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if isinstance(mapping, dict) else mapping
    return F.array_distinct(F.array_compact(F.transform(c, lambda x: F.coalesce(F.element_at(table, x), x))))


def to_text_list(c: Column | str, kind: str = "array") -> Column:
    """Comparison texts of an array, a map's values or a scalar, without empty ones."""
    c = col(c)
    items = {"array": lambda: c, "map": lambda: F.map_values(c), "string": lambda: F.array(c)}[kind]()
    return F.filter(match_items(F.coalesce(items, F.array().cast(NONE))), lambda x: x != "")


def safe_parse_json(c: Column | str) -> Column:
    """Struct (value VARIANT, error): the whole text, else from its first to its last brace."""
    c = strip(col(c))
    inner = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    value = F.coalesce(F.try_parse_json(c), F.try_parse_json(inner))
    kind = F.schema_of_variant(value)
    error = F.when(value.isNull(), "JSON parse failure").when(kind == "VOID", "JSON parse failure").when(~kind.startswith("OBJECT"), "reply is not an object")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


SCALARS = ("headword_raw", "headword", "part_of_speech", "definition", "etymology")
LISTS = ("pronunciations", "examples", "cross_references", "region_mentions")


def normalize_parsed_object(v: Column | str) -> Column:
    """Struct of five stripped strings and four arrays from a VARIANT object; wrong types are widened."""
    v = col(v)
    fields = []
    for name in SCALARS:
        text = F.try_variant_get(v, f"$.{name}", "string")
        fields.append(strip(F.coalesce(text, F.lit(""))).alias(name))
    for name in LISTS:
        many = F.try_variant_get(v, f"$.{name}", NONE)
        one = F.try_variant_get(v, f"$.{name}", "string")
        fields.append(F.coalesce(many, F.when(strip(one) != "", F.array(one)), F.array().cast(NONE)).alias(name))
    return F.struct(*fields)


def validate_parsed_object(o: Column | str) -> Column:
    """Struct (missing_headword, missing_definition, bad_examples, needs_review)."""
    o = col(o)
    head, definition, bad = F.coalesce(o["headword"], F.lit("")) == "", F.coalesce(o["definition"], F.lit("")) == "", o["examples"].isNull()
    return F.struct(head.alias("missing_headword"), definition.alias("missing_definition"), bad.alias("bad_examples"), (head | definition | bad).alias("needs_review"))


def parse_hash(columns: list[str]) -> Column:
    """SHA-256 of the values, by sorted name; equal for equal records."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
