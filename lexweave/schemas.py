"""Fixed schemas; nothing is inferred from data."""

from __future__ import annotations

# Names and order of the fields of every record.
PARAGRAPH = "para_id int, text string, text_hash string"
ENTRY = "entry_id string, entry_text string"
RULE_RECORD = (
    "entry_id int, para_id int, id string, source_text string, headword_raw string, headword string, variant_forms_raw string, variant_forms array<string>, "
    "pronunciation string, pronunciation_2 string, pronunciation_3 string, pronunciation_4 string, part_of_speech string, grammatical_labels array<string>, "
    "definition string, etymology string, cross_references array<string>, examples array<string>, region_mentions array<struct<code: string, place: string>>, "
    "entry_type string, parse_confidence double, parse_notes array<string>"
)
#: part_of_speech may be a string or an array, so it is read as VARIANT.
MODEL_DATA = "headword_raw string, headword string, variant_forms_raw string, variant_forms array<string>, pronunciations array<string>, part_of_speech variant, definition string, examples array<string>, etymology string, cross_references array<string>, region_mentions array<string>"
MODEL_RECORD = f"entry_id string, source_text string, data struct<{MODEL_DATA}>, flags struct<missing_headword boolean, missing_definition boolean, bad_examples boolean>, needs_review boolean"

CORE_FIELDS = ["entry_id", "source_text", "headword_raw", "headword", "variant_forms_raw", "variant_forms", "pronunciations", "part_of_speech", "definition", "examples", "etymology", "cross_references", "region_mentions", "needs_review"]
#: Fields compared as text; the rest of COMPARED is compared as lists.
TEXT_FIELDS = ["headword", "headword_raw", "definition", "etymology"]
LIST_FIELDS = ["variant_forms", "pronunciations", "part_of_speech", "examples", "cross_references", "region_mentions"]
COMPARED = ["headword_raw", "headword", "variant_forms_raw", "variant_forms", "pronunciations", "part_of_speech", "definition", "examples", "etymology", "cross_references", "region_mentions"]
# The fields that tell two runs' records apart.
COMPARE_COLS = ["entry_type", "headword_raw", "headword", "variant_forms_raw", "variant_forms", "pronunciation", "pronunciation_2", "pronunciation_3", "pronunciation_4", "part_of_speech", "grammatical_labels", "definition", "etymology", "cross_references", "examples", "region_mentions", "parse_confidence", "parse_notes"]
