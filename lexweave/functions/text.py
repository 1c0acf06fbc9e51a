"""Text expressions whose results follow Python's str and re, not Java's defaults."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as Python's \s has it; Java lacks the four separators even with (?U).
WS = r"[\s\x1c-\x1f]"
#: The same characters one by one, and a pattern for those among them that are not a single blank.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RAGGED = "[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  "

# Part-of-speech labels in the order in which they are tried.
POS_LABELS = (
    "personal pron.", "reflexive pron.", "pronominal phr.", "pres.part.", "n. phr.", "n.phr.", "v. phr.", "v.phr.", "n., v.", "n., adj.",
    "n. pl.", "n.pl.", "v. n.", "v.n.", "interj.", "exclam.", "def. art.", "prep.", "conj.", "pron.",
    "part.", "int.", "voc.", "phr.", "adj.", "adv.", "n.", "v.", "num.", "excl.",
)

#: Letters up to U+024F that NFKC leaves alone and casefold() below folds, and common marks beyond; all else goes to Python.
_STABLE = r"^[\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01ef\u01f4-\u024f\u0250-\u02af\u2010\u2012-\u2016\u2018-\u2023\u2027]*$"


def pos_pattern(profile: str = "src") -> str:
    """Alternatives for a part of speech; in profile `src` each ends in a blank, in `v12` none does."""
    tail = {"src": " ", "v12": ""}[profile]
    return "(?:" + "|".join(label.replace(".", r"\.") + tail for label in POS_LABELS) + ")"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_items(s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in v] for v in s], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _folded_items(s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [None if x is None else unicodedata.normalize("NFKC", x).casefold() for x in v] for v in s], dtype=object)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once a row: a fold over nothing, whose last step is `then`."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, lambda x: then(x))


def collapse(c: Column | str) -> Column:
    """One blank for each run of white space; only texts that hold others are rewritten."""
    return _one_line(strip(c))


def _one_line(c: Column) -> Column:
    return F.when(c.rlike(_RAGGED), F.regexp_replace(c, rf"(?U){WS}+", " ")).otherwise(c)


def normalize_entry_text(c: Column | str) -> Column:
    """One line, `/ , /` as `/, /`, no blank before , . ; and :; patterns are tried on texts that hold their signs only."""
    listed = lambda x: F.when(F.contains(x, F.lit("/")) & F.contains(x, F.lit(",")), F.regexp_replace(x, r"/ *, */", "/, /")).otherwise(x)
    parted = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(f" {sign}")) for sign in ",.;:"])
    closed = lambda x: F.when(parted(x), F.regexp_replace(x, r" +([,.;:])", "$1")).otherwise(x)
    return let(strip(c), lambda s: let(_one_line(s), lambda x: let(listed(x), closed)))


def _changeable(c: Column) -> Column:
    """Whether NFKC or casefold() may change a text; bytes are counted first, for ASCII needs no look at its letters."""
    return (F.octet_length(c) != F.length(c)) & ~c.rlike(_STABLE)


def normalize_unicode(c: Column | str) -> Column:
    """NFKC; only values that it may change are sent to Python."""
    c = col(c)
    return F.coalesce(_nfkc(F.when(_changeable(c), c)), c)


def _in_python(udf, c: Column) -> Column:
    """The UDF over arrays that hold an item which it may change; for others it gets an empty array.

    A null array would cost the Arrow writer a walk over all nulls of the batch before it.
    """
    odd = F.exists(c, _changeable)
    return F.when(odd, udf(F.when(odd, c).otherwise(F.array().cast(ArrayType(StringType()))))).otherwise(c)


def normalize_items(c: Column | str) -> Column:
    """NFKC of each item of an array; only arrays that it may change are sent to Python."""
    return _in_python(_nfkc_items, col(c))


def fold_items(c: Column | str) -> Column:
    """As normalize_items, with such arrays in full case folding too; casefold() does the rest."""
    return _in_python(_folded_items, col(c))


def is_nullish(c: Column | str, kind: str = "string") -> Column:
    """Null, blank text, an empty array or map, or NaN, by kind: string, array, map, double or other."""
    c = col(c)
    tests = {"string": lambda: strip(c) == "", "array": lambda: F.size(c) == 0, "map": lambda: F.size(c) == 0, "double": lambda: F.isnan(c)}
    return c.isNull() | F.coalesce(tests[kind](), F.lit(False)) if kind in tests else c.isNull()


def clean_text(c: Column | str, nfkc: bool = True) -> Column:
    """NFKC, one blank between words, null for nothing."""
    c = col(c)
    return F.nullif(collapse(normalize_unicode(c) if nfkc else c), F.lit(""))


def casefold(c: Column | str) -> Column:
    """Lower case, with ß as ss and final sigma as sigma; other letters that fold otherwise are folded with NFKC."""
    return F.translate(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def match_text(c: Column | str, nfkc: bool = True) -> Column:
    """Text for comparison without case, with plain quotes and dashes; null as the empty string."""
    c = col(c)
    folded = casefold(F.coalesce(_folded(F.when(_changeable(c), c)), c) if nfkc else c)
    return F.coalesce(collapse(F.translate(folded, "’‘“”–—", "''\"\"--")), F.lit(""))


def match_items(c: Column | str) -> Column:
    """match_text of each item of an array."""
    return F.transform(fold_items(c), lambda x: match_text(x, False))


def exact_text_match(a: Column | str, b: Column | str, nfkc: bool = True) -> Column:
    return match_text(a, nfkc) == match_text(b, nfkc)


def hash_text(c: Column | str) -> Column:
    return F.sha2(F.coalesce(col(c), F.lit("")), 256)


def int_from_id(c: Column | str) -> Column:
    """The digits at the end of an id as an integer."""
    digits = F.regexp_extract(strip(col(c).cast("string")), r"(\d+)\z", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def id_format(c: Column | str, prefix: str = "hde_") -> Column:
    return F.format_string(prefix + "%05d", col(c))


def _nonblank(c: Column) -> Column:
    return F.filter(F.transform(c, strip), lambda x: x != "")


def extract_examples(c: Column | str) -> Column:
    """Quoted spans, trimmed, without blank ones."""
    return _nonblank(F.regexp_extract_all(col(c), F.lit("[“\"](.*?)[”\"]"), F.lit(1)))


def extract_region_mentions(c: Column | str) -> Column:
    """Structs (code, place) from `(CODE, Place)`."""
    pattern = r"\(([A-Z&]{1,5}|[A-Z][A-Za-z]+),(?U:\s*)([A-Z][A-Za-z .-]+)\)"
    c = col(c)
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("code"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("place"))


_STOP = r"(?:[“\"]|(?U:\b)See(?U:\b))"


def split_definition_etymology(c: Column | str, stripped: bool = False) -> Column:
    """Struct (definition, etymology) of an entry's tail, parted at the first `<`.

    What follows a quotation mark or `See` in the etymology goes back to the definition. `stripped` says that the tail
    has no white space at its ends. Tails without `<` meet no pattern.
    """
    t = col(c) if stripped else strip(col(c))
    left = F.regexp_extract(t, r"(?s)^(.*?)\s<\s*(.*)\z", 1)
    right = F.regexp_extract(t, r"(?s)^(.*?)\s<\s*(.*)\z", 2)
    stopped = right.rlike(_STOP)
    head = F.when(stopped, F.regexp_extract(right, rf"(?s)^(.*?){_STOP}", 1)).otherwise(right)
    tail = strip(F.regexp_extract(right, rf"(?s)^.*?({_STOP}.*)\z", 1))
    cut = lambda x: F.btrim(x, F.lit(" .;"))
    none = F.lit(None).cast("string")
    holds = F.contains(t, F.lit("<"))
    only = t.startswith("<")
    marked = t.rlike(r"\s<")
    definition = F.when(~holds, F.nullif(cut(t), F.lit(""))).when(only, none).when(~marked, F.nullif(cut(t), F.lit(""))).otherwise(F.nullif(F.when(stopped, cut(F.concat(cut(left), F.lit(". "), tail))).otherwise(cut(left)), F.lit("")))
    etymology = F.when(~holds, none).when(only, cut(F.ltrim(t, F.lit("<")))).when(marked, F.nullif(cut(head), F.lit("")))
    empty = t.isNull() | (t == "")
    return F.struct(F.when(~empty, definition).alias("definition"), F.when(~empty, etymology).alias("etymology"))


def split_cross_references(c: Column | str) -> Column:
    """Targets parted by semicolons."""
    t = F.rtrim(strip(col(c)), F.lit("."))
    parts = F.transform(F.split(t, r"(?U)\s*;\s*"), lambda x: F.btrim(x, F.lit(" .;")))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def inline_cross_references(c: Column | str) -> Column:
    """Targets in capitals after See or see at the start, after a stop or a bracket."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?:^|[.;](?U:\s+)|\((?U:\s*))(?:See|see)(?U:\s+)([A-Z][A-Z0-9 \-’'.]+)"), F.lit(1))
    return F.transform(found, lambda x: F.btrim(x, F.lit(" .)")))


def words_of(matched: Column | str) -> Column:
    """Words of a text that is in comparison form already."""
    return F.regexp_extract_all(col(matched), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokenize(c: Column | str, nfkc: bool = True) -> Column:
    """Words of the comparison text."""
    return words_of(match_text(c, nfkc))


def char_len(c: Column | str, kind: str = "string") -> Column:
    c = col(c)
    if kind == "array":
        return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.coalesce(F.length(x), F.lit(0))), F.lit(0))
    return F.coalesce(F.length(c), F.lit(0))


def word_len(c: Column | str, kind: str = "string") -> Column:
    words = lambda x: F.coalesce(F.size(F.regexp_extract_all(x, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))), F.lit(0))
    return F.coalesce(F.aggregate(col(c), F.lit(0), lambda n, x: n + words(x)), F.lit(0)) if kind == "array" else words(col(c))


def phrase_containment(matched: Column | str, phrases: Column | str) -> Column:
    """Every phrase stands in the source, given as its match_text; true for none."""
    items = match_items(phrases)
    pairs = F.arrays_zip(items.alias("phrase"), F.array_repeat(col(matched), F.size(items)).alias("text"))
    return F.coalesce(F.forall(pairs, lambda x: F.contains(x["text"], x["phrase"])), F.lit(True))


def non_ascii(c: Column | str) -> Column:
    return col(c).rlike(r"[^\x00-\x7F]")


def line_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"\n")) + 1


def user_prompt(template: str, text: Column | str) -> Column:
    """The template with the stripped text in place of its mark."""
    return F.replace(F.lit(template), F.lit("{{ entry_text }}"), strip(text))
