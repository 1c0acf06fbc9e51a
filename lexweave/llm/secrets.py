"""Secret scan: fixed patterns, and password guess cost for values in credential context (operator 10)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, steps, texts_of, written

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Names of credentials, those of ASSIGN too; the guess cost judges the whole value after them. Short ones also end
#: other words (Compass, spin), so they begin a word, or a part of one in camel case.
_NAMES = r"(?:pass(?:phrase|code|wor[dt]|wd)|pwd|secret|token|api_?key|private_?key|access_?key|client_?secret|kennwort|contraseña|(?:(?<![^\W\d_])|(?<=(?-i:[a-z]))(?=(?-i:[A-Z])))(?:pass|credentials?|auth|bearer|pin|mot\x20de\x20passe))"
#: A value goes to its closing quote, or to a space, a quote that closes, a tag, or a mark before a space or a further name.
_BARE = r"""(?:[^\s"'<>|,;]|["'](?=\w)|[,;|](?!\s|\Z|["'\])}]|[\w-]+["']?\x20*[:=])|<(?!\s|\Z|/?[a-z][^<>]*>)|>(?!\s|\Z))"""
CONTEXT = re.compile(rf"""{_NAMES}["']?\x20*[:=]\x20*(?!["']?{_NAMES}["']?\x20*[:=])(?:"((?:[^"\\\n]|\\.){{6,}})"|'((?:[^'\\\n]|\\.){{6,}})'|["']?({_BARE}{{6,}}))""", re.I)
CONTEXT_HINTS = ("pass", "pwd", "credential", "auth", "bearer", "key", "secret", "token", "pin", "kennwort", "contraseña")
#: log10 of guesses from which a value counts as a secret.
MIN_COST = 10.0
#: log10 of guesses that a further part adds.
JOIN = 0.3

# Common parts of passwords by rank, and rows of keyboards.
COMMON = "password qwerty dragon monkey letmein login welcome admin master hello football baseball shadow sunshine princess secret iloveyou trustno abc love user root test guest default changeme example none null true false your here placeholder string value name the and for with this that have from".split()
RANKS = {word: rank for rank, word in enumerate(COMMON, 1)}
#: Words of the corpus, without those in values such as keys; a part of a value is a word of up to so many letters.
WORD = re.compile(r"(?<!\w)[^\W\d_]{2,}+(?!\w)")
WORD_MOST = 32
_FLUSH = 500_000
#: Words of a guesser's dictionary, the most frequent ones of the corpus; the rest is no better known than brute force.
WORDS_MOST = 100_000
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik,9ol.0p;", "qwertzuiop", "azertyuiop")
_LINES = [line for row in (*ROWS, "abcdefghijklmnopqrstuvwxyz") for line in (row, row[::-1])]
LEET = str.maketrans("4@310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?\d{1,2}(?:[-/._]?\d{1,2})?)?|\d{1,2}[-/._]\d{1,2}[-/._](?:19|20)?\d\d")


def _walk(value: str, i: int) -> int:
    """Length of the longest keyboard or alphabet run at i of a lower-case value, forwards or backwards; at most a row's."""
    most = 1
    for line in _LINES:
        at = line.find(value[i])
        n = 1
        while at >= 0 and i + n < len(value) and at + n < len(line) and value[i + n] == line[at + n]:
            n += 1
        most = max(most, n)
    return most


def _plain(value: str) -> tuple[str, str]:
    """A value in lower case, letter by letter, and the same with digits and marks read as letters."""
    plain = "".join(low if len(low := c.lower()) == 1 else c for c in value)
    return plain, plain.translate(LEET)


def guess_cost(value: str, ranks: dict[str, int] = RANKS) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for a value, and the cheapest split into (kind, start, end).

    A span is a word of `ranks` (also in leet or mixed case), a date, a repeat of one block, a keyboard walk or
    brute force. Parts add up in log10, and each further part costs JOIN, for the guesser must also know the order.
    Words, dates and walks have a greatest length and blocks of repeats have 8 characters at most, so
    the work is linear in the value, which is judged whole.
    """
    n = len(value)
    # same[b][i]: how far value[i:] agrees with value[i + b:].
    same = [[0] * (n + 1) for _ in range(min(8, n // 2) + 1)]
    for block in range(1, len(same)):
        row = same[block]
        for i in range(n - block - 1, -1, -1):
            row[i] = row[i + 1] + 1 if value[i] == value[i + block] else 0
    spans: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
    plain, soft = _plain(value)
    for i in range(n):
        for j in range(i + 1, min(n, i + WORD_MOST) + 1):
            if not soft[j - 1].isalpha():
                break
            for text, more in ((plain, 0.0), (soft, 0.5)):
                if rank := ranks.get(text[i:j]):
                    cased = 0.0 if value[i:j].islower() else 0.5
                    spans[i].append((j, math.log10(rank + 1) + more + cased, "word"))
        if m := DATE.match(value, i):
            spans[i].append((m.end(), 2.1 if m.end() - i == 4 else 4.6, "date"))
        if (run := _walk(plain, i)) >= 3:
            spans[i].append((i + run, 1.7 + math.log10(run), "walk"))
        for block in range(1, min(16, n - i) // 2 + 1):
            times = same[block][i] // block + 1
            if times >= 2 and times * block >= 3:
                spans[i].append((i + times * block, block * 1.4 + math.log10(times), "repeat"))
    # Least cost of value[:j] whose last part is brute force (0) or another (1), and how it came about.
    best = [[0.0, 0.0]] + [[math.inf, math.inf] for _ in range(n)]
    back: list[list[tuple[int, int, str]]] = [[(0, 0, ""), (0, 0, "")] for _ in range(n + 1)]
    for i in range(n):
        c = value[i]
        single = 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else 1.5
        for j, cost, kind in [(i + 1, single, "brute"), *spans[i]]:
            ends = int(kind != "brute")
            for state in (0, 1):
                total = best[i][state] + cost + (0.0 if i == 0 or state == ends == 0 else JOIN)
                if total < best[j][ends]:
                    best[j][ends], back[j][ends] = total, (i, state, kind)
    parts, j, state = [], n, int(best[n][1] < best[n][0])
    least = min(best[n])
    while j:
        i, state, kind = back[j][state]
        if kind == "brute" and parts and parts[-1][0] == "brute" and parts[-1][1] == j:
            parts[-1] = ("brute", i, parts[-1][2])
        else:
            parts.append((kind, i, j))
        j = i
    return least, parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of every base match, in order."""
    low = text.lower()
    found = []
    if any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of every value in credential context."""
    low = text.lower()
    if not any(x in low for x in CONTEXT_HINTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m[m.lastindex].rstrip(".)]}") if m.lastindex == 3 else m[m.lastindex]
        out.append((m.start(m.lastindex), m.start(m.lastindex) + len(value)))
    return out


def find_secrets(text: str, min_cost: float = MIN_COST, ranks: dict[str, int] = RANKS) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and the values in credential context that the guess cost finds, whether or not they overlap those."""
    base = base_spans(text)
    added = []
    for a, b in context_values(text):
        value = text[a:b]
        if len(value) >= 6 and guess_cost(value, ranks)[0] >= min_cost:
            added.append((a, 3, b, a))
    return base, added


def word_ranks(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Ranks of the words of all texts that occur in some value in credential context.

    A word's rank is the number of words that are at least as frequent, from sums of all words outside
    such values, so that a secret never makes itself a word. A guesser's dictionary has the words of rank
    WORDS_MOST or better, which bounds what reaches the driver and is broadcast; of them only those that a value holds come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        asked: set[str] = set()

        def out() -> pa.RecordBatch:
            words = [*counts, *asked]
            n, ask = [*counts.values(), *[0] * len(asked)], [*[False] * len(counts), *[True] * len(asked)]
            counts.clear()
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(ask, pa.bool_())], names=["word", "n", "asked"])

        for batch in steps(batches):
            for text in texts_of(batch, "text"):
                at, rest = 0, []
                for a, b in context_values(text):
                    rest.append(text[at:a])
                    at = b
                    for form in set(_plain(text[a:b])):
                        for i in range(len(form)):
                            for j in range(i + 1, min(len(form), i + WORD_MOST) + 1):
                                if not form[j - 1].isalpha():
                                    break
                                if j > i + 1:
                                    asked.add(form[i:j])
                        if len(asked) > _FLUSH:
                            yield out()
                counts.update(WORD.findall("\0".join([*rest, text[at:]]).lower()))
                if len(counts) > _FLUSH:
                    yield out()
        yield out()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long, asked boolean")
    held = written(rows.groupBy("word").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).where(F.col("n") > 0), "words")
    ranks, rank = {}, 0
    for r in held.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(WORDS_MOST).collect():
        rank += r["words"]
        if rank > WORDS_MOST:
            break
        ranks[r["n"]] = rank
    known = held.where(F.col("asked") & (F.col("n") >= min(ranks, default=1 << 62))).select("word", "n")
    own = {r["word"]: ranks[r["n"]] for r in known.collect()}
    discard(held)
    return own | {word: min(rank, own.get(word, rank)) for word, rank in RANKS.items()}


def _join(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))


def scan_secrets(docs: DataFrame, min_cost: float = MIN_COST, with_text: bool = True, carry: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text, one row per document, in code points with the end exclusive.

    spans holds the base matches and those the guess cost adds, which may overlap; redacted is the text with the
    secret part of each span replaced by [SECRET] (null without `with_text`);
    `carry` adds the input row as the struct `row`. A first pass counts the words of the whole table for the guess cost,
    a second one scans; only sums of words are shuffled. Null text counts
    as empty, rows with the same id are scanned each for itself, an empty table gives no row.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, redacted string"
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for name, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                base, added = find_secrets(text, min_cost, ranks.value)
                kinds = [k for _, k, _, _ in (*base, *added)]
                clean, at = [], 0
                for start, end in sorted((v, e) for _, _, e, v in (*base, *added)):
                    if start >= at:
                        clean += [text[at:start], "[SECRET]"]
                    at = max(at, end)
                rows.append({"doc_id": name, **{f"n_{kind}": kinds.count(k) for k, kind in enumerate(KINDS)}, "base_sha256": hashlib.sha256(_join(base).encode()).hexdigest(), "spans": _join([*base, *added]), "redacted": "".join([*clean, text[at:]]) if with_text else None})
            fields = [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return map_texts(docs, run, schema, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], carry)
