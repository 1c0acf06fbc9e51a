"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

The field's nodes are the tokens that could belong to such data. Neighbours in the text are linked as in a chain; tokens that
repeat each other, or hold the same number or mailbox, are linked however far apart they stand, each to the one before. Loopy
message passing over both kinds of links makes the labels of a document agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, steps, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on (about), tokens of one of them, and how sure an added label must be.
FIT_DOCS, FIT_TOKENS, SURE = 2_000, 100, 0.9
#: Rounds of messages, and the share of the old message that a new one keeps.
ROUNDS, DAMPING = 12, 0.3
#: Characters between two tokens that are still neighbours.
GAP = 2

# The patterns of the task. A look-behind keeps a run from being tried again at its every digit.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAILBOX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, by start, then kind."""
    out = []
    done = 0
    for m in _DOMAIN.finditer(text):
        at, low, width = m.start(), done, 64
        while True:  # the mailbox is all that stands before the sign, back to the last address
            tail = text[max(low, at - width) : at]
            n = len(tail) - len(tail.rstrip(_MAILBOX))
            if n < len(tail) or at - width <= low:
                break
            width *= 8
        if n:
            out.append((at - n, 0, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(_small(p) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_SIGN = re.compile(r"[0-9@]|[(\[](?:at|dot|\.)[)\]]", re.I)
_REST = re.compile(r"\S*")
_ENDS = "\"'`.,;:!?<>{}[]|*#$%&=~^\\/"
_CUES = [re.compile(p) for p in (r"mail|contact|write|reach", r"\bip\b|host|server|addr", r"card|visa|credit|pay", r"tel|phone|call|fax|mobile|sms")]
#: Upper bounds of the classes that counts fall into.
_DIGITS, _FEW = (0, 1, 3, 6, 7, 9, 12, 13, 15, 19), (0, 1, 2, 3)
_SPLIT_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_QUAD = re.compile(r"(\d{1,3})\D{1,3}?(\d{1,3})\D{1,3}?(\d{1,3})\D{1,3}?(\d{1,3})(?:\D.*)?")
_TOP = re.compile(r"(?:\.|[(\[](?:dot|\.)[)\]])[A-Za-z]{2,}$", re.I)


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that could be personal data: what stands between blanks around a digit or an at sign."""
    out, at = [], 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, m.start()).end()
        at = end
        while start < end and text[start] in _ENDS:
            start += 1
        while end > start and text[end - 1] in _ENDS:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def _class(n: int, bounds: tuple[int, ...]) -> int:
    return next((i for i, b in enumerate(bounds) if n <= b), len(bounds))


N_FEATURES = 1 + (len(_DIGITS) + 1) * 2 + (len(_FEW) + 1) * 3 + 12 + len(_CUES)


@dataclass
class Graph:
    """Tokens of one text with features (0/1) and links (first, second, kind: 0 neighbours, 1 skip)."""

    spans: np.ndarray
    features: np.ndarray
    links: np.ndarray


def graph_of(text: str) -> Graph:
    spans = tokens_of(text)
    n = len(spans)
    x = np.zeros((n, N_FEATURES), np.uint8)
    links: list[tuple[int, int, int]] = []
    words = [text[a:b] for a, b in spans]
    digits = [_digits(w) for w in words]
    near = [i > 0 and spans[i][0] - spans[i - 1][1] <= GAP for i in range(n)]
    runs: list[list[int]] = []
    for i in range(n):
        if near[i]:
            runs[-1].append(i)
            links.append((i - 1, i, 0))
        else:
            runs.append([i])
    joined = {}
    for run in runs:
        # A run's digits count for its tokens, up to what a number may have, so that long lists stay linear.
        for k, i in enumerate(run):
            joined[i] = "".join(digits[j] for j in run[max(0, k - 4) : k + 5])[:64]
    last: dict[str, int] = {}
    for i, w in enumerate(words):
        d = digits[i]
        letters = sum(c.isalpha() for c in w)
        dots, dashes = w.count("."), w.count("-")
        at = 1
        x[i, 0] = 1
        for value, bounds in ((len(d), _DIGITS), (len(joined[i]), _DIGITS), (letters, _FEW), (dots, _FEW), (dashes, _FEW)):
            x[i, at + _class(value, bounds)] = 1
            at += len(bounds) + 1
        quad = _QUAD.fullmatch(w[:64])
        parts = _SPLIT_AT.split(w, maxsplit=1)
        flags = (
            "@" in w, len(parts) == 2 and all(parts), w.startswith("+"), "(" in w or ")" in w, bool(quad), bool(quad) and all(int(p) <= 255 for p in quad.groups()), bool(_TOP.search(w[-32:])), 14 <= len(d) <= 19 and luhn(d),
            14 <= len(joined[i]) <= 19 and luhn(joined[i]), text[max(0, spans[i][0] - 1) : spans[i][0]] in ("=", ":", '"', "'", "/"), letters > 0 and re.fullmatch("[0-9a-f]{16,}", w, re.I) is not None, len(w) > 64,
        )
        x[i, at : at + len(flags)] = flags
        at += len(flags)
        before = text[max(0, spans[i][0] - 24) : spans[i][0]].lower()
        for cue in _CUES:
            x[i, at] = cue.search(before) is not None
            at += 1
        plain = re.sub(r"[\W_]", "", w).casefold()
        keys = {f"w{plain}"} if len(plain) >= 4 else set()
        if len(d) >= 7:
            keys.add(f"d{d[-7:]}")
        if len(parts) == 2 and len(parts[0]) >= 4:
            keys.add("w" + re.sub(r"[\W_]", "", parts[0]).casefold())
        for j in {last[k] for k in keys if k in last and not (near[i] and last[k] == i - 1)}:
            links.append((j, i, 1))
        for k in keys:
            last[k] = i
    return Graph(np.array(spans, np.int64).reshape(-1, 2), x, np.array(links, np.int64).reshape(-1, 3))


def labels_of(graph: Graph, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The kind (from 1; 0: none) of the first span that covers a token, at least in part."""
    out = np.zeros(len(graph.spans), np.int64)
    if found and len(out):
        starts, kinds, ends = (np.array(v) for v in zip(*found, strict=True))
        reach = np.maximum.accumulate(ends)
        first = np.searchsorted(reach, graph.spans[:, 0], "right")
        for i in np.flatnonzero(first < len(found)):
            for j in range(first[i], len(found)):
                if starts[j] >= graph.spans[i, 1]:
                    break
                if ends[j] > graph.spans[i, 0]:
                    out[i] = kinds[j] + 1
                    break
    return out


def _variants(value: str, kind: int) -> list[str]:
    """Other ways in which people write a value of that kind."""
    if kind == 0:
        box, host = value.split("@", 1)
        return [f"{box}(at){host}", f"{box}[at]{host.replace('.', '[dot]')}", f"{box}@{host.replace('.', '(dot)')}"]
    if kind == 1:
        return [value.replace(".", "[.]"), value.replace(".", "-")]
    digits = _digits(value)
    if kind == 2:
        return [sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sep in (".", "_", "/", "  ")]
    return [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"00{digits}"]


def lessons(text: str) -> list[tuple[Graph, np.ndarray]]:
    """The text's own graph with the patterns' labels, and for each found value its surroundings with the value written otherwise."""
    found = base_spans(text)
    own = graph_of(text)
    out = [(own, labels_of(own, found))]
    for a, kind, b in found[:8]:
        for other in _variants(text[a:b], kind):
            left, right = text[max(0, a - 60) : a], text[b : b + 60]
            g = graph_of(f"{left}{other}{right}")
            near = [(s - a + len(left), k, e - a + len(left)) for s, k, e in found if e <= a or s >= b]
            near = [(s if s < len(left) else s + len(other) - (b - a), k, e if s < len(left) else e + len(other) - (b - a)) for s, k, e in near]
            out.append((g, labels_of(g, sorted([*near, (len(left), kind, len(left) + len(other))]))))
    return out


@dataclass
class Field:
    """Weights of features by label, and of pairs of labels by kind of link."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, graphs: list[Graph]) -> list[np.ndarray]:
        """Probability of each label for each token, by loopy sum-product over all graphs at once."""
        sizes = [len(g.spans) for g in graphs]
        shift = np.r_[0, np.cumsum(sizes)]
        unary = np.concatenate([g.features @ self.weights for g in graphs])
        links = np.concatenate([g.links + [s, s, 0] for g, s in zip(graphs, shift, strict=False)])
        source, target = np.r_[links[:, 0], links[:, 1]], np.r_[links[:, 1], links[:, 0]]
        m, k = len(links), unary.shape[1]
        back = np.r_[np.arange(m, 2 * m), np.arange(m)]
        pairs = np.concatenate([self.pairs[links[:, 2]], self.pairs[links[:, 2]].transpose(0, 2, 1)])
        sent = np.zeros((2 * m, k))
        belief = unary.copy()
        for _ in range(ROUNDS if m else 0):
            rest = belief[source] - sent[back]
            top = rest[:, :, None] + pairs
            high = top.max(axis=1)
            fresh = high + np.log(np.exp(top - high[:, None, :]).sum(axis=1))
            fresh -= fresh.max(axis=1, keepdims=True)
            sent = DAMPING * sent + (1 - DAMPING) * fresh
            belief = unary.copy()
            np.add.at(belief, target, sent)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return np.split(p, shift[1:-1])


def train_field(lessons: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: every token's label given those of the tokens it is linked to; Adam over all lessons (features, links, labels).

    Pairs over skip links start from, and are drawn to, one in favour of equal labels.
    """
    k = len(KINDS) + 1
    shift = np.r_[0, np.cumsum([len(y) for _, _, y in lessons])]
    x = np.concatenate([f for f, _, _ in lessons]).astype(np.float32)
    y = np.concatenate([y for _, _, y in lessons])
    links = np.concatenate([e + [s, s, 0] for (_, e, _), s in zip(lessons, shift, strict=False)])
    prior = np.stack([np.zeros((k, k)), np.eye(k)])
    w, pairs = np.zeros((x.shape[1], k)), prior.copy()
    one = np.eye(k)[y]
    # Labels are known, so what linked tokens say is a fixed count by kind of link, side and label.
    before, after = np.zeros((2, len(y), k)), np.zeros((2, len(y), k))
    a, b, kind = links.T
    np.add.at(before, (kind, b), one[a])
    np.add.at(after, (kind, a), one[b])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    for step in range(1, epochs + 1):
        logits = x @ w + (before @ pairs + after @ pairs.transpose(0, 2, 1)).sum(axis=0)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - one) / len(y)
        down = before.transpose(0, 2, 1) @ gap + (after.transpose(0, 2, 1) @ gap).transpose(0, 2, 1)
        for i, (value, grad) in enumerate(((w, x.T @ gap + decay * w), (pairs, down + decay * (pairs - prior)))):
            first, second = moments[2 * i], moments[2 * i + 1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(w, pairs)


def fit_field(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field | None:
    """A field fitted on about `fit_docs` documents that hold a digit or an at sign, chosen by a hash; none where nothing is found.

    Labels are the patterns' own finds, in the text as it is and rewritten in other usual forms; no label of a table is used.
    """
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    if not n:
        return None
    chosen = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(n)) < fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for text in texts_of(batch, "text"):
                for g, y in lessons(text):
                    m = min(len(y), FIT_TOKENS)
                    links = g.links[(g.links[:, 1] < m)]
                    out.append({"n": m, "x": g.features[:m].tobytes(), "links": links.tobytes(), "y": y[:m].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("n", pa.int32()), ("x", pa.binary()), ("links", pa.binary()), ("y", pa.binary())]))

    taught = chosen.mapInArrow(run, "n int, x binary, links binary, y binary").collect()
    taught = [(np.frombuffer(r["x"], np.uint8).reshape(r["n"], -1), np.frombuffer(r["links"], np.int64).reshape(-1, 3), np.frombuffer(r["y"], np.int64)) for r in sorted(taught, key=lambda r: (bytes(r["x"]), bytes(r["y"]))) if r["n"]]
    return train_field(taught) if any(y.any() for _, _, y in taught) else None


def added_spans(graph: Graph, probability: np.ndarray, found: list[tuple[int, int, int]], sure: float = SURE) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens of one sure label that no pattern has touched."""
    label = probability.argmax(axis=1)
    fresh = (label > 0) & (probability.max(axis=1) >= sure) & (labels_of(graph, found) == 0)
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(fresh):
        a, b = graph.spans[i].tolist()
        if out and fresh[i - 1] and label[i - 1] == label[i] and a - graph.spans[i - 1, 1] <= GAP:
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((a, int(label[i]) - 1, b))
    return out


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a mark for each stretch that spans cover."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find_personal_data(docs: DataFrame, field: Field | None, with_text: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, counts and digest of what the patterns find, all spans (kind:start:end), the text without them.

    Null text is empty and has none; equal rows have equal results. Added spans never touch those of the patterns. Whole
    texts are read; a text's tokens that hold no digit and no at sign are no nodes, so prose costs no more than the patterns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = texts_of(batch, "text")
            base = [base_spans(t) for t in texts]
            graphs = [(i, g) for i, t in enumerate(texts) if field and _SIGN.search(t) and len((g := graph_of(t)).spans)]
            more: dict[int, list] = {}
            if graphs:
                for (i, g), p in zip(graphs, field.marginals([g for _, g in graphs]), strict=True):
                    more[i] = added_spans(g, p, base[i])
            shown = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            every = [sorted(f + more.get(i, [])) for i, f in enumerate(base)]
            columns = [pa.array([sum(k == kind for _, k, _ in f) for f in base], pa.int64()) for kind in range(len(KINDS))]
            columns += [pa.array([hashlib.sha256(shown(f).encode()).hexdigest() for f in base]), pa.array([shown(f) for f in every], pa.string()), pa.array([redacted(t, f) if with_text else None for t, f in zip(texts, every, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *[f.split()[0] for f in RESULT.split(", ")]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, run, f"doc_id {kind}, {RESULT}", ["doc_id", "text"], carry)
