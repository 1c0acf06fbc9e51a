"""Token ids of whole texts by a tokenizer file, with a cache of words."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The parts of a tokenizer file for which cutting into words beforehand is exact.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters on which normalisation and lower-casing act alike in every library: no
#: controls, nothing that composes, nothing whose lower case depends on its neighbours.
_PLAIN = [c for c in map(chr, [*range(9, 14), *range(32, 127), *range(160, 0x180), *range(0x2010, 0x2028)]) if c not in "İŉ"]


def _members(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


class TokenEncoder:
    """encode(texts) gives one uint32 array per text, the same ids as the library's own encode().

    A tokenizer that lower-cases and splits at words is fed word by word: every word of a
    text is looked up in a bounded cache and only new words reach the library. Texts with
    characters outside the plain range or with one of the file's added tokens, in any case of
    letters, and other kinds of tokenizers, go to the library whole.
    """

    def __init__(self, spec: str, cache_words: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        added = [t["content"].lower() for t in parts.get("added_tokens", []) if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        sign = os.path.commonprefix(added)
        #: What every added token begins with, if it has no letters: a text without it needs no closer look.
        self.sign = sign if sign.upper() == sign else ""
        normal = [x.get("type") for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = normal == WORD_NORMALIZERS and split[:1] == [WORD_SPLIT]
        letters, numbers, spaces = _members("L"), _members("N"), r"\t-\r \xa0"
        self.odd = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        if self.by_word:
            # New words go to the same model as one text of words parted by blanks; a token
            # that carries the word-end mark closes a word.
            byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            blank = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            bare = parts | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blank, byte_level]}}
            self.words = Tokenizer.from_str(json.dumps(bare))
            self.words.encode_special_tokens = True
            mark = parts["model"].get("end_of_word_suffix") or "\0"
            self.closes = np.zeros(self.words.get_vocab_size(), dtype=bool)
            for token, at in self.words.get_vocab().items():
                self.closes[at] = token.endswith(mark)
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(ends) == len(new):
            raw = ids.tobytes()
            self.cache.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        else:
            self.cache.update((word, own.tobytes()) for word, own in zip(new, self._whole(new), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._whole(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        words: dict[int, list[str]] = {}
        rest = []
        for i, text in enumerate(texts):
            if self.odd.search(text) or (self.added and self.sign in text and self.added.search(text.lower())):
                rest.append(i)
            else:
                words[i] = self.word.findall(text.lower())
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        known = self.cache
        new = [w for w in set().union(*words.values()) if w not in known]
        for at in range(0, len(new), 2048):
            self._learn(new[at : at + 2048])
        for i, own in words.items():
            out[i] = np.frombuffer(b"".join(map(self.cache.__getitem__, own)), dtype=np.uint32)
        return out


_ENCODERS: dict[int, TokenEncoder] = {}


def encoder(spec: str) -> TokenEncoder:
    """This worker's encoder for a tokenizer file's content."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TokenEncoder(spec)
    return _ENCODERS[key]


def read_spec(path: str) -> str:
    """A tokenizer file's content, read on the driver; its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()
