"""Overlap and walks of token lists, for all lists of a batch at once.

Tokens become integer codes. Where a source has each of its tokens is one sorted array of (source, token, place); all lists
that belong to a source share it, and a step of every walk is one binary search over it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Lists:
    """Token lists as codes, one after another."""

    codes: np.ndarray
    lengths: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list array and the lists' lengths; null lists are empty."""
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return lists.flatten(), lengths


def coded(*columns: pa.Array) -> list[Lists]:
    """Lists of strings with the same code for the same token in all columns; null is a token of its own."""
    flats = [_flat(c) for c in columns]
    values = pa.concat_arrays([v.cast(pa.large_string()) for v, _ in flats]).dictionary_encode()
    codes = np.asarray(values.indices.fill_null(len(values.dictionary))).astype(np.int64)
    cuts = np.cumsum([len(v) for v, _ in flats])[:-1]
    return [Lists(c, n) for c, (_, n) in zip(np.split(codes, cuts), flats, strict=True)]


class Places:
    """Where each list of `through` has each of its tokens."""

    def __init__(self, through: Lists, codes: int):
        self.codes = codes
        owner = through.owners()
        keys = owner * codes + through.codes
        order = np.argsort(keys, kind="stable")
        self.tokens, first, self.counts = np.unique(keys[order], return_index=True, return_counts=True)
        starts = np.r_[0, np.cumsum(through.lengths)[:-1]] if len(through.lengths) else np.zeros(0, np.int64)
        place = order - starts[owner[order]]
        self.width = int(through.lengths.max(initial=0)) + 1
        self.sorted = np.repeat(np.arange(len(first)), self.counts) * self.width + place

    def find(self, lists: Lists, sources: np.ndarray) -> np.ndarray:
        """Number of each token within its source, -1 where the source lacks it; `sources` has each list's source."""
        keys = np.repeat(sources, lists.lengths) * self.codes + lists.codes
        if not len(self.tokens):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.tokens, keys), len(self.tokens) - 1)
        return np.where(self.tokens[at] == keys, at, -1)


def overlap(places: Places, lists: Lists, found: np.ndarray) -> np.ndarray:
    """Of each list the tokens that its source has too, as often as both have them."""
    owner, there = lists.owners(), found >= 0
    pairs, counts = np.unique(owner[there] * len(places.tokens) + found[there], return_counts=True)
    shared = np.minimum(counts, places.counts[pairs % len(places.tokens)]) if len(pairs) else counts
    return np.bincount(pairs // max(len(places.tokens), 1), shared, len(lists.lengths)).astype(np.int64)


def hits(places: Places, lists: Lists, found: np.ndarray, strict: bool = False) -> np.ndarray:
    """Whether each token is found in its list's source after the one found before.

    A token that isn't found costs nothing, or with `strict` uses up all that is left. All lists take a step together;
    tokens that the source lacks altogether are never a step.
    """
    owner = lists.owners()
    there = found >= 0
    if strict:  # nothing counts from the first missing token on
        gone = np.zeros(len(found), np.int64)
        gone[~there] = 1
        gone = np.cumsum(gone)
        there &= gone - _before(gone, lists.lengths)[owner] == 0
    steps = found[there]
    lengths = np.bincount(owner[there], minlength=len(lists.lengths))
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, np.int64)
    taken, at = np.zeros(len(steps), bool), np.zeros(len(lengths), np.int64)
    active = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[active]
    for i in range(int(lengths.max(initial=0))):
        live = active[: np.searchsorted(-sorted_lengths, -i)]  # lists longer than i
        token = steps[starts[live] + i]
        spot = np.searchsorted(places.sorted, token * places.width + at[live])
        inside = spot < len(places.sorted)
        place = places.sorted[np.minimum(spot, len(places.sorted) - 1)] - token * places.width
        hit = inside & (place < places.width)
        at[live[hit]] = place[hit] + 1
        taken[starts[live[hit]] + i] = True
        if strict and not hit.all():
            stay = np.ones(len(active), bool)
            stay[: len(live)] = hit
            active, sorted_lengths = active[stay], sorted_lengths[stay]
    out = np.zeros(len(found), bool)
    out[np.flatnonzero(there)[taken]] = True
    return out


def _before(running: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of running sums over all lists the sum before each list."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, np.int64)
    return np.where(starts > 0, running[np.maximum(starts, 1) - 1], 0) if len(running) else np.zeros(len(starts), np.int64)


def walked(lists: Lists, hit: np.ndarray) -> np.ndarray:
    """Of each list the number of its hits."""
    return np.bincount(lists.owners(), hit, len(lists.lengths)).astype(np.int64)


def match_lists(through: pa.Array, lists: pa.Array, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Overlap and walk of each list against the list of the same row."""
    source, out = coded(through, lists)
    places = Places(source, int(max(source.codes.max(initial=0), out.codes.max(initial=0))) + 1)
    found = places.find(out, np.arange(len(out.lengths)))
    return overlap(places, out, found), walked(out, hits(places, out, found, strict))


def match_many(through: pa.Array, lists: pa.Array, steps: bool = False) -> pa.Array:
    """For rows of one source and several lists: an array of structs (overlap, walk), one a list.

    With `steps` a struct also has how far the walk has come after each of the list's tokens.
    """
    inner, per_row = _flat(lists)
    source, out = coded(through, inner)
    places = Places(source, int(max(source.codes.max(initial=0), out.codes.max(initial=0))) + 1)
    found = places.find(out, np.repeat(np.arange(len(per_row)), per_row))
    hit = hits(places, out, found)
    columns = {"unordered": pa.array(overlap(places, out, found), pa.int64()), "ordered": pa.array(walked(out, hit), pa.int64())}
    if steps:
        running = np.cumsum(hit)
        so_far = running - np.repeat(_before(running, out.lengths), out.lengths)
        columns["steps"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(out.lengths)], pa.int32()), pa.array(so_far, pa.int32()))
    each = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)], pa.int32()), each)
