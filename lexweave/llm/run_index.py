"""Run-length compressed Burrows-Wheeler index of a set of byte strings, and matches streamed from it."""

from __future__ import annotations

import numpy as np

#: Stands after every string; no UTF-8 text holds it.
END = 0xFF


def suffix_order(data: np.ndarray, left: np.ndarray, most: int, tied: bool = False) -> np.ndarray:
    """Suffix array by doubling; `left` is what remains of the own string at each place, `most` the longest.

    Equal ends of different strings follow each other in any order, with `tied` in that of the strings.
    """
    n = len(data)
    wide = np.full(n + 8, END, dtype=np.uint64)
    wide[:n] = data
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(left > i, wide[i : i + n], np.uint64(END))
    depth, places = 8, np.arange(n)
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])).astype(np.uint64) + np.uint64(1)
        if depth >= most or int(rank[order[-1]]) == n:
            return np.argsort(rank, kind="stable") if tied and int(rank[order[-1]]) < n else order
        after = np.where(left >= depth, rank[np.minimum(places + depth, n - 1)], np.uint64(0))
        key = (rank << np.uint64(32)) | after
        depth *= 2


class RunIndex:
    """Runs of the transform (head and first row of each) with the text places at both ends of every run.

    strings are kept one after another, each closed by END. heads[i] is the letter before the
    suffixes of run i; first[i] and last[i] are the places of its outermost suffixes. With `stream` other
    strings can be streamed through the transform: steps[i] is then the row to which the first row of run i steps back.
    """

    def __init__(self, strings: list[bytes], stream: bool = False):
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.data = np.frombuffer(bytes([END]).join(strings) + bytes([END]), dtype=np.uint8)
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        self.left = np.repeat(ends, lengths + 1) - np.arange(len(self.data))
        order = suffix_order(self.data, self.left, int(lengths.max(initial=0)) + 1, stream)
        letters = self.data[order - 1]  # the first place takes the END that closes the data
        # The ENDs before whole strings count as different letters: nothing goes on to their left.
        edge = np.flatnonzero((letters[1:] != letters[:-1]) | (letters[1:] == END)) + 1
        rows = np.concatenate([[0], edge])
        self.heads, self.rows = letters[rows], rows
        self.first, self.last = order[rows], order[np.concatenate([edge - 1, [len(order) - 1]])]

        if stream:
            sizes = np.diff(np.append(rows, len(order)))
            self.ends = rows + sizes - 1
            self.by_head = np.argsort(self.heads, kind="stable")
            self.head_keys = self.heads[self.by_head].astype(np.int64) * len(rows) + self.by_head
            self.steps = np.empty(len(rows), dtype=np.int64)
            self.steps[self.by_head] = np.cumsum(sizes[self.by_head]) - sizes[self.by_head]

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common start at places a and b, up to `most`."""
        out = np.zeros(len(a), dtype=np.int64)
        open_ = np.flatnonzero(most > 0)
        step = 8
        while len(open_):
            span = out[open_, None] + np.arange(step)
            i, j = (np.minimum(x[open_, None] + span, len(self.data) - 1) for x in (a, b))
            same = (self.data[i] == self.data[j]) & (span < most[open_, None])
            got = np.where(same.all(axis=1), step, same.argmin(axis=1))
            out[open_] += got
            open_, step = open_[got == step], 64
        return out

    def matching_statistics(self, patterns: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of each pattern the length of the longest match with the index that starts there, and a place of it.

        The patterns are read backwards, all at once, through the runs of the transform (Bannai, Gagie and I, 2020): while the
        letter read is the head of the run, the match grows by a step back; otherwise it goes on from the end of the
        nearest run of that letter above or below, whichever sample agrees with more of the match so far.
        """
        sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        text = np.frombuffer(b"".join(patterns), dtype=np.uint8)
        stops = np.cumsum(sizes)
        turn = np.argsort(-sizes, kind="stable")
        stop, size = stops[turn], sizes[turn]
        lengths, places = np.zeros(len(text), dtype=np.int32), np.zeros(len(text), dtype=np.int32)
        row, runs = np.zeros(len(patterns), dtype=np.int64), len(self.rows)
        place, length = np.full(len(patterns), self.first[0], dtype=np.int64), np.zeros(len(patterns), dtype=np.int64)
        for t in range(int(sizes.max(initial=0))):
            k = int(np.searchsorted(-size, -t, side="left"))  # those longer than t
            at = stop[:k] - 1 - t
            c = text[at].astype(np.int64)
            run = np.searchsorted(self.rows, row[:k], side="right") - 1
            j = np.flatnonzero(self.heads[run] != c)
            lost = j[:0]
            if len(j):
                near = np.searchsorted(self.head_keys, c[j] * runs + run[j])
                down, up = self.by_head[np.minimum(near, runs - 1)], self.by_head[np.maximum(near - 1, 0)]
                has_down, has_up = (near < runs) & (self.heads[down] == c[j]), (near > 0) & (self.heads[up] == c[j])
                below = np.where(has_down, self._agree(place[j], self.first[down], np.where(has_down, length[j], 0)), -1)
                above = np.where(has_up, self._agree(place[j], self.last[up], np.where(has_up, length[j], 0)), -1)
                higher = above >= below
                run[j] = np.where(higher, up, down)
                row[j] = np.where(higher, self.ends[up], self.rows[down])
                place[j] = np.where(higher, self.last[up], self.first[down])
                length[j] = np.maximum(above, below)
                lost = j[length[j] < 0]
            row[:k] += self.steps[run] - self.rows[run]
            place[:k] -= 1
            length[:k] += 1
            row[lost], place[lost] = 0, self.first[0]
            lengths[at], places[at] = length[:k], place[:k]
        return [(lengths[b - n : b], places[b - n : b]) for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]

    def common(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Length of the common start at places a and b within their strings, 0 if under `least`."""
        room = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), dtype=np.int64)
        open_ = np.flatnonzero(room >= least)
        # The last letter of a match of `least` drops most pairs before the rest is read.
        open_ = open_[self.data[a[open_] + least - 1] == self.data[b[open_] + least - 1]] if least else open_
        step = 32
        while len(open_):
            at = out[open_]
            span = np.arange(step)
            i = np.minimum(a[open_, None] + at[:, None] + span, len(self.data) - 1)
            j = np.minimum(b[open_, None] + at[:, None] + span, len(self.data) - 1)
            same = (self.data[i] == self.data[j]) & (at[:, None] + span < room[open_, None])
            got = np.where(same.all(axis=1), step, same.argmin(axis=1))
            out[open_] += got
            open_ = open_[got == step]
        out[out < least] = 0
        return out

    def long_matches(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) of matches of at least `least` letters that cover all repeated text.

        Only suffixes at run ends are compared with the neighbour in the next run. The longest match
        of the place before another in the same run is one letter longer than that one's, so
        the sampled ends yield every matching statistic by counting down (Karkkainen, Manzini
        and Puglisi, 2009: irreducible common prefixes); a place with a match of `least` letters lies in
        a match sampled at it or before it.
        """
        above, below = self.last[:-1], self.first[1:]
        n = self.common(above, below, least)
        long = n >= least
        return np.concatenate([above[long], below[long]]), np.concatenate([n[long], n[long]])

    def where(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """String number and offset in it of each place."""
        string = np.searchsorted(self.starts, places, side="right") - 1
        return string, places - self.starts[string]
