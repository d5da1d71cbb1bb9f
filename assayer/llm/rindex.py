"""A run-length index: run-compressed Burrows-Wheeler transform with sampled run ends, and matching statistics.

``RunLengthIndex`` keeps, of a text, only the runs of its Burrows-Wheeler transform and the suffix array's values at
their first and last rows. ``pointers`` streams patterns through it from right to left, all patterns in step: while the
pattern's byte continues the current run's, the row maps by LF; otherwise the row jumps to the end of the run before or
the start of the run after that has the byte, whichever suffix shares more with the pattern. So each place of a pattern
gets a pointer to a place of the text with its longest match (its matching statistics). Which of the two shares more is
read from the text itself, eight bytes at a time; so are the matches that are reported.
"""

from __future__ import annotations

import numpy as np

from assayer.llm.arrays import U, common_bytes, eights, same_bytes

#: A byte that UTF-8 text never has, between and after strings.
SEPARATOR = 0xFF


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each read up to its first SEPARATOR (then by place), by prefix doubling. ``data`` ends
    with a separator. The order is total, so that LF keeps the order of suffixes behind one byte."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.zeros(n, U)
    for j in range(8):
        first = (first << U(8)) | padded[j : j + n].astype(U)
    ends = np.flatnonzero(data == SEPARATOR)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # bytes before the separator
    over = left < 8
    first[over] &= ~((U(1) << (U(8) * (7 - left[over]).astype(U))) - U(1))
    order = np.argsort(first, kind="stable")
    ordered, width = first[order], 8
    while True:
        new = np.concatenate([[0], np.cumsum((ordered[1:] != ordered[:-1]) | over[order[1:]])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = (rank.astype(U) << U(32)) | after.astype(U)
        # only suffixes that still share a rank have to move
        tied = np.zeros(n, bool)
        tied[1:] = new[1:] == new[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        own = order[at]
        order[at] = own[np.argsort(key[own], kind="stable")]
        ordered = key[order]
        width *= 2
        over = left < width


class RunLengthIndex:
    def __init__(self, data: np.ndarray) -> None:
        """``data``: uint8, ends with SEPARATOR."""
        order = suffix_array(data)
        n = self.n = len(data)
        bwt = data[order - 1]
        head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.start = head  # first row of each run
        length = np.diff(np.concatenate([head, [n]]))
        self.byte = bwt[head].astype(np.int64)
        self.at_start = order[head]  # sampled run ends
        self.at_end = order[head + length - 1]
        by_byte = np.argsort(self.byte, kind="stable")
        before = np.cumsum(length[by_byte]) - length[by_byte]
        self.maps_to = np.empty(len(head), np.int64)
        self.maps_to[by_byte] = before  # LF of the run's first row: all rows of smaller bytes, and of this byte before
        self.runs_of = (self.byte[by_byte] << 32) | by_byte
        self.runs = len(head)
        self.text = eights(data)

    def shared(self, patterns: np.ndarray, at: np.ndarray, stop: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
        """Length, at most ``most``, that pattern[at:stop] and text[place:] have in common."""
        return common_bytes(patterns, at, self.text, place, np.minimum(np.minimum(stop - at, self.n - place), most))

    def pointers(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, patterns: np.ndarray, most: int) -> np.ndarray:
        """For each place of ``data`` in a pattern [start, stop): a place of the text with its longest match, -1 if none."""
        out = np.full(len(data), -1, np.int64)
        lanes = np.argsort(starts - stops, kind="stable")  # longest first, so that lanes that are over lie at the end
        size = (stops - starts)[lanes]
        row = np.full(len(lanes), self.n - 1)
        place = np.full(len(lanes), self.at_end[-1])
        end = stops[lanes]
        for step in range(1, int(size[0]) + 1 if len(size) else 1):
            k = int(np.searchsorted(-size, -step, "right"))
            at = end[:k] - step
            c = data[at].astype(np.int64)
            run = np.searchsorted(self.start, row[:k], "right") - 1
            off = np.flatnonzero(self.byte[run] != c)
            if len(off):
                key = (c[off] << 32) | run[off]
                after = np.searchsorted(self.runs_of, key)
                nxt = self.runs_of[np.minimum(after, self.runs - 1)]
                prv = self.runs_of[np.maximum(after - 1, 0)]
                has_next = (after < self.runs) & (nxt >> 32 == c[off])
                has_prev = (after > 0) & (prv >> 32 == c[off])
                nxt, prv = nxt & 0xFFFFFFFF, prv & 0xFFFFFFFF
                both = np.flatnonzero(has_next & has_prev)
                take_next = has_next.copy()
                if len(both):
                    a, z = np.tile(at[off[both]] + 1, 2), np.tile(end[off[both]], 2)
                    common = self.shared(patterns, a, z, np.concatenate([self.at_start[nxt[both]], self.at_end[prv[both]]]), most)
                    take_next[both] = common[: len(both)] > common[len(both) :]
                new_run = np.where(take_next, nxt, prv)
                none = ~(has_next | has_prev)
                new_row = np.where(take_next, self.start[new_run], np.append(self.start[1:], self.n)[new_run] - 1)
                new_place = np.where(take_next, self.at_start[new_run], self.at_end[new_run])
                row[off], place[off], run[off] = new_row, new_place, new_run
                lost = off[none]
            else:
                lost = off
            row[:k] = self.maps_to[run] + row[:k] - self.start[run]
            place[:k] -= 1
            out[at] = place[:k]
            if len(lost):  # the byte is nowhere in the text: start again with an empty match
                out[at[lost]] = -1
                row[lost], place[lost] = self.n - 1, self.at_end[-1]
        return out


def long_matches(index: RunLengthIndex, strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes are in the index's text."""
    if not strings:
        return []
    data = np.frombuffer(b"".join(strings), np.uint8)
    stops = np.cumsum([len(s) for s in strings])
    starts = stops - np.array([len(s) for s in strings])
    patterns = eights(data)
    place = index.pointers(data, starts, stops, patterns, length)
    at = np.concatenate([np.arange(a, max(a, z - length + 1)) for a, z in zip(starts, stops, strict=True)])
    p = place[at]
    able = (p >= 0) & (p + length <= index.n)
    hit = np.zeros(len(at), bool)
    hit[able] = same_bytes(patterns, at[able], index.text, p[able], np.full(int(able.sum()), length))
    return np.split(hit, np.cumsum([max(0, len(s) - length + 1) for s in strings])[:-1])
