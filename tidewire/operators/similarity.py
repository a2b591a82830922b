"""Names of one task compared in bulk: which of them reach an Indel ratio, and difflib's ratio of pairs, by numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from math import ceil
from typing import NamedTuple

import numpy as np

#: Names of either side that are compared all with all at once; 64-bit words for pairs of letters.
ROWS, COLUMNS, WORDS = 512, 8192, 4
#: Pairs of names of one call to find their blocks.
SOME = 20000
#: Places of letters of one step, and patterns of pairs that are remembered, about.
PLACES, PATTERNS = 1 << 22, 1 << 18
#: From here on SequenceMatcher leaves out what is frequent.
POPULAR = 200


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a (Hyyrö 2004)."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def shared_pairs(m: int, n: int, threshold: float) -> int:
    """How many pairs of letters two names of m and n letters share at least if their ratio reaches the threshold.

    They have L = ceil(t * (m + n) / 2) letters in common at least.  Each of the m - L others breaks two of the m - 1
    pairs of its own name, and each of the n - L put in between breaks one: 3 * L - m - n - 1 are left."""
    return 3 * ceil((m + n) * (threshold / 2) - 1e-9) - m - n - 1


class Alike(NamedTuple):
    """Pairs of names of two lengths: places in either list, Indel ratio, and the letters as numbers, a column for each pair."""

    a: np.ndarray
    b: np.ndarray
    ratio: np.ndarray
    a_letters: np.ndarray
    b_letters: np.ndarray


def _by_length(names: Sequence[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: (places in the list, code points by row)."""
    lengths = np.array([len(x) for x in names], dtype=np.int64)
    out = {}
    for m in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == m)
        raw = "".join(names[k] for k in places).encode("utf-32-le", "surrogatepass")
        out[m] = places, np.frombuffer(raw, dtype="<u4").astype(np.int64).reshape(len(places), m)
    return out


def _numbered(items: np.ndarray) -> np.ndarray:
    """Letters, or pairs of them, by row; a repeated one has its number with it."""
    again = np.zeros_like(items)
    for k in range(1, items.shape[1]):
        again[:, k] = (items[:, :k] == items[:, k : k + 1]).sum(axis=1)
    return items * 64 + np.minimum(again, 63)


def _bits(items: np.ndarray, known: np.ndarray, words: int) -> np.ndarray:
    """By row, which of the known items a name has; items may share a bit, so of those that another name lacks
    no more are counted than it lacks."""
    out = np.zeros((words, len(items)), dtype=np.uint64)
    at = np.searchsorted(known, items) % (64 * words)
    for k in range(items.shape[1]):
        out[at[:, k] >> 6, np.arange(len(items))] |= np.uint64(1) << (at[:, k] & 63).astype(np.uint64)
    return out


class _Side:
    """Names of one length: places in the list, letters (a column for each name), bits of letters and of pairs of them."""

    def __init__(self, places: np.ndarray, letters: np.ndarray, known: tuple[np.ndarray, np.ndarray], kind: type):
        self.places, self.m = places, letters.shape[1]
        self.letters = np.ascontiguousarray(letters.T.astype(kind))
        self.singles = _bits(_numbered(letters), known[0], 1)[0]
        self.pairs = _bits(_numbered(_pairs(letters)), known[1], WORDS)


def _pairs(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1] << 21 | letters[:, 1:]


def _lcs(masks: np.ndarray, a: np.ndarray, b_letters: np.ndarray, m: int) -> np.ndarray:
    """As `lcs` for many pairs of names, the first ones of m letters, at most 63; masks: by name and letter its places."""
    first, masks = a * masks.shape[1], masks.ravel()
    row = np.full(len(a), (1 << m) - 1, dtype=np.uint64)
    for letters in b_letters:
        met = row & masks.take(first + letters)
        row = (row + met) | (row - met)  # what is carried beyond m letters does not come back
    return m - np.bitwise_count(row & np.uint64((1 << m) - 1)).astype(np.int64)


def alike(a: Sequence[str], b: Sequence[str], threshold: float) -> Iterator[Alike]:
    """All pairs of names whose Indel ratio, 2 * LCS / (m + n), reaches the threshold; equal names too, empty ones never.

    From the lengths follows how many letters and pairs of letters a name may have that the other one lacks; these
    are counted on bits, first for all with all, and what is left is compared."""
    raw = [_by_length(x) for x in (a, b)]
    if not raw[0] or not raw[1]:
        return
    symbols = np.unique(np.concatenate([x.ravel() for side in raw for _, x in side.values()]))
    kind = np.int8 if len(symbols) < 120 else np.int32
    raw = [{m: (places, np.searchsorted(symbols, x)) for m, (places, x) in side.items()} for side in raw]
    every = lambda make: np.unique(np.concatenate([_numbered(make(x)).ravel() for side in raw for _, x in side.values()]))
    known = every(lambda x: x), every(_pairs)
    first, second = ([_Side(places, x, known, kind) for places, x in side.values()] for side in raw)
    without = [(~y.singles, ~y.pairs) for y in second]
    most = min(ROWS, max(len(x.places) for x in first)), min(COLUMNS, max(len(y.places) for y in second))
    met, lacking = np.empty(most, dtype=np.uint64), np.empty(most, dtype=np.uint8)
    for x in first:
        m = x.m
        for start in range(0, len(x.places), ROWS):
            rows = slice(start, start + ROWS)
            own, singles, pairs = x.letters[:, rows], x.singles[rows], x.pairs[:, rows]
            if m < 64:
                masks = np.zeros((own.shape[1], len(symbols)), dtype=np.uint64)
                for k in range(m):
                    masks[np.arange(own.shape[1]), own[k]] |= np.uint64(1 << k)
            for y, (no_singles, no_pairs) in zip(second, without, strict=True):
                n = y.m
                if min(m, n) < max(m, n) * (threshold / (2 - threshold)) - 1e-9:
                    continue
                least = ceil((m + n) * (threshold / 2) - 1e-9)
                for column in range(0, len(y.places), COLUMNS):
                    others = no_singles[None, column : column + COLUMNS]
                    own_met, own_lacking = (z[: len(singles), : others.shape[1]] for z in (met, lacking))
                    np.bitwise_count(np.bitwise_and(singles[:, None], others, out=own_met), out=own_lacking)
                    i, j = np.divmod(np.flatnonzero(own_lacking <= m - least), others.shape[1])
                    j += column
                    lost = np.zeros(len(i), dtype=np.uint16)
                    for w in range(WORDS):
                        lost += np.bitwise_count(pairs[w].take(i) & no_pairs[w].take(j))
                        if w % 2:
                            left = np.flatnonzero(lost <= m - 1 - shared_pairs(m, n, threshold))
                            i, j, lost = i.take(left), j.take(left), lost.take(left)
                    others = y.letters.take(j, axis=1)
                    if m < 64:
                        common = _lcs(masks, i, others, m)
                    else:
                        common = np.array([lcs(a[x.places[start + p]], b[y.places[q]]) for p, q in zip(i, j, strict=True)], dtype=np.int64)
                    ratio = 2 * common / (m + n)
                    found = ratio >= threshold
                    if found.any():
                        i, j = i[found], j[found]
                        yield Alike(x.places[start + i], y.places[j], ratio[found], own.take(i, axis=1), others[:, found])


def difflib_ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SequenceMatcher(None, a, b).ratio() of each pair of columns of letters: the longest common block, the first one in
    a and then in b, and the same again on both sides of it."""
    if len(b) >= POPULAR:
        return np.array([SequenceMatcher(None, x.tolist(), y.tolist()).ratio() for x, y in zip(a.T, b.T, strict=True)])
    done = [_matching(a[:, k : k + SOME], b[:, k : k + SOME]) for k in range(0, a.shape[1], SOME)]
    return 2.0 * np.concatenate([np.zeros(0), *done]) / (len(a) + len(b))


def _patterns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns of letters, b below a, each letter by the first place that has it."""
    both = np.concatenate([a, b]).astype(np.int64)
    symbols = int(both.max(initial=0)) + 1
    out = np.empty(both.shape, dtype=np.int16)
    some = max(1, PLACES // symbols)
    for start in range(0, both.shape[1], some):
        part = both[:, start : start + some]
        first, at = np.empty(part.shape[1] * symbols, dtype=np.int16), part + np.arange(part.shape[1]) * symbols
        for k in range(len(both) - 1, -1, -1):
            first[at[k]] = k
        out[:, start : start + some] = first[at]
    return out


class Ratios:
    """difflib's ratios of pairs of names, a to b and b to a.  They depend on which letters are equal and on no more, so each
    such pattern of a pair is compared once: names of one form with other numbers have few."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if max(len(a), len(b)) >= POPULAR:
            return difflib_ratios(a, b), difflib_ratios(b, a)
        done = [self._some(a[:, k : k + SOME], b[:, k : k + SOME]) for k in range(0, a.shape[1], SOME)]
        both = np.concatenate([np.zeros((0, 2)), *done])
        return both[:, 0], both[:, 1]

    def _some(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size, patterns = (len(a), len(b)), _patterns(a, b)
        weights = np.random.default_rng(len(patterns)).integers(0, 1 << 63, len(patterns)).astype(np.uint64)
        hashes, out = weights @ patterns.astype(np.uint64), np.empty((patterns.shape[1], 2))
        ratios = lambda k: np.stack([difflib_ratios(patterns[: len(a), k], patterns[len(a) :, k]), difflib_ratios(patterns[len(a) :, k], patterns[: len(a), k])], axis=1)
        left = self._look(size, hashes, patterns, np.arange(len(out)), out)
        if len(left):
            new = left[np.unique(hashes[left], return_index=True)[1]]
            mine = hashes[new], np.ascontiguousarray(patterns[:, new].T), ratios(new)
            old = self.known.get(size)
            if old is not None and len(old[0]) < PATTERNS:
                mine = [np.concatenate(x) for x in zip(old, mine, strict=True)]
            order = np.argsort(mine[0], kind="stable")
            self.known[size] = tuple(x[order] for x in mine)
            left = self._look(size, hashes, patterns, left, out)
            if len(left):  # patterns of one hash
                out[left] = ratios(left)
        return out

    def _look(self, size: tuple[int, int], hashes: np.ndarray, patterns: np.ndarray, asked: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Writes what is known of the columns asked for, and returns the others."""
        if size not in self.known:
            return asked
        known, rows, ratios = self.known[size]
        at = np.minimum(np.searchsorted(known, hashes[asked]), len(known) - 1)
        same = (rows[at] == patterns[:, asked].T).all(axis=1)
        out[asked[same]] = ratios[at[same]]
        return asked[~same]


def _matching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in the blocks, of each pair."""
    total = np.zeros(a.shape[1])
    kind = np.int8 if max(len(a), len(b)) < 120 else np.int16
    parts = [(np.arange(a.shape[1]), a, b)]  # letters outside a part are -1 in a, -2 in b
    while parts:
        pair, x, y = parts.pop()
        best, a_end, b_end = (np.zeros(len(pair), dtype=kind) for _ in range(3))
        run = np.zeros((len(y) + 1, len(pair)), dtype=kind)
        for i in range(len(x)):
            run[1:] = (run[:-1] + kind(1)) * (y == x[i])
            size = run.max(axis=0)
            more = np.flatnonzero(size > best)
            best[more], a_end[more], b_end[more] = size[more], i + 1, run.take(more, axis=1).argmax(axis=0)
        np.add.at(total, pair, best)
        i, j = np.arange(len(x), dtype=kind)[:, None], np.arange(len(y), dtype=kind)[:, None]
        for left in (True, False):
            a_in, b_in = (i < a_end - best, j < b_end - best) if left else (i >= a_end, j >= b_end)
            a_in, b_in = a_in & (x >= 0), b_in & (y >= 0)
            go = np.flatnonzero((best > 0) & a_in.any(axis=0) & b_in.any(axis=0))
            if len(go):
                a_in, b_in = a_in.take(go, axis=1), b_in.take(go, axis=1)
                xs, ys = np.where(a_in, x.take(go, axis=1), x.dtype.type(-1)), np.where(b_in, y.take(go, axis=1), y.dtype.type(-2))
                parts.append((pair[go], xs[a_in.any(axis=1)], ys[b_in.any(axis=1)]))
    return total
