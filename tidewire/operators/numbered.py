"""Names of one stem and a number, such as "pat lee 12345": how many of them difflib finds similar, without comparing each pair.

If the stem is their longest common block, difflib compares the numbers alone, and its ratio depends on which digits are equal.
Of all numbers of a length, those that are similar to one number are given by its form (which of its digits are equal):
places that have one of its digits, and places that have a digit foreign to it.  So they are worked out once for a form, and
for a number they are sums of counts of numbers with given digits at given places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from tidewire.operators.similarity import POPULAR, _lcs, difflib_ratios

#: Digits of a number at most; and digits that may be foreign, but for numbers of FEW digits.
MOST, FREE, FEW = 7, 3, 4
#: Pairs of names that are compared sooner than numbers are counted; those of a number of MOST digits, whose forms are many.
COMPARED, COMPARED_MOST = 1 << 22, 1 << 28
#: Numbers times forms of one step, about.
STEP = 1 << 20

class Family(NamedTuple):
    """Names of one stem: places in either list, and the digits that follow it."""

    stem: str
    a: np.ndarray
    b: np.ndarray
    a_numbers: list[str]
    b_numbers: list[str]


def needed(stem: int, m: int, n: int, threshold: float) -> int | None:
    """Digits that must match in numbers of m and n digits after a stem, if as many as there are can do."""
    return next((k for k in range(min(m, n) + 1) if 2.0 * (stem + k) / (2 * stem + m + n) >= threshold), None)


def comes_first(stem: str, most: int) -> bool:
    """Whether, in names of the stem and up to `most` letters, no common block is longer than the one that begins with both.

    Such a block would begin at other places, less than `most` letters from the start, and repeat the stem's end."""
    size = len(stem)
    return size >= most and not any(stem[i:] == stem[j : j + size - i] for i in range(1, most) for j in range(i))


def families(a: Sequence[str], b: Sequence[str], threshold: float) -> list[Family]:
    """Stems that so many names of both lists have that counting their numbers takes less than comparing them."""
    stems: list[dict[str, list[int]]] = [{}, {}]
    for names, found in zip((a, b), stems, strict=True):
        for k, name in enumerate(names):
            stem = name.rstrip("0123456789")
            if len(stem) < len(name):
                found.setdefault(stem if len(name) - len(stem) <= MOST else name[:-MOST], []).append(k)
    out = []
    for stem, mine in stems[0].items():
        theirs = stems[1].get(stem, [])
        if len(mine) * len(theirs) < COMPARED:
            continue
        numbers = [[names[k][len(stem) :] for k in places] for names, places in ((a, mine), (b, theirs))]
        lengths = [sorted({len(x) for x in some}) for some in numbers]
        most = max(lengths[0][-1], lengths[1][-1])
        if (most == MOST and len(mine) * len(theirs) < COMPARED_MOST) or len(stem) + most >= POPULAR or not comes_first(stem, most):
            continue
        free = [n - k for m in lengths[0] for n in lengths[1] if n > FEW and (k := needed(len(stem), m, n, threshold)) is not None]
        if max(free, default=0) <= FREE:
            out.append(Family(stem, np.array(mine), np.array(theirs), *numbers))
    return out


def near(family: Family, names: Sequence[str], places: np.ndarray, numbers: list[str], threshold: float) -> np.ndarray:
    """Those of the places whose names may be similar to some of the stem: they share letters with it, and any with the numbers."""
    letters, size, lengths = Counter(family.stem), len(family.stem), {len(x) for x in numbers}

    def may(name: str) -> bool:
        shared, n = sum(min(name.count(c), k) for c, k in letters.items()), len(name)
        return any(2 * min(shared + m, n) >= threshold * (size + m + n) - 1e-9 for m in lengths)

    return places[[may(names[k]) for k in places]] if len(places) else places


class Forms(NamedTuple):
    """What numbers of n digits are similar to one of a form, by columns.

    terms: for each place 0 for any digit, else which of the form's digits; factors: how often the numbers of a term count, so
    that those similar in both orders count once.  first, second: for each place 0 for a digit foreign to the form, else which
    of its digits: similar only if the number of the form comes first, or second."""

    terms: np.ndarray
    factors: np.ndarray
    first: np.ndarray
    second: np.ndarray


@lru_cache(maxsize=1 << 13)
def forms(form: tuple[int, ...], n: int, least: int) -> Forms:
    """form: its digits as numbers from 1 on, in the order in which they are met; least: digits that must match."""
    m, digits = len(form), max(form)
    every = np.indices((digits + 1,) * n, dtype=np.int8).reshape(n, -1)
    at = np.flatnonzero((every > 0).sum(axis=0) >= least)
    masks = np.zeros((1, digits + 1), dtype=np.uint64)
    for k, c in enumerate(form):
        masks[0, c] |= np.uint64(1 << k)
    at = at[_lcs(masks, np.zeros(len(at), dtype=np.int64), every[:, at], m) >= least]
    # a stem of other letters, as long as the longer number
    size = max(m, n)
    stem = np.arange(digits + 1, digits + 1 + size, dtype=np.int8)
    own = np.tile(np.concatenate([stem, np.array(form, dtype=np.int8)])[:, None], len(at))
    others = np.concatenate([np.tile(stem[:, None], len(at)), every[:, at]])
    enough = lambda x, y: np.rint(difflib_ratios(x, y) * (len(x) + len(y)) / 2) - size >= least
    one, two = enough(own, others), enough(others, own)
    both = np.zeros(every.shape[1])
    both[at[one & two]] = 1
    both = both.reshape((digits + 1,) * n)
    for k in range(n):  # a foreign digit: any digit, less those of the form
        places = np.moveaxis(both, k, 0)
        places[1:] -= places[0]
    terms = np.flatnonzero(both)
    return Forms(every[:, terms], both.ravel()[terms], every[:, at[one & ~two]], every[:, at[two & ~one]])


def _by_length(numbers: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, digits + 1 by row)."""
    lengths = np.array([len(x) for x in numbers])
    for m in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == m)
        yield m, places, np.frombuffer("".join(numbers[k] for k in places).encode(), dtype=np.uint8).reshape(-1, m).astype(np.int64) - 47


def _by_form(digits: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]:
    """(form, rows, the form's digits and the others by row) of numbers of one length."""
    m = digits.shape[1]
    first = (digits[:, :, None] == digits[:, None, :]).argmax(axis=2)
    _, one, of = np.unique(first @ (m ** np.arange(m)), return_index=True, return_inverse=True)
    order = np.argsort(of, kind="stable")
    for k, rows in enumerate(np.split(order, np.cumsum(np.bincount(of))[:-1])):
        places = np.unique(first[one[k]])
        own = digits[rows][:, places]
        has = (own[:, :, None] == np.arange(1, 11)).any(axis=1)
        others = np.argsort(has, axis=1, kind="stable")[:, : 10 - len(places)] + 1
        yield tuple((np.searchsorted(places, first[one[k]]) + 1).tolist()), rows, own, others


def _codes(own: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """For each number, by row, and term: digits + 1 at the places of its digits, else 0, as a number of base 11."""
    base = 11 ** np.arange(len(terms))[::-1]
    weights = np.stack([base @ (terms == k + 1) for k in range(own.shape[1])])
    return (own.astype(float) @ weights.astype(float)).astype(np.int64)


def _counts(codes: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """By code of base 11, how many numbers have its digits, with any digit where it has 0."""
    out = np.bincount(codes, weights=sizes, minlength=11**n).reshape((11,) * n)
    for k in range(n):
        places = np.moveaxis(out, k, 0)
        places[0] = places[1:].sum(axis=0)
    return out.ravel()


def _met(own: np.ndarray, others: np.ndarray, terms: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of known numbers of the terms, with foreign digits where these have 0."""
    rows, codes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    base = 11 ** np.arange(len(terms))[::-1]
    free = (terms == 0).sum(axis=0)
    for f in np.unique(free).tolist():
        some = terms[:, free == f]
        places = np.nonzero(some.T == 0)[1].reshape(some.shape[1], f)  # of each term
        code = _codes(own, some)
        row, term = np.nonzero(known.take(code) > 0)
        code = code[row, term]
        for k in range(f):
            code = code[:, None] + others[row] * base[places[term, k]][:, None]
            at, which = np.nonzero(known.take(code) > 0)
            row, term, code = row[at], term[at], code[at, which]
        rows.append(row)
        codes.append(code)
    return np.concatenate(rows), np.concatenate(codes)


def similar(family: Family, threshold: float, mates: Sequence[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray, turned: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(how many, a, b, whether b comes first): pairs that are similar in both orders, counted with the sizes of their names, equal
    names too; and places of pairs that are similar in one order only, with b first if these are asked for (`turned`).

    mates: which names of a (by place) are set against which ones of b; each name of a is in one of them."""
    none = np.zeros(0, dtype=np.int64)
    lists = [list(_by_length(x)) for x in (family.a_numbers, family.b_numbers)]
    for n, b_places, b_digits in lists[1]:
        b_codes, b_at = b_digits @ (11 ** np.arange(n)[::-1]), family.b[b_places]
        for a_in, b_in in mates:
            asked, mate = a_in[family.a], np.flatnonzero(b_in[b_at])
            if not len(mate) or not asked.any():
                continue
            mate = mate[np.argsort(b_codes[mate], kind="stable")]
            at = b_at[mate]
            known = _counts(b_codes[mate], n, b_sizes[at])
            codes, begin, size = np.unique(b_codes[mate], return_index=True, return_counts=True)
            place = np.zeros(11**n, dtype=np.int32)
            place[codes] = np.arange(len(codes))
            for m, a_places, a_digits in lists[0]:
                least = needed(len(family.stem), m, n, threshold)
                use = np.flatnonzero(asked[a_places])
                if least is None or not len(use):
                    continue
                for form, rows, own, others in _by_form(a_digits[use]):
                    f, a_at = forms(form, n, least), family.a[a_places[use[rows]]]
                    some = max(1, STEP // max(1, f.terms.shape[1]))
                    for k in range(0, len(rows), some):
                        part = slice(k, k + some)
                        met = known.take(_codes(own[part], f.terms)) @ f.factors
                        yield int(a_sizes[a_at[part]] @ np.rint(met).astype(np.int64)), none, none, False
                        for terms, second in ((f.first, False), (f.second, True))[: 1 + turned]:
                            row, code = _met(own[part], others[part], terms, known)
                            of = place.take(code)
                            times = size[of]
                            run = np.repeat(np.arange(len(code)), times)
                            again = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
                            yield 0, a_at[part][row[run]], at[begin[of[run]] + again], second
