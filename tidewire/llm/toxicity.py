"""Toxicity by a small bidirectional gated recurrent network, trained and run in numpy.

A word's input is a trained vector of the word plus the trained vectors of its character
n-grams.  Two GRUs read a window of words in both directions, attention pools their states,
and a logistic unit scores the window.  A text's windows of 32 words start every 16 words,
and at every word around those that come near; the text's score is its highest.  Labels are
given for texts, so training works in rounds: the windows of a toxic text that look most
toxic stand for it (at first by the label counts of words and n-grams, then by the network
itself), and clean texts give random and hardest ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import give_back, raw_texts
from tidewire.llm.decontaminate import words_of

WINDOW, STRIDE = 32, 16
#: From this chance on, every window around a window is scored too.
NEAR = 0.2
STATES, INPUTS = 8, 12
CELLS = 1 << 18
#: Lengths of n-grams anywhere in a word, and of those at its start (both with the mark of its start).
GRAMS, PREFIXES = (4, 5), (6, 7, 8, 9, 10, 11, 12)
#: Labelled texts that training reads, at most, of each label.
MAX_TOXIC, MAX_CLEAN = 900, 1800
THRESHOLD = 0.7
REMEMBERED = 60_000
#: Texts that are scored together.
ROWS = 128
#: Windows that the network runs together, and words whose n-grams are found together.
BATCH, GRAM_WORDS = 768, 16_384
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


#: Bytes of a piece of a long word, and those that neighbours share.
PIECE, SHARED = 40, 12
_MARKS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Cc", "Cf"))
_BETWEEN = re.compile(f"[{re.escape(_MARKS)}]+")


def pieces(word: bytes) -> list[bytes]:
    """A word split at marks and blanks that are not ASCII; what is still long goes as overlapping pieces."""
    text = word.decode("utf-8", "replace")
    if len(word) <= PIECE and text.isalnum():
        return [word]
    parts = [x.encode() for x in _BETWEEN.split(text) if x] or [word]
    return [x[k : k + PIECE] for x in parts for k in range(0, max(1, len(x) - SHARED), PIECE - SHARED)]


class Pieces(dict):
    """The pieces of words met; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = [word] if len(word) <= PIECE and word.isascii() else pieces(word)
        return found


def inputs_of(raw: bytes, known: Pieces) -> list[bytes]:
    """The words that the network reads; together they hold every letter of the text."""
    words = words_of(raw)
    if raw.isascii() and max(map(len, words), default=0) <= PIECE:
        return words
    return list(chain.from_iterable(map(known.__getitem__, words)))


def word_cells(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) & (CELLS - 1) for w in words), np.int64, len(words))


def gram_cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, cell) of each character n-gram (bytes) of `^word$`, anywhere and at its start, in the words' order."""
    found = [_gram_cells(words[k : k + GRAM_WORDS], k) for k in range(0, len(words), GRAM_WORDS)]
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *(x[0] for x in found)]), np.concatenate([none, *(x[1] for x in found)])


def _gram_cells(words: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
    marked = [b"\1" + w + b"\2" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    owner, raw = np.repeat(np.arange(len(marked), dtype=np.int32), size), np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    rows, cells = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    starts = np.zeros(len(raw), bool)
    starts[np.cumsum(size) - size] = True
    for n in GRAMS + PREFIXES:
        if len(raw) < n:
            continue
        inside = owner[: len(raw) - n + 1] == owner[n - 1 :]
        if n in PREFIXES:
            inside &= starts[: len(inside)]
        at = np.flatnonzero(inside)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = (code + raw[at + k]) * _C[0]
            code ^= code >> np.uint64(29)
        rows.append(owner[at])
        cells.append(((code * _C[1]) >> np.uint64(46)).astype(np.int32))
    row, cell = np.concatenate(rows), np.concatenate(cells)
    order = np.argsort(row, kind="stable")
    return row[order] + np.int32(first), cell[order]


def sum_rows(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of runs of rows by their sorted owner."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


def add_rows(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows by their place, in any order."""
    order = np.argsort(at, kind="stable")
    return sum_rows(values[order], at[order], n)


def window_starts(n: int) -> range:
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Gates are laid out z, r, n, each of the forward states and then the backward ones."""

    def __init__(self, seed: int = 5):
        g, h = np.random.default_rng(seed), 2 * STATES
        f = np.float32
        self.word = (0.05 * g.standard_normal((CELLS, INPUTS))).astype(f)
        self.gram = (0.02 * g.standard_normal((CELLS, INPUTS))).astype(f)
        self.wx = (g.standard_normal((INPUTS, 3 * h)) / np.sqrt(INPUTS)).astype(f)
        self.bias = np.zeros(3 * h, f)
        self.block = np.tile(np.kron(np.eye(2), np.ones((STATES, STATES))), (1, 3)).astype(f)
        self.u = (g.standard_normal((h, 3 * h)) / np.sqrt(STATES)).astype(f) * self.block
        self.attention = (0.5 * g.standard_normal(h)).astype(f)
        self.out = (0.5 * g.standard_normal(h)).astype(f)
        self.shift = np.full(1, -1.0, f)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        out = self.word[word_cells(words)]
        for k in range(0, len(words), GRAM_WORDS):
            owner, cell = _gram_cells(words[k : k + GRAM_WORDS], 0)
            part = out[k : k + GRAM_WORDS]
            part += sum_rows(self.gram[cell], owner, len(part))
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Inputs' part of the gates; a row of padding is added, which leaves a state as it is."""
        out = np.zeros((len(x) + 1, 6 * STATES), np.float32)
        np.matmul(x, self.wx, out=out[:-1])
        out[:-1] += self.bias
        out[-1, : 2 * STATES] = 30
        return out

    def run(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """States (time, window, 2 * STATES) of windows of ids into gates; -1 is padding."""
        t, b, h = ids.shape[1], ids.shape[0], 2 * STATES
        x = gates[ids.T].reshape(t, b, 3, 2, STATES)
        x[:, :, :, 1] = x[::-1, :, :, 1].copy()
        x = x.reshape(t, b, 3 * h)
        states, state, saved = np.empty((t, b, h), np.float32), np.zeros((b, h), np.float32), []
        for k in range(t):
            hu = state @ self.u
            zr = sigmoid(x[k, :, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = 2 * sigmoid(2 * (x[k, :, 2 * h :] + r * hu[:, 2 * h :])) - 1
            if keep:
                saved.append((state, z, r, n, hu[:, 2 * h :]))
            state = n + z * (state - n)
            states[k] = state
        states[:, :, STATES:] = states[::-1, :, STATES:].copy()
        return (states, saved) if keep else states

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(mask, states @ self.attention, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a = a * mask / np.maximum(1e-9, (a * mask).sum(axis=0))
        pooled = np.einsum("tb,tbh->bh", a, states)
        return a, pooled, pooled @ self.out + self.shift

    def columns(self, gates: np.ndarray) -> np.ndarray:
        """The gates with a column for each row, scaled so that `chances` needs exp alone."""
        return np.ascontiguousarray((gates * self._scale()).T)

    @staticmethod
    def _scale() -> np.ndarray:
        return np.repeat(np.array([-1, -1, -2], np.float32), 2 * STATES)

    def chances(self, columns: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of windows of ids into columns of gates; -1 is padding.  States are rows here, windows columns."""
        u, h, t = (self.u * self._scale()).T, 2 * STATES, ids.shape[1]
        ways = columns.reshape(3, 2, STATES, -1)
        found = [np.zeros(0, np.float32)]
        for k in range(0, len(ids), BATCH):
            rows = np.ascontiguousarray(ids[k : k + BATCH].T)
            b, mask = rows.shape[1], rows >= 0
            x = np.empty((3, 2, STATES, t, b), np.float32)
            x[:, 0], x[:, 1] = ways[:, 0][..., rows], ways[:, 1][..., rows[::-1]]
            x = x.reshape(3 * h, t, b)
            states, state = np.empty((t, h, b), np.float32), np.zeros((h, b), np.float32)
            for step in range(t):
                hu = u @ state
                zr, n = hu[: 2 * h], hu[2 * h :]
                zr += x[: 2 * h, step]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                n *= zr[h:]
                n += x[2 * h :, step]
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                new = np.subtract(state, n, out=states[step])
                new *= zr[:h]
                new += n
                state = new
            states[:, STATES:] = states[::-1, STATES:].copy()
            e = np.where(mask, np.einsum("h,thb->tb", self.attention, states), np.float32(-1e9))
            a = np.exp(e - e.max(axis=0)) * mask
            logit = (a * np.einsum("h,thb->tb", self.out, states)).sum(axis=0) / np.maximum(1e-9, a.sum(axis=0)) + self.shift
            found.append(sigmoid(logit))
        return np.concatenate(found)

    def gradients(self, gates: np.ndarray, ids: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Of the weighted log loss: by gate row, and of u, attention, out, shift."""
        t, b, h = ids.shape[1], ids.shape[0], 2 * STATES
        states, saved = self.run(gates, ids, keep=True)
        mask = ids.T >= 0
        a, pooled, logit = self.pool(states, mask)
        d = ((sigmoid(logit) - label) * weight / b).astype(np.float32)
        d_pool = d[:, None] * self.out
        d_a = states @ np.zeros(h, np.float32) if b == 0 else np.einsum("tbh,bh->tb", states, d_pool)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * self.attention
        d_attention, d_out = np.einsum("tb,tbh->h", d_e, states), pooled.T @ d
        d_states[:, :, STATES:] = d_states[::-1, :, STATES:].copy()
        d_x, d_u, d_h = np.empty((t, b, 3 * h), np.float32), np.zeros_like(self.u), np.zeros((b, h), np.float32)
        for k in reversed(range(t)):
            before, z, r, n, hun = saved[k]
            d_h = d_h + d_states[k]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (before - n) * z * (1 - z)
            d_r = d_n * hun * r * (1 - r)
            d_x[k] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_u += before.T @ d_hu
            d_h = d_h * z + d_hu @ self.u.T
        d_x = d_x.reshape(t, b, 3, 2, STATES)
        d_x[:, :, :, 1] = d_x[::-1, :, :, 1].copy()
        d_gates = add_rows(len(gates), ids.T.ravel() % len(gates), d_x.reshape(t * b, 3 * h))
        return d_gates[:-1], d_u * self.block, d_attention, d_out, np.array([d.sum()], np.float32)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.moments, self.step = rate, {}, 0

    def apply(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        t = self.step
        value -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


class Vocabulary:
    """The words of some texts: their cells and their n-grams' cells; `ids` are the texts as numbers of words."""

    def __init__(self, texts: list[bytes]):
        number, known = {}, Pieces()
        self.ids = [np.array([number.setdefault(w, len(number)) for w in inputs_of(x, known)], np.int32) for x in texts]
        self.words = list(number)
        self.cell = word_cells(self.words)
        owner, self.gram = gram_cells(self.words)
        self.gram_from = np.searchsorted(owner, np.arange(len(self.words) + 1))

    def grams(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `used`, cell) of each n-gram of some words."""
        n = self.gram_from[used + 1] - self.gram_from[used]
        mine = np.repeat(np.arange(len(used)), n)
        return mine, self.gram[np.arange(len(mine)) - np.repeat(np.cumsum(n) - n - self.gram_from[used], n)]


def label_counts(texts: Vocabulary, toxic: np.ndarray, net: Network) -> None:
    """Starts the first input of words and n-grams from their log odds, where enough toxic texts have them."""
    counts = np.zeros((2, 2, CELLS))
    for ids, y in zip(texts.ids, toxic.tolist(), strict=True):
        used = np.unique(ids)
        counts[0, y, np.unique(texts.cell[used])] += 1
        counts[1, y, np.unique(texts.grams(used)[1])] += 1
    for table, (clean, bad) in zip((net.word, net.gram), counts, strict=True):
        odds = np.log((bad + 0.5) / (clean + 0.5) * ((toxic == 0).sum() + 1) / ((toxic == 1).sum() + 1))
        table[:, 0] = np.where(bad >= 3, np.clip(odds, -1, 4), 0) / 2


def fit(texts: list[bytes], toxic: list[int], rounds: int = 3, epochs: int = 3, batch: int = 96, seed: int = 3) -> Network:
    """A network from texts with labels; without both labels it stays near the share of the label it knows."""
    net, g = Network(), np.random.default_rng(seed)
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.shift[:] = 3 if len(y) and y.min() == 1 else -3
        return net
    known = Vocabulary(texts)
    ids, words = known.ids, known.words
    label_counts(known, y, net)
    made = [(d, s) for d, x in enumerate(ids) for s in window_starts(len(x))]
    windows = np.full((len(made), WINDOW), -1, np.int32)
    for k, (d, s) in enumerate(made):
        part = ids[d][s : s + WINDOW]
        windows[k, : len(part)] = part
    of = np.array([d for d, _ in made])
    toxicity = net.inputs(words)[:, 0]
    guess = np.full(len(made), -9, np.float32)
    for k in range(WINDOW):
        guess = np.where(windows[:, k] >= 0, np.maximum(guess, toxicity[windows[:, k]]), guess)
    adam = Adam(0.01)
    for turn in range(rounds):
        if turn:
            guess = net.chances(net.columns(net.gates(net.inputs(words))), windows)
        best = np.zeros(len(ids))
        np.maximum.at(best, of, guess)
        jitter = g.random(len(made))
        rank = np.lexsort((-jitter if turn == 0 else -guess, of))
        place = np.arange(len(made)) - np.searchsorted(of[rank], of[rank])
        taken = np.zeros(len(made), bool)
        taken[rank[place < 2]] = True  # of clean texts: two at random, later the two hardest
        lot = np.lexsort((jitter, of))
        taken[lot[np.arange(len(made)) - np.searchsorted(of[lot], of[lot]) < 2]] = True
        pos = np.flatnonzero((y[of] == 1) & (guess >= best[of] - 1e-6))
        neg = np.flatnonzero((y[of] == 0) & taken)
        chosen = np.concatenate([pos, neg])
        weight = np.where(y[of[chosen]] == 1, len(chosen) / (2 * len(pos)), len(chosen) / (2 * len(neg)))
        for _ in range(epochs if len(chosen) > 1500 else epochs * 4):
            order = g.permutation(len(chosen))
            for k in range(0, len(order), batch):
                own = chosen[order[k : k + batch]]
                used, place_in = np.unique(windows[own], return_inverse=True)
                place_in = place_in.reshape(len(own), WINDOW)
                if used[0] < 0:
                    used, place_in = used[1:], place_in - 1
                mine, cell = known.grams(used)
                x = net.word[known.cell[used]] + sum_rows(net.gram[cell], mine, len(used))
                d_gates, d_u, d_attention, d_out, d_shift = net.gradients(net.gates(x), place_in, (y[of[own]]).astype(np.float32), weight[order[k : k + batch]])
                adam.step += 1
                d_x = d_gates @ net.wx.T
                for name, grad in (("wx", x.T @ d_gates), ("bias", d_gates.sum(axis=0)), ("u", d_u), ("attention", d_attention), ("out", d_out), ("shift", d_shift)):
                    adam.apply(name, getattr(net, name), grad.astype(np.float32) + (1e-4 * getattr(net, name) if name == "wx" else 0))
                scale = 0.3 / max(1.0, float(np.abs(d_x).max()) * 50)
                np.add.at(net.word, known.cell[used], -scale * d_x)
                order_ = np.argsort(cell, kind="stable")
                met, first = np.unique(cell[order_], return_index=True)
                if len(met):
                    net.gram[met] -= 0.3 * scale * np.add.reduceat(d_x[mine[order_]], first, axis=0)
    return net


class Scorer:
    """Scores texts with a network; remembers the gates of words it has met."""

    def __init__(self, net: Network):
        self.net, self.pieces = net, Pieces()
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        #: The gates of the words so far, and room for more of them.
        self.gates = self.room = self.net.columns(self.net.gates(np.zeros((0, INPUTS), np.float32)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        split = [inputs_of(x, self.pieces) for x in texts]
        if len(self.rows) > REMEMBERED:
            self.forget()
        rows = self.rows
        new = list(set(chain.from_iterable(split)).difference(rows))
        if new:
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            if len(rows) >= self.room.shape[1]:
                self.room = np.concatenate([self.gates, np.empty((6 * STATES, len(rows) + len(new)), np.float32)], axis=1)
            self.room[:, len(rows) - len(new) : len(rows) + 1] = self.net.columns(self.net.gates(self.net.inputs(new)))
            self.gates = self.room[:, : len(rows) + 1]
        size = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.full(int(size.sum()) + WINDOW, -1, np.int32)
        flat[: len(flat) - WINDOW] = np.fromiter(map(rows.__getitem__, chain.from_iterable(split)), np.int32, len(flat) - WINDOW)
        first = np.cumsum(size) - size
        starts = [window_starts(n) for n in size.tolist()]
        of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        begin = np.concatenate([first[d] + np.array(s) for d, s in enumerate(starts)])
        ids = flat[begin[:, None] + np.arange(WINDOW)]
        ids[begin[:, None] + np.arange(WINDOW) >= (first + size)[of][:, None]] = -1
        best, chance = np.zeros(len(texts)), self.net.chances(self.gates, ids).astype(float)
        np.maximum.at(best, of, chance)
        near = np.flatnonzero(chance >= NEAR)
        if len(near):
            around = np.arange(1 - STRIDE, STRIDE)
            at, of = (begin[near][:, None] + around).ravel(), np.repeat(of[near], len(around))
            inside = (at >= first[of]) & (at + WINDOW <= (first + size)[of])
            at, back = np.unique(at[inside], return_index=True)
            if len(at):
                np.maximum.at(best, of[inside][back], self.net.chances(self.gates, flat[at[:, None] + np.arange(WINDOW)]).astype(float))
        return best


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Network:
    """Fits on labelled texts where `learn` (a column over the id) is true: at most max_toxic and
    max_clean of them by a hash of the id, whole texts.  Null labels and texts teach nothing."""
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1)).filter(learn)
    given = given.groupBy("id").agg(F.max("y").alias("y"))
    few = [given.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, max_toxic), (0, max_clean))]
    picked = [tuple(r) for part in few for r in part.collect()]
    spark = docs.sparkSession
    if not picked:
        return fit([], [])
    chosen = spark.createDataFrame(picked, given.schema)  # a bounded sample
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").filter("text is not null").collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return fit([r.text.encode() for r in rows], [r.y for r in rows])


def score_toxicity(docs: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each input row: the kept columns and `score`, from the whole text.

    Null and empty texts score as a window without words.  Repeated rows are scored one by one; an
    empty table gives no rows.  Columns that are not kept are not read; a kept one may be named
    `score`, which then comes first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # CELLS vectors
    fields = [f"out_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)]
    names = [*(f"out_{k}" for k in range(len(keep))), "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scorer.score(raw_texts(batch.column(len(keep)))), pa.float64())], names=names)
        del scorer
        give_back()

    return docs.select(*keep, F.col(text_col).cast("string").alias("text_")).mapInArrow(run, ", ".join([*fields, "score double"])).toDF(*keep, "score")
