"""Toxicity: a bidirectional gated recurrent network with attention, in numpy.

A text's words are its runs of letters and digits. A word's input is a learned
vector of its own, if the training texts had it often enough, beside the mean
of learned vectors of its character trigrams, so that unknown spellings have
an input too. Windows of a fixed number of words overlap by half and cover the
whole text. Two gated recurrent layers read a window from either side,
attention pools their states, and a logistic unit scores the pool. A text's
score is that of its highest window.

Training takes a bounded sample of labelled rows (``positives`` and
``negatives``, the first by a hash of the key), whose key falls in a fold that
is not held out. A label belongs to a text, not to a window: each round trains
on the window of each text that scores highest at the time. The word vectors
begin with the log odds of the word between the classes, counted over the
sample.

Scoring happens where rows are read; nothing is shuffled. Null and empty texts
are one empty window. Rows that repeat score alike; labels of a key that has
several rows count for each, and a key with contradicting labels is toxic.
Without labelled rows of both classes every score is 0. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjrank.llm.words import Block, blocks, byte_weights, mix

FOLDS, HELD_OUT = 5, 0
DRAWS = 1 << 30


@dataclass(frozen=True)
class Settings:
    """Sizes of the sample and of the network.

    positives, negatives  labelled texts to learn from, at most
    window                words of a window; the next begins half a window on
    word, char            lengths of the two input vectors
    hidden                length of a state in each direction
    trigrams              rows of the table of trigram vectors
    rare                  a word in fewer texts of the sample has no vector of its own
    passes                rounds of training over the whole sample, whatever its size
    updates, rate         steps of training at least, so that small samples get more rounds, and their size
    every, looked         all windows are scored in every so many rounds and the last two, and so many of each text between
    """

    positives: int = 600
    negatives: int = 2400
    window: int = 32
    word: int = 6
    char: int = 6
    hidden: int = 8
    trigrams: int = 4096
    rare: int = 3
    passes: int = 12
    updates: int = 320
    rate: float = 0.02
    every: int = 2
    looked: int = 6
    seed: int = 7


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[128:] = True
    for first, last in (b"09", b"AZ", b"az"):
        table[first : last + 1] = True
    return table


class Words:
    """The distinct words of a block, by hash, and where each text has which of them."""

    def __init__(self, block: Block, weights: np.ndarray, trigrams: int):
        letters = _letters()[block.data]
        starts, ends = block.runs(letters) if len(letters) else (np.empty(0, np.int64),) * 2
        self.bounds = block.bounds(starts)
        hashes = block.hashes(starts, ends, weights)
        self.hashes, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        # trigrams of the word with a mark on either side: as many as it has bytes
        sizes = ends - starts
        self.gram_ends = np.cumsum(sizes)
        at = np.arange(self.gram_ends[-1] if len(sizes) else 0) + np.repeat(starts - self.gram_ends + sizes, sizes)
        begin, last = np.repeat(starts, sizes), np.repeat(ends, sizes) - 1
        side = np.uint64(3)
        left = np.where(at > begin, weights[block.data[np.maximum(at - 1, 0)]], side)
        right = np.where(at < last, weights[block.data[np.minimum(at + 1, len(block.data) - 1)]], side) if len(at) else left
        grams = mix(mix(left + np.uint64(11)) + weights[block.data[at]] * np.uint64(5) + mix(right + np.uint64(13)))
        self.grams, self.sizes = (grams % np.uint64(trigrams)).astype(np.int64), sizes


def windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window; every text has one at least."""
    step = width // 2
    n = np.maximum(1, -(-(sizes - width) // step) + 1)
    row = np.repeat(np.arange(len(sizes)), n)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
    return row, first, np.minimum(width, sizes[row] - first)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def added(size: int, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A table with each row added at its index."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        held = index[order]
        begin = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        out[held[begin]] = np.add.reduceat(rows[order], begin, axis=0)
    return out


class Network:
    """Parameters by name; inputs are rows of the projected vectors of a block's distinct words."""

    def __init__(self, settings: Settings, vocabulary: np.ndarray, odds: np.ndarray):
        s, rng = settings, np.random.default_rng(settings.seed)
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.settings, self.vocabulary = s, vocabulary
        word = draw(len(vocabulary) + 1, s.word, scale=0.05)
        word[:-1, 0] += odds
        self.p = {"word": word, "char": draw(s.trigrams, s.char, scale=0.05)}
        for side in "fb":
            self.p |= {
                f"in_{side}": draw(s.word + s.char, 3 * s.hidden),
                f"bias_{side}": np.zeros(3 * s.hidden, np.float32),
                f"hid_{side}": draw(s.hidden, 3 * s.hidden),
            }
        self.p |= {"look": draw(2 * s.hidden), "out": draw(2 * s.hidden), "shift": np.zeros(1, np.float32)}

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row of the word table, and input vector, of each distinct word."""
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == words.hashes if len(self.vocabulary) else np.zeros(len(words.hashes), bool)
        at = np.where(known, at, len(self.vocabulary))
        chars = np.zeros((len(words.hashes), self.settings.char), np.float32)
        if len(words.hashes):
            held = self.p["char"][words.grams]
            chars = np.add.reduceat(held, words.gram_ends - words.sizes, axis=0) / words.sizes[:, None]
        return at, np.concatenate([self.p["word"][at], chars], axis=1)

    def read(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (step, window, hidden) of one direction. ``x`` has projected inputs, ``index`` the word at each step."""
        h = self.settings.hidden
        u, steps = self.p[f"hid_{side}"], range(index.shape[0])
        out = np.empty((index.shape[0], index.shape[1], h), np.float32)
        state = np.zeros((index.shape[1], h), np.float32)
        for t in steps if side == "f" else reversed(steps):
            own, before = x[index[t]], state @ u
            gates = _sigmoid(own[:, : 2 * h] + before[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(own[:, 2 * h :] + r * before[:, 2 * h :])
            step = mask[t][:, None] * (1 - z)
            if keep is not None:
                keep.append((t, state, z, r, new, before[:, 2 * h :], step))
            state = state + step * (new - state)
            out[t] = state
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """Attention weights, pooled states and logits of windows."""
        look = np.where(mask, states @ self.p["look"], -1e9)
        weight = np.exp(look - look.max(0)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return weight, pooled, pooled @ self.p["out"] + self.p["shift"]

    def logits(self, words: Words, only: tuple | None = None, most: int = 8192) -> tuple[np.ndarray, ...]:
        """Logit of every window of a block, or of those given, with its text, first word and size."""
        row, first, size = only or windows(np.diff(words.bounds), self.settings.window)
        at, x = self.inputs(words)
        projected = {side: x @ self.p[f"in_{side}"] + self.p[f"bias_{side}"] for side in "fb"}
        out = np.empty(len(row), np.float32)
        for a in range(0, len(row), most):
            part = slice(a, a + most)
            index, mask = self.steps(words, row[part], first[part], size[part])
            if not len(words.hashes):
                out[part] = self.p["shift"]
                continue
            states = np.concatenate([self.read(projected[side], index, mask, side) for side in "fb"], axis=2)
            out[part] = self.pool(states, mask)[2]
        return out, row, first, size

    def steps(self, words: Words, row, first, size) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word at each step of the windows, and whether there is one."""
        t = np.arange(self.settings.window)[:, None]
        mask = t < size
        index = np.where(mask, words.bounds[row] + first + t, 0)
        return (words.which[index] if len(words.which) else index), mask

    def scores(self, words: Words) -> np.ndarray:
        """Score of each text of a block: that of its highest window."""
        logit, row, _, _ = self.logits(words)
        best = np.full(len(words.bounds) - 1, -np.inf)
        np.maximum.at(best, row, logit)
        return _sigmoid(best)

    def gradients(self, words: Words, chosen: tuple[np.ndarray, ...], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over chosen windows."""
        h = self.settings.hidden
        at, x = self.inputs(words)
        index, mask = self.steps(words, *chosen)
        kept: dict[str, list] = {"f": [], "b": []}
        projected = {side: x @ self.p[f"in_{side}"] + self.p[f"bias_{side}"] for side in "fb"}
        states = np.concatenate([self.read(projected[side], index, mask, side, kept[side]) for side in "fb"], axis=2)
        weight, pooled, logit = self.pool(states, mask)
        g = {name: np.zeros_like(value) for name, value in self.p.items()}
        error = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        g["out"], g["shift"] = pooled.T @ error, error.sum(keepdims=True)
        d_pooled = error[:, None] * self.p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_look = weight * (d_weight - (weight * d_weight).sum(0))
        d_states = weight[:, :, None] * d_pooled + d_look[:, :, None] * self.p["look"]
        g["look"] = np.einsum("tb,tbh->h", d_look, states)
        d_x = np.zeros_like(x)
        for i, side in enumerate("fb"):
            u, d_state = self.p[f"hid_{side}"], np.zeros((index.shape[1], h), np.float32)
            each = np.empty((*index.shape, 3 * h), np.float32)
            for t, before, z, r, new, hid, step in reversed(kept[side]):
                d_state = d_state + d_states[t][:, i * h : (i + 1) * h]
                d_new = d_state * step * (1 - new * new)
                d_z = -d_state * mask[t][:, None] * (new - before) * z * (1 - z)
                d_r = d_new * hid * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_new], axis=1)
                d_hid = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"hid_{side}"] += before.T @ d_hid
                each[t] = d_in * mask[t][:, None]
                d_state = d_state * (1 - step) + d_hid @ u.T
            d_own = added(len(x), index.ravel(), each.reshape(-1, 3 * h))
            g[f"in_{side}"], g[f"bias_{side}"] = x.T @ d_own, d_own.sum(0)
            d_x += d_own @ self.p[f"in_{side}"].T
        w = self.settings.word
        g["word"] = added(len(g["word"]), at, d_x[:, :w])
        g["char"] = added(len(g["char"]), words.grams, np.repeat(d_x[:, w:] / words.sizes[:, None], words.sizes, axis=0))
        return g


def log_odds(batches: list[tuple[Words, np.ndarray]], rare: int, prior: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Words in at least ``rare`` texts, sorted, and how much likelier toxic texts have them, from -1 to 1.

    ``prior`` texts of either class are added to each word's counts, so that few occurrences say little.
    """
    found, toxic = [], []
    for words, y in batches:
        row = np.repeat(np.arange(len(y)), np.diff(words.bounds))
        pair = np.unique(row * len(words.hashes) + words.which)
        found.append(words.hashes[pair % max(len(words.hashes), 1)])
        toxic.append(y[pair // max(len(words.hashes), 1)])
    hashes, where = np.unique(np.concatenate(found), return_inverse=True)
    yes = np.bincount(where, weights=np.concatenate(toxic), minlength=len(hashes))
    no = np.bincount(where, minlength=len(hashes)) - yes
    often = yes + no >= rare
    labels = np.concatenate([y for _, y in batches])
    n = labels.sum(), len(labels) - labels.sum()
    odds = np.log((yes + prior) / (n[0] + 2 * prior)) - np.log((no + prior) / (n[1] + 2 * prior))
    return hashes[often], (np.clip(odds, -5, 5) / 5)[often]


def fit(texts: list[str], labels: np.ndarray, settings: Settings) -> Network:
    """Train on the highest window of each text, chosen anew in every round, with Adam.

    There are ``passes`` rounds, more only where a small sample needs them for
    ``updates`` steps. Every batch has an empty text that isn't toxic. Tables of
    vectors have one step size for all rows, so that rare rows move little.
    """
    weights, rng = byte_weights(True), np.random.default_rng(settings.seed)
    batches = []
    for g in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 48)):
        block = next(blocks(pa.array([*(texts[i] for i in g), ""]), 1 << 40))
        batches.append((Words(block, weights, settings.trigrams), np.append(labels[g], 0).astype(np.float32)))
    net = Network(settings, *log_odds(batches, settings.rare))
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    updates = 0
    some: dict[int, tuple] = {}  # by batch, the windows that scored highest when all were last looked at
    turns = max(settings.passes, -(-settings.updates // len(batches)))
    for turn in range(turns):
        whole = turn % settings.every == 0 or turn >= turns - 2
        for i, (words, y) in enumerate(batches):
            if not len(words.hashes):
                continue
            logit, row, first, size = net.logits(words, None if whole else some.get(i))
            order = np.lexsort((logit, row))
            last = np.append(row[order][1:] != row[order][:-1], True)
            place = np.flatnonzero(last)[np.cumsum(last) - last] - np.arange(len(order))  # 0: the text's highest
            best = order[place == 0]
            if whole:
                some[i] = tuple(x[order[place < settings.looked]] for x in (row, first, size))
            # no other window of a text that isn't toxic is, either
            clean = np.flatnonzero(y[row] == 0)
            chosen = np.concatenate([best, clean[rng.integers(0, len(clean), len(y) // 2)]])
            g = net.gradients(words, (row[chosen], first[chosen], size[chosen]), y[row[chosen]])
            updates += 1
            for name, value in net.p.items():
                second = g[name] ** 2
                if name in ("word", "char"):
                    second = second.sum(0, keepdims=True)
                mean[name] += 0.1 * (g[name] - mean[name])
                square[name] += 0.01 * (second - square[name])
                step = (mean[name] / (1 - 0.9**updates)) / (np.sqrt(square[name] / (1 - 0.99**updates)) + 1e-8)
                value -= (settings.rate * step).astype(np.float32)
    return net


def held_out(key: Column) -> Column:
    """Whether a key's fold is kept from learning; a null key's isn't."""
    return (F.crc32(key.cast("string").cast("binary")) % FOLDS).eqNullSafe(F.lit(HELD_OUT))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, settings: Settings) -> tuple[list[str], np.ndarray]:
    """The bounded sample of labelled texts to learn from."""
    marks = labels.select(F.col(key).alias("key"), F.col("toxic").alias("toxic")).where("toxic is not null")
    marks = marks.where(~held_out(F.col("key"))).groupBy("key").agg(F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64("key"), F.lit(DRAWS))
    sizes = {r["toxic"]: r["count"] for r in marks.where("toxic in (0, 1)").groupBy("toxic").count().collect()}

    def some(label: int, most: int) -> DataFrame:
        """The first rows of a class by their draw; a cut-off first, so that few are ever sorted."""
        share = min(1.0, (2 * most + 100) / max(1, sizes.get(label, 0)))
        rows = marks.where((F.col("toxic") == label) & (draw < int(share * DRAWS)))
        return rows.orderBy(draw, "key").limit(most)

    chosen = some(1, settings.positives).unionByName(some(0, settings.negatives))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "key").orderBy("key", "text").limit(2 * (settings.positives + settings.negatives)).collect()
    return [r["text"] for r in found], np.array([r["toxic"] for r in found], np.float32)


def _apply(docs: DataFrame, labelled: DataFrame, labels: DataFrame, key: str, text: str, settings: Settings):
    texts, marks = sample(labelled, labels, key, text, settings)
    net = fit(texts, marks, settings) if 0 < marks.sum() < len(marks) else None
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scores(column: pa.Array) -> np.ndarray:
        net, weights = sent.value, byte_weights(True)
        if net is None:
            return np.zeros(len(column))
        found = [net.scores(Words(b, weights, settings.trigrams)) for b in blocks(column, 1 << 20)]
        return np.concatenate([np.empty(0), *found])

    return scores


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()  # noqa: B008
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for each row."""
    scores = _apply(docs, docs, labels, key, text, settings)
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], ["key", "score"])

    schema = T.StructType([narrow.schema["key"], T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(run, schema).select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def clean(
    docs: DataFrame, labelled: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()  # noqa: B008
) -> DataFrame:
    """The documents that score below 0.5, by a model learned from ``labelled`` texts."""
    scores = _apply(docs, labelled, labels, key, text, settings)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
