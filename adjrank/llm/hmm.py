"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

States emit symbols: each of the most frequent words is one, every other word
belongs to one of a fixed number of classes by its ending, and the text's end
is one. A word of a class has its own share of the class, smoothed like the
base model, so that known and unknown words together get exactly the class's
probability:

    P(word | state) = P(class | state) * (c + 0.5) / (N_class + 0.5 * (V_class + 1))

The second factor doesn't depend on the state. So the forward recursion over
symbols, times these shares, is the exact likelihood of the text.

Word counts are summed by Spark over all training texts; the table of all
words stays distributed, only its most frequent ones, a fixed number, are sent
to the tasks. Words beyond these meet their counts in a join. Since they are
none of the most frequent, no such key is hot. Emissions begin from the exact
counts of all symbols over all training texts, and every iteration adds up
expected counts over all training texts in all partitions; no step works on a
sample. Iterations end when the likelihood settles, or at a most.

Null and empty texts have the end token only. A row with a null key is a
training text. Rows that repeat are texts of their own. Without any training
text all counts are 0 and the states emit uniformly; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjrank.llm.sums import SCHEMA, slices, summed
from adjrank.llm.words import Block, blocks, byte_weights, mix
from adjrank.session import scratch_path

FOLDS, HELD_OUT = 5, 1
#: The hash of the end token, which no word has but by chance.
END = 0x5EED


@dataclass(frozen=True)
class Settings:
    """Sizes of the model.

    states      hidden states
    symbols     most frequent words that are symbols of their own
    known       most frequent words whose counts every task holds
    classes     classes of the other words
    iterations  Baum-Welch iterations over all training texts, at most
    settled     gain of the mean log likelihood of a token, in nats, below which there is no further iteration
    """

    states: int = 6
    symbols: int = 8192
    known: int = 65536
    classes: int = 1024
    iterations: int = 8
    settled: float = 0.002

    def __post_init__(self):
        if self.symbols + self.classes + 1 > 1 << 16:
            raise ValueError("symbols, classes and the end have to fit 16 bits")


def word_classes(block: Block, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word by its last three bytes."""
    out = np.zeros(len(starts), np.uint64)
    for j in (1, 2, 3):
        at = ends - j
        out = mix(out + np.where(at >= starts, weights[block.data[np.maximum(at, 0)]], np.uint64(7)))
    return (out % np.uint64(classes)).astype(np.int64)


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """``word`` (hash), ``class`` and ``n`` of all words in training texts (``text``, ``held_out``), and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = byte_weights(True)
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(1)))
            found, kinds = [], []
            for block in blocks(batch.column(0)):
                starts, ends = block.words()
                found.append(block.hashes(starts, ends, weights))
                kinds.append(word_classes(block, starts, ends, weights, classes))
            if not found:
                continue
            words, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            kinds = np.concatenate(kinds)[first]
            words, kinds, n = (np.append(x, y) for x, y in zip((words, kinds, n), (np.uint64(END), -1, batch.num_rows), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(kinds), pa.array(n)], ["word", "class", "n"])

    each = docs.select("text", "held_out").mapInArrow(run, "word bigint, class bigint, n bigint")
    return each.groupBy("word", "class").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words, totals of all, and totals of the classes without the words that are symbols."""

    def __init__(self, top: list, tokens: int, words: int, class_rows: list, settings: Settings):
        self.tokens, self.words, self.settings = tokens, words, settings
        hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], np.array([r["n"] for r in top], np.int64)[order]
        rank = np.arange(len(top))[order]
        self.symbol = np.where(rank < settings.symbols, rank, -1)
        self.class_tokens, self.class_words = np.zeros(settings.classes), np.zeros(settings.classes)
        for r in class_rows:
            self.class_tokens[r["class"]], self.class_words[r["class"]] = r["tokens"], r["words"]
        for r in top[: settings.symbols]:
            self.class_tokens[r["class"]] -= r["n"]
            self.class_words[r["class"]] -= 1

    @property
    def size(self) -> int:
        return self.settings.symbols + self.settings.classes + 1

    def seen(self, end_count: int) -> np.ndarray:
        """How often each symbol is in the training texts."""
        out = np.zeros(self.size)
        own = self.symbol >= 0
        out[self.symbol[own]] = self.counts[own]
        out[self.settings.symbols : -1], out[-1] = self.class_tokens, end_count
        return out

    def share_divisors(self) -> np.ndarray:
        """log10 of what a class's shares are divided by."""
        return np.log10(self.class_tokens + 0.5 * (self.class_words + 1))

    def base_divisor(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.words + 1))


def most_frequent(words: DataFrame, most: int) -> list:
    """The rows of the most frequent words, the first most so: as many whole levels of frequency as have ``most`` words at most.

    A level is a count up to 4095 and a range of counts beyond, so there are some ten thousand.
    """
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log(F.col("n") / 4096) * 200)).cast("long")
    levels = words.groupBy(level.alias("level")).count().collect()
    held, least = 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    rows = words.where(level >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r["n"], r["word"]))


def vocabulary(counts: DataFrame, settings: Settings) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count of the end token."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("class") < 0, F.col("n"))).alias("end")).first()
    words = counts.where("class >= 0")
    top = most_frequent(words, settings.known)
    by_class = words.groupBy("class").agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()
    return Vocabulary(top, total["n"] or 0, total["v"], by_class, settings), total["end"] or 0


def encode(docs: DataFrame, vocabulary, end_count: int) -> DataFrame:
    """Each row's symbols, what its frequent words add to the scores, and its other words (hashes)."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights = vocabulary.value, byte_weights(True)
        divisors, log_counts, settings = v.share_divisors(), np.log10(v.counts + 0.5), v.settings
        for batch in batches:
            for block in blocks(batch.column(1)):
                starts, ends = block.words()
                found = block.hashes(starts, ends, weights)
                at = np.minimum(np.searchsorted(v.hashes, found), max(len(v.hashes) - 1, 0))
                known = v.hashes[at] == found if len(v.hashes) else np.zeros(len(found), bool)
                symbol = np.where(known, v.symbol[at], -1) if len(v.hashes) else np.full(len(found), -1)
                kinds = word_classes(block, starts, ends, weights, settings.classes)
                tail = symbol < 0
                symbols = np.where(tail, settings.symbols + kinds, symbol).astype(np.uint16)
                logs = np.where(known, log_counts[at], 0.0) if len(v.hashes) else np.zeros(len(found))
                bounds = block.bounds(starts)
                part = lambda x: _sums(x, bounds)  # noqa: E731, B023
                end = np.uint16(v.size - 1).tobytes()
                rare = np.concatenate([[0], np.cumsum(~known)])[bounds]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        batch.column(2).slice(block.first, block.rows),
                        pa.array([symbols[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        pa.array(np.diff(bounds) + 1),
                        pa.array(np.diff(bounds) - np.diff(rare) + (end_count > 0)),
                        pa.array(part(logs) + math.log10(end_count + 0.5)),
                        pa.array(part(np.where(tail, logs - divisors[kinds], 0.0))),
                        pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(found[~known].view(np.int64))),
                    ],
                    ["key", "held_out", "symbols", "n_tokens", "n_known", "base", "tail", "rare"],
                )

    schema = f"key {kind}, held_out boolean, symbols binary, n_tokens bigint, n_known bigint, base double, tail double, rare array<bigint>"
    return docs.select("key", "text", "held_out").mapInArrow(run, schema)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


class Model:
    """Start, transition and emission probabilities; emissions by symbol, then state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(symbols: int, states: int, seen: np.ndarray) -> Model:
        """Nearly the unigram distribution in every state, told apart by a fixed pseudorandom factor."""
        shake = mix(np.arange(symbols * states, dtype=np.uint64)) >> np.uint64(40)
        emit = (seen + 0.1)[:, None] * (0.5 + shake.reshape(symbols, states) / float(1 << 24))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of_counts(cells: np.ndarray, symbols: int, states: int) -> Model:
        """From expected counts, each with a little added so that nothing has probability 0."""
        start, move, emit = np.split(cells, [states, states + states * states])
        start, move, emit = start + 0.1, move.reshape(states, states) + 0.1, emit.reshape(symbols, states)
        emit = emit + 0.01 * (emit.sum(1, keepdims=True) + 1) / (emit.sum() + symbols) * symbols / 100 + 1e-3
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, texts: list[np.ndarray], keep: list | None = None) -> np.ndarray:
        """Log likelihood of each text; texts are sorted, the longest first. Scaled at every step.

        ``keep`` gets the scaled forward variables and scales of each step.
        """
        sizes = np.array([len(x) for x in texts])
        flat, begin = np.concatenate(texts), np.cumsum(sizes) - sizes
        out, alpha = np.zeros(len(texts)), None
        active = len(texts)
        for t in range(sizes[0]):
            while sizes[active - 1] <= t:
                active -= 1
            symbols = flat[begin[:active] + t]
            before = self.start if t == 0 else alpha[:active] @ self.move
            alpha = before * self.emit[symbols]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            out[:active] += np.log(scale)
            if keep is not None:
                keep.append((symbols, alpha, scale))
        return out

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """Expected counts of starts, moves and emissions over some texts (sorted, the longest first), and their log likelihood."""
        steps: list = []
        likelihood = self.forward(texts, steps).sum()
        states = len(self.start)
        moves, gammas = np.zeros((states, states)), [None] * len(steps)
        beta = np.empty((0, states))
        for t in range(len(steps) - 1, -1, -1):
            symbols, alpha, _ = steps[t]
            own = np.ones_like(alpha)
            if t + 1 < len(steps):
                later, _, scale = steps[t + 1]
                onward = self.emit[later] * beta / scale[:, None]
                own[: len(later)] = onward @ self.move.T
                moves += alpha[: len(later)].T @ onward
            beta = own
            gammas[t] = alpha * beta
        gamma, symbols = np.concatenate(gammas), np.concatenate([s for s, _, _ in steps])
        emit = np.stack([np.bincount(symbols, weights=gamma[:, k], minlength=len(self.emit)) for k in range(states)], 1)
        return np.concatenate([gammas[0].sum(0), (moves * self.move).ravel(), emit.ravel()]), likelihood


def _groups(batch: pa.RecordBatch, tokens: int = 400_000) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of similar length together, the longest first: their numbers and symbols."""
    texts = [np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in batch.column("symbols")]
    order = np.argsort([-len(x) for x in texts], kind="stable")
    held, size = [], 0
    for i in order:
        held.append(i)
        size += len(texts[i])
        if size >= tokens:
            yield np.array(held), [texts[j] for j in held]
            held, size = [], 0
    if held:
        yield np.array(held), [texts[j] for j in held]


def train(encoded: DataFrame, seen: np.ndarray, settings: Settings) -> tuple[Model, list[float]]:
    """Baum-Welch over all training texts, and the mean log likelihood of a token before each iteration."""
    spark, states, symbols = encoded.sparkSession, settings.states, len(seen)
    learning = encoded.where("not held_out").select("symbols")
    size = states + states * states + symbols * states
    model, likelihoods = Model.first(symbols, states, seen), []
    for _ in range(settings.iterations if seen.any() else 0):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(size + 1)
            for batch in batches:
                for _, group in _groups(batch):
                    counts, likelihood = sent.value.expected(group)
                    cells[:-1] += counts
                    cells[-1] += likelihood
            if cells.any():
                yield slices(cells)

        cells = summed(learning.mapInArrow(run, SCHEMA), size + 1, np.float64)
        sent.unpersist()
        model = Model.of_counts(cells[:-1], symbols, states)
        likelihoods.append(cells[-1] / seen.sum())
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < settings.settled:
            break
    return model, likelihoods


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Train on the rows that are not held out and score all.

    Returns ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10) for each row.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), fold.eqNullSafe(F.lit(HELD_OUT)).alias("held_out"))
    path = scratch_path(spark, "words")
    count_words(rows, settings.classes).write.parquet(path)
    counts = spark.read.parquet(path)
    words, end_count = vocabulary(counts, settings)
    sent = spark.sparkContext.broadcast(words)

    path = scratch_path(spark, "symbols")
    encode(rows, sent, end_count).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    encoded = spark.read.parquet(path)
    model = spark.sparkContext.broadcast(train(encoded, words.seen(end_count), settings)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for which, group in _groups(batch):
                found[which] = model.value.forward(group) / math.log(10)
            columns = [x for name, x in zip(batch.schema.names, batch.columns, strict=True) if name != "symbols"]
            names = [x for x in batch.schema.names if x != "symbols"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*names, "chain"])

    narrow = encoded.select("row", "key", "held_out", "n_tokens", "n_known", "base", "tail", "symbols")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "symbols")
    scored = narrow.mapInArrow(run, f"{kinds}, chain double")
    # words that the tasks don't hold: both models use log10(c + 0.5)
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word", "left")
    n = F.coalesce("n", F.lit(0))
    others = rare.groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("more"), F.count("n").alias("found"))
    # a rare word's divisors are those of its class; they are in the tail already
    out = scored.join(others, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0.0)), "found": F.coalesce("found", F.lit(0))})
    return out.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("found")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(words.base_divisor())).alias("base_score"),
        (F.col("chain") + F.col("tail") + F.col("more")).alias("score"),
    )
