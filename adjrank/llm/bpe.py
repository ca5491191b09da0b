"""Token counts under a byte-level BPE, by rank-synchronous merging of arrays.

The pre-tokens of a block that were not counted before become one ragged array
of symbols. In each round, every sequence finds its lowest-ranked pair and
merges all its occurrences at once; sequences without a known pair are done.
What survives is counted. A round costs as much as the sequences are long, and
a long one has many, so these keep the rank of each pair instead, by rank: a
round takes the places of the lowest rank, in all of them, and looks up again
only the pairs next to a merge. So a text without a space costs little more
than one with many.

Nulls count as empty texts (no tokens). Rows are counted alone, where they are
read, so repeated rows, empty tables and further columns need no care.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the pre-tokens of byte-level BPE. White space as Unicode defines it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
    r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
NO_PAIR = np.iinfo(np.int64).max
#: Pre-tokens whose counts a task keeps; beyond that it begins anew.
KEPT = 400_000
#: Bytes from which a pre-token keeps its ranks from round to round; such are not remembered.
LONG = 128


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary file's merges as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        ids = held["model"]["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in held["model"]["merges"]]
        left, right, made = (np.array([ids[x] for x in col], np.int64) for col in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        self.width = max(ids.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.made_at = made
        self.of_byte = np.array([ids[x] for x in byte_letters()], np.int64)
        self.special = [x["content"] for x in held.get("added_tokens", ())]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NO_PAIR if there is none, and the symbol it makes."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ranks[at], NO_PAIR), self.made[at]


def count_symbols(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols each non-empty byte string has when no pair can be merged any more."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    symbols = merges.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    out, long = np.empty_like(sizes), sizes >= LONG
    for count, some in ((_merge_short, ~long), (_merge_long, long)):
        if some.any():
            out[some] = count(symbols[np.repeat(some, sizes)], sizes[some], merges)
    return out


def _every_second(follows: np.ndarray) -> np.ndarray:
    """Of occurrences that overlap, as in aaa, every second one from the left; ``follows`` tells which overlap the one before."""
    begin = np.flatnonzero(~follows)
    return (np.arange(len(follows)) - np.repeat(begin, np.diff(np.append(begin, len(follows))))) % 2 == 0


def _merge_short(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> np.ndarray:
    """Sizes after all merges, each round looking up all pairs of the sequences that aren't done."""
    out = sizes.copy()
    which = np.arange(len(sizes))
    keep = sizes > 1
    symbols, which, sizes = symbols[np.repeat(keep, sizes)], which[keep], sizes[keep]
    while len(which):
        ends = np.cumsum(sizes)
        seq = np.repeat(np.arange(len(which)), sizes)
        rank, made = merges.find(symbols[:-1], symbols[1:])
        rank[ends[:-1] - 1] = NO_PAIR  # no pair across sequences
        rank = np.append(rank, NO_PAIR)
        best = np.minimum.reduceat(rank, ends - sizes)
        hit = np.flatnonzero((rank == best[seq]) & (rank != NO_PAIR))
        follows = np.zeros(len(hit), bool)
        follows[1:] = hit[1:] == hit[:-1] + 1
        hit = hit[_every_second(follows)]
        symbols[hit] = made[hit]
        left = np.ones(len(symbols), bool)
        left[hit + 1] = False
        sizes = sizes - np.bincount(seq[hit], minlength=len(which))
        out[which] = sizes
        active = (best != NO_PAIR) & (sizes > 1)
        symbols = symbols[left & active[seq]]
        which, sizes = which[active], sizes[active]
    return out


def _merge_long(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> np.ndarray:
    """Sizes after all merges, each round touching only the places of the lowest rank and their neighbours.

    Sequences don't meet, so all of them take the lowest rank of any at once.
    """
    ends = np.cumsum(sizes)
    seq = np.repeat(np.arange(len(sizes)), sizes)
    before, after = np.arange(-1, len(symbols) - 1), np.arange(1, len(symbols) + 1)
    before[ends - sizes], after[ends - 1] = -1, -1
    rank = np.full(len(symbols), NO_PAIR)
    places: dict[int, list[np.ndarray]] = {}  # those that a rank had when it was looked up
    waiting: list[int] = []

    def look_up(at: np.ndarray) -> None:
        at = at[after[at] >= 0]
        found, _ = merges.find(symbols[at], symbols[after[at]])
        rank[at] = found
        order = np.argsort(found, kind="stable")[: np.count_nonzero(found != NO_PAIR)]
        at, found = at[order], found[order]
        cuts = np.flatnonzero(np.diff(found, prepend=-1, append=NO_PAIR)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = int(found[a])
            if r not in places:
                places[r] = []
                heappush(waiting, r)
            places[r].append(at[a:b])

    look_up(np.arange(len(symbols)))
    while waiting:
        lowest = heappop(waiting)
        held = places.pop(lowest)
        hit = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
        hit = hit[rank[hit] == lowest]  # others have merged since
        if not len(hit):
            continue
        follows = np.zeros(len(hit), bool)
        follows[1:] = after[hit[:-1]] == hit[1:]
        hit = hit[_every_second(follows)]
        gone = after[hit]
        symbols[hit] = merges.made_at[lowest]
        rank[gone] = rank[hit] = NO_PAIR
        sizes = sizes - np.bincount(seq[hit], minlength=len(sizes))
        beyond = after[gone]
        after[hit] = beyond
        before[beyond[beyond >= 0]] = hit[beyond >= 0]
        ahead = before[hit]
        look_up(np.union1d(hit, ahead[ahead >= 0]))
    return sizes


class Counter:
    """Counts the tokens of texts; remembers the pre-tokens it has met."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) or r"(?!)")
        self.pre_token = regex.compile(PRE_TOKEN)
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT:
            self.known.clear()
        found = []
        for text in texts:
            parts = self.split.split(text) if self.merges.special else [text]
            pre = self.pre_token.findall(parts[0]) if len(parts) == 1 else [x for p in parts for x in self.pre_token.findall(p)]
            found.append((pre, len(parts) - 1))
        new = list({x for pre, _ in found for x in pre if x not in self.known})
        if new:
            self.known.update(zip(new, count_symbols([x.encode() for x in new], self.merges).tolist(), strict=True))
        counts = [sum(map(self.known.__getitem__, pre)) + special for pre, special in found]
        for x in new:
            if len(x) >= LONG:
                del self.known[x]
        return counts


def groups(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) for each row.

    ``path`` is that of the vocabulary file on every machine. Special strings
    within a text are one token each, none are added.
    """
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path)
            texts = batch.column(1).to_pylist()
            tokens = np.array([n for some in groups(texts, 1 << 20) for n in counter.counts(some)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens)], ["key", "n_tokens"])

    # counting the bytes beside the text would send them to Python and back
    sized = narrow.select(F.struct("key", F.octet_length("text").cast("long").alias("n_bytes")).alias("key"), "text")
    schema = T.StructType([T.StructField("key", sized.schema["key"].dataType), T.StructField("n_tokens", T.LongType())])
    return sized.mapInArrow(run, schema).select(
        F.col("key.key").alias(key),
        F.col("key.n_bytes").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
