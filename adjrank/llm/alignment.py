"""Alignment of two tokenizers' tokens by pointer jumping, and how often ids are linked.

The texts of a block are tokenized by both libraries. Every token points to the
token that overlaps it and reaches farthest to the right; a token that none
reaches beyond points to itself. Doubling all pointers of the block at once,
until none changes, takes each token to the last one of its component of
overlapping tokens, which labels the group: groups end where tokens of both
end. No step looks at pairs of tokens.

Links of a group are all its pairs of an A and a B id. A block's different
pairs, with the number of documents that hold them, are added up over all
blocks; each block gets the totals of its own pairs back. In long groups equal
ids count once with their number, and a text with too many different pairs for
one block is dealt over several by its A ids, so memory is bounded.

Texts that are null, empty, or that a tokenizer does not give back byte by byte
have no tokens: zeros and an empty string. Rows that repeat are documents of
their own, null keys stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adjrank.llm.bpe import PRE_TOKEN, byte_letters, groups as texts_of
from adjrank.llm.tables import bucketed
from adjrank.session import stored

#: Characters that are tokenized at once; links that are kept in a block; bytes of text for each stored part.
CHARS, LINKS, PART_BYTES = 1 << 18, 3_000_000, 16 << 20
#: Pre-tokens whose ids a task keeps; beyond that it begins anew.
KEPT = 200_000
#: Links of a group from which equal ids are counted together.
LONG = 64

DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string"


class Pieces:
    """The bytes of each id's token."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class ByteWords:
    """Ids of texts by a byte-level vocabulary's library, put together from those of their pre-tokens.

    No token reaches across pre-tokens, so each different one is given to the library once.
    """

    def __init__(self, model):
        self.model, self.split = model, regex.compile(PRE_TOKEN)
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.held, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.place) > KEPT:
            self.clear()
        words = [self.split.findall(x) for x in texts]
        new = list({w for found in words for w in found if w not in self.place})
        if new:
            made = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] for w in new]
            self.place.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.held = np.concatenate([self.held, np.fromiter((i for x in made for i in x), np.int64)])
            self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in made], np.int64)])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64)
        sizes, starts = self.sizes[at], (np.cumsum(self.sizes) - self.sizes)[at]
        ends = np.cumsum(sizes)
        ids = self.held[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, _sums(sizes, np.array([len(x) for x in words], np.int64))


class Tokenizers:
    """Both libraries, without special tokens: their strings are ordinary text."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.words = ByteWords(self.a.model)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: i for i, letter in enumerate(byte_letters())}
        with open(path_a, encoding="utf-8") as file:
            ids = json.load(file)["model"]["vocab"]
        names = [""] * max(self.a.get_vocab_size(), max(ids.values()) + 1)
        for name, i in ids.items():
            names[i] = name
        self.pieces_a = Pieces([bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode() for name in names])
        self.pieces_b = Pieces([self._bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())])

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]):
        """Ids and their number in each text, of both."""
        return self.words.ids([" " + x if x else "" for x in texts]), _flat(self.b.encode(texts, num_threads=1))


class Tokens(NamedTuple):
    """One tokenizer's tokens of some texts in a row: ids, ends in bytes, and how many each text has."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum())), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    held = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return held[ends] - held[ends - counts]


def tokens(texts: list[str], both: Tokenizers) -> tuple[Tokens, Tokens]:
    """Tokens of both for the texts that both give back byte by byte; the others have none."""
    spelled = [b" " + x.encode() if x else b"" for x in texts]
    sizes = np.array([len(x) for x in spelled], np.int64)
    (ids_a, n_a), (ids_b, n_b) = both.ids(texts)
    good = (sizes > 0) & (_sums(both.pieces_a.sizes[ids_a], n_a) == sizes) & (_sums(both.pieces_b.sizes[ids_b], n_b) == sizes)
    for _ in range(2):  # first by length, then byte by byte
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b, sizes = np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, sizes, 0)
        data = np.frombuffer(b"".join(x for x, ok in zip(spelled, good, strict=True) if ok), np.uint8)
        wrong = (both.pieces_a.spelled(ids_a) != data) | (both.pieces_b.spelled(ids_b) != data)
        good = good & (_sums(wrong, sizes) == 0)
        spelled = [x if s else b"" for x, s in zip(spelled, sizes, strict=True)]
    ends_a, ends_b = np.cumsum(both.pieces_a.sizes[ids_a]), np.cumsum(both.pieces_b.sizes[ids_b])
    return Tokens(ids_a, ends_a, n_a), Tokens(ids_b, ends_b, n_b)


def label(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every A and B token, numbered from 0 in order, and the number of groups.

    Both tokenize the same bytes; ``ends`` are where tokens end.
    """
    n = len(ends_a)
    over_a = n + np.searchsorted(ends_b, ends_a)  # the B token that holds an A token's last byte
    under = np.searchsorted(ends_a, ends_b)
    own = n + np.arange(len(ends_b))
    over_b = np.where(ends_a[under] > ends_b, under, own) if n else own
    to = np.concatenate([over_a, over_b])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    last = to[n:] == own
    number = np.cumsum(last) - 1
    return number[to[:n] - n], number[to[n:] - n], int(last.sum())


def written(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups as ``a1,a2|b1;a3|b2;`` in one row of bytes, and where each group ends there."""
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    until_a, until_b = np.cumsum(in_a), np.cumsum(in_b)
    place_a = np.arange(len(a.ids)) + (until_b - in_b)[group_a]
    place_b = np.arange(len(b.ids)) + until_a[group_b]
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    ids[place_a], ids[place_b] = a.ids, b.ids
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[place_a[until_a - 1]], mark[place_b[until_b - 1]] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    top = 10
    while (ids >= top).any():
        digits += ids >= top
        top *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    left = ids.copy()
    for k in range(int(digits.max(initial=0))):
        here = digits > k
        out[(ends - 2 - k)[here]] = 48 + left[here] % 10
        left //= 10
    return out, ends[place_b[until_b - 1]]


def _entries(ids: np.ndarray, group: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of tokens, with equal ids of a long group together; in the order of groups."""
    if not long.any():
        return group, ids, np.ones(len(ids), np.int8)
    in_long = long[group]
    held, number = np.unique((group[in_long] << 24) | ids[in_long], return_counts=True)
    group = np.concatenate([group[~in_long], held >> 24])
    order = np.argsort(group, kind="stable")
    ids = np.concatenate([ids[~in_long], held & ((1 << 24) - 1)])
    return group[order], ids[order], np.concatenate([np.ones(len(ids) - len(held), np.int64), number])[order]


class Links(NamedTuple):
    """Links in the order of documents: document, pair of ids (A in the upper half), and how many."""

    doc: np.ndarray
    pair: np.ndarray
    number: np.ndarray


def links(entries_a, entries_b, doc_of: np.ndarray) -> Links:
    """All pairs of an A and a B entry of the same group."""
    (group, id_a, many_a), (group_b, id_b, many_b) = entries_a, entries_b
    in_b = np.bincount(group_b, minlength=len(doc_of))
    first = np.cumsum(in_b) - in_b
    n = in_b[group]
    ends = np.cumsum(n)
    at_b = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[group] - ends + n, n)
    at_a = np.repeat(np.arange(len(group)), n)
    return Links(doc_of[group].astype(np.int32)[at_a], (id_a[at_a] << 32) | id_b[at_b], many_a[at_a] * many_b[at_b])


class Block:
    """What a stored row is made of: documents' facts and their links."""

    def __init__(self):
        self.keys: list[pa.Array] = []
        self.docs: list[pa.Array] = []
        self.links: list[Links] = []
        self.n = self.size = 0

    def add(self, keys: pa.Array, docs: pa.Array, found: Links):
        self.keys.append(keys)
        self.docs.append(docs)
        self.links.append(Links(found.doc + np.int32(self.n), found.pair, found.number))
        self.n += len(keys)
        self.size += len(found.pair)


def _order(pair: np.ndarray) -> np.ndarray:
    """The stable order of pairs: pairs and places sorted as one number each, as long as both fit in one."""
    if not len(pair):
        return np.empty(0, np.int64)
    low, place = int((pair & 0xFFFFFFFF).max()).bit_length(), len(pair).bit_length()
    if int(pair.max() >> 32).bit_length() + low + place > 63:
        return np.argsort(pair, kind="stable")
    held = (((pair >> 32) << low | pair & 0xFFFFFFFF) << place) | np.arange(len(pair))
    held.sort()
    return held & ((1 << place) - 1)


def _stored_row(number: int, home: int, keys: pa.Array, docs: pa.Array, found: Links) -> pa.RecordBatch:
    """One block: its documents, its different pairs with the documents that hold them, and its links as places among those."""
    order = _order(found.pair)
    pair, doc = found.pair[order], found.doc[order]
    new = np.ones(len(order), bool)
    new[1:] = pair[1:] != pair[:-1]
    once = new.copy()
    once[1:] |= doc[1:] != doc[:-1]
    starts = np.flatnonzero(new)
    place = np.empty(len(order), np.uint32)
    place[order] = np.cumsum(new) - 1
    held = np.add.reduceat(once.astype(np.int64), starts) if len(starts) else starts
    bounds = np.searchsorted(found.doc, np.arange(len(keys) + 1))
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    many = found.number.astype(np.int64).tobytes() if (found.number != 1).any() else b""
    columns = {
        "block": pa.array([number]),
        "home": pa.array([home]),
        "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
        "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
        "bounds": one(bounds, pa.int64()),
        "links": pa.array([place.tobytes()], pa.binary()),
        "many": pa.array([many], pa.binary()),
        "pairs": one(pair[starts], pa.int64()),
        "held": one(held, pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _align(texts: list[str], both: Tokenizers):
    """Facts of each text, entries of both tokenizers, and the text of each group."""
    a, b = tokens(texts, both)
    group_a, group_b, n = label(a.ends, b.ends)
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    rows = np.arange(len(texts))
    doc_of = np.empty(n, np.int64)
    doc_of[group_b] = np.repeat(rows, b.counts)
    spelled, ends = written(a, b, group_a, group_b, n)
    until = np.searchsorted(doc_of, np.arange(1, len(texts) + 1))  # groups up to each text's end
    stops = np.concatenate([[0], ends])[until]
    begins = np.concatenate([[0], stops[:-1]])
    shas = [hashlib.sha256(spelled[x : y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(begins, stops, strict=True)]
    n_groups = np.bincount(doc_of, minlength=len(texts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc_of, in_a * in_b)
    facts = [pa.array(x, pa.int64()) for x in (a.counts, b.counts, n_groups, n_links)]
    docs = pa.StructArray.from_arrays([*facts, pa.array(shas, pa.string())], ["n_a", "n_b", "n_groups", "n_links", "sha"])
    long = in_a * in_b > LONG
    return docs, _entries(a.ids, group_a, long), _entries(b.ids, group_b, long), doc_of


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows ``key``, ``text`` as blocks with their links."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        both, block = Tokenizers(path_a, path_b), Block()

        def flush() -> pa.RecordBatch:
            found = Links(*(np.concatenate(x) for x in zip(*block.links, strict=True)))
            return _stored_row(number, number, pa.concat_arrays(block.keys), pa.concat_arrays(block.docs), found)

        for batch in batches:
            first = 0
            for some in texts_of(batch.column(1).to_pylist(), CHARS):
                keys = batch.column(0).slice(first, len(some))
                first += len(some)
                docs, entries_a, entries_b, doc_of = _align(some, both)
                size = int(np.bincount(entries_b[0], minlength=len(doc_of))[entries_a[0]].sum())
                if size <= LINKS:
                    block.add(keys, docs, links(entries_a, entries_b, doc_of))
                    if block.size >= LINKS:
                        yield flush()
                        number, block = number + 1, Block()
                    continue
                # too many for one block: one for each class of A ids
                home = number + 1 if block.n else number
                if block.n:
                    yield flush()
                classes = -(-size // LINKS)
                for i in range(classes):
                    mine = entries_a[1] % classes == i
                    yield _stored_row(home + i, home, keys, docs, links(tuple(x[mine] for x in entries_a), entries_b, doc_of))
                number, block = home + classes, Block()
        if block.n:
            yield flush()

    doc = f"array<struct<{DOC.replace(' ', ':').replace(',:', ',')}>>"
    schema = (
        f"block bigint, home bigint, keys array<{kind}>, docs {doc}, bounds array<bigint>, links binary, many binary, "
        "pairs array<bigint>, held array<bigint>"
    )
    return docs.mapInArrow(run, schema)


def _totals(blocks: DataFrame) -> DataFrame:
    """For each block, the documents that hold each of its pairs anywhere, and whether that is the most for the pair's A id."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x"))
    each = each.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = stored(each.groupBy("pair").agg(F.sum("held").alias("count")), "pairs")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = each.select("block", "place", "pair").join(counts, "pair")
    return told.groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("told"))


def link_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row.

    The paths are those of the tokenizers' files on every machine.
    """
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = bucketed(linked(narrow, path_a, path_b), "links", -(-total // PART_BYTES), "block")
    held = blocks.join(_totals(blocks).hint("shuffle_hash"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                keys, bounds = column["keys"][i].values, column["bounds"][i].values.to_numpy()
                place = np.frombuffer(column["links"][i].as_py(), np.uint32)
                many = np.frombuffer(column["many"][i].as_py(), np.int64)
                many = many if len(many) else np.ones(len(place), np.int64)
                told = column["told"][i].values
                count, best = np.zeros(0 if told is None else len(told), np.int64), np.zeros(0 if told is None else len(told), np.int64)
                if told is not None:
                    at = told.field("place").to_numpy()
                    count[at] = told.field("count").to_numpy()
                    best[at] = told.field("best").to_numpy(zero_copy_only=False)
                n = np.diff(bounds)
                facts = [_sums(many * x[place], n) for x in (best, count)]
                docs = column["docs"][i].values
                columns = [
                    pa.array(np.full(len(keys), column["home"][i].as_py())),
                    pa.array(np.arange(len(keys))),
                    keys,
                    *(docs.field(x) for x in ("n_a", "n_b", "n_groups", "n_links", "sha")),
                    *(pa.array(x, pa.int64()) for x in facts),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = narrow.schema["key"].dataType.simpleString()
    names = ["home", "row", "key", "n_a", "n_b", "n_groups", "n_links", "sha", "n_best", "count_sum"]
    out = held.select("home", "keys", "docs", "bounds", "links", "many", "told").mapInArrow(
        run, f"home bigint, row bigint, key {kind}, {DOC}, n_best bigint, count_sum bigint"
    )
    parted = blocks.where("block <> home").select("home").distinct()
    if not parted.isEmpty():  # documents whose links are in several blocks
        facts = [F.first(x).alias(x) for x in ("key", "n_a", "n_b", "n_groups", "n_links", "sha")]
        out = out.groupBy("home", "row").agg(*facts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(F.col("key").alias(key), *names[3:7], "n_best", "count_sum", F.col("sha").alias("groups_sha256"))


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ``groups`` of every row: the A and the B ids of each, and where it ends in the bytes of space and text."""
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def lists(ids: np.ndarray, group: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n + 1)), pa.int32()), pa.array(ids, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(path_a, path_b)
        for batch in batches:
            first = 0
            for some in texts_of(batch.column(1).to_pylist(), CHARS):
                a, b = tokens(some, both)
                group_a, group_b, n = label(a.ends, b.ends)
                ends = np.empty(n, np.int64)
                ends[group_b] = b.ends  # the last token of a group stays
                in_doc = np.repeat(np.arange(len(some)), b.counts)
                doc_of = np.empty(n, np.int64)
                doc_of[group_b] = in_doc
                sizes = np.bincount(in_doc, both.pieces_b.sizes[b.ids], len(some)).astype(np.int64)
                ends -= (np.cumsum(sizes) - sizes)[doc_of]
                held = pa.StructArray.from_arrays([lists(a.ids, group_a, n), lists(b.ids, group_b, n), pa.array(ends)], ["a", "b", "end"])
                bounds = pa.array(np.searchsorted(doc_of, np.arange(len(some) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.ListArray.from_arrays(bounds, held)], ["key", "groups"])
                first += len(some)

    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, groups array<struct<a:array<int>,b:array<int>,end:bigint>>").withColumnRenamed("key", key)
