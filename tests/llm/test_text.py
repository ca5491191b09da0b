"""Operators on single texts, against plain Python."""

import random
import re
import string
import time
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import clashing, documents
from tokenizers import Tokenizer

from adjrank.llm import bpe, packing, quality
from adjrank.llm.words import blocks, byte_weights, shingles

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def counter():
    return bpe.Counter(BYTE_BPE)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE_BPE)


TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r'aab<|>stdofex1.")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8))
def test_counts_equal_the_library(counter, byte_library, texts):
    assert counter.counts(texts) == [len(byte_library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_overlapping_pairs_merge_from_the_left(counter, byte_library):
    for n in range(1, 40):
        for letter in ("a", "=", " ", "\n", "é"):
            assert counter.counts([letter * n]) == [len(byte_library.encode(letter * n).ids)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ab", "aab ", "théèñ", "01", "漢字a", "=-"]), st.integers(1, 900), st.integers(0, 99)), min_size=1, max_size=4))
def test_long_pre_tokens_equal_the_library(counter, byte_library, drawn):
    texts = ["".join(random.Random(seed).choices(letters, k=n)) for letters, n, seed in drawn]
    assert counter.counts(texts) == [len(byte_library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_megabytes_without_a_space(counter, byte_library):
    draw = random.Random(3)
    texts = ["".join(draw.choices(string.ascii_letters, k=1 << 20)), "a" * (1 << 20), "漢字" * (1 << 17)]
    begin = time.process_time()
    found = counter.counts(texts)
    assert time.process_time() - begin < 60  # some seconds, where all pairs in each round took minutes
    assert found == [len(byte_library.encode(x, add_special_tokens=False).ids) for x in texts]
    assert not any(len(x) >= bpe.LONG for x in counter.known)


def test_token_counts(spark, odd, nothing):
    library = Tokenizer.from_file(BYTE_BPE)
    found = bpe.token_counts(clashing(odd), BYTE_BPE, limit=10).collect()
    expected = []
    for row in odd.collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        expected.append((row.doc_id, len((row.text or "").encode()), n, n > 10))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert bpe.token_counts(nothing, BYTE_BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_word_ids_equal_the_library(texts):
    library = Tokenizer.from_file(WORD_BPE) if not hasattr(test_word_ids_equal_the_library, "t") else test_word_ids_equal_the_library.t
    test_word_ids_equal_the_library.t = library
    found = [x.tolist() for x in packing.WordIds(WORD_BPE).texts(pa.array(texts))]
    assert found == [library.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8), st.integers(1, 60))
def test_words_and_shingles(texts, size):
    found = []
    weights = byte_weights(True)
    for block in blocks(pa.array(texts, pa.string()), size):
        starts, ends = block.words()
        rows, hashes = shingles(block.hashes(starts, ends, weights), block.bounds(starts)[1:] - block.bounds(starts)[:-1], 3)
        words = [block.bytes_of(a, b).decode() for a, b in zip(starts, ends, strict=True)]
        for i in range(block.rows):
            a, b = block.bounds(starts)[i : i + 2]
            found.append((words[a:b], sorted(hashes[rows == i].tolist())))
    assert [x for x, _ in found] == [WORD.findall(x or "") for x in texts]
    names = {}
    for words, hashes in found:
        low = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
        sets = [tuple(low[j : j + 3]) for j in range(len(low) - 2)] or ([tuple(low)] if low else [])
        assert len(sets) == len(hashes)
        # equal shingles have equal hashes and different ones different hashes
        for shingle in set(sets):
            names.setdefault(shingle, None)
        assert len(set(sets)) == len(set(hashes))


def plain_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed,
    )


def test_quality_counts(spark, odd, some, nothing):
    rows = [r for r in odd.collect() if r.doc_id != 7] + some.where("n_chars < 2000").collect()
    rows += documents(spark, [(100, "x y z\r\nx y z\r\nx y z\n#% a|b"), (101, "w " * 60 + "\n")]).collect()
    df = spark.createDataFrame(rows, some.schema)
    found = quality.quality(clashing(df)).collect()
    expected = [(r.doc_id, *plain_counts(r.text)) for r in rows]
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=str) == sorted(expected, key=str)
    assert not any(r.kept and r.base_failed for r in found)
    assert quality.quality(nothing).count() == 0


PROSE = " ".join(f"Sentence{i} says{i} something of{i} its own{i} about the{i} matter at{i} hand." for i in range(8))


def test_failing_lines_go_and_documents_that_lose_too_much(spark):
    menu = "Home | News | Sport | Contact | About | Shop"
    rows = [
        (1, PROSE),
        (2, PROSE + "\n" + menu + "\nClick here to read more\n" + PROSE.upper()),
        (3, "\n".join([menu] * 10) + "\n" + PROSE[:40]),
        (4, " ".join(f"word{i}!!" for i in range(80))),
        (5, " ".join(f"word{i}" for i in range(80))),
        (6, " ".join(f"word{i}***" for i in range(80)) + "."),
    ]
    kept = {r.doc_id: r for r in quality.clean(clashing(documents(spark, rows))).collect()}
    assert set(kept) == {1, 2}
    assert kept[1].text == PROSE and kept[2].text == PROSE + "\n" + PROSE.upper() and kept[2].n_chars == len(kept[2].text)


def test_clean_keeps_columns_and_repeated_rows(spark, nothing):
    df = clashing(documents(spark, [(1, PROSE), (1, PROSE), (None, PROSE), (2, None)]))
    out = quality.clean(df)
    assert out.schema == df.schema and [r.doc_id for r in out.collect()] == [1, 1, None]
    assert quality.clean(nothing).collect() == []


def test_packing_of_odd_texts(spark, odd, nothing):
    library = Tokenizer.from_file(WORD_BPE)
    found = packing.packed(clashing(odd), WORD_BPE, 1, size=64).collect()
    expected = []
    for row in odd.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            expected.append((row.doc_id, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(expected, key=str)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(nothing, WORD_BPE, 1).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_sweep_places_every_piece_once_and_packs_tightly(counts):
    plan = packing.sweep(counts, 20)
    used, ranks = {}, {n: [] for n in counts}
    for length, rank, n, first, offset in plan:
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            assert used.get(s, 0) == offset
            used[s] = offset + length
            assert used[s] <= 20
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    # no gap could still take the smallest piece of a later sequence: at most one sequence is half empty
    assert sum(x <= 10 for x in used.values()) <= 1


def test_equal_lengths_are_ranked_across_parts(spark):
    rows = [(i, "same words in every text") for i in range(500)]
    found = packing.packed(documents(spark, rows).repartition(7), WORD_BPE, 1, size=20).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == 500 and max(r.sequence_id for r in found) == -(-500 // 3) - 1


def test_boilerplate_is_whole_words_and_most_of_a_line():
    bad = ["Sign in", "Click here to read more.", "Privacy policy | Terms of use", "\u201cRead more\u201d", "please log in."]
    good = [
        "Her design in oak won.", "The catalog in print is long.", "A dialog in French began.", "Posts in this thread more often agree.",
        "On Monday all the boys had to sign in at the school office before they went to class.",
    ]
    lines = bad + good
    # a text of its own for each, and all in one text; no phrase reaches from one text into the next
    block = next(blocks(pa.array([*lines, "\n".join(lines), "he may sign", " in ink.", "\u00e9sign in.", ""]), 1 << 20))
    row, _, _, found = quality.judge(block, quality.Rules(unpunctuated=99, max_separator_ratio=9))["lines"]
    expected = [True] * len(bad) + [False] * len(good)
    assert found.tolist() == [*expected, *expected, False, False, False]
