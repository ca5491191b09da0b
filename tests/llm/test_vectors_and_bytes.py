"""Whitening, suffix dedup and alignment against brute force."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_cases import ODD, clashing, documents
from tokenizers import Tokenizer

from adjrank.llm import alignment, suffix_dedup, whitening

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


# --- whitening -----------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def check_whitening(df, keys, held, components=32):
    """The result for ``held`` rows of vectors equals a direct decomposition up to signs and bases of equal eigenvalues."""
    x = np.floor(np.array(held, np.float32).astype(float) * 64) + 1_000_000
    n = len(x)
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    value, vector = value[::-1], vector[:, ::-1]
    k = min(components, int((value > 1e-12 * value[0]).sum()))
    rows = whitening.whitened(df, components=components).collect()
    assert len(rows) == n * k
    got = collections.defaultdict(lambda: np.full(k, np.nan))
    for r in rows:
        got[r.vec_id][r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(value[r.component - 1] / value.sum(), rel=1e-9)
    want = ((x - x.mean(0)) @ vector[:, :k]) / np.sqrt(value[:k])
    made = np.array([got[key] for key in keys])
    for first in range(k):
        alike = np.isclose(value[:k], value[first], rtol=1e-9)
        # the same space: equal inner products
        assert np.allclose(made[:, alike] @ made[:, alike].T, want[:, alike] @ want[:, alike].T, atol=1e-6) or alike[-1]
    exact = [[int(c) for c in row] for row in x]
    sums = [sum(col) for col in zip(*exact, strict=True)]
    deviation = {key: sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for key, row in zip(keys, exact, strict=True)}
    assert all(r.deviation == deviation[r.vec_id] for r in rows)


def test_whitening_equals_a_direct_decomposition(spark):
    draw = np.random.default_rng(1)
    held = draw.standard_normal((60, 9)) * np.arange(1, 10)
    rows = [(i, [float(c) for c in row], 0) for i, row in enumerate(held)]
    check_whitening(vectors(spark, rows).repartition(3), list(range(60)), held)
    check_whitening(vectors(spark, rows), list(range(60)), held, components=4)


def test_whitening_drops_rows_and_survives_breakdowns(spark):
    # two dimensions are equal, one is constant, and the spectrum has equal values
    corners = [[a, b, a, 0.5, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    rows = [(i, row, 0) for i, row in enumerate(corners)] + [
        (90, None, 0), (91, [1.0, None, 1.0, 1.0, 1.0], 0), (92, [float("nan")] * 5, 0), (93, [float("inf")] * 5, 0), (94, [float("-inf")] * 5, 0),
    ]
    check_whitening(clashing(vectors(spark, rows)), list(range(8)), corners)
    twice = whitening.whitened(vectors(spark, [*rows[:8], (None, corners[0], 0), (3, corners[3], 0)])).collect()
    assert len(twice) == 30 and sum(r.vec_id is None for r in twice) == 3 and sum(r.vec_id == 3 for r in twice) == 6


def test_whitening_without_variance(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0)])).count() == 0
    assert whitening.whitened(vectors(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [], 0), (2, [], 0)])).count() == 0
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whitened(vectors(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]).repartition(2, "vec_id"))


def test_exact_deviations_of_large_numbers(spark):
    held = [[1e7, 0.0], [-1e7, 3.0], [0.0, 1.0]]
    rows = whitening.whitened(vectors(spark, [(i, row, 0) for i, row in enumerate(held)])).collect()
    x = [[int(np.floor(np.float32(c) * 64.0)) for c in row] for row in held]
    sums = [sum(col) for col in zip(*x, strict=True)]
    assert {r.vec_id: r.deviation for r in rows} == {i: sum((3 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}


# --- repeats of 50 bytes ----------------------------------------------------------


def repeats(rows, width=50):
    first = {}
    for doc, text in rows:
        held = (text or "").encode()
        for i in range(len(held) - width + 1 if doc is not None else 0):
            first[held[i : i + width]] = min(doc, first.get(held[i : i + width], doc))
    out = []
    for doc, text in rows:
        held = (text or "").encode()
        gone = np.zeros(len(held) + 1, bool)
        for i in range(len(held) - width + 1 if doc is not None else 0):
            if first[held[i : i + width]] < doc:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(held, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(held), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return by_key(out)


def removed(df):
    return by_key(suffix_dedup.digests(suffix_dedup.without_repeats(df)).collect())


def test_the_cover_has_every_difference():
    cover = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))


def test_delta_coding_is_an_exact_round_trip():
    for held in ([], [0], [5, 5, 2**63, 2**64 - 1]):
        assert suffix_dedup.decode(suffix_dedup.encode(np.array(held, np.uint64))).tolist() == held


def test_repeats_of_odd_texts(spark, odd, nothing):
    rows = [*ODD, (11, "ab" * 40), (12, "x" + "ab" * 40), (12, "ab" * 40), (13, "a" * 49), (14, "q" * 200), (14, "q" * 200), (15, "é" * 30 + "ab" * 30)]
    rows = [r[:2] for r in rows]
    assert removed(clashing(documents(spark, rows))) == repeats(rows)
    assert removed(nothing) == []
    found = {r.doc_id: r for r in suffix_dedup.without_repeats(documents(spark, [(1, "z" * 60), (2, "u" * 9 + "z" * 60 + "v")])).collect()}
    assert [tuple(x) for x in found[2].spans] == [(9, 69)] and bytes(found[2].kept) == b"u" * 9 + b"v" and found[1].spans == []


@pytest.mark.parametrize("chunk", [1 << 24, 1 << 13])
def test_repeats_do_not_depend_on_chunks_or_order(spark, some, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "LEAST_BUCKETS", 3)
    docs = some.select("doc_id", "text")
    want = repeats([tuple(r) for r in docs.collect()])
    assert sum(r[2] for r in want) > 1000
    assert removed(docs.repartition(3, "text")) == want


# --- alignment --------------------------------------------------------------------


def alignments(rows):
    a_of = Tokenizer.from_file(BYTES)
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    docs = []
    for doc, text in rows:
        groups, n = [], (0, 0)
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            bytes_a = [bytes(letters[c] for c in a_of.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
                n, i, j = (len(a), len(b)), 0, 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
        docs.append((doc, n, groups))
    held = collections.Counter()
    for _, _, groups in docs:
        held.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc, n, groups in docs:
        each = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, *n, len(groups), len(each), sum(held[p] == most[p[0]] for p in each), sum(held[p] for p in each), sha))
    return by_key(out)


STRANGE = [
    *(r[:2] for r in ODD),
    (20, "a▁b"), (21, "</s> <s> <unk>"), (22, "=-" * 300 + "日本語" * 50), (23, "antidisestablishmentarianism" * 9), (24, " leading  spaces "),
]


def test_alignment_of_odd_texts(spark, nothing):
    assert by_key(alignment.link_counts(clashing(documents(spark, STRANGE)), BYTES, PIECES).collect()) == alignments(STRANGE)
    assert alignment.link_counts(nothing, BYTES, PIECES).count() == 0


def test_alignment_of_texts_with_more_links_than_a_block(spark, some, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 60)
    monkeypatch.setattr(alignment, "LONG", 4)
    assert by_key(alignment.link_counts(documents(spark, STRANGE), BYTES, PIECES).collect()) == alignments(STRANGE)
    monkeypatch.setattr(alignment, "LINKS", 5000)
    rows = [tuple(r) for r in some.select("doc_id", "text").collect()]
    assert by_key(alignment.link_counts(some.repartition(3), BYTES, PIECES).collect()) == alignments(rows)


def test_groups_end_where_both_tokenizers_do(spark):
    text = "the cat sat"
    (row,) = alignment.aligned(documents(spark, [(1, text)]), BYTES, PIECES).collect()
    assert [g.end for g in row.groups] == [4, 8, 12] and [len(g.a) for g in row.groups] == [1, 1, 1]


def test_pointer_jumping_labels_long_components():
    # every second end is shared with neither side until the last
    n = 3000
    a, b, groups = alignment.label(np.append(np.arange(2, 2 * n, 2), 2 * n + 1), np.append(np.arange(1, 2 * n, 2), 2 * n + 1))
    assert groups == 1 and not a.any() and not b.any()
    a, b, groups = alignment.label(np.array([2, 3, 7]), np.array([1, 3, 5, 6, 7]))
    assert (a.tolist(), b.tolist(), groups) == ([0, 0, 1], [0, 0, 1, 1, 1], 2)


@pytest.mark.parametrize("top", [3, 50_000, 1 << 24, 1 << 31])
def test_links_are_ordered_like_a_stable_sort(top):
    """Also ids that do not fit in one number with their place."""
    rng = np.random.default_rng(6)
    pair = (rng.integers(0, top, 20_000) << 32) | rng.integers(0, top, 20_000)
    for some in (pair, np.repeat(pair[:50], 3), pair[:1], pair[:0]):
        assert (alignment._order(some) == np.argsort(some, kind="stable")).all()
