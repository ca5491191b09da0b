"""Operators over whole tables, against brute force."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import clashing, documents

from adjrank.llm import hmm, mixing, ngram_join, spotsigs, sums, toxicity, url_rules, warc
from adjrank.llm.components import connected_components, contract, extended
from adjrank.llm.words import blocks, byte_weights

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- n-gram join ---------------------------------------------------------------


def sets_of(text, k):
    words = WORD.findall(lowered(text))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def brute_components(rows, like):
    sets = {i: sets_of(text, like.words) for i, text in rows}
    groups = Groups()
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and like.over * both >= like.under * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return sorted((i, len(sets[i]), groups.find(i)) for i in ids)


def variants(seed, copies, words, changes):
    """Texts that differ in some words each, around the border of likeness."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, words)]
    out = [" ".join(base)]
    for i in range(copies):
        text = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, changes + 1))):
            text[at] = f"x{seed}.{i}.{at}"
        if rng.random() < 0.3:
            text = text[: int(rng.integers(words * 3 // 4, words))]
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("like", [ngram_join.Likeness(), ngram_join.Likeness(under=80, words=5), ngram_join.Likeness(under=50, words=2)])
def test_components_equal_brute_force(spark, like):
    texts = [x for seed in range(6) for x in variants(seed, 25, 30 + 15 * seed, 6)]
    rows = list(enumerate(texts)) + [(1000, texts[0]), (1001, texts[30].upper()), (1002, None), (1003, ""), (1004, "a b"), (1005, "A  B")]
    found = ngram_join.components(clashing(documents(spark, rows)), like=like).collect()
    assert sorted(map(tuple, found)) == brute_components(rows, like)


def test_cut_columns_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMN", 5)
    texts = [x for seed in range(3) for x in variants(seed, 40, 60, 5)]
    rows = list(enumerate(texts))
    found = ngram_join.components(documents(spark, rows)).collect()
    assert sorted(map(tuple, found)) == brute_components(rows, ngram_join.Likeness())


def test_components_of_odd_rows(spark, odd, nothing):
    found = sorted(map(tuple, ngram_join.components(clashing(odd)).collect()), key=str)
    by_id = {i: (n, c) for i, n, c in found}
    assert len(found) == odd.count()
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[4] == by_id[5] == by_id[-3] == (16, -3)
    assert by_id[7] == (1, 7) and by_id[8] == (1, 8) and by_id[None] == (6, None)
    assert ngram_join.components(nothing).count() == 0


def test_representatives(spark, odd, nothing):
    kept = ngram_join.representatives(clashing(odd))
    assert kept.columns == clashing(odd).columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(map(str, [1, 2, 3, -3, 6, 7, 8, None, 9]))
    assert ngram_join.representatives(nothing).count() == 0


def test_representatives_keep_all_rows_without_shingles(spark):
    empty = [(None, ""), (None, None), (None, " "), (4, ""), (4, "\n")]
    copies = [(9, "the same words here again")] * 2
    found = ngram_join.representatives(documents(spark, empty + copies)).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(empty + copies[:1], key=str)


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(50)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: groups.find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_extended_by_further_edges(spark):
    rng = np.random.default_rng(4)
    first = [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))]
    # between components, within one, to new and to smaller nodes, a loop and a null
    more = [(int(a), int(b)) for a, b in rng.integers(0, 500, (60, 2))] + [first[0], (7, 7), (None, 3), (900, 901)]
    groups = Groups()
    for a, b in [*first, *((a, b) for a, b in more if a is not None)]:
        groups.join(a, b)
    kind = "a bigint, b bigint"
    for known, added in ((first, more), ([], first + more), (first + more, [])):
        joined = extended(connected_components(spark.createDataFrame(known, kind)), spark.createDataFrame(added, kind))
        found = [(r.node, r.component) for r in joined.collect()]
        assert sorted(found) == sorted({(x, groups.find(x)) for a, b in [*first, *more] if a is not None and a != b for x in (a, b)})


def test_sums_take_no_job_for_each_slice(spark):
    counts = np.arange(40 * sums.SLICE, dtype=np.uint32)
    rows = sums.count_slices(counts).to_pylist() * 2
    partial = spark.createDataFrame([(r["at"], bytearray(r["cells"])) for r in rows], sums.SCHEMA)
    spark.sparkContext.setJobGroup("slices", "sums")
    try:
        assert (sums.summed_counts(partial, len(counts), 2**32 - 1) == 2 * counts).all()
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("slices"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 20


@pytest.mark.parametrize("order", ["ascending", "mixed"])
def test_components_of_a_long_path_take_few_rounds(spark, order):
    names = list(range(5000))
    if order == "mixed":
        np.random.default_rng(2).shuffle(names)
    path = [(int(a), int(b)) for a, b in zip(names, names[1:], strict=False)]
    rounds = contract(spark.createDataFrame(path, "a bigint, b bigint"))
    assert len(rounds) <= 20 and rounds[-1].where("to <> 0").isEmpty()


def test_counts_are_an_exact_round_trip():
    for counts in ([0] * 70000, [0] * 69999 + [7], list(range(70000)), [2**32 - 1] + [0] * 10, [1] * 10):
        held = np.array(counts, np.uint32)
        out = np.zeros(len(held), np.uint64)
        for at, cells in zip(*(x.to_pylist() for x in sums.count_slices(held).columns), strict=True):
            found = sums.counted(cells)
            out[at * sums.SLICE : at * sums.SLICE + len(found)] = found
        assert (out == held).all()


# --- fingerprints --------------------------------------------------------------


def chains(text):
    """Signatures as sets of strings."""
    tokens, run, out = re.sub(r"[\W_]+", " ", (text or "").lower()).split(), [], []
    last = len(tokens) - 1
    glued = []
    for i, word in enumerate(tokens):
        run.append(word)
        if word not in spotsigs.ANCHORS or i == last:
            glued.append(run)
            run = []
    for a, b in zip(glued, glued[1:], strict=False):
        if len(a) > 1:
            out.append(" ".join((*a, b[-1])))
    return set(out) or ({" ".join(tokens)} if tokens else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edited(rows, found):
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        row, text, after = found[i], text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row.fingerprint) == 8 * len(chains(text))
        assert row.near_edited == pytest.approx(jaccard(chains(text), chains(edited)))
        assert row.near_next == pytest.approx(jaccard(chains(text), chains(after)))


def test_edited_fingerprints(spark, some):
    rows = [(r.doc_id, r.text) for r in some.collect()] + [(1 << 40, "the end of a text is here"), (-5, None), (-9, "")]
    check_edited(rows, {r.doc_id: r for r in spotsigs.edited_fingerprints(clashing(documents(spark, rows))).collect()})


def test_uneven_keys_have_the_same_order(spark, some, monkeypatch):
    monkeypatch.setattr(spotsigs, "UNEVEN", 1)
    rows = [(r.doc_id * r.doc_id, r.text) for r in some.collect()] + [(1 << 60, "alone the far away")]
    assert "_offset" in str(spotsigs.bucketed(documents(spark, rows).selectExpr("doc_id key", "text"), 4)._jdf.queryExecution().optimizedPlan())
    check_edited(rows, {r.doc_id: r for r in spotsigs.edited_fingerprints(documents(spark, rows)).collect()})


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    found = spotsigs.edited_fingerprints(clashing(odd)).collect()
    by_text = {}
    assert len(found) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert spotsigs.edited_fingerprints(nothing).count() == 0
    one = spotsigs.edited_fingerprints(documents(spark, [(3, "the dog of the house")])).first()
    assert one.n_chars == 20 and one.near_next == 1.0


def test_signature_near_duplicates_equal_brute_force(spark, some):
    rows = [(r.doc_id, r.text) for r in some.collect()]
    rows += [(1000 + i, re.sub(r"\bw(\d*[05])\b", r"the w\1", x)) for s in range(2) for i, x in enumerate(variants(s, 15, 200, 6), 100 * s)]
    members, pairs = spotsigs.near_duplicates(documents(spark, rows), threshold=0.8)
    of = {r.doc_id: r["class"] for r in members.collect()}
    found = {frozenset((r.a, r.b)) for r in pairs.collect()}
    sets = {i: chains(text) for i, text in rows}
    expected = {frozenset((of[a], of[b])) for a in of for b in of if a < b and of[a] != of[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert found == expected and expected


# --- URL rules -----------------------------------------------------------------

URLS = [
    None, "", "no scheme.org/", "http://Example.ORG/es/1", "https://a.b.example.org/en/1234?x#y", "http://example.org/en/2", "http://notexample.org/es/",
    "http://x.com/fr/a", "http://x.com/de/a", "http://x.com?/fr/", "http://com/fr/", "http://x.com#/fr/", "http://x.net/ads/1", "http://x.net/", "http://x.org",
    "http://x.org/", "://y.com/de/", "ftp://q://z.com/de/", "http:///de/", "http://x.net/.example.org/es/", "http://ads.x.net/a\nb/ads/", "HTTP://EXAMPLE.com/DE/",
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lowered(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    own = "block" if any(x in path for x in ("/ads/", "/tracking/")) and host else "allow"
    return host, path, best and best[0] + best[1], best[2] if best else own


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, host string, rule string")
    found = url_rules.judge(pages, [url_rules.Rule(*r) for r in RULES]).collect()
    assert sorted(map(tuple, found)) == [(i, *brute_judge(u)) for i, u in enumerate([*URLS, *URLS])]
    assert url_rules.judge(pages.where("false"), [url_rules.Rule(*r) for r in RULES]).count() == 0


def test_rules_are_found_by_their_rarest_token():
    rules = [url_rules.Rule("example.org", "/es/", "block"), url_rules.Rule("*", "*", "allow"), url_rules.Rule("a.b", "/x*y/z/w", "block")]
    index = url_rules.Index(rules, {"host:example": 5, "host:org": 50, "path:es": 9})
    assert set(index.by_token) == {"host:example", "host:a"} and len(index.always) == 1
    assert index.best("q.a.b", "/x1y/z/w2").name == "a.b/x*y/z/w" and index.best("q.a.b", "/x1y/w2").name == "**"


# --- WARC ----------------------------------------------------------------------

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/ c", "<p>one</p>"), (3, None, "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://d/\r\nX: y", None), (5, "e", ""),
    (6, "f", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb"), (7, "g", "ünï \U0001f600" * 5000), (None, "h", "<p>one</p>"), (None, "i", "only null"), (8, "j", "x"), (8, "k", "y"),
]


def brute_revisits(pages, least):
    largest = {}
    for i, _, html in pages:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = largest.get(html or "") if len(data) >= least else i
        revisit = top is not None and top != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,frequent", [(0, 1000), (4, 1000), (0, 6)])
def test_archives(spark, tmp_path, monkeypatch, least, frequent):
    monkeypatch.setattr(warc.resolve_revisits, "__defaults__", (0, frequent))
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id bigint, url string, html string, key string, payload string")
    warc.archive(pages.repartition(3), str(tmp_path / "w"), least_bytes=least)
    records = warc.read_archives(spark, str(tmp_path / "w")).collect()
    key = lambda x: int(k) if x and (k := re.match(r"<urn:page:(-?\d*):", x).group(1)) else None
    found = [(key(r.record_id), r.payload_bytes, r.payload_digest[5:], r.type, key(r.refers_to)) for r in records]
    assert sorted(found, key=str) == brute_revisits(PAGES, least)
    for r in records:
        assert r.type == "revisit" or bytes(r.payload) in {(p[2] or "").encode() for p in PAGES}


def test_empty_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.archive(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


# --- mixing --------------------------------------------------------------------


def brute_targets(sizes):
    """By source: targets, by reassigning the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * sizes[s] < weight[s] * level}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def test_mix(spark, some, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)  # several levels of running sums
    rows = [(r.doc_id, r.text, ("src", "Ünï", "a", None, "z")[r.doc_id * r.doc_id % 5]) for r in some.collect()]
    rows += [(500, None, "a"), (501, "", "empty"), (502, "x y z", "tiny"), (502, "x y z", "tiny"), (None, "q " * 300, "z")]
    docs = clashing(documents(spark, rows))
    found = sorted((tuple(r) for r in mixing.Mix(docs).taken().collect()), key=str)
    again = sorted((tuple(r) for r in mixing.Mix(docs.repartition(5)).taken().collect()), key=str)
    assert found == again
    count = lambda x: len(WORD.findall(x or ""))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += count(text)
    wanted = brute_targets(dict(sizes))
    got = Counter()
    source_of = {(i, count(text)): source for i, text, source in rows}
    assert len(found) == len(rows)
    for i, size, source_size, target, taken in found:
        source = source_of[i, size]
        assert source_size == sizes[source] and target == pytest.approx(wanted[source]) and 0 <= taken <= 2 * size
        got[source] += taken
    for source, target in wanted.items():
        assert abs(got[source] - target) <= max(64, 0.01 * target)


def test_slots_are_a_permutation(spark, some):
    rows = [(r.doc_id, r.text, f"s{r.doc_id % 3}") for r in some.collect()]
    mix = mixing.Mix(documents(spark, rows))
    times = Counter((r.place, r.block) for r in mix.slots().collect())
    sources = {r.place: r for r in mix.sources.collect()}
    assert sum(times.values()) == mix.total
    for place, source in sources.items():
        own = [times[place, b] for b in range(source.blocks)]
        assert sum(own) == source.slots and max(own) - min(own) <= 1


def test_mixed_documents(spark, some, nothing):
    rows = [(r.doc_id, r.text, f"s{r.doc_id % 4}") for r in some.collect()] + [(7, "x y", "s1"), (7, "x y", "s1"), (8, None, None)]
    docs = clashing(documents(spark, rows))
    mix = mixing.Mix(docs)
    out = mix.documents(docs)
    assert out.schema.names == docs.schema.names
    texts = out.collect()
    taken = Counter()
    for r in texts:
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    wanted = Counter()
    for r in mix.taken().collect():
        wanted[r.key] += r.taken
    assert taken == Counter({k: v for k, v in wanted.items() if v})
    assert mixing.Mix(nothing).taken().count() == 0 and mixing.Mix(nothing).documents(nothing).count() == 0


# --- language model ------------------------------------------------------------

SMALL = hmm.Settings(states=3, symbols=200, known=400, classes=32, iterations=6)


def test_base_scores(spark, some, odd, nothing):
    rows = [(r.doc_id, r.text) for r in some.collect()] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 7]
    found = hmm.score(clashing(documents(spark, rows)), settings=SMALL).collect()
    split = lambda x: [*WORD.findall(lowered(x)), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, x in rows if not out(i) for w in split(x))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, x in rows:
        words = split(x)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        expected.append((str(i), out(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted(expected)
    # the chain tells languages apart, so it finds held-out texts likelier than the base
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score(nothing, settings=SMALL).count() == 0


def test_forward_is_exact_and_training_climbs():
    rng = np.random.default_rng(3)
    texts = sorted((rng.integers(0, 5, n) for n in (1, 2, 3, 5, 6)), key=len, reverse=True)
    model = hmm.Model.first(5, 3, np.ones(5))
    for _ in range(5):
        likelihood = model.forward(texts)
        for text, found in zip(texts, likelihood, strict=True):
            paths = np.array(np.meshgrid(*[range(3)] * len(text))).reshape(len(text), -1).T
            total = sum(
                model.start[p[0]] * np.prod(model.emit[text, p]) * np.prod(model.move[p[:-1], p[1:]]) for p in paths
            )
            assert found == pytest.approx(math.log(total))
        counts, summed = model.expected(texts)
        assert summed == pytest.approx(likelihood.sum())
        assert counts[:3].sum() == pytest.approx(len(texts)) and counts[12:].sum() == pytest.approx(sum(map(len, texts)))
        start, move, emit = np.split(counts, [3, 12])
        move, emit = move.reshape(3, 3) + 1e-12, emit.reshape(5, 3) + 1e-12
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        assert model.forward(texts).sum() >= likelihood.sum() - 1e-9


def test_training_reads_all_texts_and_settles(spark):
    """The last model is that of plain Baum-Welch over all texts, whatever partitions they are in."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 3, n) + 3 * int(rng.integers(2)) for n in rng.integers(1, 30, 300)]
    rows = [(bytearray(x.astype(np.uint16).tobytes()), False) for x in texts] + [(bytearray(np.full(9, 1, np.uint16).tobytes()), True)]
    encoded = spark.createDataFrame(rows, "symbols binary, held_out boolean").repartition(5)
    seen = np.bincount(np.concatenate(texts), minlength=6)
    found, likelihoods = hmm.train(encoded, seen, hmm.Settings(states=2, symbols=4, classes=1, iterations=40, settled=1e-4))
    assert np.all(np.diff(likelihoods) > -1e-3) and 2 < len(likelihoods) < 40
    model, ordered = hmm.Model.first(6, 2, seen), sorted(texts, key=len, reverse=True)
    for mean in likelihoods:
        counts, total = model.expected(ordered)
        assert total / seen.sum() == pytest.approx(mean)
        model = hmm.Model.of_counts(counts, 6, 2)
    assert found.emit == pytest.approx(model.emit) and found.move == pytest.approx(model.move)


def test_whole_scores_by_enumeration(spark):
    """The score of ``score`` equals the sum over all state paths times the words' shares of their symbols."""
    size = hmm.Settings(states=2, symbols=3, known=4, classes=2, iterations=3)
    rows = [(i, x) for i, x in enumerate(["a b a", "b c dd", "", "a ee ff", "a", "zz a", "b b c gg", "c ee a", "new a"])]
    docs = documents(spark, rows)
    found = {r.doc_id: r.score for r in hmm.score(docs, settings=size).collect()}
    coded = docs.selectExpr("doc_id key", "text", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 held_out")
    counts = spark.createDataFrame(hmm.count_words(coded, size.classes).collect())
    vocabulary, end = hmm.vocabulary(counts, size)
    encoded = spark.createDataFrame(hmm.encode(coded, spark.sparkContext.broadcast(vocabulary), end).collect())
    model, _ = hmm.train(encoded, vocabulary.seen(end), size)
    times = {r.word: r.n for r in counts.collect()}
    own = {h: s for h, s in zip(vocabulary.hashes.view(np.int64).tolist(), vocabulary.symbol.tolist(), strict=True) if s >= 0}
    weights = byte_weights(True)
    for i, text in rows:
        symbols, share = [], 1.0
        for block in blocks(pa.array([text])):
            starts, ends = block.words()
            for h, kind in zip(block.hashes(starts, ends, weights).view(np.int64).tolist(), hmm.word_classes(block, starts, ends, weights, 2), strict=True):
                symbols.append(own.get(h, 3 + int(kind)))
                if h not in own:
                    share *= (times.get(h, 0) + 0.5) / (vocabulary.class_tokens[kind] + 0.5 * (vocabulary.class_words[kind] + 1))
        symbols.append(5)
        total = 0.0
        for path in itertools.product(range(2), repeat=len(symbols)):
            p = model.start[path[0]] * model.emit[symbols[0], path[0]]
            for before, now, symbol in zip(path[:-1], path[1:], symbols[1:], strict=True):
                p *= model.move[before, now] * model.emit[symbol, now]
            total += p
        assert found[i] == pytest.approx(math.log10(total * share), abs=1e-9)


def test_shares_of_a_class_and_its_unknown_words_sum_to_one(spark, some):
    rows = some.selectExpr("doc_id key", "text", "false held_out")
    counts = hmm.count_words(rows, SMALL.classes).collect()
    vocabulary, end = hmm.vocabulary(spark.createDataFrame(counts), SMALL)
    assert end == some.count() and vocabulary.tokens == sum(r.n for r in counts) and vocabulary.words == len(counts)
    symbols = {h for h, s in zip(vocabulary.hashes.view(np.int64).tolist(), vocabulary.symbol, strict=True) if s >= 0}
    share = Counter()
    for r in counts:
        if r["class"] >= 0 and r.word not in symbols:
            share[r["class"]] += (r.n + 0.5) / 10 ** vocabulary.share_divisors()[r["class"]]
    for kind, known in share.items():
        assert known + 0.5 / 10 ** vocabulary.share_divisors()[kind] == pytest.approx(1)


# --- toxicity ------------------------------------------------------------------

QUICK = toxicity.Settings(positives=60, negatives=120, updates=60)


def toxic_corpus(spark, n=260):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.zipf(1.4, int(rng.integers(5, 150))) % 500]
        toxic = int(i % 4 == 0)
        for at in rng.integers(0, len(words) + 1, 2 if toxic else 0):
            words.insert(at, ("vile", "Rotten", "foul!")[int(rng.integers(3))])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, "x"))
    return rows, spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")


def test_toxicity_of_held_out_texts(spark, odd, nothing):
    rows, labels = toxic_corpus(spark)
    docs = clashing(documents(spark, rows).unionByName(odd.withColumn("doc_id", odd.doc_id + 100_000)))
    found = toxicity.score(docs, labels, settings=QUICK).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 1000]
    assert len(held) > 30 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(r.predicted == 0 for r in found if r.doc_id in (100_001, 100_002, 100_003))
    kept = toxicity.clean(docs, docs, labels, settings=QUICK)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}
    assert toxicity.score(nothing, labels, settings=QUICK).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0"), settings=QUICK).collect()} == {0.0}


@pytest.mark.parametrize("batches", [30, 70])
def test_large_samples_are_trained_in_as_many_passes(monkeypatch, batches):
    looks, logits = [], toxicity.Network.logits

    def seen(self, words, only=None, *more):
        looks.append(only is None)
        return logits(self, words, only, *more)

    monkeypatch.setattr(toxicity.Network, "logits", seen)
    texts = ["good words", "bad words"] * (24 * batches)
    toxicity.fit(texts, np.tile([0, 1], 24 * batches).astype(np.float32), toxicity.Settings(window=4, hidden=2, trigrams=64))
    whole = np.array(looks).reshape(-1, batches).all(1)
    assert len(whole) == 12 and whole[-2:].all() and whole.sum() >= 6


def test_gradients():
    import pyarrow as pa

    s = toxicity.Settings(window=6, word=3, char=2, hidden=2, trigrams=16)
    weights = byte_weights(True)
    words = toxicity.Words(next(blocks(pa.array(["a bb c a dd e ff g h i", "bb c", "z a"]))), weights, s.trigrams)
    net = toxicity.Network(s, words.hashes[::2].copy(), np.linspace(-1, 1, len(words.hashes[::2])).astype(np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    row, first, size = toxicity.windows(np.diff(words.bounds), s.window)
    y = np.arange(len(row)) % 2

    def loss():
        z = net.logits(words)[0].astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    found = net.gradients(words, (row, first, size), y)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for at in range(0, flat.size, max(1, flat.size // 7)):
            held = flat[at]
            flat[at] = held + 1e-2
            up = loss()
            flat[at] = held - 1e-2
            down = loss()
            flat[at] = held
            assert found[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-2, abs=2e-3), name


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 9, 20, 31])
def test_windows_overlap_and_cover(n):
    row, first, size = toxicity.windows(np.array([n]), 6)
    assert set(range(n)) == {i for f, s in zip(first, size, strict=True) for i in range(f, f + s)}
    assert all(b - a == 3 for a, b in zip(first, first[1:], strict=False)) and (n == 0 or (size > 0).all())
