"""Quality rules: lines first, then documents.

Each line is judged by itself: its punctuation, whether it is navigation, and
whether it is boilerplate. Failing lines are removed, and a document that
loses too large a part of its words is rejected. Counts of the whole text that
need no line rules are returned as well.

Nulls count as empty texts; they have no words and are rejected. Rows keep
their other columns, repeated rows are judged alike, an empty table gives an
empty one. Every row is judged in the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjrank.llm.words import Block, blocks, byte_weights, code_points, repeats, total, windows

#: Fixed by the definition of the symbol count.
SYMBOLS = b"#*$%&|<>"
#: Byte that may end a line, before closing quotes and brackets.
TERMINALS = b".!?:;"
CLOSERS = b"\"')]}"
#: Between the entries of menus and breadcrumbs.
SEPARATORS = b"|>"
#: A short line that has little else says nothing of its own.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "sign up",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    min_words, max_repeat_pct  a text below or above them fails as a whole
    max_symbol_ratio           symbols and exclamation marks for each word of a good line
    max_separator_ratio        menu separators for each word of a good line
    short_line                 words up to which a line may be boilerplate
    phrase_share               part of such a line's words that boilerplate phrases hold at least
    unpunctuated               words from which a line needs one that ends a sentence
    max_lost                   part of a document's words that removed lines may hold
    """

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_ratio: float = 0.25
    max_separator_ratio: float = 0.2
    short_line: int = 25
    phrase_share: float = 0.25
    unpunctuated: int = 4
    max_lost: float = 0.5


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _marks(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[data]


def _between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[ends] - sums[starts]


def _ends_well(block: Block, ends: np.ndarray) -> np.ndarray:
    """Whether the word that ends at each position ends with a terminal, closing marks aside."""
    well = np.zeros(len(ends), bool)
    at = ends - 1
    closer, final = _marks(block.data, CLOSERS), _marks(block.data, TERMINALS)
    for _ in range(3):
        # "…" and closing typographic quotes are three bytes that begin with E2 80
        quote = (at >= 2) & (block.data[np.maximum(at - 2, 0)] == 0xE2) & (block.data[np.maximum(at - 1, 0)] == 0x80)
        well |= final[at] | (quote & (block.data[at] == 0xA6))
        at = np.where(closer[at], at - 1, np.where(quote, at - 3, at))
        at = np.maximum(at, 0)
    return well


def _letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte is of a letter or digit; of others than ASCII, only general punctuation and Latin-1 signs aren't."""
    table = np.zeros(256, bool)
    table[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")] = True
    table[128:] = True
    out = table[data]
    follow = np.append(data[1:], 0)
    general = np.flatnonzero((data == 0xE2) & ((follow == 0x80) | (follow == 0x81)))
    latin = np.flatnonzero((data == 0xC2) & ~np.isin(follow, (0xAA, 0xB5, 0xBA)))
    out[np.concatenate([general, general + 1, general + 2, latin, latin + 1])] = False
    return out


def phrase_words(block: Block, line_a: np.ndarray, line_b: np.ndarray) -> np.ndarray:
    """Words of each line that are in boilerplate phrases, which stand between word borders."""
    out, letters = np.zeros(len(line_a), np.int64), _letters(block.data)
    lowered = block.data.tobytes().lower()
    for phrase in BOILERPLATE:
        at, where = lowered.find(phrase.encode()), []
        while at >= 0:
            where.append(at)
            at = lowered.find(phrase.encode(), at + 1)
        a = np.array(where, np.int64)
        b, line = a + len(phrase), np.searchsorted(line_a, a, side="right") - 1
        a, b, line = (x[(line >= 0) & (b <= line_b[line])] for x in (a, b, line)) if len(line_a) else (a[:0],) * 3
        left = (a == line_a[line]) | ~letters[a - 1]
        right = (b == line_b[line]) | ~letters[np.minimum(b, len(letters) - 1)]
        np.add.at(out, line[left & right], len(phrase.split()))
    return out


def judge(block: Block, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and verdict of each text, and the byte ranges of the lines to keep."""
    data = block.data
    starts, ends = block.words()
    bounds = block.bounds(starts)
    n_words = np.diff(bounds)
    plain = byte_weights(False)
    plain[[32, 9, 10, 11, 12, 13]] = plain[[32, 9, 10, 11, 12, 13]] + np.arange(3, 9, dtype=np.uint64)
    out = {
        "n_words": n_words,
        "word_chars": total(_between(code_points(data), starts, ends), bounds),
        "n_symbols": total(_marks(data, SYMBOLS), block.offsets),
    }
    # lines that hold a word
    line_a, line_b = block.runs(data != 10) if len(data) else (starts, ends)
    in_line = np.searchsorted(starts, line_b) - (first_word := np.searchsorted(starts, line_a))
    line_a, line_b, first_word, in_line = (x[in_line > 0] for x in (line_a, line_b, first_word, in_line))
    line_row = block.rows_of(line_a)
    _, later = repeats(line_row, block.hashes(line_a, line_b, plain))
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=block.rows)
    # words in repeated windows
    rows, begins, found = windows(block.hashes(starts, ends, byte_weights(False)), n_words, 3)
    twice, _ = repeats(rows, found)
    covered = np.zeros(len(starts) + 2, bool)
    for j in range(3):
        covered[begins[twice] + j] = True
    out["n_repeat_words"] = total(covered[: len(starts)], bounds)
    # line rules
    marks = _between(_marks(data, SYMBOLS + b"!"), line_a, line_b)
    separators = _between(_marks(data, SEPARATORS), line_a, line_b)
    sentences = _between(_ends_well(block, ends), first_word, first_word + in_line)
    bad = (in_line >= rules.unpunctuated) & (sentences == 0)
    bad |= marks > np.maximum(1, rules.max_symbol_ratio * in_line)
    bad |= separators > np.maximum(1, rules.max_separator_ratio * in_line)
    held = phrase_words(block, line_a, line_b)
    bad |= (held > 0) & (in_line <= rules.short_line) & (held >= rules.phrase_share * in_line)
    lost = np.bincount(line_row, weights=np.where(bad, in_line, 0), minlength=block.rows)
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_pct * n_words)
    out["lost_words"] = lost.astype(np.int64)
    out["kept"] = ~out["base_failed"] & (lost <= rules.max_lost * n_words)
    out["lines"] = (line_row, line_a, line_b, bad)
    return out


VERDICT = (
    [T.StructField(name, T.LongType()) for name in (*COUNTS, "lost_words")]
    + [T.StructField(name, T.BooleanType()) for name in ("base_failed", "kept")]
)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``key``, the counts of the text, words in removed lines, and both verdicts, for each row."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for block in blocks(batch.column(1)):
                found = judge(block, rules)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(block.first, block.rows), *(pa.array(found[x.name]) for x in VERDICT)],
                    ["key", *(x.name for x in VERDICT)],
                )

    schema = T.StructType([T.StructField("key", narrow.schema["key"].dataType), *VERDICT])
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def clean(docs: DataFrame, text: str = "text", chars: str = "n_chars", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents that pass, without their failing lines; ``chars`` follows the new text.

    A text none of whose lines fails stays as it is, white space included.
    """
    at, count_at = docs.columns.index(text), docs.columns.index(chars) if chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                found = judge(block, rules)
                row, a, b, bad = found["lines"]
                part = batch.slice(block.first, block.rows)
                texts = part.column(at).to_pylist()
                for r in np.unique(row[bad]):
                    if found["kept"][r]:
                        good = (row == r) & ~bad
                        texts[r] = b"\n".join(block.bytes_of(i, j) for i, j in zip(a[good], b[good], strict=True)).decode()
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if count_at is not None:
                    sizes = [None if x is None else len(x) for x in texts]
                    columns[count_at] = pa.array(sizes, part.schema.field(count_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)
