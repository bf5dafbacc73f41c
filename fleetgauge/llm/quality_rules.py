"""Repetition coverage: how much of a text lies inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths, computed over a whole batch of texts at once, mark the
windows that occur twice or more in their text; the code points of the words they cover, first
occurrence included, are measured against all code points in words. Lines are measured likewise.

Words are runs of anything but `\\x20` and `\\x09-\\x0D`. Null and empty texts have no words, so
they fail the base rule. Repeated rows get equal results. Further columns are kept unless their
names are those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.arrays import Flat, covered, groups, mix, repeated, rolling, windows
from fleetgauge.llm.tables import add_columns

SYMBOLS = "#*$%&|<>"  # fixed value
MIN_WORDS = 10  # fixed value
MAX_REPEAT_PERCENT = 20  # fixed value


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest percentages of the code points in words.

    `grams`: (words in a window, percent inside windows that occur twice or more);
    `lines`: percent inside lines equal to another line of the text, first one included.
    """

    grams: tuple[tuple[int, int], ...] = ((5, 20), (7, 17), (10, 15))
    lines: int = 30


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return hashes ^ mix(text.astype(np.uint64) + np.uint64(0x1234567))


def measure(texts: list[str | None], grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts per text: COUNTS, `line_chars`, and `gram_<n>` code points covered for each length."""
    parts = []
    for _, some in groups(texts):
        flat = Flat(some)
        lengths = flat.stops - flat.starts
        text = flat.text_of_word()
        hashes = flat.word_hashes()
        out = {"n_words": flat.counts, "word_chars": flat.per_text_words(lengths)}
        symbol = np.isin(flat.codes, np.array([ord(c) for c in SYMBOLS], np.uint32))
        out["n_symbols"] = flat.per_text(symbol)
        for n in dict.fromkeys((5, *grams)):
            first, keys = windows(hashes, flat.word_offsets, n)
            again = first[repeated(_keyed(keys, text[first]))]
            inside = covered(again, n, len(hashes))
            if n == 5:
                out["n_repeat_words"] = flat.per_text_words(inside)
            out[f"gram_{n}"] = flat.per_text_words(np.where(inside, lengths, 0))
        out |= _lines(flat, lengths)
        parts.append(out)
    names = [*COUNTS, "line_chars", *(f"gram_{n}" for n in grams)]
    return {k: np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int64) for k in names}


def _lines(flat: Flat, lengths: np.ndarray) -> dict[str, np.ndarray]:
    stop = np.flatnonzero(flat.codes == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    at = np.searchsorted(flat.starts, np.append(start, len(flat.codes)))
    total = np.concatenate([[0], np.cumsum(lengths)])
    chars = total[at[1:]] - total[at[:-1]]
    full = np.flatnonzero(chars > 0)
    start, stop, chars = start[full], stop[full], chars[full]
    text = np.searchsorted(flat.ends, start, side="right")
    keys = _keyed(mix(rolling(flat.prefix, start, stop)), text)
    seen = np.ones(len(keys), bool)
    seen[np.unique(keys, return_index=True)[1]] = False  # the first of each is no repeat
    double = np.where(repeated(keys), chars, 0)
    sums = lambda v: np.bincount(text, v, flat.n_texts).astype(np.int64)
    return {"n_dup_lines": sums(seen), "line_chars": sums(double)}


def judge(m: dict[str, np.ndarray], limits: RepetitionLimits) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of measured texts; whole numbers only, so no rounding decides."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    kept = ~failed
    for n, percent in limits.grams:
        kept &= 100 * m[f"gram_{n}"] <= percent * m["word_chars"]
    kept &= 100 * m["line_chars"] <= limits.lines * m["word_chars"]
    return failed, kept


def repetition(df: DataFrame, text: str = "text", limits: RepetitionLimits | None = None) -> DataFrame:
    """`df` with the counts, the covered code points, `base_failed` and `kept` for every text."""
    limits = limits or RepetitionLimits()
    grams = tuple(n for n, _ in limits.grams)
    kinds = {c: "long" for c in (*COUNTS, "line_chars", *(f"gram_{n}" for n in grams))}

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        found = measure(batch.column(text).to_pylist(), grams)
        failed, kept = judge(found, limits)
        return found | {"base_failed": failed, "kept": kept}

    return add_columns(df, work, kinds | {"base_failed": "boolean", "kept": "boolean"}, text)


def digest(df: DataFrame) -> DataFrame:
    """`doc_id`, the base counts, the verdicts and the covered code points of `documents`."""
    return repetition(df.select("doc_id", "text")).drop("text")


def keep_good(df: DataFrame, text: str = "text", limits: RepetitionLimits | None = None) -> DataFrame:
    """The rows whose text is kept, as they are."""
    limits = limits or RepetitionLimits()
    grams = tuple(n for n, _ in limits.grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(measure(batch.column(text).to_pylist(), grams), limits)[1]))

    return df.mapInArrow(run, df.schema)
