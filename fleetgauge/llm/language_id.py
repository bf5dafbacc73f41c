"""Language identification of mixed text.

Words (runs of letters) get a score per language: the log probabilities of their letter trigrams, hashed
into a table learned by counting. The script of a word (by ranges of code points) narrows its languages
to those that were seen to use it. A Viterbi search over the words of a text, with a penalty for each switch,
labels spans; the language whose spans hold the most letters is the language of the text, and its
share of the letters is the score.

Texts that are null or have no letter get `und`, score 0 and no span. Words in a script no language uses take the
language around them. The search runs over all words of a text, whatever its length, step by step over
many texts at once. Repeated rows get equal results. Without anything to learn from, all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.arrays import Flat, groups, mix
from fleetgauge.llm.tables import add_columns

UNKNOWN = "und"
BITS = 16  # of the trigram table
SAMPLE_PER_LANGUAGE = 1500  # texts a language is learned from, about
SWITCH_PENALTY = 12.0  # in nats
LEAST_SHARE = 0.01  # of a language's letters, for a script to be one of its own
FOREIGN = -25.0  # score of a word for a language that does not use its script

# First code points of blocks and their scripts (0: any other letter).
SCRIPT_STARTS = (
    (0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7),
    (0x0980, 8), (0x0A00, 0), (0x0E00, 9), (0x0E80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0),
    (0x20000, 13), (0x30000, 0),
)
N_SCRIPTS = 14


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray  # (2^BITS, languages): log probabilities of trigrams
    uses: np.ndarray  # (N_SCRIPTS, languages): 0, or FOREIGN where the language does not use the script


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case when that is one code point."""
    n = 0x110000
    letter = np.fromiter((chr(k).isalpha() for k in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for k in np.flatnonzero(letter).tolist():
        if len(c := chr(k).lower()) == 1:
            lower[k] = ord(c)
    return letter, lower


class Letters:
    """Words of letters of some texts, with the trigram numbers and the script of each word."""

    def __init__(self, texts: list[str]):
        flat = Flat(texts)
        is_letter, lower = _letters()
        letter = is_letter[flat.codes]
        edge = np.flatnonzero(np.diff(letter, prepend=False))  # each text ends with a line feed
        self.flat, self.starts, self.stops = flat, edge[0::2], edge[1::2]
        self.lengths = self.stops - self.starts
        self.offsets = np.searchsorted(self.starts, np.append(flat.begins, len(flat.codes)))
        low = np.where(letter, lower[flat.codes], 1).astype(np.uint64)
        one = np.concatenate([[1], low[:-1]]).astype(np.uint64)
        two = np.concatenate([[1], one[:-1]]).astype(np.uint64)
        two[one == 1] = 1
        at = np.flatnonzero(letter | (one != 1))
        code = low[at] | one[at] << np.uint64(21) | two[at] << np.uint64(42)
        self.trigrams = (mix(code) >> np.uint64(64 - BITS)).astype(np.int64)
        self.first = np.searchsorted(at, self.starts)
        points = np.array([p for p, _ in SCRIPT_STARTS])
        kinds = np.array([s for _, s in SCRIPT_STARTS])
        self.scripts = kinds[np.searchsorted(points, flat.codes[self.starts], side="right") - 1]


def _sample(df: DataFrame, text: str, lang: str, learn_from: Column, per_language: int, spread: list[str]) -> DataFrame:
    """About `per_language` texts of each language, those with the smallest hashes of `spread` and the text.

    Where `spread` tells the rows of one text apart, a text with very many copies is sampled like any
    others; otherwise its copies come in or stay out together.
    """
    usable = df.where(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.xxhash64(*spread, text).alias("_hash")
    )
    sizes = usable.groupBy("_lang").agg(F.count("*").alias("n")).collect()  # a row per language learned
    if not sizes:
        return usable.drop("_hash")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["_lang"], min(1.0, per_language / r["n"]))])
    place = F.pmod("_hash", F.lit(1 << 20)) / (1 << 20)
    return usable.where(place < share[F.col("_lang")]).drop("_hash")


def fit(
    df: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE,
    spread: tuple[str, ...] = (),
) -> LanguageModel:
    """Counts trigrams and scripts of a bounded sample per language; the counts are added up by Spark.

    `spread`: columns, such as an id, that spread the copies of one text over the sample's hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for name in set(langs.tolist()):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == name]
                total = sums.setdefault(name, np.zeros((1 << BITS) + N_SCRIPTS, np.int64))
                for _, some in groups(mine):
                    found = Letters(some)
                    total[: 1 << BITS] += np.bincount(found.trigrams, minlength=1 << BITS)
                    total[1 << BITS :] += np.bincount(found.scripts, found.lengths, N_SCRIPTS).astype(np.int64)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "at", "n"]
            )

    counted = _sample(df, text, lang, learn_from, per_language, list(spread)).mapInArrow(count, "lang string, at int, n long")
    rows = counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()  # bounded by table and languages
    names = sorted(rows["lang"].unique())
    totals = np.zeros(((1 << BITS) + N_SCRIPTS, len(names)))
    totals[rows["at"].to_numpy(np.int64), [names.index(x) for x in rows["lang"]]] = rows["n"].to_numpy()
    grams, scripts = totals[: 1 << BITS], totals[1 << BITS :]
    table = np.log((grams + 0.2) / (grams.sum(0) + 0.2 * (1 << BITS)))
    used = scripts >= LEAST_SHARE * np.maximum(scripts.sum(0), 1)
    uses = np.where(used | ~used.any(1, keepdims=True), 0.0, FOREIGN)
    mean = table.mean(1, keepdims=True) if names else 0.0
    return LanguageModel(names, (table - mean).astype(np.float32), uses.astype(np.float32))


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. `scores`: (words, labels); texts are the ranges between `offsets`.

    All texts advance together, the longest first, so at each step those not yet ended lead the list.
    """
    n_words, n_labels = scores.shape
    labels = np.zeros(n_words, np.int16)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order) or n_labels < 2:
        return labels
    start, size = offsets[:-1][order], sizes[order]
    back = np.zeros((n_words, n_labels), np.int16)
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t
    best = scores[start]
    own = np.arange(n_labels, dtype=np.int16)
    for t in range(1, size[0]):
        a = alive[t]
        held = best[:a]
        top = held.argmax(1)
        change = held[np.arange(a), top][:, None] - penalty
        stay = held >= change
        at = start[:a] + t
        back[at] = np.where(stay, own, top[:, None])
        best[:a] = np.where(stay, held, change) + scores[at]
    last = best.argmax(1)  # rows keep the sums of their last word
    labels[start + size - 1] = last
    now = last.copy()
    for t in range(size[0] - 1, 0, -1):
        a = alive[t]
        at = start[:a] + t
        ending = size[:a] == t + 1
        now[:a] = np.where(ending, last[:a], now[:a])
        now[:a] = back[at, now[:a]]
        labels[at - 1] = now[:a]
    return labels


def label_texts(texts: list[str | None], model: LanguageModel, penalty: float) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text; spans are code points, end exclusive."""
    for _, some in groups(texts):
        found = Letters(some)
        n = len(some)
        if not len(found.starts) or not model.names:
            yield from [(UNKNOWN, 0.0, [])] * n
            continue
        scores = np.add.reduceat(model.table[found.trigrams], found.first, axis=0)
        scores += model.uses[found.scripts]
        labels = viterbi(scores, found.offsets, penalty)
        text = np.repeat(np.arange(n), np.diff(found.offsets))
        n_labels = len(model.names)
        letters = np.bincount(text * n_labels + labels, found.lengths, n * n_labels).reshape(n, n_labels)
        total, top = letters.sum(1), letters.argmax(1)
        new = np.ones(len(labels), bool)
        new[1:] = (np.diff(labels) != 0) | (np.diff(text) != 0)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(labels)) - 1
        begin = found.flat.begins[text[head]]
        pieces = list(zip(
            (found.starts[head] - begin).tolist(), (found.stops[tail] - begin).tolist(), labels[head].tolist(), strict=True
        ))
        bounds = np.searchsorted(text[head], np.arange(n + 1)).tolist()
        for k in range(n):
            if not total[k]:
                yield UNKNOWN, 0.0, []
                continue
            spans = [{"start": a, "end": b, "lang": model.names[x]} for a, b, x in pieces[bounds[k] : bounds[k + 1]]]
            yield model.names[top[k]], float(letters[k, top[k]] / total[k]), spans


def identify(df: DataFrame, model: LanguageModel, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """`df` with `lang_pred`, `score` and `spans` of every text; only the text is looked at."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # its size is set by BITS and the languages

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        found = list(label_texts(batch.column(text).to_pylist(), sent.value, penalty))
        return {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "spans": [x[2] for x in found]}

    kinds = {"lang_pred": "string", "score": "double", "spans": "array<struct<start: long, end: long, lang: string>>"}
    return add_columns(df, work, kinds, text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is in the fold that nothing is learned from; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def digest(df: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every row of `documents`."""
    model = fit(df, ~held_out(), spread=("doc_id",))
    found = identify(df.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
