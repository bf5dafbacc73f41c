"""Quality classifier by co-training two views of a document.

Content view: hashed words and the make-up of the text (cases, digits, symbols, repeats, word lengths).
Metadata view: source, language, length and the layout of lines. Each view has a logistic classifier. In
every round each classifier labels all documents without a label, and those it is surest of become training data of
the other one. A part of the labels is kept aside: on it each view is calibrated, and the two calibrated log
odds are combined by a last logistic fit. All documents are then scored by both views.

The fit uses at most `labelled` labelled documents, those of the smallest hashes, at least half of that room open to
either class. In each of the `ROUNDS` rounds Spark scores every document, and of those without a label each view passes on
the `PASSED_ON` surest of either kind (twice, three times as many in later rounds), if sure enough (`SURE`). So the
driver holds the features of a bounded number of rows, chosen out of the whole table. Both classes are dealt into
the part kept aside, and there each counts as often as it stands among all labels of documents. Scoring covers
every row and the whole of every text.

Null texts count as empty. Labels that are null are left out; an id with several labels takes the majority,
good among equals; labels of ids that are not in the documents are left out. With fewer than two labels of either
kind (one to fit on, one kept aside) every document gets the share of good ones (1 without any).
Of an id with several rows the one with the smallest hash is fitted as labelled; among rows without a label each
different one may be passed on. Ties go by hashes, so the fit does not hang on how rows are partitioned. Repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.arrays import Flat, groups, mix, repeated
from fleetgauge.llm.tables import add_columns
from fleetgauge.session import written

LABELLED = 4000
ROUNDS = 3
SURE = 0.97  # calibrated probability from which a pseudo-label is passed on
PASSED_ON = 400  # most pseudo-labels of either kind a view gives away in a round
ASIDE = 4  # every 4th label of a class is kept for calibration

WORD_BITS = 12
SOURCE_BITS, LANG_BITS = 8, 6
CONTENT_SHAPE = ("bias", "upper", "digits", "symbols", "bars", "repeats", "word_length", "distinct")
META_SHAPE = ("bias", "length", "length2", "lines", "line_length", "short_lines", "stops")
N_CONTENT = (1 << WORD_BITS) + len(CONTENT_SHAPE)
N_META = (1 << SOURCE_BITS) + (1 << LANG_BITS) + len(META_SHAPE)


@dataclass
class Sparse:
    """Rows of (column, value) lists."""

    n: int
    row: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], size)

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        return Sparse(len(rows), place[self.row[keep]], self.col[keep], self.val[keep])

    @staticmethod
    def stack(parts: list[Sparse]) -> Sparse:
        at = np.cumsum([0] + [p.n for p in parts])
        join = lambda xs, kind: np.concatenate([*xs, np.zeros(0, kind)]).astype(kind)
        return Sparse(
            int(at[-1]), join([p.row + a for p, a in zip(parts, at)], np.int64),  # noqa: B905
            join([p.col for p in parts], np.int64), join([p.val for p in parts], np.float64),
        )


def _dense(columns: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.stack(columns, 1)
    n, k = m.shape
    return np.repeat(np.arange(n), k), np.tile(np.arange(first, first + k), n), m.ravel()


def content_features(texts: list[str | None]) -> Sparse:
    parts = []
    for _, some in groups(texts):
        flat = Flat(some)
        words = flat.word_hashes()
        text = flat.text_of_word()
        bucket = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        cell, n = np.unique((text << WORD_BITS) | bucket, return_counts=True)
        row, col = cell >> WORD_BITS, cell & ((1 << WORD_BITS) - 1)
        val = np.log1p(n)
        val /= np.sqrt(np.maximum(np.bincount(row, val * val, flat.n_texts), 1e-9))[row]
        codes = flat.codes
        chars = np.maximum(flat.ends - flat.begins - 1, 1)
        share = lambda mark: flat.per_text(mark) / chars
        count = np.maximum(flat.counts, 1)
        again = repeated(words ^ mix(text.astype(np.uint64) + np.uint64(77)))
        upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
        symbol = (codes >= 33) & (codes <= 47) | (codes >= 58) & (codes <= 64) | (codes >= 91) & (codes <= 96) | (codes >= 123) & (codes <= 126)
        distinct = np.bincount(np.unique((text << WORD_BITS) | bucket) >> WORD_BITS, minlength=flat.n_texts)
        shape = [
            np.ones(flat.n_texts), 4 * share(upper), 4 * share((codes >= 48) & (codes <= 57)), 4 * share(symbol), 20 * share(codes == 124),
            flat.per_text_words(again) / count, flat.per_text_words(flat.stops - flat.starts) / count / 8, distinct / count,
        ]
        more = _dense(shape, 1 << WORD_BITS)
        parts.append(Sparse(flat.n_texts, *(np.concatenate(x) for x in zip((row, col, val), more, strict=True))))
    return Sparse.stack(parts)


def _hashed(values: list[str | None], bits: int) -> np.ndarray:
    """A bucket per value; few distinct values stand in a batch."""
    of = {v: zlib.crc32((v or "\0").encode("utf-8", "surrogatepass")) % (1 << bits) for v in set(values)}
    return np.array([of[v] for v in values], np.int64)


def meta_features(texts: list[str | None], sources: list[str | None], langs: list[str | None]) -> Sparse:
    parts = []
    at = 0
    for _, some in groups(texts):
        flat = Flat(some)
        n = flat.n_texts
        stop = np.flatnonzero(flat.codes == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        line_text = np.searchsorted(flat.ends, start, side="right")
        size = stop - start
        lines = np.bincount(line_text, minlength=n)
        before = flat.codes[np.maximum(stop - 1, 0)]
        ends_well = ((before == 46) | (before == 33) | (before == 63)) & (size > 0)
        per = lambda v: np.bincount(line_text, v, n) / np.maximum(lines, 1)
        length = np.log1p(flat.ends - flat.begins - 1) / 8
        shape = [np.ones(n), length, length**2, np.log1p(lines) / 4, np.log1p(per(size)) / 6, per(size < 40), per(ends_well)]
        rows = np.arange(n)
        source = _hashed(sources[at : at + n], SOURCE_BITS)
        lang = _hashed(langs[at : at + n], LANG_BITS) + (1 << SOURCE_BITS)
        more = _dense(shape, (1 << SOURCE_BITS) + (1 << LANG_BITS))
        ones = np.ones(n)
        parts.append(Sparse(n, *(np.concatenate(x) for x in zip((rows, source, ones), (rows, lang, ones), more, strict=True))))
        at += n
    return Sparse.stack(parts)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, size: int, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights by Adam on the whole sample; the same input gives the same weights."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        g = x.back(weight * (sigmoid(x.dot(w)) - y), size) / total + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a score into log odds."""
    n = len(z)
    x = Sparse(n, np.tile(np.arange(n), 2), np.repeat([0, 1], n), np.concatenate([z, np.ones(n)]))
    a, b = fit_logistic(x, y, weight, 2, 1e-3, 300)
    return float(a), float(b)


@dataclass
class CoModel:
    content: np.ndarray | None
    meta: np.ndarray | None
    content_line: tuple[float, float]
    meta_line: tuple[float, float]
    joint: tuple[float, float, float]
    prior: float

    def scores(self, content: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content, metadata, combined) probabilities of good."""
        if self.content is None:
            return tuple(np.full(content.n, self.prior) for _ in range(3))
        a = self.content_line[0] * content.dot(self.content) + self.content_line[1]
        b = self.meta_line[0] * meta.dot(self.meta) + self.meta_line[1]
        j = self.joint
        return sigmoid(a), sigmoid(b), sigmoid(j[0] * a + j[1] * b + j[2])


Fitted = list[tuple[np.ndarray, tuple[float, float]]]  # weights and calibration of the content and the metadata view
Given = list[tuple[Sparse, np.ndarray]]  # rows and pseudo-labels for the content and the metadata view


def surest_rows(views: list[Sparse], pool: np.ndarray, fitted: Fitted, most: int) -> Given:
    """What each view is given by the other one: the `most` surest rows of either kind out of `pool`."""
    given = []
    for mine, other in ((0, 1), (1, 0)):
        w, (a, b) = fitted[other]
        p = sigmoid(a * views[other].take(pool).dot(w) + b)
        chosen = {}
        for kind, sure in ((1, p), (0, 1 - p)):
            order = np.argsort(-sure, kind="stable")[:most]
            chosen |= {int(k): kind for k in order if sure[k] >= SURE}
        picked = np.array(sorted(chosen), np.int64)
        given.append((views[mine].take(pool[picked]), np.array([chosen[int(k)] for k in picked], np.int64)))
    return given


def co_train(
    content: Sparse, meta: Sparse, label: np.ndarray, rounds: int = ROUNDS, stands_for: tuple[float, float] = (1.0, 1.0),
    surest: Callable[[Fitted, int], Given] | None = None,
) -> CoModel:
    """`label`: 1 good, 0 bad, -1 not labelled. `stands_for`: labels that one bad, one good row stands for.

    `surest` gives the pseudo-labels of a round (by default, of the rows without a label).
    """
    known = np.flatnonzero(label >= 0)
    prior = float(np.average(label[known], weights=np.take(stands_for, label[known]))) if len(known) else 1.0
    none = CoModel(None, None, (1.0, 0.0), (1.0, 0.0), (0.5, 0.5, 0.0), prior)
    aside = np.sort(np.concatenate([known[label[known] == kind][::ASIDE] for kind in (0, 1)]))
    base = np.setdiff1d(known, aside)
    if any(len(set(label[x].tolist())) < 2 for x in (aside, base)):
        return none
    often = np.take(stands_for, label[aside])
    views = [(content, N_CONTENT), (meta, N_META)]
    if surest is None:
        pool = np.flatnonzero(label < 0)
        surest = lambda fitted, most: surest_rows([content, meta], pool, fitted, most)
    given: Given | None = None
    fitted: Fitted = []
    for step in range(rounds + 1):
        fitted = []
        for v, (x, size) in enumerate(views):
            rows, y = x.take(base), label[base].astype(float)
            if given is not None:
                rows, y = Sparse.stack([rows, given[v][0]]), np.concatenate([y, given[v][1]])
            share = y.mean()
            weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * np.where(np.arange(len(y)) < len(base), 1.0, 0.5)
            w = fit_logistic(rows, y, weight, size)
            fitted.append((w, calibrate(x.take(aside).dot(w), label[aside].astype(float), often)))
        if step < rounds:
            given = surest(fitted, PASSED_ON * (step + 1))
    (wc, lc), (wm, lm) = fitted
    a = lc[0] * content.take(aside).dot(wc) + lc[1]
    b = lm[0] * meta.take(aside).dot(wm) + lm[1]
    n = len(aside)
    both = Sparse(n, np.tile(np.arange(n), 3), np.repeat([0, 1, 2], n), np.concatenate([a, b, np.ones(n)]))
    joint = fit_logistic(both, label[aside].astype(float), often, 3, 1e-3, 300)
    return CoModel(wc, wm, lc, lm, tuple(joint.tolist()), prior)


def _features(batch: pa.RecordBatch, text: str, source: str, lang: str) -> tuple[Sparse, Sparse]:
    get = lambda c: batch.column(c).to_pylist()
    texts = get(text)
    return content_features(texts), meta_features(texts, get(source), get(lang))


def _of_row() -> Column:
    """Hash that tells rows of one id apart; a null differs from an empty text."""
    return F.xxhash64(*[x for c in ("text", "source", "lang") for x in (F.col(c), F.col(c).isNull())])


def _featured(rows: DataFrame, order: list[str]) -> tuple[pd.DataFrame, Sparse, Sparse]:
    """Other columns and both views' features of a bounded number of rows, on the driver in a fixed order."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        c, m = _features(batch, "text", "source", "lang")
        out = {}
        for name, x in (("c", c), ("m", m)):
            places = np.argsort(x.row, kind="stable")
            ends = np.searchsorted(x.row[places], np.arange(x.n + 1))
            col, val = x.col[places].astype(np.int32), x.val[places].astype(np.float32)
            out[f"{name}_col"] = [col[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out[f"{name}_val"] = [val[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out

    kinds = {k: "binary" for k in ("c_col", "c_val", "m_col", "m_val")}
    table = add_columns(rows, work, kinds, "text", "source", "lang").drop("text", "source", "lang").toPandas()
    table = table.sort_values(order, kind="stable")

    def view(name: str) -> Sparse:
        cols = [np.frombuffer(b, np.int32) for b in table[f"{name}_col"]]
        vals = [np.frombuffer(b, np.float32) for b in table[f"{name}_val"]]
        join = lambda xs, kind: np.concatenate([*xs, np.zeros(0, kind)])
        row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
        return Sparse(len(cols), row.astype(np.int64), join(cols, np.int32).astype(np.int64), join(vals, np.float32).astype(np.float64))

    return table, view("c"), view("m")


def _surest(docs: DataFrame, known: DataFrame, fitted: Fitted, most: int) -> Given:
    """As `surest_rows`, out of all documents whose id has no label, scored by Spark."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)  # N_CONTENT + N_META weights

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        both = zip(sent.value, _features(batch, "text", "source", "lang"), strict=True)
        return {f"_p{v}": sigmoid(a * x.dot(w) + b) for v, ((w, (a, b)), x) in enumerate(both)}

    kinds = {"_p0": "double", "_p1": "double"}
    scored = add_columns(docs, work, kinds, "text", "source", "lang").select("doc_id", "_h", *kinds)
    sure = F.greatest("_p0", "_p1", 1 - F.col("_p0"), 1 - F.col("_p1")) >= SURE
    scored = written(scored.where(sure).distinct().join(known.select("doc_id"), "doc_id", "left_anti"), "sure")
    picks = []
    for v in (0, 1):
        for kind in (1, 0):
            p = F.col(f"_p{v}") if kind else 1 - F.col(f"_p{v}")
            best = scored.where(p >= SURE).orderBy(p.desc(), F.xxhash64("doc_id"), "doc_id", "_h").limit(most)
            picks.append(best.select("doc_id", "_h", F.struct(F.lit(1 - v).alias("to"), F.lit(kind).alias("kind")).alias("_pick")))
    chosen = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])
    chosen = chosen.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_list("_pick")).alias("_picks"))  # at most 4 a row
    rows = docs.join(F.broadcast(chosen), ["doc_id", "_h"]).dropDuplicates(["doc_id", "_h"])  # at most 4 * `most` rows; equal ones alike
    table, content, meta = _featured(rows, ["doc_id", "_h"])
    given = []
    for v, x in enumerate((content, meta)):
        labels = [[p["kind"] for p in picks if p["to"] == v] for picks in table["_picks"]]
        held = np.array([k for k, found in enumerate(labels) if found], np.int64)
        given.append((x.take(held), np.array([labels[k][0] for k in held], np.int64)))
    return given


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoModel:
    """Fits both views. `labels`: doc_id, quality (1 good, 0 bad)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("_label")
    )
    known = written(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    n_of = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    n_bad, n_good = n_of.get(0, 0), n_of.get(1, 0)
    bad = min(n_bad, max(labelled // 2, labelled - n_good))
    good = min(n_good, labelled - bad)
    first = lambda kind, n: known.where(F.col("_label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(first(0, bad).unionByName(first(1, good)))  # at most `labelled` rows
    texts = docs.where("doc_id is not null").select("doc_id", "text", "source", "lang", _of_row().alias("_h"))
    one = F.min_by(F.struct("text", "source", "lang"), "_h").alias("_one")
    picked = texts.join(chosen, "doc_id").groupBy("doc_id", "_label").agg(one).select("doc_id", "_label", "_one.*")
    rows, content, meta = _featured(picked, ["doc_id"])
    stands_for = (n_bad / max(bad, 1), n_good / max(good, 1))
    return co_train(
        content, meta, rows["_label"].to_numpy(np.int64), stands_for=stands_for,
        surest=lambda fitted, most: _surest(texts, known, fitted, most),
    )


def score(docs: DataFrame, model: CoModel, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """`docs` with `content_score`, `metadata_score`, `score` and `kept` (score of 0.5 or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # N_CONTENT + N_META weights

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        c, m, s = sent.value.scores(*_features(batch, text, source, lang))
        return {"content_score": c, "metadata_score": m, "score": s, "kept": s >= 0.5}

    kinds = {"content_score": "double", "metadata_score": "double", "score": "double", "kept": "boolean"}
    return add_columns(docs, work, kinds, text, source, lang)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id` and the scores of every row of `documents`."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text", "source", "lang"), model).drop("text", "source", "lang")
