"""Main text of pages by a recurrent block labeller.

A page is cut into blocks. A bidirectional LSTM in numpy reads, for each block in page order, learned vectors
of the hashed tag path (tags, classes, ids of the open elements), learned vectors of its hashed words and a few
measures, and tells for every block whether it belongs to the article; the states of both directions carry what
stands before and behind. The blocks of the article, joined by one space, are the text.

The labeller is trained here, on layouts made by rule around texts of at most `SAMPLE_PAGES` pages, and on those
pages themselves where their elements (article, nav, footer and the like) speak for themselves. Every block of every
page is then read and labelled, whatever the page's length; pages without any block of an article have empty text.
Null and empty pages have empty text. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.arrays import Flat
from fleetgauge.llm.html_blocks import PageBlock, read_blocks
from fleetgauge.llm.html_templates import PageMaker
from fleetgauge.llm.tables import add_columns

SAMPLE_PAGES = 300
MADE_PAGES = 1500
EPOCHS = 6
SEED = 7
PATHS, PATH_SIZE = 2048, 16  # buckets and length of the vectors of path tokens
WORDS, WORD_SIZE = 1024, 8
MEASURES = 9
HIDDEN = 20
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
_MARK = ""  # stands in made pages ahead of article text


def _bucket(token: str) -> int:
    h = 2166136261
    for b in token.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % PATHS


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_buckets(path: tuple[str, ...]) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        if len(_paths) > 20_000:
            _paths.clear()
        found = _paths[path] = np.array([_bucket(t) for t in path] or [0], np.int64)
    return found


@dataclass
class Blocks:
    """Features of the blocks of some pages; `offsets` cut them by page."""

    offsets: np.ndarray
    path_flat: np.ndarray
    path_at: np.ndarray
    word_flat: np.ndarray
    word_at: np.ndarray
    measures: np.ndarray


def features(pages: list[list[PageBlock]]) -> Blocks:
    blocks = [b for page in pages for b in page]
    sizes = np.array([len(p) for p in pages], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    paths = [_path_buckets(b.path) for b in blocks]
    path_at = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
    flat = Flat([b.text for b in blocks])
    lower = np.where((flat.codes >= 65) & (flat.codes <= 90), flat.codes + 32, flat.codes)
    flat.codes = lower.astype(np.uint32)
    words = (flat.word_hashes() >> np.uint64(54)).astype(np.int64)  # 10 bits: WORDS buckets
    chars = np.maximum(flat.ends - flat.begins - 1, 1)
    share = lambda mark: flat.per_text(mark) / chars
    last = flat.codes[np.maximum(flat.ends - 2, 0)]
    page_of = np.repeat(np.arange(len(pages)), sizes)
    place = (np.arange(len(blocks)) - offsets[page_of]) / np.maximum(sizes[page_of], 1)
    m = np.stack([
        np.log1p(chars) / 6, np.minimum(flat.counts, 60) / 30, np.array([b.link_chars for b in blocks]) / chars if blocks else np.zeros(0),
        np.isin(last, [46, 33, 63, 58]).astype(float), np.array([b.heading for b in blocks], float),
        place, np.log1p(sizes[page_of]) / 5, 4 * share((flat.codes >= 48) & (flat.codes <= 57)), 4 * share(np.isin(flat.codes, [44, 46, 59])),
    ], 1).astype(np.float32) if blocks else np.zeros((0, MEASURES), np.float32)
    return Blocks(offsets, np.concatenate([*paths, np.zeros(0, np.int64)]).astype(np.int64), path_at, words, flat.word_offsets[: len(blocks) + 1], m)


def _mean(table: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each list; 0 for an empty list."""
    n = np.diff(at)
    out = np.zeros((len(n), table.shape[1]), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(table[flat], at[:-1][full], axis=0) / n[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of the bidirectional LSTM and its output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
        self.w = {
            "path": f(PATHS, PATH_SIZE, s=0.3), "word": f(WORDS, WORD_SIZE, s=0.1),
            "fx": f(INPUT, 4 * HIDDEN), "fh": f(HIDDEN, 4 * HIDDEN), "fb": np.zeros(4 * HIDDEN, np.float32),
            "bx": f(INPUT, 4 * HIDDEN), "bh": f(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32),
            "out": f(2 * HIDDEN + INPUT), "bias": np.zeros(1, np.float32),
        }
        for k in ("fb", "bb"):
            self.w[k][HIDDEN : 2 * HIDDEN] = 1  # gates open to the past at first

    def inputs(self, x: Blocks) -> np.ndarray:
        # Sums over the path, so that one telling name is not lost among many.
        path = _mean(self.w["path"], x.path_flat, x.path_at) * np.sqrt(np.maximum(np.diff(x.path_at), 1))[:, None]
        return np.concatenate([path, _mean(self.w["word"], x.word_flat, x.word_at), x.measures], 1).astype(np.float32)

    def _run(self, side: str, inputs: np.ndarray, offsets: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of one direction. All pages step together, those with most blocks first."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        states = np.zeros((len(inputs), HIDDEN), np.float32)
        tape: list = []
        if not len(order):
            return states, tape
        size = sizes[order]
        start = offsets[:-1][order] if side == "f" else offsets[1:][order] - 1
        move = 1 if side == "f" else -1
        given = inputs @ self.w[side + "x"] + self.w[side + "b"]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")
        h = np.zeros((len(order), HIDDEN), np.float32)
        c = np.zeros((len(order), HIDDEN), np.float32)
        for t in range(size[0]):
            a = alive[t]
            at = start[:a] + move * t
            z = given[at] + h[:a] @ self.w[side + "h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c[:a] + i * g
            if keep:
                tape.append((at, h[:a].copy(), c[:a].copy(), i, f, o, g, new))
            c[:a] = new
            h[:a] = o * np.tanh(new)
            states[at] = h[:a]
        return states, tape

    def probability(self, x: Blocks) -> np.ndarray:
        inputs = self.inputs(x)
        both = np.concatenate([self._run("f", inputs, x.offsets)[0], self._run("b", inputs, x.offsets)[0], inputs], 1)
        return _sigmoid(both @ self.w["out"] + self.w["bias"])

    def gradient(self, x: Blocks, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, back through both directions."""
        w = self.w
        inputs = self.inputs(x)
        fs, f_tape = self._run("f", inputs, x.offsets, True)
        bs, b_tape = self._run("b", inputs, x.offsets, True)
        both = np.concatenate([fs, bs, inputs], 1)
        d = (weight * (_sigmoid(both @ w["out"] + w["bias"]) - y) / max(weight.sum(), 1e-6)).astype(np.float32)
        g = {"out": both.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_both = d[:, None] * w["out"][None, :]
        d_in = d_both[:, 2 * HIDDEN :].copy()
        for side, tape, d_states in (("f", f_tape, d_both[:, :HIDDEN]), ("b", b_tape, d_both[:, HIDDEN : 2 * HIDDEN])):
            d_given = np.zeros((len(inputs), 4 * HIDDEN), np.float32)
            g_h = np.zeros_like(w[side + "h"])
            n = len(tape[0][0]) if tape else 0
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for at, h0, c0, i, f, o, gg, new in reversed(tape):
                a = len(at)
                up = dh[:a] + d_states[at]
                tc = np.tanh(new)
                dcell = dc[:a] + up * o * (1 - tc * tc)
                dz = np.concatenate([
                    dcell * gg * i * (1 - i), dcell * c0 * f * (1 - f), up * tc * o * (1 - o), dcell * i * (1 - gg * gg)
                ], 1)
                d_given[at] = dz
                g_h += h0.T @ dz
                dh[:a], dc[:a] = dz @ w[side + "h"].T, dcell * f
            g[side + "x"], g[side + "h"], g[side + "b"] = inputs.T @ d_given, g_h, d_given.sum(0)
            d_in += d_given @ w[side + "x"].T
        n_path, n_word = np.diff(x.path_at), np.diff(x.word_at)
        for name, d_part, flat, n, scale in (
            ("path", d_in[:, :PATH_SIZE], x.path_flat, n_path, 1 / np.sqrt(np.maximum(n_path, 1))),
            ("word", d_in[:, PATH_SIZE : PATH_SIZE + WORD_SIZE], x.word_flat, n_word, 1 / np.maximum(n_word, 1)),
        ):
            each = np.repeat(np.arange(len(n)), n)
            by = np.argsort(flat, kind="stable")
            g[name] = np.zeros_like(w[name])
            if len(flat):
                rows, first = np.unique(flat[by], return_index=True)
                g[name][rows] = np.add.reduceat((d_part * scale[:, None])[each[by]], first, axis=0)
        return g


def _made(maker: PageMaker) -> tuple[list[PageBlock], list[int]]:
    html = "".join(
        re.sub(r"(^|>)(?=[^<>])", rf"\1{_MARK}", piece) if label else piece for piece, label in maker.page()
    )
    blocks = read_blocks(html)
    labels = [int(_MARK in b.text) for b in blocks]
    return [b._replace(text=" ".join(b.text.replace(_MARK, " ").split()) or "-") for b in blocks], labels


# Elements whose meaning the HTML standard fixes, and names that leave no doubt.
_CHROME = frozenset(
    "nav footer aside form button label select !hidden ad ads advert advertisement sponsored cookie consent comments comment".split()
)


def own_labels(blocks: list[PageBlock]) -> list[float]:
    """What the elements of a page say by themselves: 1, 0, or -1 where they say nothing."""
    out = []
    for b in blocks:
        names = {t.lstrip(".") for t in b.path}
        out.append(0 if names & _CHROME else 1 if names & {"article"} else -1)
    return out


def train(htmls: list[str], made: int = MADE_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller from sampled pages; equal samples in equal order give an equal labeller."""
    real = [read_blocks(h) for h in htmls]
    lines = [b.text for page in real for b in page]
    maker = PageMaker(lines, seed)
    data = [_made(maker) for _ in range(made)]
    data += [(p, own_labels(p)) for p in real if p]
    order = np.random.default_rng(seed)
    model = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    step = 0
    total = epochs * -(-len(data) // 32)
    for _ in range(epochs):
        # Pages of like length run together.
        places = sorted(range(len(data)), key=lambda k: len(data[k][0]))
        batches = [places[k : k + 32] for k in range(0, len(places), 32)]
        for k in order.permutation(len(batches)):
            some = [data[i] for i in batches[k]]
            y = np.array([x for _, labels in some for x in labels], np.float32)
            if not len(y):
                continue
            g = model.gradient(features([p for p, _ in some]), np.maximum(y, 0), (y >= 0).astype(np.float32))
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.99 * v[name] + 0.01 * grad * grad
                model.w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


GROUP_BLOCKS = 4000  # blocks labelled at once


def main_texts(htmls: list[str | None], model: Labeller) -> list[str]:
    out: list[str] = []
    held: list[list[PageBlock]] = []

    def flush() -> None:
        x = features(held)
        chosen = model.probability(x) >= 0.5
        for k, page in enumerate(held):
            out.append(" ".join(b.text for b, yes in zip(page, chosen[x.offsets[k] : x.offsets[k + 1]].tolist(), strict=True) if yes))
        held.clear()

    n = 0
    for html in htmls:
        blocks = read_blocks(html)
        held.append(blocks)
        n += len(blocks)
        if n >= GROUP_BLOCKS:
            flush()
            n = 0
    if held:
        flush()
    return out


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """Trains on the different pages with the smallest hashes, at most `sample` of them.

    The bound is found on the hashes alone, so no more than that many pages ever come to the driver.
    """
    hashed = pages.where("html is not null").select("html", F.xxhash64("html").alias("_h"))
    least = [r["_h"] for r in hashed.select("_h").distinct().orderBy("_h").limit(sample).collect()]
    if not least:
        return train([])
    rows = hashed.where(F.col("_h") <= least[-1]).groupBy("_h").agg(F.min("html").alias("html")).toPandas()
    return train(rows.sort_values("_h")["html"].tolist())


def extract(pages: DataFrame, model: Labeller, html: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars`."""
    sent = pages.sparkSession.sparkContext.broadcast(model.w)  # its size is set by the constants above

    def labeller() -> Labeller:
        found = Labeller.__new__(Labeller)
        found.w = sent.value
        return found

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = main_texts(batch.column(html).to_pylist(), labeller())
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return add_columns(pages, work, {"text": "string", "n_chars": "long"}, html)


def digest(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` of every page."""
    model = fit(pages)
    return extract(pages.select("page_id", "url", "html"), model).drop("html")

