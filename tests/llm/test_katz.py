"""Katz scores against a plain model in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import katz

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNKNOWN = object()


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), "\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def discounts(counts):
    n = Counter(counts.values())
    for k in (5, 4, 3, 2, 1):
        if not all(n[r] for r in range(1, k + 2)):
            continue
        a = (k + 1) * n[k + 1] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)} if a < 1 else {}
        if d and all(0 < x < 1 for x in d.values()):
            return d
    return {}


class Plain:
    """Counts of every length; probabilities straight from the definition."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for words in texts:
            padded = ["<s>"] * (order - 1) + words
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
        self.d = [discounts(c) for c in self.counts]
        self.behind = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for gram, c in self.counts[k].items():
                self.behind[k][gram[:-1]][gram[-1]] = c
        self.left = {}

    def p(self, word, hist):
        k = len(hist) + 1
        seen = self.behind[k].get(hist)
        if not seen:
            return 1.0 if k == 1 else self.p(word, hist[1:])
        c, total, d = seen.get(word, 0), sum(seen.values()), self.d[k]
        left = sum(x * (1 - d[x]) for x in seen.values() if x in d)
        scale = 1.0
        if left <= 0:
            left, total, d = 1.0, total + 1, {}
        if c:
            return scale * d.get(c, 1.0) * c / total
        if k == 1:
            return left / total
        if hist not in self.left:
            self.left[hist] = 1 - math.fsum(self.p(w, hist[1:]) for w in seen)
        return left / total / self.left[hist] * self.p(word, hist[1:])

    def score(self, words):
        padded = ["<s>"] * (self.order - 1) + words
        n = self.order - 1
        return math.fsum(math.log10(self.p(padded[i], tuple(padded[i - n : i]))) for i in range(n, len(padded)))


def plain(rows, order=2):
    training = [tokens(t) for i, t in rows if not held(i)]
    model = Plain(training, order)
    words = Counter(w for t in training for w in t)
    n, v = sum(words.values()), len(words)
    out = []
    for i, text in rows:
        own = tokens(text)
        base = math.fsum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        out.append((i, held(i), len(own), sum(words[w] > 0 for w in own), n, base, model.score(own)))
    return out, model


def same(got, want):
    key = lambda r: tuple(map(str, r[:5])) + (round(r[5], 6),)
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def made(seed, n=70, kinds=60):
    """Words with frequencies like those of a language, so that few occur often and many once."""
    some = random.Random(seed)
    word = lambda: f"W{int(kinds ** some.random() * 1.5)}" if some.random() < 0.9 else f"r{some.randrange(500)}"
    rows = [(k, " ".join(word() for _ in range(some.randrange(0, 60)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t"), (None, "W1 w2 é"), (3, rows[3][1]), (n + 3, "w1 " * 400)]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_plain_model(spark, order):
    """Small blocks and partitions: frequent histories are dealt over several of them."""
    rows = made(order)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).repartition(3)
    out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    want, model = plain(rows, order)
    same(katz.score(df, held_out=out, order=order, least=200).collect(), want)
    # Behind any history the probabilities of all words and of one unknown word sum to one.
    words = [g[0] for g in model.counts[1]] + [UNKNOWN]
    for hist in list(model.behind[order])[:40]:
        assert math.fsum(model.p(w, hist) for w in words) == pytest.approx(1, abs=1e-9)


def test_digest_on_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    same(katz.digest(docs).collect(), plain(rows)[0])


@pytest.mark.parametrize("rows", [
    [],
    [(1, "a a a b"), (2, "a b")],  # no counts of counts to discount by
    [(k, "x y") for k in range(200) if held(k)][:3],  # nothing to learn from
    [(0, None)],
])
def test_small_tables(spark, rows):
    same(katz.digest(spark.createDataFrame(rows, SCHEMA)).collect(), plain(rows)[0])


def test_blocks_are_read_without_an_exchange(spark):
    df = spark.createDataFrame(made(5), SCHEMA)
    plan = katz.score(df, least=200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the answers
    assert "Bucketed: true" in plan


def test_packing():
    for values in (np.zeros(0, np.int64), np.array([3, -1, 2**62]), np.array([0.5, -1e300])):
        assert (katz.unpack(katz.pack(values), values.dtype.type) == values).all()
