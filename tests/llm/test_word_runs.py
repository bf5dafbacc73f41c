"""Periodic runs against a search that tries every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fleetgauge.llm import word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, power=4):
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def some_words(some, k):
    words = [some.randrange(k) for _ in range(some.randrange(0, 40))]
    if some.random() < 0.5:
        unit = [some.randrange(k) for _ in range(some.randrange(1, 6))]
        words = words[: some.randrange(10)] + unit * some.randrange(1, 9) + unit[: some.randrange(len(unit))] + words[: some.randrange(10)]
    return words


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_many_texts_at_once(least, power):
    some = random.Random(least)
    for _ in range(400):
        texts = [some_words(some, some.choice([1, 2, 2, 3, 5])) for _ in range(some.randrange(1, 5))]
        sizes = [len(t) for t in texts]
        got = word_runs.runs(np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), sizes), least, power)
        want, at = [], 0
        for text in texts:
            want += [(s + at, s + length + at, q) for s, length, q in plain_runs(text, least, power)]
            at += len(text)
        assert [tuple(r) for r in got.tolist()] == want


def test_long_periodic_texts_stay_near_linear():
    ones = np.zeros(200_000, np.int64)
    assert word_runs.runs(ones, ones).tolist() == [[0, 200_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 100_000:  # as many squares as words can hold, none four times
        a, b = b, b + a
    assert len(word_runs.runs(np.array(b), np.zeros(len(b), np.int64))) == 0


def test_words_split_at_ascii_white_space_only():
    texts = ["  a\tb\n\nc\x0bd\x0ce\rf ", "", None, "x\x1cy\x85z\xa0 w", " \n ", "é 日本"]
    words, offsets = word_runs.split_words(pa.array(texts))
    for k, text in enumerate(texts):
        assert words.to_pylist()[offsets[k] : offsets[k + 1]] == WORD.findall(text or "")


def test_digest_equals_the_plain_search(spark, monkeypatch):
    """Planted texts, nulls, empty texts, repeated rows; groups of few words, so a batch is many."""
    monkeypatch.setattr(word_runs, "GROUP_WORDS", 50)
    some = random.Random(7)
    rows = [(k, " ".join("abcde"[w] for w in some_words(some, 4)) + some.choice(["", " ", "\n"])) for k in range(150)]
    rows += [(None, "a a a a a a a"), (151, None), (152, ""), (153, " \t"), (3, rows[3][1]), (154, "na " * 500 + "end")]
    df = spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, runs string, text string")
    got = sorted((tuple(r) for r in word_runs.digest(df).collect()), key=str)
    assert got == sorted((plain(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20
    listed = {r["doc_id"]: r for r in word_runs.find_runs(df.where("doc_id > 150")).collect()}
    assert [tuple(x) for x in listed[154]["runs"]] == [(0, 500, 1)] and listed[154]["collapsed"] == "na end"
    assert listed[151]["runs"] == [] and listed[151]["collapsed"] == ""


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert word_runs.digest(empty).count() == 0 and word_runs.find_runs(empty).count() == 0
