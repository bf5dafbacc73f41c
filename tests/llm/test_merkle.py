"""The hash tree against a plain one that keeps every path in lists."""

import hashlib
import random
import zlib

import pytest

from fleetgauge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """(top, path of each leaf); a path holds (sibling, whether it is on the left)."""
    paths = [[] for _ in hashes]
    members = [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        above, below = [], []
        for i in range(0, len(hashes), 2):
            run = hashes[i : i + 2]
            for m in members[i]:
                paths[m].append((run[1] if len(run) > 1 else "", False))
            for m in members[i + 1] if len(run) > 1 else []:
                paths[m].append((run[0], True))
            above.append(sha("".join(run)))
            below.append(sum(members[i : i + 2], []))
        hashes, members = above, below
    return hashes[0], paths


def plain(rows):
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(row[2], []).append(k)
    subroot, path = {}, {}
    for lang, own in groups.items():
        own.sort(key=lambda k: (rows[k][0] is None, rows[k][0] or 0, leaf(rows[k])))
        subroot[lang], paths = tree([leaf(rows[k]) for k in own])
        path.update(zip(own, paths, strict=True))
    langs = sorted(subroot, key=lambda x: (x is not None, (x or "").encode()))
    root, paths = tree([subroot[x] for x in langs])
    upper = dict(zip(langs, paths, strict=True))
    out = []
    for k, row in enumerate(rows):
        steps = path[k] + upper[row[2]]
        start = list(row)
        if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
            start[3] += 1
        h = leaf(start)
        for sibling, on_left in steps:
            h = sha(sibling + h if on_left else h + sibling)
        out.append((row[0], leaf(row), subroot[row[2]], root, sha("".join(s for s, _ in steps)), h, h == root))
    return out


def as_set(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def made(n, seed):
    some = random.Random(seed)
    return [
        (
            some.choice([None, some.randrange(50)]) if some.random() < 0.1 else k, some.choice([None, "s", "é"]),
            some.choice([None, "", "en", "en", "en", "zz", "日本", *"abcdef"]), some.choice([None, 5, 7]), some.choice([None, "", "x y"]),
        )
        for k in range(n)
    ]


def test_several_rounds_equal_the_plain_tree(spark, monkeypatch):
    """Blocks of 8: groups of many blocks, nulls, repeated rows and ids, more groups than a block."""
    monkeypatch.setattr(merkle, "LEVELS", 3)
    rows = made(150, 1)
    got = merkle.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert as_set(got) == as_set(plain(rows))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_one_group_of_each_size(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(k, "s", "en", k, f"text {k}") for k in range(n)]
    assert as_set(merkle.digest(spark.createDataFrame(rows, SCHEMA)).collect()) == as_set(plain(rows))


def test_empty_table_and_extra_columns(spark):
    assert merkle.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None, "x", 3), (2, "a", "en", 4, "t", "y", 4)]
    df = spark.createDataFrame(rows, SCHEMA + ", grp string, pos int")
    assert as_set(merkle.digest(df).collect()) == as_set(plain([r[:5] for r in rows]))


def test_no_exchange_of_the_leaves_above_the_first(spark):
    """Leaves are laid out by block once; the join with the levels above uses that layout."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = merkle.digest(spark.createDataFrame(made(40, 2), SCHEMA))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan
