"""Similarity join, mixing, WARC and top-k against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import graph, jaccard_join, mixing, topk_search, warc


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string, key string, source string")


def _shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    sets = [_shingles(t) for t in (r[1] for r in rows)]
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                link[i][j] = both >= 0.8 * len(sets[i] | sets[j])
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    ids = [r[0] for r in rows]
    head = {}
    for i in range(n):
        known = [ids[j] for j in range(n) if root[j] == root[i] and ids[j] is not None]
        head[i] = min(known) if known else None
    return sorted((ids[i] if ids[i] is not None else -1, head[i], sum(link[i])) for i in range(n))


def _copies(seed, n_groups=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for g in range(n_groups):
        base = [word() for _ in range(60)]
        for c in range(2 + 3 * g):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(60)] = word()
            texts.append(" ".join(w))
        texts.append(" ".join(base))
        texts.append("  ".join(base) + "\n")  # other white space, same words
    return texts


def test_classes_and_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 4)  # clusters of many blocks
    texts = [*_copies(1), None, "", " \n ", "one two", "one two", "one  two", "a b c d e", "a b c d e f"]
    rows = [(k, t, "x", "y", "s") for k, t in enumerate(texts)]
    rows += [(3, rows[3][1], "x", "y", "s"), (None, rows[5][1], "x", "y", "s")]  # a repeated row, a null id
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in jaccard_join.digest(_docs(spark, rows)).collect())
    assert got == _brute(rows)


def test_links_without_a_shared_band_are_counted(spark):
    r = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(300):
        w = list(base)
        for j in range(2):
            w[r.randrange(5, 195)] = f"x{k}_{j}"  # most pairs are 0.81 alike
        texts.append(" ".join(w))
    rows = [(k, t, "x", "y", "s") for k, t in enumerate(texts)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.digest(_docs(spark, rows)).collect())
    assert got == _brute(rows)


def test_one_row_of_each_class_stays(spark):
    texts = _copies(2, 3) + [None, "lone words here"]
    rows = [(k, t, "x", "y", "s") for k, t in enumerate(texts)] + [(0, texts[0], "x", "y", "s")]
    docs = _docs(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted({c for _, c, _ in _brute(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def _sizes_of_clusters(members, edges):
    return sorted((r["count"] for r in graph.components(edges).groupBy("root").count().collect()), reverse=True)


def test_texts_that_share_a_passage_do_not_chain(spark):
    """4000 texts, a third of whose words are one passage (similarity 0.2), and some near copies among them."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(60)] + passage + [word() for _ in range(60)] for _ in range(4000)]
    for k in range(40):  # near copies of every hundredth, in groups of three
        for at in (1, 2):
            texts.append([*texts[100 * k][: 170 + at], "x"])
    bands, rows = jaccard_join.band_plan(0.8, 0.999, jaccard_join.MAX_HASHES)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    all_rows = jaccard_join.sketches(df, "doc_id", "text", 5, bands, rows)
    members = all_rows.groupBy("key").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).checkpoint()
    edges = jaccard_join._candidates(members)
    assert _sizes_of_clusters(members, edges)[0] <= 10  # weak candidates chained hundreds
    got = jaccard_join.digest(df).where("n_links > 0")
    assert sorted(x.n_links for x in got.collect()) == [2] * 120


def test_members_far_from_the_smallest_one_still_meet(spark):
    """Texts along a line, each like the next and less and less like the first: links as counted by brute force."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for line in range(3):
        words = [word() for _ in range(80)]
        for _ in range(30):
            rows.append((len(rows), " ".join(words), "x", "y", "s"))
            words[r.randrange(80)] = word()
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in jaccard_join.digest(_docs(spark, rows)).collect())
    assert got == _brute(rows)


def test_components_of_any_graph(spark):
    r = random.Random(3)
    for n, m in ((1, 0), (30, 20), (60, 60), (40, 300)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k) for k in range(0, n, 7)] + [(k, k + 1) for k in range(n // 3)]
        root = list(range(n + 1))
        for _ in pairs:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        got = {x.id: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {k: root[k] for pair in pairs for k in pair}


def test_rows_pass_with_columns_of_any_name(spark):
    names = ["_id", "_hash", "_row", "_rows", "_n", "_source", "_size", "_times", "_equal", "id", "n", "row", "key", "text_hash", "own_id"]
    rows = [(k % 5, f"some words of text {k % 3} that are long enough to stand", "s", *([k] * len(names))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 3
    taken = mixing.take(df)
    assert taken.columns == df.columns and {tuple(x) for x in taken.collect()} <= {tuple(x) for x in df.collect()}


def test_bands_reach_the_recall_wanted():
    for threshold, recall in ((0.8, 0.999), (0.9, 0.99), (0.5, 0.9)):
        bands, rows = jaccard_join.band_plan(threshold, recall, 64)
        assert bands * rows <= 64 and 1 - (1 - threshold**rows) ** bands >= recall


def test_banding_finds_pairs_at_the_threshold():
    r = np.random.default_rng(0)
    bands, rows = jaccard_join.band_plan(0.8, 0.999, 64)
    hits = 0
    for _ in range(400):
        x = r.integers(0, 2**63, 180, dtype=np.uint64) * np.uint64(2)
        a, b = x[:162], x[18:]  # 144 of 180 shared
        flat, at = np.concatenate([a, b]), np.array([0, 162, 324])
        sig, _ = jaccard_join.signatures(flat, at, bands, rows)
        hits += (sig[0] == sig[1]).any()
    assert hits >= 396


def _targets_by_hand(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(repeats * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeats * sizes[s] + 1e-9}
        if not over:
            return {s: repeats * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_the_mix_comes_near_its_targets(spark, seed):
    r = random.Random(seed)
    sources = ["b", "a", "ä", None, "tiny", "é", "none"]
    rows = []
    for k in range(600):
        s = r.choice(sources[:4] + ["b"] * 4) if k > 20 else r.choice(sources)
        rows.append((k, " ".join(["w"] * (0 if s == "none" else r.randint(0, 30))), s))
    rows += [(None, "x y", "a"), (5, None, "b"), (7, "x y z", "b"), (7, "x y z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).toPandas()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets_by_hand(sizes)
    for s, part in out.groupby(out["source"].fillna("?")):
        s = None if s == "?" else s
        assert part["target"].iloc[0] == pytest.approx(want[s])
        assert (part["source_size"] == sizes[s]).all()
        assert abs(part["taken"].sum() - want[s]) <= 2 * 30 + 1
    assert (out["taken"] <= 3 * out["size"]).all() and out["taken"].sum() <= sum(sizes.values())
    again = mixing.mix(df).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    assert out.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    taken = mixing.take(df)
    assert taken.count() == (out["taken"] / out["size"].clip(lower=1)).sum() and taken.columns == df.columns


def test_an_empty_mix(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.take(df).count() == 0


def test_archives_read_back_what_was_written(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.0", "<p>a</p>", "x" * 300_000, "dup", "dup"]
    rows = [(k, f"http://x/{k} ü\n", h, 1) for k, h in enumerate(html)] + [(7, "http://x/7 ü\n", "dup", 1), (None, None, "dup", 1), (3, "b", "z", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    index = warc.write_archives(pages)
    assert index.count() == len(rows) and index.select("file", "offset").distinct().count() == len(rows)
    got = warc.read_records(index).collect()
    first = {}
    for page, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", page)
    seen = set()
    want = []
    for page, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (h or "").encode()
        new = data not in seen
        seen.add(data)
        want.append((str(page), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if new else "revisit", None if new else first[h or ""]))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda w: w[:4])
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h, _ in rows}
    some = warc.read_records(index.where("page_id % 2 = 0"), payload=False)
    assert sorted(r.page_id for r in some.collect()) == [0, 2, 4, 6, 8]


def test_payloads_below_the_least_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = warc.read_records(warc.write_archives(pages, least=4)).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type) for r in got] == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.digest(pages.limit(0)).count() == 0


def test_a_damaged_record_is_noticed():
    row = {"page_id": 1, "url": None, "payload": b"abc", "payload_bytes": 3, "sha": hashlib.sha1(b"abd").hexdigest(), "record_type": "response", "refers_to": None, "copy": 0}
    with pytest.raises(ValueError, match="damaged"):
        warc.unpack(warc.pack(row))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    r = np.random.default_rng(5)
    rows = []
    for k in range(300):
        v = (r.integers(-2, 3, 12) / 4.0).tolist()
        if k % 3 == 0:
            v = [x if r.random() < 0.3 else 0.0 for x in v]
        rows.append((k, v))
    rows += [(500, None), (550, [1.0, None]), (600, [1.0, float("nan")]), (650, [float("inf")]), (700, []), (750, [1.0, 2.0]), (None, [1.0] * 12), (51, rows[51][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q is not None and q % 50 == 0:
            scored = [(-int((v[: len(c)] * c[: len(v)]).sum()), i is None, i or 0) for i, c in good if i != q]
            want += [(q, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:5])]
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in topk_search.digest(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    few = df.where(F.col("vec_id").isin(0, 1, 2))
    assert topk_search.digest(few).count() == 2 and topk_search.digest(df.limit(0)).count() == 0


def test_top_k_sends_no_unfolded_queries_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 8)
    df = spark.range(120).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7, F.col("id") % 5).cast("array<double>").alias("embedding"))
    out = topk_search.top_k(df, F.col("vec_id") % 2 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
    assert out.count() == 60 * 5


def test_scores_of_frequent_and_rare_terms_add_up(monkeypatch):
    monkeypatch.setattr(topk_search, "_TILE", 16)
    r = np.random.default_rng(2)
    x = r.integers(-9, 10, (70, 6))
    x[:, 4] *= r.random(70) < 0.1  # rare among the candidates
    x[3:, 5] = 0

    def block(rows):
        return topk_search.Block(
            np.arange(len(rows)).astype(np.int64).tobytes(), np.ones(len(rows), np.uint8).tobytes(),
            np.full(len(rows), 6, np.int32).tobytes(), rows.astype(np.int64).tobytes(),
        )

    assert (topk_search.scores(block(x[:20]), block(x)) == x[:20] @ x.T).all()
