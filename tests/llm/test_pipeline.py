"""The pipeline against a plain version of all its stages, and its registered queries."""

import hashlib
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, connect
from fleetgauge.llm import oracles, secrets_scan
from tests.llm.test_joins import _brute, _targets_by_hand
from tests.llm.test_text_rules import JWT, brute_counts

SF = "/root/testdata/sf0.001"


def _texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7)))
    out = []
    for k in range(30):
        words = [word() for _ in range(r.randint(12, 60))]
        if k % 5 == 0:
            words[3] = 'token = "zzzz9999yyyy"'
        if k % 7 == 0:
            words.append(JWT)
        out.append(" ".join(words))
        if k % 4 == 0:
            out += [out[-1], " ".join(words[:-1] + ["other"])]
    return [*out, None, "", "too short", "again and again " * 30]


def _rejected(text):
    b = brute_counts(text)
    failed = b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]
    return failed or any(100 * b[f"gram_{n}"] > p * b["word_chars"] for n, p in ((5, 20), (7, 17), (10, 15)))


def _mix(rows):
    """(row, times) of the mix: whole queue of one process, by virtual finish time."""
    size = lambda row: len((row[1] or "").split())
    sizes = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + size(row)
    targets = _targets_by_hand(sizes)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    items = []
    for rank, name in enumerate(names):
        own = sorted((r for r in rows if r[3] == name), key=lambda r: (hashlib.md5(f"{r[0]}mix".encode()).hexdigest(), r[0], size(r)))
        cum = 0
        for row in own:
            cum += size(row)
            items += [((e * sizes[name] + cum) / targets[name], rank, row) for e in range(3)]
    out, run = {}, 0
    for _, _, row in sorted(items, key=lambda x: x[:2]):
        run += size(row)
        if run > sum(sizes.values()):
            break
        out[row] = out.get(row, 0) + 1
    return out


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    rows = [(k, t, "en", ["s1", "s2", None][k % 3], None if t is None else len(t)) for k, t in enumerate(_texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r in rows if not _rejected(r[1])]
    heads = {c for _, c, _ in _brute(good)}
    kept = [r for r in good if r[0] in heads]
    masked = []
    for r in kept:
        text = secrets_scan.mask(r[1], secrets_scan.find_secrets(r[1]))
        masked.append((r[0], text, r[2], r[3], len(text)))
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want = sorted((r[0], r[4], tuple(library.encode(r[1]))) for r, n in _mix(masked).items() for _ in range(n))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_chars, tuple(r.ids)) for r in got.collect()) == want
    assert any("[secret]" in r[1] for r in masked) and len(kept) < len(good) < len(rows)


def test_pipeline_of_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_every_dealt_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_the_last_stage_says_whether_the_ids_give_the_text_back(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "a ▁ b")], "doc_id long, text string")
    got = {r.doc_id: r.round_trip for r in corpus_pipeline.tokens(spark, docs, SF).collect()}
    assert got == {1: True, 2: True, 3: False}
