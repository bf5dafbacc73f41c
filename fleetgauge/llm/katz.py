"""Language-model scores: Katz backoff over Good-Turing discounted n-gram counts.

P(w | h) = d(c) * c / c(h) where the n-gram (h, w) occurs c > 0 times in training, else a(h) * P(w | h'),
with h' one word shorter and a(h) = (share of h that the discounts leave) / (1 - sum of P(v | h') over the v seen
behind h): the probabilities behind each history sum to one. Below the single words stands one unknown word, which
takes what their discounts leave. A history without training counts passes on to the shorter one.

Discounts: d(r) = (r*/r - A) / (1 - A) for r <= k, r* = (r + 1) n(r+1) / n(r), A = (k + 1) n(k+1) / n(1), where n(r) counts the
n-grams of this length that occur r times; k is the largest up to 5 with all d(r) between 0 and 1, and 0 if there is none.
Where a history's discounts leave nothing, its counts are divided by c(h) + 1, which leaves 1 / (c(h) + 1).

Texts are cut into words at ASCII white space, A-Z become small, and an end mark closes each text. The history of
the first words is filled up with a start mark, which is never predicted.

How it runs. Documents become blocks: packed streams of word numbers, in a table bucketed by block. For each n-gram
length in turn, a block sends its distinct n-grams, with their training counts and the probability that the shorter
history gives (for pairs: the word's count, which says the same), to partitions by the number of the history; a history
with more than a partition's share of all words is dealt over as many partitions as its share asks for. A partition counts its n-grams and answers each block: counts,
numbers for the next length, and of each history the counts of counts and the summed probabilities. The answers are the
n-gram tables as each block needs them, partitioned like the blocks, so nothing is broadcast and the streams
move no more: the bucketed blocks meet their answers where they lie and evaluate each token from the longest n-gram down.
To the driver go only the counts of counts of each length.

Blocks and partitions hold `LEAST` tokens, and more where the corpus is so large that a block would otherwise send few
n-grams to each partition; one longer text makes a block of its own.

Null texts are empty: just the end mark. A null id is not held out. Repeated rows are scored and counted each. With no
training text every token has probability 1. An empty table gives an empty one. Other columns play no part.
Words and n-grams are told apart by 64-bit hashes of the words.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.arrays import mix
from fleetgauge.llm.tables import table_type
from fleetgauge.llm.word_runs import split_words
from fleetgauge.session import work_path

ORDER = 2
LARGEST_DISCOUNTED = 5
LEAST = 3 << 19  # tokens of a block, n-grams of a partition
PIECE = 64  # n-grams that a block should send to a partition, at least
END = b"\n"  # no word has white space
_STAT = -1  # in place of a word: asks for the history only


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: high bytes are mostly alike."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], n * size, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the (sorted) keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


class Totals(NamedTuple):
    """Training n-grams of one length: how many occur, how often in all, and how many of them once, twice, ..."""

    seen: int
    tokens: int
    times: tuple[int, ...]

    def discounts(self) -> np.ndarray:
        """d(0), d(1), ..., d(k + 1): the last stands for all larger counts."""
        n = (0, *self.times)
        for k in range(LARGEST_DISCOUNTED, 0, -1):
            if not all(n[1 : k + 2]):
                continue
            a = (k + 1) * n[k + 1] / n[1]
            if a >= 1:
                continue
            d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d, 1.0])
        return np.array([1.0, 1.0])


class Shape(NamedTuple):
    """What all blocks and partitions must agree on."""

    parts: int
    train_docs: int
    order: int


# --- a block: its entries of each length ----------------------------------------------------------------------------


class Entries(NamedTuple):
    """Distinct n-grams of a block by partition, history and word; `gram` is the block's own number, -1 for none."""

    part: np.ndarray
    hist: np.ndarray
    word: np.ndarray
    count: np.ndarray
    below: np.ndarray  # what the sum behind the history is made of
    gram: np.ndarray

    def sorted(self) -> Entries:
        order = np.lexsort((self.word, self.hist, self.part))
        return Entries(*(x[order] for x in self))


def word_entries(hashes: np.ndarray, counts: np.ndarray, shape: Shape) -> Entries:
    part = (mix(hashes) % np.uint64(shape.parts)).astype(np.int64)
    zero = np.zeros(len(hashes), np.int64)
    return Entries(part, zero, hashes.view(np.int64), counts, zero.astype(float), np.arange(len(hashes))).sorted()


class Grams(NamedTuple):
    """n-grams of one length in a block: of each token its gram, of each gram its number in all blocks and its training
    count, and of each token its probability behind the history."""

    of_token: np.ndarray
    number: np.ndarray
    count: np.ndarray
    prob: np.ndarray


class Longer(NamedTuple):
    """The next longer n-grams: `entries` to ask for, and what their answers are needed with."""

    of_token: np.ndarray
    entries: Entries
    hist: np.ndarray
    hist_count: np.ndarray
    below: np.ndarray


def longer(words: Grams, last: Grams, firsts: np.ndarray, train: np.ndarray, tokens: int, shape: Shape) -> Longer:
    """`firsts`: first token of each text; `train`: 1 for tokens of training texts; `tokens`: of all training texts."""
    n = len(last.of_token)
    before = np.empty(n, np.int64)
    before[1:] = last.of_token[:-1]
    before[firsts] = -1  # the start mark
    own = (before + 1) * len(words.number) + words.of_token
    _, at, of_token = np.unique(own, return_index=True, return_inverse=True)
    h = before[at]
    hist = np.where(h < 0, 0, last.number[h])
    hist_count = np.where(h < 0, shape.train_docs, last.count[h])
    word = words.number[words.of_token[at]]
    count = np.bincount(of_token, weights=train, minlength=len(at)).astype(np.int64)
    below = last.prob[at]
    # A history with a share of all words is dealt over that share of the partitions.
    salts = np.minimum(1 + hist_count * shape.parts // max(1, tokens), shape.parts)
    where = (hist + (mix(word.view(np.uint64)) % salts.view(np.uint64)).view(np.int64)) % shape.parts
    hot, one = np.unique(hist[salts > 1], return_index=True)
    many = salts[salts > 1][one]
    asked = np.repeat(hot, many)
    salt = np.arange(len(asked)) - np.repeat(np.cumsum(many) - many, many)
    none = np.zeros(len(asked), np.int64)
    # The shorter history's probability; single words go by their counts, which are smaller and say the same.
    sent = words.count[words.of_token[at]] if last is words else below
    entries = Entries(
        np.concatenate([where, (asked + salt) % shape.parts]), np.concatenate([hist, asked]), np.concatenate([word, none + _STAT]),
        np.concatenate([count, none]), np.concatenate([sent, none.astype(sent.dtype)]), np.concatenate([np.arange(len(at)), none - 1]),
    )
    return Longer(of_token, entries.sorted(), hist, hist_count, below)


# --- a partition: counts its n-grams and answers the blocks ---------------------------------------------------------


def _coded(entries: Entries, lo: int, hi: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Histories of a piece without what its partition says: steps between their quotients, and salts."""
    hist = entries.hist[lo:hi]
    return np.diff(hist // shape.parts, prepend=0), (entries.part[lo:hi] - hist) % shape.parts


def _hist(part: int, steps: np.ndarray, salt: np.ndarray, shape: Shape) -> np.ndarray:
    return np.cumsum(steps) * shape.parts + (part - salt) % shape.parts


def requests(block: int, entries: Entries, shape: Shape) -> dict[str, list]:
    """One row per partition that the block asks."""
    begins = _starts(entries.part)
    out: dict[str, list] = {k: [] for k in REQUEST.names}
    for lo, hi in zip(begins, [*begins[1:], len(entries.part)], strict=True):
        out["block"].append(block)
        out["part"].append(int(entries.part[lo]))
        hist, salt = _coded(entries, lo, hi, shape)
        out["hist"].append(pack(hist))
        out["salt"].append(pack(salt))
        out["word"].append(pack(entries.word[lo:hi]))
        out["count"].append(pack(entries.count[lo:hi]))
        out["below"].append(pack(entries.below[lo:hi]))
    return out


REQUEST = pa.schema([
    ("block", pa.int64()), ("part", pa.int64()), ("hist", pa.binary()), ("word", pa.binary()), ("count", pa.binary()), ("below", pa.binary()),
    ("salt", pa.binary()),
])
REQUEST_SQL = "block long, part long, hist binary, word binary, count binary, below binary, salt binary"
ANSWER = pa.schema([
    ("level", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()), ("ranks", pa.binary()),
    ("times", pa.binary()), ("below", pa.binary()), ("seen", pa.int64()), ("tokens", pa.int64()), ("n", pa.list_(pa.int64())),
])
ANSWER_SQL = (
    "level int, block long, part long, counts binary, ranks binary, times binary, below binary, seen long, tokens long, n array<long>"
)


def answer_part(pieces: pa.Table, level: int, words: Totals | None, shape: Shape) -> pa.Table:
    """Answers to the pieces of one partition, and a row (block -1) with its counts of counts."""
    part = pieces["part"][0].as_py()
    take = lambda name, kind: [unpack(x, kind) for x in pieces[name].to_pylist()]
    hists = [_hist(part, x, y, shape) for x, y in zip(take("hist", np.int64), take("salt", np.int64), strict=True)]
    sizes = np.array([len(x) for x in hists])
    hist, word = np.concatenate(hists), np.concatenate(take("word", np.int64))
    count = np.concatenate(take("count", np.int64))
    if level == 2:
        below = word_probability(np.concatenate(take("below", np.int64)), words)
    else:
        below = np.concatenate(take("below", np.float64))
    order = np.lexsort((word, hist))
    begins = _starts(hist[order], word[order])
    total = np.add.reduceat(count[order], begins)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    seen = total > 0
    first = order[begins]
    of_hist = _starts(hist[first])
    hist_of = np.repeat(np.arange(len(of_hist)), np.diff(np.append(of_hist, len(first))))
    times = np.stack([np.add.reduceat((total == r).astype(np.int64), of_hist) for r in range(1, LARGEST_DISCOUNTED + 1)], 1)
    mass = np.add.reduceat(np.where(seen, below[first], 0.0), of_hist)
    out: dict[str, list] = {k: [] for k in ANSWER.names}
    often = np.empty(len(total), np.int64)
    often[np.argsort(-total, kind="stable")] = np.arange(len(total))  # frequent ones get small numbers, which pack well
    ends = np.cumsum(sizes)
    for block, lo, hi in zip(pieces["block"].to_pylist(), ends - sizes, ends, strict=True):
        mine = rank[lo:hi]
        hists_of = hist_of[mine[_starts(hist[lo:hi])]]
        row = (level, block, part, pack(total[mine]), pack(often[mine]) if level < shape.order else None,
               pack(times[hists_of].ravel()), pack(mass[hists_of]), None, None, None)
        for name, value in zip(ANSWER.names, row, strict=True):
            out[name].append(value)
    n = [int((total == r).sum()) for r in range(1, LARGEST_DISCOUNTED + 2)]
    row = (level, -1, part, None, None, None, None, int(seen.sum()), int(total.sum()), n)
    for name, value in zip(ANSWER.names, row, strict=True):
        out[name].append(value)
    return pa.table(out, schema=ANSWER)


# --- a block again: probabilities from the answers ------------------------------------------------------------------


class Answers(NamedTuple):
    """Answers of one length to one block, in the order of its entries."""

    count: np.ndarray
    rank: np.ndarray | None
    times: np.ndarray
    below: np.ndarray


def answers_of(rows: pa.Table, level: int) -> Answers:
    mine = rows.filter(pc.equal(rows["level"], level)).sort_by("part")
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in mine[name].to_pylist() if x is not None)])
    ranked = mine["ranks"].null_count == 0
    return Answers(
        join("counts", np.int64), join("ranks", np.int64) if ranked else None,
        join("times", np.int64).reshape(-1, LARGEST_DISCOUNTED), join("below", np.float64),
    )


def _numbered(entries: Entries, got: Answers, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(number in all blocks, training count) of the block's grams; 0 stands for the start mark."""
    real = entries.gram >= 0
    size = int(real.sum())
    number, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[entries.gram[real]] = got.count[real]
    if got.rank is not None:
        number[entries.gram[real]] = got.rank[real] * shape.parts + entries.part[real] + 1
    return number, count


def word_grams(codes: np.ndarray, entries: Entries, got: Answers, totals: Totals, shape: Shape) -> Grams:
    number, count = _numbered(entries, got, shape)
    return Grams(codes, number, count, word_probability(count, totals)[codes])


def word_probability(count: np.ndarray, totals: Totals) -> np.ndarray:
    """Of single words; a count of 0 is the unknown word."""
    if not totals.tokens:
        return np.ones(len(count))
    d = totals.discounts()
    left = sum(n * r * (1 - d[r]) for r, n in enumerate(totals.times, 1) if r < len(d) - 1)
    if left <= 0:
        return np.where(count > 0, count, 1) / (totals.tokens + 1)
    return np.where(count > 0, d[np.minimum(count, len(d) - 1)] * count, left) / totals.tokens


def longer_grams(ask: Longer, got: Answers, totals: Totals, shape: Shape) -> Grams:
    entries = ask.entries
    number, count = _numbered(entries, got, shape)
    d = totals.discounts()
    # What each history's discounts leave, and the shorter history's probabilities of what it has seen.
    places, where = np.unique(entries.hist, return_inverse=True)
    at = where[_starts(entries.part, entries.hist)]
    left, mass = np.zeros(len(places)), np.zeros(len(places))
    weight = np.array([r * (1 - d[r]) if r < len(d) - 1 else 0.0 for r in range(1, LARGEST_DISCOUNTED + 1)])
    np.add.at(left, at, got.times @ weight)
    np.add.at(mass, at, got.below)
    of_gram = np.searchsorted(places, ask.hist)
    left, mass = left[of_gram], mass[of_gram]
    plain = left <= 0
    total = np.maximum(ask.hist_count + plain, 1)
    seen = np.where(plain, 1.0, d[np.minimum(count, len(d) - 1)]) * count / total
    back = np.where(plain, 1.0, left) / total / np.maximum(1 - mass, np.finfo(float).tiny) * ask.below
    prob = np.where(ask.hist_count == 0, ask.below, np.where(count > 0, seen, back))
    return Grams(ask.of_token, number, count, prob[ask.of_token])


class Block(NamedTuple):
    """Streams of one block: word numbers with an end mark behind each text, sizes of the texts, whether they train."""

    codes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, row: pa.Table) -> Block:
        take = lambda name, kind: unpack(row[name][0].as_py(), kind)
        return cls(*(take(n, k) for n, k in zip(cls._fields, (np.int32, np.uint64, np.int64, np.int64, np.bool_), strict=True)))

    def levels(self, answers: pa.Table, totals: list[Totals], shape: Shape) -> tuple[list[Grams], Longer | None]:
        """Grams of every length that is answered, and what to ask for the next one."""
        ask = word_entries(self.hashes, self.counts, shape)
        grams = [word_grams(self.codes.astype(np.int64), ask, answers_of(answers, 1), totals[0], shape)]
        firsts = np.cumsum(self.sizes) - self.sizes
        train = np.repeat(~self.held, self.sizes).astype(float)
        for level in range(2, shape.order + 1):
            more = longer(grams[0], grams[-1], firsts, train, totals[0].tokens, shape)
            if level > len(totals):
                return grams, more
            grams.append(longer_grams(more, answers_of(answers, level), totals[level - 1], shape))
        return grams, None


# --- on Spark -------------------------------------------------------------------------------------------------------


def cut_blocks(df: DataFrame, most: int) -> DataFrame:
    """Blocks of the texts of `id, text, held`; `most` tokens each, or one longer text."""
    kind = df.schema["id"].dataType
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(table_type(kind))), *((n, pa.binary()) for n in Block._fields)])

    def make(number: int, ids: pa.Array, texts: pa.Array, held: np.ndarray) -> pa.RecordBatch:
        words, offsets = split_words(pc.ascii_lower(texts))
        encoded = words.dictionary_encode()
        sizes = np.diff(offsets) + 1
        codes = np.full(int(sizes.sum()), len(encoded.dictionary), np.int64)  # the end mark is the last
        last = np.cumsum(sizes) - 1
        inner = np.ones(len(codes), bool)
        inner[last] = False
        codes[inner] = encoded.indices.to_numpy()
        often = np.bincount(codes, minlength=len(encoded.dictionary) + 1)
        by_count = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
        place = np.empty(len(by_count), np.int64)
        place[by_count] = np.arange(len(by_count))
        names = [*encoded.dictionary.cast(pa.large_binary()).to_pylist(), END]
        hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in names), np.uint64)[by_count]
        codes = place[codes]
        counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(hashes))
        streams = [pack(x) for x in (codes.astype(np.int32), hashes, counts.astype(np.int64), sizes, held)]
        ids = ids.cast(schema.field("ids").type.value_type)
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, *(pa.array([x], pa.binary()) for x in streams)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        room = most
        for batch in batches:
            # A text of b bytes has at most b / 2 + 1 tokens and its end; b / 4 is near the usual number.
            size = pc.add(pc.divide(pc.fill_null(pc.binary_length(batch.column("text")), 0), 4), 1).to_numpy(zero_copy_only=False)
            lo = 0
            total = np.cumsum(size)
            while lo < len(size):
                done = total[lo - 1] if lo else 0
                hi = int(np.searchsorted(total, done + room, side="right"))
                if hi == lo and not parts:
                    hi = lo + 1
                if hi > lo:
                    parts.append(batch.slice(lo, hi - lo))
                    room -= total[hi - 1] - done
                if hi < len(size):
                    yield flush(number, parts)
                    number, parts, room = number + 1, [], most
                lo = hi
        if parts:
            yield flush(number, parts)

    def flush(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        texts = pa.concat_arrays([x.cast(pa.large_string()) for x in rows["text"].chunks])
        return make(number, pa.concat_arrays(rows["id"].chunks), texts, rows["held"].to_numpy())

    return df.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, " + ", ".join(f"{n} binary" for n in Block._fields))


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """`df` written to the shared folder in buckets: grouping by the column reads it without an exchange."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", work_path(spark, "blocks")).option("compression", "none").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files of a named path stay
    return table


def _plain(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "none").parquet(path)  # the columns are packed already
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, REQUEST)


def score(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, held_out: Column | None = None, order: int = ORDER, least: int = LEAST,
) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`, a row per row of `df`.

    Rows where `held_out` is true are scored but not learned from. `base_score`: sum of log10((c + 1) / (N + V + 1))
    over the tokens, with c, N and V from the training texts; `score`: log10 probability of the text.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), held.alias("held"))
    size = docs.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("docs"), F.count_if(~F.col("held")).alias("train")
    ).first()
    tokens = size["bytes"] // 4 + size["docs"]
    most = max(least, math.isqrt(PIECE * tokens))
    shape = Shape(max(1, -(-tokens // most)), size["train"], order)
    blocks = bucketed(cut_blocks(docs, most), "block", min(100_000, max(1, 2 * shape.parts)))
    totals: list[Totals] = []
    answers: list[DataFrame] = []
    for level in range(1, order + 1):
        found = _plain(_answered(_asked(blocks, answers, totals, shape), level, totals, shape), f"grams{level}")
        n = [F.sum(F.col("n")[k]) for k in range(LARGEST_DISCOUNTED + 1)]
        row = found.where("block = -1").agg(F.sum("seen"), F.sum("tokens"), *n).first()
        totals.append(Totals(row[0] or 0, row[1] or 0, tuple(x or 0 for x in row[2:])))
        answers.append(found.where("block >= 0"))
    return _scored(blocks, answers, totals, shape)


def _asked(blocks: DataFrame, answers: list[DataFrame], totals: list[Totals], shape: Shape) -> DataFrame:
    if not answers:

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield _batch(requests(block, word_entries(unpack(hashes, np.uint64), unpack(counts, np.int64), shape), shape))

        return blocks.select("block", "hashes", "counts").mapInArrow(words, REQUEST_SQL)

    known = list(totals)

    def grams(row: pa.Table, given: pa.Table) -> pa.Table:
        _, more = Block.of(row).levels(given, known, shape)
        return pa.Table.from_batches([_batch(requests(row["block"][0].as_py(), more.entries, shape))])

    return _meet(blocks.drop("ids"), answers).applyInArrow(grams, REQUEST_SQL)


def _meet(blocks: DataFrame, answers: list[DataFrame]):
    given = answers[0]
    for more in answers[1:]:
        given = given.unionByName(more)
    return blocks.groupBy("block").cogroup(given.drop("seen", "tokens", "n").groupBy("block"))


def _answered(asked: DataFrame, level: int, totals: list[Totals], shape: Shape) -> DataFrame:
    words = totals[0] if totals else None
    return asked.groupBy("part").applyInArrow(lambda pieces: answer_part(pieces, level, words, shape), ANSWER_SQL)


def _scored(blocks: DataFrame, answers: list[DataFrame], totals: list[Totals], shape: Shape) -> DataFrame:
    kind = blocks.schema["ids"].dataType.elementType
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (kind.simpleString(), "boolean", "long", "long", "long", "double", "double")
    known = list(totals)

    def run(row: pa.Table, given: pa.Table) -> pa.Table:
        block = Block.of(row)
        grams, _ = block.levels(given, known, shape)
        count = grams[0].count[block.codes]
        base = np.log10((count + 1) / (known[0].tokens + known[0].seen + 1))
        firsts = np.cumsum(block.sizes) - block.sizes
        per_text = lambda x: np.add.reduceat(x, firsts)  # noqa: E731  every text has its end mark
        return pa.table([
            row["ids"].chunk(0).flatten(), pa.array(block.held), pa.array(block.sizes), pa.array(per_text((count > 0).astype(np.int64))),
            pa.array(np.full(len(firsts), known[0].tokens)), pa.array(per_text(base)), pa.array(per_text(np.log10(grams[-1].prob))),
        ], names=list(names))

    return _meet(blocks, answers).applyInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def digest(df: DataFrame) -> DataFrame:
    """Scores of every row of `documents`; texts whose id's checksum leaves 2 by 7 are held out."""
    return score(df, held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
