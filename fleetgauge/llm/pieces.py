"""SentencePiece encoding and decoding by a Viterbi search with shared prefixes.

A text becomes marked words: spaces are written as the mark, one mark goes ahead of the text, and the
text is cut where no piece of the vocabulary can reach across (ahead of a mark, and around characters
that no longer piece holds). The distinct words of a batch are sorted, so words with a common prefix
follow each other; a walk over this order, which is a depth-first walk over their trie, keeps the
forward states of the prefix shared with the word before and only extends them.

The state at a prefix is the best last piece. In a unigram model it maximises the sum of scores. In a
BPE model the sums do not decide: the encoding of a prefix is the only path whose neighbouring pieces
are all stable, that is, merging the two as one string gives the same two pieces back. (Merges inside
two neighbours run in the same order with or without the rest of the text, and the first merge across
a border would show in the two alone.) So a piece may end a path only if it is stable with the piece
before; stability is found by merging the two once, and kept.

Characters outside the vocabulary become their UTF-8 bytes; models without byte pieces are refused. Null
and empty texts have no pieces. Decoding gives the text back, but for a literal mark (U+2581) in it,
which comes back as a space.
"""

from __future__ import annotations

import gc
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm.tables import add_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
_KEPT = 100_000  # words and pairs remembered by a task


class PieceModel:
    """Vocabulary, scores and kind of a model file, as plain values that can be sent to tasks."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], bpe: bool):
        self.pieces, self.scores, self.bpe = pieces, scores, bpe
        self.key = hashlib.md5(repr((pieces, scores, bpe)).encode("utf-8", "surrogatepass")).hexdigest()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if i in special and re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no pieces for bytes")
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces that reach over a mark")
        of_byte = {i: b for b, i in self.byte_ids.items()}
        self.raw = [
            bytes([of_byte[i]]) if i in of_byte else b"" if i in special else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]

    @classmethod
    def load(cls, path: str = MODEL) -> PieceModel:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = {i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        pieces, scores = [m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)]
        # Scores of a BPE model are its ranks, negative whole numbers; those of a unigram model are logarithms.
        bpe = all(float(s).is_integer() for s in scores)
        return cls(pieces, scores, special, bpe)


class Encoder:
    """Pieces are numbered as in the model; other single characters get numbers behind them."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.score = {p: model.scores[i] for p, i in model.ids.items()}
        self.worst = min(self.score.values(), default=0.0) - 10.0  # of an unknown character
        self.joined = {c for p in model.ids if len(p) > 1 for c in p} | {MARK}
        inside = "".join(re.escape(c) for c in sorted(self.joined - {MARK}))
        word = f"{MARK}*[{inside}]+|" if inside else ""
        self.cut = re.compile(f"{word}{MARK}+|[^{MARK}{inside}]")
        self.names = list(model.pieces)
        self.number = dict(model.ids)
        self.long_of = [len(p) for p in model.pieces]
        self.stable: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        sizes = np.array([len(b) for b in model.raw])
        self.raw = np.frombuffer(b"".join(model.raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum(sizes)])
        self._build_automaton()

    def _build_automaton(self) -> None:
        """All pieces that end at a character come from one state: the longest end of the text so far
        that begins a piece. `ends[state]` lists them as (number, length), longest first."""
        step: list[dict[str, int]] = [{}]
        depth, held, parent = [0], [-1], [(0, "")]
        for piece, number in self.m.ids.items():
            state = 0
            for c in piece:
                nxt = step[state].get(c)
                if nxt is None:
                    nxt = step[state][c] = len(step)
                    step.append({})
                    depth.append(depth[state] + 1)
                    held.append(-1)
                    parent.append((state, c))
                state = nxt
            held[state] = number
        self.step, self.back = step, [0] * len(step)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(step)
        for nxt in sorted(range(1, len(step)), key=depth.__getitem__):
            state, c = parent[nxt]
            if state:
                at = self.back[state]
                while at and c not in step[at]:
                    at = self.back[at]
                self.back[nxt] = step[at].get(c, 0)
            own = ((held[nxt], depth[nxt]),) if held[nxt] >= 0 else ()
            self.ends[nxt] = own + self.ends[self.back[nxt]]
            if not self.ends[nxt] or self.ends[nxt][-1][1] != 1:  # a character that is no piece itself
                self.ends[nxt] += ((self._character(c), 1),)

    def _follow(self, state: int, c: str) -> int:
        at = state
        while at and c not in self.step[at]:
            at = self.back[at]
        found = self.step[at].get(c, 0)
        if found:
            self.step[state][c] = found
        return found

    def _character(self, c: str) -> int:
        if c not in self.number:
            self.number[c] = len(self.names)
            self.names.append(c)
            self.long_of.append(1)
        return self.number[c]

    def merge(self, text: str) -> list[str]:
        """Pieces by merging: the neighbours with the best joint piece first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _is_stable(self, before: int, piece: int) -> bool:
        if len(self.stable) > 4 * _KEPT:
            self.stable.clear()
        names = [self.names[n] for n in (before, piece) if n >= 0]
        found = self.stable[before << 32 | piece] = self.merge("".join(names)) == names
        return found

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, in one walk over their sorted order."""
        out = {}
        previous = ""
        # Forward states by depth: last piece, sum of scores, state of the automaton.
        last, sums, states = [-1], [0.0], [0]
        step, ends, bpe, n_own, long_of = self.step, self.ends, self.m.bpe, len(self.m.pieces), self.long_of
        stable, add_piece, add_state = self.stable, last.append, states.append
        for word in sorted(words):
            depth = 0
            for a, b in zip(word, previous):  # noqa: B905
                if a != b:
                    break
                depth += 1
            del last[depth + 1 :], states[depth + 1 :], sums[depth + 1 :]
            state = states[-1]
            for c in word[depth:]:
                found = step[state].get(c)
                state = self._follow(state, c) if found is None else found
                add_state(state)
                options = ends[state] or ((self._character(c), 1),)
                if bpe:
                    for number, long in options:
                        key = last[-long] << 32 | number
                        if stable[key] if key in stable else self._is_stable(last[-long], number):
                            add_piece(number)
                            break
                    else:
                        raise ValueError("no stable path: the pieces do not come from merges")
                else:
                    number, total = self._best(sums, c, options)
                    add_piece(number)
                    sums.append(total)
            path, n = [], len(word)
            while n:
                number = last[n]
                path.append(number)
                n -= long_of[number]
            path.reverse()
            out[word] = path if not path or max(path) < n_own else self._bytes_for_unknown(path)
            previous = word
        return out

    def _best(self, sums: list[float], c: str, options: tuple) -> tuple[int, float]:
        """Last piece of the path with the largest sum; of equal sums the longer piece."""
        if options[-1][1] != 1:
            options = (*options, (self._character(c), 1))
        chosen, total = -1, 0.0
        for number, long in options:
            s = sums[-long] + (self.m.scores[number] if number < len(self.m.pieces) else self.worst)
            if chosen < 0 or s > total:
                chosen, total = number, s
        return chosen, total

    def _bytes_for_unknown(self, path: list[int]) -> list[int]:
        out = []
        for number in path:
            if number < len(self.m.pieces):
                out.append(number)
            else:
                out += [self.m.byte_ids[b] for b in self.names[number].encode("utf-8", "surrogatepass")]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts."""
        words: list[str] = []
        counts = []
        for text in texts:
            found = self.cut.findall(MARK + text.replace(" ", MARK)) if text else []
            words += found
            counts.append(len(found))
        place = {w: k for k, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        fresh = [w for w in place if w not in self.known]
        made = self.encode_words(fresh)
        known = self.known
        tokens = [made[w] if w in made else known[w] for w in place]
        often = np.bincount(at, minlength=len(place)) > 1
        again = {w: made[w] for w, o in zip(place, often.tolist(), strict=True) if o and w in made}
        if len(known) + len(again) > _KEPT:
            self.known = {}
        self.known |= again
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(chain.from_iterable(tokens), np.int32, int(sizes.sum()))
        ids, per_word = gather(flat, np.concatenate([[0], np.cumsum(sizes)]), at)
        ends = np.concatenate([[0], np.cumsum(per_word)])
        return ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)], ids

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of lists of ids; bytes that are no UTF-8 become the replacement character."""
        raw, sizes = gather(self.raw, self.raw_at, ids)
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        data = raw.tobytes()
        out = []
        for k in range(len(offsets) - 1):
            text = data[at[k] : at[k + 1]].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes): the lists `at` of a flat list of lists, one behind the other."""
    starts, sizes = offsets[at], offsets[at + 1] - offsets[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - sizes), sizes)
    return flat[np.arange(total) + shift], sizes


_encoders: dict[str, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    model = sent.value
    if model.key not in _encoders:
        _encoders.clear()
        _encoders[model.key] = Encoder(model)
        gc.freeze()  # its many small lists live as long as the worker
    return _encoders[model.key]


def _sent(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(PieceModel.load(model))  # the vocabulary bounds its size


def encode(df: DataFrame, text: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """`df` with `ids` and `n_tokens`; with `check`, also whether decoding gives the text back."""
    sent = _sent(df.sparkSession, model)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = batch.column(text).to_pylist()
        encoder = _encoder(sent)
        offsets, ids = encoder.encode(texts)
        out = {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), "n_tokens": np.diff(offsets)}
        if check:
            out["round_trip"] = [a == (b or "") for a, b in zip(encoder.decode(offsets, ids), texts, strict=True)]
        return out

    kinds = {"ids": "array<int>", "n_tokens": "long"} | ({"round_trip": "boolean"} if check else {})
    return add_columns(df, work, kinds, text)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """`df` with the text of its ids; null for null ids."""
    sent = _sent(df.sparkSession, model)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        lists = batch.column(ids).to_pylist()
        flat = np.array([i for x in lists for i in x or ()], np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
        texts = _encoder(sent).decode(offsets, flat)
        return {text: [None if x is None else t for x, t in zip(lists, texts, strict=True)]}

    return add_columns(df, work, {text: "string"}, ids)


def digest(df: DataFrame, model: str = MODEL) -> DataFrame:
    """`doc_id, ids, n_tokens, round_trip` of every row of `documents`."""
    return encode(df.select("doc_id", "text"), model=model, check=True).drop("text")
