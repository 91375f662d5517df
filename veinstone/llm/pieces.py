"""SentencePiece encoding and decoding (operator 8): shared-prefix Viterbi over distinct marked words.

Texts are marked (a space becomes U+2581, one is put in front) and cut into words before each run of
marks, as bytes and by their hashes. Each batch's distinct new words are sorted, which lays them out as a
trie in depth-first order; a stack of forward cells, one for each character, is kept for the prefix shared
with the word before, so a cell is computed once for all words below it. Beside each cell lies the state
of an automaton over the vocabulary, which names the pieces that end there.

A forward cell holds the best segmentation that ends there. For unigram models that is the one with the
highest sum of piece scores. A BPE model's scores are merge ranks, and its segmentation is not the one with
the best sum; there the cell holds the only last piece that is consistent: of the pieces that end here, the
one whose predecessor's cell it follows without any merge across the border (a path of score 0; others minus
infinity). Both are exact: the second equals merging pair by pair. Characters without a piece become bytes.

Null texts encode to null; an empty text encodes to no pieces. Any text decodes to itself; bytes that are no
valid UTF-8 are read as U+FFFD first. Very long texts and words are encoded whole; words of over
LONG_WORD bytes are not remembered. Repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import clean, held, keeps, read, tidy

MARK = "▁"
#: Stands for a mark that a text itself holds (no valid text holds a lone surrogate); it becomes the mark's bytes.
OWN_MARK = "\udc81"
#: Where the vocabulary is; the driver reads it and sends it to the executors (a file of fixed size, at most MAX_MODEL bytes).
MODEL, MAX_MODEL = "/opt/tokenizers/piece_bpe_32k.model", 64 << 20
WORST = float("inf")
#: Ids, above all pieces' ones, of a word's start and (with the code point added) of a character without a piece.
FIRST, NO_PIECE = 1 << 23, (1 << 23) + 1
#: Distinct words (of at most LONG_WORD bytes) and pairs of pieces that a worker remembers; beyond it starts anew.
REMEMBER, REMEMBER_PAIRS, LONG_WORD = 400_000, 200_000, 64
#: Bytes of text that are coded at once.
CHUNK = 1 << 19


@dataclass
class Vocabulary:
    pieces: dict[str, int]
    scores: list[float]
    texts: list[bytes]
    bytes_: list[int]
    unknown: int
    bpe: bool

    @classmethod
    def load(cls, proto: bytes, bpe: bool) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = {s: i for i, s in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        texts = [bytes([int(s[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else s.replace(MARK, " ").encode() for i, s in enumerate(names)]
        return cls(normal, [sp.get_score(i) for i in range(len(names))], texts, byte, sp.unk_id(), bpe)


class State:
    """A prefix of pieces: where each next character leads, and the (length, id) of the pieces that end here, longest first."""

    __slots__ = ("ends", "text", "to")

    def __init__(self, text: str, ends: tuple[tuple[int, int], ...]):
        self.text, self.ends, self.to = text, ends, {}


class Coder:
    """Encodes words; remembers them, and which pieces may follow which."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.rank = {piece: -v.scores[t] for piece, t in v.pieces.items()}
        self.worst = min(v.scores) - 10
        self.follows: dict[int, bool] = {}
        self.states: dict[str, State | None] = dict.fromkeys(piece[:n] for piece in v.pieces for n in range(1, len(piece) + 1))
        self.root = self.states[""] = State("", ())
        size = np.array([len(t) for t in v.texts], np.int64)
        self.piece_bytes, self.piece_end = np.frombuffer(b"".join(v.texts), np.uint8), np.cumsum(size)
        self.piece_size = size
        self.forget()

    def forget(self) -> None:
        """No word is known: hashes (sorted) with the start and number of their pieces in flat."""
        self.hashes, self.start, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def step(self, state: State, char: str) -> State:
        """The state of the longest suffix of state's text and char that is a prefix of a piece."""
        text = state.text + char
        while text not in self.states:
            text = text[1:]
        out = self.states[text]
        if out is None:
            get = self.v.pieces.get
            ends = tuple((len(text) - i, t) for i in range(len(text)) if (t := get(text[i:])) is not None)
            out = self.states[text] = State(text, ends)
        state.to[char] = out
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """Pair by pair: the adjacent pair with the best score first, the leftmost of equals."""
        symbols = list(symbols)
        rank = self.rank.get
        ranks = [rank(a + b, WORST) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == WORST:
                break
            at = ranks.index(best)
            joined = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = [joined]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + joined, WORST)
            if at < len(ranks):
                ranks[at] = rank(joined + symbols[at + 1], WORST)
        return symbols

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the text a + b ends in just a and b (a may be empty)."""
        return self.merged(list(a + b)) == ([a, b] if a else [b])

    def learn(self, words: list[str]) -> list[list[int]]:
        """The pieces of distinct words: depth first along the trie that their sorted order is. words is sorted in place."""
        words.sort()
        bpe, follows, fits, piece_score, worst = self.v.bpe, self.follows, self.fits, self.v.scores, self.worst
        # Of the forward cell behind each character: its last piece, where that starts, its score, and the automaton's state.
        ids, starts, scores, states = [FIRST], [0], [0.0], [self.root]
        out: list[list[int]] = []
        last = ""
        for word in words:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            del ids[same + 1 :], starts[same + 1 :], scores[same + 1 :], states[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                char = word[end - 1]
                state = states[-1]
                state = state.to.get(char) or self.step(state, char)
                piece, start, score = NO_PIECE, end - 1, scores[-1] + worst
                if bpe:
                    # The pair (id before, id) decides; a character without a piece has an id of its own.
                    piece += ord(char)
                    for n, t in state.ends:
                        key = ids[end - n] << 24 | t
                        good = follows.get(key)
                        if good is None:
                            good = follows[key] = fits(word[starts[end - n] : end - n], word[end - n : end])
                        if good:
                            piece, start, score = t, end - n, 0.0
                            break
                else:
                    for n, t in state.ends:
                        if scores[end - n] + piece_score[t] > score:
                            piece, start, score = t, end - n, scores[end - n] + piece_score[t]
                ids.append(piece)
                starts.append(start)
                scores.append(score)
                states.append(state)
            last = word
            found: list[int] = []
            end = len(word)
            while end:
                t, start = ids[end], starts[end]
                found += [t] if t < FIRST else [self.v.bytes_[b] for b in reversed(word[start:end].replace(OWN_MARK, MARK).encode())]
                end = start
            out.append(found[::-1])
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each row's end) of the texts that offsets cut the bytes buf into."""
        if len(self.hashes) > REMEMBER:
            self.forget()
        if len(self.follows) > REMEMBER_PAIRS:
            self.follows.clear()
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        space = buf == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        rows = offsets[:-1][np.diff(offsets) > 0]
        begins[rows] = True
        first = np.flatnonzero(begins)
        end = np.append(first[1:], len(buf))
        opens = np.isin(first, rows)  # a text's first word has a mark in front
        hashes = W.spans(buf, first, end, opens)
        found, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, found)
        new = np.ones(len(found), bool)
        new[place < len(self.hashes)] = self.hashes[place[place < len(self.hashes)]] != found[place < len(self.hashes)]
        start, many, flat = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), self.flat
        start[~new], many[~new] = self.start[place[~new]], self.many[place[~new]]
        if new.any():
            which = np.flatnonzero(new)
            raw = buf.tobytes()
            of = {}
            for i, a, b, opening in zip(which.tolist(), first[at[which]].tolist(), end[at[which]].tolist(), opens[at[which]].tolist(), strict=True):
                of[(MARK if opening else "") + raw[a:b].decode().replace(MARK, OWN_MARK).replace(" ", MARK)] = i
            words = list(of)
            coded = self.learn(words)
            order = np.array([of[w] for w in words], np.int64)
            many[order] = [len(c) for c in coded]
            start[order] = len(flat) + np.cumsum(many[order]) - many[order]
            flat = np.concatenate([flat, np.fromiter((t for c in coded for t in c), np.int32)])
            keep = np.sort(which[end[at[which]] - first[at[which]] <= LONG_WORD])
            if len(keep) == len(which):
                self.flat = flat
            else:  # without the pieces of long words
                short = np.concatenate([flat[start[i] : start[i] + many[i]] for i in keep]) if len(keep) else flat[:0]
                kept = len(self.flat) + np.cumsum(many[keep]) - many[keep]
                self.flat = np.concatenate([self.flat, short])
            where = np.searchsorted(self.hashes, found[keep])
            self.hashes = np.insert(self.hashes, where, found[keep])
            self.start = np.insert(self.start, where, start[keep] if len(keep) == len(which) else kept)
            self.many = np.insert(self.many, where, many[keep])
        n = many[inverse]
        total = np.cumsum(n)
        ids = flat[np.arange(total[-1]) + np.repeat(start[inverse] - (total - n), n)]
        cut = np.searchsorted(first, offsets[1:])
        return ids, np.concatenate([[0], total])[cut]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each row's end) of rows of piece ids, with the mark in front as a space."""
        n = self.piece_size[ids]
        total = np.cumsum(n)
        size = int(total[-1]) if len(total) else 0
        out = self.piece_bytes[np.arange(size) + np.repeat(self.piece_end[ids] - total, n)]
        return out, np.concatenate([[0], total])[ends]

    def same(self, ids: np.ndarray, ends: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each row's pieces decode to its text."""
        got, to = self.decode(ids, ends)
        size = np.diff(offsets)
        want = np.insert(buf, offsets[:-1][size > 0], 0x20)
        until = np.cumsum(size + (size > 0))
        if len(got) == len(want) and (to == until).all() and (got == want).all():
            return np.ones(len(size), bool)
        begin, start = np.concatenate([[0], to[:-1]]), np.concatenate([[0], until[:-1]])
        return np.array([np.array_equal(got[a:b], want[c:d]) for a, b, c, d in zip(begin, to, start, until, strict=True)], bool)


def decode_ids(coder: Coder, ids: list[int]) -> str:
    """The text of piece ids; the mark put in front is dropped. Ids that are no text give U+FFFD."""
    raw = coder.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes()
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_LOADED: dict[int, Coder] = {}
keeps("pieces", _LOADED.clear)


def _coder(proto: bytes, bpe: bool) -> Coder:
    key = hash((proto, bpe))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Coder(Vocabulary.load(proto, bpe))
    return _LOADED[key]


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        proto = f.read(MAX_MODEL + 1)
    if len(proto) > MAX_MODEL:
        raise ValueError(f"{path} is larger than {MAX_MODEL} bytes")
    return held(df.sparkSession, proto)


def encode(docs: DataFrame, path: str = MODEL, bpe: bool = True) -> DataFrame:
    """docs (doc_id, text; others are ignored) -> doc_id, n_pieces, ids, roundtrip (decoding gives the text again)."""
    model = _model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model.value, bpe)
        for batch in batches:
            for start, stop, buf, offsets in W.chunks(batch.column(1), CHUNK):
                ids, ends = coder.encode(buf, offsets)
                none = batch.column(1).slice(start, stop - start).is_null()
                cuts = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids), mask=none)
                mask = none.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start),
                    pa.array(np.diff(cuts), mask=mask),
                    lists,
                    pa.array(coder.same(ids, ends, buf, offsets), mask=mask),
                ], names=["doc_id", "n_pieces", "ids", "roundtrip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean(F.col("text")).alias("text")).mapInArrow(tidy(run, "pieces"), "doc_id long, n_pieces long, ids array<int>, roundtrip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text."""
    model = _model(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model.value, True)
        for batch in batches:
            texts = [None if x is None else decode_ids(coder, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run, "pieces"), "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
