"""Piece encoding by streaming Viterbi, and decoding.

A text (spaces become the mark ▁, with one mark before it) is cut into vocabulary
pieces with the largest sum of scores.  Best paths only reach back by the longest
piece, so a window of that many boundaries is all that is kept; as soon as the
paths of all boundaries in the window run through one boundary, the ids up to it
are final and leave.  A boundary that no piece of the vocabulary spans is one
where all paths meet: texts are cut there first, equal segments are encoded once,
and short ones run through the recurrence side by side in numpy.  Long segments,
such as texts without spaces, use the streaming form.

Ties go to the longer last piece.  A character that is no piece costs the lowest
score minus ten and comes out as its bytes.

Defined cases: a null or empty text has no ids; decoding gives the text back
whole unless it holds the mark itself, which reads as a space; repeated rows are
encoded alike; columns besides ``text`` are carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import text_slices
from metricloom.llm.tokens import WordCache, bounds_of, gather

MARK = "▁"
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6  # piece types of the model file
LANE = 48  # characters of the longest segment that runs side by side
SEPARATORS = "\x00\x01\x02\x03\x04\x05\x06\x07"


class Vocabulary:
    """Pieces of a model file, as a trie of (state, character) steps."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED, UNUSED)]
        self.ids = {piece: i for i, piece, _ in pieces}
        self.scores = np.zeros(len(model.pieces) + 1)
        self.scores[[i for i, *_ in pieces]] = [s for *_, s in pieces]
        self.unknown = len(model.pieces)  # stands for a character that is no piece
        self.scores[self.unknown] = min(s for *_, s in pieces) - 10
        self.longest = max(len(piece) for _, piece, _ in pieces)
        self.bytes = np.zeros(256, np.uint32)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        pairs = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        #: No piece spans a boundary before a mark that follows another character, nor one beside a line end.
        self.cuts_at_mark = not any(a != MARK and b == MARK for a, b in pairs)
        self.cuts_at_line = not any("\n" in pair for pair in pairs)
        text = [p.piece.replace(MARK, " ").encode() for p in model.pieces]
        for value, i in enumerate(self.bytes):
            text[i] = bytes([value])
        self.text, self.text_bounds = np.frombuffer(b"".join(text), np.uint8), bounds_of(np.array([len(t) for t in text]))
        self._trie()

    def _trie(self) -> None:
        letters = sorted({c for piece in self.ids for c in piece})
        self.letter = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        steps, ends, number = {}, {}, 1
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                key = state * self.base + int(self.letter[ord(c)])
                if key not in steps:
                    steps[key] = number
                    number += 1
                state = steps[key]
            ends[state] = i
        self.steps = steps
        self.piece_of = np.full(number, -1, np.int32)
        self.piece_of[list(ends)] = list(ends.values())
        # open addressing, so that whole arrays of states step at once
        self.mask = (1 << (len(steps) * 3).bit_length()) - 1
        self.keys, self.next = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        for key, state in steps.items():
            at = self._slot(key)
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.next[at] = key, state

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 7) & self.mask

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Next states; -1 where the trie has no such step."""
        key = states * self.base + letters
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        open_ = np.flatnonzero(letters > 0)
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def expand(self, piece: int, character: str) -> list[int]:
        return [int(self.bytes[b]) for b in character.encode("utf-8", "surrogatepass")] if piece == self.unknown else [piece]


class StreamingViterbi:
    """Feed characters, take ids; ``held`` characters are not yet decided."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text: list[str] = []  # characters after the last committed boundary
        self.start = 0  # place of the first of them
        self.best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}  # boundary -> (score, previous boundary, piece)
        self.walks: list[tuple[int, int]] = []  # (start, trie state) of pieces under way
        self.end = 0

    @property
    def held(self) -> int:
        return self.end - self.start

    def push(self, character: str) -> list[int]:
        v, here = self.v, self.end
        self.text.append(character)
        self.walks.append((here, 0))
        self.end += 1
        letter, going, best = int(v.letter[ord(character)]), [], None
        single = False
        for start, state in self.walks:  # earlier starts first: ties go to the longer piece
            state = v.steps.get(state * v.base + letter) if letter else None
            if state is None:
                continue
            going.append((start, state))
            piece = int(v.piece_of[state])
            if piece >= 0:
                single |= start == here
                score = self.best[start][0] + v.scores[piece]
                if best is None or score > best[0]:
                    best = (score, start, piece)
        if not single:
            score = self.best[here][0] + v.scores[v.unknown]
            if best is None or score > best[0]:
                best = (score, here, v.unknown)
        self.best[self.end] = best
        self.walks = going
        return self._commit({start for start, _ in going} | {self.end})

    def _commit(self, alive: set[int]) -> list[int]:
        """Ids up to the last boundary that all surviving paths share."""
        paths = set(alive)
        while len(paths) > 1:  # step the latest path back until all meet
            last = max(paths)
            paths.discard(last)
            paths.add(self.best[last][1])
        meet = paths.pop()
        out = self._ids(meet)
        needed, todo = set(), list(alive)
        while todo:
            b = todo.pop()
            if b not in needed and b >= meet:
                needed.add(b)
                todo += [self.best[b][1]] if b > meet else []
        score = self.best[meet][0]
        self.best = {b: (s - score, p, x) for b, (s, p, x) in ((b, self.best[b]) for b in needed)}
        self.text, self.start = self.text[meet - self.start :], meet
        return out

    def _ids(self, boundary: int) -> list[int]:
        parts = []
        while boundary > self.start:
            _, before, piece = self.best[boundary]
            parts.append(self.v.expand(piece, self.text[before - self.start]))
            boundary = before
        return [i for part in reversed(parts) for i in part]

    def finish(self) -> list[int]:
        out = self._ids(self.end)
        self.__init__(self.v)
        return out


def stream_ids(vocabulary: Vocabulary, characters: Iterable[str]) -> Iterator[int]:
    viterbi = StreamingViterbi(vocabulary)
    for c in characters:
        yield from viterbi.push(c)
    yield from viterbi.finish()


class PieceEncoder(WordCache):
    """Ids of whole texts; segments are looked up before they are computed."""

    def __init__(self, path: str, cache_words: int = 400_000):
        super().__init__()
        self.vocabulary = Vocabulary(path)
        self.cache_words = cache_words

    def segments(self, texts: pa.Array) -> pa.Array:
        v = self.vocabulary
        free = next((c for c in SEPARATORS if not pc.any(pc.match_substring(texts, c)).as_py()), None)
        marked = pc.replace_substring(texts, " ", MARK)
        marked = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(MARK, marked.type), marked, pa.scalar("", marked.type)))
        if free is None:  # no character is free to cut at: whole texts are segments
            return pa.LargeListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int64()), marked)
        if v.cuts_at_mark:
            marked = pc.replace_substring_regex(marked, f"([^{MARK}]){MARK}", rf"\1{free}{MARK}")
        if v.cuts_at_line:
            marked = pc.replace_substring(marked, "\n", f"{free}\n{free}")
        return pc.split_pattern(marked, free)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        parts: list[np.ndarray] = []
        lengths = np.zeros(len(words), np.int64)
        n_long = int((sizes > LANE).sum())
        for i in order[:n_long]:
            ids = np.fromiter(stream_ids(self.vocabulary, words[int(i)].as_py()), np.uint32)
            parts.append(ids)
            lengths[i] = len(ids)
        for at in range(n_long, len(words), 20_000):
            rows = order[at : at + 20_000]
            ids, number = self._lanes(words.take(pa.array(rows)).to_pylist(), sizes[rows])
            parts.append(ids)
            lengths[rows] = number
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return gather(np.concatenate(parts), bounds_of(lengths[order]), np.argsort(order))

    def _lanes(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The recurrence for words of descending length, one lane each."""
        v = self.vocabulary
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, firsts = v.letter[code], np.cumsum(sizes) - sizes
        lane = np.repeat(np.arange(len(words)), sizes)
        left = sizes[lane] - (np.arange(len(code)) - firsts[lane])
        match = np.full((v.longest, len(code)), -1, np.int32)
        going, states = np.arange(len(code)), np.zeros(len(code), np.int64)
        for k in range(v.longest):
            inside = left[going] > k
            going, states = going[inside], states[inside]
            states = v.step(states, letters[going + k])
            going, states = going[states >= 0], states[states >= 0]
            match[k, going] = v.piece_of[states]
            if not len(going):
                break
        match[0][match[0] < 0] = v.unknown
        longest = int(sizes[0]) if len(sizes) else 0
        best = np.full((longest + 1, len(words)), -np.inf)
        back, piece = np.zeros((longest + 1, len(words)), np.int64), np.zeros((longest + 1, len(words)), np.int32)
        best[0] = 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # lanes longer than p
        for p in range(longest):
            n = active[p]
            at = firsts[:n] + p
            for k in range(min(v.longest, longest - p)):
                m = match[k, at]
                r = np.flatnonzero(m >= 0)
                if not len(r):
                    continue
                score = best[p, r] + v.scores[m[r]]
                better = score > best[p + k + 1, r]
                r, score = r[better], score[better]
                best[p + k + 1, r], back[p + k + 1, r], piece[p + k + 1, r] = score, p, m[r]
        rows = np.flatnonzero(sizes > 0)
        ends, found = sizes[rows], []
        while len(rows):
            found.append((rows, back[ends, rows], piece[ends, rows]))
            ends = back[ends, rows]
            rows, ends = rows[ends > 0], ends[ends > 0]
        rows, starts, ids = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in (list(zip(*found)) or [(), (), ()]))
        order = np.lexsort((starts, rows))
        rows, starts, ids = rows[order], starts[order], ids[order].astype(np.uint32)
        unknown = ids == v.unknown
        width = np.ones(len(ids), np.int64)
        wide = code[firsts[rows[unknown]] + starts[unknown]]
        width[unknown] = 1 + (wide > 0x7F) + (wide > 0x7FF) + (wide > 0xFFFF)
        out = np.repeat(ids, width)
        if unknown.any():
            spelled = "".join(map(chr, wide)).encode("utf-8", "surrogatepass")
            out[np.repeat(unknown, width)] = v.bytes[np.frombuffer(spelled, np.uint8)]
        return out, np.bincount(rows, width, len(words)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts and the bounds of each text in them."""
        lists = self.segments(texts)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        flat, bounds, place = self.lookup(coded.dictionary)
        ids, ends = gather(flat, bounds, place[coded.indices.to_numpy()])
        starts = lists.offsets.to_numpy()
        return ids, ends[starts - starts[0]]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of consecutive ranges of ids; broken byte sequences are replaced."""
        v = self.vocabulary
        raw, ends = gather(v.text, v.text_bounds, ids.astype(np.int64))
        ends = ends[bounds]
        data = raw.tobytes()
        texts = [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return pa.array(texts, pa.large_string())


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder, with its segments, per Python worker and file."""
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` (array<int>); no shuffle."""
    plain = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, bounds = encoder.encode(texts)
                lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "ids"])

    return plain.mapInArrow(run, plain.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode_pieces(coded: DataFrame, path: str, output: str = "decoded") -> DataFrame:
    """``coded`` (ids, ...) with the text of the ids; no shuffle."""
    plain = coded.drop(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                lists = part.column("ids").cast(pa.large_list(pa.int32()))
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = encoder.decode(lists.flatten().to_numpy(), bounds_of(size))
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], [*part.schema.names, output])

    return plain.mapInArrow(run, plain.withColumn(output, F.lit("")).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip): ids and decoded texts are made and
    compared where they are, so that only digests leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, bounds = encoder.encode(texts)
                same = pc.equal(encoder.decode(ids, bounds), pc.replace_substring(texts, MARK, " "))
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), same], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
