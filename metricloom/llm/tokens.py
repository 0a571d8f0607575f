"""Exact token ids of whole texts, computed once per distinct word.

The tokenizer drops white space and never joins characters across a space or a
line end, nor a letter and the punctuation after it, so a text's ids are the
ids of its words in order.  A batch of texts is split and dictionary-encoded by
Arrow, only words not seen before by this worker reach the tokenizer, and the
ids are gathered back with numpy.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that lower-casing and composition map one to one, and punctuation that no rule of the tokenizer joins to them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{}~"


class WordCache:
    """Ids of words, computed once while they fit into ``cache_words``; that bounds
    a worker's memory, not the result."""

    cache_words = 250_000

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds of a list of distinct words."""
        raise NotImplementedError

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, bounds, place of each word in them) of distinct words."""
        if len(self.known) > self.cache_words:
            self._forget()
        place = pc.index_in(words, value_set=self.known)
        new = pc.is_null(place)
        fresh = words.filter(new)
        flat, bounds = self.word_ids(fresh)
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        self.flat = np.concatenate([self.flat, flat])
        self.known = pa.concat_arrays([self.known, fresh])
        return self.flat, self.bounds, place


class WordEncoder(WordCache):
    """``encode(texts)`` equals the tokenizer's own ids for every text."""

    def __init__(self, path: str, cache_words: int = 250_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.cache_words = cache_words

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds of a list of distinct words."""
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        text = words.to_pylist()
        lengths, parts, order = np.zeros(len(text), np.int64), [], []
        rows = np.flatnonzero(plain)
        for at in range(0, len(rows), 20_000):
            some = rows[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join([text[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not mark word ends")
            lengths[some] = np.diff(stops, prepend=0)
            parts.append(ids)
            order.append(some)
        rest = np.flatnonzero(~plain)
        if len(rest):
            got = [e.ids for e in self.tokenizer.encode_batch([text[i] for i in rest], add_special_tokens=False)]
            lengths[rest] = [len(x) for x in got]
            parts.append(np.array([i for x in got for i in x], np.uint32))
            order.append(rest)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        order = np.concatenate(order)
        flat, bounds = gather(np.concatenate(parts), bounds_of(lengths[order]), np.argsort(order))
        return flat, bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts and the bounds of each text in them."""
        spaced = pc.replace_substring_regex(texts, f"([{LETTERS}])([{MARKS}])", r"\1 \2")
        words = pc.split_pattern(pc.replace_substring(spaced, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, f"^[{LETTERS}]+$")
        lowered = pc.if_else(plain, pc.utf8_lower(distinct), distinct).dictionary_encode()
        flat, bounds, place = self.lookup(lowered.dictionary)
        ids, ends = gather(flat, bounds, place[lowered.indices.to_numpy()][coded.indices.to_numpy()])
        starts = words.offsets.to_numpy()
        return ids, ends[starts - starts[0]]


def bounds_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def gather(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``rows`` of ``flat``, one after the other, and their bounds."""
    lengths = np.diff(bounds)[rows]
    ends = bounds_of(lengths)
    shift = np.repeat(bounds[rows] - ends[:-1], lengths)
    shift += np.arange(ends[-1])
    return flat[shift], ends


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder, with its words, per Python worker and file."""
    return WordEncoder(path)
