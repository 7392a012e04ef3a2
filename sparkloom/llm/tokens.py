"""Exact tokenizer output through a word memo.

The vocabulary's pre-tokenizer never joins text across white space, so the ids
of a text are the ids of its words, cut at ASCII white space, in turn. Each distinct
word is encoded once by the tokenizers library and then looked up. To have fewer
distinct words, texts are lower-cased first, as the vocabulary's normalizer does
itself, and ASCII punctuation between a letter and white space is set apart, where the
pre-tokenizer cuts anyway. The normalizer composes (NFC) before it lower-cases, so a
text is lower-cased first only if it and its lower-cased form are composed already.

Nulls are the caller's: it passes an empty text, which has no ids. Equal texts have equal ids,
and a text of any length is coded whole.
"""

from __future__ import annotations

import os
import re
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

_TAIL = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[^\W\d_].)(?=\s)")


#: Characters of a call: the more at once, the fewer lookups and the larger a call's arrays.
CHUNK = 1 << 20
#: Words given to the tokenizer at once: what it returns for a word takes many times the word's ids.
SLICE = 8192


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def apart(text: str) -> str:
    """A text with the same ids and fewer distinct words.

    The final sigma depends on context, so texts with one are left alone, and so are those whose
    composed form depends on whether they are lower-cased before or after.
    """
    if "\u03a3" in text or "<|" in text:
        return text
    low = text.lower()
    if not text.isascii() and not (is_normalized("NFC", text) and is_normalized("NFC", low)):
        return text
    return _TAIL.sub(r" \g<0>", low)


class WordMemo:
    """ids(texts) gives what ``encode(text, add_special_tokens=False)`` gives, as one array and its row offsets.

    At most ``limit`` words are remembered, but for those of a single call; when
    full, the half that was used most stays.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = None
        if any(t.endswith("</w>") for t in vocabulary):
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.index: dict[str, int] = {}
        self.held, self.data = 0, np.empty(1 << 16, np.uint32)
        #: Of every word: place and number of its ids, times it was used.
        self.places = np.zeros((3, 1 << 14), np.int64)

    def encode_all(self, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids of words that stand by themselves, one after another, and how many each has.

        letters: every word is one pre-token, so its last id is the one that ends a word.
        """
        if not letters or self.ends is None:
            rows = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((i for r in rows for i in r), np.uint32), np.fromiter(map(len, rows), np.int64, len(rows))
        joined = [" ".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        cut = np.flatnonzero(self.ends[ids])
        if len(cut) != len(words):
            return self.encode_all(words, False)
        return ids, np.diff(cut, prepend=-1)

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        for group, letters in ((plain, True), ([w for w in words if not w.isalpha()], False)):
            for k in range(0, len(group), SLICE):
                part = group[k : k + SLICE]
                ids, lengths = self.encode_all(part, letters)
                n, m, held, more = len(self.index), len(part), self.held, len(ids)
                if n + m > self.places.shape[1]:
                    self.places = np.concatenate([self.places, np.zeros((3, max(m, self.places.shape[1])), np.int64)], 1)
                if held + more > len(self.data):
                    self.data = np.concatenate([self.data, np.empty(max(more, len(self.data)), np.uint32)])
                self.data[held : held + more] = ids
                self.places[0, n : n + m] = held + np.cumsum(lengths) - lengths
                self.places[1, n : n + m] = lengths
                self.places[2, n : n + m] = 0
                self.held += more
                self.index.update(zip(part, range(n, n + m), strict=True))

    def shrink(self) -> None:
        n = len(self.index)
        begin, length, used = self.places[:, :n]
        keep = np.zeros(n, bool)
        keep[np.argpartition(-used, self.limit // 2)[: self.limit // 2]] = True
        place = np.cumsum(keep) - 1
        self.index = {w: int(place[i]) for w, i in self.index.items() if keep[i]}
        begin, length, used = begin[keep], length[keep], used[keep] >> 1
        at = np.cumsum(length) - length
        self.held = int(length.sum())
        self.data[: self.held] = self.data[np.repeat(begin - at, length) + np.arange(self.held)]
        self.places[:, : len(at)] = at, length, used

    def find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array([apart(t) for t in items], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        rows = self.find(words)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            if len(self.index) + len(missing) > self.limit and len(self.index) > self.limit // 2:
                self.shrink()
                self.learn(list(set(words).difference(self.index)))
                rows = self.find(words)
            else:
                new = [words[i] for i in missing.tolist()]
                self.learn(new)
                rows[missing] = self.find(new)
        self.places[2, rows] += np.bincount(codes, minlength=len(words))
        rows = rows[codes]
        begin, length = self.places[0, rows], self.places[1, rows]
        upto = np.concatenate([[0], np.cumsum(length)])
        kind = np.int32 if max(self.held, upto[-1]) < 1 << 31 else np.int64
        at = np.repeat((begin - upto[:-1]).astype(kind), length)
        at += np.arange(upto[-1], dtype=kind)
        flat = self.data[at] if len(at) else np.empty(0, np.uint32)
        return flat, upto[split.offsets.to_numpy()].astype(np.int64)


def memo(path: str) -> WordMemo:
    """The worker's memo, kept between tasks."""
    return common.held(f"tokens {path}", lambda: WordMemo(path))
