"""Ids of the public word-level BPE tokenizer for whole texts, by runs without white space and a bounded cache.

The tokenizer drops white space before it looks at words and never joins across it, so a text's ids are those of its runs in a
row. It lower-cases, and a run of marks is a word of its own; so runs that differ in the case of ASCII letters, or in marks at
their end, share what the cache holds. Runs that the cache lacks go to the tokenizers library together.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from .common import Rolling, SliceCache, per_text, words


_BETWEEN = b"<|startoftext|>"
_UPPER, _MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_MARK[list(b".,!?;:")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, but those before other characters than ASCII and Latin-1 letters, which may combine with them."""
    behind = np.append(data[1:], np.uint8(0)) if len(data) else data
    return np.where(_UPPER[data] & ((behind < 0x80) | (behind == 0xC3)), data + np.uint8(32), data)


def cut_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same runs; marks at the end of one are a run of their own where an ASCII letter or digit or a Latin-1 letter is before."""
    last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[ends - 1]
    at = np.maximum(last, 0)
    letter = _ALNUM[data[at]] | ((data[np.maximum(at - 1, 0)] == 0xC3) & (data[at] >= 0x80) & (data[at] != 0x97) & (data[at] != 0xB7))
    cut = np.flatnonzero((last >= starts) & (last + 1 < ends) & letter)
    stops = ends.copy()
    stops[cut] = last[cut] + 1
    return np.insert(starts, cut + 1, last[cut] + 1), np.insert(stops, cut + 1, ends[cut]), np.insert(owner, cut + 1, owner[cut])


class WordBpe:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.between = self.tokenizer.token_to_id(_BETWEEN.decode())
        self.rolling, self.cache = Rolling(5), SliceCache(self._compute, 21)

    def _alone(self, slices: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([s.decode("utf-8") for s in slices], add_special_tokens=False)]

    def _compute(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and counts. Slices are encoded with a special token between them, which ends what is before it."""
        if any(_BETWEEN in s for s in slices):
            got = self._alone(slices)
            counts = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum())), counts
        parts, counts = [], []
        for first in range(0, len(slices), 2000):
            some = slices[first : first + 2000]
            ids = np.array(self._alone([_BETWEEN.join(some)])[0], np.uint32)
            mark = ids == self.between
            parts.append(ids[~mark])
            counts.append(np.diff(np.concatenate(([-1], np.flatnonzero(mark), [len(ids)]))) - 1)
        return np.concatenate(parts), np.concatenate(counts)

    def encode_block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block in a row, and where each text's begin and end."""
        starts, ends, owner = words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if b"<|" not in raw:  # special tokens hold marks and letters in one case
            data = lower(data)
            raw = data.tobytes()
            starts, ends, owner = cut_marks(data, starts, ends, owner)
        hashes = self.rolling.slices(self.rolling.prefix(data), starts, ends)
        ids, counts = self.cache.rows(hashes, raw, starts, ends)
        return ids, per_text(counts, np.searchsorted(owner, np.arange(len(offsets))))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with an end id after each."""
    out = np.insert(ids, bounds[1:], end)
    return out, bounds + np.arange(len(bounds))
