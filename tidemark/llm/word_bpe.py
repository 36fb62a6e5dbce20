"""Token ids of whole texts by a ``tokenizers`` file, with the ids of each distinct word computed once.

Valid for tokenizers that drop white space and never merge across it: the ids of a text are then those of its
white-space separated words, one after the other. ``Encoder`` checks that on the file's own description.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import memory
from .piece_cache import PieceCache, gather, keys_of

BATCH = 20_000  # distinct words that are encoded at once
JOINED = 200  # words of letters that are encoded as one text
TEXT_BYTES = 8_000_000  # of the texts that are split at once
# Bytes of words: of letters from U+0100 to U+023F, ASCII letters and those from U+00C0 on; signs that only join other
# signs, so no apostrophe; all others. Words with others are left to the tokenizer whole.
LETTER, SIGN, OTHER = 0, 1, 2
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER
KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x != ord("'")]] = SIGN
#: The times and division signs; U+0130, whose lower case is two characters.
NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        told = json.loads(self.tokenizer.to_str())
        split = [x for x in (told["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if not (split and split[0]["invert"] and split[0]["behavior"] == "Removed"):
            raise ValueError("the tokenizer keeps white space, so words can't be encoded one by one")
        vocabulary = self.tokenizer.get_vocab()
        suffix = told["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.cache = PieceCache(lambda words: [])  # only its arrays are used

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        found = [x.ids for k in range(0, len(words), BATCH) for x in self.tokenizer.encode_batch_fast(words[k : k + BATCH], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(x) for x in found], np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, and how many each has; many are one text, in which each ends with an end of word."""
        flat, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(words), JOINED * 100):
            some = words[k : k + JOINED * 100]
            joined = [" ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(some):
                ids, size = self._one_by_one(some)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has; letters and signs after them are encoded apart, as the tokenizer's own pattern splits them."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = KIND[data]
        for one, two in NO_LETTERS:
            kind[:-1][(data[:-1] == one) & (data[1:] == two)] = OTHER
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: E731  in each word
        back = np.concatenate([[True], kind[:-1] != LETTER]) & (kind == LETTER)  # a letter after a sign or at the start
        back[ends[:-1]] = False
        signs = count(kind == SIGN)
        plain = (kind[ends[:-1]] == LETTER) & (count(kind == OTHER) == 0) & (count(back) == 0)
        own = np.repeat(plain, np.diff(ends))

        def strings(bytes_: np.ndarray, sizes: np.ndarray) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(bytes_))

        base = pc.utf8_lower(strings(data[own & (kind == LETTER)], (np.diff(ends) - signs)[plain])).dictionary_encode()
        tail = strings(data[own & (kind == SIGN)], signs[plain]).dictionary_encode()
        names = base.dictionary.to_numpy(zero_copy_only=False)
        at = self.cache.find(keys_of(names))
        here, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        held, held_size = self.cache.held(at[here])
        parts = [(held.view(np.uint32), held_size // 4), self._letters(names[new].tolist()), self._one_by_one(tail.dictionary.to_pylist()), self._one_by_one(words.filter(pa.array(~plain)).to_pylist())]
        pool, size = (np.concatenate(x) for x in zip(*parts))
        begin = np.cumsum(size) - size
        number = np.empty(len(names), np.int64)  # of each base in the pool
        number[here], number[new] = np.arange(len(here)), np.arange(len(here), len(names))
        tails = len(names) + len(tail.dictionary)
        which = np.zeros((len(words), 2), np.int64)
        which[plain, 0], which[plain, 1] = number[base.indices.to_numpy()], len(names) + tail.indices.to_numpy()
        which[~plain, 0] = np.arange(tails, len(size))
        sizes = size[which]
        sizes[~plain, 1] = 0
        return gather(pool, begin[which].ravel(), sizes.ravel()), sizes.sum(1)

    def _joined(self, texts: list[str]) -> list[bytes]:
        array = pa.array(texts, pa.large_string())
        data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
        # Unicode's white space has these as well, which the tokenizer takes for ordinary characters
        control = bool(((data >= 0x1C) & (data <= 0x1F)).any())
        split = (pc.ascii_split_whitespace if control else pc.utf8_split_whitespace)(array)
        word = pc.binary_length(split.values).to_numpy() > 0  # space at an end of a text leaves an empty one
        coded = split.values.filter(pa.array(word)).dictionary_encode()
        keys = keys_of(coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False))
        at = self.cache.find(keys)
        here, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        flat, size = self.cache.held(at[here])
        pool, sizes = flat.view(np.uint32), np.zeros(len(keys), np.int64)
        sizes[here] = size // 4
        if len(new):
            fresh, sizes[new] = self._encode(coded.dictionary.take(pa.array(new)))
            self.cache.hold(keys[new], fresh.view(np.uint8), 4 * sizes[new])
            pool = np.concatenate([pool, fresh])
        order, begin = np.concatenate([here, new]), np.empty(len(keys), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        number = coded.indices.to_numpy()
        ids = gather(pool, begin[number], sizes[number]).astype("<u4", copy=False).tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes[number])])
        cuts = (4 * upto[np.concatenate([[0], np.cumsum(word)])[split.offsets.to_numpy()]]).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        memory.used()
        out, held, size = [], [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TEXT_BYTES:
                out += self._joined(held)
                held, size = [], 0
        return out + self._joined(held) if held else out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


memory.on_release(_encoder.cache_clear)


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process, so tasks share what is cached; what others have left goes."""
    memory.release(_encoder.cache_clear)
    return _encoder(path)
