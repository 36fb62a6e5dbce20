"""Words of a text: lower-cased A-Z, split at ASCII white space, as 64-bit hashes."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


class Words:
    """Words of several texts as local ids, with one hash per distinct word.

    ``ids`` has all texts one after the other; text k's words are ids[starts[k]:starts[k + 1]].
    bytes.split() splits at exactly the white space [\\x20\\x09-\\x0D] and bytes.lower() changes only A-Z.
    """

    def __init__(self, texts: list[bytes], first: tuple[bytes, ...] = (), last: tuple[bytes, ...] = (), lower: bool = True):
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        get = vocabulary.__getitem__
        parts = []
        for text in texts:
            words = [*first, *(text.lower() if lower else text).split(), *last]
            parts.append(np.fromiter(map(get, words), np.int32, len(words)))
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int64)
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.words = list(vocabulary)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of several texts, one after the other, and starts as in ``Words``, with the same hashes.

    Arrow splits and lower-cases by the same rules and numbers the words, so that none but distinct ones become objects.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    word = pc.binary_length(split.values).to_numpy() > 0  # space at an end of a text leaves an empty one
    starts = np.concatenate([[0], np.cumsum(word, dtype=np.int64)])[split.offsets.to_numpy()]
    coded = split.values.dictionary_encode()
    distinct = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)  # bytes objects, sooner than by to_pylist
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[coded.indices.to_numpy()[word]], starts
