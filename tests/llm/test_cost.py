"""Inner steps give what a plain way gives, in a part of its time."""

from time import process_time

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import blocks, ngram_join
from tidemark.llm.queries import WORD_BPE
from tidemark.llm.word_bpe import Encoder
from tidemark.llm.words import Words, word_hashes


def _least_seconds(run, times: int = 3) -> float:
    spent = []
    for _ in range(times):
        before = process_time()
        run()
        spent.append(process_time() - before)
    return min(spent)


def _plain_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Shingles by a dictionary of words and np.unique."""
    words, out = Words(texts), []
    for a, b in zip(words.starts[:-1], words.starts[1:]):
        own = words.hashes[words.ids[a:b]]
        rolled = own[: max(0, len(own) - width + 1)]
        for k in range(1, width):
            rolled = blocks.mix(rolled, own[k : k + len(rolled)])
        out.append(np.unique(rolled))
    return out


def test_shingle_sets_take_less_time_than_a_plain_way():
    rng = np.random.default_rng(3)
    known = np.array([rng.bytes(3 + k % 6).hex().encode() for k in range(60_000)])
    texts = [b" ".join(x) for x in known[rng.integers(0, len(known), (300, 2_000))].tolist()]
    for one, two in zip(ngram_join.shingle_sets(texts), _plain_sets(texts, 5), strict=True):
        assert np.array_equal(one, two)
    assert _least_seconds(lambda: ngram_join.shingle_sets(texts)) < 0.7 * _least_seconds(lambda: _plain_sets(texts, 5))


def test_word_hashes_of_odd_texts():
    texts = [b"", b" \t\n", b" A b\x0b\x0cC\r\n", "Ä \x1c a\x85b \xa0 Ż".encode(), b"\xff\xfe A\x00b", b"one One ONE"]
    for some in ([], texts[:1], texts[:2], texts):
        hashes, starts = word_hashes(some)
        words = Words(some)
        assert starts.tolist() == words.starts.tolist()
        assert hashes.tolist() == (words.hashes[words.ids].tolist() if len(words.ids) else [])


def test_new_words_take_less_time_than_word_by_word():
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCÉßñ"))
    known = ["".join(x) + tail for x, tail in zip(rng.choice(letters, (40_000, 9)), rng.choice(["", "", ",", ".***", "!?"], 40_000))]
    texts = [" ".join(x) for x in np.array(known)[rng.integers(0, len(known), (300, 2_000))].tolist()]
    tokenizer = Tokenizer.from_file(WORD_BPE)

    def plain() -> list[bytes]:
        """Distinct words one by one, texts joined from a dictionary."""
        split = [x.split() for x in texts]
        words = list(set().union(*split))
        ids = {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False))}
        return [b"".join(map(ids.__getitem__, x)) for x in split]

    encoders = [Encoder(WORD_BPE) for _ in range(3)]  # each sees the words for the first time
    assert Encoder(WORD_BPE).encode(texts) == plain()
    assert _least_seconds(lambda: encoders.pop().encode(texts)) < 0.8 * _least_seconds(plain)


def test_word_encoder_on_odd_words():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.encode_special_tokens = True
    texts = ["", " ", "a\x1cb \x1f\x85 c", "Foo's Bar'S don't, 'tis a'\"b", "É×Ü a÷b İx ıY", "Ⱥbc Ǆx ǅ ß ẞ ŉ e\u0301 É,", "a,, b.*** .a a.b <s> </s> f</w>", "ªº µm 1a a1 1,2", "日本語\u3000テ。 😀a", "\x00 a\x00 \x7f a\x7f", "x" * 5_000 + "!" * 300, "ΑΣ ΑΣ. Σ"]
    texts += [f"x{chr(c)} {chr(c)}. Y{chr(c)}z" for c in range(1, 0x400)]
    encoder = Encoder(WORD_BPE)
    for _ in range(2):  # new, then held
        assert encoder.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.encode([]) == [] and encoder.encode([None]) == [b""]
