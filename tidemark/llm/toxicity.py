"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A token's input is the embedding of its word (words of the training texts) plus the mean embedding of its
hashed character trigrams, so inflected and unseen words count. All overlapping windows of a text are scored;
a text's score is a calibrated function of its highest window. Training is numpy on the driver, on a bounded
sample of labelled rows. Windows of toxic texts are chosen by smoothed word and trigram log-odds, since labels
are given for whole texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, memory
from .bpe import slices

SAMPLE = (1_500, 3_000)  # bound of labelled rows to learn from: toxic, clean
LONGEST = 100_000  # bytes of a text to learn from at most, so the sample is bounded in bytes; scores take texts of any length
WINDOW, STRIDE = 24, 12
WORD_ROWS, GRAM_ROWS, INPUT, HIDDEN = 8_192, 4_096, 12, 8
EPOCHS, STEPS, BATCH, RATE = 4, 150, 256, 0.02  # epochs; more where they make fewer steps
SLICE_BYTES = 3_000_000
LANES = 8_192  # windows that run through the network at once
#: ASCII signs that separate words, besides white space.
SIGNS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(SIGNS).split()


class Tokens:
    """Words of several texts by local id, with each distinct word's row and trigram rows."""

    def __init__(self, texts: list[bytes], known: dict[bytes, int]):
        vocabulary: dict[bytes, int] = {}
        parts = []
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
        self.size = np.array([len(x) for x in parts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.words = list(vocabulary)
        self.rows = np.fromiter((known.get(w, 0) for w in self.words), np.int64, len(self.words))
        self.grams, self.gram_word = trigram_rows(self.words)


def trigram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of all trigrams of <word>, and the word of each."""
    size = np.array([len(w) for w in words], np.int64)
    symbols = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.int64)
    if not len(symbols):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = symbols[:-2] << 16 | symbols[1:-1] << 8 | symbols[2:]
    word = np.repeat(np.arange(len(words)), size + 2)
    same = word[:-2] == word[2:]
    return (code[same] * 2654435761 >> 7) % GRAM_ROWS, word[:-2][same]


def windows(size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, tokens) of all overlapping windows; each token lies in one at least."""
    count = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = begin[text] + k * STRIDE
    return text, first, np.minimum(WINDOW, begin[text] + size[text] - first)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row, of ``n`` rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        begin = np.flatnonzero(np.diff(rows[order], prepend=-1))
        out[rows[order][begin]] = np.add.reduceat(values[order], begin)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and passes; gates are stacked as update, reset, candidate for both directions."""

    def __init__(self, seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, INPUT, scale=0.1), "gram": draw(GRAM_ROWS, INPUT, scale=0.1), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32), "attend": draw(2 * h, scale=0.3)}
        for d in "fb":
            self.p |= {f"w{d}": draw(INPUT, 3 * h, scale=0.3), f"u{d}": draw(h, 3 * h, scale=0.3), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p["word"][0] = 0
        self.known: dict[bytes, int] = {}
        self.scale = np.array([1.0, 0.0])

    def embed(self, tokens: Tokens) -> np.ndarray:
        """Input of each distinct word."""
        n = len(tokens.words)
        total = np.zeros((n, INPUT), np.float32)
        count = np.bincount(tokens.gram_word, minlength=n)
        begin = np.cumsum(count) - count
        if len(tokens.grams):
            total = np.add.reduceat(self.p["gram"][tokens.grams], begin)  # each word has a trigram at least
        return total / np.maximum(count, 1)[:, None].astype(np.float32) + self.p["word"][tokens.rows]

    def run(self, gates: dict[str, np.ndarray], ids: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows. gates: projected input of each word and direction; ids: (windows, WINDOW)."""
        n, h, p = len(ids), HIDDEN, self.p
        states, saved = {}, {}
        live = [length > t for t in range(ids.shape[1])]
        for d in "fb":
            x, state = gates[d], np.zeros((n, h), np.float32)
            out = np.zeros((ids.shape[1], n, h), np.float32)
            saved[d] = [None] * ids.shape[1]
            for t in range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1):
                g = x[ids[:, t]]
                zr = _sigmoid(g[:, : 2 * h] + state @ p[f"u{d}"][:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                candidate = np.tanh(g[:, 2 * h :] + (r * state) @ p[f"u{d}"][:, 2 * h :])
                new = np.where(live[t][:, None], z * state + (1 - z) * candidate, state)
                if keep:
                    saved[d][t] = (state, z, r, candidate)
                state = new
                out[t] = state
            states[d] = out
        both = np.concatenate([states["f"], states["b"]], 2)
        energy = np.where(np.stack(live), both @ p["attend"], -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * both).sum(0)
        logit = pooled @ p["out"] + p["bias"]
        return (logit, both, weight, pooled, saved, live) if keep else logit

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {d: inputs @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, tokens: Tokens, inputs: np.ndarray, ids: np.ndarray, length: np.ndarray, y: np.ndarray):
        """Loss and gradients of a batch; ids are local to ``tokens``."""
        p, h = self.p, HIDDEN
        logit, both, weight, pooled, saved, live = self.run(self.gates(inputs), ids, length, keep=True)
        probability = _sigmoid(logit)
        loss = -np.mean(np.where(y > 0, np.log(probability + 1e-7), np.log(1 - probability + 1e-7)))
        dlogit = ((probability - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["out"]
        dweight = (both * dpooled).sum(2)
        denergy = weight * (dweight - (weight * dweight).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", denergy, both)
        dboth = weight[:, :, None] * dpooled + denergy[:, :, None] * p["attend"]
        dx = np.zeros((*ids.T.shape, inputs.shape[1]), np.float32)
        for k, d in enumerate("fb"):
            u, dstate = p[f"u{d}"], np.zeros((len(y), h), np.float32)
            du, dw, dc = np.zeros_like(u), np.zeros_like(p[f"w{d}"]), np.zeros(3 * h, np.float32)
            steps = range(ids.shape[1])
            for t in reversed(steps) if d == "f" else steps:
                state, z, r, candidate = saved[d][t]
                dnew = dstate + dboth[t][:, k * h : (k + 1) * h]
                on = live[t][:, None]
                dz, dcandidate = dnew * (state - candidate) * z * (1 - z), dnew * (1 - z) * (1 - candidate**2)
                dreset = dcandidate @ u[:, 2 * h :].T
                dr = dreset * state * r * (1 - r)
                dgate = np.where(on, np.concatenate([dz, dr, dcandidate], 1), 0).astype(np.float32)
                du[:, : 2 * h] += state.T @ dgate[:, : 2 * h]
                du[:, 2 * h :] += (r * state).T @ dgate[:, 2 * h :]
                x = inputs[ids[:, t]]
                dw += x.T @ dgate
                dc += dgate.sum(0)
                dx[t] += dgate @ p[f"w{d}"].T
                dstate = np.where(on, dnew * z + dreset * r + dgate[:, : 2 * h] @ u[:, : 2 * h].T, dnew)
            g |= {f"u{d}": du, f"w{d}": dw, f"c{d}": dc}
        dinput = _summed(ids.T.ravel(), dx.reshape(-1, dx.shape[2]), len(inputs))
        g["word"] = _summed(tokens.rows, dinput, WORD_ROWS)
        g["word"][0] = 0
        share = 1 / np.maximum(np.bincount(tokens.gram_word, minlength=len(tokens.words)), 1)
        g["gram"] = _summed(tokens.grams, dinput[tokens.gram_word] * share[tokens.gram_word, None].astype(np.float32), GRAM_ROWS)
        return loss, g

    def window_logits(self, tokens: Tokens, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        gates, out = self.gates(self.embed(tokens)), np.empty(len(first), np.float32)
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(first), LANES):
            at = order[k : k + LANES]
            out[at] = self.run(gates, _window_ids(tokens, first[at], int(length[at].max())), length[at])
        return out

    def highest(self, texts: list[bytes]) -> np.ndarray:
        """Highest window logit of each text; of no words, -inf."""
        tokens = Tokens(texts, self.known)
        text, first, length = windows(tokens.size, tokens.begin)
        out = np.full(len(texts), -np.inf)
        if len(text):
            np.maximum.at(out, text, self.window_logits(tokens, first, length))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        top = self.highest(texts)
        return np.where(np.isfinite(top), _sigmoid(self.scale[0] * np.where(np.isfinite(top), top, 0) + self.scale[1]), 0.0)


def _window_ids(tokens: Tokens, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    at = first[:, None] + np.arange(width)
    return tokens.ids[np.minimum(at, len(tokens.ids) - 1)]


def _log_odds(rows: np.ndarray, text: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smoothed log-odds of a feature's presence in toxic against clean texts, shrunk when rare."""
    pair = np.unique(rows * len(y) + text)
    feature, label = pair // len(y), y[pair % len(y)]
    toxic, clean = (np.bincount(feature, label == k, n) for k in (1, 0))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((y == 0).sum() + 1))
    return odds * (toxic + clean > 2)


def train(texts: list[bytes], y: np.ndarray, seed: int = 7) -> Network:
    """Fit the network on whole texts and their labels (0 or 1)."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.scale = np.array([0.0, 6.0 if len(y) and y.max() == 1 else -6.0])
        return net
    tokens = Tokens(texts, {})
    owner = np.repeat(np.arange(len(texts)), tokens.size)
    odds = _log_odds(tokens.ids.astype(np.int64), owner, y, len(tokens.words))
    presence = np.bincount(tokens.ids, minlength=len(tokens.words))
    order = np.lexsort((xxhashes(tokens.words), -np.abs(odds), presence <= 2))[: WORD_ROWS - 1]
    net.known = {tokens.words[i]: k + 1 for k, i in enumerate(order.tolist())}
    tokens.rows = np.fromiter((net.known.get(w, 0) for w in tokens.words), np.int64, len(tokens.words))
    # a window's worth: its best word, by the word's own and its best trigram's log-odds
    gram_odds = _log_odds(tokens.grams, tokens.gram_word, (np.bincount(tokens.ids, y[owner], len(tokens.words)) > 0.6 * presence).astype(int), GRAM_ROWS)
    best_gram = np.zeros(len(tokens.words))
    np.maximum.at(best_gram, tokens.gram_word, gram_odds[tokens.grams])
    worth = odds + 0.2 * best_gram
    text, first, length = windows(tokens.size, tokens.begin)
    value = np.empty(len(first))
    for k in range(0, len(first), LANES):
        some = worth[_window_ids(tokens, first[k : k + LANES])]
        value[k : k + LANES] = np.where(np.arange(WINDOW) < length[k : k + LANES, None], some, -9).max(1)
    label = y[text]
    for turn in range(2):  # the second turn chooses windows by the network itself
        order = np.lexsort((-value, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        top = order[(rank < 2) & (label[order] == 1) & ((rank == 0) | (value[order] > np.quantile(value[label == 0], 0.995)))]
        clean = np.flatnonzero(label == 0)
        hard = clean[np.argsort(-value[clean], kind="stable")[: len(top)]]
        some = rng.choice(clean, min(len(clean), 2 * len(top) + 500), replace=False)
        chosen = np.concatenate([top, hard, some])
        _fit(net, tokens, first[chosen], length[chosen], label[chosen], rng, EPOCHS if turn == 0 else EPOCHS // 2)
        value = net.window_logits(tokens, first, length)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, value)
    seen = np.isfinite(top)
    net.scale = _calibrated(top[seen], y[seen])
    return net


def xxhashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _fit(net: Network, tokens: Tokens, first, length, y, rng, epochs: int) -> None:
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    epochs = max(epochs, -(-STEPS * BATCH // max(len(y), BATCH)))
    step, total = 0, epochs * max(1, len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order) - BATCH // 2 + 1 or 1, BATCH):
            at = order[k : k + BATCH]
            ids = _window_ids(tokens, first[at])
            found, local = np.unique(ids, return_inverse=True)
            part = Part(tokens, found)
            _, g = net.gradients(part, net.embed(part), local.reshape(ids.shape), length[at], y[at].astype(np.float32))
            step += 1
            rate = RATE * (1 - step / (total + 2)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, value in g.items():
                m[name] += 0.1 * (value - m[name])
                s[name] += 0.001 * (value**2 - s[name])
                net.p[name] -= (rate * m[name] / (np.sqrt(s[name]) + 1e-6)).astype(np.float32)


class Part:
    """The distinct words of a batch, as ``Tokens`` has them."""

    def __init__(self, tokens: Tokens, found: np.ndarray):
        self.words = found
        self.rows = tokens.rows[found]
        begin = np.searchsorted(tokens.gram_word, found)
        count = np.searchsorted(tokens.gram_word, found, side="right") - begin
        self.gram_word = np.repeat(np.arange(len(found)), count)
        self.grams = tokens.grams[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def _calibrated(top: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic function of the highest logit, by Newton steps with a small ridge."""
    x, w = np.stack([top, np.ones(len(top))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = np.clip(_sigmoid(x @ w), 1e-6, 1 - 1e-6)
        gradient = x.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
        w[0] = np.clip(w[0], 0.05, 5.0)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, held_out_of: int = 5) -> Network:
    """Train on labelled ``docs`` outside the held-out fold: at most ``sample`` toxic and clean rows by a hash of the id,
    of at most LONGEST bytes each. Without labels of both kinds all scores are alike: of no labels, or clean ones, low."""
    usable = labels.where((F.crc32(F.col("doc_id").cast("string")) % held_out_of != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, sample[0]), (0, sample[1]))]
    drawn = F.broadcast(drawn[0].union(drawn[1]).withColumnRenamed("doc_id", "__labelled"))  # as many rows as ``sample`` at most
    rows = docs.select("doc_id", F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8").alias("body")).join(drawn, F.col("doc_id") == F.col("__labelled"))
    found = rows.where(F.length("body") <= LONGEST).select("doc_id", "body", "toxic").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    texts, y = [bytes(x) for x in found["body"]], found["toxic"].to_numpy(np.int64)
    del found
    network = train(texts, y)
    memory.release()
    return network


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` (text and any other columns) with ``score``: every window of every whole text goes through the network.

    A null or empty text, or one without words, has score 0. All columns pass through as they are, whatever their
    names; where one is called score, the new one is score_1, or the first such name that is free. Rows come back as
    often as they occur, of an empty table none. Texts of any length are taken whole, one at a time if need be.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # parameters of fixed size
    names, own = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    text = own[names.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                score = shared.value.score(blocks.texts_of(pa.Table.from_batches([part]), text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "__score"])

    held = docs.toDF(*own)
    held = held.withColumn(text, F.col(text).cast("string"))
    schema = ", ".join(f"{c} {t}" for c, t in held.dtypes)
    return held.mapInArrow(run, f"{schema}, __score double").toDF(*names, score_name(names))


def score_name(columns: list[str]) -> str:
    """The column that ``scored`` adds to these."""
    taken = {c.lower() for c in columns}
    return next(c for c in ("score", *(f"score_{i}" for i in range(1, len(columns) + 2))) if c not in taken)


def judged(docs: DataFrame, network: Network, held_out_of: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) for every row of ``docs``; null ids are held out.

    Other columns are ignored. Null, empty, repeated and very long texts, and empty tables, as in ``scored``.
    """
    found = scored(docs.select("doc_id", "text"), network)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_of == 0, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns untouched; a score of 0.5 goes. An empty table gives none."""
    added = score_name(docs.columns)
    return scored(docs, network).where(F.col(added) < 0.5).drop(added)
