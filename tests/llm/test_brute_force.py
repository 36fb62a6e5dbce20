"""Models and packings against plain versions written from their definitions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import labelled_prose
from tidemark.llm import lm, packing, quality, token_output, toxicity
from tidemark.llm.queries import WORD_BPE, with_end

TEXTS = ["abab abc cab cab cab", "aab bca  abc\tabd", "xyz zyx abc", "dada dad add", "a", ""]


def plain_kneser_ney(texts, order):
    """Counts as dictionaries of tuples; gives the probability of a symbol after the symbols of its word so far."""
    raw, words = [Counter() for _ in range(order)], Counter()
    for text in texts:
        before = None
        for w in text.split():
            words["↺" if w == before else w] += 1
            before = w
    for w, n in words.items():
        s = ["\x02", *w, "\x03"]
        for p in range(1, len(s)):
            for m in range(1, order + 1):
                if p >= m - 1:
                    raw[m - 1][tuple(s[p - m + 1 : p + 1])] += n
    counts = []
    for m in range(1, order + 1):
        left = defaultdict(set)
        if m < order:
            for g in raw[m]:
                left[g[1:]].add(g)
        starts = {g: n for g, n in raw[m - 1].items() if m == order or (m > 1 and g[0] == "\x02")}
        counts.append({g: starts.get(g, len(left[g]) or n) for g, n in raw[m - 1].items()})
    discounts = []
    for level in counts:
        n = [sum(v == k for v in level.values()) for k in range(5)]
        if all(n[1:5]):
            y = n[1] / (n[1] + 2 * n[2])
            discounts.append([min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) for k in (1, 2, 3)])
        else:
            discounts.append([0.5, 1.0, 1.5])

    def probability(history, symbol):
        p = 1 / (1 << 12)
        for m in range(1, order + 1):
            if len(history) < m - 1:
                break
            context = tuple(history[len(history) - m + 1 :])
            followers = {g: a for g, a in counts[m - 1].items() if g[:-1] == context}
            if not followers:
                continue
            cut = lambda a: discounts[m - 1][min(a, 3) - 1]  # noqa: B023, E731
            total, own = sum(followers.values()), followers.get((*context, symbol), 0)
            p = (own - cut(own) if own else 0) / total + sum(map(cut, followers.values())) / total * p
        return p

    return probability


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity(spark, order):
    model = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "abc abc dad", "Zebra abca", "q q q"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["nats"], r["symbols"]) for r in quality.surprise(docs, quality.model(model, order), order).collect()}
    p = plain_kneser_ney(TEXTS, order)
    for r in docs.collect():
        nats = symbols = 0
        before = None
        for w in r["text"].split():
            s = ["\x02", *("↺" if w == before else w), "\x03"]
            before = w
            nats -= sum(np.log(p(s[:k], s[k])) for k in range(1, len(s)))
            symbols += len(s) - 1
        assert got[r["doc_id"]] == (pytest.approx(nats, rel=1e-5), symbols)


def test_kept_is_what_its_columns_say(spark):
    data, good, _ = labelled_prose(200, 4)
    docs = spark.createDataFrame([*data, (1000, "", "en"), (1001, None, None), (1002, "one", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good) if i < 150], "doc_id long, quality int")
    rows = quality.judged(docs, labels).collect()
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in rows)
    assert {r["doc_id"]: r["perplexity"] for r in rows}[1000] == 1 and 0 < sum(not r["kept"] for r in rows) < 100


@pytest.mark.parametrize("order", [1, 2, 3])
def test_log_probabilities(spark, order):
    rng = np.random.default_rng(order)
    data = [(i, " ".join(rng.choice(list("abcdefgh") + [f"w{k}" for k in range(30)], int(rng.integers(0, 30))))) for i in range(80)]
    counts = [Counter() for _ in range(order)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    for i, text in data:
        tokens = ["<s>", *text.split(), "</s>"]
        if not held(i):
            for m in range(order):
                counts[m].update(tuple(tokens[k - m : k + 1]) for k in range(m, len(tokens)))
    words = {g[0]: n for g, n in counts[0].items() if g[0] != "<s>"}
    total, once, twice = sum(words.values()), sum(n == 1 for n in words.values()), sum(n == 2 for n in words.values())
    cut = once / (once + 2 * twice) if once and twice else 0.5

    def p(history, w):
        if not history:
            return max(words[w] - cut, 0) / total if w in words else cut * len(words) / total
        rest, seen = p(history[1:], w), counts[len(history) - 1].get(history, 0)
        return (counts[len(history)].get((*history, w), 0) + lm.MU * rest) / (seen + lm.MU) if seen else rest

    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(data, "doc_id long, text string"), order=order).collect()}
    for i, text in data:
        tokens = ["<s>", *text.split(), "</s>"]
        want = sum(np.log10(p(tuple(tokens[max(0, k - order + 1) : k]), tokens[k])) for k in range(1, len(tokens)))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_window_scores():
    """Every overlapping window on its own, by the network's equations one step at a time."""
    net = toxicity.Network(3)
    net.known = {b"alpha": 1, b"beta": 2}
    rng = np.random.default_rng(0)
    texts = [b" ".join(rng.choice([b"alpha", b"beta", b"gamma", b"d", b"Epsilon!"], n).tolist()) for n in (1, 24, 25, 70)] + [b"", b" .,; "]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN

    def one(words):
        tokens = toxicity.Tokens([b" ".join(words)], net.known)
        x, states = net.embed(tokens)[tokens.ids], {}
        for d in "fb":
            state, out = np.zeros(h), [None] * len(x)
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                g, u = x[t] @ net.p[f"w{d}"] + net.p[f"c{d}"], net.p[f"u{d}"]
                z, r = sigmoid(g[:h] + state @ u[:, :h]), sigmoid(g[h : 2 * h] + state @ u[:, h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + (r * state) @ u[:, 2 * h :])
                out[t] = state
            states[d] = np.array(out)
        both = np.concatenate([states["f"], states["b"]], 1)
        weight = np.exp(both @ net.p["attend"])
        return float((weight / weight.sum()) @ both @ net.p["out"] + net.p["bias"][0])

    for text, got in zip(texts, net.highest(texts)):
        words = toxicity.words_of(text)
        last = max(0, len(words) - toxicity.WINDOW)
        starts = [*range(0, last, toxicity.STRIDE), -(-last // toxicity.STRIDE) * toxicity.STRIDE] if words else []
        want = max((one(words[k : k + toxicity.WINDOW]) for k in set(starts)), default=-np.inf)
        assert got == pytest.approx(want, abs=1e-4)


def plain_packing(docs, length, most):
    """Rows (doc, start, ids, sequence, offset) of one partition, with lists that are searched from the front."""
    windows, out, number = [], [], 0  # a window is [room, pieces]

    def emit(pieces):
        nonlocal number
        offset = 0
        for doc, start, ids in pieces:
            out.append((doc, start, ids, number, offset))
            offset += len(ids)
        number += 1

    for doc, ids in docs:
        start = 0
        while len(ids) - start >= length:
            emit([(doc, start, ids[start : start + length])])
            start += length
        while start < len(ids):
            fitting = [w for w in windows if w[0] >= len(ids) - start]
            if fitting:
                w = min(fitting, key=lambda w: w[0])
            elif len(windows) < most:
                windows.append(w := [length, [], len(out)])
            else:
                w = min(windows, key=lambda w: w[0])
            part = min(w[0], len(ids) - start)
            w[1].append((doc, start, ids[start : start + part]))
            w[0], start = w[0] - part, start + part
            if not w[0]:
                windows.remove(w)
                emit(w[1])
    return out, windows, number


def test_online_placement(spark):
    """All windows but the merged leftovers are those of the plain version; crc32 is that of the ids."""
    rng = np.random.default_rng(5)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], int(rng.integers(0, 150))))) for i in range(120)]
    rows = packing.pack(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), with_end(WORD_BPE), length=64, open_windows=4)
    got = rows.select("*", F.crc32("ids").alias("crc")).collect()
    encode = with_end(WORD_BPE)()
    docs = [(i, np.frombuffer(encode([t])[0], "<u4").tolist()) for i, t in data]
    want, left, number = plain_packing(docs, 64, 4)
    mine = sorted((r["sequence_id"], r["offset"], r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert [x for x in mine if x[0] < number] == sorted((s, o, d, a, tuple(ids)) for d, a, ids, s, o in want)
    rest = sum(len(ids) for w in left for _, _, ids in w[1])
    sizes = Counter(x[0] for x in mine for _ in x[4])
    assert sum(n for s, n in sizes.items() if s >= number) == rest
    assert all(r["crc"] == zlib.crc32(bytes(r["ids"])) and r["length"] == len(r["ids"]) // 4 for r in got)


def test_best_fit_decreasing_placement():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths, length = rng.integers(1, 65, int(rng.integers(1, 80))), 64
        rooms: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fitting = [k for k, room in enumerate(rooms) if room >= n]
            if fitting:
                rooms[min(fitting, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(length - n)
        rows = token_output.best_fit_decreasing(lengths, length)
        assert sorted(length - int(lengths[r].sum()) for r in rows) == sorted(rooms)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))


def test_matrix_is_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words here " * i) for i in range(20)], "doc_id long, text string")
    rows = token_output.packed_rows(docs, with_end(WORD_BPE), length=32)
    token_output.write(rows, str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(str, again.collect())) == Counter(map(str, rows.collect()))
