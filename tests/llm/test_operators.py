"""Each operator against brute force, round trips and awkward rows, on small fixtures."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, bpe, embed_dedup, exact_dedup, licenses, lm, ngram_join, packing, quality, shared, token_output, toxicity
from tidemark.llm.queries import WORD_BPE, with_end
from tidemark.llm.word_bpe import Encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
STRANGE = ["", None, "   ", "a", "naïve Ünïcode ÀÉ", "x" * 5000, "tab\tline\nend", "one two three four five six seven", "one two three four five six seven", "\x1c odd \x85 space  here", "日本語 テキスト", "it's we'll don't", "Σίσυφος İstanbul éa", "2048 ۰۱ ½"]


@pytest.fixture(scope="module")
def odd(spark):
    """Strange texts, a null id, a repeated row and columns whose names operators use themselves."""
    data = [(i, t, "en", "s", "x", 1) for i, t in enumerate(STRANGE)] + [(None, "null id", None, None, None, None), (3, "a", "en", "s", "x", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score string, __block int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def prose(spark):
    """Documents with exact copies, near copies and unrelated texts."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    out = []
    for i in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(3, 120))))
        out.append(" ".join(words))
        if i % 4 == 0:
            out.append("  ".join(words))
        if i % 3 == 0:
            words[len(words) // 2] = "changed"
            out.append(" ".join(words))
    return spark.createDataFrame([(7 * k % 997, t, "en") for k, t in enumerate(out)], "doc_id long, text string, lang string").cache()


def test_exact_groups(spark, prose, odd, empty):
    for df in (prose, odd):
        data = [(r["doc_id"], " ".join((r["text"] or "").replace("\n", " ").replace("\t", " ").split(" "))) for r in df.collect()]
        got = Counter((r["doc_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.groups(df).collect())
        import re

        bodies = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in data]
        size = Counter(b for _, b in bodies)
        assert got == Counter((i, size[b], hashlib.sha256(b.encode()).hexdigest()) for i, b in bodies)
    assert exact_dedup.groups(empty).isEmpty()


def test_colliding_hashes_are_told_apart(prose):
    plain = Counter(map(tuple, exact_dedup.groups(prose).collect()))
    assert Counter(map(tuple, exact_dedup.groups(prose, lambda t: F.length(t) % 3).collect())) == plain


def test_first_of_each_group_keeps_columns(odd):
    kept = exact_dedup.first_of_each_group(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect())[3] == 1


def brute_force_join(data):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in data}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join(prose, odd, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(prose).collect()}
    assert got == brute_force_join([(r["doc_id"], r["text"]) for r in prose.collect()])
    strange = ngram_join.near_duplicates(odd).collect()
    assert len(strange) == odd.count()
    assert next(r for r in strange if r["doc_id"] is None)["component_id"] is None
    assert {r["component_id"] for r in strange if r["doc_id"] in (7, 8)} == {7}
    assert ngram_join.near_duplicates(empty).isEmpty()


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(400):
        words = list(base)
        words[int(rng.integers(0, 80))] = f"edit{i}"
        data.append((i, " ".join(words)))
    got = ngram_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(i, c) for i, (_, c) in brute_force_join(data).items()}


def test_pairs_are_verified_once(spark, monkeypatch):
    """Long lists in many chunks: the result is that of brute force, and no pair is verified twice."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    verified, plain = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets, percent: (verified.append(found := plain(pairs, sets, percent)), found)[1])
    monkeypatch.setattr(shared, "drop", lambda *frames: None)
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(30)]
    data = []
    for i in range(150):  # groups of near copies that share a passage, at similarities about the threshold
        own = [f"g{i % 6}w{k}" for k in range(12 + i % 9)]
        words = passage + own
        words[int(rng.integers(0, len(words)))] = f"edit{i % 40}"
        data.append((i, " ".join(words)))
    got = ngram_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_force_join(data)
    pairs = Counter((r["a"], r["b"]) for frame in verified for r in frame.collect())
    assert pairs and max(pairs.values()) == 1 and all(a < b for a, b in pairs)


def test_lm_scores(prose, odd, empty):
    for df in (prose, odd):
        rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in df.collect()]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        counts = Counter(w for i, ws in rows if not held(i) for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = Counter((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in rows)
        for order in (1, 2, 3):
            found = lm.score(df, order=order).collect()
            assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    better = lm.score(prose).where("held_out").agg(F.sum("score") > F.sum("base_score")).first()[0]
    assert better and lm.score(empty).isEmpty()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_automaton_is_a_distribution(order):
    """Given any history, the probabilities of all known words and the unknown class add up to one."""
    texts = [b"a b a c", b"b a b", b"a a"]
    known = [b"a", b"b", b"c"]
    histories = ([], [b"a"], [b"a", b"b"], [b"z", b"a"], [b"c"])
    probes = [b" ".join([*h, *w]) for h in histories for w in (*((x,) for x in (*known, b"zz")), ())]  # the last ends there
    grams = lm.Grams(texts + probes, order)
    train = np.array([True] * len(texts) + [False] * len(probes))
    counted, counts = grams.counted(train), []
    for level, (_, c) in enumerate(counted):
        own = np.empty(len(c), np.int64)
        own[grams.sorted_by_key(level)] = c
        counts.append(own)
    token_counts = Counter(w for t in texts for w in [*t.split(), None])
    n, once, twice = sum(token_counts.values()), sum(v == 1 for v in token_counts.values()), sum(v == 2 for v in token_counts.values())
    automaton = lm.Automaton(grams, counts, n, len(token_counts), once, twice)
    logp = automaton.walk(grams)
    at = [(int(grams.starts[k + len(texts)]), len(p.split())) for k, p in enumerate(probes)]
    for i in range(0, len(probes), 5):
        words = sum(10 ** logp[a + size] for a, size in at[i : i + 4])
        first, size = at[i + 4]
        assert words + 10 ** logp[first + size + 1] == pytest.approx(1, abs=1e-12)
    # lanes of any length give what one walk gives
    segment, lm.SEGMENT = lm.SEGMENT, 2
    try:
        assert np.allclose(automaton.walk(grams), logp)
    finally:
        lm.SEGMENT = segment


def test_bpe_equals_the_library(odd, empty):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).isEmpty()


def test_bpe_on_random_bytes():
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    texts = ["".join(chr(c) for c in rng.choice([32, 97, 98, 101, 110, 116, 233, 10, 39, 48, 0x4E2D], int(rng.integers(1, 400)))) for _ in range(200)]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_BPE)
    plain.encode_special_tokens = True
    rng = np.random.default_rng(1)
    texts = [t or "" for t in STRANGE] + ["Hello, World! ÉCOLE; isn't it? a.b ,x <|endoftext|> É. ß, x¹."] + ["".join(rng.choice(list("aBÉ'., 1²́\n!"), 60)) for _ in range(200)]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(WORD_BPE).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_online_packing(odd, prose, empty):
    for df in (odd, prose):
        pieces = packing.pack(df, with_end(WORD_BPE), length=64, open_windows=3).toPandas()
        encode = with_end(WORD_BPE)()
        want = Counter((r["doc_id"], encode([r["text"]])[0]) for r in df.collect())
        held: Counter = Counter()
        for (doc, _), part in pieces.fillna({"doc_id": -1}).groupby(["doc_id", pieces["doc_tokens"]]):
            by_start = part.sort_values("start")
            if (by_start["start"] == 0).sum() == 1:
                assert by_start["start"].tolist() == [0, *by_start["length"].cumsum().tolist()[:-1]]
                held[(None if doc == -1 else int(doc), b"".join(by_start["ids"]))] += 1
        assert all(want[k] for k in held)
        assert pieces["length"].sum() == sum(len(ids) // 4 * n for (_, ids), n in want.items())
        sizes = []
        for _, part in pieces.sort_values("offset").groupby("sequence_id"):
            assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
            sizes.append(int(part["length"].sum()))
        assert all(s == 64 or s & (s - 1) == 0 for s in sizes)
    assert packing.pack(empty, with_end(WORD_BPE)).isEmpty()


def test_packed_matrix(odd, prose, empty):
    for df in (odd, prose):
        encode = with_end(WORD_BPE)()
        want = sum(len(encode([r["text"]])[0]) // 4 for r in df.collect())
        rows = token_output.packed_rows(df, with_end(WORD_BPE), length=64).collect()
        ids = token_output.matrix([r["ids"] for r in rows])
        assert ids.shape[1] == 64 and sum(r["n_tokens"] for r in rows) == want
        texts = {r["doc_id"]: encode([r["text"]])[0] for r in df.collect()}
        for k, r in enumerate(rows):
            assert r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
            for doc, start, i, j in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                assert ids[k, i:j].astype("<u4").tobytes() == texts[doc][4 * start : 4 * (start + j - i)]
    assert token_output.packed_rows(empty, with_end(WORD_BPE)).isEmpty()


def test_capacity_tree():
    tree = token_output.CapacityTree(10)
    for room in (2, 5, 9):
        tree.change(room, 1)
    assert [tree.least(x) for x in (1, 2, 3, 6, 9, 10)] == [2, 2, 5, 9, 9, None]
    rows = token_output.best_fit_decreasing(np.array([6, 4, 5, 5, 10]), 10)
    assert sorted(map(sorted, rows)) == [[0, 1], [2, 3], [4]]


def test_license_scan(spark, odd, empty):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT" and len(t) > 100)
    body = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" THE ", "\nTHE ").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    data = [(1, body), (2, "Text before\nReleased under the MIT Licence\nafter"), (3, "not released under the MIT License."), (4, "intro\n\n" + mit + "\n\nend"), (5, None)]
    got = {(r["doc_id"], r["license_id"], r["whole_text"]) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", True), (2, "MIT", False), (4, "MIT", False)}
    # titled files of several paragraphs, whole and above other text
    cuts = mit.replace("subject to the following conditions: ", "subject to the following conditions:\n\n").replace("of the Software. THE", "of the Software.\n\nTHE").replace("IMPLIED, INCLUDING", "IMPLIED,\nINCLUDING")
    titled = f"The MIT License (MIT)\n\nCopyright (c) 1999 A. Body\nAll rights reserved.\n\n{cuts}\n"
    bsd = next(t for k, t in licenses.KNOWN if k == "BSD-3-Clause").replace(": 1.", ":\n\n1.").replace(" 2.", "\n2.").replace(" 3.", "\n\n3.")
    data = [(1, titled), (2, titled + "\nimport this\n\nprint(1)"), (3, "x = 1\n" + bsd + "\ny"), (4, cuts.replace("persons", "people"))]
    got = {(r["doc_id"], r["license_id"], r["whole_text"]) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", True), (2, "MIT", False), (3, "BSD-3-Clause", False)}
    assert licenses.scan(odd).isEmpty() and licenses.scan(empty).isEmpty()
    plan = licenses.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def labelled_prose(n: int, seed: int):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(["an", "th", "er", "on", "in", "es"], int(rng.integers(1, 4)))) for _ in range(200)]
    docs, quality_, toxic = [], [], []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(20, 80))))
        bad, rude = i % 7 == 3, i % 5 == 1
        if rude:
            for _ in range(3):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(["idiotic", "scumbag"]))
        text = " ".join(x + "$$$" if bad else x for x in w)
        docs.append((i, text, "en" if i % 2 else "fr"))
        quality_.append(int(not bad))
        toxic.append(int(rude))
    return docs, quality_, toxic


def test_quality_classifier(spark, odd, empty):
    data, good, _ = labelled_prose(300, 1)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good) if i < 150], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert all(got[i]["kept"] == bool(good[i]) for i in range(150, 300))
    labels = labels.where("doc_id > 100")
    strange = quality.judged(odd, labels).collect()
    assert len(strange) == odd.count() and all(r["kept"] for r in strange)  # no trusted text there: nothing is rejected
    assert quality.judged(empty, labels).isEmpty()
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, odd.collect()))


def test_rare_language_has_its_own_threshold(spark):
    """A language with few of the trusted texts is fitted and judged by its own, however small the fitted sample is."""
    data, good, _ = labelled_prose(600, 8)
    rare = [(1000 + i, " ".join("".join(chr(0x430 + (ord(c) * 7 + i) % 5) for c in w) for w in t.split(" ")).replace("$", ""), "ru") for i, t, _ in data[:12]]
    docs = spark.createDataFrame(data + rare, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*enumerate(good), *((i, 1) for i, _, _ in rare)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels, trusted_rows=30).collect()}
    limit = {r["lang"]: r["threshold"] for r in got.values()}
    assert len(limit) == 3 and limit["ru"] not in (limit["en"], limit["fr"])
    for lang in ("en", "fr"):  # thresholds are of all trusted texts: those of two fifths of a sample of 30 would reject many
        kept = [got[i]["kept"] for i, _, own in data if own == lang and good[i]]
        assert sum(kept) >= 0.985 * len(kept)


def test_all_trusted_texts_fit_or_set_thresholds(spark, monkeypatch):
    """Four fifths of any number of trusted texts fit the model: there is no bound on them."""
    fitted = []

    class Fitted(Exception):
        pass

    def fit(docs, order):
        fitted.append(docs.count())
        raise Fitted

    monkeypatch.setattr(quality, "model", fit)
    docs = spark.range(13_000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 10 = 0, 'fr', 'en') as lang")
    for run in (quality.judged, quality.keep_good):
        with pytest.raises(Fitted):
            run(docs, docs.selectExpr("doc_id", "1 as quality"))
    assert len(fitted) == 2 and all(abs(n - 0.8 * 13_000) < 300 for n in fitted)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    with pytest.raises(Fitted):
        quality.judged(docs, docs.selectExpr("doc_id", "1 as quality"))
    assert fitted[2] == fitted[0]


def test_kneser_ney_sums_to_one(spark):
    """Over all symbols after any context, interpolated probabilities add up to one."""
    docs = spark.createDataFrame([("abab abc cab",), ("aab bca abc",)], "text string")
    table = {r["key"]: (r["alpha"], r["gamma"]) for r in quality.model(docs, 3).collect()}
    find = lambda keys: tuple(np.array([table.get(int(k), (0.0, 1.0))[i] for k in keys.view(np.int64)]) for i in (0, 1))
    seen = [b"a", b"b", b"c"]
    for history in (b"", b"a", b"ab", b"ca"):
        words = [history + x for x in seen] + [history]
        g = quality.Grams(words, 3)
        p = np.full(len(g.place), 0.0)
        for level, key in enumerate(g.keys, 1):
            at = g.at(level)
            p[at] = find(key[at])[0] + find(g.contexts(level, at))[1] * p[at]
        total = sum(p[b + len(history) + 1] for b in g.begin)
        escaped = 1.0
        for level in range(1, 4):
            at = np.array([g.begin[0] + len(history) + 1])
            if at[0] - g.begin[0] >= level - 1:
                escaped *= find(g.contexts(level, at))[1][0]
        assert total + escaped == pytest.approx(1, abs=1e-9)


def test_toxicity_network(spark, odd, empty):
    data, _, toxic = labelled_prose(400, 2)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    network = toxicity.learn(docs, labels)
    got = toxicity.judged(docs, network).toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == [toxic[i] for i in held["doc_id"]]).mean() > 0.95
    assert all(held["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]])
    strange = toxicity.judged(odd, network).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert toxicity.judged(empty, network).isEmpty() and toxicity.keep_clean(odd, network).columns == odd.columns


def test_network_gradients():
    net = toxicity.Network(1)
    tokens = toxicity.Tokens([b"aa bb cc dd", b"bb ee"], {b"aa": 1, b"bb": 2})
    _, first, length = toxicity.windows(tokens.size, tokens.begin)
    ids, y = toxicity._window_ids(tokens, first, 4), np.array([1.0, 0.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(tokens, net.embed(tokens), ids, length, y)
    for name, at in (("out", (3,)), ("attend", (2,)), ("wf", (1, 2)), ("ub", (2, 5)), ("uf", (1, 20)), ("cb", (4,)), ("word", (2, 1)), ("gram", (int(tokens.grams[0]), 3))):
        losses = []
        for step in (1e-4, -1e-4):
            net.p[name][at] += step
            losses.append(net.gradients(tokens, net.embed(tokens), ids, length, y)[0])
            net.p[name][at] -= step
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=0.02, abs=1e-5)


def test_embedding_graph(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = [b + rng.normal(scale=0.05, size=16) for b in base for _ in range(int(rng.integers(1, 8)))] + [base[0]] * 3
    data = [(i, [float(v) for v in row], int(i % 2)) for i, row in enumerate(x)]
    strange = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, data[0][1], None), (None, data[0][1], 0)]
    df = spark.createDataFrame(data + strange, "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near_duplicates(df)
    unit = np.array([r / np.linalg.norm(r) for r in np.array(x)])
    label = np.arange(len(x)) % 2
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    own = {r["vec_id"]: r for r in got.collect()}
    assert [own[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    component = np.arange(len(x))
    for _ in range(len(x)):
        component = np.where(near, component[None, :], 10**9).min(1)
    assert [own[i]["component_id"] for i in range(len(x))] == component.tolist()
    assert all(own[i]["n_links"] == 0 for i in (1000, 1001, 1002, 1003, None))
    audit = embed_dedup.audit_recall(df, got).first()
    assert audit["n_found"] >= 0.9 * audit["n_true"]
    assert embed_dedup.near_duplicates(df.where("false")).isEmpty()


def near_copies(spark, seed, copies, others):
    """Vectors of one label: near copies of one vector and unrelated ones; and the links of each."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=16) + rng.normal(scale=0.25, size=(copies, 16)), rng.normal(size=(others, 16))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, row, 0) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    return df, ((unit @ unit.T >= 0.93).sum(1) - 1).tolist()


@pytest.mark.parametrize("most, rows, chunk", [(60, 40, 90), (150, 100, 100), (250, 200, 60)])
def test_dealt_cells_lose_no_link(spark, monkeypatch, most, rows, chunk):
    """Cells beyond the bound of one task are dealt again or compared by chunks; every link counts once, at both ends."""
    for name, value in (("CELL_MOST", most), ("CELL_ROWS", rows), ("CHUNK", chunk), ("SHARD_ROWS", 30), ("SALT_ROWS", 100)):
        monkeypatch.setattr(embed_dedup, name, value)
    df, links = near_copies(spark, 6, 200, 300)
    got = {r["vec_id"]: r for r in embed_dedup.with_recall(df, audited=100).collect()}
    assert [got[i]["n_links"] for i in range(len(links))] == links
    assert {got[i]["component_id"] for i in range(200)} == {0}
    assert all(r["audit_recall"] == 1.0 and r["audit_links"] > 0 for r in got.values())


def test_walk_crosses_shards(monkeypatch):
    """The search runs over the united lists of all shards of a cell, and finds what brute force finds."""
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", 40)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([b + rng.normal(scale=0.15, size=(int(rng.integers(1, 20)), 24)) for b in base])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    start, edges, medoids, shard = embed_dedup._graph(x)
    assert len(medoids) > 10 and len(set(shard)) > 10
    true = x @ x.T >= 0.93
    found, seen = np.zeros_like(true), []
    for i in range(0, len(x), 16):
        nodes, score = embed_dedup._walked(x, x[i : i + 16], start, edges, medoids, 0.93)
        found[i : i + 16, nodes] = score >= 0.93
        seen.append(len(nodes))
    assert (found & true).sum() >= 0.98 * true.sum() and not (found & ~true).any()
    assert np.mean(seen) < 0.8 * len(x)  # a walk does not look at all nodes


def brute_components(links):
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("edges", [20, 1000])
def test_components(spark, monkeypatch, edges):
    """Chains, a hub, self links and null ends, in one task and in many."""
    monkeypatch.setattr(shared, "EDGES", edges)
    rng = np.random.default_rng(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7)] + [tuple(map(int, rng.integers(1000, 1100, 2))) for _ in range(70)]
    got = shared.components(spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute_components(links)
    assert shared.components(spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize("n", [8, 16, 32])
def test_exchange_in_hops(spark, n):
    """Counts come back right through several hops, and each hop's rows are at most the blocks times the fan-out."""
    rng = np.random.default_rng(n)
    data = [(i, " ".join(f"w{k}" for k in rng.integers(0, 400, 60))) for i in range(40 * n)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    packed = blocks.pack(docs, n, by=("doc_id", "text"))

    def keys_of(table):
        grams = lm.Grams(blocks.texts_of(table), 2)
        return grams.counted(np.ones(table.num_rows, bool))

    exchange = blocks.Exchange(packed, n, keys_of, (np.uint64,), fan=4)
    assert len(exchange.hops) == {8: 2, 16: 2, 32: 3}[n] and max(exchange.radix) <= 4
    for hop in exchange.hops:
        assert hop.count() <= 2 * (4 * n + 64)  # two levels; rows of the last, rounded-up ranges besides

    def totals(fan):
        def last(table, answers):
            grams, got = lm.Grams(blocks.texts_of(table), 2), blocks.answers_by_level(answers, (np.uint64,))
            keys = [grams.keys[k][grams.sorted_by_key(k)] for k in (0, 1)]
            assert all(len(got[k + 1][0][0]) == len(keys[k]) for k in (0, 1))
            rows = [(int(k), int(c), int(got[level + 1][1][0])) for level in (0, 1) for k, c in zip(keys[level].view(np.int64), got[level + 1][0][0])]
            return pa.table([pa.array(x, pa.int64()) for x in zip(*rows)], ["key", "n", "total"])

        found = blocks.finish(packed, blocks.counts(packed, n, keys_of, fan), last, "key long, n long, total long")
        return set(map(tuple, found.distinct().collect()))

    whole = lm.Grams([t.encode() for _, t in data], 2).counted(np.ones(len(data), bool))
    want = {(int(k), int(c), int(counts.sum())) for keys, counts in whole for k, c in zip(keys.view(np.int64), counts)}
    assert totals(4) == totals(512) == want


def test_pipeline_stages(spark, tmp_path):
    """The pipeline against its stages' own definitions on a small corpus."""
    import corpus_pipeline

    data, good, toxic = labelled_prose(300, 6)
    data = [(i, t, lang, "s", len(t)) for i, t, lang in data] + [(1000 + k, data[k][1], "en", "s", 1) for k in range(0, 60, 10)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, good[i], toxic[i]) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "ngram_join", "packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    wanted = {i for i in range(300) if good[i] and not toxic[i]}
    kept = set(out["doc_id"])
    assert kept <= set(range(300)) and len(kept ^ wanted) <= 0.05 * len(wanted)
    encode = with_end(WORD_BPE)()
    for doc, part in out.groupby("doc_id"):
        assert b"".join(part.sort_values("start")["ids"]) == encode([data[doc][1]])[0]
    json.dumps(sorted(kept))


def test_ngrams_of_words_are_hashed_once(spark, monkeypatch):
    """Only distinct n-grams are hashed and looked up, whether told apart by a table or by sorting, and each symbol finds its own."""
    from tidemark.llm import blocks, quality

    words = [b"abab", b"ba", "né".encode(), b"", b"a\x02b"] * 50
    hashed, plain = [], blocks.mix
    monkeypatch.setattr(blocks, "mix", lambda a, b: (hashed.append(len(a)), plain(a, b))[1])
    forms = []
    for table in (16, 0):
        monkeypatch.setattr(quality, "TABLE", table)
        hashed.clear()
        forms.append(quality.Grams(words, 3))
        assert sum(hashed) == sum(len(k) for k in forms[-1].found) < 60
    spelled = "".join("\x02" + w.decode() + "\x03" for w in words)
    for g in forms:
        for level, key in enumerate(g.found, 1):
            own = {}
            for i in g.at(level).tolist():
                own.setdefault(spelled[i - level + 1 : i + 1], set()).add(int(key[g.of[level - 1][i]]))
            assert all(len(x) == 1 for x in own.values()) and len(set.union(*own.values())) == len(own)
        assert (g.distinct() == forms[0].distinct()).all()


def test_model_leaves_no_texts_behind(spark):
    """The model's own tables are deleted once it is written: neither texts nor counts stay beside it."""
    from tidemark.llm import quality, shared

    docs = spark.createDataFrame([(f"some plain words {i % 7} and more",) for i in range(40)], "text string")
    held = shared.written()
    lm = quality.model(docs, 3)
    assert shared.written() == held + 1 and lm.count() > 0
