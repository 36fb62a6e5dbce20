"""Very long texts, repeated ids and clashing columns, for every operator and for the pipeline's stages."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_force_join, labelled_prose
from tidemark.llm import bpe, exact_dedup, licenses, lm, ngram_join, packing, quality, shared, token_output, toxicity
from tidemark.llm.piece_cache import PieceCache
from tidemark.llm.queries import WORD_BPE, with_end
from tidemark.llm.word_bpe import Encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def long(spark):
    """Twenty thousand words, a hundred thousand letters without a space, and near copies of both."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(20_000)]
    run = "".join(rng.choice(list("abcdefgh"), 100_000))
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), run, run + "x", " ".join(words[:9])]
    return spark.createDataFrame([(i, t, "en", 0.5, "u") for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double, __text string").cache()


def test_long_texts(long):
    data = [(r["doc_id"], r["text"]) for r in long.collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(long).collect()} == brute_force_join(data)
    assert {r["doc_id"]: r["group_size"] for r in exact_dedup.groups(long).collect()} == dict.fromkeys(range(5), 1)
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score(long).collect()} == {i: len(t.split()) + 1 for i, t in data}
    assert licenses.scan(long).isEmpty()
    encode = with_end(WORD_BPE)()
    total = sum(len(encode([t])[0]) // 4 for _, t in data)
    assert packing.pack(long, with_end(WORD_BPE)).agg(F.sum("length")).first()[0] == total
    assert token_output.packed_rows(long, with_end(WORD_BPE)).agg(F.sum("n_tokens")).first()[0] == total


def test_long_pieces_of_bpe(long):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(long, RANKS, public_tokenizers.PATTERN).collect()}
    for r in long.collect():
        assert got[r["doc_id"]]["ids"] == library.encode_ordinary(r["text"])
        assert bytes(got[r["doc_id"]]["decoded"]) == r["text"].encode()
    codec, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), np.random.default_rng(0)
    pieces = ["".join(rng.choice(list(letters), n)).encode() for n in (1, 2, 3, 50, 700) for letters in ("a", "ab", "aeinrst")]
    assert [codec._long(p) for p in pieces] == codec.merge(pieces)  # heap and matrix


def test_models_on_long_texts(spark, long):
    data, good, toxic = labelled_prose(120, 3)
    docs = spark.createDataFrame([(100 + i, t, lang) for i, t, lang in data], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(100 + i, good[i], toxic[i]) for i in range(120)], "doc_id long, quality int, toxic int")
    both = docs.union(long.select("doc_id", "text", "lang"))
    assert quality.judged(both, labels).where("doc_id < 100").count() == 5
    network = toxicity.learn(docs, labels)
    scored = toxicity.scored(long, network)
    assert scored.columns == [*long.columns, "score_1"]
    assert [r["score"] for r in scored.collect()] == [0.5] * 5 and all(0 <= r["score_1"] <= 1 for r in scored.collect())
    assert toxicity.keep_clean(long, network).columns == long.columns


def test_cache_is_bounded_in_bytes():
    encoder, rng = Encoder(WORD_BPE), np.random.default_rng(2)
    plain = Encoder(WORD_BPE)
    encoder.cache.limit = 300_000
    for _ in range(6):
        texts = ["".join(rng.choice(list("abcdefgh"), 100_000)), " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(2_000))]
        assert encoder.encode(texts) == plain.encode(texts)
        assert encoder.cache.size <= 300_000
    pieces, asked = [f"p{i}" for i in range(50_000)], []
    cache = PieceCache(lambda new: (asked.extend(new), [p.encode() * (1 + len(p) % 3) for p in new])[1])
    for k in range(0, 50_000, 7_000):
        part = pieces[max(0, k - 500) : k + 7_000]
        assert cache.joined([part, part[:3], []]) == [b"".join(p.encode() * (1 + len(p) % 3) for p in x) for x in (part, part[:3], [])]
    assert sorted(asked) == sorted(pieces)  # each was encoded once


def test_text_ids_are_refused(spark):
    docs = spark.createDataFrame([("a1", "some text")], "doc_id string, text string")
    for operator in (ngram_join.near_duplicates, lambda d: packing.pack(d, with_end(WORD_BPE)), lambda d: token_output.packed_rows(d, with_end(WORD_BPE))):
        with pytest.raises(TypeError, match="integer"):
            operator(docs)


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """Documents with null, empty and very long texts, a null id, a repeated row and columns with names of the operators' own."""
    folder = str(tmp_path_factory.mktemp("odd"))
    data, good, toxic = labelled_prose(160, 12)
    rng = np.random.default_rng(3)
    rows = [(i, t, lang, "s", len(t), 0.1 * i, "x") for i, t, lang in data]
    rows += [(900, "", "en", None, 0, None, None), (901, None, None, None, None, None, None), (None, "a text without an id", "en", "s", 1, 1.0, "y")]
    rows += [(902, " ".join(rng.choice(data[0][1].split(), 12_000)), "en", "s", 1, 1.0, "y"), rows[4], rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, __text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, good[i], toxic[i]) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stages_on_odd_rows(spark, odd_corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = shared.materialise(stage(spark, docs, odd_corpus))
        assert kept.columns == docs.columns
        assert not (Counter(map(tuple, kept.collect())) - Counter(map(tuple, docs.collect()))), name
        assert stage(spark, docs.where("false"), odd_corpus).isEmpty()
        docs = kept
    ids = Counter(r["doc_id"] for r in docs.collect())
    assert max(ids.values()) == 1 and 900 in ids and 901 not in ids  # null and empty texts are equal, the smaller id stays
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, odd_corpus)
    assert {r["doc_id"] for r in pieces.collect()} == set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), odd_corpus).isEmpty()


def test_pipeline_against_its_operators(spark, odd_corpus):
    """run() is what the operators give one after the other, and leaves its last table only."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{odd_corpus}/labels.parquet")
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    good = {r["doc_id"] for r in quality.judged(docs, labels).where("kept").collect()}
    docs = shared.materialise(docs.where(F.col("doc_id").isin(list(good - {None})) | F.col("doc_id").isNull()))
    network = toxicity.learn(docs, labels)
    civil = {r["doc_id"] for r in toxicity.judged(docs, network).where("predicted = 0").collect()}
    rest = sorted((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] in civil)
    first: dict[str, int] = {}
    for i, t in rest:
        first.setdefault(" ".join(t.replace("\n", " ").split(" ")), i)
    distinct = [(i, t) for i, t in dict(rest).items() if i in first.values()]
    wanted = {i for i, (_, component) in brute_force_join(distinct).items() if i == component}
    out = corpus_pipeline.run(spark, odd_corpus)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} - {None} == wanted
