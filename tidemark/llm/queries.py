"""Queries over the test tables that apply each operator to its whole table, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, licenses, lm, ngram_join, packing, quality, token_output, toxicity
from .word_bpe import encoder


#: A tokenizer file of the installed package, read where tasks run.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. A scan of fewer tasks than there are cores is dealt to all of them; it is a small one."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    tasks = min(cores, 64)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op1_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.with_recall(_table(spark, sf_dir, "embeddings"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def with_end(path: str, end: int = 1):
    """An encoder of whole texts that adds the id ``end`` to each."""

    def make():
        encode, last = encoder(path).encode, end.to_bytes(4, "little")
        return lambda texts: [x + last for x in encode(texts)]

    return make


def op9_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), with_end(WORD_BPE))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_packed_id_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_rows(_table(spark, sf_dir, "documents"), with_end(WORD_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_graph": op1_embedding_graph,
    "op2_kneser_ney_quality": op2_kneser_ney_quality,
    "op3_toxicity": op3_toxicity,
    "op4_byte_level_bpe": op4_byte_level_bpe,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_license_scan": op8_license_scan,
    "op9_bounded_space_packing": op9_bounded_space_packing,
    "op10_packed_id_matrix": op10_packed_id_matrix,
}

def _canonical_sql(c: str) -> str:
    """The canonical form of a text column, as licenses.by_lines has it."""
    out = f"regexp_replace(lower(coalesce({c}, '')), '\\r\\n?', chr(10), 'g')"
    for line in (licenses.COPYRIGHT_LINE, licenses.TITLE_LINE):
        out = f"regexp_replace({out}, '{line}', '', 'g')"
    for source, target in licenses.SPELLINGS:
        out = f"replace({out}, '{source}', '{target}')"
    return f"regexp_replace({out}, '{licenses.OTHER_SIGNS}', ' ', 'g')"


def _license_sql() -> str:
    """License hits by matching canonical texts themselves between line ends, without digests."""
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in licenses.KNOWN)
    whole = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))".format
    return f"""
        with k as (select min(id) as license_id, body from (select id, {whole(_canonical_sql('t'))} as body from (values {quoted}) v(id, t)) group by body),
        d as (select doc_id, {_canonical_sql('text')} as body from documents),
        w as (select doc_id, {whole('body')} as whole, chr(10) || array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x != ''), chr(10)) || chr(10) as lines from d)
        select doc_id, license_id, count(*) as n_units, bool_or(body = whole) as whole_text
        from w join k on contains(replace(lines, chr(10), ' '), ' ' || body || ' ') and regexp_matches(lines, chr(10) || replace(body, ' ', '[ \\n]') || chr(10)) group by doc_id, license_id
    """


ORACLES: dict[str, str] = {
    "op8_license_scan": _license_sql(),
    "op6_exact_dedup": """
        with body as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as body from documents)
        select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
            doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
        from body
    """,
}
