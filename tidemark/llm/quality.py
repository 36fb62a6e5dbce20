"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are the characters of white-space separated words, between a start and an end symbol; a word that
repeats the one before it becomes a single repeat symbol, so loops show. Counts, continuation counts, context
sums and discounts are joins and aggregates over hashed n-grams. Scoring is a sharded join: blocks of documents
ask shards of the model for the n-grams of their distinct words (see ``blocks``). A document's perplexity is that of
its text and PULL more symbols at its language's median, so that very short texts are not judged on chance. It is
rejected when that exceeds its language's threshold: a quantile of trusted texts that the model did not see, widened
by MARGIN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, memory, shared
from .bpe import slices
from .words import Words

ORDER = 4
FITTING = 0.8  # share of a language's trusted texts that fit the model; all other trusted texts set the thresholds
BROADCAST_ROWS = 1_000_000  # ids of fitting texts that are broadcast; more are joined by a shuffle
STEP = 1e-4  # nats that medians and quantiles are counted in, so that no task holds a value for each text
QUANTILE = 0.995
PULL = 40.0  # symbols' weight of the language's median
MARGIN = 0.05  # nats that a text may exceed the quantile by
BLOCK_BYTES = 3_000_000
TABLE = 16  # n-grams are told apart by a table of at most this many cells for each symbol, and by sorting otherwise
REPEAT = "↺".encode()
EMPTY = np.uint64(0x5EED5EED5EED5EED)  # key of the empty context
GRAM = "level int, key long, context long, suffix long, first boolean, n long"


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``codes`` below ``size``, sorted, and the place of each code among them."""
    if size > TABLE * (len(codes) + 1024):
        return np.unique(codes, return_inverse=True)
    met = np.zeros(size, bool)
    met[codes] = True
    found = np.flatnonzero(met)
    place = np.empty(size, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[codes]


class Grams:
    """Character n-grams of distinct words: per level the keys of distinct n-grams and the number of each symbol's.

    N-grams are told apart by their context's number and their last symbol, so only distinct ones are hashed.
    """

    def __init__(self, words: list[bytes], order: int):
        spelled = ["\x02" + w.decode("utf-8", "replace") + "\x03" for w in words]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        symbols = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), "<u4")
        self.place = np.arange(len(symbols), dtype=np.int32) - np.repeat(self.begin, self.size).astype(np.int32)
        letters, letter = _numbered(symbols, int(symbols.max(initial=0)) + 1)
        letters = letters.astype(np.uint64)
        self.found, self.context, self.of = [blocks.mix(np.full(len(letters), EMPTY), letters)], [np.zeros(len(letters), np.int64)], [letter]
        for level in range(2, order + 1):
            at = np.flatnonzero(self.place >= level - 1)
            codes = self.of[-1][at - 1].astype(np.int64) * len(letters) + letter[at]
            met, number = _numbered(codes, len(self.found[-1]) * len(letters))
            context, last = np.divmod(met, max(1, len(letters)))
            of = np.zeros(len(symbols), np.int32)
            of[at] = number
            self.found.append(blocks.mix(self.found[-1][context], letters[last]))
            self.context.append(context)
            self.of.append(of)

    def at(self, level: int) -> np.ndarray:
        """Places of the symbols that have an n-gram of the level: all but starts."""
        return np.flatnonzero(self.place >= max(1, level - 1))

    @property
    def keys(self) -> list[np.ndarray]:
        """Per level the key of each symbol's n-gram, where it has one."""
        return [key[of] for key, of in zip(self.found, self.of)]

    def contexts(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.found[level - 2][self.of[level - 2][at - 1]] if level > 1 else np.full(len(at), EMPTY)

    def _contexts(self, level: int) -> np.ndarray:
        """Key of the context of each distinct n-gram."""
        return self.found[level - 2][self.context[level - 1]] if level > 1 else np.full(len(self.found[0]), EMPTY)

    def counted(self, level: int, times: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the level's distinct n-grams that occur: key, context, suffix, whether a word begins with it, and how often."""
        at = self.at(level)
        at = at[times[at] > 0][::-1]
        of, size = self.of[level - 1][at], len(self.found[level - 1])
        n = np.bincount(of, times[at], size).astype(np.int64)
        first = np.zeros(size, np.int64)
        first[of] = at  # the first place, as it is written last
        held = np.flatnonzero(n)
        first = first[held]
        suffix = self.found[level - 2][self.of[level - 2][first]] if level > 1 else np.full(len(held), EMPTY)
        return self.found[level - 1][held], self._contexts(level)[held], suffix, self.place[first] == level - 1, n[held]

    def distinct(self) -> np.ndarray:
        """All keys to look up, sorted: n-grams and, one level lower, their contexts."""
        return np.unique(np.concatenate([*self.found, np.array([EMPTY])]))

    def surprise(self, find, uniform: float) -> np.ndarray:
        """Negative log-likelihood of each word; ``find`` gives the alphas and gammas of keys."""
        p = np.full(len(self.place), uniform)
        for level, key in enumerate(self.found, 1):
            alpha, gamma = find(key)[0], find(self._contexts(level))[1]
            at = self.at(level)
            of = self.of[level - 1][at]
            p[at] = alpha[of] + gamma[of] * p[at]
        nats = np.where(self.place >= 1, -np.log(p), 0)
        return np.add.reduceat(nats, self.begin) if len(self.begin) else np.empty(0)


def _stream(texts: list[bytes]) -> Words:
    """Words of whole texts (case kept), immediate repeats replaced."""
    words = Words(texts, (), (), lower=False)
    ids = words.ids
    again = np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    inner = words.starts[(words.starts > 0) & (words.starts < len(ids))]
    again[inner] = False
    words.words.append(REPEAT)
    words.ids = np.where(again, len(words.words) - 1, ids)
    return words


def model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, alpha, gamma): discounted probability of an n-gram and back-off weight of a context, from all ``docs``; materialised."""

    def grams(batches):
        memory.release()
        for part in (x for batch in batches for x in slices(batch, "text", BLOCK_BYTES)):
            stream = _stream(blocks.texts_of(pa.Table.from_batches([part])))
            weight = np.bincount(stream.ids, minlength=len(stream.words)) if len(stream.ids) else np.zeros(len(stream.words), np.int64)
            g = Grams(stream.words, order)
            times = np.repeat(weight, g.size)
            for level in range(1, order + 1):
                key, context, suffix, first, n = g.counted(level, times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), *(pa.array(x.view(np.int64)) for x in (key, context, suffix)), pa.array(first), pa.array(n)], [x.split()[0] for x in GRAM.split(", ")])

    counted = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(grams, GRAM)
    counted = shared.materialise(counted.groupBy("level", "key").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.first("first").alias("first"), F.sum("n").alias("n")))
    left = counted.where("level > 1").groupBy(F.col("suffix").alias("key"), (F.col("level") - 1).alias("level")).agg(F.count("*").alias("kinds"))
    raw = (F.col("level") == order) | (F.col("first") & (F.col("level") > 1))
    a = counted.join(left, ["key", "level"], "left").select("level", "key", "context", F.when(raw, F.col("n")).otherwise(F.coalesce("kinds", "n")).alias("a"))
    a = shared.materialise(a)
    of = lambda k: F.count_if(F.col("a") == k).cast("double")
    met = a.groupBy("level").agg(*(of(k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = [F.when(usable, F.least(F.greatest(k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}"), F.lit(0.1)), F.lit(k - 0.05))).otherwise(F.lit(0.5 * k)).alias(f"d{k}") for k in (1, 2, 3)]
    discounts = met.select("level", *d)  # one row for each level of ``order``
    cut = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = a.join(F.broadcast(discounts), "level").select("level", "key", "context", "a", cut.alias("cut"))
    sums = cut.groupBy("context").agg(F.sum("a").cast("double").alias("total"), F.sum("cut").alias("freed"))
    alphas = cut.join(sums, "context").select("key", ((F.col("a") - F.col("cut")) / F.col("total")).alias("alpha"))
    gammas = sums.select(F.col("context").alias("key"), (F.col("freed") / F.col("total")).alias("gamma"))
    out = alphas.join(gammas, "key", "full").select("key", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    out = shared.materialise(out)
    shared.drop(counted, a)
    return out


def surprise(docs: DataFrame, lm: DataFrame, order: int = ORDER, alphabet: int = 1 << 12) -> DataFrame:
    """``docs`` (text and any other columns) with ``nats`` and ``symbols`` of each whole text under the model."""
    n = blocks.block_count(docs, block_bytes=BLOCK_BYTES)
    packed = blocks.pack(docs, n, by=("doc_id", "text"))

    def keys_of(table):
        keys = Grams(_stream(blocks.texts_of(table)).words, order).distinct()
        return [(keys, None)]

    exchange = blocks.Exchange(packed, n, keys_of, (np.float32, np.float32))
    shards = exchange.shards

    def shard(batches):
        for batch in batches:
            at = blocks.shards_of(batch.column("key").to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["__range", "key", "alpha", "gamma"])

    def answered(asked, known):
        key = known.column("key").to_numpy().view(np.uint64)
        order_ = np.argsort(key)
        key = key[order_]
        alpha, gamma = (np.append(known.column(c).to_numpy()[order_], rest).astype(np.float32) for c, rest in (("alpha", 0), ("gamma", 1)))
        found = []
        for data in asked.column("keys").to_pylist():
            wanted = blocks.unpack_keys(data)
            at = np.searchsorted(key, wanted)
            at[(at < len(key)) & (np.append(key, np.uint64(0))[at] != wanted)] = len(key)
            found.append([blocks.planes(alpha[at]), blocks.planes(gamma[at])])
        columns = [*(asked.column(c) for c in ("__range", "asker", "level")), pa.array(found, pa.list_(pa.binary())), pa.nulls(len(found), pa.binary())]
        return pa.table(columns, ["__range", "asker", "level", "parts", "stats"])

    def last(table, answers):
        stream = _stream(blocks.texts_of(table))
        grams = Grams(stream.words, order)
        keys = grams.distinct()
        alpha, gamma = (x.astype(np.float64) for x in blocks.answers_by_level(answers, (np.float32, np.float32))[1][0])

        def find(wanted):
            at = np.searchsorted(keys, wanted)
            return alpha[at], gamma[at]

        nats = grams.surprise(find, 1 / alphabet)
        spread = lambda x: np.add.reduceat(np.append(x[stream.ids], 0), stream.starts[:-1]) * (np.diff(stream.starts) > 0)
        return table.append_column("nats", pa.array(spread(nats))).append_column("symbols", pa.array(spread(grams.size - 1)))

    sharded = lm.mapInArrow(shard, "__range long, key long, alpha double, gamma double")
    answers = exchange.back(exchange.questions.groupBy("__range").cogroup(sharded.groupBy("__range")).applyInArrow(answered, blocks.ANSWERED))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", nats double, symbols long"
    return blocks.finish(packed, answers, last, schema)


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER, trusted_rows: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """Judge every whole text of ``docs`` (doc_id, text, lang; other columns are ignored) by a model of trusted text.

    Trusted are documents with quality 1 in ``labels`` (doc_id, quality). All of them are used: about four fifths of
    each language's fit the model, by a hash of their id, and all others set their language's median and threshold,
    one of each language at least. A caller may bound the fitting texts by ``trusted_rows``, in equal shares of the
    languages as far as these have texts. Languages without trusted texts, null included, take the largest threshold of the others.
    Null and empty texts have perplexity 1 and are kept. Repeated rows and null ids come back as they are;
    without any trusted text all rows are kept. Texts of any length are scored whole, one block at a time at least; an
    empty table gives none; a perplexity equal to the threshold is kept. Result: doc_id, lang, n_symbols, perplexity,
    threshold, kept, which is perplexity <= threshold.
    """
    return _judged(docs, labels, order, trusted_rows, quantile).select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "kept")


def _equal_share(sizes: list[tuple[int, int]], rows: int) -> float:
    """Texts that each language may give so that ``FITTING * rows`` are given in all; ``sizes`` are (texts, languages)."""
    left, languages = FITTING * rows, sum(k for _, k in sizes)
    for n, k in sorted(sizes):
        if FITTING * n * languages > left:
            return left / languages
        left, languages = left - FITTING * n * k, languages - k
    return float(rows)


def _quantile(seen: DataFrame, value: Column, quantile: float, name: str) -> DataFrame:
    """(lang, ``name``): a quantile of all rows of each language, from counts of values in steps of STEP."""
    counts = seen.groupBy("lang", F.round(value / STEP).cast("long").alias("step")).agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg((F.percentile("step", quantile, F.col("n")) * STEP).alias(name))


def _judged(docs: DataFrame, labels: DataFrame, order: int, trusted_rows: int | None, quantile: float, whole: bool = False) -> DataFrame:
    own = docs.select("doc_id", "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(c for c in docs.columns if c == "__no_text" or c.startswith("__c")))
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__trusted")).distinct()
    place = F.xxhash64("doc_id", F.lit("fit"))
    trusted = own.select("doc_id", "lang").join(ids, F.col("doc_id") == F.col("__trusted")).select("doc_id", F.coalesce("lang", F.lit("")).alias("group")).distinct()
    trusted = shared.materialise(trusted.withColumn("place", place))
    sizes = shared.materialise(trusted.groupBy("group").agg(F.count("*").alias("n"), F.max("place").alias("last")))  # a row for each language
    share = F.lit(FITTING)
    if trusted_rows is not None:
        most = _equal_share([(r["n"], r["count"]) for r in sizes.groupBy("n").count().collect()], trusted_rows)
        share = F.least(share, F.lit(most) / F.col("n"))
    low = (F.col("place").cast("double") + 2.0**63) / 2.0**64 < share
    trusted = shared.materialise(trusted.join(F.broadcast(sizes), "group").select("doc_id", "group", (low & (F.col("place") < F.col("last"))).alias("fits")))
    fitting = trusted.where("fits").select(F.col("doc_id").alias("__trusted"), "group")
    if fitting.count() <= BROADCAST_ROWS:
        fitting = F.broadcast(fitting)
    texts = own.select("doc_id", F.coalesce("lang", F.lit("")).alias("__lang"), "text").join(fitting, (F.col("doc_id") == F.col("__trusted")) & (F.col("__lang") == F.col("group")))
    lm = model(texts.select("text"), order)
    scored = surprise(own, lm, order)
    scored = shared.materialise(scored if whole else scored.drop("text"))
    mean = F.col("nats") / F.col("symbols")
    seen = scored.where("symbols > 0 and lang is not null").select("doc_id", "lang", "nats", "symbols")
    others = trusted.where("not fits").select(F.col("doc_id").alias("__trusted"), "group")
    seen = shared.materialise(seen.join(others, (F.col("doc_id") == F.col("__trusted")) & (F.col("lang") == F.col("group"))).select("lang", "nats", "symbols"))
    middle = _quantile(seen, mean, 0.5, "middle")
    pulled = (F.col("nats") + PULL * F.col("middle")) / (F.col("symbols") + PULL)
    limits = _quantile(seen.join(F.broadcast(middle), "lang"), pulled, quantile, "limit")
    limits = limits.join(middle, "lang").select(F.col("lang").alias("__lang"), "middle", (F.col("limit") + MARGIN).alias("limit"))
    limits = shared.materialise(limits)  # a row for each language
    rest = limits.agg(F.max("limit"), F.max_by("middle", "limit")).first()
    default, default_middle = (rest[0], rest[1]) if rest[0] is not None else (float("inf"), 0.0)
    scored = scored.join(F.broadcast(limits), F.col("lang") == F.col("__lang"), "left")
    scored = scored.withColumn("middle", F.coalesce("middle", F.lit(default_middle))).withColumn("limit", F.coalesce("limit", F.lit(default)))
    perplexity = F.when(F.col("symbols") > 0, F.exp(pulled)).otherwise(F.lit(1.0))
    scored = scored.select("*", F.col("symbols").alias("n_symbols"), perplexity.alias("perplexity"), F.greatest(F.exp("limit"), F.lit(1.0)).alias("threshold"))
    return scored.withColumn("kept", F.col("perplexity") <= F.col("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, all columns untouched; repeated rows and null ids, too. An empty table gives none."""
    used = ("doc_id", "lang", "text")
    others = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in used}
    held = docs.select(*used, F.col("text").isNull().alias("__no_text"), *(F.col(f"`{c}`").alias(n) for c, n in others.items()))
    kept = _judged(held, labels, ORDER, None, QUANTILE, whole=True).where("kept")
    text = F.when(~F.col("__no_text"), F.col("text"))
    return kept.select(*(text.alias(c) if c == "text" else F.col(others.get(c, c)).alias(c) for c in docs.columns))
