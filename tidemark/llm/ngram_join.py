"""Similarity self-join of texts on the Jaccard similarity of their word shingles, by prefix filtering.

Shingles are counted over all documents with the sharded exchange of ``blocks``. Each text orders its shingles
from rare to frequent; two texts that reach the threshold share one of the first n - ceil(t n) + 1. A shingle of
one text, or of copies of one set, can't be shared, so a set whose prefix holds nothing else has no partner and is
done. Equal sets become one representative. Representatives meet in lists, one for each prefix shingle and band of set sizes, where
partners are in the same band or the next (length filter). The positional filter bounds what two sets share from the
places of the shingle, the suffix filter from the suffixes behind it: these are cut at fixed pivots, equal parts of
the hash space, and share at most the smaller count of each part. Both hold at the first shingle that two sets share.
A pair that passes is verified on the whole sets, once: pairs that were verified are remembered, and pairs whose ends
are linked through others need no verification, so a group of near copies costs about one pair for each member.
Long lists are split at random for linking, and at the end compared chunk by chunk, only with the members outside
their largest class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, shared
from .words import word_hashes

WORDS = 5  # words of a shingle
PERCENT = 75  # least similarity in hundredths
CHUNK = 1024  # members of a list that are compared with as many others at once, or sorted together for linking
ROUNDS = 4  # rounds that link neighbours in lists before the rest is compared
PIVOT_BITS = 6  # a suffix is cut into 2 ** PIVOT_BITS parts
FEW_PAIRS = 200_000  # pairs whose ends every task learns
FULL = 255  # a count that does not fit says nothing
SALTS = 16  # tasks that the copies of one set are dealt to when they get their class


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a shorter text its whole sequence, of no words nothing."""
    hashes, starts = word_hashes(texts)
    rolled = hashes[: max(0, len(hashes) - width + 1)]
    for k in range(1, width):
        rolled = blocks.mix(rolled, hashes[k : k + len(rolled)])
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= width:
            out.append(blocks.distinct(rolled[a : b - width + 1]))
        elif b > a:
            whole = hashes[a : a + 1]
            for k in range(a + 1, b):
                whole = blocks.mix(whole, hashes[k : k + 1])
            out.append(blocks.mix(whole, np.array([b - a], np.uint64)))
        else:
            out.append(hashes[:0])
    return out


def _least_common(n, percent: int):
    """Shared members that a partner of a set of ``n`` needs at least: ceil(t n)."""
    return (percent * n + 99) // 100


def _least_overlap(n, m, percent: int):
    """ceil(t / (1 + t) (n + m))."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def _set_key(members: np.ndarray) -> bytes:
    one, two = blocks.mix(members, np.uint64(1)), blocks.mix(members, np.uint64(2))
    return np.array([np.add.reduce(one), np.bitwise_xor.reduce(two)], np.uint64).tobytes() + len(members).to_bytes(8, "little")


def _suffixes(ordered: np.ndarray, first: int, last: int) -> bytes:
    """For each place from ``first`` to ``last`` of a set in its order, the counts of the members behind it by part."""
    part = (ordered >> np.uint64(64 - PIVOT_BITS)).astype(np.int64)
    counts = np.zeros((last - first, 1 << PIVOT_BITS), np.int64)
    counts[-1] = np.bincount(part[last:], minlength=1 << PIVOT_BITS)
    for k in range(last - first - 2, -1, -1):
        counts[k] = counts[k + 1]
        counts[k, part[first + k + 1]] += 1
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document its set size and, where a partner is possible, set key, length of the prefix, the prefix's counts, and the set in its order."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = blocks.block_count(own)
    packed = blocks.pack(own, n, by=("doc_id", "text"))

    def keys_of(table):
        sets = shingle_sets(blocks.texts_of(table), width)
        keys, counts = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
        return [(keys, counts.astype(np.uint32))]

    def last(table, answers):
        sets = shingle_sets(blocks.texts_of(table), width)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        by_key = np.argsort(flat)
        rank = np.empty(len(flat), np.int64)
        rank[by_key] = np.cumsum(np.diff(flat[by_key], prepend=flat[by_key[:1]]) != 0)
        flat_counts = blocks.answers_by_level(answers, (np.uint64,))[1][0][0][rank]
        ends = np.cumsum([len(x) for x in sets], dtype=np.int64).tolist()
        out: dict[str, list] = {k: [] for k in ("set_key", "prefix_end", "counts", "shingles")}
        for members, end in zip(sets, ends):
            size = len(members)
            count = flat_counts[end - size : end]
            length = size - int(_least_common(size, percent)) + 1
            alone = int(np.count_nonzero(count == 1))
            if not size or alone >= length:
                for column in out.values():
                    column.append(None)
                continue
            order = np.lexsort((members, count))
            for name, x in (("set_key", _set_key(members)), ("prefix_end", length), ("counts", blocks.planes(count[order[:length]].astype(np.uint64))), ("shingles", members[order].tobytes())):
                out[name].append(x)
        kinds = {"prefix_end": pa.int32()}
        sizes = pa.array([len(x) for x in sets], pa.int64())
        return pa.table([table.column("doc_id"), sizes, *(pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items())], ["doc_id", "n_shingles", *out])

    return blocks.finish(packed, blocks.counts(packed, n, keys_of), last, "doc_id long, n_shingles long, set_key binary, prefix_end int, counts binary, shingles binary")


def _band(n: Column, percent: int) -> Column:
    """Bands of set sizes, such that partners are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else n.cast("int")


def _shareable(groups: DataFrame) -> DataFrame:
    """The sets of ``groups`` that may share a prefix shingle with another set, with first_pos, the place of the first such.

    A shingle that occurs as often as the set has ``copies`` is in no other set; these lead the order.
    """

    def run(batches):
        for batch in batches:
            counts = [blocks.from_planes(x, np.uint64) for x in batch.column("counts").to_pylist()]
            first = np.array([np.count_nonzero(c <= n) for c, n in zip(counts, batch.column("copies").to_pylist())], np.int32)
            kept = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("set_key", "rep", "n_shingles")), pa.array(first), *(batch.column(c) for c in ("prefix_end", "shingles"))], ["set_key", "rep", "n_shingles", "first_pos", "prefix_end", "shingles"])
            yield kept.filter(pa.array(first < batch.column("prefix_end").to_numpy()))

    return groups.mapInArrow(run, "set_key binary, rep long, n_shingles long, first_pos int, prefix_end int, shingles binary")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(token, band, guest, rep, n, pos, suffix, k, component): prefix shingles that several sets share, in lists of k members.

    Every set is in the list of its own band and, as a guest, in that of the band below; guests meet no guests.
    """

    def spread(batches):
        for batch in batches:
            places = [np.arange(a, b) for a, b in zip(batch.column("first_pos").to_pylist(), batch.column("prefix_end").to_pylist())]
            ordered = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            row = np.repeat(np.arange(len(places)), [len(x) for x in places])
            suffix = b"".join(_suffixes(x, p[0], p[-1] + 1) for x, p in zip(ordered, places))
            token = np.concatenate([x[p] for x, p in zip(ordered, places)] or [np.empty(0, np.uint64)]).view(np.int64)
            pos = np.concatenate(places or [np.empty(0, np.int64)]).astype(np.int32)
            parts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(1 << PIVOT_BITS), len(row), [None, pa.py_buffer(suffix)]).cast(pa.binary())
            take = lambda name: batch.column(name).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(token), take("rep"), take("n_shingles"), pa.array(pos), parts], ["token", "rep", "n", "pos", "suffix"])

    def tokens(batches):
        for batch in batches:
            rows = zip(batch.column("first_pos").to_pylist(), batch.column("prefix_end").to_pylist(), batch.column("shingles").to_pylist())
            found = [np.frombuffer(x, np.int64)[a:b] for a, b, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.empty(0, np.int64)]))], ["token"])

    places = sets.select("rep", "n_shingles", "first_pos", "prefix_end", "shingles")
    several = places.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    spread_out = places.mapInArrow(spread, "token long, rep long, n long, pos int, suffix binary").join(several, "token")
    both = spread_out.withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", _band(F.col("n"), percent) - F.col("guest").cast("int"))
    both = shared.materialise(both)
    shared.release(sets.sparkSession)
    lists = both.groupBy("token", "band").agg(F.count("*").alias("k"), F.count_if(~F.col("guest")).alias("own")).where("k > 1 and own > 0").select("token", "band", "k")
    out = shared.materialise(both.join(lists, ["token", "band"]).select("token", "band", "guest", "rep", "n", "pos", "suffix", "k", F.col("rep").alias("component")))
    shared.drop(both)
    return out


def _open(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The lists that hold more than one class, with each member's class."""
    named = postings.drop("component").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("token", "band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("token", "band")
    return named.join(mixed, ["token", "band"])


def _may_link(n: np.ndarray, m: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: whether two sets can share enough, given the counts of their suffixes."""
    full = np.maximum(one, two).max(1) == FULL
    return full | (1 + np.minimum(one, two).sum(1, dtype=np.int64) >= _least_overlap(n, m, percent))


def _parts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 1 << PIVOT_BITS)


def _neighbours(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each set with the one it meets most often beside it, in size order (turn 0) or in a random order of each list."""
    salt = F.when(F.col("k") > CHUNK, F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("k") / CHUNK))).otherwise(F.lit(0))
    near = Window.partitionBy("token", "band", "salt").orderBy(*(["n", "rep"] if turn == 0 else [F.xxhash64("rep", F.lit(-turn)), "rep"]))
    beside = F.lag(F.struct("rep", "n", "pos", "component", "guest", "suffix")).over(near)
    met = postings.withColumn("salt", salt).select(F.col("rep").alias("b"), "n", "pos", "component", "guest", "suffix", beside.alias("p")).where("p is not null and p.component != component and not (guest and p.guest)")
    least = F.ceil(percent * (F.col("n") + F.col("p.n")) / F.lit(100 + percent))
    passed = (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & (F.least(F.col("n") - F.col("pos"), F.col("p.n") - F.col("p.pos")) >= least)

    def filtered(batches):
        for x in batches:
            ok = _may_link(x.column("n").to_numpy(), x.column("m").to_numpy(), _parts(x.column("one")), _parts(x.column("two")), percent)
            yield x.select(["a", "b"]).filter(pa.array(ok))

    pairs = met.where(passed).select(F.col("p.rep").alias("a"), "b", "n", F.col("p.n").alias("m"), F.col("suffix").alias("one"), F.col("p.suffix").alias("two")).mapInArrow(filtered, "a long, b long")
    best = pairs.groupBy("a", "b").count().groupBy("b").agg(F.max_by("a", F.struct("count", F.negative("a"))).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) and whether their whole sets reach the threshold. Of few pairs, only the sets in question move."""
    pairs = shared.materialise(pairs)
    if pairs.count() <= FEW_PAIRS:
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        sets = sets.join(F.broadcast(ends), "rep", "left_semi")  # twice FEW_PAIRS numbers at most
    left, right = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")

    def verify(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * common >= percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    out = shared.materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, linked boolean"))
    shared.drop(pairs)
    shared.release(pairs.sparkSession)
    return out


def _compared(members: DataFrame, percent: int) -> DataFrame:
    """Pairs from different classes that pass all filters in some list.

    A list's members outside its largest class are compared with all members, in chunks of both. Members of one
    class need no comparison, so the largest class never meets itself.
    """
    classes = members.groupBy("token", "band", "component").agg(F.count("*").alias("size"))
    largest = classes.groupBy("token", "band").agg(F.max_by("component", "size").alias("major"), (F.sum("size") - F.max("size")).alias("minors"), F.sum("size").alias("k"))
    chunks = F.ceil(F.col("k") / CHUNK)
    largest = largest.withColumn("salt", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1))).drop("k")  # members of long lists learn it in many tasks
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("salt")), chunks).cast("int"))
    rows = salted.join(largest, ["token", "band", "salt"]).withColumn("minor", F.col("component") != F.col("major"))
    # row i and column j of the chunks that meet: a minor is in its row, any member in its column
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep", F.lit("i")), F.ceil(F.col("minors") / CHUNK)).cast("int")).withColumn("j", F.pmod(F.xxhash64("rep", F.lit("j")), F.ceil(F.col("k") / CHUNK)).cast("int"))
    last_i, last_j = (F.ceil(F.col(c) / CHUNK).cast("int") - 1 for c in ("minors", "k"))
    columns = ("token", "band", "i", "j", "side", "rep", "n", "pos", "component", "minor", "guest", "suffix")
    side_one = rows.where("minor").withColumn("j", F.explode(F.sequence(F.lit(0), last_j))).withColumn("side", F.lit(1)).select(*columns)
    side_two = rows.withColumn("i", F.explode(F.sequence(F.lit(0), last_i))).withColumn("side", F.lit(2)).select(*columns)
    keys = ["token", "band", "i", "j"]
    dealt = side_one.union(side_two).repartition(*keys).sortWithinPartitions(*keys)

    def pairs_of(table: pa.Table):
        get = {c: table.column(c).to_numpy(zero_copy_only=False) for c in columns if c != "suffix"}
        suffix = _parts(table.column("suffix").combine_chunks())
        change = np.flatnonzero(np.logical_or.reduce([np.diff(get[k]) != 0 for k in keys])) + 1
        found = [np.empty((0, 2), np.int64)]
        for i, j in zip([0, *change], [*change, table.num_rows]):
            rows_ = np.arange(i, j)
            one, two = rows_[get["side"][i:j] == 1], rows_[get["side"][i:j] == 2]
            for k in range(0, len(one), CHUNK):
                x = one[k : k + CHUNK, None]
                n, m = get["n"][x], get["n"][two]
                ok = (get["component"][x] != get["component"][two]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ~(get["guest"][x] & get["guest"][two])
                ok &= ~get["minor"][two] | (get["rep"][x] < get["rep"][two])  # two minors meet twice
                ok &= np.minimum(n - get["pos"][x], m - get["pos"][two]) >= _least_overlap(n, m, percent)
                p, q = np.nonzero(ok)
                for h in range(0, len(p), 20_000):
                    u, v = one[k + p[h : h + 20_000]], two[q[h : h + 20_000]]
                    close = _may_link(get["n"][u], get["n"][v], suffix[u], suffix[v], percent)
                    a, b = get["rep"][u[close]], get["rep"][v[close]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def segments(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            at = [table.column(c).to_numpy() for c in keys]
            tail = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in at]))[-1]) + 1 if any((k != k[-1]).any() for k in at) else 0
            if tail:
                yield pairs_of(table.slice(0, tail).combine_chunks())
            rest = table.slice(tail)
        if rest is not None and rest.num_rows:
            yield pairs_of(rest.combine_chunks())

    return dealt.mapInArrow(segments, "a long, b long").distinct()


def link(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the representatives that have partners.

    Rounds link members of lists to their neighbours from another class, in size order and then in random orders;
    after each, lists of one class are done. What the rounds leave apart is compared in all lists that are left.
    """
    spark = sets.sparkSession
    postings = _postings(sets, percent)
    tried, done, found = spark.createDataFrame([], "a long, b long, linked boolean"), [], None
    for turn in range(ROUNDS):
        new = _neighbours(postings, percent, turn).join(tried, ["a", "b"], "left_anti")
        new = _verified(new, sets, percent)
        tried, done = tried.union(new), [*done, new]
        if not new.where("linked").isEmpty():
            found = shared.components(tried.where("linked"))
            last, postings = postings, shared.materialise(_open(postings, found))
            shared.drop(last, found)
        elif turn > 1:
            break
    new = _compared(postings, percent).join(tried, ["a", "b"], "left_anti")
    new = _verified(new, sets, percent)
    found = shared.components(tried.union(new).where("linked"))
    shared.drop(postings, new, *done)
    return found


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of near-duplicate texts of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty; texts without words link with nothing. Repeated rows come back as often as they occur.
    Rows with a null doc_id keep a null component and link with nothing. An empty table gives none. Texts of any
    length are taken whole; a similarity of exactly ``percent`` hundredths links. Shingles are compared by 64-bit
    hashes; doc_id must be an integer. Result: doc_id, n_shingles, component_id (smallest doc_id reachable by links).
    """
    shared.integral(docs, "doc_id")
    rows = shared.materialise(prefixes(docs, width, percent))
    shared.release(docs.sparkSession)
    possible = rows.where("set_key is not null and doc_id is not null")
    best = F.min_by(F.struct("n_shingles", "prefix_end", "counts", "shingles"), "doc_id")
    groups = possible.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), best.alias("own")).select("set_key", "rep", "copies", "own.*")
    reps = shared.materialise(possible.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    sets = shared.materialise(_shareable(groups))
    names = shared.materialise(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")))
    shared.drop(rows)
    found = link(sets, percent)
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    named = shared.materialise(named)
    shared.drop(sets, reps, found)
    shared.release(docs.sparkSession)
    salted = names.where("set_key is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a set's copies may be a third of all rows
    linked = salted.join(named, ["set_key", "salt"]).select("doc_id", "n_shingles", "component_id")
    return linked.union(names.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def first_of_each_group(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class; other columns pass through untouched.

    Rows with a null doc_id stay, repeated rows of a doc_id that stays do, too; texts without words stay. An empty
    table gives none.
    """
    later = near_duplicates(docs, width, percent).where("doc_id != component_id").select(F.col("doc_id").alias("__later")).distinct()
    return docs.join(later, docs["doc_id"] == later["__later"], "left_anti")
