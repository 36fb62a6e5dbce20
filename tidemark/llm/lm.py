"""Language-model scoring with a weighted backoff automaton.

Counting: blocks of documents ask shards for the training counts of the n-grams they hold (see ``blocks``), so
the model never exists in one place: each block builds the part of the automaton that its texts can reach.
States are contexts seen in training, arcs are n-grams seen in training, failure arcs lead to the next shorter
context with a backoff weight. Smoothing: absolute discounting for single words, whose freed mass is the
probability of the unknown-word class; for longer contexts p(w|h) = (c(hw) + mu p(w|h')) / (c(h) + mu).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .words import Words

START, END = b" start", b" end"  # no word holds a space
MU = 20.0
SEGMENT = 256  # tokens that one lane of the traversal walks


class Grams:
    """Distinct n-grams of some texts, by level: codes, hashed keys and, by position, their ranks."""

    def __init__(self, texts: list[bytes], order: int):
        words = Words(texts, (START,), (END,))
        self.starts, self.ids, n = words.starts, words.ids, len(words.words)
        place = np.arange(len(self.ids)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        self.rank, self.keys = [self.ids.astype(np.int64)], [words.hashes]
        self.context, self.suffix, self.word = [np.zeros(n, np.int64)], [np.zeros(n, np.int64)], [np.arange(n)]
        for level in range(2, order + 1):
            at = np.flatnonzero(place >= level - 1)
            code = self.rank[-1][at - 1] * n + self.ids[at]
            found, first, where = np.unique(code, return_index=True, return_inverse=True)
            rank = np.full(len(self.ids), -1, np.int64)
            rank[at] = where
            self.context.append(found // n if n else found)
            self.word.append(found % n if n else found)
            self.suffix.append(self.rank[-1][at[first]])
            self.keys.append(blocks.mix(self.keys[-1][self.context[-1]], words.hashes[self.word[-1]]))
            self.rank.append(rank)

    def sorted_by_key(self, level: int) -> np.ndarray:
        return np.argsort(self.keys[level], kind="stable")

    def counted(self, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the sorted keys and how often training texts hold them."""
        weight = np.repeat(train, np.diff(self.starts)).astype(np.float64)
        out = []
        for level, rank in enumerate(self.rank):
            at = rank >= 0
            counts = np.bincount(rank[at], weight[at], len(self.keys[level])).astype(np.uint32)
            order = self.sorted_by_key(level)
            out.append((self.keys[level][order], counts[order]))
        return out


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block, from their training counts."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, distinct: int, once: int, twice: int, mu: float = MU):
        order = len(counts)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        self.unknown = np.log10(discount * distinct / tokens) if tokens else 0.0
        p = np.where(counts[0] > 0, np.maximum(counts[0] - discount, 0) / max(tokens, 1), 0)
        self.offset = np.concatenate([[1], 1 + np.cumsum([len(c) for c in counts[: order - 1]])]).astype(np.int64) if order > 1 else np.array([1])
        states = int(self.offset[order - 1]) if order > 1 else 1
        self.depth, self.fail, self.backoff = np.zeros(states, np.int8), np.zeros(states, np.int64), np.zeros(states)
        self.weight, self.goto = [], []
        goto = np.zeros(0, np.int64)
        for m in range(order):  # n-grams of m + 1 words
            if m:
                seen = counts[m - 1][grams.context[m]]
                p = np.where(counts[m] > 0, (counts[m] + mu * p[grams.suffix[m]]) / (np.maximum(seen, 1) + mu), 0)
            with np.errstate(divide="ignore"):
                self.weight.append(np.where(counts[m] > 0, np.log10(p), np.nan))
            below = goto[grams.suffix[m]] if m else np.zeros(len(counts[0]), np.int64)
            if m < order - 1:
                own = self.offset[m] + np.arange(len(counts[m]))
                self.depth[own], self.fail[own] = m + 1, below
                self.backoff[own] = np.log10(mu / (counts[m] + mu))
                goto = np.where(counts[m] > 0, own, below)
            else:
                goto = below
            self.goto.append(goto)

    def walk(self, grams: Grams) -> np.ndarray:
        """log10 probability of each position (0 at starts): one traversal from left to right, in parallel lanes.

        A lane walks a segment of a text. A state never depends on more than order - 1 words, so a lane that
        starts those words early, without adding them up, is in the state that a walk from the text's start has.
        """
        order, out = len(self.weight), np.zeros(len(grams.ids))
        lanes = [(max(a, p - order + 1), max(a + 1, p), min(p + SEGMENT, b)) for a, b in zip(grams.starts[:-1].tolist(), grams.starts[1:].tolist()) for p in range(a, b, SEGMENT)]
        if not lanes:
            return out
        at, first, end = (np.array(x) for x in zip(*lanes))
        longest = np.argsort(at - end, kind="stable")
        at, first, end = at[longest], first[longest], end[longest]
        state = np.zeros(len(at), np.int64)
        while len(at):
            total, next_state, open_ = np.zeros(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
            for d in range(order - 1, -1, -1):
                here = np.flatnonzero(open_ & (self.depth[state] == d))
                if not len(here):
                    continue
                rank = grams.rank[d][at[here]]
                arc = np.where(rank >= 0, self.weight[d][rank], np.nan)
                hit = ~np.isnan(arc)
                if d == 0:
                    total[here] += np.where(hit, arc, self.unknown)
                    next_state[here] = np.where(hit, self.goto[0][rank], 0)
                    break
                found, lost = here[hit], here[~hit]
                total[found] += arc[hit]
                next_state[found] = self.goto[d][rank[hit]]
                open_[found] = False
                total[lost] += self.backoff[state[lost]]
                state[lost] = self.fail[state[lost]]
            out[at] = np.where(at >= first, total, out[at])
            at = at + 1
            live = int(np.count_nonzero(at < end))  # lanes are sorted by length, so the live ones lead
            at, first, end, state = at[:live], first[:live], end[:live], next_state[:live]
        return out


def _training(counts: list[np.ndarray], stats: np.ndarray, start: int) -> tuple[int, int, int, int]:
    """Tokens, distinct tokens, seen once, seen twice; the start symbol is no token."""
    c = int(counts[0][start]) if len(counts[0]) else 0
    return int(stats[0]) - c, int(stats[1]) - (c > 0), int(stats[2]) - (c == 1), int(stats[3]) - (c == 2)


def score(docs: DataFrame, order: int = 2, mu: float = MU, held_out_of: int = 10) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Rows whose crc32(doc_id as text) mod ``held_out_of`` is not 0 are the training texts. A null text is empty
    and holds the end token only; a null doc_id counts as the id "". Repeated rows are counted and returned as
    often as they occur. Without training texts every token has log-probability 0. An empty table gives none.
    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % held_out_of == 0
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    n = blocks.block_count(own)
    packed = blocks.pack(own, n, by=("doc_id", "text"))

    def keys_of(table: pa.Table):
        return Grams(blocks.texts_of(table), order).counted(~table.column("held_out").to_numpy(zero_copy_only=False))

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams, got = Grams(blocks.texts_of(table), order), blocks.answers_by_level(answers, (np.uint64,))
        counts = []
        for level in range(order):
            by_rank = np.empty(len(grams.keys[level]), np.int64)
            by_rank[grams.sorted_by_key(level)] = got[level + 1][0][0].astype(np.int64)
            counts.append(by_rank)
        tokens, distinct, once, twice = _training(counts, got[1][1], int(grams.ids[0]) if len(grams.ids) else 0)
        logp = Automaton(grams, counts, tokens, distinct, once, twice, mu).walk(grams)
        token = np.ones(len(grams.ids), bool)
        token[grams.starts[:-1]] = False
        c = np.where(token, counts[0][grams.ids], 0)
        base = np.where(token, np.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1))), 0)
        total = lambda x: np.add.reduceat(x, grams.starts[:-1])  # noqa: E731  each text has two symbols at least
        columns = [table.column("doc_id"), table.column("held_out"), pa.array(np.diff(grams.starts) - 1), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(table.num_rows, tokens, np.int64)), pa.array(total(base)), pa.array(total(logp))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = blocks.counts(packed, n, keys_of)
    kind = dict(docs.dtypes)["doc_id"]
    return blocks.finish(packed, answers, last, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
