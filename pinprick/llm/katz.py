"""Katz backoff language model of any order, with Good-Turing discounts.

Counts are kept in tables partitioned by key: words with their count, and for each order n-grams as (history, word)
with theirs, dealt by history; the n-grams of a very frequent history are dealt over as many pieces as its count asks for. Words
and n-grams get 64-bit numbers, so that a history is one number whatever its length. A token's probability is
found by recursion: an n-gram that was counted has its discounted relative frequency; else the history's backoff weight
times the probability by the shorter history; at the end the word's own probability, which is again discounted, or, for a word
never counted, the mass the discounts left over. Backoff weights come from the n-grams of a history and their words'
probabilities by the shorter one, so each history's probabilities add up to one.

Documents ask the tables in blocks (see :mod:`.blocks`), order by order: for their distinct words, then for
their distinct n-grams, then for the backoff weights of the histories that need one. Sums over a history are whole
numbers (how many of its n-grams, and of their shorter ones, were counted once, twice, ...), so weights are exact however a
history is dealt. Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, MESSAGE, NAMES, TEXT, Block, each_block, each_bucket, make_blocks, messages, mix, n_buckets, packed, split_by, swept, unpacked, word_hashes
from .common import dropped, stored

BLOCK_BYTES, LARGEST = 8 << 20, 5
TABLE, STATS, ASKED = 50, 51, 60  # kinds of messages; others are orders, and 20 + order for weights
END, BEGIN = np.uint64(1), np.uint64(2)  # names of the end token and of what stands before a text
NO_ID = np.int64(-1)
BEGIN_ID = np.int64(1) << np.int64(62)
NO_RANK = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Discounts:
    """Factor for each count: Good-Turing up to the largest count at which it is sound, then none;
    an absolute discount of every count where it never is."""

    factors: tuple[float, ...]
    absolute: float

    @staticmethod
    def of(n: list[int]) -> "Discounts":
        """``n[r]``: how many types have count r, for r from 1 to LARGEST + 1."""
        for k in range(LARGEST, 0, -1):
            if not n[1] or any(not n[r] for r in range(1, k + 2)):
                continue
            top = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if top != 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return Discounts(tuple(d), 0.0)
        return Discounts((), (n[1] + 0.5) / (n[1] + 2 * n[2] + 1))

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = np.asarray(c, np.float64)
        if not self.factors:
            return np.maximum(c - self.absolute, 0)
        table = np.array([0.0, *self.factors, 1.0])
        return c * table[np.minimum(c, len(table) - 1).astype(np.int64)]

    def taken(self, few: np.ndarray, types: np.ndarray) -> np.ndarray:
        """What discounts take from sums of counts: ``few[r]`` of the types have count r + 1."""
        if not self.factors:
            return self.absolute * types
        return sum((r * (1 - f) * few[r - 1] for r, f in enumerate(self.factors, 1)), np.zeros(len(types)))

    def leaves_all(self, least: np.ndarray) -> np.ndarray:
        """Whether types of at least this count lose nothing."""
        return np.asarray(least) > len(self.factors) if self.factors else np.zeros(len(least), bool)


def training(ids: list[int | None], folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"null" if i is None else str(i).encode()) % folds != fold for i in ids], bool)


def _pieces(history: np.ndarray, word: np.ndarray, count: np.ndarray, hot: int, n: int) -> np.ndarray:
    """Bucket of each n-gram: of its history, or of one of a frequent history's pieces."""
    piece = mix(word.view(np.uint64), 13) % (count // hot + 1).astype(np.uint64)
    return (mix(mix(history.view(np.uint64), 11), piece) % np.uint64(n)).astype(np.int64)


def _runs(history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending histories as starts, differences and lengths of their runs."""
    start = np.flatnonzero(np.diff(history, prepend=-1))
    return start, np.diff(history[start], prepend=0).astype(np.uint64), np.diff(np.append(start, len(history))).astype(np.uint32)


class Grams:
    """The distinct n-grams of one order in a block: history and word as numbers, ascending by history, and each token's place among them (-1: none)."""

    def __init__(self, hs: np.ndarray, history: np.ndarray, word: np.ndarray, local: np.ndarray) -> None:
        """``hs``: the block's histories, ascending; ``history``: each token's place among them (-1: none)."""
        known = np.flatnonzero((history >= 0) & (word != NO_ID))
        keys = history[known].astype(np.uint64) << np.uint64(32) | local[known].astype(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.token = known[order[new]]  # some token that has it
        self.history, self.word = hs[(keys[new] >> np.uint64(32)).astype(np.int64)], word[self.token]
        self.place = np.full(len(word), -1, np.int32)
        self.place[known[order]] = np.cumsum(new, dtype=np.int32) - 1


class Text:
    """A block's tokens, one text's after another's, with what the block was told so far, order by order."""

    def __init__(self, b: Block, model: "Scalars") -> None:
        self.b, self.model = b, model
        at, count, number, size = unpacked(b.data)
        self.at, self.size, self.own = at.astype(np.int32), size, number
        self.first = np.cumsum(size) - size
        self.train = np.repeat(training(b.ids, model.folds, model.fold), size)
        self.word = number[self.at]
        #: For each order up to now: count and number of the n-gram that ends at each token, and total of its history.
        self.counts, self.numbers, self.totals, self.grams = [count[self.at]], [self.word], [np.full(len(self.at), max(model.tokens[0], 1))], []

    def history(self) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of the longest history known so far of each token."""
        h, c = np.concatenate([[NO_ID], self.numbers[-1][:-1]]), np.concatenate([[0], self.counts[-1][:-1]])
        first = len(self.counts) == 1
        h[self.first], c[self.first] = (BEGIN_ID, self.model.texts) if first else (NO_ID, 0)
        h[c == 0] = NO_ID
        return h, c

    def ask(self) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
        """N-grams of the next order, the count of each one's history, and their buckets; and each token's history."""
        h, c = self.history()
        # places of the histories among the block's, without sorting by token: words or n-grams of the order before, by number
        number, of = (self.own, self.at) if len(self.counts) == 1 else (self.last, self.grams[-1].place)
        order = np.argsort(number, kind="stable")
        place = np.empty(len(order) + 1, np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        place[-1] = -1
        before = place[np.concatenate([of[:1], of[:-1]])]
        hs = np.append(number[order], BEGIN_ID)
        before[self.first] = len(order) if len(self.counts) == 1 else -1
        before[h == NO_ID] = -1
        g = Grams(hs, before, self.word, self.at)
        return g, c[g.token], _pieces(g.history, g.word, c[g.token], self.model.hot, self.model.n), h

    def told(self, weighed: bool = True) -> None:
        """Take in what the block was told about the next order."""
        order, m = len(self.counts) + 1, self.model
        g, _, bucket, h = self.ask()
        c, number, least = np.zeros(len(g.word) + 1, np.int64), np.full(len(g.word) + 1, NO_ID), np.full(len(g.word) + 1, LARGEST + 1)
        answers = dict(self.b.told.get(order, []))
        for k, i in split_by(bucket, m.n):
            count, rank, low = unpacked(answers[k])
            c[i], least[i] = count, low
            if len(rank):
                number[i] = np.where(rank == NO_RANK, NO_ID, rank.astype(np.int64) * m.n + k)
        _, own = self.history()
        self.counts.append(c[g.place])
        self.numbers.append(number[g.place])
        self.last = number[:-1]
        self.grams = [g]
        # a history whose n-grams all keep their count has its total raised by one
        raised = m.discounts[order - 1].leaves_all(least)[g.place] & (own > 0) & (self.counts[-1] > 0)
        self.asked = h, own
        self.sums = None
        if weighed:
            hs, need, sums = self._weights(order)
            at = np.searchsorted(hs, h)
            has = (h != NO_ID) & (at < len(hs)) & (hs[np.minimum(at, max(len(hs) - 1, 0))] == h) if len(hs) else np.zeros(len(h), bool)
            all_kept = m.discounts[order - 1].leaves_all(np.where(sums[0] > 0, self._least(sums), 0))
            raised = np.where(has, all_kept[at * has], raised) if len(hs) else raised
            self.sums = has, at * has, sums
        self.totals.append(own + raised)

    def _least(self, sums: np.ndarray) -> np.ndarray:
        """Least count of each history's n-grams, by how many have each."""
        some = sums[1 : 1 + LARGEST] > 0
        return np.where(some.any(0), some.argmax(0) + 1, LARGEST + 1)

    def needed(self) -> tuple[np.ndarray, np.ndarray]:
        """Histories of the last order whose sums the block needs, ascending, and their counts: those of tokens that back off, and those dealt in pieces."""
        h, c = self.asked
        need = (h != NO_ID) & ((self.counts[-1] == 0) | (c >= self.model.hot))
        hs, first = np.unique(h[need], return_index=True)
        return hs, c[need][first]

    def _weights(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hs, c = self.needed()
        sums = np.zeros((2 + 2 * LARGEST, len(hs)))
        answers = dict(self.b.told.get(20 + order, []))
        for k, i in _addresses(hs, c, self.model.hot, self.model.n):
            for row, x in enumerate(unpacked(answers[k])):
                sums[row][i] += x
        return hs, c, sums

    def probability(self) -> np.ndarray:
        """Each token's own probability, without history."""
        c = self.counts[0]
        return np.where(c > 0, self.model.discounts[0](c) / self.totals[0], self.model.unknown)

    def backed(self, p: np.ndarray, lower_totals: np.ndarray) -> np.ndarray:
        """Probabilities by the last order taken in, from those by the one before."""
        m, order = self.model, len(self.counts)
        h, own = self.asked
        total = np.maximum(self.totals[-1], 1)
        seen = m.discounts[order - 1](self.counts[-1]) / total
        has, at, sums = self.sums
        types, few, lower, rest = sums[0], sums[1 : 1 + LARGEST], sums[1 + LARGEST : 1 + 2 * LARGEST], sums[-1]
        if len(types):
            kept = own - m.discounts[order - 1].taken(few, types)[at]
            left = 1 - kept / total
            low = (sum(r * lower[r - 1] for r in range(1, LARGEST + 1)) + rest - m.discounts[order - 2].taken(lower, types))[at] / np.maximum(lower_totals, 1)
            weight = np.where(has & (own > 0), left / np.maximum(1 - low, 1e-12), 1.0)
        else:
            weight = np.ones(len(p))
        return np.where(self.counts[-1] > 0, seen, weight * p)


def _addresses(hs: np.ndarray, count: np.ndarray, hot: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of the histories with pieces there) for histories with their counts."""
    many = (count // hot + 1).astype(np.int64)
    of = np.repeat(np.arange(len(hs)), many)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    bucket = (mix(mix(hs.view(np.uint64)[of], 11), piece) % np.uint64(n)).astype(np.int64)
    for k, i in split_by(bucket, n):
        yield k, np.unique(of[i])  # two pieces may share a bucket


@dataclass(frozen=True)
class Scalars:
    """What is one number for the whole corpus."""

    n: int  # buckets
    folds: int
    fold: int
    texts: int = 0  # for training
    tokens: tuple[int, ...] = ()  # by order
    types: int = 0  # words
    unknown: float = 1.0  # probability of all words never counted, as one type
    hot: int = 1  # histories are dealt in pieces of about so many tokens
    discounts: tuple[Discounts, ...] = ()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, order: int = 2, folds: int = 5, fold: int = 1) -> DataFrame:
    """Score every text by a model of ``order`` trained on those outside the held-out fold.

    Tokens are runs of anything but ASCII white space, A-Z lowered, and one end per text; the history of a text's first tokens is
    what there is, with one mark for its start. Columns:
    id, held_out, n_tokens, n_known, train_tokens, base_score (log10 probability by single
    words with half a count added) and score (log10 probability by the model). Null and empty
    texts have the end alone; a null id is text 'null' for the fold; repeated rows count
    as often as they stand. Without training texts every word is unknown and the score is 0. An
    empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = docs.sparkSession
    blocks = make_blocks(docs, id_col, text_col, BLOCK_BYTES)
    n = n_buckets(blocks, 1_500_000)

    def words_of(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, count = word_hashes(b.texts(), lower=True)
        h = np.insert(np.where(h <= BEGIN, h + np.uint64(3), h), np.cumsum(count), END)
        return *np.unique(h, return_inverse=True), count + 1

    def by_hash(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return split_by((mix(words, 7) % np.uint64(n)).astype(np.int64), n)

    def ask_words(b: Block) -> Iterator[pa.RecordBatch]:
        words, at, size = words_of(b)
        c = np.bincount(at[np.repeat(training(b.ids, folds, fold), size)], minlength=len(words)).astype(np.uint32)
        yield messages([(b.number, 1, k, packed(words[i], c[i])) for k, i in by_hash(words)])

    def count_words(bucket: int, asked: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(d) for _, _, d in asked]
        words, which = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        c = np.bincount(which, np.concatenate([g[1] for g in got]), len(words)).astype(np.int64)
        rank = _ranked(c)
        at, rows = 0, [(-1, TABLE, bucket, packed(words[c > 0], c[c > 0])), (-1, STATS, bucket, packed(_stats(c)))]
        for (block, _, _), g in zip(asked, got):
            i = which[at : at + len(g[0])]
            rows.append((block, 1, bucket, packed(c[i], rank[i])))
            at += len(g[0])
        yield messages(rows)

    told = stored(each_bucket(each_block(blocks, ask_words, MESSAGE), count_words, MESSAGE), "katz-1")
    swept(spark)
    stats = _total(told)
    d = Discounts.of(stats[2:].tolist())
    kept = stats[0] - float(d.taken(stats[3 : 3 + LARGEST, None].astype(float), stats[1:2].astype(float))[0])
    model = Scalars(n, folds, fold, _n_training(blocks, folds, fold), (int(stats[0]),), int(stats[1]), 1 - kept / stats[0] if stats[0] else 1.0, max(1000, int(stats[0]) // (4 * n)), (d,))

    def encode(b: Block) -> Iterator[pa.RecordBatch]:
        """The block with words as places among its distinct ones, and their counts and numbers."""
        words, at, size = words_of(b)
        count, number = np.zeros(len(words), np.int64), np.full(len(words), NO_ID)
        answers = dict(b.told[1])
        for k, i in by_hash(words):
            c, rank = unpacked(answers[k])
            count[i], number[i] = c, np.where(rank == NO_RANK, NO_ID, rank.astype(np.int64) * n + k)
        data = packed(at.astype(np.uint32), count, number, size.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([b.number]), pa.array([TEXT], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary()), pa.array([b.ids], pa.list_(pa.int64())), pa.array([b.sizes], pa.binary())], names=[*NAMES, "ids", "sizes"])

    state = stored(each_block(blocks, encode, BLOCK, told.where(F.col("kind") == 1)), "katz-state", **{"parquet.block.size": str(8 << 20)})
    dropped(told)
    dropped(blocks)
    swept(spark)

    def up_to(b: Block, model: Scalars, level: int, weighed: bool) -> tuple[Text, np.ndarray]:
        """The block's text with all orders up to ``level`` taken in, the last with or without its weights, and probabilities by the last weighed one."""
        t = Text(b, model)
        p = t.probability()
        for k in range(2, level + 1):
            lower = t.totals[-1]
            t.told(k < level or weighed)
            if k < level or weighed:
                p = t.backed(p, lower)
        return t, p

    facts: list[DataFrame] = []
    for level in range(2, order + 1):
        last = level == order

        def ask(b: Block, model: Scalars = model, level: int = level) -> Iterator[pa.RecordBatch]:
            t, _ = up_to(b, model, level - 1, True)
            g, own, bucket, _ = t.ask()
            c = np.bincount(g.place[t.train & (g.place >= 0)], minlength=len(g.word)).astype(np.uint32)
            lower, total = t.counts[-1][g.token].astype(np.uint64), t.totals[-1][g.token] if level > 2 else np.zeros(len(g.token), np.int64)
            rows = []
            for k, i in split_by(bucket, model.n):
                start, steps, runs = _runs(g.history[i])
                rows.append((b.number, level, k, packed(steps, runs, total[i][start].astype(np.uint64), g.word[i].view(np.uint64), c[i], lower[i])))
            if rows:
                yield messages(rows)

        def count(bucket: int, asked: list[tuple[int, int, bytes]], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            got = [unpacked(d) for _, _, d in asked]
            history = np.concatenate([np.repeat(np.cumsum(g[0]), g[1]) for g in got])
            total = np.concatenate([np.repeat(g[2], g[1]) for g in got])
            word, c, lower = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
            order_ = np.lexsort((word, history))
            new = np.ones(len(order_), bool)
            new[1:] = (np.diff(history[order_]) != 0) | (np.diff(word[order_]) != 0)
            which = np.empty(len(order_), np.int64)
            which[order_] = np.cumsum(new) - 1
            first = order_[new]
            c = np.bincount(which, c, len(first)).astype(np.int64)
            seen = c > 0
            h = history[first]
            rank = _ranked(c) if not last else np.zeros(0, np.uint32)
            # least count among a history's n-grams here
            start = np.flatnonzero(np.diff(h, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
            least = np.minimum.reduceat(np.where(seen, np.minimum(c, LARGEST + 1), LARGEST + 1), start)
            least = np.repeat(least, np.diff(np.append(start, len(h)))).astype(np.uint8)
            f = first[seen]
            begin, steps, runs = _runs(history[f].view(np.int64))
            rows = [(-1, TABLE, bucket, packed(steps, runs, total[f][begin], word[f], c[seen].astype(np.uint64), lower[f])), (-1, STATS, bucket, packed(_stats(c)))]
            at = 0
            for (block, _, _), g in zip(asked, got):
                i = which[at : at + len(g[3])]
                rows.append((block, level, bucket, packed(c[i].astype(np.uint64), rank[i] if not last else rank, least[i])))
                at += len(g[3])
            yield messages(rows)

        table = stored(each_bucket(each_block(state, ask, MESSAGE, *facts), count, MESSAGE), f"katz-{level}")
        swept(spark)
        stats = _total(table)
        model = Scalars(n, folds, fold, model.texts, (*model.tokens, int(stats[0])), model.types, model.unknown, model.hot, (*model.discounts, Discounts.of(stats[2:].tolist())))
        facts.append(table.where(F.col("kind") == level))

        def ask_weights(b: Block, model: Scalars = model, level: int = level) -> Iterator[pa.RecordBatch]:
            t, _ = up_to(b, model, level, False)
            hs, c = t.needed()
            rows = [(b.number, ASKED, k, packed(_runs(hs[i])[1])) for k, i in _addresses(hs, c, model.hot, model.n)]
            if rows:
                yield messages(rows)

        def weigh(bucket: int, asked: list[tuple[int, int, bytes]], level: int = level) -> Iterator[pa.RecordBatch]:
            """For each history asked for: its types, how many were counted once, twice, ..., the same of the shorter n-grams, and the sum of the other counts of these."""
            hs, sums = np.zeros(0, np.uint64), np.zeros((2 + 2 * LARGEST, 1), np.uint32)
            for _, kind, data in asked:
                if kind == TABLE:
                    steps, runs, _, _, c, lower = unpacked(data)
                    hs = np.cumsum(steps)
                    if len(hs):
                        start = np.cumsum(runs.astype(np.int64)) - runs
                        rows = [np.ones(len(c), np.int64), *(c == r for r in range(1, LARGEST + 1)), *(lower == r for r in range(1, LARGEST + 1)), np.where(lower > LARGEST, lower, 0)]
                        sums = np.stack([np.add.reduceat(np.asarray(x, np.int64), start) for x in rows])
            out = []
            for block, kind, data in asked:
                if kind == ASKED:
                    own = np.cumsum(unpacked(data)[0])
                    at = np.minimum(np.searchsorted(hs, own), max(len(hs) - 1, 0))
                    has = hs[at] == own if len(hs) else np.zeros(len(own), bool)  # a piece may have no n-gram
                    out.append((block, 20 + level, bucket, packed(*(np.where(has, x[at], 0).astype(np.uint64 if k == len(sums) - 1 else np.uint32) for k, x in enumerate(sums)))))
            if out:
                yield messages(out)

        weights = stored(each_bucket(each_block(state, ask_weights, MESSAGE, *facts).unionByName(table.where(F.col("kind") == TABLE)), weigh, MESSAGE), f"katz-weights-{level}")
        swept(spark)
        facts.append(weights)

    def finish(b: Block) -> Iterator[pa.RecordBatch]:
        t, p = up_to(b, model, order, True)
        own, m = t.counts[0], len(t.size)
        logs = [np.add.reduceat(np.log10(x), t.first) for x in (p, (own + 0.5) / (model.tokens[0] + 0.5 * (model.types + 1)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.ids, pa.int64()), pa.array(~training(b.ids, folds, fold)), pa.array(t.size), pa.array(np.add.reduceat((own > 0).astype(np.int64), t.first)), pa.array(np.full(m, model.tokens[0])), pa.array(logs[1]), pa.array(logs[0])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    out = each_block(state, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", *facts)
    return out.withColumnRenamed("doc_id", id_col)


def _ranked(c: np.ndarray) -> np.ndarray:
    """Ranks by falling count of what was counted: frequent words and n-grams have small numbers."""
    rank, known = np.full(len(c), NO_RANK), np.flatnonzero(c > 0)
    rank[known[np.argsort(-c[known], kind="stable")]] = np.arange(len(known), dtype=np.uint32)
    return rank


def _stats(c: np.ndarray) -> np.ndarray:
    """Tokens, types, and how many types have count 0 (always 0), 1, ... LARGEST + 1."""
    c = c[c > 0].astype(np.int64)
    few = np.bincount(c[c <= LARGEST + 1], minlength=LARGEST + 2)
    return np.concatenate([[c.sum(), len(c)], few]).astype(np.int64)


def _total(table: DataFrame) -> np.ndarray:
    """Sums of the buckets' statistics, a few numbers each."""
    total = np.zeros(LARGEST + 4, np.int64)
    for r in table.where(F.col("kind") == STATS).select("data").toLocalIterator():
        total = total + unpacked(bytes(r["data"]))[0]
    return total


def _n_training(blocks: DataFrame, folds: int, fold: int) -> int:
    """Training texts: the count of the history at a start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(training(ids or [], folds, fold).sum()) for ids in b.column(0).to_pylist()], pa.int64())], names=["n"])

    return int(blocks.select("ids").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
