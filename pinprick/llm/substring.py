"""Substring deduplication by recompression.

Every word gets a global number, asked of the tables that all blocks share. Then, round by round, maximal
runs of one symbol and pairs of a left and a right symbol (sides are drawn by a hash of the symbol) become
symbols, whose global numbers one Spark round gives to all blocks: equal numbers stand for equal words,
and where a stretch of words stands twice, its interior is parsed alike. For every symbol the words that
its parse depended on are tracked: wherever these words stand, the symbol does.

With its number a block is told whether any other document holds the symbol. A window that also stands in another document
holds, among the symbols whose words all lie in it, only shared ones. So a symbol that one document has alone
rules out every window around it, gets no number and is a wall to later rounds, as is what lies in no window any more: each
round asks only about what may still repeat. In the end documents made of shared symbols alone are compared as
sequences of these (whole copies), and the windows that are left by 128-bit fingerprints, of which the smallest id that has each is found.
Then words are compared: of every stretch to be removed, windows that cover it are fetched from the documents they are said to
stand in too. Were two windows of one fingerprint to differ, the job fails rather than cut a wrong word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK, MESSAGE, TEXT, Block, each_block, each_bucket, make_blocks, messages, mix, n_buckets, packed, split_by, swept, unpacked, word_hashes
from .common import dropped, stored

ROUNDS, BLOCK_BYTES = 5, 8 << 20
NAMES, OPEN, COPY, WINDOWS, NOTE, FETCH, LOCAL, REPLY, HOLDER = 1, 2, 3, 4, 5, 6, 7, 8, 9  # kinds of messages
LAST = np.iinfo(np.int64).max  # place of a null id: after every id
NONE = np.uint32(0xFFFFFFFF)
WALL = np.int64(-1)


def step(name: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
    """One round: each new symbol as (left, its run, right, its run), right -1 where there is none, with its first
    word and the words [lo, hi) that it depends on. Walls (-1) stay; no symbol crosses them."""
    n, wall = len(name), name == WALL
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | wall[1:]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    size = (end - start).astype(np.int32)
    # a symbol's being alone, or a run's being whole, depends on both neighbours
    wall = wall[start]
    lo, hi = np.where(wall, lo[start], np.minimum(lo[np.maximum(start - 1, 0)], lo[start])), np.where(wall, hi[start], np.maximum(hi[np.minimum(end, n - 1)], hi[end - 1]))
    name, at = name[start], at[start]
    left = (mix(mix(name.view(np.uint64), size), turn) >> np.uint64(41)) & np.uint64(1) == 0
    take = np.zeros(len(name), bool)
    take[:-1] = left[:-1] & ~left[1:] & ~wall[:-1] & ~wall[1:]
    taken = np.zeros(len(name), bool)
    taken[1:] = take[:-1]
    follow, prior = np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
    # a left symbol always depends on what follows; a right one that is left over, on what stood before
    hi2 = np.where(left, np.maximum(hi, hi[follow]), hi)
    lo2 = np.where(take, np.minimum(lo, lo[follow]), np.where(left, lo, np.minimum(lo, lo[prior])))
    lo2, hi2 = np.where(wall, lo, lo2), np.where(wall, hi, hi2)
    kept = ~taken
    right, many = np.where(take, name[follow], WALL), np.where(take, size[follow], 0)
    return tuple(x[kept] for x in (name, size, right, many, at, lo2, hi2))


def number(asked: list[tuple[int, int, bytes]], bucket: int, n: int) -> Iterator[pa.RecordBatch]:
    """Numbers for the keys of one bucket: each block is told the rank of each key it asked for, or that no other document has it."""
    got = [unpacked(d) for _, _, d in asked]
    columns = [np.concatenate(c) for c in zip(*(g[:-1] for g in got))]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    times = np.bincount(group)
    shared = times > 1
    shared |= np.bincount(group, np.concatenate([g[-1] for g in got])) > 0  # two documents of one block
    rank = np.full(len(times), NONE)
    some = np.flatnonzero(shared)
    if len(some) * n >= 1 << 56:
        raise ValueError("more than 2^56 symbols in a round")
    rank[some[np.argsort(-times[some], kind="stable")]] = np.arange(len(some), dtype=np.uint32)  # frequent symbols have small numbers
    told, at, rows = rank[group], 0, []
    for (block, kind, _), g in zip(asked, got):
        rows.append((block, kind, bucket, packed(told[at : at + len(g[0])])))
        at += len(g[0])
    yield messages(rows)


def _ask(block: int, keys: list[np.ndarray], doc: np.ndarray, n: int) -> tuple[list[tuple[int, int, int, bytes]], np.ndarray]:
    """Messages about the distinct keys, each with whether two documents here have it, and each key's place among them."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    any_ = np.empty(len(first), doc.dtype)
    any_[which] = doc
    twice = np.zeros(len(first), bool)
    twice[which[doc != any_[which]]] = True
    keys = [k[first] for k in keys]
    return [(block, NAMES, k, packed(*(x[i] for x in keys), twice[i])) for k, i in split_by(_bucket(keys, n), n)], which


def _bucket(keys: list[np.ndarray], n: int) -> np.ndarray:
    h = keys[0].view(np.uint64) if len(keys) == 1 else mix(mix(keys[0].view(np.uint64), keys[1]), mix(keys[2].view(np.uint64), keys[3]))
    return (mix(h, 3) % np.uint64(n)).astype(np.int64)


def _told(b: Block, keys: list[np.ndarray], n: int, turn: int) -> np.ndarray:
    """Numbers of the block's distinct keys (ascending, as they were asked for); walls for those no other document has."""
    out, answers = np.full(len(keys[0]), WALL), dict(b.told.get(NAMES, []))
    for k, i in split_by(_bucket(keys, n), n):
        rank = unpacked(answers[k])[0]
        out[i] = np.where(rank == NONE, WALL, (np.int64(turn) << 56) + rank.astype(np.int64) * n + k)
    return out


def _closed(open_: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> None:
    """Rule out the windows that hold one of the stretches [lo, hi) of words."""
    fits = hi - lo <= window
    ruled = np.zeros(len(open_) + 1, np.int32)
    np.add.at(ruled, np.maximum(hi[fits] - window, 0), 1)
    np.add.at(ruled, lo[fits] + 1, -1)
    open_ &= np.cumsum(ruled)[:-1] == 0


def _walled(name: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, open_: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Symbols that lie in no open window are walls, too; neighbouring walls become one, which keeps
    what the symbols on either side depend on."""
    covered = np.cumsum(np.bincount(np.concatenate([np.flatnonzero(open_) + 1, [0]]), minlength=len(open_) + 1))  # open windows up to a place
    last = np.append(at[1:], len(open_))
    name = np.where(covered[at + 1] > covered[np.clip(last - window, 0, at)], name, WALL)
    wall = name == WALL
    first = np.ones(len(name), bool)
    first[1:] = ~(wall[1:] & wall[:-1])
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(name)) - 1
    return name[start], at[start], lo[end], hi[start]


class Words:
    """A block's words as hashes, documents between walls."""

    def __init__(self, texts: Iterable[bytes]) -> None:
        h, self.count = word_hashes(texts)
        n = len(self.count)
        ends = np.cumsum(self.count)
        self.first = ends - self.count + 1 + np.arange(n)
        self.hash = np.insert(h, np.concatenate([[0], ends]), np.uint64(0))
        self.wall = np.zeros(len(self.hash), bool)
        self.wall[[0]] = True
        self.wall[self.first + self.count] = True
        self.doc = np.concatenate([[0], np.repeat(np.arange(n), self.count + 1)]).astype(np.int32)


def _fingerprints(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the ``window`` words from each place on, by doubling."""
    out = []
    for seed in (0x51, 0xA7):
        x, n = mix(h, seed), 1
        while 2 * n <= window:
            x, n = mix(x[:-n], x[n:]), 2 * n
        if n < window:
            x = mix(x[: -(window - n)], x[window - n :])
        out.append(x)
    return out[0], out[1]


def _order(ids: list[int | None]) -> np.ndarray:
    return np.array([LAST if i is None else i for i in ids], np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    Words are runs of anything but ASCII white space. A word is removed if a window of ``window``
    consecutive words that covers it also starts in a document with a smaller id, as judged
    on the input. Null and empty texts have no words. A null id is larger than every id; no
    id is smaller than itself, so repeated rows keep their words. An empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    spark = docs.sparkSession
    blocks = make_blocks(docs, id_col, text_col, BLOCK_BYTES)
    n = n_buckets(blocks, 350_000)
    state_of = T._parse_datatype_string(BLOCK)

    def ask_words(b: Block) -> Iterator[pa.RecordBatch]:
        words = Words(b.texts())
        rows, _ = _ask(b.number, [words.hash[~words.wall].view(np.int64)], words.doc[~words.wall], n)
        if rows:
            yield messages(rows)

    def name(bucket: int, asked: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        yield from number(asked, bucket, n)

    def go_on(b: Block, symbols: tuple[np.ndarray, ...], open_: np.ndarray, first: np.ndarray, count: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        """The block's state, and what it asks about its next symbols."""
        symbols = _walled(*symbols, open_, window)
        rows = [(b.number, TEXT, 0, packed(*symbols, np.packbits(open_), np.array([len(open_)]), first, count))]
        if turn <= ROUNDS:
            left, run, right, many, at, _, _ = step(*symbols, turn)
            new = (left != WALL) & ((run > 1) | (right != WALL))
            doc = np.searchsorted(first, at[new], "right")
            rows += _ask(b.number, [x[new] for x in (left, run, right, many)], doc, n)[0]
        m = len(rows)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))), pa.array([b.ids] + [None] * (m - 1), pa.list_(pa.int64())), pa.array([b.sizes] + [None] * (m - 1), pa.binary())], names=state_of.names)

    def begin(b: Block) -> Iterator[pa.RecordBatch]:
        words = Words(b.texts())
        keys, which = np.unique(words.hash[~words.wall].view(np.int64), return_inverse=True)
        names = np.full(len(words.hash), WALL)
        names[~words.wall] = _told(b, [keys], n, 0)[which]
        at = np.arange(len(names), dtype=np.int32)
        open_ = np.zeros(len(names), bool)
        for f, c in zip(words.first.tolist(), words.count.tolist()):
            open_[f : f + max(0, c - window + 1)] = True
        alone = (names == WALL) & ~words.wall
        _closed(open_, at[alone], at[alone] + 1, window)
        yield from go_on(b, (names, at, at, at + np.int32(1)), open_, words.first, words.count, 1)

    def again(turn: int) -> Callable[[Block], Iterator[pa.RecordBatch]]:
        def work(b: Block) -> Iterator[pa.RecordBatch]:
            *symbols, bits, size, first, count = unpacked(b.data)
            open_ = np.unpackbits(bits, count=int(size[0])).astype(bool)
            left, run, right, many, at, lo, hi = step(*symbols, turn)
            new = (left != WALL) & ((run > 1) | (right != WALL))
            keys = [x[new] for x in (left, run, right, many)]
            order = np.lexsort(keys[::-1])
            fresh = np.ones(len(order), bool)
            if len(order):
                fresh[1:] = False
                for k in keys:
                    fresh[1:] |= k[order][1:] != k[order][:-1]
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(fresh) - 1
            names = left.copy()
            names[new] = _told(b, [k[order[fresh]] for k in keys], n, turn)[which]
            alone = new & (names == WALL)
            _closed(open_, lo[alone], hi[alone], window)
            yield from go_on(b, (names, at, lo, hi), open_, first, count, turn + 1)

        return work

    told = stored(each_bucket(each_block(blocks, ask_words, MESSAGE), name, MESSAGE), "substring-names")
    swept(spark)
    state = stored(each_block(blocks, begin, state_of, told), "substring-state")
    dropped(told)
    for turn in range(1, ROUNDS + 1):
        told = stored(each_bucket(state.where(F.col("kind") == NAMES), name, MESSAGE), "substring-names")
        after = stored(each_block(state.where(F.col("kind") == TEXT), again(turn), state_of, told), "substring-state")
        dropped(told)
        dropped(state)
        state = after
        swept(spark)

    # Documents without walls, by their symbols: only those with the smallest id go on.
    def whole(b: Block) -> Iterator[pa.RecordBatch]:
        names, at, *_, first, count = unpacked(b.data)
        ends, rows = np.searchsorted(at, [first, first + count]), []
        for k in np.flatnonzero(count >= window).tolist():
            own = names[ends[0][k] : ends[1][k]]
            if len(own) and at[ends[0][k]] == first[k] and (own != WALL).all():
                rows.append((b.number, k, LAST if b.ids[k] is None else b.ids[k], hashlib.sha256(own.tobytes()).digest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "ord", "place", "symbols"])

    long = stored(each_block(state, whole, "block long, ord int, place long, symbols binary"), "substring-whole")
    firsts = long.groupBy("symbols").agg(F.min(F.struct("place", "block", "ord")).alias("_f"), F.count("*").alias("_n")).where("_n > 1")
    # a text with very many copies is a skewed key of a plain join, which adaptive execution splits
    copies = stored(long.join(firsts.select("symbols", F.col("_f.place").alias("_place"), F.col("_f.block").alias("_block"), F.col("_f.ord").alias("_ord")), "symbols").where("place > _place").select("block", "ord", "_block", "_ord"), "substring-copies")
    rows = F.array_sort(F.collect_list(F.struct("ord", "_block", "_ord")))  # at most a block's documents
    copies = stored(copies.groupBy("block").agg(rows.alias("r")).select("block", F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), F.concat_ws(",", F.transform("r", lambda x: F.concat_ws(" ", x["ord"], x["_block"], x["_ord"]))).cast("binary").alias("data")), "substring-copied")

    def opened(b: Block) -> Iterator[pa.RecordBatch]:
        *_, bits, size, first, count = unpacked(b.data)
        open_ = np.flatnonzero(np.unpackbits(bits, count=int(size[0])))
        doc = np.searchsorted(first, open_, "right") - 1
        yield messages([(b.number, OPEN, 0, packed(doc.astype(np.int32), (open_ - first[doc]).astype(np.int32)))])

    notes = stored(each_block(state, opened, MESSAGE), "substring-open")
    dropped(state)
    swept(spark)

    def ask_windows(b: Block) -> Iterator[pa.RecordBatch]:
        some, doc, at, x, y = _windows(b, window)
        if len(at):
            place = _order(b.ids)[some][doc]
            order = np.lexsort((place, y, x))
            x, y, place, doc, at = x[order], y[order], place[order], doc[order], at[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            yield messages([(b.number, WINDOWS, k, packed(x[new][i], y[new][i], place[new][i], some[doc[new][i]].astype(np.int32), at[new][i])) for k, i in split_by((x[new] % np.uint64(n)).astype(np.int64), n)])

    def first_windows(bucket: int, asked: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Whether a smaller id has each window, and where the first is of those that several blocks have."""
        got = [unpacked(d) for _, _, d in asked]
        x, y, place, ord_, at = (np.concatenate([g[k] for g in got]) for k in range(5))
        block = np.repeat(np.array([b for b, _, _ in asked]), [len(g[0]) for g in got])
        order = np.lexsort((at, ord_, block, place, y, x))
        new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
        group = np.empty(len(x), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        earlier, k, rows = place[first][group] < place, 0, []
        for (b, _, _), g in zip(asked, got):
            rows.append((b, WINDOWS, bucket, packed(np.packbits(earlier[k : k + len(g[0])]))))
            k += len(g[0])
        f = first[np.bincount(group, minlength=len(first)) > 1]
        yield messages([*rows, (-1, HOLDER, bucket, packed(x[f], y[f], block[f], ord_[f], at[f]))])

    found = stored(each_bucket(each_block(blocks, ask_windows, MESSAGE, notes, copies), first_windows, MESSAGE), "substring-found")
    swept(spark)

    # What is to be removed is compared word by word: the block asks for windows that cover it.
    def ask_places(b: Block) -> Iterator[pa.RecordBatch]:
        some, doc, at, x, y = _windows(b, window)
        hit, elsewhere, here = _hits(b, some, doc, x, y, n)
        rows = [(b.number, NOTE, -1, packed(some[doc[hit]].astype(np.int32), at[hit]))]
        t = np.flatnonzero(hit)[_tiles(doc[hit], at[hit], window)]
        far, near = t[elsewhere[t]], t[~elsewhere[t]]
        rows += [(b.number, FETCH, k, packed(x[far][i], y[far][i], some[doc[far][i]].astype(np.int32), at[far][i])) for k, i in split_by((x[far] % np.uint64(n)).astype(np.int64), n)]
        if len(near):  # the first is in this block
            there = here[near]
            rows.append((b.number, LOCAL, -1, packed(np.full(1, b.number), some[doc[there]].astype(np.int32), at[there], some[doc[near]].astype(np.int32), at[near])))
        yield messages(rows)

    asked = stored(each_block(blocks, ask_places, MESSAGE, notes, copies, found.where(F.col("kind") == WINDOWS)), "substring-asked")

    def find_places(bucket: int, asked: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """To the blocks that hold the first of the windows asked for: who asks, and where both windows are."""
        rows = []
        x, y, block, ord_, at = next((unpacked(d) for _, kind, d in asked if kind == HOLDER), [np.zeros(0, np.uint64)] * 5)
        for b, kind, d in asked:
            if kind == FETCH:
                u, v, o, a = unpacked(d)
                where = np.searchsorted(x, u)
                while (other := y[where] != v).any():
                    where[other] += 1  # another window with the first half of the fingerprint
                sources, of = np.unique(block[where], return_inverse=True)
                rows += [(int(sources[s]), FETCH, bucket, packed(np.full(1, b), ord_[where[i]], at[where[i]], o[i], a[i])) for s, i in split_by(of, len(sources))]
        if rows:
            yield messages(rows)

    wanted = stored(each_bucket(asked.where(F.col("kind") == FETCH).unionByName(found.where(F.col("kind") == HOLDER)), find_places, MESSAGE), "substring-wanted")
    wanted = wanted.unionByName(asked.where(F.col("kind") == LOCAL).withColumn("kind", F.lit(FETCH)))
    sources = copies.select("block", F.explode(F.split(F.col("data").cast("string"), ",")).alias("_c")).select("block", F.split("_c", " ").alias("_c"))
    sources = sources.select(F.element_at("_c", 2).cast("long").alias("_to"), "block", F.element_at("_c", 3).alias("_from")).distinct()
    sources = sources.groupBy("_to", "block").agg(F.array_sort(F.collect_list("_from")).alias("_l"))  # for a pair of blocks: at most a block's documents
    sources = sources.select(F.col("_to").alias("block"), F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), F.concat_ws(",", F.col("block").cast("string"), F.concat_ws(",", "_l")).cast("binary").alias("data"))

    def answer(b: Block) -> Iterator[pa.RecordBatch]:
        """The words of windows that blocks ask for, and digests of the words of documents that others are said to copy."""
        held: dict[int, list[bytes]] = {}
        requests = [unpacked(d) for _, d in b.told.get(FETCH, [])]
        copied = [d.decode().split(",") for _, d in b.told.get(COPY, [])]
        needed = {o for r in requests for o in r[1].tolist()} | {int(o) for d in copied for o in d[1:]}
        if not needed:
            return
        for k, text in enumerate(b.texts()):
            if k in needed:
                held[k] = text.split()
        for block, ord_, at, o, a in requests:
            words = [b" ".join(held[i][j : j + window]) for i, j in zip(ord_.tolist(), at.tolist())]
            yield messages([(int(block[0]), REPLY, 0, packed(o, a, np.frombuffer(b"\n".join(words), np.uint8)))])
        sha = {o: hashlib.sha256(b" ".join(held[o])).digest() for o in {int(o) for d in copied for o in d[1:]}}
        for to, *own in copied:
            own = np.array(own, np.int64)
            yield messages([(int(to), REPLY, 1, packed(np.full(1, b.number), own, np.frombuffer(b"".join(sha[o] for o in own.tolist()), np.uint8)))])

    replies = stored(each_block(blocks, answer, MESSAGE, wanted, sources), "substring-replies")
    swept(spark)
    schema = T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)

    def cut(b: Block) -> Iterator[pa.RecordBatch]:
        skip, out, bad = _copies(b), [], "two stretches of words share their symbols or fingerprint but differ"
        doc, at = next((unpacked(d) for _, d in b.told.get(NOTE, [])), (np.zeros(0, np.int32),) * 2)
        starts: dict[int, np.ndarray] = {}
        if len(doc):
            new = np.flatnonzero(np.diff(doc, prepend=-1))
            starts = dict(zip(doc[new].tolist(), np.split(at, new[1:])))
        same: dict[int, list[tuple[int, bytes]]] = {}
        copied: dict[tuple[int, int], bytes] = {}
        for kind, d in b.told.get(REPLY, []):
            if kind == 0:
                o, a, words = unpacked(d)
                for i, j, w in zip(o.tolist(), a.tolist(), words.tobytes().split(b"\n")):
                    same.setdefault(i, []).append((j, w))
            else:
                source, o, sha = unpacked(d)
                copied |= {(int(source[0]), i): sha[32 * k : 32 * k + 32].tobytes() for k, i in enumerate(o.tolist())}
        for k, text in enumerate(b.texts()):
            words = text.split()
            kept = words
            if k in skip:
                if copied.get(skip[k]) != hashlib.sha256(b" ".join(words)).digest():
                    raise RuntimeError(bad)
                kept = []
            elif k in starts:
                cover = np.zeros(len(words) + 1, np.int32)
                proved = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, starts[k], 1)
                np.add.at(cover, starts[k] + window, -1)
                for j, w in same.get(k, []):
                    if b" ".join(words[j : j + window]) != w:
                        raise RuntimeError(bad)
                    proved[j] += 1
                    proved[j + window] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                if (gone & (np.cumsum(proved)[:-1] == 0)).any():
                    raise RuntimeError("a stretch to be removed was not compared")
                kept = [x for x, g in zip(words, gone.tolist()) if not g]
            joined = b" ".join(kept)
            out.append((b.ids[k], len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode()] * with_text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=schema.names)

    return each_block(blocks, cut, schema, asked.where(F.col("kind") == NOTE), copies, replies).withColumnRenamed("doc_id", id_col)


def _windows(b: Block, window: int) -> tuple[np.ndarray, ...]:
    """Open windows of the documents that go on: these documents, each window's place among them, its start and both fingerprints."""
    doc, at = unpacked(b.told[OPEN][0][1])
    go = ~np.isin(doc, list(_copies(b)))
    doc, at = doc[go], at[go]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    some, doc = np.unique(doc, return_inverse=True)
    wanted = set(some.tolist())
    words = Words(t for k, t in enumerate(b.texts()) if k in wanted)
    x, y = _fingerprints(words.hash, window)
    here = at + words.first[doc]
    return some, doc, at, x[here], y[here]


def _hits(b: Block, some: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows also start in a document of a smaller id, which of them in another block, and the first of each here."""
    if not len(x):
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
    answers, place = dict(b.told.get(WINDOWS, [])), _order(b.ids)[some][doc]
    order = np.lexsort((place, y, x))
    new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
    group = np.empty(len(x), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    earlier = np.zeros(len(first), bool)
    for k, i in split_by((x[first] % np.uint64(n)).astype(np.int64), n):
        earlier[i] = np.unpackbits(unpacked(answers[k])[0], count=len(i)).astype(bool)
    return (place > place[first][group]) | earlier[group], earlier[group], first[group]


def _tiles(doc: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Some of the windows (ascending by document and start) that cover all the words that all of them cover."""
    if not len(at):
        return np.zeros(0, np.int64)
    place = at + doc.astype(np.int64) * (int(at.max()) + window + 2)  # windows of two documents never touch
    taken = [0]
    while True:
        last = taken[-1]
        reach = int(np.searchsorted(place, place[last] + window, "right")) - 1
        if max(reach, last + 1) == len(place):
            return np.array(taken)
        taken.append(max(reach, last + 1))


def _copies(b: Block) -> dict[int, tuple[int, int]]:
    """Documents of the block that copy one with a smaller id, and where that is."""
    found = (x.split() for _, d in b.told.get(COPY, []) for x in d.decode().split(","))
    return {int(x): (int(block), int(ord_)) for x, block, ord_ in found}
