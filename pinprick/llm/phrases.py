"""Frequent phrases and how strongly their words belong together.

1. Every task counts the hashes of all its phrases of one to five words in a count-min sketch; sketches are added up
   piece by piece in Spark. A sum of such counters is never below a phrase's number of occurrences, so phrases
   below ``least`` in some row of counters are out. The counters are only held against ``least``, so they stop there: one
   byte each, and one bit each once they are added up, which all tasks get.
2. The rest, all frequent phrases and a few more, are counted exactly by their words.
3. Frequent phrases are scored at their weakest cut by joins with the same counts, those that nearly always occur within a longer
   one go, and the best of each language get a rank.

The sketch grows with the text up to ``most`` counters a row. Beyond, more phrases pass it, and the second step counts more; the result stays the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import _FACTORS, _LOWER, _factors, mix
from .common import free_name, let_go, n_partitions, stored, tuned

#: Rows of counters, counters in a piece that is added up at once, bytes of text worked on at once, and bytes of text that share a sketch.
ROWS, PIECE, SPAN, SHARE = 2, 1 << 18, 1 << 18, 64 << 20
_ENDS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[*b" \t"]] = True


class Words:
    """The words of some texts, A-Z folded: hashes, places in the bytes, and how many words of the same text piece follow each, itself included."""

    def __init__(self, texts: list[bytes], groups: np.ndarray) -> None:
        self.raw = raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        cut = _BREAK[raw]
        gap = cut | _GAP[raw]
        first = ~gap
        first[1:] &= gap[:-1]
        self.start = start = np.flatnonzero(first).astype(np.int32)
        last = ~gap
        last[:-1] &= gap[1:]
        self.end = np.flatnonzero(last) + 1
        n = len(start)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        self.group = groups[doc]
        if not n:
            self.hash, self.room = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        place = np.arange(len(raw), dtype=np.int32) - start[np.maximum(np.cumsum(first, dtype=np.int32) - 1, 0)]
        place[gap] = 0
        if int(place.max()) + 1 > len(_FACTORS[0]):
            _FACTORS[0] = _factors(2 * int(place.max()) + 2)
        values = (raw.astype(np.uint64) + np.uint64(1)) * _FACTORS[0][place]
        values[gap] = 0
        self.hash = mix(np.add.reduceat(values, start), 0)
        piece = np.cumsum(cut, dtype=np.int32)[start]
        ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, n)
        self.room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)

    def phrases(self, longest: int, names: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, hashes) of the phrases of n words for each n; ``names`` are the groups' hashes."""
        at = np.arange(len(self.hash))
        h = mix(self.hash, names[self.group])
        yield 1, at, h
        for n in range(2, longest + 1):
            keep = self.room[at] >= n
            at = at[keep]
            h = mix(h[keep], self.hash[at + n - 1])
            yield n, at, h

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist()))

    @property
    def data(self) -> bytes:
        if not hasattr(self, "_data"):
            self._data = self.raw.tobytes()
        return self._data


def _cut(text: bytes) -> Iterator[list[bytes]]:
    """A text in parts of about SPAN bytes that end where a piece ends."""
    at = 0
    while len(text) - at > SPAN and (found := _ENDS.search(text, at + SPAN)):
        yield [text[at : found.start()]]
        at = found.end()
    yield [text[at:]]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of some hundred kilobytes of text at a time (a longer text on its own), and the groups' names."""
    for b in batches:
        groups = b.column(0).dictionary_encode()
        codes, names = np.asarray(groups.indices), groups.dictionary.to_pylist()
        sizes = np.cumsum(b.column(2).to_numpy())
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SPAN, "right")))
            texts = b.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
            for part in _cut(texts[0]) if hi == lo + 1 else [texts]:
                yield Words(part, codes[lo:hi]), names
            lo = hi


def _named(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


def _places(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h, row + 1) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(rows: DataFrame, longest: int, least: int, bits: int) -> bytes:
    """For each counter of the merged sketches, whether it reaches ``least``, packed: ``ROWS`` rows of 2^bits counters."""
    spark = rows.sparkSession
    kind = np.uint8 if least <= 255 else np.uint16 if least <= 65535 else np.uint32
    piece = min(PIECE, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for words, names in _spans(batches):
            if own is None:
                own = np.zeros((ROWS, 1 << bits), np.uint32)
            for _, _, h in words.phrases(longest, _named(names)):
                for r in range(ROWS):
                    np.add.at(own[r], _places(h, r, bits), np.ones(len(h), np.uint32))
        if own is not None:
            for k, part in enumerate(own.reshape(-1, piece)):
                if part.any():
                    data = zstandard.compress(np.minimum(part, least).astype(kind).tobytes(), 3)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["piece", "data"])
        own = None
        let_go()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.compress(np.packbits(total >= least).tobytes())], pa.binary())], names=["piece", "data"])

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(data), kind)
                if k != now:
                    if total is not None:
                        yield told()
                    now, total = k, np.zeros(piece, np.uint64)
                total += part
        if total is not None:
            yield told()

    parts = rows.mapInArrow(count, "piece int, data binary").repartition(n_partitions(spark), "piece").sortWithinPartitions("piece")
    out = np.zeros((ROWS << bits) // 8, np.uint8)
    for r in parts.mapInArrow(merge, "piece int, data binary").collect():  # a bit for each counter, however many texts
        out[r.piece * piece // 8 : (r.piece + 1) * piece // 8] = np.frombuffer(zstandard.decompress(r.data), np.uint8)
    return out.tobytes()


def phrase_counts(df: DataFrame, text_col: str = "text", group_col: str = "lang", *, longest: int = 5, least: int = 100, unknown: str = "und", most: int = 1 << 25) -> DataFrame:
    """(lang, phrase, words, f) of every phrase of one to ``longest`` words that occurs at least ``least`` times within text pieces of its group, exactly,
    and one row for each group with an empty phrase, 0 words and the number of all its words.

    A-Z are folded; pieces end at ``.,;:!?`` and line ends; words are stretches of anything but spaces and tabs, joined by one space. Null texts are
    empty, a null group is ``unknown``; a group without words has no row.
    """
    spark = tuned(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(unknown)).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.where("text <> ''").withColumn("size", F.octet_length("text").cast("long"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bits = max(12, (min(most, total // 64) or 1).bit_length())
    bits = min(bits, (most - 1).bit_length())
    few = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // SHARE)))
    seen = spark.sparkContext.broadcast(sketch(few, longest, least, bits))  # at most ROWS * most bits

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(seen.value, np.uint8).reshape(ROWS, -1)
        for words, names in _spans(batches):
            group, phrase, size, f = [], [], [], []
            for g, n in enumerate(np.bincount(words.group, minlength=len(names)).tolist()):
                if n:
                    group.append(names[g]), phrase.append(b""), size.append(0), f.append(n)
            for n, at, h in words.phrases(longest, _named(names)):
                for r in range(ROWS):
                    p = _places(h, r, bits)
                    keep = (frequent[r][p >> 3] >> (7 - (p & 7))) & 1 == 1
                    at, h = at[keep], h[keep]
                # equal phrases: by this hash and another one of the same words
                other = np.zeros(len(at), np.uint64)
                for k in range(n):
                    other = mix(other ^ words.hash[at + k], k + 0xABCD)
                order = np.argsort(h, kind="stable")
                at, h, other = at[order], h[order], other[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1]))) if len(at) else np.zeros(0, np.int64)
                f += np.diff(new, append=len(at)).tolist()
                heads = at[new]
                group += [names[g] for g in words.group[heads].tolist()]
                phrase += [words.text(i, n) for i in heads.tolist()]
                size += [n] * len(heads)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(size, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "words", "f"])
        let_go()

    counted = rows.mapInArrow(survivors, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return stored(counted.where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def collocations(df: DataFrame, text_col: str = "text", group_col: str = "lang", *, longest: int = 5, least: int = 100, within: int = 100, top: int = 2000, unknown: str = "und", most: int = 1 << 25) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to ``longest`` words of each group.

    ``a`` is a phrase's number of occurrences, at least ``least``; ``n`` all words of the group. A cut after the first words gives ``l`` and ``r`` for the two
    parts and the score ``floor(1000 * a * n / (l * r))``; the lowest cut counts, the first of equal ones. A phrase within a longer one that has at least ``within`` percent of its
    occurrences is left out. Ranks go by score, then ``a`` (both descending), then the phrase in UTF-8 order. Products have up to 38 digits.
    """
    counts = phrase_counts(df, text_col, group_col, longest=longest, least=least, unknown=unknown, most=most)
    found = counts.where("words > 1").withColumn("_w", F.split("phrase", " "))
    # a longer phrase is never more frequent, so those one word longer decide
    longer = found.where("words > 2").select("lang", F.explode(F.array(F.array_join(F.expr("slice(_w, 1, words - 1)"), " "), F.array_join(F.expr("slice(_w, 2, words - 1)"), " "))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < within * F.col("f"), F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "_w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(_w, 1, k)"), " ").alias("_first"), F.array_join(F.expr("slice(_w, k + 1, words - k)"), " ").alias("_rest"))
    part = lambda key, name: counts.where("words > 0").select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = cuts.join(part("_first", "l"), ["lang", "_first"]).join(part("_rest", "r"), ["lang", "_rest"])
    cuts = cuts.join(counts.where("words = 0").select("lang", F.col("f").alias("n")), "lang")
    big = lambda x, digits: F.col(x).cast(T.DecimalType(digits, 0))
    cuts = cuts.withColumn("_above", F.lit(1000).cast("decimal(4,0)") * big("a", 16) * big("n", 16)).withColumn("_below", big("l", 18) * big("r", 18))
    cuts = cuts.withColumn("score", F.expr("_above div _below"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = weakest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
