"""Stretches of words that repeat periodically, by linear-time runs over an ordered alphabet.

The longest Lyndon word at each place ends before the next smaller suffix. Each run (a maximal stretch with a smallest
period) has a Lyndon root under an order of the words or under its reverse, and where such a root occurs for the
first time, the distance to the next smaller suffix is the run's period. So two Lyndon arrays and one
extension to the left for each candidate tell all runs. Suffixes are compared word by word; what has been matched
at a distance is remembered for that distance and passed over afterwards, so that no pair of places
is matched twice. No suffix arrays or trees, no fingerprints of substrings: words are only told apart and ordered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let_go, tuned, utf8


def lyndon_array(values: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """The next smaller suffix of each place of ``values``, and in how many words the two suffixes agree where that is not 0, from the last place on.

    The end counts as smaller than everything. Values are at least 0.
    """
    n = len(values)
    w = np.append(values, -1)
    after, agree = list(range(1, n + 2)), {}
    begin, end = [-1] * (n + 1), [-1] * (n + 1)  # by distance: the leftmost stretch known to match
    places = np.flatnonzero(w[1:] >= w[:-1])[::-1].tolist()  # elsewhere the next word is smaller
    w = w.tolist()
    for i in places:
        a, j = w[i], after[i + 1] if w[i + 1] > w[i] else i + 1
        while w[j] > a:
            j = after[j]
        if w[j] < a:
            after[i] = j
            continue
        m, ask = 1, True
        while True:
            if ask:  # match on from what is known
                d, x = j - i, i + m
                if begin[d] <= x <= end[d]:
                    x = end[d]
                else:
                    stop = begin[d]
                    while w[x] == w[x + d]:
                        x += 1
                        if x == stop:
                            x = end[d]
                            break
                begin[d], end[d], m = i, x, x - i
            if w[i + m] > w[j + m]:
                break
            # suffix j is larger: its own next smaller one is next, and how far those two agree is known
            known, j = agree.get(j, 0), after[j]
            if known < m:
                m = known
                break
            ask = known == m
        after[i] = j
        if m:
            agree[i] = m
    return after, agree


def runs_of(values: np.ndarray, shortest: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``values`` at least ``shortest`` words and ``times`` (two or more) periods long, in order."""
    n, found = len(values), set()
    if n < shortest:
        return []
    for w in (values, values.max() - values):
        after, agree = lyndon_array(w)
        seen: dict[int, int] = {}  # by period: the end of the last run
        for i in reversed(agree):
            far, d = agree[i], after[i] - i
            if far <= (times - 2) * d or seen.get(d) == i + d + far:
                continue
            seen[d], at = i + d + far, i
            while at and w[at - 1] == w[at - 1 + d]:
                at -= 1
            if seen[d] - at >= max(shortest, times * d):
                found.add((at, seen[d] - at, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shortest: int = 6, times: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: its runs as (start, length, period), by start and period, and its text without
    the words that a run holds after its first period, joined by one space.

    Words are stretches of anything but ASCII white space, numbered from 0. A run has one smallest period, is at least
    ``shortest`` words and ``times`` periods long and cannot be extended. Null and empty texts have no words and
    no runs; ids of any type may be null or repeat; other columns are left out. Rows are worked on
    one by one, without a shuffle, in memory proportional to the longest text.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    tuned(df.sparkSession)
    kind = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T._parse_datatype_string("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, runs, left = [], [], []
            for text in utf8(b.column(1)):
                words = text.split()
                number: dict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                own = runs_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), shortest, times)
                size.append(len(words))
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in own])
                if own:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s, k, p in own:
                        edge[s + p] += 1
                        edge[s + k] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(runs, run_type), pa.array(left, pa.binary()).cast(pa.string())], names=kind.names)
        let_go()

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(work, kind).withColumnRenamed("id", id_col)


def looped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with a loop written into a tenth of its texts: from some word on, one stretch of the text repeats to its end.

    Which texts, where from and how long a stretch follows from the CRC-32 of the id as text (null as "null").
    """
    h, g, words, n, a, p = (free_name(df.columns, x) for x in ("_h", "_g", "_words", "_n", "_a", "_p"))
    out = df.withColumn(h, F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))).withColumn(g, F.expr(f"{h} div 10"))
    out = out.withColumn(words, F.when(F.col(h) % 10 == 0, F.split(F.regexp_replace(F.col(f"`{text_col}`"), "^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$", ""), "[ \\x09-\\x0D]+")))
    out = out.withColumn(words, F.when(F.element_at(words, 1) != "", F.col(words))).withColumn(n, F.size(words)).withColumn(a, (F.col(g) % F.col(n)).cast("int"))
    out = out.withColumn(p, F.expr(f"cast(1 + ({n} - {a}) div (3 + {g} % 8) as int)"))
    tail = F.expr(f"slice(flatten(array_repeat(slice({words}, {a} + 1, {p}), cast(ceil(({n} - {a}) / {p}) as int))), 1, {n} - {a})")
    text = F.when(F.col(words).isNotNull(), F.array_join(F.concat(F.expr(f"slice({words}, 1, {a})"), tail), " ")).otherwise(F.col(f"`{text_col}`"))
    return out.withColumn(text_col, text).drop(h, g, words, n, a, p)
