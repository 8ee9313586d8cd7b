"""Periodic runs of words by a dictionary of basic factors.

For every power of two the dictionary names the factors of that many words, so
that equal names are equal factors.  At each length the occurrences of a
factor that follow one another closely form arithmetic progressions, whose
difference is the factor's own period.  A progression proposes its difference,
and two progressions within twice the length propose the distances that can
still be the smallest period of a run: from any member to the first of the
other, and from last to last.  Each proposal is extended to both sides by
descending through the names, and what is found more than once is kept once,
with its smallest period.

Why that finds every run: let a run have period q and start at s, and let L be
the largest power of two that fits behind s + q.  Since the run is at least 2q
long, q < 2L, and the factor at s recurs at s + q.  If both belong to one
progression, q is its difference.  Otherwise the second one either ends inside
the run, and then so does the first and their last members are q apart, or it
goes on to the run's end, and then s + q is its first member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import id_and_text, pa_type, schema_of, slices

LEAST = 12
_RUNS = "array<struct<start:long,length:long,period:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+``: what bytes.split() parts at."""
    return text.split() if text else []


class BasicFactors:
    """Names of all factors of a power of two words that occur more than once; -1 for the others."""

    def __init__(self, first: np.ndarray):
        """``first``: a name for each word."""
        self.names: list[np.ndarray] = []
        self.order: list[tuple[np.ndarray, np.ndarray]] = []
        n, at = len(first), np.arange(len(first))
        keys = first.astype(np.int64)
        while True:
            by = np.argsort(keys, kind="stable")
            ordered = keys[by]
            begins = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(by) else np.zeros(0, dtype=bool)
            group = np.cumsum(begins) - 1
            again = (np.bincount(group)[group] > 1) if len(by) else begins
            if not again.any():
                return
            place, name = at[by][again], group[again]
            level = np.full(n, -1, dtype=np.int32)
            level[place] = name
            self.names.append(level)
            self.order.append((place, name))
            size = 1 << (len(self.names) - 1)
            # A factor of twice the length can only recur if both halves do.
            at = np.sort(place)
            at = at[at + size < n]
            at = at[level[at + size] >= 0]
            keys = level[at].astype(np.int64) * (int(name[-1]) + 1) + level[at + size]

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from ``x`` on equal those from ``y`` on, for each pair x < y."""
        out = np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            out += self._same(k, x + out, y + out) << k
        return out

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before ``x`` equal those before ``y``, for each pair x < y."""
        out = np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            out += self._same(k, x - out - (1 << k), y - out - (1 << k)) << k
        return out

    def _same(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        names = self.names[k]
        inside = (x >= 0) & (y < len(names))
        a, b = names[np.where(inside, x, 0)], names[np.where(inside, y, 0)]
        return (inside & (a >= 0) & (a == b)).astype(np.int64)

    def proposals(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, period): at least one pair inside each run of ``least`` words or more."""
        for k, (place, name) in enumerate(self.order):
            size = 1 << k
            # A run of least words or more has a factor of over least / 4 words behind its first period.
            if 4 * size < least or len(place) < 2:
                continue
            gap = np.diff(place)
            joined = (name[1:] == name[:-1]) & (2 * gap <= size)
            head = np.flatnonzero(np.concatenate(([True], ~joined)))
            last = np.concatenate((head[1:], [len(place)])) - 1
            inner = last > head
            yield place[head[inner]], place[head[inner] + 1] - place[head[inner]]
            progression = np.cumsum(np.concatenate(([True], ~joined))) - 1
            near, ahead = np.arange(len(place)), 1
            while len(near):
                other = progression[near] + ahead
                near, other = near[other < len(head)], other[other < len(head)]
                to = head[other]
                close = (name[to] == name[near]) & (place[to] - place[last[progression[near]]] <= 2 * size)
                near, other = near[close], other[close]
                period = place[head[other]] - place[near]
                fits = period <= 2 * size
                yield place[near[fits]], period[fits]
                ends = np.flatnonzero(near == last[progression[near]])
                period = place[last[other[ends]]] - place[near[ends]]
                fits = period <= 2 * size
                yield place[near[ends[fits]]], period[fits]
                ahead += 1


def runs_of(first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All maximal runs as rows (start, length, period), by start, then period.

    ``first`` holds a number for each word, equal for equal words.  A run has
    length of at least ``least`` (4 or more) and twice its smallest period.
    """
    found = BasicFactors(first)
    parts = list(found.proposals(least))
    none = np.zeros((0, 3), dtype=np.int64)
    if not parts:
        return none
    at, period = np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])
    # Neighbours that propose the same period lie in the same run.
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    new = np.concatenate(([True], (period[1:] != period[:-1]) | (at[1:] - at[:-1] > 1))) if len(at) else np.zeros(0, dtype=bool)
    at, period = at[new], period[new]
    before, after = found.behind(at, at + period), found.ahead(at, at + period)
    start, length = at - before, before + period + after
    long = length >= np.maximum(least, 2 * period)
    rows = np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0) if long.any() else none
    # A stretch that is found with several periods is a run of the smallest.
    smallest = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.zeros(0, dtype=bool)
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed): one row for each row of ``docs``.

    ``runs`` are all maximal runs of words as (start, length, period), by
    start, then period.  ``collapsed`` (binary) are the words that no run
    covers beyond its first period, joined by one space.  Null, empty and blank
    texts have no words, no runs and an empty ``collapsed``.  Repeated rows are
    treated alike, each for itself; an empty table gives no rows.  All other
    columns of ``docs`` are left behind, whatever their names.

    ``rewrite(id, words)`` may replace a document's words before.  Words of a
    whole slice of documents share one dictionary, where words of different
    documents never have the same name; a text of any length is taken whole,
    with memory for its words times the logarithm of its longest repeat.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = schema_of(rows, "id", ("n_words", "long"), ("runs", _RUNS), ("collapsed", "binary"))
    kind = pa_type(schema["runs"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            if rewrite is not None:
                texts = [rewrite(of, words) for of, words in zip(batch.column("id").to_pylist(), texts, strict=True)]
            numbers: list[int] = []
            for words in texts:
                base = len(numbers)
                known: dict[bytes, int] = {}
                numbers.extend([known.setdefault(w, base + k) for k, w in enumerate(words)])
            sizes = [len(words) for words in texts]
            begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            found = runs_of(np.array(numbers, dtype=np.int64), least)
            owner = np.searchsorted(begins, found[:, 0], side="right") - 1
            found[:, 0] -= begins[owner]
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            collapsed = [b" ".join(without(words, found[a:b])) for words, a, b in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            fields = [pa.array(found[:, k], pa.int64()) for k in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"])).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), runs, pa.array(collapsed, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def without(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` but those inside a run behind its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's words: those of every tenth document (by crc32) repeat with a period from some word on."""
    import zlib

    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * (-(-(n - a) // len(period))))[: n - a]


def op11(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256; then n_words.

    A null doc_id is never planted.  Without runs the four columns of the
    longest run are null and ``runs_sha256`` is that of an empty string.
    """
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = find_runs(docs, rewrite=planted).withColumn("longest", longest)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
