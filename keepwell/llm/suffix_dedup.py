"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

Every window of ``length`` bytes of a text has a representative suffix: the
one whose first GRAM bytes have the least hash among all that fit in the
window.  Equal windows have the same representative at the same place, so two
windows can only be equal if their representatives share a prefix of GRAM
bytes.  Only representatives are indexed (about one suffix in 85).

The index is a family of suffix arrays.  A suffix is held as the 64-bit
signature of its first GRAM bytes, and an array is a table sorted by
signature and bucketed by it: equal prefixes are neighbours, which is all
that a scan for long matches needs of the order.  A new batch of documents
gets its suffix array; it is merge-scanned against every level of the family,
which shows the signatures that occur again; then levels of equal size merge,
as in binary counting, so a suffix is rewritten at most log2(batches) times.

The signatures found give candidates.  An exact check follows.  The windows
of one representative are a run; a run whose whole bytes occur again is
repeated as a whole.  Other runs that share a signature are brought together
with their bytes and their windows compared one by one; for a signature with
very many different runs the windows are counted by a hash on the cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.llm.columns import pa_type, schema_of, slices
from keepwell.session import written

GRAM = 32
BATCHES = 4
#: Different runs of one signature that one task compares at once; those of a more frequent signature are dealt out by window.
TOGETHER = 4_096
_POSITION = np.uint64(2**24 - 1)
_SEEDS = (1, 2)


def _mix(x: np.ndarray, multiplier: int) -> np.ndarray:
    x = x * np.uint64(multiplier)
    x ^= x >> np.uint64(29)
    return x


def signatures(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on."""
    view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = _mix(view ^ np.uint64(0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9)
    h = _mix(h, 0x94D049BB133111EB)
    size = 8
    for multiplier in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = _mix(h[:-size] * np.uint64(0x8EBC6AF09C88C6E3) + h[size:], multiplier)
        size *= 2
    return h


def window_runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, representative, first, last): the runs of window starts with the same representative.

    A text longer than a piece of 2**23 bytes is handled in pieces, which
    may cut a run in two.
    """
    n, piece = len(data), 2**23
    parts = [_runs(data[at : at + piece + length - 1], length, at) for at in range(0, max(n - length + 1, 0), piece)]
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(data: bytes, length: int, offset: int):
    h = signatures(np.frombuffer(data, dtype=np.uint8))
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    return h[place[first]], place[first] + offset, first + offset, last + offset


def _text_key(data: bytes) -> tuple[int, int]:
    """128 bits that stand for the text, as two signed numbers."""
    return tuple(int.from_bytes(xxhash.xxh3_64_digest(data, seed), "big", signed=True) for seed in _SEEDS)


def _suffix_arrays(docs: DataFrame, length: int) -> DataFrame:
    """(sig, n): the sorted representatives of each slice of a batch, equal prefixes counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [window_runs(x, length)[:2] for x in batch.column("text").to_pylist() if x and len(x) >= length]
            if not found:
                continue
            # A representative cut off by a piece's edge is one suffix: the same place is counted once.
            sig = np.concatenate([s[np.concatenate(([True], p[1:] != p[:-1]))] for s, p in found])
            sig, n = np.unique(sig.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(n)], names=["sig", "n"])

    return docs.mapInArrow(run, "sig long, n long")


class SuffixArrayFamily:
    """Levels of sorted, bucketed suffix arrays; level k holds 2**k batches or none.

    Levels are managed tables in the session's warehouse, all with the same
    number of buckets, so scans and merges of levels need no shuffle.  A level
    that was merged into a larger one is dropped after that one is written.
    """

    def __init__(self, spark: SparkSession, length: int, buckets: int | None = None):
        self.spark, self.length = spark, length
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.repeated: list[DataFrame] = []
        self._name = f"suffix_arrays_{uuid.uuid4().hex}"
        self._made = 0

    def _save(self, rows: DataFrame) -> str:
        """``rows`` are dealt by signature into ``buckets`` partitions already."""
        self._made += 1
        name = f"{self._name}_{self._made}"
        rows.write.bucketBy(self.buckets, "sig").sortBy("sig").saveAsTable(name)
        return name

    def add(self, docs: DataFrame) -> None:
        """Index a batch, scan it against all levels, and merge levels of equal size."""
        new = self._save(_suffix_arrays(docs, self.length).repartition(self.buckets, "sig").groupBy("sig").agg(F.sum("n").alias("n")))
        batch = self.spark.table(new)
        # Each part is written by itself: Spark 4.1 takes a union of bucketed tables for one bucketed table, and a distinct of it leaves repeated rows.
        self.repeated.append(written(batch.where("n > 1").select("sig")))
        for level in self.levels.values():
            self.repeated.append(written(batch.select("sig").join(self.spark.table(level).select("sig"), "sig")))
        k = 0
        while k in self.levels:
            old = self.levels.pop(k)
            a, b = self.spark.table(old), self.spark.table(new).withColumnRenamed("n", "m")
            merged = self._save(a.join(b, "sig", "full").select("sig", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
            self._drop(old, new)
            new, k = merged, k + 1
        self.levels[k] = new

    def matches(self) -> DataFrame:
        """(sig): every signature that occurs twice or more in what was added."""
        out = self.repeated[0]
        for part in self.repeated[1:]:
            out = out.unionByName(part)
        return out.distinct()

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(*self.levels.values())
        self.levels = {}


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    """(sig, run, t1, t2, first, n): every run of windows; ``run`` stands for its bytes and its representative's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                if not text or len(text) < length:
                    continue
                sig, place, first, last = window_runs(text, length)
                ids = b"".join([digest(text[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)])
                t1, t2 = _text_key(text)
                k = len(sig)
                out.append((sig.view(np.int64), np.frombuffer(ids, dtype=np.int64), np.full(k, t1), np.full(k, t2), first, last - first + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["sig", "run", "t1", "t2", "first", "n"])

    return docs.mapInArrow(run, "sig long, run long, t1 long, t2 long, first long, n long")


def _keyed(docs: DataFrame) -> DataFrame:
    """(t1, t2, packed) and the id: texts compressed for the shuffle that brings them to their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            keys = [_text_key(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([pack(x) for x in texts], pa.binary())],
                names=[*(c for c in batch.schema.names if c != "text"), "t1", "t2", "packed"],
            )

    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("t1", "long", False).add("t2", "long", False).add("packed", "binary", False)
    return docs.mapInArrow(run, schema)


def _windows(texts_and_runs: DataFrame, length: int) -> DataFrame:
    """The windows of the runs given per text, by their bytes as 128 bits, after what a slice of texts tells by itself.

    A window that a slice holds more than once is repeated whatever others
    hold: runs of such windows come as (t1, t2, first, n) without a hash.  And
    each different window of the slice comes once as (h1, h2, copies), with its
    place if it is the only one.  So a passage that very many texts share costs
    one row for each slice and window, not one for each text and window.
    """
    names = ["h1", "h2", "copies", "t1", "t2", "first", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        digest = xxhash.xxh3_128_digest
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "packed"):
            hashes, places, sizes, keys = [], [], [], []
            for t1, t2, packed, runs in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "packed", "runs")), strict=True):
                if (t1, t2) in seen:  # a copy of a text that this task has handled
                    continue
                seen.add((t1, t2))
                text = unpack(packed)
                for r in runs:
                    place = np.arange(r["first"], r["first"] + r["n"])
                    hashes += [digest(text[i : i + length]) for i in place.tolist()]
                    places.append(place)
                    sizes.append(len(place))
                    keys.append((t1, t2))
            if not hashes:
                continue
            h = np.frombuffer(b"".join(hashes), dtype=[("h1", "<i8"), ("h2", "<i8")])
            place, row = np.concatenate(places), np.repeat(np.arange(len(sizes)), sizes)
            t1, t2 = np.array(keys, dtype=np.int64).T
            _, at, of, copies = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(copies[of] > 1)
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(again) != 1) | (np.diff(row[again]) != 0)))) if len(again) else again
            many = np.diff(np.append(starts, len(again)))
            begin = again[starts]
            none, count = np.zeros(len(begin), dtype=bool), np.concatenate((copies, np.zeros(len(begin), dtype=np.int64)))
            hashed = np.concatenate((np.ones(len(at), dtype=bool), none))
            rows = np.concatenate((at, begin))
            columns = [pa.array(h["h1"][rows], mask=~hashed), pa.array(h["h2"][rows], mask=~hashed), pa.array(count), *(pa.array(x) for x in (t1[row[rows]], t2[row[rows]], place[rows], np.concatenate((np.ones(len(at), dtype=np.int64), many))))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts_and_runs.select("id", "t1", "t2", "packed", "runs").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _contents(texts_and_runs: DataFrame, length: int) -> DataFrame:
    """(sig, t1, t2, first, n, single, data): the runs given per text with all their bytes."""
    names = ["sig", "t1", "t2", "first", "n", "single", "data"]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "packed"):
            out = []
            for t1, t2, packed, runs in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "packed", "runs")), strict=True):
                if (t1, t2) in seen:  # a copy of a text that this task has handled
                    continue
                seen.add((t1, t2))
                text = unpack(packed)
                out += [(r["sig"], t1, t2, r["first"], r["n"], r["single"], text[r["first"] : r["first"] + r["n"] - 1 + length]) for r in runs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return texts_and_runs.select("id", "t1", "t2", "packed", "runs").mapInArrow(run, "sig long, t1 long, t2 long, first long, n long, single boolean, data binary")


def _compared(contents: DataFrame, length: int) -> DataFrame:
    """(t1, t2, first, n): the repeated windows of single runs, whole signatures at a time."""

    def repeated(rows: pa.Table) -> pa.RecordBatch:
        digest = xxhash.xxh3_64_intdigest
        t1, t2, first, n, single, data = (rows.column(c).to_pylist() for c in ("t1", "t2", "first", "n", "single", "data"))
        h = np.array([digest(d[i : i + length]) for d, k in zip(data, n, strict=True) for i in range(k)], dtype=np.uint64)
        _, of, copies = np.unique(h, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        again = np.flatnonzero((copies[of] > 1) & np.array(single)[row])
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(again) != 1) | (np.diff(row[again]) != 0)))) if len(again) else np.zeros(0, dtype=np.int64)
        many = np.diff(np.concatenate((starts, [len(again)])))
        at = again[starts]
        who = row[at]
        return pa.RecordBatch.from_arrays([pa.array(np.array(t1, dtype=np.int64)[who]), pa.array(np.array(t2, dtype=np.int64)[who]), pa.array(np.array(first, dtype=np.int64)[who] + within[at]), pa.array(many)], names=["t1", "t2", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in slices(batches, "data"):
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            sig = rows.column("sig").to_numpy()
            done = int(np.searchsorted(sig, sig[-1]))
            if done:
                yield repeated(rows.slice(0, done))
            held = rows.slice(done)
        if held is not None:
            yield repeated(held)

    return contents.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "t1 long, t2 long, first long, n long")


def repeated_windows(docs: DataFrame, texts: DataFrame, length: int, batches: int = BATCHES) -> DataFrame:
    """(t1, t2, first, n): runs of window starts whose ``length`` bytes start anywhere else too, by text.

    ``docs`` has ``text`` as bytes; ``texts`` are the same rows as ``_keyed``
    gives them.  Texts shorter than ``length`` have no window.
    """
    family = SuffixArrayFamily(docs.sparkSession, length)
    for k in range(batches):
        family.add(docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(batches)) == k))
    repeated = written(family.matches())  # a plain table, so that Spark can split a frequent signature's rows in the join
    candidates = written(_runs_of(docs.select("text"), length).join(repeated, "sig"))
    family.close()
    # One row for each different run of a signature; a signature with one such run only has nothing else to compare.
    different = written(candidates.groupBy("sig", "run").agg(F.count("*").alias("copies"), F.min(F.struct("t1", "t2", "first", "n")).alias("one")))
    whole = candidates.join(different.where("copies > 1").select("sig", "run"), ["sig", "run"]).select("t1", "t2", "first", "n")
    unlike = different.groupBy("sig").agg(F.count("*").alias("runs")).where("runs > 1")
    asked = written(different.join(unlike, "sig").select("one.*", "sig", (F.col("copies") == 1).alias("single"), "runs"))

    def with_texts(rows: DataFrame) -> DataFrame:
        return texts.join(rows.groupBy("t1", "t2").agg(F.collect_list(F.struct("sig", "first", "n", "single")).alias("runs")), ["t1", "t2"])

    few = _compared(_contents(with_texts(asked.where(F.col("runs") <= TOGETHER)), length), length)
    windows = written(_windows(with_texts(asked.where(F.col("runs") > TOGETHER)), length))
    alike = windows.where("h1 is null").select("t1", "t2", "first", "n")
    hashed = windows.where("h1 is not null")
    again = hashed.groupBy("h1", "h2").agg(F.sum("copies").alias("copies")).where("copies > 1").select("h1", "h2")
    alone = hashed.where("copies = 1").join(again, ["h1", "h2"]).select("t1", "t2", "first", "n")
    return whole.unionByName(few).unionByName(alike).unionByName(alone)


def _with_runs(docs: DataFrame, length: int, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(id, packed, runs): each row's compressed text and the runs of its repeated windows, null without any."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))
    texts = _keyed(rows)
    found = repeated_windows(rows, texts, length, batches).groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    return texts.join(found, ["t1", "t2"], "left").select("id", "packed", "runs")


def _cut(text: bytes, runs: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the spans that go."""
    gone = merged_spans([(r["first"], r["first"] + r["n"] - 1 + length) for r in runs or ()])
    edges = [0, *(x for span in gone for x in span), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if gone else text, gone


def remove_repeated(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, text, kept, spans): what is left of each row's bytes, and the maximal removed spans as [start, end).

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another; strings are judged on the
    input.  Null counts as empty.  Texts shorter than ``length`` stay.
    Repeated rows are copies of each other.  The order of rows and ties play
    no part.
    """
    joined = _with_runs(docs, length, id_col, text_col, batches)
    schema = schema_of(joined, "id", ("text", "binary"), ("kept", "binary"), ("spans", "array<struct<start:long,end:long>>"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa_type(schema["spans"].dataType)
        for batch in slices(batches, "packed"):
            texts = [unpack(x) for x in batch.column("packed").to_pylist()]
            kept, spans = zip(*[_cut(t, r, length) for t, r in zip(texts, batch.column("runs").to_pylist(), strict=True)], strict=True)
            named = [[{"start": a, "end": b} for a, b in gone] for gone in spans]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary()), pa.array(kept, pa.binary()), pa.array(named, kind)], names=schema.names)

    return joined.mapInArrow(cut, schema)


def without_repeated(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what ``remove_repeated`` leaves of each text; all columns stay.

    A character of which a part is removed goes as a whole.  A row whose text
    is removed entirely goes; a row that had no text stays as it is.
    """
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    rows = docs.select(row.alias("row"), docs[text_col].alias("text"), docs[text_col].isNull().alias("none"))
    joined = _with_runs(rows.select(F.struct("row", "none").alias("row"), "text"), length, "row", "text", BATCHES)
    schema = schema_of(joined, "id", ("text", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed"):
            stay, texts = [], []
            for packed, runs in zip(batch.column("packed").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text = unpack(packed)
                kept, _ = _cut(text, runs, length)
                stay.append(bool(kept) or not text)
                if stay[-1]:
                    texts.append(kept.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(stay, pa.bool_())), pa.array(texts, pa.string())], names=["id", "text"])

    kept = joined.mapInArrow(run, schema)
    text = F.when(F.col("id.none"), F.lit(None)).otherwise(F.col("text"))
    return kept.select(*[(text if c == text_col else F.col(f"id.row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeated(docs)
    return out.select(
        F.col("id").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
