"""Best-fit packing of tokenized documents by large-item matching.

Lengths are small integers, so the packing is planned on the histogram of
lengths (one row per length, whatever the number of documents).  Pieces
longer than a third of the capacity pair, the longest with the longest
partner that fits; no bin can hold three.  Shorter pieces, longest first, go
to the bins whose gap they fill best.  The plan has shapes: so many bins with
the same contents.  Each piece takes its place by its rank among the pieces
of its length, which comes from counts per task and a running sum over tasks.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.columns import held, id_and_text, schema_of, slices
from keepwell.session import materialize

CAPACITY = 1024
END_ID = 2
#: Words whose ids a task remembers; further words are encoded anew in each slice.
REMEMBERED = 1_000_000
#: Words encoded by one call.
WORDS_AT_ONCE = 200
#: Text handled at once; each of its different words is looked up once.
SLICE_BYTES = 8_000_000
#: Texts whose ids are put together by one gather.
TEXTS_AT_ONCE = 500
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class WordCoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes; a different word is looked up once for each call of ``encode``.

    Byte-level BPE cuts a text before every single space that stands between
    two characters that are no white space, so what stands between such
    spaces can be encoded by itself.  Texts with other spaces are cut only
    there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: By id: whether the token begins with a space, which byte-level BPE writes as this letter.
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.opens[[k for token, k in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_after_space(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it; of many words at once, whose ids a space divides again."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            (raw,) = self._ids([" " + " ".join(part)])
            starts = (np.flatnonzero(self.opens[np.frombuffer(raw, dtype="<u4")]) * 4).tolist()
            out.extend(raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True))
        return out

    def _known(self, words: list[str], memory: dict[str, bytes], before: str) -> list[bytes]:
        """The ids of each word; none for one that begins or ends with white space, or is empty."""
        out = list(map(memory.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        safe = [k for k in new if (w := words[k]) and not w[0].isspace() and not w[-1].isspace()]
        for k in new:
            out[k] = b""
        texts = [words[k] for k in safe]
        for k, ids in zip(safe, self._ids_after_space(texts) if before else self._ids(texts), strict=True):
            out[k] = ids
        if len(memory) < REMEMBERED:
            memory.update((words[k], out[k]) for k in new)
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        split = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        # The first word of a text has no space before it.
        opening, at = np.unique(codes[bounds[:-1]], return_inverse=True)
        codes[bounds[:-1]] = len(words) + at
        ids = [*self._known(words, self.later, " "), *self._known([words[k] for k in opening.tolist()], self.first, "")]
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        odd = sizes == 0
        starts = np.cumsum(sizes) - sizes
        # By text: its words' ids one after the other; some texts at once, so that the gather stays small.
        for a in range(0, len(texts), TEXTS_AT_ONCE):
            b = min(a + TEXTS_AT_ONCE, len(texts))
            part = codes[bounds[a] : bounds[b]]
            many = sizes[part]
            ends = np.concatenate(([0], np.cumsum(many)))
            raw = pool[np.repeat(starts[part] - ends[:-1], many) + np.arange(ends[-1])]
            strange = np.concatenate(([0], np.cumsum(odd[part])))
            cut = bounds[a : b + 1] - bounds[a]
            for k, x, y in zip(range(a, b), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if strange[x] < strange[y]:
                    head, *rest = _SAFE_SPACE.split(texts[k])
                    yield b"".join([*self._ids([head]), *self._ids_after_space(rest)])
                else:
                    yield raw[ends[x] : ends[y]].tobytes()


def cuts(n: int, capacity: int, short_first: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids: all of ``capacity`` but the last one, or but the first one."""
    ends = [*range(n % capacity or capacity, n + 1, capacity)] if short_first else [*range(capacity, n, capacity), n]
    return [*zip([0, *ends], ends, strict=False)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, short_first: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth[, ids]): each document's ids, cut into pieces of ``capacity``.

    A document is its text's ids and then ``end_id``; null counts as empty.
    What is left over is the last piece, or the first one with ``short_first``.
    ``nth`` counts the pieces of one length within one task.
    """
    rows = id_and_text(docs, id_col, text_col)
    more = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "int"), ("nth", "long")]
    schema = schema_of(rows, "id", *more, *([("ids", "binary")] if keep_ids else []))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One for each Python worker, so that its tasks share what it remembers.
        coder = held(("words", tokenizer), lambda: WordCoder(tokenizer))
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, most=SLICE_BYTES):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column("text").to_pylist()]
            rows, out = [], []
            for row, ids in enumerate(coder.encode(texts)):
                ids += end
                for piece, (at, to) in enumerate(cuts(len(ids) // 4, capacity, short_first)):
                    part, n = ids[4 * at : 4 * to], to - at
                    rows.append(row)
                    out.append((piece, at, n, zlib.crc32(part), task, int(seen[n]), part))
                    seen[n] += 1
            cols = list(zip(*out, strict=True))[: 7 if keep_ids else 6]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [batch.column("id").take(pa.array(rows)), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shapes as (bins, [(length, pieces of it in each bin), ...]) that hold exactly ``counts``."""
    left = {n: k for n, k in counts.items() if k}
    shapes: list[tuple[int, list[tuple[int, int]]]] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else 0
        if not b:
            bins, content = left[a], [(a, 1)]
        elif b == a:
            bins, content = (left[a] // 2, [(a, 2)]) if left[a] > 1 else (1, [(a, 1)])
            if left[a] == 1 and at > 0:
                b = large[at - 1]
                content = [(a, 1), (b, 1)]
        else:
            bins, content = min(left[a], left[b]), [(a, 1), (b, 1)]
        shapes.append((bins, content))
        for n, k in content:
            left[n] -= bins * k
            if not left[n]:
                large.remove(n)
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    sizes: list[int] = []

    def put(bins: int, content: list[tuple[int, int]]) -> None:
        gap = capacity - sum(n * k for n, k in content)
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((bins, content))

    for shape in shapes:
        put(*shape)
    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        many = left[n]
        while many:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                each = min(capacity // n, many)
                put(many // each, [(n, each)])
                many -= many // each * each
                continue
            gap = sizes[at]
            bins, content = gaps[gap].pop()
            used = min(bins, many)
            if used < bins:
                gaps[gap].append((bins - used, content))
            elif not gaps[gap]:
                del gaps[gap]
                del sizes[at]
            same = content[-1][0] == n
            put(used, [*content[:-1], (n, content[-1][1] + 1)] if same else [*content, (n, 1)])
            many -= used
    return [shape for gap in sorted(gaps) for shape in gaps[gap]]


def places(shapes: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (first rank, first sequence, pieces in each bin, offset of the first), in order of rank."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for bins, content in shapes:
        offset = 0
        for n, each in content:
            out.setdefault(n, []).append((rank.get(n, 0), sequence, each, offset))
            rank[n] = rank.get(n, 0) + bins * each
            offset += n * each
        sequence += bins
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of task and nth.

    Every piece is placed, no sequence is longer than ``capacity``, and
    offsets in a sequence run from 0 without a gap.  Pieces of equal length
    are interchangeable.  No pieces give no rows.
    """
    pieces = materialize(pieces)
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    # At most ``capacity`` rows; the plan has a few thousand shapes of at most 44 different lengths.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = [c for c in pieces.columns if c not in ("task", "nth")]
    ranked = pieces.join(bases, ["task", "length"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, start, each, at = table[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                nth = rank[rows] - first[k]
                sequence[rows] = start[k] + nth // each[k]
                offset[rows] = at[k] + nth % each[k] * length[rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def op2(docs: DataFrame, tokenizer: str, short_first: bool = False) -> DataFrame:
    """The contract's columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = pack(pieces(docs, tokenizer, short_first=short_first))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
