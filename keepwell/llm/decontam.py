"""Benchmark decontamination with a generalised suffix automaton over words.

The words of all benchmark items form one suffix automaton.  A document's
words are streamed through it; the state and the length of the longest match
that ends at each word tell which windows of an item end there and which
items hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import id_and_text, pa_type, schema_of, slices
from keepwell.session import materialize

WINDOW = 13
#: Bytes of item text in one automaton; a larger benchmark is searched in several blocks, one pass over the documents each.
BLOCK_BYTES = 8_000_000
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII, after lower-casing A to Z."""
    return WORD.findall(text.lower()) if text else []


class ItemAutomaton:
    """Suffix automaton of all items' word sequences, with the items that hold each state's strings."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[list[str]] = []
        by_words: dict[tuple[int, ...], int] = {}
        for name, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            if ids:
                if ids not in by_words:
                    by_words[ids] = len(self.names)
                    self.names.append([])
                self.names[by_words[ids]].append(name)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for ids in by_words:
            last = 0
            for word in ids:
                last = self._extend(last, word)
        self.holders: list[list[int]] = [[] for _ in self.next]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for ids, item in by_words.items():
            self._mark(ids, item)
        self.least = min([min(len(ids), window) for ids in by_words], default=0)
        # The nearest state at or above each one that ends a short item; 0 for none.
        self.above = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.above[state] = state if self.short[state] else self.above[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None and self.length[target] == self.length[last] + 1:
            return target
        if target is not None:
            return self._split(last, word, target)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        shorter = self._state(dict(self.next[target]), self.length[at] + 1, self.link[target])
        self.link[target] = shorter
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = shorter
            at = self.link[at]
        return shorter

    def _mark(self, ids: tuple[int, ...], item: int) -> None:
        state = 0
        for word in ids:
            state = self.next[state][word]
            at = state
            # Only strings of a whole window are ever asked for.
            while at > 0 and self.length[at] >= self.window and (not self.holders[at] or self.holders[at][-1] != item):
                self.holders[at].append(item)
                at = self.link[at]
        if len(ids) < self.window:
            self.short[state].append((len(ids), item))

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(end, words, items): every window that ends at word ``end``, for known words without a gap."""
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for end, word in enumerate(ids):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state].get(word, 0)
            matched = matched + 1 if state else 0
            # What is longer than a window is cut back to the state of its last window.
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window:
                yield end, window, self.holders[state]
            at = self.above[state]
            while at:
                for n, item in self.short[at]:
                    if n <= matched:
                        yield end, n, [item]
                at = self.above[link[at]]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal spans of hit words as [start, end), and the items whose windows occur."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        known = np.array(ids, dtype=np.int64) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            for end, n, held in self.stream(ids[a:b]):
                start, end = a + end + 1 - n, a + end + 1
                while spans and spans[-1][1] >= start:
                    start, end = min(start, spans[-1][0]), max(end, spans.pop()[1])
                spans.append((start, end))
                items.update(held)
        return spans, items


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text, n_words, spans, items): for each row of ``docs`` the hit word spans and the item ids found.

    A window is ``window`` consecutive words of an item, or a whole shorter
    item; items without words have none.  Null texts have no words.  Items
    equal in words are found together; a repeated item id counts once; a null
    item id is called ``null``.  Spans are maximal, [start, end) in words.
    """
    return _passes(id_and_text(docs, id_col, text_col), items, window, item_col, item_text)


def _passes(rows: DataFrame, items: DataFrame, window: int, item_col: str, item_text: str, last: tuple | None = None) -> DataFrame:
    """``find_contamination`` of (id, text) rows; ``last`` may give a schema and what to make of each batch of the last pass."""
    asked = items.select(F.coalesce(items[item_col].cast("string"), F.lit("null")).alias("name"), F.lower(items[item_text]).alias("low"), items[item_text].cast("binary").alias("words")).where("words is not null")
    held = asked.agg(F.sum(F.octet_length("words") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-held // BLOCK_BYTES))
    schema = schema_of(rows, "id", ("text", "binary"), ("n_words", "long"), ("spans", "array<struct<start:long,end:long>>"), ("items", "array<string>"))
    out = rows.select("id", "text", F.lit(None).cast("long").alias("n_words"), F.array().cast(schema["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == k).select("name", "words").distinct()
        out = _search(out, [(r["name"], bytes(r["words"])) for r in block.collect()], window, schema, last if k == blocks - 1 else None)
        if k < blocks - 1:
            out = materialize(out)
    return out


def _search(rows: DataFrame, items: list[tuple[str, bytes]], window: int, schema, last: tuple | None) -> DataFrame:
    """One pass over the documents with one block of items, whose size is bounded."""
    out_schema, finish = last or (schema, lambda batch: batch)
    shared = rows.sparkSession.sparkContext.broadcast(sorted(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(shared.value, window)
        for batch in slices(batches):
            counts, all_spans, all_items = [], [], []
            for text, spans, names in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True):
                words = words_of(text)
                counts.append(len(words))
                found, held = automaton.match(words) if automaton.least else ([], set())
                merged: list[tuple[int, int]] = []
                for a, b in sorted([(s["start"], s["end"]) for s in spans] + found):
                    if merged and a <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                    else:
                        merged.append((a, b))
                all_spans.append([{"start": a, "end": b} for a, b in merged])
                all_items.append(sorted({*names, *(n for i in held for n in automaton.names[i])}))
            arrays = [batch.column("id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(all_spans, pa_type(schema["spans"].dataType)), pa.array(all_items, pa.list_(pa.string()))]
            yield finish(pa.RecordBatch.from_arrays(arrays, names=schema.names))

    return rows.mapInArrow(run, out_schema)


def judged(found: DataFrame, coverage: float = 0.05) -> DataFrame:
    """``found`` with n_hit and contaminated: some word is hit, and at least ``coverage`` of all words."""
    per = round(1 / coverage)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words")))


def without_spans(text: bytes | None, spans: list[dict]) -> bytes | None:
    """The text without the words of the spans and what stands between these words."""
    if not text or not spans:
        return text
    ends = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for span in spans:
        out.append(text[at : ends[span["start"]][0]])
        at = ends[span["end"] - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, and without the hit spans in the other rows.

    All columns stay.  Rows without hits keep their text as it is.
    """
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    packed = docs.select(row.alias("id"), docs[text_col].cast("binary").alias("text"))
    schema = schema_of(packed, "id", ("text", "string"))
    per = round(1 / coverage)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        stay, texts = [], []
        for text, n_words, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "n_words", "spans")), strict=True):
            n_hit = sum(s["end"] - s["start"] for s in spans)
            stay.append(n_hit == 0 or per * n_hit < n_words)
            if stay[-1]:
                left = without_spans(text, spans)
                texts.append(None if left is None else left.decode("utf-8", "ignore"))
        return pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(stay, pa.bool_())), pa.array(texts, pa.string())], names=["id", "text"])

    # Cut by the worker that searches last: a second Python step would hold a second worker for each task.
    kept = _passes(packed, items, window, "item_id", "text", (schema, cut))
    return kept.select(*[(F.col("text") if c == text_col else F.col(f"id.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def op8(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = judged(find_contamination(docs, items))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH item AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS name, {_SQL_WORDS} AS w FROM benchmark),
gram AS (
  SELECT DISTINCT name, least(len(w), {WINDOW}) AS n, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS g
  FROM item, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM gram),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
place AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS g
  FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT r, n, i, name FROM place JOIN gram USING (n, g)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""
