"""Ranked lexical search: MaxScore with bounds on pairs of terms.

The index has a row for each block of documents: for every term that some
query asks for, the documents that hold it and the impact of each.  Beside the
postings a block keeps each term's highest impact, and for pairs of terms
their intersection list's highest joint impact.  The terms of a query, rarest
first, are paired neighbour by neighbour; two rare terms hardly ever meet, so
that a pair's bound is often no more than the greater of its two terms'.

A query skips every block whose pair bounds add up to less than the lowest
score it still needs.  Inside a block only the terms before the point from
which on the bounds are too low are read in full; the rest are looked up for
what is left.  Skipping is strict: whatever may still tie is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.columns import slices
from keepwell.llm.decontam import words_of
from keepwell.session import written

TOP = 20
#: Bytes of query text that are searched for in one pass; more queries take several.
QUERY_BYTES = 4_000_000
#: Stands for a null id, which comes last.
_NO_ID = 2**63 - 1
_BLOCKS = "ids binary, n binary, terms binary, ends binary, places binary, tf binary, n_docs long, n_terms long"
_BOUNDED = "ids binary, terms binary, ends binary, places binary, factors binary, tops binary, pairs binary, joints binary"


def _of(column: pa.Array, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), dtype=kind)


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each slice of documents: ids, terms of each document, and postings of ``vocabulary``.

    Every row of ``docs`` is indexed, from its whole text.  A posting has the
    document's place in the block and the term's occurrences there.  n_docs and
    n_terms count the block's documents with a term and all their terms.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("id"), docs[text_col].cast("binary").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(shared.value)}
        for batch in slices(batches):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(words) for words in texts], dtype=np.int64)
            found = [np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int64, count=len(words)) for words in texts]
            term = np.concatenate(found) if found else n[:0]
            place = np.repeat(np.arange(len(n)), n)
            known = term >= 0
            keys, tf = np.unique(term[known] * len(n) + place[known], return_counts=True)
            terms, begins = np.unique(keys // max(len(n), 1), return_index=True)
            ends = np.append(begins, len(keys))[1:]
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            columns = _packed(ids, n, terms.astype(np.int32), ends.astype(np.int64), (keys % max(len(n), 1)).astype(np.int32), tf.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=_BLOCKS.replace(" binary", "").replace(" long", "").split(", "))

    return rows.mapInArrow(run, _BLOCKS)


def document_frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """The documents of all blocks that hold each of ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                ends = _of(batch.column("ends"), row, np.int64)
                df[_of(batch.column("terms"), row, np.int32)] += np.diff(ends, prepend=0)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term], pa.int64())], names=["term", "df"])

    counted = blocks.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, dtype=np.int64)
    for r in counted.collect():  # a row for each term of the queries, whose text is bounded
        out[r["term"]] = r["df"]
    return out


class Queries:
    """Queries as pairs of terms, rarest first, and the distinct pairs of all of them.

    A query's last term may stay alone; it is paired with a term that no
    document holds.
    """

    def __init__(self, texts: list[bytes], vocabulary: list[bytes], weights: np.ndarray):
        number = {w: k for k, w in enumerate(vocabulary)}
        self.weights = np.append(weights, 0)
        nothing = len(vocabulary)
        pairs: dict[tuple[int, int], int] = {}
        first, second, pair, begins = [], [], [], [0]
        for text in texts:
            counts = Counter(number[w] for w in words_of(text))
            terms = sorted((t for t in counts if weights[t] > 0), key=lambda t: (-weights[t], t))
            if len(terms) % 2:
                terms.append(nothing)
            for a, b in zip(terms[::2], terms[1::2], strict=True):
                first.append((a, counts[a]))
                second.append((b, counts.get(b, 1)))
                pair.append(pairs.setdefault((a, b), len(pairs)))
            begins.append(len(pair))
        self.a, self.times_a = np.array(first, dtype=np.int64).reshape(-1, 2).T
        self.b, self.times_b = np.array(second, dtype=np.int64).reshape(-1, 2).T
        self.pair, self.begins = np.array(pair, dtype=np.int64), np.array(begins, dtype=np.int64)
        self.pairs = np.array(sorted(pairs, key=pairs.get), dtype=np.int64).reshape(-1, 2)


def bounded(blocks: DataFrame, queries: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """The index with impacts, each term's highest, and the highest joint impact of every pair that meets in the block."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        by_first = np.argsort(queries.pairs[:, 0], kind="stable")
        for batch in batches:
            for row in range(batch.num_rows):
                column = lambda name, kind: _of(batch.column(name), row, kind)  # noqa: B023, E731
                n, terms, ends, places = column("n", np.int64), column("terms", np.int32), column("ends", np.int64), column("places", np.int32)
                tf = column("tf", np.int32).astype(np.int64)
                norm = 75 + (25 * n * n_docs) // max(n_terms, 1)
                factors = (1_000_000_000 * tf) // (1000 * tf + 12 * norm[places])
                begins = ends - np.diff(ends, prepend=0)
                impact = np.repeat(queries.weights[terms], ends - begins) * factors
                tops = np.maximum.reduceat(impact, begins) if len(terms) else impact[:0]
                slot = np.full(len(queries.weights), -1, dtype=np.int64)
                slot[terms] = np.arange(len(terms))
                a, b = slot[queries.pairs[by_first, 0]], slot[queries.pairs[by_first, 1]]
                both = np.flatnonzero((a >= 0) & (b >= 0))
                met, joints, of, beside = [], [], -1, np.zeros(len(n), dtype=np.int64)
                for p, x, y in zip(by_first[both].tolist(), a[both].tolist(), b[both].tolist(), strict=True):
                    if x != of:
                        beside[:] = 0
                        beside[places[begins[x] : ends[x]]] = impact[begins[x] : ends[x]]
                        of = x
                    other = beside[places[begins[y] : ends[y]]]
                    joint = (other + impact[begins[y] : ends[y]])[other > 0]
                    if len(joint):
                        met.append(p)
                        joints.append(int(joint.max()))
                columns = _packed(column("ids", np.int64), terms, ends, places, factors.astype(np.int32), tops, np.array(met, dtype=np.int64), np.array(joints, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=_BOUNDED.replace(" binary", "").split(", "))

    return blocks.select("ids", "n", "terms", "ends", "places", "tf").mapInArrow(run, _BOUNDED)


class Searcher:
    """The best documents of each query among the blocks seen so far."""

    def __init__(self, queries: Queries, top: int):
        self.queries, self.top = queries, top
        size = len(queries.begins) - 1
        self.asked = np.flatnonzero(np.diff(queries.begins))
        #: The lowest score that a document still needs.
        self.least = np.ones(size, dtype=np.int64)
        self.scores = [np.zeros(0, dtype=np.int64)] * size
        self.ids = [np.zeros(0, dtype=np.int64)] * size

    def read(self, block: dict[str, np.ndarray]) -> None:
        q = self.queries
        highest, joint = np.zeros(len(q.weights), dtype=np.int64), np.zeros(len(q.pairs), dtype=np.int64)
        highest[block["terms"]] = block["tops"]
        joint[block["pairs"]] = block["joints"]
        top_a, top_b = highest[q.a], highest[q.b]
        bounds = np.maximum(joint[q.pair], np.maximum(top_a, top_b)) + (q.times_a - 1) * top_a + (q.times_b - 1) * top_b
        if not len(self.asked):
            return
        total = np.add.reduceat(bounds, q.begins[self.asked])
        slot = np.full(len(q.weights), -1, dtype=np.int64)
        slot[block["terms"]] = np.arange(len(block["terms"]))
        ends = block["ends"]
        begins = ends - np.diff(ends, prepend=0)
        impact = np.repeat(q.weights[block["terms"]], ends - begins) * block["factors"]
        lists = (slot, begins, ends, block["places"], impact)
        for k in self.asked[total >= self.least[self.asked]].tolist():
            places, scores = self._search(k, bounds, top_b, lists, len(block["ids"]))
            if len(places):
                self._keep(k, block["ids"][places], scores)

    def _search(self, k: int, bounds: np.ndarray, top_b: np.ndarray, lists: tuple, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents of a block that score at least what query ``k`` needs."""
        q, least = self.queries, int(self.least[k])
        slot, begins, ends, places, impact = lists
        span = slice(q.begins[k], q.begins[k + 1])
        count = 2 * (span.stop - span.start)
        terms, times = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
        terms[::2], terms[1::2], times[::2], times[1::2] = q.a[span], q.b[span], q.times_a[span], q.times_b[span]
        # rest[i] bounds what the terms from i on can add.
        rest = np.zeros(count + 1, dtype=np.int64)
        rest[:-1:2] = np.cumsum(bounds[span][::-1])[::-1]
        rest[1::2] = rest[2::2] + q.times_b[span] * top_b[span]
        essential = int((rest[:-1] >= least).sum())
        scores = np.zeros(size, dtype=np.int64)
        at = slot[terms]
        for i in np.flatnonzero(at[:essential] >= 0).tolist():
            x, y = begins[at[i]], ends[at[i]]
            scores[places[x:y]] += times[i] * impact[x:y]
        left = np.flatnonzero(scores >= max(1, least - int(rest[essential])))
        sums = scores[left]
        for i in (essential + np.flatnonzero(at[essential:] >= 0)).tolist():
            if not len(left):
                break
            x, y = begins[at[i]], ends[at[i]]
            holders = places[x:y]
            where = np.minimum(np.searchsorted(holders, left), len(holders) - 1)
            sums = sums + np.where(holders[where] == left, times[i] * impact[x:y][where], 0)
            stay = sums >= least - rest[i + 1]
            left, sums = left[stay], sums[stay]
        good = sums >= least
        return left[good], sums[good]

    def _keep(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids[k], ids)), np.concatenate((self.scores[k], scores))
        best = np.lexsort((ids, -scores))[: self.top]
        self.ids[k], self.scores[k] = ids[best], scores[best]
        if len(best) == self.top:
            self.least[k] = self.scores[k][-1]


def _best(blocks: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(query, doc, score): the best documents of each query in each task's blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value, top)
        kinds = dict(ids=np.int64, terms=np.int32, ends=np.int64, places=np.int32, factors=np.int32, tops=np.int64, pairs=np.int64, joints=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                searcher.read({name: _of(batch.column(name), row, kind) for name, kind in kinds.items()})
        sizes = [len(x) for x in searcher.ids]
        columns = [np.repeat(np.arange(len(sizes)), sizes), *(np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (searcher.ids, searcher.scores))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc", "score"])

    return blocks.mapInArrow(run, "query long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): for each item the ``top`` documents with the highest score above 0.

    All rows of ``docs`` take part, ids as long; each row is a document, also a
    repeated one.  Equal scores go by ascending id, a null id last.  Null and
    empty texts have no terms: such documents are never found, such items find
    nothing.  A repeated item row counts once; rows with one item id and
    different texts are ranked each for itself.  An empty table on either side
    gives no rows.  Other columns do not matter, whatever their names.

    Items are taken in blocks of at most QUERY_BYTES of text, each with an
    index of its terms over all documents.
    """
    spark = docs.sparkSession
    asked = items.select(items[item_col].alias("item"), items[item_text].cast("binary").alias("words")).where("words is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    parts = []
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else asked
        parts.append(_ranked(docs, sorted(((r["item"], bytes(r["words"])) for r in part.collect()), key=lambda x: (x[1], str(x[0]))), items.schema[item_col].dataType, top, id_col, text_col, spark))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked(docs: DataFrame, asked: list[tuple[object, bytes]], kind, top: int, id_col: str, text_col: str, spark) -> DataFrame:
    """``search`` for one block of items, whose size is bounded."""
    vocabulary = sorted({w for _, text in asked for w in words_of(text)})
    blocks = written(index(docs, vocabulary, id_col, text_col))
    total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    df = document_frequencies(blocks, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], dtype=np.int64)
    queries = Queries([text for _, text in asked], vocabulary, weights)
    best = _best(written(bounded(blocks, queries, n_docs, n_terms)), queries, top)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    ranked = best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(asked)], _names(kind))
    return ranked.join(names, "query").select("item", "rank", F.nullif("doc", F.lit(_NO_ID)).alias("id"), "score")


def _names(kind):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("query", T.LongType(), False), T.StructField("item", kind, True)])


def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns: item_id, rank, doc_id, score."""
    return search(docs, items).select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH item AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM doc),
asked AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(terms) AS t FROM item) GROUP BY q, t),
post AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM doc)
  WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM post, total GROUP BY t, n_docs),
score AS (
  SELECT q, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN post USING (t) JOIN weight USING (t) JOIN doc USING (r), total GROUP BY q, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM score JOIN doc USING (r) JOIN item USING (q) WHERE score > 0)
WHERE rank <= {TOP}
"""
