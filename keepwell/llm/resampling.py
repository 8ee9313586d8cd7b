"""Quality by importance resampling of hashed n-grams.

Words and pairs of words of a text fall into a fixed number of buckets.  Two
generative models, each a distribution over the buckets, come from target
text and from the raw corpus; a document's importance weight is the ratio of
its likelihoods.  Gumbel noise on the log weights and the ``k`` largest sums
are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import id_and_text, schema_of, slices
from keepwell.session import materialize

BUCKETS = 16_384
#: Share of all documents that are sampled.
KEEP = 0.85
#: Labelled target documents that the target model is fitted on, about; the raw model covers all documents.
TARGET_ROWS = 50_000
SEED = 1
_HIST = 4_096


def buckets_of(text: bytes | None, buckets: int) -> np.ndarray:
    """The bucket of every word and every pair of neighbouring words, ASCII letters lower-cased."""
    words = (text or b"").lower().split()
    h = np.array([xxhash.xxh32_intdigest(w) for w in words], dtype=np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate((h * np.uint64(0x94D049BB133111EB), pairs)) >> np.uint64(40)) % np.uint64(buckets)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all of ``docs``; tasks return one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts += np.bincount(buckets_of(text, buckets).astype(np.int64), minlength=buckets)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["bucket", "n"])

    rows = docs.select(docs[text_col].cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.float64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one count added to every bucket."""
    p, q = target + 1, raw + 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (1 <= k <= rows), exactly, from histograms around it; values are neither null nor NaN."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        bucket = F.least(F.floor((F.col(column) - low) / ((high - low) / _HIST)), F.lit(_HIST - 1))
        found = rows.where(F.col(column).between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def resample(docs: DataFrame, ratios: np.ndarray, keep: float = KEEP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_grams, log_weight, score, gumbel_key, kept): one row for each row of ``docs``.

    ``score`` is the mean log ratio of a gram, squeezed to (0, 1); 0.5 for a
    text without words, which has weight 1.  Noise follows from id and text,
    so repeated rows share their key; rows that tie at the last place are all
    kept.  An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    schema = schema_of(rows, "id", ("n_grams", "long"), ("log_weight", "double"), ("noise", "long"))
    table = np.asarray(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [buckets_of(x, len(table)).astype(np.int64) for x in batch.column("text").to_pylist()]
            arrays = [batch.column("id"), pa.array([len(f) for f in found], pa.int64()), pa.array([float(table[f].sum()) for f in found], pa.float64()), batch.column("noise")]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    noisy = rows.withColumn("noise", F.xxhash64(F.lit(seed), "id", "text"))
    weighed = noisy.mapInArrow(run, schema)
    uniform = (F.pmod(F.col("noise"), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    keyed = materialize(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).drop("noise"))
    n = keyed.count()
    last = kth_largest(keyed, "gumbel_key", max(1, -int(-n * keep // 1))) if n else 0.0
    score = 1 / (1 + F.exp(-F.col("log_weight") / F.greatest(F.col("n_grams"), F.lit(1))))
    return keyed.select("id", "n_grams", "log_weight", score.alias("score"), "gumbel_key", (F.col("gumbel_key") >= last).alias("kept"))


def target_of(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Documents labelled as good, about ``rows`` of them at most, chosen by a hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) / float(2**30)
    # At most about ``rows`` ids, whatever the size of the table.
    return docs.join(F.broadcast(good.where(place < min(1.0, rows / max(n, 1)))), "doc_id", "left_semi")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_grams, log_weight, score, gumbel_key and kept of every document."""
    ratios = log_ratios(bucket_counts(target_of(docs, labels)), bucket_counts(docs))
    return resample(docs, ratios).withColumnRenamed("id", "doc_id")
