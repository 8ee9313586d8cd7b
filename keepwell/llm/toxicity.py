"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Only documents are labelled.  A sentence's
score is a logistic function of its words and their beginnings; the document's is the noisy-or of
its sentences: it is toxic unless no sentence is.  The weights are fitted to
the document labels through the noisy-or, and the fitted sentence scores
then locate the offending sentences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import crc32_mod, id_and_text, pa_type, schema_of, slices
from keepwell.llm.decontam import WORD

#: Labelled documents that the weights are fitted on, about, for either label, and their bytes; fewer are drawn, whatever their length, if they are long, but about FIT_LEAST.
FIT_ROWS = 3_000
FIT_BYTES = 12_000_000
FIT_LEAST = 20
#: Fitted documents that must have a feature.
MIN_DOCS = 5
#: Bytes of a word's beginning.
STEM = 4
ROUNDS = 200
RATE = 0.3
#: L1 penalty, in documents' worth of gradient; a word needs more evidence than that to get a weight.
SHRINK = 0.5
BIAS = -5.0
OFFENDING = 0.3
_SENTENCE = re.compile(rb"[^.!?\n]+")


def features(words: list[bytes]) -> set[bytes]:
    """The different words of a sentence, and after a ``^`` how they begin, which forms of one word share."""
    return {*words, *[b"^" + w[:STEM] for w in words]}


def fit(bags: list[list[list[bytes]]], labels: np.ndarray, weights: np.ndarray) -> dict[bytes, float]:
    """Weights of features (and the bias under b"") from bags of sentences of words, by Adagrad on the noisy-or likelihood with an L1 penalty."""
    seen: dict[bytes, int] = {}
    for bag in bags:
        for w in set().union(*map(features, bag)):
            seen[w] = seen.get(w, 0) + 1
    index = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_DOCS))}
    word, sentence, doc = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            known = {index[w] for w in features(s) if w in index}
            word += known
            sentence += [len(doc)] * len(known)
            doc.append(d)
    word, sentence, doc = (np.array(x, dtype=np.int64) for x in (word, sentence, doc))
    w, b = np.zeros(len(index)), BIAS
    square_w, square_b = np.full(len(index), 1e-8), 1e-8
    total = max(weights.sum(), 1e-9)
    for _ in range(ROUNDS):
        z = b + np.bincount(sentence, w[word], minlength=len(doc))
        q = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, np.logaddexp(0, z), minlength=len(bags))
        p = np.maximum(-np.expm1(-none), 1e-9)
        pull = np.where(labels == 1, -np.exp(-none) / p, 1.0) * weights / total
        g = q * pull[doc]
        grad_w = np.bincount(word, g[sentence], minlength=len(index))
        grad_b = g.sum()
        square_w += grad_w**2
        square_b += grad_b**2
        step = RATE / np.sqrt(square_w)
        w -= step * grad_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * SHRINK / total * weights.mean(), 0)
        b -= RATE * grad_b / math.sqrt(square_b)
    return {b"": float(b), **{x: float(w[k]) for x, k in index.items() if abs(w[k]) > 1e-3}}


def sample_rates(there: dict[int, tuple[int, int]], rows: int) -> list[float]:
    """The share of the documents of label 0 and 1 to draw, from how many there are of each and their bytes."""
    out = []
    for label in (0, 1):
        n, size = there.get(label, (0, 0))
        wanted = min(rows / max(n, 1), FIT_BYTES / max(size, 1))
        out.append(min(1.0, max(wanted, FIT_LEAST / max(n, 1))))
    return out


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> dict[bytes, float]:
    """Weights from a bounded sample: about ``rows`` documents of either label, chosen by a hash of the id.

    Each sampled document weighs as many as it stands for.  The sample is
    brought to one task, the weights (one for each frequent word of the
    sample) to the driver.  With no labelled text the bias alone is left.
    """
    asked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("of")).agg(F.max(label_col).alias("label"))
    texts = docs.select(docs[id_col].alias("of"), docs[text_col].cast("binary").alias("text")).where(F.octet_length("text") > 0)
    sizes = texts.groupBy("of").agg(F.sum(F.octet_length("text")).alias("bytes"))
    there = asked.join(sizes, "of").groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    rates = sample_rates({r["label"]: (r["n"], r["bytes"]) for r in there.collect()}, rows)
    rate = F.when(F.col("label") == 1, rates[1]).otherwise(rates[0])
    place = F.pmod(F.xxhash64("of"), F.lit(2**30)) / float(2**30)
    sample = asked.where(place < rate).select("of", "label", (1 / rate).alias("weight"))
    # The sample has about 2 * rows ids, whatever the size of the table.
    bags = texts.join(F.broadcast(sample), "of").select("of", "text", "label", "weight")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["of", "text"])
        bags = [sentences_of(t)[0] for t in group["text"]]
        found = fit(bags, group["label"].to_numpy(), group["weight"].to_numpy(dtype=np.float64))
        return pd.DataFrame({"word": list(found), "w": list(found.values())})

    out = {bytes(r["word"]): r["w"] for r in bags.groupBy(F.lit(0).alias("one")).applyInPandas(fitted, "word binary, w double").collect()}
    return out or {b"": BIAS}


def sentences_of(text: bytes | None) -> tuple[list[list[bytes]], list[tuple[int, int]]]:
    """The words of every sentence that has words, and its place in bytes."""
    words, places = [], []
    for m in _SENTENCE.finditer(text.lower() if text else b""):
        found = WORD.findall(m[0])
        if found:
            words.append(found)
            places.append(m.span())
    return words, places


def score(docs: DataFrame, weights: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending): one row for each row of ``docs``, from its text alone.

    ``offending`` lists the sentences with a score of OFFENDING or more, as
    [start, end) in bytes.  A text without words, or null, has score 0.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = schema_of(rows, "id", ("score", "double"), ("offending", "array<struct<start:long,end:long,score:double>>"))
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        bias = weight[b""]
        get = weight.get
        for batch in slices(batches):
            scores, offending = [], []
            for text in batch.column("text").to_pylist():
                words, places = sentences_of(text)
                z = np.array([bias + sum([get(w, 0.0) for w in features(s)]) for s in words])
                scores.append(float(min(1.0, max(0.0, -np.expm1(-np.logaddexp(0, z).sum())))))
                q = 1 / (1 + np.exp(-z))
                offending.append([{"start": places[k][0], "end": places[k][1], "score": float(q[k])} for k in np.flatnonzero(q >= OFFENDING).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(offending, pa_type(schema["offending"].dataType))], names=schema.names)

    return rows.mapInArrow(run, schema)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted; then n_offending."""
    weights = learn(docs, labels.where(crc32_mod("doc_id", 4) != 2))
    out = score(docs, weights)
    return out.select(
        F.col("id").alias("doc_id"),
        F.coalesce(crc32_mod("id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )
