"""Quality rules from compression: bands of zstandard ratios.

The ratio is raw bytes over compressed bytes, of the whole text and of each
fixed chunk.  Repetitive text compresses too well, random text hardly at all.
What is usual depends on the length, so the limits come in bands of length.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import id_and_text, per_text, schema_of

LEVEL = 3
CHUNK = 4_096
#: (bytes from, least ratio, greatest ratio) for whole texts.
BANDS = ((0, 0.0, 2.0), (64, 0.75, 2.2), (256, 1.2, 2.5), (1_024, 1.6, 3.0), (4_096, 1.8, 3.5), (16_384, 1.9, 4.0))
#: The same for every chunk of CHUNK bytes, the last one being the text's last CHUNK bytes, and for a shorter text of half of that or more.
CHUNK_BAND = (1.5, 3.2)
WINDOW = 5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, word characters, symbols, repeated lines, words in repeated windows)."""
    words = _WORD.findall(text)
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    copies = Counter(windows)
    repeated = 0
    if len(copies) < len(windows):
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        starts = np.flatnonzero(np.fromiter((copies[w] > 1 for w in windows), dtype=bool, count=len(windows)))
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + WINDOW, -1)
        repeated = int((np.cumsum(hit) > 0).sum())
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), again, repeated


def ratios(data: bytes, compress) -> tuple[float | None, float | None, float | None]:
    """Of the whole text, then the least and the greatest of its chunks; None where there is nothing."""
    if not data:
        return None, None, None
    # The last chunk overlaps the one before, so that every byte of a long text is in a whole chunk.
    parts = [data[max(0, min(at, len(data) - CHUNK)) :][:CHUNK] for at in range(0, len(data), CHUNK)]
    found = [len(p) / len(compress(p)) for p in parts if 2 * len(p) >= CHUNK]
    return len(data) / len(compress(data)), min(found, default=None), max(found, default=None)


def within_bands(size: int, whole: float | None, least: float | None, greatest: float | None) -> bool:
    if whole is None:
        return False
    _, low, high = next(b for b in reversed(BANDS) if size >= b[0])
    return low <= whole <= high and (least is None or least >= CHUNK_BAND[0]) and (greatest is None or greatest <= CHUNK_BAND[1])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the base counts, n_bytes, the three ratios and in_bands.

    A null or empty text has no words and no ratios, and is outside the bands.
    """
    rows = id_and_text(docs, id_col, text_col)
    counts = [(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")]
    schema = schema_of(rows, "id", *counts, ("ratio", "double"), ("least_chunk_ratio", "double"), ("greatest_chunk_ratio", "double"), ("in_bands", "boolean"))

    def make():
        compress = zstandard.ZstdCompressor(level=LEVEL).compress

        def one(data: bytes | None) -> tuple:
            data = data or b""
            found = ratios(data, compress)
            return (*base_counts(data.decode("utf-8", "replace")), len(data), *found, within_bands(len(data), *found))

        return one

    return per_text(rows, schema, make)


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, the four counts, base_failed, kept; then the ratios."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measure(docs).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.col("in_bands")
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "ratio", "least_chunk_ratio", "greatest_chunk_ratio")
