"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds a bounded sample of labelled text.
A text is cross-parsed against each: from where the last phrase ended, the
longest match with the sample is the next phrase.  Few long phrases mean a
familiar language.  Phrases are normalised by the text's length; the language
that needs the fewest wins.

The automaton's transitions are one table with the restart after a failed
match built in, so many segments of text advance by one character in one
array operation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import crc32_mod, held, id_and_text, schema_of, slices

#: Characters of labelled text per language, and over all languages.
SAMPLE_CHARS = 30_000
SAMPLE_TOTAL = 600_000
#: Characters of one labelled text that may enter the sample.
SAMPLE_TEXT = 3_000
#: A phrase does not go on from one segment of this many characters to the next.
SEGMENT = 512
UNKNOWN = "und"
_BREAK = 1 << 30


def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, or a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    out = np.full(0x110000, 32, dtype=np.uint32)
    for p in points.tolist():
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            out[p] = ord(low) if len(low) == 1 else p
    return out


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return _letters()


def codes(text: str) -> np.ndarray:
    """Code points of the normalised text: letters with single spaces between words, one at each end; empty without letters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _letter_table()[raw]
    space = low == 32
    if space.all():
        return low[:0]
    low = np.concatenate((low[:1] * 0 + 32, low, low[:1] * 0 + 32))
    space = low == 32
    return low[~(space & np.concatenate(([False], space[:-1])))]


class Parser:
    """Cross-parsing against the samples of several languages."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in samples]
        points = [codes(text) for _, text in samples]
        alphabet = np.unique(np.concatenate(points)) if points else np.zeros(0, dtype=np.uint32)
        # Code 0 stands for every character that no sample has.
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        self.tables = [self._table(self.code[p].tolist()) for p in points]

    def _table(self, text: list[int]) -> np.ndarray:
        """Flat transitions: the next state's row, with _BREAK added where a new phrase begins."""
        following, link, length = [{}], [-1], [0]
        last = 0
        for c in text:
            new = len(following)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at != -1 and c not in following[at]:
                following[at][c] = new
                at = link[at]
            if at != -1:
                target = following[at][c]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    shorter = len(following)
                    following.append(dict(following[target]))
                    link.append(link[target])
                    length.append(length[at] + 1)
                    link[target] = link[new] = shorter
                    while at != -1 and following[at].get(c) == target:
                        following[at][c] = shorter
                        at = link[at]
            last = new
        restart = np.zeros(self.width, dtype=np.int32)
        for c, target in following[0].items():
            restart[c] = target * self.width
        table = np.tile(restart + _BREAK, (len(following), 1))
        for state, edges in enumerate(following):
            for c, target in edges.items():
                table[state, c] = target * self.width + (_BREAK if state == 0 else 0)
        return table.ravel()

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (its code points) by language; a character that a sample lacks is a phrase."""
        segments = [self.code[t[at : at + SEGMENT]] for t in texts for at in range(0, len(t), SEGMENT)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // SEGMENT) for t in texts])
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        if not segments:
            return out
        sizes = np.array([len(s) for s in segments])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((SEGMENT, len(segments)), dtype=np.int32)
        for column, k in enumerate(order.tolist()):
            grid[: sizes[k], column] = segments[k]
        active = np.searchsorted(-sizes[order], -np.arange(SEGMENT), side="left")
        for lang, table in enumerate(self.tables):
            state = np.zeros(len(segments), dtype=np.int32)
            count = np.zeros(len(segments), dtype=np.int32)
            for at in range(SEGMENT):
                n = active[at]
                if not n:
                    break
                step = table[state[:n] + grid[at, :n]]
                count[:n] += step >> 30
                state[:n] = step & (_BREAK - 1)
            np.add.at(out[:, lang], owner[order], count)
        return out


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_lang: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> list[tuple[str, str]]:
    """(language, sample text): a sample of at most ``per_lang`` characters for each label, ``total`` in all.

    The sample is bounded, so it may pass through the driver.  Its texts are
    chosen by a hash of what may enter of them, at a rate that follows from the
    characters there are of each language in different texts; so every labelled
    text can enter, and copies count and enter once.  A language whose draw is
    short is drawn again at a higher rate, up to all its texts.  Languages
    beyond ``total`` / 100, the rarest first, are not learned.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, SAMPLE_TEXT).alias("text"))
    texts = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.max(F.length("text")).alias("n"))
    there = texts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(total // 100)
    sizes = {r["lang"]: r["n"] for r in there.collect() if r["n"]}
    if not sizes:
        return []
    share = min(per_lang, total // len(sizes))
    # Thrice the wanted amount, then cut: the amount in a sample by rate varies.
    rates = {lang: min(1.0, 3.0 * (share + SAMPLE_TEXT) / n) for lang, n in sizes.items()}
    placed = rows.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(2**40)) / float(2**40))
    by_lang: dict[str, list[tuple[float, str]]] = {}
    while rates:
        rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
        drawn: dict[str, list[tuple[float, str]]] = {lang: [] for lang in rates}
        for r in placed.where(F.col("place") < rate[F.col("lang")]).distinct().collect():
            drawn[r["lang"]].append((r["place"], r["text"]))
        by_lang |= drawn
        rates = {lang: min(1.0, 4 * x) for lang, x in rates.items() if x < 1 and sum(len(t) for _, t in drawn[lang]) < min(share, sizes[lang])}
    return [(lang, "\n".join(t for _, t in sorted(texts))[:share]) for lang, texts in sorted(by_lang.items())]


def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return held(("parser", samples), lambda: Parser(list(samples)))


def _judged(parser: Parser, column: pa.Array) -> list[tuple[str, float, float]]:
    """(language, lead, mean phrase in characters) of each text of a string or binary column."""
    texts = [codes((x or b"").decode("utf-8", "replace")) for x in column.cast(pa.binary()).to_pylist()]
    out = []
    for text, phrases in zip(texts, parser.phrases(texts), strict=True):
        if not len(text) or not parser.langs:
            out.append((UNKNOWN, 0.0, 0.0))
            continue
        first, *rest = np.argsort(phrases, kind="stable").tolist()
        lead = 1 - phrases[first] / phrases[rest[0]] if rest else 1.0
        out.append((parser.langs[first], float(lead), len(text) / int(phrases[first])))
    return out


def identify(docs: DataFrame, samples: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, phrase_length): one row for each row of ``docs``, from its text alone.

    ``score`` is the best language's lead, 1 - its phrases / the runner-up's
    (1 if only one language is known).  A tie goes to the first language in
    alphabetical order, with score 0.  A text that is null, empty or without
    letters is ``und`` with score 0; so is every text if nothing was learned.
    ``phrase_length`` is the mean phrase in the best language, in characters.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = schema_of(rows, "id", ("lang_pred", "string"), ("score", "double"), ("phrase_length", "double"))
    known = tuple(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(known)
        for batch in slices(batches):
            out = _judged(parser, batch.column("text"))
            cols = zip(*out, strict=True) if out else ([], [], [])
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: the id's crc32 modulo 3 is not 1."""
    return docs.where(crc32_mod(id_col, 3) != 1)


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score; then phrase_length."""
    out = identify(docs, learn(training_rows(docs)))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(crc32_mod("id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "phrase_length")


def recognised(docs: DataFrame, samples: list[tuple[str, str]], least_phrase: float = 1.2, text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose language cannot be told; all columns stay.

    Rejected are texts without letters and those whose mean phrase in the
    best language is shorter than ``least_phrase`` characters: hardly any two
    letters in a row occur in any known language.
    """
    known = tuple(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(known)
        for batch in slices(batches, text_col):
            kept = [lang != UNKNOWN and phrase >= least_phrase for lang, _, phrase in _judged(parser, batch.column(text_col))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
