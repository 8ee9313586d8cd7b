"""Language ID, toxicity, resampling, compression bands and licences."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keepwell.llm import compression, language, licences, resampling, toxicity
from keepwell.llm.columns import table

SF = "/root/testdata/sf0.01"


def parsed(text, sample):
    """Cross-parsing the slow way, segment by segment."""
    n = 0
    for at in range(0, len(text), language.SEGMENT):
        part = text[at : at + language.SEGMENT]
        i = 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in sample:
                k += 1
            i += k
            n += 1
    return n


def test_cross_parsing_equals_a_plain_search():
    samples = [("a", "the cat sat on the mat and the dog"), ("b", "der hund und die katze auf der matte")]
    parser = language.Parser(samples)
    texts = ["The dog sat!", "Katze und Hund, auf der Matte", "xyz 12 qqq the", "a " * 900]
    clean = ["".join(map(chr, language.codes(t))) for t in texts]
    found = parser.phrases([language.codes(t) for t in texts])
    plain = [["".join(map(chr, language.codes(s))) for _, s in samples]]
    for row, text in enumerate(clean):
        for col in range(2):
            assert found[row, col] == parsed(text, plain[0][col])


def test_language_of_held_out_documents(spark):
    out = language.op3(table(spark, SF, "documents")).toPandas().merge(table(spark, SF, "documents").toPandas())
    held = out[out.held_out]
    assert len(out) == 1000 and (held.lang == held.lang_pred).mean() > 0.98
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id] == out.held_out.tolist()
    assert out.score.between(0, 1).all()


def test_language_of_odd_rows(spark, odd, none):
    rows = language.op3(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (3, 4, 7):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.op3(none).count() == 0
    kept = language.recognised(odd, language.learn(language.training_rows(odd)))
    assert kept.columns == odd.columns and not {3, 4, 7} & {r.doc_id for r in kept.collect()}


def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.op4(docs, labels).toPandas().merge(labels.toPandas())
    held = out[out.held_out]
    ranks = held.score.rank()
    n = int(held.toxic.sum())
    assert (ranks[held.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(held) - n)) > 0.95
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert hit.sum() / n > 0.75 and hit.sum() / (held.predicted == 1).sum() > 0.85


def test_noisy_or_and_offending_sentences(spark, odd, none):
    weights = {b"": -4.0, b"alpha": 6.0, b"^alph": 1.0}
    rows = {(r.id, i): r for i, r in enumerate(toxicity.score(odd, weights).collect())}
    assert len(rows) == odd.count()
    one = next(r for (k, _), r in rows.items() if k == 1)
    sigma = lambda z: 1 / (1 + math.exp(-z))
    assert one.score == pytest.approx(1 - (1 - sigma(3.0)) * (1 - sigma(-4.0)))
    assert [(s.start, s.end) for s in one.offending] == [(0, len("Alpha beta gamma delta"))]
    assert all(r.score == 0.0 for (k, _), r in rows.items() if k in (3, 4))
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.op4(odd, labels).count() == odd.count()
    assert toxicity.op4(none, labels).count() == 0
    assert toxicity.op4(odd, labels.where("false")).count() == odd.count()


def test_resampling_against_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    size = resampling.BUCKETS
    count = lambda ids: sum((np.bincount(resampling.buckets_of(texts[i], size).astype(int), minlength=size) for i in ids), np.zeros(size))
    ratios = resampling.log_ratios(count(good), count(texts))
    out = resampling.op1(docs, labels).toPandas()
    for r in out.itertuples():
        assert r.log_weight == pytest.approx(ratios[resampling.buckets_of(texts[r.doc_id], size).astype(int)].sum(), abs=1e-6)
    k = math.ceil(len(out) * resampling.KEEP)
    assert out.kept.tolist() == (out.gumbel_key >= out.gumbel_key.sort_values(ascending=False).iloc[k - 1]).tolist()
    judged = out.merge(labels.toPandas())
    assert judged[judged.quality == 1].kept.mean() > 0.97 and judged[judged.quality == 0].kept.mean() < 0.3


def test_resampling_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert resampling.op1(odd, labels).count() == odd.count()
    assert resampling.op1(none, labels).count() == 0
    assert resampling.op1(odd, labels.where("false")).count() == odd.count()


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_largest(spark, k):
    values = sorted([float(x % 37) for x in range(500)] + [math.exp(x / 30) for x in range(500)], reverse=True)
    assert resampling.kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k) == values[k - 1]


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    copies = Counter(windows)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    hit = {j for i, x in enumerate(windows) if copies[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_compression_bands(spark, odd, none):
    for docs in (table(spark, SF, "documents"), odd):
        texts = sorted((plain_counts(r.text or "") for r in docs.collect()))
        out = compression.op6(docs).toPandas()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert sorted(out[names].itertuples(index=False, name=None)) == texts
        failed = (out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words)
        assert (out.base_failed == failed).all() and not (out.kept & out.base_failed).any()
    assert compression.op6(none).count() == 0
    assert not compression.within_bands(800, 40.0, None, None)
    assert not compression.within_bands(8_000, 1.05, 1.02, 1.05)
    assert compression.within_bands(2_000, 2.0, None, None)
    assert not compression.within_bands(9_000, 2.2, 2.0, 30.0)


def test_compression_keeps_good_documents(spark):
    out = compression.op6(table(spark, SF, "documents")).toPandas().merge(table(spark, SF, "labels").toPandas())
    out = out[~out.base_failed]
    assert out[out.quality == 1].kept.mean() > 0.99


def test_licence_expressions():
    assert licences.postfix("a or b and c") == ["a", "b", "c", "and", "or"]
    assert licences.postfix("(a or b) and c with d") == ["a", "b", "or", "c", "d", "with", "and"]
    for bad in ("", "and a", "a and", "(a", "a)", "()", "a (b)"):
        assert licences.postfix(bad) is None
    assert licences.evaluate("mit or gpl-2.0-only") == ({"mit", "gpl"}, True)
    assert licences.evaluate("mit and gpl-2.0+ with classpath-exception-2.0") == ({"mit", "gpl"}, False)
    assert licences.evaluate("cc-by-nc-4.0") == ({"cc-by-nc"}, False)
    for line, want in {
        "mit, gpl-2.0": ({"mit", "gpl"}, False),
        "mit/gpl-2.0": ({"mit", "gpl"}, True),
        "mit gpl-2.0": ({"mit", "gpl"}, False),
        "gpl-2.0 or later": ({"gpl"}, False),
        "mit, or apache-2.0 */": ({"mit", "apache"}, True),
        "(mit; bsd-3-clause,) and see the file": ({"mit", "bsd"}, True),
        "mit (see licence)": ({"mit"}, True),
        "gpl-2.0 with classpath-exception-2.0, mit": ({"gpl", "mit"}, False),
        "licenseref-own-1": ({"licenseref-own-1"}, False),
    }.items():
        assert licences.evaluate(line) == want, line
    for line in ("see license", "", "and mit", "mit and and bsd-2-clause", "(mit or", "/ ,", "https://example.org"):
        assert licences.evaluate(line) is None, line


def test_licence_scan(spark, odd, none):
    texts = [
        (1, "Released under the MIT License. MIT  license mit-license"),
        (2, "# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause\ncode"),
        (3, "under CC BY-NC 4.0; gnu general public license version 3"),
        (4, None),
    ]
    rows = {r.doc_id: r for r in licences.op9(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].labels) == (3, 3, 7, "mit")
    assert (rows[2].n_base, rows[2].base_labels, rows[2].labels, rows[2].permitted) == (0, "", "apache,bsd,mit", True)
    assert (rows[3].base_labels, rows[3].labels, rows[3].permitted) == ("cc-by,gpl", "cc-by,cc-by-nc,gpl", False)
    assert (rows[4].n_words, rows[4].n_base, rows[4].first_word, rows[4].labels, rows[4].score) == (0, 0, None, "", 0.0)
    assert licences.op9(odd).count() == odd.count() and licences.op9(none).count() == 0
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts_by_id = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    docs = {r.doc_id: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(lower)) for r in table(spark, SF, "documents").collect()}
    for r in licences.op9(table(spark, SF, "documents")).collect():
        w = docs[r.doc_id]
        places = [(i, v) for p, v in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({v for _, v in places})))
        notices = {v for p, v in (licences.BASE | licences.NOTICES).items() if f" {p} " in f" {' '.join(w)} "}
        tagged = [licences.evaluate(m) for m in re.findall(r"(?i)spdx-license-identifier:([^\n]*)", texts_by_id[r.doc_id])]
        found = [t for t in tagged if t is not None]
        assert r.labels == ",".join(sorted(notices.union(*(t[0] for t in found))))
        allowed = notices <= licences.PERMITTED and all(t[1] for t in found)
        assert r.permitted == (allowed if notices or found else None)
        assert (r.first_word, r.last_word) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))


def test_copies_do_not_starve_a_language_sample(spark):
    from pyspark.sql import functions as F

    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(80)])
    copies = spark.range(20_000).select(F.lit("xx").alias("lang"), F.repeat(F.lit("copied text "), 50).alias("text"))
    others = spark.range(100).select(F.lit("xx").alias("lang"), F.substring(words, 1, 600).alias("text"))
    clean = spark.range(300).select(F.lit("yy").alias("lang"), F.substring(words, 1, 500).alias("text"))
    samples = dict(language.learn(copies.union(others).union(clean)))
    assert {k: len(v) for k, v in samples.items()} == {"xx": language.SAMPLE_CHARS, "yy": language.SAMPLE_CHARS}
    assert samples["xx"].count("copied text") <= 50


def test_a_language_whose_draw_is_short_is_drawn_again(spark):
    from pyspark.sql import functions as F

    lang = F.concat(F.lit("l"), (F.col("id") % 60).cast("string"))
    docs = spark.range(60 * 60).select(lang.alias("lang"), F.substring(F.repeat(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" ")), 600), 1, 3_000).alias("text"))
    samples = language.learn(docs, per_lang=100)
    assert len(samples) == 60 and {len(t) for _, t in samples} == {100}


def test_toxicity_is_fitted_on_long_texts(spark):
    plain = [" ".join(f"word{(k * 7 + j) % 50}" for j in range(8)) + "." for k in range(400)]
    docs = [(i, " ".join(plain[:200] + (["you are vile scum."] if i % 2 else []) + plain[200:])) for i in range(80)]
    assert min(len(t) for _, t in docs) > 20_000
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert all((r.score >= 0.3) == (r.id % 2 == 1) for r in rows)


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", 50_000)
    seen = []
    real = toxicity.sample_rates
    monkeypatch.setattr(toxicity, "sample_rates", lambda there, rows: seen.append(real(there, rows)) or seen[-1])
    docs = spark.createDataFrame([(i, "some words here. " * 100) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(400)], "doc_id long, toxic int")
    toxicity.learn(docs, labels)
    assert seen[0][1] == 1.0 and seen[0][0] == pytest.approx(50_000 / (390 * 1_700))


def test_last_chunk_covers_the_end_of_the_text():
    import base64
    import random

    import zstandard

    compress = zstandard.ZstdCompressor(level=compression.LEVEL).compress
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]
    clean = " ".join(rng.choices(vocabulary, k=3_000)).encode()[: 2 * compression.CHUNK]
    noise = base64.b64encode(rng.randbytes(1_500))[:2_000]
    whole, least, _ = compression.ratios(clean + noise, compress)
    end = (clean + noise)[-compression.CHUNK :]
    assert least == len(end) / len(compress(end)) < compression.ratios(clean, compress)[1]
    assert compression.ratios(b"abc", compress)[1] is None
    assert compression.ratios(clean[:3_000], compress)[1] == 3_000 / len(compress(clean[:3_000]))
