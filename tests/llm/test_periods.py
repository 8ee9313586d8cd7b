"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from keepwell.llm import periods
from keepwell.llm.columns import table


def plain_runs(words, least=12):
    """All maximal runs by trying every period; the smallest period of a stretch wins."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def sorted_by_period(runs):
    return sorted(map(tuple, runs), key=lambda r: (r[0], r[2]))


def strings():
    rng = random.Random(3)
    fib, other = "a", "ab"
    while len(other) < 400:
        fib, other = other, other + fib
    yield from (fib, other, "a" * 300, "ab" * 100 + "b" + "ab" * 100, "", "a", "abc" * 3 + "d" + "abc" * 4)
    yield "x" * 50 + "y" + "x" * 50 + "y" + "x" * 49
    for k in range(60):
        # x^100 x' x^100: a run for each of many periods around one centre.
        x = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
        yield x * rng.randrange(3, 30) + x[: rng.randrange(len(x) + 1)] + x * rng.randrange(3, 30)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abc"
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(12, 90)))
    for _ in range(150):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(3)]
        yield "".join(rng.choice(parts) * rng.randrange(1, 8) for _ in range(rng.randrange(1, 9)))


@pytest.mark.parametrize("least", [4, 12])
def test_runs_equal_a_plain_search(least):
    for s in strings():
        got = periods.runs_of(np.array([ord(c) for c in s], dtype=np.int64), least)
        assert sorted_by_period(got.tolist()) == sorted_by_period(plain_runs(s, least)), s


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted_by_period(plain_runs(words))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def compare(docs):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periods.op11(docs)
    assert got.columns[:8] == names and [t for _, t in got.dtypes[:6]] == ["bigint"] * 6
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = [plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in got.select(names).collect()], key=key) == sorted(want, key=key)


def test_query_equals_a_plain_search(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    # The plain search takes the square of a text.
    short = docs.where("size(split(text, ' ')) < 1500").limit(400)
    assert periods.op11(short).where("n_runs > 0").count() > 30
    compare(short)


def test_odd_rows(spark, odd, none):
    compare(odd.where("doc_id is null or doc_id <> 5"))
    assert periods.op11(none).count() == 0
    assert periods.op11(odd).count() == odd.count()


def test_very_long_texts(spark):
    period = " ".join(f"w{k}" for k in range(50_000))
    docs = spark.createDataFrame([(3, "one " * 200_000), (4, " ".join([period] * 3))], "doc_id long, text string")
    got = {r.id: r for r in periods.find_runs(docs).collect()}
    assert [tuple(x) for x in got[3].runs] == [(0, 200_000, 1)] and got[3].collapsed == b"one"
    assert [tuple(x) for x in got[4].runs] == [(0, 150_000, 50_000)] and got[4].collapsed == period.encode()
