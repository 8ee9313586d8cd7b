"""Ranked search against scoring every document, and against the SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from keepwell.llm import ranked
from keepwell.llm.columns import table

SF = "/root/testdata/sf0.01"
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [w.lower() for w in TERM.findall((text or "").encode())]


def plain(docs, items, top=20):
    docs = [(d, Counter(t), len(t)) for d, text in docs for t in [terms_of(text)]]
    big_n, big_l = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item, text in set(items):
        found = []
        for doc_id, tf, n in docs:
            m = 75 + (25 * n * big_n) // max(big_l, 1)
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms_of(text) if tf[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def rows_of(frame):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, frame), key=key)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    out = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for k in range(n)]
    return out + [(n + k, out[k % 7][1]) for k in range(n // 3)]


@pytest.mark.parametrize("parts", [3, 60])
@pytest.mark.parametrize("query_bytes", [400, 4_000_000])
def test_search_equals_scoring_everything(spark, monkeypatch, parts, query_bytes):
    monkeypatch.setattr(ranked, "QUERY_BYTES", query_bytes)
    docs = texts(1, 400)
    items = [(k, t) for k, t in texts(2, 12)] + [(100, "nothing known here"), (101, ""), (102, None), (103, "w0 w0 W0 w119"), (103, "w0 w0 W0 w119"), (None, "w5 w6 w7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = ranked.op12(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows_of(got.collect()) == rows_of(plain(docs, items))


def test_blocks_are_skipped_and_bounds_hold():
    docs, items = texts(3, 600), [t for _, t in texts(4, 10)]
    vocabulary = sorted({w for t in items for w in terms_of(t)})
    weights = np.array([1000 + 10 * k for k in range(len(vocabulary))], dtype=np.int64)
    queries = ranked.Queries([t.encode() for t in items], vocabulary, weights)
    number = {w: k for k, w in enumerate(vocabulary)}
    searcher, searched = ranked.Searcher(queries, 3), []
    inner = searcher._search
    searcher._search = lambda k, *rest: searched.append(k) or inner(k, *rest)
    for at in range(0, 600, 20):
        block = [Counter(number[w] for w in terms_of(t) if w in number) for _, t in docs[at : at + 20]]
        present = sorted({t for d in block for t in d})
        posts = [[(place, d[t]) for place, d in enumerate(block) if t in d] for t in present]
        impact = [{t: int(weights[t]) * 1000 * d[t] for t in d} for d in block]
        joints = {p: max((i[a] + i[b] for i in impact if a in i and b in i), default=0) for p, (a, b) in enumerate(queries.pairs.tolist())}
        met = [p for p, j in joints.items() if j]
        flat = [x for post in posts for x in post]
        searcher.read({
            "ids": np.arange(at, at + 20), "terms": np.array(present, dtype=np.int32), "ends": np.cumsum([len(p) for p in posts]),
            "places": np.array([p for p, _ in flat], dtype=np.int32), "factors": np.array([1000 * tf for _, tf in flat], dtype=np.int32),
            "tops": np.array([max(i.get(t, 0) for i in impact) for t in present]), "pairs": np.array(met, dtype=np.int64), "joints": np.array([joints[p] for p in met], dtype=np.int64),
        })
    assert 0 < len(searched) < 30 * len(items)
    for k, text in enumerate(items):
        scores = sorted(((-sum(int(weights[number[w]]) * 1000 * Counter(terms_of(t))[w] for w in terms_of(text)), d) for d, t in docs[:600]))
        assert list(zip(searcher.scores[k].tolist(), searcher.ids[k].tolist(), strict=True)) == [(-s, d) for s, d in scores[:3] if s]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ranked.SQL).fetchall()
    assert rows_of(ranked.op12(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()) == rows_of(want)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "words that alpha beta share"), (2, "one die kleine"), (3, "überraschung äpfeln")], "item_id long, text string")
    got = ranked.op12(odd, items).collect()
    assert rows_of(got) == rows_of(plain([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in items.collect()]))
    assert ranked.op12(none, items).count() == 0 and ranked.op12(odd, items.where("false")).count() == 0
