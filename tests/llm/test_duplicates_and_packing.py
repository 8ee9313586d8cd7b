"""SimHash groups, repeated passages, decontamination, packing, chat rotation and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from keepwell.llm import chat, decontam, packing, queries, simhash, suffix_dedup
from keepwell.llm.columns import table
from keepwell.llm.components import connected_components

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    want = plain_components(out, [e for e in links if e[0] != e[1]])
    by = defaultdict(set)
    for n, r in out.items():
        by[r].add(want[n])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(want.values()))


@pytest.mark.parametrize("block_rows", [100, 131_072])
def test_gray_index_finds_every_link(spark, monkeypatch, block_rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(simhash, "ASKED", 150)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(7)
    fps = {0, 2**64 - 1}
    for _ in range(120):
        base = rng.getrandbits(64)
        for _ in range(6):
            fp = base
            for _ in range(rng.randrange(7)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    dense = rng.getrandbits(64)
    fps |= {dense ^ k for k in range(200)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = connected_components(simhash._links(simhash._blocks(nodes), 3), "a", "b").collect()
    roots = {x: x for x in signed} | {r.node: r.root for r in found}
    want = plain_components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    pairs = {(roots[x], want[x]) for x in signed}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_simhash_query(spark, odd, none):
    for docs in (table(spark, SF, "documents"), odd):
        rows = [(r.doc_id, f"{plain_fingerprint(r.text):016x}") for r in docs.collect()]
        out = simhash.op10(docs).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter(rows)
        fps = sorted({f for _, f in rows})
        want = plain_components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (int(a, 16) ^ int(b, 16)).bit_count() <= 3])
        least = {}
        for i, f in rows:
            if i is not None:
                least[want[f]] = min(i, least.get(want[f], i))
        assert all(r.component_id == least.get(want[r.fingerprint]) for r in out)
    assert simhash.op10(none).count() == 0
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    assert kept.count() == simhash.near_duplicate_groups(odd.selectExpr("hash(doc_id, text) as doc_id", "text")).select("component_id").distinct().count()


def plain_removed(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [4_096, 1])
def test_repeated_passages(spark, odd, none, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = random.Random(3)
    passage = bytes(rng.choices(b"abcdefgh ", k=700)).decode()
    texts = [r.text for r in odd.collect()]
    for _ in range(60):
        a = rng.randrange(400)
        body = "".join(rng.choices("ijklmnop é", k=rng.randrange(500)))
        texts.append(body + passage[a : a + rng.randrange(180, 300)] + body[:100])
    texts += [passage * 3, "x" * 1000, "é" * 150, passage[:200], passage[:199]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op5(docs).collect()}
    assert [out[k] for k in range(len(texts))] == plain_removed([(t or "").encode() for t in texts])
    if together > 1:
        assert suffix_dedup.op5(none).count() == 0
        left = suffix_dedup.without_repeated(odd)
        assert left.columns == odd.columns and {r.doc_id for r in left.collect()} >= {1, 2, 3, 4}


def test_windows_have_one_representative():
    rng = random.Random(5)
    text = bytes(rng.choices(b"ab", k=5000)) + b"z" * 3000
    sig, place, first, last = suffix_dedup.window_runs(text, 200)
    assert first[0] == 0 and last[-1] == len(text) - 200 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + 200 - suffix_dedup.GRAM)).all()


def check_packing(docs, out):
    want = Counter()
    tokenizer = Tokenizer.from_file(BPE)
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        for k, a in enumerate(range(0, len(ids), 1024)):
            part = ids[a : a + 1024]
            want[r.doc_id, k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    at = defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values(), default=0) <= 1024
    return len(at), -(-sum(at.values()) // 1024)


def test_packing(spark, odd, none):
    used, least = check_packing(table(spark, SF, "documents"), packing.op2(table(spark, SF, "documents"), BPE).collect())
    assert used <= 1.01 * least
    check_packing(odd, packing.op2(odd, BPE).collect())
    assert packing.op2(none, BPE).count() == 0


def test_query_leaves_only_the_first_piece_short(spark, tmp_path):
    """The contract: longer documents are cut into 1024-token pieces, of which the first may be shorter."""
    tokenizer = Tokenizer.from_file(BPE)
    texts = {1: "one two three", 2: "w" + " w" * 2500, 3: "w" + " w" * 2046, 4: None, 5: "w" + " w" * 1023, 6: "w" + " w" * 1022}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for k, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        starts = [a for a in range(len(ids) % -1024, len(ids), 1024)]
        for piece, a in enumerate(starts):
            part = ids[max(a, 0) : a + 1024]
            want.add((k, piece, max(a, 0), len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    out = queries.QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    at = defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024


def test_words_beyond_memory_are_encoded_alike(monkeypatch):
    texts = ["some words and more words", "more other words here", " odd  spaces\tand words "]
    whole = list(packing.WordCoder(BPE).encode(texts))
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    coder = packing.WordCoder(BPE)
    assert [next(coder.encode([t])) for t in texts] == whole


class CountedReads(dict):
    reads = 0

    def __getitem__(self, key):
        self.reads += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.reads += 1
        return super().get(key, default)


def test_a_word_is_looked_up_once_for_all_its_places():
    odd = ["", " ", "a  b", "tab\there", " first", "last ", "line\nbreak\n", "\u00a0x y", "na\u00efve caf\u00e9!", "it's we're 12 a,b"]
    texts = ["the same words again", *odd, "the words"] * 60
    coder = packing.WordCoder(BPE)
    coder.later = CountedReads()
    plain = [np.array(e.ids, dtype="<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(coder.encode(texts)) == plain
    assert 0 < coder.later.reads <= len({w for t in texts for w in t.split(" ")})
    assert list(coder.encode([])) == []


def test_plan_holds_everything():
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.randrange(4, 60)
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(200)))
        shapes = packing.plan(dict(counts), capacity)
        held = Counter()
        for bins, content in shapes:
            assert sum(n * k for n, k in content) <= capacity
            for n, k in content:
                held[n] += bins * k
        assert held == counts


def test_decontamination_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    out = decontam.op8(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()
    assert sorted(map(tuple, out)) == sorted(con.sql(decontam.SQL).fetchall())
    assert any(r.contaminated for r in out)


@pytest.mark.parametrize("block_bytes", [8_000_000, 200])
def test_decontamination_against_brute_force(spark, odd, none, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    rng = random.Random(11)
    word = lambda: rng.choice("ab")
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 13, 14, 40])))) for k in range(25)]
    items += [(90, None), (91, ""), (92, items[3][1]), (None, "x y z"), (3, items[3][1])]
    docs = [(k, " ".join(rng.choice("aaabbbxyz") for _ in range(rng.randrange(80)))) for k in range(60)]
    docs += [(100 + k, f"q {t} q") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.id: r for r in decontam.judged(decontam.find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"))).collect()}
    for k, text in docs:
        w = (text or "").split()
        hit, names = set(), set()
        for name, item in items:
            v = (item or "").split()
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if v else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names.add("null" if name is None else str(name))
        r = out[k]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(names))
        assert {i for s in r.spans for i in range(s.start, s.end)} == hit
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.op8(odd, empty).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.op8(none, empty).count() == 0
    assert decontam.clean(odd, empty).columns == odd.columns and decontam.clean(odd, empty).count() == odd.count()
    assert decontam.without_spans(b"A, b-c; d.", [{"start": 1, "end": 3}]) == b"A, ; d."


def test_rotation(spark):
    rows = [
        ("c", 0, "system", "Be kind."), ("c", 1, "ann", "Hi"), ("c", 2, "bob", "Hello"), ("c", 2, "bob", "Hello"), ("c", None, "ann", None), ("c", 3, None, "?"),
        ("d", 0, "system", "alone"), (None, 0, "ann", "x"), ("e", 1, "ann", "tie"), ("e", 1, "bob", "tie"),
    ]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    con = duckdb.connect()
    con.register("arrow", frame.toArrow())
    con.sql("CREATE VIEW conversations AS SELECT * FROM arrow")
    out = chat.op7(frame)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(con.sql(chat.SQL).fetchall(), key=key)
    ann = sorted((r for r in out.collect() if r.conv_id == "c" and r.perspective == "ann"), key=lambda r: r.position)
    assert [r.chat_role for r in ann] == ["system", "assistant", "user", "user", "user", "assistant"]
    assert ann[1].rendered[ann[1].loss_start : ann[1].loss_end] == "Hi<|im_end|>"
    assert ann[2].rendered == "<|im_start|>user name=bob\nHello<|im_end|>\n" and ann[2].loss_end == 0
    assert not any(r.conv_id == "d" for r in out.collect())
    assert chat.op7(frame.where("false")).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_pipeline_stages_on_odd_rows(spark, odd, none, tmp_path):
    for docs in (odd, none):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns, name
        assert corpus_pipeline.packing(spark, kept, SF).columns[:2] == ["doc_id", "piece"]


def test_pipeline_against_plain_stages(spark):
    """Each stage's decisions, judged on its own input."""
    docs = table(spark, SF, "documents")
    items = table(spark, SF, "benchmark")
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, held, SF).toPandas())
        before = {r.doc_id: r.text for r in held.collect()}
        after = {r.doc_id: getattr(r, "text", None) for r in out.collect()}
        if name == "language":
            assert set(before) == set(after)
        elif name == "near_duplicates":
            groups = simhash.op10(held).collect()
            assert set(after) == {r.component_id for r in groups}
        elif name == "repeated_passages":
            texts = [before[k].encode() for k in sorted(before)]
            for k, (size, gone, _, _) in zip(sorted(before), plain_removed(texts), strict=True):
                assert (k in after) == (gone < size or not size)
                assert k not in after or (after[k] == before[k]) == (gone == 0)
        elif name == "decontamination":
            judged = {r.doc_id: r for r in decontam.op8(held, items).collect()}
            assert set(after) == {k for k, r in judged.items() if not r.contaminated}
            assert all((after[k] == before[k]) == (judged[k].n_hit == 0) for k in after)
        else:
            check_packing(held, out.collect())
        held = out
