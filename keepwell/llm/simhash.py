"""SimHash near-duplicates through a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint of its word shingles; fingerprints
link when at most ``max_bits`` bits differ, and linked documents form groups.

The distinct fingerprints are sorted by Gray rank, so that neighbours share
long bit patterns, and cut into blocks of equal size.  A block is a tree:
every node holds the bits that all its fingerprints share and that its
parent's do not (a mask and a value).  A search goes down level by level,
adds the differences found in each node's mask, and drops a whole group once
the sum passes ``max_bits``.  The blocks' own patterns are the tree's upper
nodes: they decide which later blocks a fingerprint has to visit.  Each task
searches one block and returns a spanning forest of what it linked, never the
pairs; the forests meet in ``connected_components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.columns import id_and_text, per_text, schema_of
from keepwell.llm.components import connected_components
from keepwell.session import materialize

SEED = 42
#: Fingerprints in a block, until there are MAX_BLOCKS of them; then blocks grow, so the table of blocks stays bounded.
BLOCK_ROWS = 131_072
MAX_BLOCKS = 4_096
#: Fingerprints that one task searches against a block.
ASKED = 32_768
FANOUT = 4
CHUNK = 1_024
_VOTES = 100_000


def simhash64(text: bytes | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _VOTES):
        to = min(n, at + _VOTES)
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)])
        votes += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row for each row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col)
    return per_text(rows, schema_of(rows, "id", ("fp", "long")), lambda: lambda text: (simhash64(text, shingle),))


def gray_rank(fp):
    """Place of a fingerprint, read as a Gray code word, in Gray order; as a signed number that sorts alike."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


class GrayTree:
    """The nodes over a sorted run of fingerprints; level 0 are the fingerprints themselves."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray):
        """``lows``, ``highs``: AND and OR of each leaf's members (for a single fingerprint, itself twice)."""
        self.n = len(lows)
        ands, ors = [lows.astype(np.uint64)], [highs.astype(np.uint64)]
        while len(ands[-1]) > FANOUT:
            cuts = np.arange(0, len(ands[-1]), FANOUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], cuts))
            ors.append(np.bitwise_or.reduceat(ors[-1], cuts))
        shared = [~(a ^ o) for a, o in zip(ands, ors, strict=True)]
        self.values, self.free = ands, [64 - np.bitwise_count(s).astype(np.int64) for s in shared]
        self.masks = [s if k + 1 == len(shared) else s & ~shared[k + 1][np.arange(len(s)) // FANOUT] for k, s in enumerate(shared)]

    def search(self, queries: np.ndarray, most: int, whole: bool, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, leaf) with a difference of at most ``most`` in the leaf's shared bits.

        ``whole``: where a group lies within reach as a whole, only its first
        leaf is returned.  ``skip(level, query, node)``: true for groups that
        need no look.
        """
        top = len(self.masks) - 1
        q = np.repeat(np.arange(len(queries)), len(self.masks[top]))
        node = np.tile(np.arange(len(self.masks[top])), len(queries))
        sums = np.zeros(len(q), dtype=np.int64)
        found_q, found_leaf = [], []
        for level in range(top, -1, -1):
            sums = sums + np.bitwise_count((queries[q] ^ self.values[level][node]) & self.masks[level][node])
            keep = sums <= most
            if skip is not None:
                keep &= ~skip(level, q, node)
            q, node, sums = q[keep], node[keep], sums[keep]
            done = np.full(len(q), True) if level == 0 else (sums + self.free[level][node] <= most if whole else np.full(len(q), False))
            found_q.append(q[done])
            found_leaf.append(node[done] * FANOUT**level)
            q, node, sums = q[~done], node[~done], sums[~done]
            if level:
                q, sums = np.repeat(q, FANOUT), np.repeat(sums, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = node < len(self.masks[level - 1])
                q, node, sums = q[there], node[there], sums[there]
        return np.concatenate(found_q), np.concatenate(found_leaf)


def _settle(labels: np.ndarray) -> None:
    while not np.array_equal(up := labels[labels], labels):
        labels[:] = up


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every link the same label, the smaller one; labels stay roots."""
    while len(a):
        of_a, of_b = labels[a], labels[b]
        apart = of_a != of_b
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(of_a, of_b)[apart], np.minimum(of_a, of_b)[apart])
        _settle(labels)


def _forest(members: np.ndarray, queries: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Labels of members, then queries: the place of one that is linked to it, here or through others.

    ``own``: for a query that is a member its place there, else -1.
    """
    tree = GrayTree(members, members)
    n = tree.n
    labels = np.arange(n + len(queries))
    labels[n:][own >= 0] = own[own >= 0]
    leaves = np.arange(n)
    for level, free in enumerate(tree.free):
        near = free[leaves // FANOUT**level] <= most
        labels[:n][near] = (leaves // FANOUT**level * FANOUT**level)[near]
    _settle(labels)
    for at in range(0, len(queries), CHUNK):
        part = np.arange(at, min(at + CHUNK, len(queries)))
        low, high = [labels[:n]], [labels[:n]]
        for masks in tree.masks[1:]:
            cuts = np.arange(len(masks)) * FANOUT
            low.append(np.minimum.reduceat(low[-1], cuts))
            high.append(np.maximum.reduceat(high[-1], cuts))

        def joined(level, q, node, low=low, high=high, part=part):
            mine = labels[n + part[q]]
            return (low[level][node] == mine) & (high[level][node] == mine)

        q, leaf = tree.search(queries[part], most, True, joined)
        _merge(labels, n + part[q], leaf)
    return labels


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): one row for each row of ``docs``.

    Exact over all documents: whoever is reachable over links of at most
    ``max_bits`` differing bits shares ``component_id``, the smallest id
    among them (nulls do not count; null if there are only nulls).  Null and
    empty texts have the fingerprint 0 and link like any other.  Repeated
    rows and equal fingerprints are one node of the index.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")))
    blocks = materialize(_blocks(nodes))
    links = _links(blocks, max_bits)
    labels = connected_components(links, "a", "b")
    linked = nodes.join(labels, nodes.fp == labels.node).select("fp", "least", "root")
    least = linked.groupBy("root").agg(F.min("least").alias("of_all"))
    of_fp = linked.join(least, "root").select("fp", "of_all")
    known = nodes.join(of_fp, "fp", "left").select("fp", F.coalesce("of_all", "least").alias("component_id"))
    return rows.join(known, "fp").select("id", "fp", "component_id")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(block, fp): runs of about equal size in Gray order."""
    n_blocks = max(1, min(MAX_BLOCKS, -(-nodes.count() // BLOCK_ROWS)))
    ranked = nodes.select("fp", gray_rank(F.col("fp")).alias("rank"))
    shares = [k / n_blocks for k in range(1, n_blocks)]
    # MAX_BLOCKS - 1 numbers at most.
    cuts = np.array(ranked.agg(F.percentile_approx("rank", shares, 100_000)).first()[0] if shares else [], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(cuts, batch.column("rank").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("fp")], names=["block", "fp"])

    return ranked.mapInArrow(place, "block int, fp long")


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """One block as one row: its fingerprints in Gray order as bytes, and the bits they share."""
    fp = group["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    low, high = np.bitwise_and.reduce(fp), np.bitwise_or.reduce(fp)
    return pd.DataFrame({"block": group["block"].iloc[:1], "members": [fp[np.argsort(rank)].tobytes()], "low": [low.view(np.int64)], "high": [high.view(np.int64)]})


def _links(blocks: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that are to be connected."""
    packed = materialize(blocks.groupBy("block").applyInPandas(_pack, "block int, members binary, low long, high long"))
    # One row per block, MAX_BLOCKS at most: the upper nodes of the hierarchy.
    upper = packed.select("block", "low", "high").orderBy("block").toPandas()
    ids = upper["block"].to_numpy(dtype=np.int64)
    lows, highs = (upper[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("low", "high"))
    if len(ids) == 0:
        return blocks.select(F.col("fp").alias("a"), F.col("fp").alias("b"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = GrayTree(lows, highs)
        for batch in batches:
            fp, home = batch.column("fp").to_numpy(), batch.column("block").to_numpy()
            for at in range(0, len(fp), CHUNK):
                part, own = fp[at : at + CHUNK], home[at : at + CHUNK]
                q, leaf = tree.search(part.view(np.uint64), max_bits, False)
                mine = ids[leaf] >= own[q]
                yield pa.RecordBatch.from_arrays([pa.array(ids[leaf[mine]].astype(np.int32)), pa.array(part[q[mine]])], names=["block", "fp"])

    # Each fingerprint is asked of its own block and of the later ones that may hold a link; a block that is asked much is searched by several tasks.
    asked = blocks.mapInArrow(visits, "block int, fp long")
    shares = materialize(asked.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("n")))
    asked = asked.join(F.broadcast(shares), "block").select("block", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("share"), "fp")
    trees = packed.join(F.broadcast(shares), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("share"), "members")

    def link(tree: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        members = np.frombuffer(tree["members"].iloc[0], dtype=np.uint64)
        queries = asks["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        by_value = np.argsort(members)
        at = by_value[np.minimum(np.searchsorted(members, queries, sorter=by_value), len(members) - 1)]
        labels = _forest(members, queries, np.where(members[at] == queries, at, -1), max_bits)
        every = np.concatenate([members, queries])
        far = every[labels] != every
        return pd.DataFrame({"a": every[far].view(np.int64), "b": every[labels[far]].view(np.int64)})

    return trees.groupBy("block", "share").cogroup(asked.groupBy("block", "share")).applyInPandas(link, "a long, b long")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicate_groups(docs)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id (null last), ties by content.

    All columns stay.  Rows that are equal in id and text count as one row.
    """
    mark = F.xxhash64(F.col(text_col), F.col(id_col))
    groups = near_duplicate_groups(docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("own"), mark.alias("mark")).alias("place"), text_col), shingle, max_bits, "place", text_col)
    kept = groups.select("component_id").distinct().select(F.col("component_id.own").alias("__own"), F.col("component_id.mark").alias("__mark"))
    marked = docs.withColumn("__mark", mark)
    rows = marked.join(kept, (F.col(id_col).eqNullSafe(F.col("__own"))) & (marked["__mark"] == kept["__mark"]), "left_semi")
    return rows.dropDuplicates([id_col, "__mark"]).drop("__mark")
