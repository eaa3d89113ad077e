"""Near-duplicate documents: MinHash, banding, verification, connected components.

1. Each text becomes the set of its 5-word shingles (64-bit hashes), and the set's
   minima under many universal hash functions become its signature.
2. Texts with equal sets are one node, whatever their number; its document is the
   smallest. Everything below works on nodes.
3. Bands of the signature put nodes into buckets. For each node it is counted how many
   of its shingles occur in any other node there: the intersection with another node is
   no larger, which rules out most pairs of copies that have been edited more than a link
   allows before they are formed. In a bucket, not all pairs are
   compared: a pivot is compared with all others. The first pivot is the node that
   shares most buckets with others, which is the original among its edited copies.
   A bucket whose nodes are connected is done. In the others the compared pivots are
   taken out and ``DRAW`` times as many are drawn, until no bucket holds two
   components. From then on a pair is formed in the first of its open buckets only, and only if the rarest shingles of both
   meet, as those of linked sets must: with the shingles of a set in order of their number in all sets, the larger set's first (1 - t) share
   has one in common with the smaller set's first (1 - t) / (1 + t) share. Copies that have been edited
   each in its own way have rare shingles of their own and don't meet.
   So each pair in a bucket is compared, known to be connected, or known not to be linked.
4. A pair is first judged by its signatures, with a margin beyond which no link is
   lost in practice (5.5 standard errors), then by the two full sets.
5. Links become components by alternating large-star and small-star.

The number of rows of a band is the largest with which a link at the threshold is
missed with a chance below ``MISS``. Null and empty texts have no shingles and are linked
with nothing. Rows that share a doc_id are one node. Rows with a null doc_id are
linked with nothing, have a null component and are kept.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD_BYTES, Phrases, Words, anti, arrow_map, mix, signed, slices, small, stored, with_bytes
from .components import components
from .tokens import release

SHINGLE = 5
BANDS = 32
MISS = 1e-7
DRAW = 256


def rows_per_band(percent: int, bands: int = BANDS, miss: float = MISS) -> int:
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** bands <= miss]
    return max(fits, default=1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted hashes of its shingles; of a shorter one, its whole sequence."""
    words = Words(texts, lower=True)
    phrases = Phrases(words.code)
    first = words.first
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(int))
    offset = np.cumsum(n) - n
    start = np.repeat(first[:-1] - offset, n) + np.arange(int(n.sum()))
    end = np.minimum(start + size, np.repeat(first[1:], n))
    hashes = phrases.of(start, end)
    return [np.unique(hashes[o : o + k]) for o, k in zip(offset.tolist(), n.tolist())]


def signatures(sets: list[np.ndarray], n_hashes: int, block: int = 1 << 15) -> np.ndarray:
    """Minima of the sets, a row for each, under multiply-add hashes modulo 2**64 (their upper halves)."""
    rng = np.random.default_rng(7)
    factor = rng.integers(1, 2**63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, n_hashes, dtype=np.uint64)
    out = np.full((len(sets), n_hashes), 2**64 - 1, np.uint64)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        stop, total = at, 0
        while stop < len(filled) and (stop == at or total + len(sets[filled[stop]]) <= block):
            total += len(sets[filled[stop]])
            stop += 1
        part = [sets[i] for i in filled[at:stop]]
        values = np.concatenate(part)
        starts = np.cumsum([0] + [len(p) for p in part[:-1]])
        mine = np.empty((n_hashes, len(part)), np.uint64)
        for h in range(n_hashes):
            mine[h] = np.minimum.reduceat(values * factor[h] + shift[h], starts)
        out[filled[at:stop]] = mine.T
        at = stop
    return (out >> np.uint64(32)).astype(np.uint32)


def fingerprints(docs: DataFrame, n_hashes: int, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the set; null if empty), ``signature``."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        release()
        for part in slices(batch, limit=WORD_BYTES):
            sets = shingle_sets(part.column("text"), size)
            yield {
                "doc_id": part.column("doc_id"),
                "n_shingles": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "signature": [row.tobytes() for row in signatures(sets, n_hashes)],
            }

    return arrow_map(with_bytes(docs, "doc_id"), work, "doc_id long, n_shingles long, digest binary, signature binary")


def band_keys(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``node, key``: a bucket for each band of its signature."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, bands, rows)
        key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + marks[:, :, r].astype(np.uint64))
        yield {"node": np.repeat(batch.column("node").to_numpy(), bands), "key": signed(np.ascontiguousarray(key)).ravel()}

    return arrow_map(nodes.select("node", "signature"), work, "node long, key long")


def agreeing(pairs: DataFrame, marks: DataFrame, n_hashes: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose signatures don't rule out a link."""
    share = percent / 100
    need = n_hashes * (share - 5.5 * (share * (1 - share) / n_hashes) ** 0.5)

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, n_hashes) for c in ("sa", "sb"))
        near = pa.array((one == two).sum(axis=1) >= need)
        yield {c: batch.column(c).filter(near) for c in ("a", "b")}

    with_a = pairs.join(marks.toDF("a", "sa"), "a")
    return arrow_map(with_a.join(marks.toDF("b", "sb"), "b").select("a", "b", "sa", "sb"), work, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets reach the similarity."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    own = held(sets, ends)
    both = pairs.join(own.toDF("a", "set_a"), "a").join(own.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return both.where(F.col("shared") * 100 >= percent * (F.col("sum") - F.col("shared"))).select("a", "b").distinct()


def held(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``node`` is in ``ids``. Signatures and sets are heavy, so they are not shuffled for what is not compared."""
    return rows.join(small(ids.select("node"), BROADCAST_IDS), "node", "left_semi")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``node, set`` of the documents in ``ids``."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        for part in slices(batch, limit=WORD_BYTES):
            sets = shingle_sets(part.column("text"), size)
            lengths = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            values = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            yield {"node": part.column("doc_id"), "set": pa.ListArray.from_arrays(pa.array(lengths), pa.array(values))}

    chosen = with_bytes(docs, "doc_id").join(small(ids, BROADCAST_IDS), F.col("doc_id") == F.col("node"), "left_semi")
    return arrow_map(chosen, work, "node long, set array<long>")


def linkable(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``shingle, n`` of the shingles in several sets, and ``node, size, shared`` of the sets of which ``percent`` or more (``shared``) also occurs in others, as a link takes."""
    shingles = sets.select("node", F.size("set").alias("size"), F.explode("set").alias("shingle"))
    common = stored(shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "common")
    shared = shingles.join(common, "shingle", "left_semi").groupBy("node", "size").agg(F.count("*").alias("shared"))
    return common, shared.where(F.col("shared") * 100 >= F.col("size") * percent)


def rarest(sets: DataFrame, common: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``node, probe, index``: the first shingles of each set, the rarest first, as a larger and as a smaller partner.

    Linked sets have ``percent / 100`` of the larger and ``2 * percent / (100 + percent)`` of the smaller in common at least; so
    some common shingle comes before the rest of either. The upper halves of hashes stand for shingles here: equal ones still meet.
    """
    own = held(sets, nodes).select("node", F.explode("set").alias("shingle")).join(common, "shingle", "left")
    own = own.select("node", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "shingle").alias("e"))
    listed = own.groupBy("node").agg(F.array_sort(F.collect_list("e")).alias("s"))
    size = F.size("s")
    first = lambda least: F.transform(F.slice("s", F.lit(1), size - least + 1), lambda e: F.shiftright(e["shingle"], 32).cast("int"))
    larger, smaller = F.expr(f"int((size(s) * {percent}L + 99) div 100)"), F.expr(f"int((size(s) * {2 * percent}L + {99 + percent}) div {100 + percent})")
    return listed.select("node", first(larger).alias("probe"), first(smaller).alias("index"))


def drawn_pairs(open_: DataFrame, pivots: DataFrame, may_link, drawn) -> DataFrame:
    """Pairs ``a, b`` of drawn nodes with the others of their open buckets, that may still be linked.

    A pair that shares several of them is formed in the first one only, from ``keys``: where neither is drawn there, both stay, so
    it is formed in a later draw. Two that are both drawn are formed by the smaller.
    """
    larger = (F.col("size") > F.col("its_size")) | ((F.col("size") == F.col("its_size")) & (F.col("node") > F.col("pivot")))
    meet = F.when(larger, F.arrays_overlap("probe", "its_index")).otherwise(F.arrays_overlap("its_probe", "index"))
    once = (~drawn | (F.col("node") > F.col("pivot"))) & (F.array_min(F.array_intersect("keys", "its_keys")) == F.col("key"))
    apart = (F.col("node") != F.col("pivot")) & (F.col("component") != F.col("own"))
    pairs = open_.join(pivots, "key").where(apart & may_link & once & meet)
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, percent: int, bands: int, rows: int, size: int = SHINGLE) -> DataFrame:
    """``node, component`` of the nodes that are linked with another. ``nodes`` has ``node, signature``."""
    buckets = stored(band_keys(nodes, bands, rows), "buckets")
    sizes = stored(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    members = stored(buckets.join(small(sizes, BROADCAST_IDS), "key").distinct(), "members")
    ids = stored(members.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    sets = stored(full_sets(docs, ids.select("node"), size), "sets")
    common, able = linkable(sets, percent)
    able = stored(able, "linkable")
    marks = stored(held(nodes.select("node", "signature"), able), "marks")
    open_ = stored(members.select("node", "key").join(ids.join(able, "node"), "node"), "open")
    # |a and b| is at most what either shares with anyone, and a link takes (100 + percent) |a and b| >= percent (|a| + |b|)
    may_link = F.least("shared", "its_shared") * (100 + percent) >= (F.col("size") + F.col("its_size")) * percent
    found, tried, labels, draw = None, None, None, 0
    while True:
        if draw == 0:
            chief = F.max_by("node", F.struct(F.col("meets"), -F.col("node")))
            pivots = open_.groupBy("key").agg(chief.alias("pivot")).join(able.toDF("pivot", "its_size", "its_shared"), "pivot")
        else:  # about DRAW ** draw of each bucket, all of a bucket that has no more
            spread = F.pmod(F.xxhash64("node", F.lit(draw)), F.col("n"))
            pivots = open_.where(spread < DRAW**draw).select(
                "key", F.col("node").alias("pivot"), F.col("component").alias("own"),
                F.col("size").alias("its_size"), F.col("shared").alias("its_shared"),
                F.col("probe").alias("its_probe"), F.col("index").alias("its_index"), F.col("keys").alias("its_keys"),
            )
        pivots = stored(pivots, "pivots")
        if draw:
            pairs = drawn_pairs(open_, pivots, may_link, spread < DRAW**draw)
        else:
            pairs = open_.join(pivots, "key").where((F.col("node") != F.col("pivot")) & may_link)
            pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        near = stored(agreeing(pairs, marks, bands * rows, percent), "near")
        new = stored(confirmed(near, sets, percent), "confirmed")
        found = new if found is None else found.union(new)
        labels = stored(components(found), "labels")
        base = open_.drop("component", "n", "keys")
        taken = pivots.select("key", F.col("pivot").alias("node"))
        rest = base.join(taken, ["key", "node"], "left_anti").join(labels, "node", "left")
        rest = stored(rest.withColumn("component", F.coalesce("component", "node")), "rest")
        split = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        split = stored(split.where("lo != hi").select("key", "n"), "split")
        if split.isEmpty():
            return labels
        open_ = rest.join(split, "key")
        own = open_.groupBy("node").agg(F.collect_list("key").alias("keys"))  # one a band at most
        open_ = open_.join(own, "node")
        if not draw:
            open_ = open_.join(stored(rarest(sets, common, stored(open_.select("node").distinct(), "apart"), percent), "rarest"), "node")
        open_ = stored(open_, "open")
        draw += 1


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """For each row ``doc_id, n_shingles, component_id, kept``: linked are texts with a similarity of ``percent`` or more."""
    rows = rows_per_band(percent, bands)
    prints = stored(fingerprints(docs, bands * rows, size), "prints")
    known = prints.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    first = known.withColumnRenamed("doc_id", "node").join(classes, ["digest", "node"])
    nodes = stored(first.dropDuplicates(["digest", "node"]).select("node", "signature"), "nodes")
    labels = links(docs, nodes, percent, bands, rows, size)
    classes = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = prints.select("doc_id", "n_shingles", "digest").join(stored(classes, "components"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id; of repeated rows one."""
    verdicts = stored(near_duplicates(docs, percent, bands, size), "verdicts")
    gone = stored(verdicts.where("not kept").select("doc_id").distinct(), "gone")
    out = anti(docs, small(gone, BROADCAST_IDS))
    repeated = verdicts.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return out
    once = out.where("doc_id is not null").dropDuplicates(["doc_id"])
    return once.unionByName(out.where("doc_id is null"))
