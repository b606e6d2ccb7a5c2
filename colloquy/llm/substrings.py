"""Substring dedup (operator 7): prefix-partitioned suffix trees.

The suffixes are those that begin at a word and may take part in a repeat of ``span`` words (see
anchors.py: no repeat is lost), cut at depth ``span``. A suffix's label has the fingerprints of its
prefixes of four depths, 8, 17, 26 and 35 words for span 35: the tree's levels, so that a path of
words is one step.

A first pass counts the suffixes by prefix, for each depth, in buckets of prefixes. A suffix goes to
the group of its shortest prefix whose bucket holds ``LEAVES`` suffixes at most, so a prefix that is
too frequent is split at the next depth, and a group fits in memory. Only prefixes of full depth may
be more frequent: their suffixes are dealt by place over as many groups as it takes, and the counts
of their nodes, one row a node and group, are added up afterwards.

A group's subtree is its sorted labels and the depths at which neighbours part (LCP). An internal
node is a run of suffixes that share a depth; those of full depth are the deep ones, and their leaves
are the windows that repeat. What the tasks report is the rest, leaves alone at full depth. The
windows that repeat are joined to maximal runs of each text.

The driver sees only buckets that hold more than ``LEAVES`` suffixes, and these only if their bytes allow
it; else they are joined with the suffixes.

Defined results: a null text has no words; texts of fewer than ``span`` words lose nothing; exact
copies of ``span`` words or more lose every word; repeated rows count as copies; rows of equal id
and other text are documents of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import NO_ID, covered, kept_digest, live_anchors, live_positions, live_windows
from .tables import written
from .words import Words, ints, mix, slices, span_hashes

LABEL = ["k1", "k2"]
#: So many suffixes of a group are held in memory.
LEAVES = 1 << 18
#: Fingerprints that are counted at a time, and bytes of hot buckets that are broadcast.
COUNTED, HOT_BYTES = 1 << 21, 64 << 20
#: The counting pass has so many buckets of prefixes for each group that there must be.
SPREAD = 16
NODES = "k1 long, k2 long, doc long, pos int, leaves int, edge boolean"


def depths(span: int) -> tuple[int, int, int, int]:
    return max(1, span // 4), max(1, span // 2), max(1, 3 * span // 4), span


def labelled(part: pa.RecordBatch, k: int, span: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text and first word of each suffix of a batch, and its fingerprint at each depth (32 bits)."""
    words = Words(part.column("text"))
    starts = live_windows(words, live_positions(part.column("live")), k, span)
    text = np.repeat(np.arange(len(words)), [len(x) for x in starts])
    pos = np.concatenate([*starts, np.zeros(0, np.int64)])
    at = pos + words.first[text]
    return text, pos, [span_hashes(words.hashes, at, at + depth, 10 + n) >> np.uint64(32) for n, depth in enumerate(depths(span))]


def bucket_of(fingerprint: np.ndarray, n: int) -> np.ndarray:
    return (fingerprint & np.uint64(n - 1)).astype(np.int64)


def count_task(k: int, span: int, n: int, share: float):
    """Partial counts of the suffixes in each bucket of prefixes, at each depth (bucket: depth * n + bucket).

    Buckets that hold less than a share of what is counted at a time are left out, so that not every task tells of
    every bucket; over all of the input a bucket's count is too low by at most that share of all suffixes.
    """

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(parts)
        bucket, often = np.unique(whole, return_counts=True)
        bucket, often = (x[often >= share * len(whole)] for x in (bucket, often))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(often.astype(np.int64))], names=["bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for part in slices(whole, "text"):
                for level, fingerprint in enumerate(labelled(part, k, span)[2]):
                    held.append(bucket_of(fingerprint, n) + level * n)
                    size += len(fingerprint)
                if size > COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return run


def groups_of(fingerprints: list[np.ndarray], place: np.ndarray, hot: tuple[np.ndarray, np.ndarray], n: int, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each suffix, and whether its group has only a part of a prefix of full depth; hot: buckets of more than ``leaves``, sorted, and their counts."""
    keys, counts = hot
    group, split = np.zeros(len(place), np.uint64), np.zeros(len(place), bool)
    todo = np.ones(len(place), bool)
    for level, fingerprint in enumerate(fingerprints):
        bucket = bucket_of(fingerprint, n)
        often = np.zeros(len(bucket), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, bucket + level * n), len(keys) - 1)
            often = np.where(keys[at] == bucket + level * n, counts[at], 0)
        here = todo & ((often == 0) | (level == 3))
        parts = np.maximum(-(-often // leaves), 1)
        split |= here & (parts > 1)
        group[here] = mix(bucket[here] * 4 + level, 41) ^ mix(place[here] % parts[here].astype(np.uint64), 42)
        todo &= ~here
    return (ints(group) >> 32).astype(np.int32), split


SUFFIX = "k1 long, k2 long, doc long, pos int"


def suffix_task(held, k: int, span: int, n: int, leaves: int):
    """The suffixes of a batch of texts, with label; pos is complemented where the text has copies. With
    held (the hot buckets) their groups, without it what tells them: buckets by depth, and a number by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                text, pos, d = labelled(part, k, span)
                if not len(pos):
                    continue
                doc = part.column("doc").to_numpy()[text]
                place = mix(mix(doc, 43) ^ pos.astype(np.uint64), 44)
                copies = part.column("copies").to_numpy()[text] > 1
                columns = {"k1": ints((d[0] << np.uint64(32)) | d[1]), "k2": ints((d[2] << np.uint64(32)) | d[3]), "doc": doc, "pos": np.where(copies, ~pos, pos).astype(np.int32)}
                if held is None:
                    columns |= {f"b{level}": bucket_of(fingerprint, n) + level * n for level, fingerprint in enumerate(d)} | {"place": ints(place)}
                else:
                    columns["group"], columns["split"] = groups_of(d, place, held.value, n, leaves)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

    return run


def grouped_suffixes(texts: DataFrame, k: int, span: int, words: int, n: int) -> DataFrame:
    """The suffixes with their groups. Only hot buckets are told to the tasks; more of them than HOT_BYTES has room for are joined.

    Counts may be too low by a quarter of LEAVES, which is added to them: groups keep their bound, and what repeats
    does not depend on how suffixes are grouped.
    """
    lost = LEAVES // 4
    task = count_task(k, span, n, lost / max(4 * words, 1))
    counts = texts.select("text", "live").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg((F.sum("n") + lost).alias("n"))
    hot = written(counts.where(F.col("n") > LEAVES), "hot")
    columns = texts.select("doc", "text", "copies", "live")
    if 16 * hot.count() <= HOT_BYTES:
        found = hot.orderBy("bucket").toArrow()
        held = texts.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("bucket", "n")))
        return columns.mapInArrow(suffix_task(held, k, span, n, LEAVES), f"{SUFFIX}, group int, split boolean")
    rows = columns.mapInArrow(suffix_task(None, k, span, n, LEAVES), f"{SUFFIX}, b0 long, b1 long, b2 long, b3 long, place long")
    for level in range(4):
        rows = rows.join(hot.select(F.col("bucket").alias(f"b{level}"), F.col("n").alias(f"n{level}")), f"b{level}", "left")
    parts = F.ceil(F.coalesce("n3", F.lit(1)) / LEAVES)
    bucket = F.when(F.col("n0").isNull(), F.col("b0")).when(F.col("n1").isNull(), F.col("b1")).when(F.col("n2").isNull(), F.col("b2")).otherwise(F.col("b3"))
    deep = F.col("n0").isNotNull() & F.col("n1").isNotNull() & F.col("n2").isNotNull()
    share = F.when(deep, F.pmod("place", parts)).otherwise(F.lit(0))
    return rows.select("k1", "k2", "doc", "pos", F.xxhash64(bucket, share).bitwiseAND(0x7FFFFFFF).cast("int").alias("group"), (deep & (parts > 1)).alias("split"))


def shared_depths(group: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """How many levels each suffix (sorted) shares with the one before it (0 to 4); -1 where a group begins."""
    lcp = np.full(len(group), -1, np.int8)
    same = group[1:] == group[:-1]
    a, b = k1[1:] ^ k1[:-1], k2[1:] ^ k2[:-1]
    levels = np.where(a != 0, np.where(a >> 32 != 0, 0, 1), np.where(b >> 32 != 0, 2, np.where(b != 0, 3, 4)))
    lcp[1:][same] = levels[same]
    return lcp


def nodes_at(lcp: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of suffixes that share ``level`` levels: the tree's nodes of that depth, leaves alone too."""
    begins = np.flatnonzero(lcp < level)
    return begins, np.append(begins[1:], len(lcp))


def tree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over suffixes sorted by group and label: leaves alone at full depth, and each node of full depth of split prefixes (edge).

    leaves: how many a reported node has (2: two or more).
    """
    held: list[pa.RecordBatch] = []

    def settled(b: pa.RecordBatch) -> pa.RecordBatch:
        group, k1, k2, doc, pos = (b.column(c).to_numpy() for c in ("group", "k1", "k2", "doc", "pos"))
        split = b.column("split").to_numpy(zero_copy_only=False)
        begins, _ = nodes_at(shared_depths(group, k1, k2), 4)
        leaves = np.minimum(np.add.reduceat(np.where(pos < 0, 2, 1), begins), 2)
        told = (leaves == 1) | split[begins]
        at = begins[told]
        columns = [k1[at], k2[at], doc[at], pos[at], leaves[told].astype(np.int32), split[at]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k1", "k2", "doc", "pos", "leaves", "edge"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        group = b.column("group").to_numpy()
        last = np.flatnonzero(group[1:] != group[:-1])
        first = held[0].column("group")[0].as_py()
        at = int(last[-1]) + 1 if len(last) else 0
        if at or first != group[0]:  # groups end in this batch; the last one is open
            done = [*held[:-1], b.slice(0, at)]
            yield settled(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
            held = [b.slice(at)]
    if held:
        yield settled(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def remove_task(k: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"))
                starts = live_windows(words, live_positions(part.column("live")), k, span)
                removed, digest, spans = [], [], []
                for n, alone in enumerate(part.column("alone").to_pylist()):
                    count = int(words.counts[n])
                    again = np.setdiff1d(starts[n], np.array(alone or [], np.int64))
                    gone = covered(again, again + span, count)
                    removed.append(int(gone.sum()))
                    digest.append(kept_digest(words, n, ~gone))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("c1"), part.column("c2"), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, SPANS)], names=["rep", "c1", "c2", "n_removed", "kept_sha256", "removed"])

    return run


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def substring_dedup(docs: DataFrame, span: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256, removed): removed has the runs of words taken out."""
    k = max(1, span // 3)
    rows, contents, texts = live_anchors(docs, k, span, True, id_col, text_col)
    words = rows.agg(F.sum("n_words")).first()[0] or 0
    n = 1 << min(32, int(np.ceil(np.log2(max(words * SPREAD / LEAVES, 1 << 12)))))
    suffixes = grouped_suffixes(texts, k, span, words, n)
    nodes = suffixes.repartition("group").sortWithinPartitions("group", *LABEL).mapInArrow(tree_task, NODES)
    nodes = written(nodes, "nodes")
    edges = nodes.where("edge").groupBy(*LABEL).agg(F.sum("leaves").alias("leaves"), F.min("doc").alias("doc"), F.min("pos").alias("pos")).where("leaves = 1")
    alone = nodes.where("not edge").select("doc", "pos").unionAll(edges.select("doc", "pos")).groupBy("doc").agg(F.collect_list("pos").alias("alone"))
    cut = texts.where("copies = 1").join(alone, "doc", "left").select("rep", "c1", "c2", "text", "live", "alone").mapInArrow(remove_task(k, span), "rep long, c1 long, c2 long, n_removed long, kept_sha256 string, removed array<struct<begin:bigint,end:bigint>>")
    copied = contents.where("copies > 1").select("c1", "c2", F.lit(True).alias("copied"))
    cut = cut.select("c1", "c2", "n_removed", "kept_sha256", "removed").unionByName(copied, allowMissingColumns=True)
    all_gone = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= span)
    return rows.join(cut, ["c1", "c2"], "left").select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias(id_col),
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(all_gone, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))).otherwise(F.coalesce("removed", F.array().cast("array<struct<begin:bigint,end:bigint>>"))).alias("removed"),
    )
