"""MinHash near-dedup (operator 4): ProbMinHash, banding, verification.

Texts are sets of shingles of five words, all of weight 1, as in the verification. Each shingle is a Poisson process
whose rate is its weight; its arrivals, drawn by keyed hashes, fall on random registers of the
sketch, and it stops once the next arrival comes later than every register's. Two registers agree
with the texts' probability Jaccard, which for equal weights is the Jaccard similarity of the sets.
Bands of registers form buckets. Links are verified by the exact Jaccard similarity of the shingle
sets (0.8 or more), in two rounds: each text of a bucket against the bucket's centre, its least
content; then, in buckets whose texts are not of one group yet, every two texts of different groups.
So all texts of a bucket are compared or in one group, whatever its size.

Exact copies (same words) are one content throughout, so thousands of copies cost one sketch row. In
the first round a task holds a centre and one text at a time, and a centre of many texts is dealt
over several tasks. In the second a bucket is cut into tiles of ``UNIT`` shingles at most, and every
two tiles meet in a task of their own; its work grows with the square of the tiles, but only where
band-sharing texts of different groups meet.

Defined results: a row is known by its id and its text, so rows of equal id and other text are
documents of their own; null and empty texts, and texts without words, are a class each (class_key
null); a text of fewer than five words is one shingle; class_key names a class, by its least content
hash; class_id is its least document id, which two classes may share where ids repeat or are null; a
null id counts as the least and stays null; repeated rows are copies; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import may_be_among, written
from .words import U, Words, ints, mix, slices, span_hashes

SHINGLE = 5
UNIT = 2_000_000
NO_ID = -(1 << 63)
#: A centre's texts go to tasks of about so many.
SPOKES = 4096
SKETCH_BYTES = 1 << 20


def distinct_shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles, sorted by text and hash."""
    text, h = words.shingles(k)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new)
    return text[begins], h[begins], np.diff(np.append(begins, len(h)))


def unit_uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from hashes."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def prob_minhash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The sketch (n x m): for each register the hash of the shingle that arrived first (0: no shingle)."""
    first = np.full(n * m, np.inf)
    owner = np.zeros(n * m, U)
    time, round_ = np.zeros(len(h)), 0
    while len(h):
        time = time - np.log(unit_uniform(mix(h, 2 * round_ + 1))) / weight
        if round_:
            latest = first.reshape(n, m).max(axis=1)
            go = time < latest[text]
            text, h, weight, time = text[go], h[go], weight[go], time[go]
        at = text * m + (mix(h, 2 * round_ + 2) % U(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        owner[at[won]] = h[won]
        round_ += 1
    return owner.reshape(n, m)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sketch), bands), U)
    for band in range(bands):
        for r in range(rows):
            out[:, band] = mix(out[:, band] ^ sketch[:, band * rows + r], 31 + band)
    return out


def sketch_task(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SKETCH_BYTES):
                words = Words(part.column("text"))
                text, h, _ = distinct_shingles(words)
                sketch = prob_minhash(text, h, np.ones(len(h)), len(words), bands * rows)
                c1 = span_hashes(words.hashes, words.first[:-1], words.first[1:], 3)
                some = words.counts > 0
                flat = ints(band_hashes(sketch, bands, rows)[some].ravel())
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                size = np.bincount(text, minlength=len(words))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(ints(c1)), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "th", "c1", "size", "bands"])

    return run


def set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle set of each text, as bytes."""
    for whole in batches:
        for part in slices(whole, "text"):
            words = Words(part.column("text"))
            text, h, _ = distinct_shingles(words)
            edges = np.searchsorted(text, np.arange(len(words) + 1))
            yield pa.RecordBatch.from_arrays([part.column("c1"), pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["c1", "shingles"])


def star_task(threshold: float):
    """Over rows sorted by unit, each unit's centre first: links of the centre; two sets in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, centre, own = None, None, None
        for batch in batches:
            found = []
            for u, node, raw in zip(batch.column("unit").to_pylist(), batch.column("c1").to_pylist(), batch.column("shingles"), strict=True):
                other = np.frombuffer(raw.as_buffer(), U)
                if u != unit:
                    unit, centre, own = u, node, other.copy()
                elif node != centre:
                    least = min(len(own), len(other))
                    if least >= threshold * max(len(own), len(other)) - 1e-9:
                        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                        both = np.count_nonzero(own[at] == other)
                        if both >= threshold * (len(own) + len(other) - both) - 1e-9:
                            found.append((centre, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def linked(nodes: list[int], sets: list[np.ndarray], labels: list[int], threshold: float) -> list[tuple[int, int]]:
    """Links (spanning, not all) between sets of different labels and of Jaccard similarity ``threshold`` or more; exact."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    group, out = np.unique(labels, return_inverse=True)[1], []
    # those of the commonest label last, as they are compared with the others only
    order = np.argsort(np.bincount(group)[group], kind="stable")
    mark = np.zeros(int(codes.max()) + 1, bool)
    left = np.ones(len(nodes), bool)
    for i in order.tolist():
        left[i] = False
        if not (group[left] != group[i]).any():
            continue
        mine = codes[begins[i] : begins[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes], begins[:-1], dtype=np.int64)
        mark[mine] = False
        for j in np.flatnonzero(left & (group != group[i]) & (both >= threshold * (sizes + sizes[i] - both) - 1e-9)).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((nodes[i], nodes[j]))
    return out


def link_task(threshold: float):
    """Over rows sorted by unit: links of each unit in turn, one unit in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sets, labels = None, [], [], []

        def close() -> pa.RecordBatch:
            got = linked(nodes, sets, labels, threshold) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            for u, node, label, raw in zip(*(batch.column(n).to_pylist() for n in ("unit", "c1", "label", "shingles")), strict=True):
                if u != unit:
                    if unit is not None:
                        yield close()
                    unit, nodes, sets, labels = u, [], [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, U))
                labels.append(label)
        if unit is not None:
            yield close()

    return run


def star_units(member: DataFrame) -> DataFrame:
    """(c1, unit, centre) of the first round: each content with each of its centres; a centre comes with each of its units."""
    spoke = member.where("c1 <> least").select("c1", "least").distinct()
    parts = spoke.groupBy("least").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("parts"))
    spoke = spoke.join(parts, "least").select("c1", F.xxhash64("least", F.pmod(F.xxhash64("c1"), F.col("parts")).cast("int")).alias("unit"), F.lit(False).alias("centre"))
    return spoke.unionAll(parts.select(F.col("least").alias("c1"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.xxhash64("least", x))).alias("unit"), F.lit(True).alias("centre")))


def pair_units(member: DataFrame, labelled: DataFrame) -> DataFrame:
    """(c1, unit, label) of the second round: tiles of the buckets that hold several groups; labelled: (c1, size, label)."""
    rows = member.select("bucket", "c1").join(labelled, "c1")
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum("size").alias("mass"), F.count("*").alias("n"), F.sum(F.xxhash64("c1").cast("decimal(38,0)")).alias("mark")).where("x <> y")
    once = mixed.groupBy("n", "mark").agg(F.min("bucket").alias("bucket"), F.max("mass").alias("mass"))  # buckets of the same texts
    once = once.select("bucket", F.ceil(F.col("mass") * 2 / UNIT).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("c1"), F.col("tiles")).cast("int")
    return rows.join(once, "bucket").select("c1", "label", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.xxhash64(F.col("bucket"), F.least(x, tile), F.greatest(x, tile)))).alias("unit"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 26, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id, class_size, class_key, text_hash) of every document; text_hash is xxhash64 of the text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    sketches = written(keyed.mapInArrow(sketch_task(bands, rows), "id long, th long, c1 long, size long, bands array<bigint>"), "sketches")
    some = sketches.where("size > 0")
    bucket = written(some.select("c1", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("bucket"), "c1").distinct(), "bands")
    full = written(bucket.groupBy("bucket").agg(F.min("c1").alias("least"), F.max("c1").alias("most")).where("least < most").select("bucket", "least"), "full")
    member = written(bucket.join(full, "bucket"), "buckets")  # both sides are written: then Spark can split hot buckets
    # of each content that shares a bucket, one row's text
    stands = some.groupBy("c1").agg(F.min("id").alias("id"), F.max("size").alias("size")).join(member.select("c1").distinct(), "c1", "left_semi")
    stands = written(some.select("c1", "id", "th").join(stands, ["c1", "id"]).groupBy("c1", "id", "size").agg(F.min("th").alias("th")), "stands")
    # texts that stand for none are not shuffled
    texts = may_be_among(keyed, "th", stands, "stands").where("stands").drop("stands")
    texts = texts.join(stands.select("id", "th", "c1"), ["id", "th"]).dropDuplicates(["c1"])
    sets = written(texts.select("c1", "text").mapInArrow(set_task, "c1 long, shingles binary"), "sets")

    def verified(units: DataFrame, task, *order) -> DataFrame:
        rows = sets.join(units, "c1")
        return written(rows.repartition("unit").sortWithinPartitions("unit", *order).mapInArrow(task, "a long, b long"), "links")

    links = verified(star_units(member), star_task(threshold), F.desc("centre"))
    labelled = written(stands.join(components(links), F.col("node") == F.col("c1"), "left").select("c1", "size", F.coalesce("label", "c1").alias("label")), "nodes")
    links = links.unionAll(verified(pair_units(member, labelled), link_task(threshold), "c1"))
    classes = components(links)
    contents = some.groupBy("c1").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    of_content = contents.join(classes, classes.node == contents.c1, "left").select("c1", "rep", "copies", F.coalesce("label", "c1").alias("class_key"))
    whole = of_content.groupBy("class_key").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    of_content = written(of_content.select("c1", "class_key").join(whole, "class_key"), "classes")  # then Spark can split the hot contents of the join
    known = some.select("id", "c1", "th").join(of_content, "c1").select("id", "class_id", "class_size", "class_key", "th")
    empty = sketches.where("size = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("long").alias("class_key"), "th")
    return known.unionAll(empty).select(*(F.nullif(F.col(c), F.lit(NO_ID)).alias(name) for c, name in (("id", id_col), ("class_id", "class_id"))), "class_size", "class_key", F.col("th").alias("text_hash"))
