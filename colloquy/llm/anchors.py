"""Content-selected anchors of texts, and which of them occur in more than one place.

An anchor is a position whose k-gram of words has the least hash among some ``span - k + 1``
neighbouring k-grams. Every run of ``span`` words holds one, at the same offset in each of its
occurrences, so a run that repeats has a repeating (live) anchor: all other positions may be left
out without losing a repeat.

Exact copies of a text are one content; its row with the least id stands for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .words import Words, gram_positions, ints, minimisers, slices

NO_ID = -(1 << 63)
SCAN = "id bigint, c1 bigint, c2 bigint, n_words bigint, sha string, pos int, h bigint, own boolean"


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the two halves of the content's key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("c1"), F.xxhash64(F.lit(2), text).alias("c2"))


def kept_digest(words: Words, n: int, keep: np.ndarray | None = None) -> str:
    """sha256 of a text's kept words, joined by one space."""
    a, b = int(words.first[n]), int(words.first[n + 1])
    if keep is None:
        raw = words.data[words.offs[n] : words.offs[n + 1]].tobytes().split()
    else:
        at = np.flatnonzero(keep) + a
        data = words.data.data
        raw = [data[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)] if b > a else []
    return hashlib.sha256(b" ".join(raw)).hexdigest()


def anchors_of(words: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of words of the slice) and hashes of the anchors of texts of ``span`` words or more."""
    at, h = words.grams(k)
    if not len(at):
        return at, h
    full = np.full(int(words.first[-1]), np.iinfo(np.uint64).max, np.uint64)
    full[at] = h
    chosen = minimisers(full, span - k + 1)[at] if len(full) >= span - k + 1 else np.ones(len(at), bool)
    chosen &= np.repeat(words.counts, words.counts)[at] >= span
    return at[chosen], h[chosen]


def scan_task(k: int, span: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"))
                n = len(words)
                at, h = anchors_of(words, k, span)
                text = np.searchsorted(words.first, at, side="right") - 1
                order = np.lexsort((h, text))
                same = np.zeros(len(at), bool)
                twin = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
                same[order[1:][twin]] = True
                same[order[:-1][twin]] = True
                ids, c1, c2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "c1", "c2"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("c1"), part.column("c2"), pa.array(words.counts.astype(np.int64)), pa.array([kept_digest(words, i) if digest else None for i in range(n)], pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())],
                    names=["id", "c1", "c2", "n_words", "sha", "pos", "h", "own"],
                )
                m = len(at)
                id_col = part.column("id").take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [id_col, pa.array(c1[text]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array((at - words.first[text]).astype(np.int32)), pa.array(ints(h)), pa.array(same)],
                    names=["id", "c1", "c2", "n_words", "sha", "pos", "h", "own"],
                )

    return run


def live_anchors(docs: DataFrame, k: int, span: int, digest: bool, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames.

    rows: (id, c1, c2, n_words, sha) of every row; contents: (rep, c1, c2, copies) of every content;
    texts: (doc, rep, c1, text, copies, live array<struct<pos,n>>) of each content with live anchors, written,
    with a number of its own; n is how many rows have the anchor.
    """
    keyed = keyed_texts(docs, id_col, text_col)
    scan = written(keyed.mapInArrow(scan_task(k, span, digest), SCAN), "anchors")
    rows = scan.where("pos is null").select("id", "c1", "c2", "n_words", "sha")
    contents = rows.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("id").alias("last"))
    found = scan.where("pos is not null")
    often = found.groupBy("h").agg(F.min("c1").alias("least"), F.max("c1").alias("most"), F.max("own").alias("own"), F.count("*").alias("n")).where("least <> most or own").select("h", "n")
    often = written(often, "often")  # then Spark can split the hot hashes of the join
    live = found.select("id", "c1", "pos", "h").join(often, "h")
    live = live.groupBy("id", "c1").agg(F.collect_list(F.struct("pos", "n", "h")).alias("live"))  # of one document
    live = live.join(contents.select(F.col("rep").alias("id"), "c1", "c2", "copies"), ["id", "c1"])
    texts = keyed.join(live, ["id", "c1", "c2"]).dropDuplicates(["id", "c1", "c2"])
    texts = texts.select(F.monotonically_increasing_id().alias("doc"), F.col("id").alias("rep"), "c1", "c2", "text", "copies", "live")
    return rows, contents, written(texts, "texts")


def covered(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places that some [begin, end) covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def live_windows(words: Words, live: list[np.ndarray], k: int, span: int) -> list[np.ndarray]:
    """For each text, the starts of the windows of ``span`` words that hold a live anchor."""
    out = []
    for n, count in enumerate(words.counts.tolist()):
        a = live[n]
        starts = max(0, count - span + 1)
        out.append(np.flatnonzero(covered(np.clip(a - (span - k), 0, starts), np.clip(a + 1, 0, starts), starts)) if len(a) else np.zeros(0, np.int64))
    return out


def live_positions(column: pa.Array) -> list[np.ndarray]:
    """The anchors' places of each row."""
    offsets = column.offsets.to_numpy()
    pos = column.values.field("pos").to_numpy(zero_copy_only=False)
    return [pos[a:b].astype(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def valid_windows(words: Words, span: int) -> np.ndarray:
    return gram_positions(words.first, span)
