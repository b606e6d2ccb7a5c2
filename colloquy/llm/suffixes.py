"""Suffix-array dedup (operator 6): sparse suffix arrays.

Only the suffixes at content-selected positions (minimisers; see anchors.py) are kept, and of these
only those whose first k words begin another such suffix too. A suffix carries its next and its
previous ``span - k`` words as 32-bit word hashes. The suffixes are sorted by their first words; in
a group of equal first words, each window of ``span`` words around a suffix is compared with all
others at the same offset, by the hash of the words before and after. Windows that two suffixes
share are repeats, and a suffix's run is the union of its own. Every repeat of ``span`` words or more holds a kept
suffix in each window of ``span`` words, so the union of the runs covers long repeats whole.

Sorting is by Spark (it spills); a task compares one block of sorted suffixes at a time. A
first-words group of more than ``HOT`` suffixes is cut by its next and, again, by its previous half
of the words needed (a window has one of the halves), and dealt by salt over tasks of about ``HOT``
suffixes. Each such part is settled by itself; one suffix for each different window of a part then
goes to a second round, where the parts of a group meet. Where a group is longer than a block, too,
one suffix for each different window goes on to its next block. So neither a task nor its memory
follows the number of copies of a passage, but that of a group's different windows.

Exact copies are one content; of those with two rows or more, the whole text is a repeat.

Defined results: a null text, or one of fewer than ``span`` words, has no repeat; a repeat inside
one text counts, overlapping too; a run's match_id is the least id of the texts it was compared
equal with (its own id if within itself); repeated rows are copies; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import NO_ID, live_anchors
from .tables import written
from .words import Words, ints, mix, slices

HOT = 4096
BLOCK = 20_000
#: salt: the part of a hot group, -1 if the suffix is in no such group.
SUFFIX = ["h", "cut", "salt", "after", "before", "doc", "rep", "pos"]
SUFFIXES = "h long, cut long, salt int, after binary, before binary, doc long, rep long, pos int"
#: Runs (h is null), and suffixes that go on to the second round (begin is null).
FOUND = f"begin int, end int, match_id long, {SUFFIXES}"


def context_task(k: int, span: int):
    """The live suffixes: first words, the words after and before (nearest first), big-endian."""
    reach = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"))
                live = part.column("live")
                counts = np.diff(live.offsets.to_numpy())
                fields = live.flatten()
                if not len(fields):
                    continue
                text = np.repeat(np.arange(len(words)), counts)
                pos = fields.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
                at = pos + words.first[text]
                low, high = words.first[text], words.first[text + 1]
                short = ((words.hashes >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)  # 0: no word

                def gathered(offsets: np.ndarray, at=at, low=low, high=high, short=short) -> np.ndarray:
                    where = at[:, None] + offsets[None, :]
                    there = (where >= low[:, None]) & (where < high[:, None])
                    return np.where(there, short[np.where(there, where, 0)], 0).astype(">u4")

                after, before = gathered(k + np.arange(reach)), gathered(-1 - np.arange(reach))
                half = -(-reach // 2)
                often = fields.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                hot = often > HOT
                h = fields.field("h").to_numpy(zero_copy_only=False)
                for side, near in ((0, after), (1, before)):
                    rows = np.flatnonzero(hot | (side == 0))
                    if not len(rows):
                        continue
                    cut = np.zeros(len(rows), np.uint64)
                    for c in range(half):
                        cut = mix(cut ^ near[rows, c].astype(np.uint64), 5 + side)
                    cut = np.where(hot[rows], ints(cut), 0)
                    docs, reps = (part.column(c).to_numpy()[text[rows]] for c in ("doc", "rep"))
                    fixed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * reach), len(rows), [None, pa.py_buffer(np.ascontiguousarray(x[rows]).tobytes())]).cast(pa.binary()) for x in (after, before)]
                    parts = -(-often[rows] // HOT)
                    salt = np.where(hot[rows], ints(mix(mix(docs.astype(np.uint64), 11) ^ pos[rows].astype(np.uint64), 12) >> np.uint64(1)) % parts, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(cut), pa.array(salt.astype(np.int32)), *fixed, pa.array(docs), pa.array(reps), pa.array(pos[rows].astype(np.int32))], names=SUFFIX)

    return run


def heads(near: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0, 1, ... words of each row, and how many leading columns hold a word."""
    codes = np.zeros((len(near), near.shape[1] + 1), np.uint64)
    for c in range(near.shape[1]):
        codes[:, c + 1] = mix(codes[:, c] ^ near[:, c].astype(np.uint64), seed)
    there = near != 0
    return codes, np.where(there.all(axis=1), near.shape[1], there.argmin(axis=1)) if near.shape[1] else np.zeros(len(near), np.int64)


def match_block(group: np.ndarray, after: np.ndarray, before: np.ndarray, doc: np.ndarray, rep: np.ndarray, pos: np.ndarray, k: int, span: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs (doc, begin, end, match_id) of the windows that two suffixes of a group share; a mask with one suffix for each different window."""
    reach = after.shape[1]
    (right, n_right), (left, n_left) = heads(after, 8), heads(before, 9)
    least, most = np.full(len(group), reach + 1), np.full(len(group), -1)  # words before the suffix, in shared windows
    match, stands = np.full(len(group), np.iinfo(np.int64).max), np.zeros(len(group), bool)
    for n in range(reach + 1):
        at = np.flatnonzero((n_left >= n) & (n_right >= reach - n))
        if not len(at):
            continue
        code = mix(left[at, n] ^ mix(right[at, reach - n] ^ mix(group[at], 21), 22), 23)
        order = np.lexsort((rep[at], code))
        at, code = at[order], code[order]
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        stands[at[begins]] = True
        sizes = np.diff(np.append(begins, len(at)))
        other = np.repeat(rep[at[begins]], sizes)
        many = begins[sizes > 1]
        other[many] = rep[at[many + 1]]
        shared = np.repeat(sizes > 1, sizes)
        at, other = at[shared], other[shared]
        least[at], most[at] = np.minimum(least[at], n), n
        match[at] = np.minimum(match[at], other)
    found = np.flatnonzero(most >= 0)
    return [doc[found], pos[found] - most[found], pos[found] - least[found] + span, match[found]], stands


def match_task(k: int, span: int):
    """Over sorted suffixes, in blocks that end where a group ends; of a larger group what stands for its windows is kept."""
    reach = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept = 0

        def edges(b: pa.RecordBatch) -> np.ndarray:
            """Mask: where a group begins, but for the first."""
            h, cut, salt = (b.column(c).to_numpy() for c in ("h", "cut", "salt"))
            return (h[1:] != h[:-1]) | (cut[1:] != cut[:-1]) | (salt[1:] != salt[:-1])

        def block(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
            doc, rep, pos = (b.column(c).to_numpy() for c in ("doc", "rep", "pos"))
            after, before = (np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(-1, reach) for c in ("after", "before"))
            group = np.concatenate([[0], np.cumsum(edges(b))])
            (d, begin, end, other), stands = match_block(group, after, before, doc, rep, pos.astype(np.int64), k, span)
            own = {"begin": pa.array(begin.astype(np.int32)), "end": pa.array(end.astype(np.int32)), "match_id": pa.array(other), "doc": pa.array(d)}
            return filled(own, len(d), b.schema), stands

        def again(b: pa.RecordBatch, stands: np.ndarray) -> pa.RecordBatch:
            """What goes on to the second round: of hot groups, what stands for their windows."""
            part = b.filter(pa.array(stands & (b.column("salt").to_numpy() >= 0)))
            return filled({n: part.column(n) for n in SUFFIX}, part.num_rows, b.schema)

        def filled(own: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
            kinds = {"begin": pa.int32(), "end": pa.int32(), "match_id": pa.int64()} | {f.name: f.type for f in schema}
            return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()], names=list(kinds))

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < max(BLOCK, 2 * kept):
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = np.flatnonzero(edges(whole))
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                runs, stands = block(whole.slice(0, at))
                yield runs
                yield again(whole.slice(0, at), stands)
                held, kept = [whole.slice(at)], 0
            else:
                runs, stands = block(whole)
                yield runs
                held, kept = [whole.filter(pa.array(stands))], int(stands.sum())
        rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        if rest:
            runs, stands = block(rest[0])
            yield runs
            yield again(rest[0], stands)

    return run


def repeated_runs(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, begin, length, match_id): the maximal runs of words of a text that repeats cover."""
    k = max(1, span // 3)
    rows, contents, texts = live_anchors(docs, k, span, False, id_col, text_col)
    suffixes = texts.select("doc", "rep", "text", "live").mapInArrow(context_task(k, span), SUFFIXES)

    def settled(rows: DataFrame, *group: str) -> DataFrame:
        return rows.repartition(*group).sortWithinPartitions(*group, "after", "doc", "pos").mapInArrow(match_task(k, span), FOUND)

    first = written(settled(suffixes, "h", "cut", "salt"), "runs")
    second = first.where("begin is null").select("h", "cut", F.lit(-1).alias("salt"), *SUFFIX[3:])
    runs = first.where("begin is not null").unionAll(settled(second, "h", "cut", "salt")).select("doc", "begin", "end", "match_id")
    runs = runs.groupBy("doc", "begin", "end").agg(F.min("match_id").alias("match_id"))
    so_far = Window.partitionBy("doc").orderBy("begin", F.desc("end"))  # of one text
    runs = runs.withColumn("reach", F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("island", F.sum(F.when(F.col("begin") <= F.col("reach"), 0).otherwise(1)).over(so_far))
    runs = runs.groupBy("doc", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("match_id").alias("match_id"))
    runs = texts.where("copies = 1").select("doc", "rep", "c1", "c2").join(runs, "doc").select(F.col("rep").alias("id"), "begin", "end", "match_id")
    copied = contents.where("copies > 1").join(rows.select("c1", "c2", "id", "n_words"), ["c1", "c2"]).where(F.col("n_words") >= span)
    other = F.when(F.col("id") == F.col("rep"), F.col("last")).otherwise(F.col("rep"))
    copied = copied.select("id", F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end"), other.alias("match_id"))
    named = [F.nullif(F.col(c), F.lit(NO_ID)).alias(n) for c, n in (("id", id_col), ("match_id", "match_id"))]
    return runs.unionAll(copied).select(named[0], F.col("begin").cast("long").alias("begin"), (F.col("end") - F.col("begin")).cast("long").alias("length"), named[1])
