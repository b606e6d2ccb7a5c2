"""Alignment of two tokenizers over a corpus (operator 11).

Every text, with a space before it, is encoded by a byte-level BPE (A) and by a SentencePiece model
(B). Byte offsets where tokens of both end cut the two sequences into groups; every token of A in a
group is linked with every token of B in it. A pair of ids counts in how many documents hold it linked.

A chunk is a run of white space with what follows up to the next space or line feed. Tokens of neither
tokenizer cross a chunk's border, so groups do not either: a task aligns each distinct chunk once and
adds up documents from their chunks.

Counting: pairs are packed into one int64, a << 20 | b. ``np.unique`` counts them per task, the partial
counts are range-partitioned and sorted by key, and each range sums its runs into a shard: a file of
sorted keys and counts in the shared folder. Lookups map the shards into memory and use
``searchsorted``. A folder that cannot be mapped (no ``file:`` path) gets the same counts by a join.

Defined results: a null or empty text has no tokens, as has one whose tokens' joined bytes differ from
it (a literal U+2581 is one case): zeros and an empty groups_sha256. A null id stays null; rows of one
id are documents of their own, repeated rows included; of ties for an id's highest count all are
best; an empty table gives an empty result; other columns are ignored. A long text is taken in parts
of about a million characters cut between chunks, with the same result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder, written
from .words import Cache, slices

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BITS = 20
LOW = (1 << BITS) - 1
#: Characters of a text that are aligned at a time.
PART = 1 << 20
#: Bytes of chunks that a task remembers before it starts anew.
HELD = 96 << 20
#: Pairs of a group from which its ids are counted before they are paired.
BIG = 1 << 16
#: Keys that are counted at a time, and rows of a shard.
KEYS, SHARD = 1 << 21, 1 << 22

_ALIGNERS = Cache()


def byte_characters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what is known of the chunks seen so far."""

    def __init__(self, bpe: str, pieces: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(bpe)
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        spelled, vocabulary = byte_characters(), json.loads(bpe)["model"]["vocab"]
        self.a_bytes = [b""] * (self.a.get_vocab_size() + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(spelled[c] for c in token)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.digits = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"]
        self.space = b.piece_to_id("▁")
        ends = " \n" if not any(b"\n" in x for x in self.b_bytes if len(x) > 1) else " "
        self.unsafe, self.simple, self.cut = re.compile(rf"\s[{ends}]"), re.compile(rf"[{ends}][^{ends}]*"), re.compile(rf"(?<=\S)(?=[{ends}])")
        self.forget()

    def forget(self, least: int | None = None) -> None:
        """All chunks, or those met less than ``least`` times."""
        keep = np.flatnonzero(self.met >= least) if least else np.zeros(0, np.int64)
        names, groups = (list(self.known), self.groups) if len(keep) else ([], [])
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.groups = [groups[i] for i in keep.tolist()]
        if not len(keep):
            self.numbers = np.zeros((0, 5), np.int64)  # of a chunk: tokens of A, of B, groups, links, whether it can be told
            self.at, self.keys, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.at[keep + 1] - self.at[keep]
        take = spans(self.at[keep], size)
        self.numbers, self.met = self.numbers[keep], np.zeros(len(keep), np.int64)
        self.at, self.keys, self.times = np.concatenate([[0], np.cumsum(size)]), self.keys[take], self.times[take]
        self.held = self.bytes_of(list(self.known), self.groups, len(self.keys))

    def bytes_of(self, chunks: list[str], groups: list[str], keys: int) -> int:
        return sum(map(len, chunks)) + sum(map(len, groups)) + 16 * keys + 250 * len(chunks)

    def chunks(self, text: str) -> list[str]:
        return self.cut.split(text) if self.unsafe.search(text) else self.simple.findall(text)

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART:
            found = self.cut.search(text, at + PART)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encoded(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of both; B itself puts a space before a text, which stands for a chunk's own or has to go."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return a, [([self.space] if c == " " else ids) if c[0] == " " else ids[1:] if ids and ids[0] == self.space else [0] for c, ids in zip(chunks, b, strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Aligns new chunks. One whose tokens' bytes are not its own cannot be told."""
        sides, raw = self.encoded(chunks), [c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, told = [], np.ones(len(raw), bool)
        for i, (side, sizes, spelled) in enumerate(zip(sides, self.sizes, (self.a_bytes, self.b_bytes), strict=True)):
            flat, n = flattened(side)
            total = np.concatenate([[0], np.cumsum(sizes[flat])])
            until = np.cumsum(n)
            same = total[until] - total[until - n] == size
            if not same.all() or b"".join(map(spelled.__getitem__, flat.tolist())) != b"".join(raw):
                same &= [b"".join(map(spelled.__getitem__, x)) == r for x, r in zip(side, raw, strict=True)]
            told &= same
            ids.append((flat, n))
        for i, (flat, n) in enumerate(ids):
            ids[i] = flat if told.all() else flat[np.repeat(told, n)]
        size = np.where(told, size, 0)
        ends = [np.cumsum(sizes[x]) for sizes, x in zip(self.sizes, ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(common, e) for e in ends]
        number = [np.bincount(g, minlength=len(common)) for g in group]
        chunk = np.searchsorted(np.cumsum(size), common)  # of each group
        links = number[0] * number[1]
        key, times, owner = linked_pairs(ids, group, number, chunk)
        count = [np.bincount(chunk, weights=x, minlength=len(chunks)).astype(np.int64) for x in (*number, np.ones(len(common)), links)]
        own = self.spelled(ids, group, number, count[0] + count[1])
        for c in chunks:
            self.known[c] = len(self.known)
        self.groups += own
        self.numbers = np.concatenate([self.numbers, np.stack([*count, told.astype(np.int64)], axis=1)])
        self.met = np.concatenate([self.met, np.zeros(len(chunks), np.int64)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(owner, minlength=len(chunks)))])
        self.keys, self.times = np.concatenate([self.keys, key]), np.concatenate([self.times, times])
        self.held += self.bytes_of(chunks, own, len(key))

    def spelled(self, ids: list[np.ndarray], group: list[np.ndarray], number: list[np.ndarray], tokens: np.ndarray) -> list[str]:
        """Each chunk's groups: an id with what follows it, ``,`` within a side, ``|`` after A's and ``;`` after B's."""
        ends = [np.cumsum(n) for n in number]
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, (x, g) in enumerate(zip(ids, group, strict=True)):
            at = np.arange(len(x))
            other = ends[1][g] - number[1][g] if side == 0 else ends[0][g]
            codes[at + other] = x * 3 + np.where(at + 1 == ends[side][g], 1 + side, 0)
        words, until = list(map(self.digits.__getitem__, codes.tolist())), np.cumsum(tokens).tolist()
        return ["".join(words[i:j])[:-1] for i, j in zip([0, *until], until, strict=False)]

    def measure(self, parts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each part: numbers, groups as text; and (part, key, times) of its linked pairs, sorted."""
        if self.held > HELD:
            self.forget(2)
            if self.held > HELD // 2:
                self.forget()
        found = [self.chunks(p) for p in parts]
        fresh = [c for c in dict.fromkeys(chain.from_iterable(found)) if c not in self.known]
        if fresh:
            self.learn(fresh)
        which = [list(map(self.known.__getitem__, x)) for x in found]
        groups = [";".join(map(self.groups.__getitem__, x)) for x in which]
        flat, n = flattened(which)
        self.met += np.bincount(flat, minlength=len(self.met))
        part = np.repeat(np.arange(len(parts)), n)
        ends = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[flat], axis=0)])[np.concatenate([[0], np.cumsum(n)])]
        numbers = np.diff(ends, axis=0)
        numbers[:, 4] = numbers[:, 4] == n
        distinct, often = np.unique(part << 40 | flat, return_counts=True)
        c = distinct & ((1 << 40) - 1)
        size = self.at[c + 1] - self.at[c]
        take = spans(self.at[c], size)
        part, key, times = merged(np.repeat(distinct >> 40, size), self.keys[take], self.times[take] * np.repeat(often, size))
        return numbers, groups, part, key, times


def flattened(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and how many each list has."""
    return np.fromiter(chain.from_iterable(rows), np.int64), np.fromiter(map(len, rows), np.int64, len(rows))


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def linked_pairs(ids: list[np.ndarray], group: list[np.ndarray], number: list[np.ndarray], chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed pairs, how often each is linked, and the chunk; sorted by chunk and key."""
    partners = number[1][group[0]]
    big = number[0] * number[1] > BIG
    partners = np.where(big[group[0]], 0, partners)
    left = np.repeat(np.arange(len(ids[0])), partners)
    begin = np.cumsum(number[1]) - number[1]
    right = begin[group[0][left]] + np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)
    owner, key, times = [chunk[group[0][left]]], [ids[0][left] << BITS | ids[1][right]], [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(big).tolist():
        (a, n), (b, m) = (np.unique(x[s == g], return_counts=True) for x, s in zip(ids, group, strict=True))
        key.append((a[:, None] << BITS | b[None, :]).ravel())
        times.append((n[:, None] * m[None, :]).ravel())
        owner.append(np.full(len(a) * len(b), chunk[g]))
    owner, key, times = merged(*(np.concatenate(x) for x in (owner, key, times)))
    return key, times, owner


def merged(owner: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each owner and key, with the sum of its times, sorted."""
    packed = owner << 2 * BITS | key
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    begin = np.flatnonzero(np.diff(packed, prepend=-1))
    times = np.add.reduceat(times[order], begin) if len(begin) else times[:0]
    return packed[begin] >> 2 * BITS, packed[begin] & ((1 << 2 * BITS) - 1), times


def aligner(held, mark: str) -> Aligner:
    """The worker's own; tasks that follow each other share what is known of chunks."""
    if mark not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[mark] = Aligner(*held.value)
    return _ALIGNERS[mark]


LINKED = "id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>"


def long_text(own: Aligner, text: str) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """The same for one text, part by part."""
    sums, digest, kept = np.zeros(5, np.int64), hashlib.sha256(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    told = True
    for i, part in enumerate(own.parts(text)):
        numbers, groups, _, key, times = own.measure([part])
        sums += numbers[0]
        told &= bool(numbers[0, 4])
        digest.update((";" if i else "").encode() + groups[0].encode())
        key, times = (np.concatenate(x) for x in zip(kept[0], (key, times), strict=True))
        kept = [merged(np.zeros(len(key), np.int64), key, times)[1:]]
    return ([*sums[:4].tolist(), told], digest.hexdigest(), *kept[0])


def link_task(held, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(held, mark)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                rows = [i for i, t in enumerate(texts) if t]
                numbers, digests = np.zeros((len(texts), 5), np.int64), [""] * len(texts)
                if len(rows) == 1:
                    numbers[rows[0]], digests[rows[0]], key, times = long_text(own, " " + texts[rows[0]])
                    row = np.full(len(key), rows[0])
                elif rows:
                    numbers[rows], groups, part, key, times = own.measure([" " + texts[i] for i in rows])
                    row = np.array(rows)[part]
                    for i, g in zip(rows, groups, strict=True):
                        digests[i] = hashlib.sha256(g.encode()).hexdigest()
                else:
                    row = key = times = np.zeros(0, np.int64)
                good = numbers[:, 4] == 1
                numbers[~good] = 0
                keep = good[row]
                bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(texts)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x[keep])) for x in (key, times)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(numbers[:, i]) for i in range(4)), pa.array([d if ok else "" for d, ok in zip(digests, good, strict=True)]), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    return run


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of packed pairs; each document holds a pair once."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    parts, size = [], 0
    for batch in batches:
        parts.append(batch.column("keys").flatten().to_numpy(zero_copy_only=False))
        size += len(parts[-1])
        if size > KEYS:
            yield counted(parts)
            parts, size = [], 0
    if size:
        yield counted(parts)


def runs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of runs of equal keys in sorted rows."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
        if not len(key):
            continue
        begin = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        total = np.add.reduceat(n, begin)
        key = key[begin]
        if len(keys[-1]) and keys[-1][-1] == key[0]:
            counts[-1][-1] += total[0]
            key, total = key[1:], total[1:]
        keys.append(key)
        counts.append(total)
    return np.concatenate(keys), np.concatenate(counts)


def shard_task(folder: str):
    """Writes a range's shard; a row says where it is and the highest count of each id of A in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = runs(batches)
        if not len(key):
            return
        path = f"{folder}/{int(key[0])}-{len(key)}.npy"
        part = f"{path}.{uuid.uuid4().hex}"  # a task that is run again replaces the file by its equal
        with open(part, "wb") as out:
            np.save(out, np.stack([key, n]))
        os.replace(part, path)
        begin = np.flatnonzero(np.diff(key >> BITS, prepend=-1))
        lists = [pa.array([x], pa.list_(pa.int64())) for x in ((key >> BITS)[begin], np.maximum.reduceat(n, begin))]
        yield pa.RecordBatch.from_arrays([pa.array([int(key[0])]), pa.array([path]), *lists], names=["first", "path", "a", "most"])

    return run


class Shards:
    """Sorted shards, mapped when first used."""

    def __init__(self, where: list[tuple[int, str]]) -> None:
        self.first, self.paths, self.open = np.array([f for f, _ in where], np.int64), [p for _, p in where], {}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(distinct), np.int64)
        bounds = np.append(np.searchsorted(distinct, self.first), len(distinct))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            if i not in self.open:
                self.open[i] = np.load(self.paths[i], mmap_mode="r")
            key, n = self.open[i]
            asked = slice(bounds[i], bounds[i + 1])
            found[asked] = n[np.searchsorted(key, distinct[asked])]
        return found[back]


def lookup_task(where: list[tuple[int, str]], most):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, highest = Shards(where), most.value
        for batch in batches:
            keys, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "times"))
            size = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size)])
            n = shards.counts(keys)
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * (n == highest[keys >> BITS]), times * n)]
            names = [c for c in batch.schema.names if c not in ("keys", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(np.diff(s)) for s in sums)], names=[*names, "n_best", "count_sum"])

    return run


class Alignment(NamedTuple):
    """documents: a row for each; pairs: (a_id, b_id, n_docs, best), a row for each pair of ids ever linked."""

    documents: DataFrame
    pairs: DataFrame


def mapped_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that tasks can map files from."""
    where = urlparse(shared_folder(spark))
    return where.path.rstrip("/") if where.scheme == "file" else None


def by_shards(spark: SparkSession, linked: DataFrame, counts: DataFrame, folder: str) -> DataFrame:
    folder = f"{folder}/shards-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    rows = counts.mapInArrow(shard_task(folder), "first long, path string, a array<long>, most array<long>")
    shards = written(rows, "shards")
    where = [(r.first, r.path) for r in shards.select("first", "path").orderBy("first").collect()]  # one row a range
    best = shards.select(F.explode(F.arrays_zip("a", "most")).alias("x")).groupBy("x.a").agg(F.max("x.most").alias("most")).toPandas()
    most = np.zeros(1 << BITS, np.int64)  # at most one entry for each id of a vocabulary, 8 MB
    most[best["a"].to_numpy(np.int64)] = best["most"].to_numpy(np.int64)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.schema if f.name not in ("keys", "times"))
    return linked.mapInArrow(lookup_task(where, spark.sparkContext.broadcast(most)), f"{kind}, n_best long, count_sum long")


def by_join(linked: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = written(linked.withColumn("row", F.monotonically_increasing_id()), "linked")
    links = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", "x.keys", "x.times")
    sums = links.join(pairs, F.col("keys") == F.col("key")).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("keys", "times").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])


def align_tokens(docs: DataFrame, bpe_path: str = BYTE_BPE, piece_path: str = PIECES, id_col: str = "doc_id", text_col: str = "text", mapped: bool = True) -> Alignment:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the counts of all pairs."""
    spark = docs.sparkSession
    with open(bpe_path, encoding="utf-8") as bpe, open(piece_path, "rb") as pieces:
        both = bpe.read(), pieces.read()
    held = spark.sparkContext.broadcast(both)  # two vocabularies, of fixed size
    mark = hashlib.sha256(both[0].encode() + both[1]).hexdigest()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    linked = written(rows.mapInArrow(link_task(held, mark), LINKED.format(kind=kind)), "linked")
    partial = written(linked.select("keys").mapInArrow(count_task, "key long, n long"), "partial")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partial.count() // SHARD + 1)
    counts = partial.repartitionByRange(ranges, "key").sortWithinPartitions("key")

    summed = partial.groupBy("key").agg(F.sum("n").alias("n"))
    a = F.shiftright("key", BITS)
    highest = summed.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    pairs = summed.join(highest, a == F.col("a")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    folder = mapped_folder(spark) if mapped else None
    found = by_shards(spark, linked, counts, folder) if folder else by_join(linked, pairs)
    named = pairs.select(F.shiftright("key", BITS).cast("int").alias("a_id"), F.col("key").bitwiseAND(LOW).cast("int").alias("b_id"), F.col("n").alias("n_docs"), "best")
    return Alignment(found.withColumnRenamed("id", id_col).select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), named)
