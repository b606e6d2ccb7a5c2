"""Benchmark decontamination (operator 10): latent semantic retrieval and sequence checks.

Texts are cut into passages of ``WIDTH`` words, every ``STRIDE`` words. Terms are the words of the
benchmark; their document frequencies are counted over all texts. Those of all other words, which a
passage's norm needs, are counted by ``BUCKETS`` hashes: words that share one can only seem more
common, which raises a cosine and never hides an item. A randomised SVD of TF-IDF
passages (one power step, then Rayleigh-Ritz on the range found, both as sums over distributed
passages and the benchmark's items) gives the latent space. It is fitted on every passage of every
text and all items, and has as many dimensions as items at least; every passage is then searched:
both its score in the latent space and its plain cosine are sums over its terms, so passages whose
terms cannot reach the threshold with any item by either are left out, and the rest are compared
with all items by both; the larger counts, so that what the space does not hold of an item loses no
copy. Candidates are checked by the longest common
subsequence of words with the passage and its surroundings, and by the same measure of the item's
answer, its last quarter.

The items are taken in blocks of about ``RANK`` items and ``BLOCK_CHARS`` characters; only a block's model is broadcast. The sums of the
tasks are added up in Spark, so the driver gets one sum a fit.

Defined results: null texts and texts or items without words match nothing; several matches of a
text and an item count once, by the best; equal items are all reported; repeated rows are reported
for each row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, ints, slices

WIDTH, STRIDE = 32, 16
RANK = 256
BLOCK_CHARS = 1 << 17
#: How many of an item's rarest words a text must hold at least, beside those that it may lack.
SURE = 4
BUCKETS = 1 << 18
#: Rows of a sum that travel together.
ROWS = 256
#: The latent space leaves out words of less weight, those that over a third of the texts hold; the plain cosine has them all.
COMMON = np.log(3) + 0.05
PREFILTER = 1 << 22


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def term_table(terms: np.ndarray) -> np.ndarray:
    """A first filter for ``find_terms``."""
    maybe = np.zeros(PREFILTER, bool)
    maybe[ints(terms) & (PREFILTER - 1)] = True
    return maybe


def find_terms(terms: np.ndarray, maybe: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h that hold terms (sorted hashes), and the terms' numbers."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.flatnonzero(maybe[ints(h) & (PREFILTER - 1)])
    at = np.minimum(np.searchsorted(terms, h[hit]), len(terms) - 1)
    good = terms[at] == h[hit]
    return hit[good], at[good]


def passages(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and end word of each passage."""
    counts = words.counts
    n = np.where(counts > 0, np.maximum(1, -(-(counts - WIDTH) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(counts)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = words.first[text] + step * STRIDE
    return text, begin, np.minimum(begin + WIDTH, words.first[text + 1])


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return (ints(hashes) >> 24) & (n - 1)


def passage_norms(words: Words, hit: np.ndarray, term: np.ndarray, idf: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and end word of each passage, and the norm of its TF-IDF; hit, term: from find_terms; rest: of other words, by bucket."""
    text, begin, end = passages(words)
    every = rest[buckets(words.hashes, len(rest))]
    every[hit] = idf[term]
    mass = np.concatenate([[0], np.cumsum(every**2)])
    return text, begin, end, np.sqrt(np.maximum(mass[end] - mass[begin], 0))


def add_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of sums."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("total"), strict=True):
            total = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
            sums[part] = sums[part] + total if part in sums else total.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "total"])


def pair_sums(hit: np.ndarray, term: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray, scale: np.ndarray, slot: np.ndarray, sign: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A S) to total (terms x slots, flat).

    A's rows are the passages, scaled; S has one entry a row, sign at slot. A pair of words that some
    passages share counts as often as these, by a difference of sums over the passages.
    """
    slots = len(total) // len(slot)
    so_far = np.concatenate([[0], np.cumsum(scale**2)])
    low, high = np.searchsorted(end, hit, side="right"), np.searchsorted(begin, hit, side="right")  # the passages of each word
    into, column, signed = term * slots, slot[term], weight * sign[term]
    at, adds = [], []
    for d in range(WIDTH):
        n = len(hit) - d
        a = np.flatnonzero(low[d:] < high[: max(n, 0)])
        if not len(a):
            break
        b = a + d
        times = so_far[high[a]] - so_far[low[b]]
        at.append(into[a] + column[b])
        adds.append((times * weight[a] * signed[b]).astype(np.float32))
        if d:
            at.append(into[b] + column[a])
            adds.append((times * weight[b] * signed[a]).astype(np.float32))
    if at:
        total += np.bincount(np.concatenate(at), weights=np.concatenate(adds), minlength=len(total))


def fit_space(texts: DataFrame, items: list[np.ndarray], terms: np.ndarray, idf: np.ndarray, rest: np.ndarray, seed: int = 11) -> np.ndarray:
    """What a passage's entry of each term adds to its latent score with each item (terms x items).

    The space is that of the leading singular vectors of all passages and items, by a randomised
    method of one pass: Y = A'A S for a random S, and A'A is about Y (S'Y)^-1 Y'. A score is the
    passage's place in the space times the item's, of length 1; both are linear in the passage, so
    the basis and the items' places are multiplied once.
    """
    spark, v = texts.sparkSession, len(terms)
    rank = min(RANK, v)
    slots = min(v, 2 * rank)
    random = np.random.default_rng(seed)
    slot, sign = random.permutation(v) % slots, random.choice([-1.0, 1.0], v)
    held = spark.sparkContext.broadcast((terms, idf, rest, slot, sign))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, rest, slot, sign = held.value
        maybe, total, n = term_table(terms), np.zeros(len(terms) * slots), 0
        spatial = idf >= COMMON
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"), folded=True)
                hit, term = find_terms(terms, maybe, words.hashes)
                _, begin, end, norm = passage_norms(words, hit, term, idf, rest)
                some = np.flatnonzero(spatial[term])
                hit, term = hit[some], term[some]
                pair_sums(hit, term, idf[term], begin, end, 1 / np.maximum(norm, 1e-9), slot, sign, total)
                n += len(begin)
        total = total.reshape(-1, slots)
        total = total.astype(np.float32)
        cut = [np.array([n], np.float32), *(total[a : a + ROWS] for a in range(0, len(total), ROWS))]  # part 0 is n
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["part", "total"])

    sums = "part int, total binary"
    found = texts.select("text").mapInArrow(run, sums).repartition("part").mapInArrow(add_task, sums).collect()  # one sum, not one a task
    parts = [np.frombuffer(p["total"], np.float64) for p in sorted(found, key=lambda p: p["part"])]
    y = np.concatenate(parts[1:]).reshape(v, slots) if parts else np.zeros((v, slots))
    plain = plain_scores(items, terms, idf).astype(np.float64) * (idf >= COMMON)[:, None]
    spread = np.zeros((v, slots))
    spread[np.arange(v), slot] = sign
    y = y + (plain @ (plain.T @ spread)) * max(1.0, (parts[0][0] if parts else 0) / max(len(items), 1))
    values, vectors = np.linalg.eigh((core := spread.T @ y) + core.T)
    kept = values > 1e-9 * max(values.max(initial=0), 1e-30)
    left, size, _ = np.linalg.svd(y @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    basis = left[:, size > 0][:, :rank]
    placed = basis.T @ plain
    return (basis @ (placed / np.maximum(np.linalg.norm(placed, axis=0), 1e-9))).astype(np.float32)


def plain_scores(items: list[np.ndarray], terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The same for the plain cosine: the items' normed TF-IDF (terms x items)."""
    out = np.zeros((len(terms), len(items)), np.float32)
    for i, x in enumerate(items):
        own = np.bincount(np.searchsorted(terms, x), minlength=len(terms)) * idf
        out[:, i] = own / max(np.linalg.norm(own), 1e-9)
    return out


def rare_terms(items: list[np.ndarray], idf: np.ndarray, overlap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the terms that count towards an item's least number of hits: where each term's items begin and how many they are, these items, and each item's number.

    A text that has the share ``overlap`` of an item's words in common with it lacks at most the
    rest, m words. So of the m + SURE rarest words it holds SURE at least (all, of a shorter item).
    """
    term, item, need = [], [], np.zeros(len(items), np.int64)
    for n, x in enumerate(items):
        lacks = len(x) - int(np.ceil(overlap * len(x) - 1e-9))
        rarest = x[np.argsort(-idf[x], kind="stable")][: lacks + SURE]
        need[n] = max(len(rarest) - lacks, 1)
        own, times = np.unique(rarest, return_counts=True)
        # a word that is there once may stand for all its places in the item
        need[n] = max(1, need[n] - int((times - 1).sum()))
        term.append(own)
        item.append(np.full(len(own), n))
    term, item = np.concatenate(term), np.concatenate(item)
    order = np.argsort(term, kind="stable")
    many = np.bincount(term, minlength=len(idf))
    return np.cumsum(many) - many, many, item[order], need


def able_pairs(words: Words, hit: np.ndarray, term: np.ndarray, begin: np.ndarray, end: np.ndarray, rare: tuple, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages and items (pairs, distinct) such that the passage, with as many words around it as the item has, holds enough of the item's rarest words."""
    low, many, rare_item, need = rare
    low, many = low[term], many[term]
    at = np.repeat(hit, many)
    item = rare_item[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    order = np.lexsort((at, item))
    at, item = at[order], item[order]
    found = [np.zeros(0, np.int64)]
    for k in np.unique(need).tolist():
        # k hits of an item within the widest window: a superset, as hits of one word count each
        first = np.flatnonzero(need[item] == k)
        last = first + k - 1
        first = first[last < len(at)]
        last = first + k - 1
        near = (item[last] == item[first]) & (at[last] - at[first] < WIDTH + 2 * sizes[item[first]])
        first, last = first[near], last[near]
        low_p = np.searchsorted(end, at[last] - sizes[item[first]], side="right")
        high_p = np.searchsorted(begin, at[first] + sizes[item[first]], side="right")
        n = np.maximum(high_p - low_p, 0)
        passage = np.repeat(low_p - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(passage * np.int64(len(sizes)) + np.repeat(item[first], n))
    pairs = np.unique(np.concatenate(found))
    return pairs // len(sizes), pairs % len(sizes)


def pair_scores(passage: np.ndarray, item: np.ndarray, hit: np.ndarray, term: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray, adds: np.ndarray) -> np.ndarray:
    """Sums of what the words of each passage add to the score with its item."""
    low, high = np.searchsorted(hit, begin[passage]), np.searchsorted(hit, end[passage])
    n = high - low
    pair = np.repeat(np.arange(len(n)), n)
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.bincount(pair, weights=weight[at] * adds[term[at], item[pair]], minlength=len(n))


def search_task(held, cosine: float, overlap: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, rest, latent, plain, items, item_ids = held.value
        maybe, sizes = term_table(terms), np.array([len(x) for x in items])
        item_terms = [np.searchsorted(terms, x) for x in items]
        rare = rare_terms(item_terms, idf, overlap)
        there = np.zeros(len(terms), bool)
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"), folded=True)
                hit, hit_terms = find_terms(terms, maybe, words.hashes)
                text, begin, end, norm = passage_norms(words, hit, hit_terms, idf, rest)
                passage, item = able_pairs(words, hit, hit_terms, begin, end, rare, sizes)
                scores = (pair_scores(passage, item, hit, hit_terms, begin, end, idf[hit_terms], x) for x in (latent, plain))
                near = np.maximum(*scores) / np.maximum(norm[passage], 1e-9)
                best: dict[tuple[int, int], tuple[float, float]] = {}
                for x in np.flatnonzero(near >= cosine).tolist():
                    p, n = int(passage[x]), int(item[x])
                    t, own = int(text[p]), items[n]
                    # the passage with what stands around it, as long as the item
                    low = max(int(words.first[t]), int(begin[p]) - len(own))
                    high = min(int(words.first[t + 1]), int(end[p]) + len(own))
                    a, b = np.searchsorted(hit, (low, high))
                    there[hit_terms[a:b]] = True
                    shared = there[item_terms[n]].sum()  # the sequence in common is no longer
                    there[hit_terms[a:b]] = False
                    if shared < overlap * len(own):
                        continue
                    around = words.hashes[low:high]
                    share = lcs(own, around) / len(own)
                    tail = own[-max(1, len(own) // 4) :]
                    if share >= overlap and lcs(tail, around) >= answer * len(tail) and share > best.get((t, n), (0.0, 0.0))[0]:
                        best[t, n] = (share, float(near[x]))
                keys = list(best)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array([k[0] for k in keys], pa.int64())), pa.array([item_ids[k[1]] for k in keys], pa.int64()), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.float64())],
                    names=["id", "item_id", "overlap", "cosine"],
                )

    return run


def frequency_task(held, others: bool):
    """How many texts hold each term (numbers from 0) and, if asked for, a word of each bucket (numbers from the number of terms); -1: how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        maybe = term_table(terms)
        size, texts = len(terms) + others * BUCKETS, 0
        counts = np.zeros(size, np.int64)
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"), folded=True)
                hit, term = find_terms(terms, maybe, words.hashes)
                text = words.text_of_word()
                seen = [(text[hit], term)] + ([(text, len(terms) + buckets(words.hashes, BUCKETS))] if others else [])
                for t, x in seen:
                    pairs = np.sort(t * np.int64(size) + x)
                    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
                    counts += np.bincount(pairs % size, minlength=size)
                texts += len(words)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], texts))], names=["term", "n"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.2, overlap: float = 0.6, answer: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id, item_id, overlap, cosine): texts that hold a benchmark item or a paraphrase of it."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    # about so many blocks that each has RANK items and BLOCK_CHARS characters at most; a longer item stands alone with what its hash brings
    size = asked.agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["items"] // RANK), -(-(size["chars"] or 0) // BLOCK_CHARS))

    def counted(terms: np.ndarray, others: bool) -> tuple[np.ndarray, int]:
        counts = np.zeros(len(terms) + others * BUCKETS)
        got = texts.mapInArrow(frequency_task(spark.sparkContext.broadcast(terms), others), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        at, n = got.column("term").to_numpy(), got.column("n").to_numpy()
        counts[at[at >= 0]] = n[at >= 0]
        return counts, int(n[at < 0].sum())

    def weights(counts: np.ndarray, of: int) -> np.ndarray:
        return np.log((of + 1) / (np.minimum(counts, of) + 1)) + 0.05

    rest = None
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id long, overlap double, cosine double"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").toArrow()
        words = Words(block.column("text").combine_chunks(), folded=True)
        kept = np.flatnonzero(words.counts > 0)
        if not len(kept):
            continue
        items = [words.hashes[words.first[i] : words.first[i + 1]] for i in kept]
        item_ids = block.column("item").to_numpy()[kept]
        terms = np.unique(words.hashes)
        counts, n_texts = counted(terms, rest is None)
        idf = weights(counts[: len(terms)], n_texts)
        rest = weights(counts[len(terms) :], n_texts) if rest is None else rest
        held = spark.sparkContext.broadcast((terms, idf, rest, fit_space(texts, items, terms, idf, rest), plain_scores(items, terms, idf), items, item_ids))
        part = texts.mapInArrow(search_task(held, cosine, overlap, answer), schema.replace(f"`{id_col}`", "id", 1))
        found = found.unionAll(part.withColumnRenamed("id", id_col))
    return found
