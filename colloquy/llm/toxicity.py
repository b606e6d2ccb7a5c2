"""Toxicity (operator 9): non-negative positive-unlabelled learning.

A linear classifier is trained with numpy on confirmed toxic texts (P) and unlabelled ones (U; labels
of 0 are not used as negatives) with the class-prior-corrected risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

(sigmoid loss; when the bracket is negative its gradient is followed upwards). A text's features are
which words it holds, and which beginnings of 4 to 7 bytes its longer words have, so that a word
counts whatever its ending. Of the features that ``LEAST`` sampled texts hold, those that tell P from U best
(chi squared) may enter; how many do is chosen among ``SIZES`` by the risk on each half of the sample
of a model of the other half. The class prior is the share of toxic rows among the labelled training rows. Training takes
at most ``most`` texts of each kind (the least keyed hashes of their ids), whole; features are
counted in the executors, and the driver gets only what the model's size bounds. Every text is
scored whole.

Defined results: null and empty texts get the score of a text without features; labels other than 1
do not confirm; several labels of an id confirm if one is 1; a null id is never learned; rows of
equal id share their label; repeated rows and equal texts get equal scores; without confirmed texts
every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import bounded_sample
from .tables import written
from .words import Words, ints, slices

PREFILTER = 1 << 20
STEMS = (4, 5, 6, 7)
LEAST = 3
SIZES = (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192)
#: A larger model may have so many times the least risk: it is judged on half of the sample, and used with all.
WIDER = 1.15


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and hash of each feature, a kind at a time: words, then beginnings of longer words; not distinct."""
    words = Words(texts, folded=True)
    text, size = words.text_of_word(), words.ends - words.starts
    yield text, words.hashes
    for n in STEMS:
        long = np.flatnonzero(size > n)
        yield text[long], words.hash_spans(words.starts[long], words.starts[long] + n, 40 + n)


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many sampled texts of P and of U each feature is."""
    for whole in batches:
        for part in slices(whole, "text"):
            p, u = (part.column(c).to_numpy(zero_copy_only=False) for c in ("p", "u"))
            for text, h in features(part.column("text")):
                order = np.lexsort((text, h))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                text, h = text[new], h[new]
                if len(h):
                    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    sums = [np.add.reduceat(x[text].astype(np.int64), begins) for x in (p, u)]
                    yield pa.RecordBatch.from_arrays([pa.array(ints(h[begins])), *map(pa.array, sums)], names=["feature", "p", "u"])


def found_features(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each chosen feature (sorted hashes) that a text holds, distinct and sorted by text."""
    maybe = np.zeros(PREFILTER, bool)
    maybe[ints(chosen) & (PREFILTER - 1)] = True
    n, pairs = np.int64(max(len(chosen), 1)), []
    for text, h in features(texts):
        hit = np.flatnonzero(maybe[ints(h) & (PREFILTER - 1)])
        at = np.minimum(np.searchsorted(chosen, h[hit]), n - 1)
        good = chosen[at] == h[hit] if len(chosen) else np.zeros(len(hit), bool)
        pairs.append(text[hit[good]] * n + at[good])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // n, pairs % n


def hits_task(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                text, at = found_features(part.column("text"), chosen)
                offsets = np.searchsorted(text, np.arange(part.num_rows + 1))
                hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("p"), part.column("u"), part.column("half"), hits], names=["p", "u", "half", "hits"])

    return run


#: Texts' features, as (text, feature) pairs, and how many texts there are.
Matrix = tuple[np.ndarray, np.ndarray, int]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(p: Matrix, u: Matrix, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the gradient to follow (weights, then bias)."""

    def scored(m: Matrix) -> np.ndarray:
        return sigmoid(np.bincount(m[0], weights=w[m[1]], minlength=m[2]) + b)

    def gradient(m: Matrix, s: np.ndarray) -> np.ndarray:
        """Of the mean score."""
        each = s * (1 - s) / max(m[2], 1)
        return np.append(np.bincount(m[1], weights=each[m[0]], minlength=len(w)), each.sum())

    sp, su = scored(p), scored(u)
    toxic, clean = prior * (1 - sp).mean(), su.mean() - prior * sp.mean()
    of_p, of_u = gradient(p, sp), gradient(u, su)
    if clean >= 0:
        return toxic + clean, of_u - 2 * prior * of_p
    return toxic, prior * of_p - of_u


def fit(p: Matrix, u: Matrix, size: int, prior: float, epochs: int, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam."""
    w, first, second = np.append(np.zeros(size), -1.0), np.zeros(size + 1), np.zeros(size + 1)
    for epoch in range(1, epochs + 1):
        grad = risk(p, u, w[:-1], w[-1], prior)[1]
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    return w[:-1], float(w[-1])


def part_of(m: Matrix, texts: np.ndarray, size: int) -> Matrix:
    """Some texts (mask), and the first ``size`` features."""
    number = np.cumsum(texts) - 1
    use = texts[m[0]] & (m[1] < size)
    return number[m[0][use]], m[1][use], int(texts.sum())


def fit_nnpu(p: Matrix, u: Matrix, half_p: np.ndarray, half_u: np.ndarray, many: int, prior: float, epochs: int = 300) -> tuple[np.ndarray, float]:
    """p, u: features are numbered by rank. Their number goes by the risk over both halves, each judged by a model of the other."""
    sizes = sorted({min(s, many) for s in SIZES})
    risks = [0.0] * len(sizes)
    for n, size in enumerate(sizes if len(sizes) > 1 else []):
        for side in (False, True):
            w, b = fit(part_of(p, half_p == side, size), part_of(u, half_u == side, size), size, prior, epochs // 3)
            risks[n] += risk(part_of(p, half_p != side, size), part_of(u, half_u != side, size), w, b, prior)[0]
    size = max(s for s, r in zip(sizes, risks, strict=True) if r <= WIDER * min(risks))
    w, b = fit(part_of(p, np.ones(p[2], bool), size), part_of(u, np.ones(u[2], bool), size), size, prior, epochs)
    return np.append(w, np.zeros(many - size)), b


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    n = len(texts)
    if model["bias"] is None:
        return np.zeros(n)
    text, at = found_features(texts, model["features"])
    weights = model["weights"][at] if len(at) else np.zeros(0)
    return sigmoid(np.bincount(text, weights=weights, minlength=n) + model["bias"])


def trained(rows: DataFrame, prior: float) -> dict:
    """The model of sampled rows (text, p, u, half)."""
    counts = rows.agg(F.sum(F.col("p").cast("long")).alias("p"), F.sum(F.col("u").cast("long")).alias("u")).first()
    if not counts["p"] or not counts["u"]:
        return {"features": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": None}
    n_p, n_u = F.lit(float(counts["p"])), F.lit(float(counts["u"]))
    mid = (F.col("p") + F.col("u")) / (n_p + n_u)
    chi = (F.col("p") / n_p - F.col("u") / n_u) ** 2 / F.greatest(mid * (1 - mid), F.lit(1e-9))
    held = rows.mapInArrow(count_task, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") + F.col("u") >= LEAST)
    ranked = np.array([r[0] for r in held.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(SIZES[-1]).collect()], np.int64).view(np.uint64)
    order = np.argsort(ranked)
    chosen = ranked[order]
    sides: dict[str, list] = {"p": [], "u": []}
    halves: dict[str, list] = {"p": [], "u": []}
    for r in rows.mapInArrow(hits_task(chosen), "p boolean, u boolean, half boolean, hits array<int>").toLocalIterator():
        for side in ("p", "u"):
            if r[side]:
                sides[side].append(order[np.array(r["hits"], np.int64)])
                halves[side].append(r["half"])

    def joined(side: list) -> Matrix:
        return np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate([*side, np.zeros(0, np.int64)]), len(side)

    w, b = fit_nnpu(joined(sides["p"]), joined(sides["u"]), np.array(halves["p"]), np.array(halves["u"]), len(ranked), prior)
    used = w[order] != 0
    return {"features": chosen[used], "weights": w[order][used], "bias": b}


def toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows (id, score). training: the rows of docs of which labels and texts may be learned."""
    spark = docs.sparkSession
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias(id_col)).agg(F.max((F.col(label_col) == 1).cast("int")).alias("mark"))
    may = training.select(F.col(id_col).alias(id_col)).where(F.col(id_col).isNotNull()).distinct().join(marks, id_col, "left")
    counts = may.agg(F.count("mark").alias("known"), F.sum("mark").alias("toxic")).first()
    prior = min(0.9, max(1e-3, (counts["toxic"] or 0) / max(counts["known"], 1)))
    # the unlabelled side is drawn from all training rows, whatever their labels
    kinds = may.select(id_col, F.lit(0).alias("kind")).unionAll(may.where("mark = 1").select(id_col, F.lit(1).alias("kind")))
    picked = bounded_sample(kinds, "kind", id_col, most).groupBy(id_col).agg(F.max(F.col("kind") == 1).alias("p"), F.max(F.col("kind") == 0).alias("u"))  # 2 x most ids at most
    rows = training.join(F.broadcast(picked), id_col).select(F.col(text_col).alias("text"), "p", "u", (F.xxhash64(F.lit(19), F.col(id_col)) % 2 == 0).alias("half"))
    held = spark.sparkContext.broadcast(trained(written(rows, "sample"), prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score_texts(part.column("text"), held.value))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
