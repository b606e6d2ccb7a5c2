"""First-hit windows where one key may hold most of the hits: a key is settled by many tasks at once.

A window's first hit depends on the window before it, so windows form a chain through a key's hits. Hits
are range-partitioned by key and time; at most one key is cut by each border between ranges. For a cut key

1. every range names the *probes* that may leave it: the ends of windows that outlast its last hit;
2. every range maps the probes that come to it: from the first hit at or after the probe, pointers to the
   hit that opens the next window are doubled until they reach the last window that opens in the range,
   whose end is the next probe;
3. probes are edges between ranges; doubling them from the key's first hit finds, in as many rounds as the
   logarithm of the ranges, the window that is open where each range begins.

Then all ranges are settled independently. What goes to the driver has one row a range. A range is held by
its task (about ROWS hits); hits of one key and time that are told apart by nothing stay in one range.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .limiters import window_settle

#: Hits of a range, about.
ROWS = 1 << 20
PROBE = "chain int, part long, probe long"
EDGE = f"{PROBE}, opened long, number long, next_part long, next_probe long"


class Range(NamedTuple):
    part: int
    first_key: str
    last_key: str
    last_time: int
    begin: int  # number of its first hit among all


class Chain(NamedTuple):
    """A cut key: its ranges, and up to which time each holds hits of it (the last one: for ever)."""

    key: str
    parts: list[int]
    until: np.ndarray

    def target(self, probes: np.ndarray, after: int) -> np.ndarray:
        """The first range after this one that may hold a hit at or after each probe; -1: none."""
        at = self.parts.index(after) + 1
        found = at + np.searchsorted(self.until[at:], probes)
        return np.append(self.parts, -1)[np.minimum(found, len(self.parts))]


def ranges_of(rows: DataFrame) -> list[Range]:
    """One row a range, in order."""
    edge = F.struct("_at", "_key", "_t")
    found = rows.groupBy("_part").agg(F.min(edge).alias("a"), F.max(edge).alias("z"), F.count("*").alias("n")).orderBy("_part").collect()
    begin = np.cumsum([0, *(r.n for r in found)]).tolist()
    return [Range(r._part, r.a._key, r.z._key, r.z._t, b) for r, b in zip(found, begin, strict=False)]


def chains_of(ranges: list[Range]) -> list[Chain]:
    chains: list[Chain] = []
    for before, now in zip(ranges, ranges[1:], strict=False):
        if before.last_key != now.first_key:
            continue
        if not chains or chains[-1].key != now.first_key:
            chains.append(Chain(now.first_key, [before.part], np.zeros(0, np.int64)))
        chains[-1].parts.append(now.part)
    until = {r.part: r.last_time for r in ranges}
    return [Chain(c.key, c.parts, np.array([*(until[p] for p in c.parts[:-1]), np.iinfo(np.int64).max])) for c in chains]


def segments(rows: pa.Table, chains: list[Chain]):
    """The cut keys of a range: (number of the chain, chain, range, times, span, place of the first hit), hits sorted."""
    rows = rows.sort_by("_at")
    keys, t, span = (rows.column(c).to_numpy() for c in ("_key", "_t", "_span"))
    part = rows.column("_part")[0].as_py()
    for n, chain in enumerate(chains):
        if part in chain.parts:
            own = np.flatnonzero(keys == chain.key)
            yield n, chain, part, t[own], float(span[own[0]]), int(rows.column("_at")[int(own[0])].as_py())


def leaving(chains: list[Chain]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        for n, chain, part, t, span, _ in segments(rows, chains):
            if part == chain.parts[0]:
                found.append((np.array([n]), np.array([part]), t[:1]))  # the key's first hit opens a window
            if part != chain.parts[-1]:
                probes = np.unique(t[t + span > t[-1]] + int(span))
                found.append((np.full(len(probes), n), chain.target(probes, part), probes))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table({"chain": pa.array(columns[0], pa.int32()), "part": pa.array(columns[1], pa.int64()), "probe": pa.array(columns[2], pa.int64())})

    return run


def last_openings(t: np.ndarray, span: int) -> np.ndarray:
    """For each hit, if it opens a window, the hit that opens the last window among these."""
    then = np.searchsorted(t, t + span)
    jump = np.where(then < len(t), np.minimum(then, len(t) - 1), np.arange(len(t)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def passing(chains: list[Chain], begins: dict[int, int]):
    def run(key: tuple, rows: pa.Table, probes: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in ("chain", "part", "probe", "opened", "number", "next_part", "next_probe")}
        if len(rows) and len(probes):
            asked_chain, asked = (probes.column(c).to_numpy() for c in ("chain", "probe"))
            for n, chain, part, t, span, at in segments(rows, chains):
                probe = np.unique(asked[asked_chain == n])
                entry = np.searchsorted(t, probe)
                probe, entry = probe[entry < len(t)], entry[entry < len(t)]
                last = last_openings(t, int(span))[entry]
                then = t[last] + int(span)
                number = begins[part] + (at & ((1 << 33) - 1)) + last
                for c, x in zip(out, (np.full(len(probe), n), np.full(len(probe), part), probe, t[last], number, chain.target(then, part), then), strict=True):
                    out[c].append(x.astype(np.int64))
        return pa.table({c: pa.array(np.concatenate(x), pa.int32() if c == "chain" else pa.int64()) for c, x in out.items()})

    return run


def reached(edges: DataFrame, chains: list[Chain]) -> DataFrame:
    """The edges on the way from each key's first hit, by doubling."""
    node = ["chain", "part", "probe"]
    first = edges.sparkSession.createDataFrame([(n, int(c.parts[0])) for n, c in enumerate(chains)], "chain int, part long")
    found = edges.join(F.broadcast(first), ["chain", "part"]).groupBy("chain", "part").agg(F.min("probe").alias("probe"))
    jump = edges.where("next_part >= 0").select(*node, "next_part", "next_probe")
    for _ in range(max(1, math.ceil(math.log2(max(len(c.parts) for c in chains))))):
        further = found.join(jump, node).select("chain", F.col("next_part").alias("part"), F.col("next_probe").alias("probe"))
        found = written(found.unionByName(further).distinct(), "reached")
        then = jump.select("chain", F.col("part").alias("next_part"), F.col("probe").alias("next_probe"), F.col("next_part").alias("p"), F.col("next_probe").alias("q"))
        jump = written(jump.join(then, ["chain", "next_part", "next_probe"]).select(*node, F.col("p").alias("next_part"), F.col("q").alias("next_probe")), "jumps")
    return edges.join(found, node, "left_semi")


def open_windows(rows: DataFrame, ranges: list[Range], chains: list[Chain]) -> dict[int, tuple[int, int]]:
    """For each range that begins within a key: when the window open there opened, and the number of that hit."""
    cut = rows.where(F.col("_key").isin([c.key for c in chains])).select("_part", "_key", "_t", "_span", "_at")
    cut = cut.where(F.col("_part").isin(sorted({p for c in chains for p in c.parts})))
    probes = written(cut.groupBy("_part").applyInArrow(leaving(chains), PROBE).where("part >= 0").distinct(), "probes")
    begins = {r.part: r.begin for r in ranges}
    mapped = cut.groupBy("_part").cogroup(probes.withColumn("_part", F.col("part")).groupBy("_part")).applyInArrow(passing(chains, begins), EDGE)
    opened = reached(written(mapped, "edges"), chains).select("chain", "part", "opened", "number").collect()  # one row a range at most
    out = {}
    for n, chain in enumerate(chains):
        own = {r.part: (r.opened, r.number) for r in opened if r.chain == n}
        state = None
        for part in chain.parts:
            if state is not None:
                out[part] = state
            state = own.get(part, state)
    return out


def settle_range(carried: dict[int, tuple[int, int]], begins: dict[int, int], names: list[str]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        keys, t, limit, span = (rows.column(c).to_numpy() for c in ("_key", "_t", "_limit", "_span"))
        part = key[0].as_py()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
        allowed = np.zeros(len(t), bool)
        for a, b in zip(edges, [*edges[1:], len(t)], strict=True):
            state = None
            if a == 0 and part in carried:
                opened, number = carried[part]
                state = [opened, min(int(limit[a]), begins[part] - number)]
            allowed[a:b], _ = window_settle(t[a:b], limit[a], span[a], state)
        return rows.select(names).append_column("allowed", pa.array(allowed))

    return run


def settled_by_ranges(hits: DataFrame, keys: list[str], tie: str, parts: int | None = None) -> DataFrame:
    """hits with allowed; hits: keys, _t (long), _limit and _span (doubles, equal for a key), tie and more."""
    spark = hits.sparkSession
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), hits.count() // ROWS + 1)
    order = ["_key", "_t", tie]
    rows = hits.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "hits").withColumn("_part", F.shiftright("_at", 33))
    ranges = ranges_of(rows)
    chains = chains_of(ranges)
    carried = open_windows(rows, ranges, chains) if chains else {}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields) + ", allowed boolean"
    return rows.groupBy("_part").applyInArrow(settle_range(carried, {r.part: r.begin for r in ranges}, hits.columns), schema)
