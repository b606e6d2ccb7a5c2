"""Schema versions as data, a ledger of what was applied, and the script of what would be.

A version is a list of steps up and down; a step is one statement, with a sign by which it is seen to be
done already. ``upgrade`` and ``downgrade`` run the steps that the ledger does not have, in order, and note
each one after it ran, so a run that was cut off goes on at the step where it stopped; a step that ran but
was not noted is seen to be done and only noted. ``script`` gives the same statements as text without a
session. The ledger is a log: of a step's rows the last one counts.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LEDGER = "schema_versions"


class Step(NamedTuple):
    """A statement over {db}; done: a table that is there then, or (with a minus) gone, or table.column."""

    sql: str
    done: str


class Version(NamedTuple):
    name: str
    up: list[Step]
    down: list[Step]


def _table(name: str, columns: str) -> Step:
    return Step(f"CREATE TABLE IF NOT EXISTS {{db}}.{name} ({columns}) USING parquet", name)


def _drop(name: str) -> Step:
    return Step(f"DROP TABLE IF EXISTS {{db}}.{name}", f"-{name}")


#: The stored tables, version by version.
ID, MADE = "id VARCHAR(36) NOT NULL", "created_at TIMESTAMP NOT NULL"
VERSIONS = [
    Version(
        "0001",
        [
            _table("users", f"{ID}, email VARCHAR(320) NOT NULL, password_hash VARCHAR(255) NOT NULL, {MADE}"),
            _table("conversations", f"{ID}, user_id VARCHAR(36) NOT NULL, title VARCHAR(255) NOT NULL, {MADE}"),
            _table("messages", f"{ID}, conversation_id VARCHAR(36) NOT NULL, role VARCHAR(32) NOT NULL, content STRING NOT NULL, {MADE}"),
        ],
        [_drop("messages"), _drop("conversations"), _drop("users")],
    ),
    Version(
        "0002",
        [_table("refresh_tokens", f"{ID}, user_id VARCHAR(36) NOT NULL, token_hash VARCHAR(64) NOT NULL, expires_at TIMESTAMP NOT NULL, revoked_at TIMESTAMP, {MADE}")],
        [_drop("refresh_tokens")],
    ),
    Version(
        "0003",
        [Step(f"ALTER TABLE {{db}}.users ADD COLUMNS ({name} BOOLEAN DEFAULT {value})", f"users.{name}") for name, value in (("is_active", "true"), ("is_superuser", "false"), ("is_verified", "false"))],
        [  # columns of Parquet tables can't be dropped: the table is rewritten without them
            Step("CREATE TABLE IF NOT EXISTS {db}.users_without_flags USING parquet AS SELECT id, email, password_hash, created_at FROM {db}.users", "users_without_flags"),
            Step("DROP TABLE IF EXISTS {db}.users", "-users"),
            Step("ALTER TABLE {db}.users_without_flags RENAME TO {db}.users", "-users_without_flags"),
        ],
    ),
]
HEAD = VERSIONS[-1].name


class Applied(NamedTuple):
    version: str
    direction: str
    number: int
    sql: str
    done: str

    @property
    def mark(self) -> str:
        return hashlib.sha256(self.sql.encode()).hexdigest()[:16]


def steps(direction: str, to: str) -> list[Applied]:
    """All steps up to a version, or down until it and those after it are gone, in order."""
    chosen = [v for v in VERSIONS if v.name <= to] if direction == "up" else [v for v in reversed(VERSIONS) if v.name >= to]
    return [Applied(v.name, direction, n, s.sql, s.done) for v in chosen for n, s in enumerate(v.up if direction == "up" else v.down)]


def opening(db: str) -> list[str]:
    return [f"CREATE DATABASE IF NOT EXISTS {db}", f"CREATE TABLE IF NOT EXISTS {db}.{LEDGER} (place BIGINT, version STRING, direction STRING, number INT, mark STRING, applied_at TIMESTAMP) USING parquet"]


def note(db: str, step: Applied, place: int) -> str:
    return f"INSERT INTO {db}.{LEDGER} VALUES ({place}, '{step.version}', '{step.direction}', {step.number}, '{step.mark}', current_timestamp())"


def script(db: str, direction: str = "up", to: str = HEAD, first: int = 0) -> str:
    """What a run on an empty ledger would execute, statement by statement."""
    lines = opening(db)
    for place, step in enumerate(steps(direction, to), first):
        lines += [step.sql.format(db=db), note(db, step, place)]
    return "".join(f"{line};\n" for line in lines)


def ledger(spark: SparkSession, db: str) -> dict[tuple[str, str, int], tuple[str, int]]:
    """(version, direction, number of the step) to the mark noted last, and its place in the log."""
    rows = spark.table(f"{db}.{LEDGER}").groupBy("version", "direction", "number").agg(F.max_by("mark", "place").alias("mark"), F.max("place").alias("place")).collect()
    return {(r.version, r.direction, r.number): (r.mark, r.place) for r in rows}


def is_done(spark: SparkSession, db: str, sign: str) -> bool:
    gone, name = sign.startswith("-"), sign.lstrip("-")
    table, _, column = name.partition(".")
    there = spark.catalog.tableExists(f"{db}.{table}")
    return not there if gone else there and (not column or column in spark.table(f"{db}.{table}").columns)


def run(spark: SparkSession, db: str, direction: str, to: str) -> list[str]:
    """Runs what is left of a direction's steps; returns the statements that ran, notes left out."""
    for sql in opening(db):
        spark.sql(sql)
    known = ledger(spark, db)
    place = max((p for _, p in known.values()), default=-1) + 1
    undone = {v: max((p for (w, d, _), (_, p) in known.items() if w == v and d != direction), default=-1) for v in (x.name for x in VERSIONS)}
    ran = []
    for step in steps(direction, to):
        mark, at = known.get((step.version, direction, step.number), (None, -1))
        if at > undone[step.version]:  # noted, and not taken back since
            if mark != step.mark:
                raise ValueError(f"version {step.version}, step {step.number} was applied as another statement")
            continue
        if direction == "down" and undone[step.version] < 0:
            continue  # never applied
        if not is_done(spark, db, step.done):
            spark.sql(step.sql.format(db=db))
            ran.append(step.sql.format(db=db))
        spark.sql(note(db, step, place))
        place += 1
    return ran


def upgrade(spark: SparkSession, db: str, to: str = HEAD) -> list[str]:
    return run(spark, db, "up", to)


def downgrade(spark: SparkSession, db: str, below: str) -> list[str]:
    """Takes back the version ``below`` and those after it."""
    return run(spark, db, "down", below)
