import uuid
from datetime import datetime

import pytest
from colloquy.operators import buckets, versions
from colloquy.plans import ledger
from pyspark.sql import functions as F


def as_of():
    return F.lit("2026-03-01 00:00:00").cast("timestamp")


def tokens(spark, n=400):
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("token_hash"), (F.col("id") % 50).alias("user_id"))
    return rows.select("*", F.lit("2026-04-01 00:00:00").cast("timestamp").alias("expires_at"), F.when(F.col("user_id") == 3, F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("revoked_at"))


@pytest.fixture
def stored(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    buckets.create(tokens(spark), name, "token_hash", 32, str(tmp_path / "t"))
    return name


def files(spark, name):
    spark.catalog.refreshTable(name)
    return {(r.bucket, r.f) for r in spark.table(name).select("bucket", F.input_file_name().alias("f")).distinct().collect()}


def same(spark, name, frame):
    key = lambda r: tuple(map(str, r))
    got = buckets.rows_of(spark, name).select(frame.columns).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, frame.collect()), key=key)


def test_revoke_touches_its_buckets_alone(spark, stored):
    before, presented = files(spark, stored), tokens(spark).where("user_id = 9").select("token_hash")
    hit = buckets.revoke(spark, stored, presented, as_of())
    assert 0 < len(hit) < 32
    after = files(spark, stored)
    assert {f for f in before if f[0] not in hit} == {f for f in after if f[0] not in hit}
    assert not {f for f in before if f[0] in hit} & after
    same(spark, stored, versions.revoked(tokens(spark), presented, as_of()))
    buckets.revoke(spark, stored, presented, as_of())  # again: the same
    same(spark, stored, versions.revoked(tokens(spark), presented, as_of()))
    assert buckets.revoke(spark, stored, presented.limit(0), as_of()) == []


def test_rotate_put_and_delete(spark, stored):
    presented = tokens(spark).where("user_id in (3, 4)").select("token_hash", F.concat(F.lit("n"), "token_hash").alias("new_token"))
    buckets.rotate(spark, stored, presented, as_of(), 7)
    want = versions.rotated(tokens(spark), presented, as_of(), 7)
    same(spark, stored, want)
    one = spark.createDataFrame([("x", 1, datetime(2026, 5, 1), None), (tokens(spark).first().token_hash, 77, datetime(2026, 5, 1), None)], want.schema)
    buckets.put(spark, stored, one)
    want = want.join(one.select("token_hash"), "token_hash", "left_anti").unionByName(one)
    same(spark, stored, want)
    buckets.delete(spark, stored, want.where("user_id < 40").select("token_hash"))
    same(spark, stored, want.where("user_id >= 40"))


def test_bucket_that_gets_empty(spark, stored):
    gone = spark.table(stored).where("bucket = 5").select("token_hash")
    gone = spark.createDataFrame(gone.collect(), gone.schema)
    assert buckets.delete(spark, stored, gone) == [5]
    assert spark.table(stored).where("bucket = 5").count() == 0
    same(spark, stored, tokens(spark).join(gone, "token_hash", "left_anti"))


def test_change_of_other_keys_is_refused(spark, stored):
    with pytest.raises(ValueError):
        buckets.changed(spark, stored, tokens(spark).limit(1), lambda rows: rows.unionByName(tokens(spark)))


def database():
    return f"chat_{uuid.uuid4().hex}"


def columns(spark, db):
    return {t.name: spark.table(f"{db}.{t.name}").columns for t in spark.catalog.listTables(db) if not t.isTemporary and t.name != ledger.LEDGER}


def test_script_equals_what_runs(spark):
    one, two = database(), database()
    ran = ledger.upgrade(spark, one)
    text = ledger.script(two)
    assert [x for x in text.replace(two, one).split(";\n") if x in ran] == ran and len(ran) == 7
    for statement in text.split(";\n")[:-1]:
        spark.sql(statement)
    assert columns(spark, one) == columns(spark, two) and len(columns(spark, one)["users"]) == 7
    assert ledger.upgrade(spark, two) == []  # the script has noted all of it


def test_interrupted_upgrade_goes_on(spark, monkeypatch):
    db, sql = database(), type(spark).sql
    seen = []

    def cut(self, text, *a, **k):
        if "is_superuser" in text or "'0002'" in text and "INSERT" in text and not seen:
            seen.append(text)
            raise RuntimeError("cut off")
        return sql(self, text, *a, **k)

    for _ in range(2):  # first after a statement ran and before it was noted, then at a statement
        with monkeypatch.context() as m:
            m.setattr(type(spark), "sql", cut)
            with pytest.raises(RuntimeError):
                ledger.upgrade(spark, db)
    assert len(seen) == 2
    rest = ledger.upgrade(spark, db)
    assert [s.split("(")[1].split()[0] for s in rest] == ["is_superuser", "is_verified"]
    whole = database()
    ledger.upgrade(spark, whole)
    assert columns(spark, db) == columns(spark, whole)


def test_down_and_up_again(spark):
    db = database()
    ledger.upgrade(spark, db)
    spark.sql(f"INSERT INTO {db}.users (id, email, password_hash, created_at) VALUES ('1', 'a@b.org', 'h', now())")
    assert len(ledger.downgrade(spark, db, "0003")) == 3 and ledger.downgrade(spark, db, "0003") == []
    assert columns(spark, db)["users"] == ["id", "email", "password_hash", "created_at"] and spark.table(f"{db}.users").count() == 1
    assert len(ledger.upgrade(spark, db)) == 3
    ledger.downgrade(spark, db, "0001")
    assert columns(spark, db) == {}
    assert len(ledger.upgrade(spark, db, "0001")) == 3


def test_changed_statement_is_refused(spark, monkeypatch):
    db = database()
    ledger.upgrade(spark, db, "0001")
    other = [ledger.VERSIONS[0]._replace(up=[ledger.Step("CREATE TABLE {db}.odd (id INT) USING parquet", "odd")]), *ledger.VERSIONS[1:]]
    monkeypatch.setattr(ledger, "VERSIONS", other)
    with pytest.raises(ValueError):
        ledger.upgrade(spark, db)
