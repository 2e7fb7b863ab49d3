"""Statements, constraints and transactions on small tables."""

import uuid
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators.store import ConflictError, ConstraintError, StoreError
from millrace.plans.sqlfront import Engine, EnginePool, normalize


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def rows(e, sql, *args, **named):
    return sorted((tuple(r) for r in e.execute(sql, *args, **named).collect()), key=str)


def run(e, *texts):
    for t in texts:
        e.execute(t)


def test_insert_update_delete(engine):
    run(engine, "CREATE TABLE t (id INT, name VARCHAR(3), score FLOAT DEFAULT 1.5)", "INSERT INTO t VALUES (1, 'longer than three', 2.0), (2, 'it''s', NULL)", "INSERT INTO t (name, id) VALUES ('b', 3)")
    assert rows(engine, "SELECT * FROM t") == [(1, "longer than three", 2.0), (2, "it's", None), (3, "b", 1.5)]
    run(engine, "UPDATE t SET id = id + 10, name = name || '_u' WHERE score > 1", "DELETE FROM t WHERE score IS NULL")
    assert rows(engine, "SELECT id, name FROM t") == [(11, "longer than three_u"), (13, "b_u")]
    run(engine, "DELETE FROM t WHERE id = 999", "TRUNCATE TABLE t")
    assert rows(engine, "SELECT * FROM t") == []


def test_parameters_and_cache(engine):
    run(engine, "CREATE TABLE t (id INT, name TEXT)")
    put = engine.prepare("INSERT INTO t VALUES ($1, $2)")
    for k, v in ((1, "a'b"), (2, None), (3, "$1 @x")):
        put(k, v)
    assert rows(engine, "SELECT name FROM t WHERE id = $2 OR id = $1", 1, 3) == [("a'b",), ("$1 @x",)]
    assert rows(engine, "SELECT id FROM t WHERE id > @low", low=2) == [(3,)]
    with pytest.raises(StoreError):
        put(1)
    assert normalize("SELECT '$1', 'AS string (5)', CAST(x AS TEXT), CAST(y AS VARCHAR(9)) FROM t WHERE a = $1 AND b = @k") == "SELECT '$1', 'AS string (5)', TRY_CAST(x AS string), TRY_CAST(y AS string) FROM t WHERE a = :p1 AND b = :k"


def test_constraints(engine):
    run(engine, "CREATE TABLE d (id INT PRIMARY KEY, name TEXT)", "CREATE TABLE e (id SERIAL, d_id INT, age INT, CONSTRAINT c CHECK (age BETWEEN 1 AND 99), FOREIGN KEY (d_id) REFERENCES d (id))", "INSERT INTO d VALUES (1, 'x'), (2, 'y')", "INSERT INTO e (d_id, age) VALUES (1, 5), (NULL, NULL)")
    for bad in ("INSERT INTO d VALUES (1, 'again')", "INSERT INTO d VALUES (NULL, 'z')", "INSERT INTO e (d_id, age) VALUES (9, 5)", "INSERT INTO e (age) VALUES (100)", "UPDATE e SET d_id = 7 WHERE d_id = 1", "DELETE FROM d WHERE id = 1", "UPDATE d SET id = 2", "TRUNCATE d", "DROP TABLE d"):
        with pytest.raises(ConstraintError):
            engine.execute(bad)
    assert rows(engine, "SELECT id, d_id FROM e") == [(1, 1), (2, None)]
    run(engine, "DELETE FROM d WHERE id = 2", "CREATE UNIQUE INDEX u ON e (age)")
    with pytest.raises(ConstraintError):
        engine.execute("INSERT INTO e (age) VALUES (5)")
    run(engine, "DROP INDEX u", "INSERT INTO e (age) VALUES (5)")
    with pytest.raises(StoreError):
        engine.execute("DROP INDEX u")


def test_upsert(engine):
    run(engine, "CREATE TABLE t (k INT, v TEXT, n INT)", "INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2)", "INSERT INTO t VALUES (1, 'z', 9), (3, 'c', 3), (3, 'd', 4) ON CONFLICT (k) DO NOTHING")
    assert rows(engine, "SELECT * FROM t") == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    run(engine, "INSERT INTO t SELECT 2, 'new', 40 ON CONFLICT (k) DO UPDATE SET v = excluded.v, n = n + 1")
    assert rows(engine, "SELECT * FROM t WHERE k = 2") == [(2, "new", 3)]


def test_update_from_takes_the_first(engine):
    run(engine, "CREATE TABLE t (k INT, v TEXT)", "CREATE TABLE s (k INT, w TEXT)", "INSERT INTO t VALUES (1, 'a'), (2, 'b')", "INSERT INTO s VALUES (1, 'y'), (1, 'x')", "UPDATE t SET v = w FROM s WHERE t.k = s.k")
    assert rows(engine, "SELECT * FROM t") == [(1, "x"), (2, "b")]


def test_schema_changes(engine):
    run(engine, "CREATE TABLE t (a INT, b TEXT) WITH COLUMNAR", "INSERT INTO t VALUES (1, 'x')", "ALTER TABLE t ADD COLUMN c DECIMAL(10,2)", "INSERT INTO t VALUES (2, 'y', 1.5)", "ALTER TABLE t RENAME b TO d", "ALTER TABLE t DROP COLUMN a", "ALTER TABLE t ADD a TEXT")
    assert [str(v) for r in rows(engine, "SELECT d, c, a FROM t") for v in r] == ["x", "None", "None", "y", "1.50", "None"]
    with pytest.raises(StoreError):
        engine.execute("ALTER TABLE t ADD d INT")


def test_views_and_explain(engine):
    run(engine, "CREATE TABLE t (id INT, dept TEXT)", "INSERT INTO t VALUES (1, 'E'), (2, 'S'), (3, 'E')", "CREATE VIEW e AS SELECT id FROM t WHERE dept = 'E'", "CREATE VIEW big AS SELECT id FROM e WHERE id > 1")
    assert rows(engine, "SELECT * FROM e") == [(1,), (3,)] and rows(engine, "SELECT * FROM big WHERE id < 9") == [(3,)]
    assert "Scan parquet" in rows(engine, "EXPLAIN SELECT * FROM t WHERE id = 1")[0][0]
    assert rows(engine, "\\dt") == [("t",)]
    engine.execute("DROP VIEW big")
    with pytest.raises(Exception, match="big"):
        engine.execute("SELECT * FROM big")


def test_transactions(spark, tmp_path):
    one, two = (Engine(spark, f"file://{tmp_path}/s") for _ in range(2))
    run(one, "CREATE TABLE t (id INT)", "CREATE TABLE u (id INT)", "INSERT INTO t VALUES (1)", "BEGIN", "INSERT INTO t VALUES (2)")
    assert rows(one, "SELECT * FROM t") == [(1,), (2,)] and rows(two, "SELECT * FROM t") == [(1,)]
    with pytest.raises(StoreError):
        one.execute("BEGIN")
    run(two, "INSERT INTO u VALUES (7)")
    run(one, "COMMIT")
    assert rows(two, "SELECT * FROM t") == [(1,), (2,)] and rows(one, "SELECT * FROM u") == [(7,)]
    for e in (one, two):
        run(e, "BEGIN", "DELETE FROM t WHERE id = 1")
    run(one, "COMMIT")
    with pytest.raises(ConflictError):
        two.execute("COMMIT")
    run(two, "BEGIN", "DELETE FROM t")
    with pytest.raises(StoreError):
        two.execute("INSERT INTO nowhere VALUES (1)")
    run(two, "ROLLBACK")
    assert rows(two, "SELECT * FROM t") == [(2,)]
    for stray in ("COMMIT", "ROLLBACK", "GRANT x"):
        with pytest.raises(StoreError):
            two.execute(stray)


def test_duplicates_are_all_found_with_an_index(engine):
    run(engine, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (5), (5), (5)", "CREATE INDEX i ON t (id)")
    assert rows(engine, "SELECT * FROM t WHERE id = 5") == [(5,)] * 3


def test_streamed_windows_match_batch(spark, sf, tmp_path):
    from millrace.streaming.windows import windowed_counts

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    q = windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("w")) == key(windowed_counts(events))


def one(e, sql, *args):
    ((v,),) = rows(e, sql, *args)
    return v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 0", None), ("7.0 / 2", Decimal("3.5")), ("CAST(7 AS FLOAT) / 2", 3.5), ("CAST(1 AS FLOAT) / 0", None), ("MOD(5, 0)", None), ("5 % 3", 2), ("-5 % 3", -2), ("MOD(-7, CAST(2 AS FLOAT))", 1.0),
        ("2147483647 + 1", 2147483648), ("9223372036854775807 + 1", None), ("2147483647 * 2 - 1", 4294967293), ("10 - 3 - 2", 5), ("10 - (3 - 2)", 9), ("2 + 3 * 4", 14), ("(2 + 3) * 4", 20), ("100 / 10 / 3", 3), ("100 / (10 / 3)", 33),
        ("CASE WHEN 1 + 1 = 2 THEN 7 / 2 ELSE 1 - 2 END + 1", 4), ("LENGTH('é')", 2), ("TRIM('\t x\n')", "x"), ("SUBSTRING('hello', 0, 3)", None), ("SUBSTRING('hello', 2, 3)", "ell"), ("SUBSTRING('hello', 2, -1)", ""), ("CEIL(1.5)", 2.0), ("FLOOR(-1.5)", -2.0),
        (r"'a\b' LIKE 'a\b'", True), (r"'a\%' LIKE 'a\%'", True), (r"'a\xyz' LIKE 'a\%'", True), (r"'ab' LIKE 'a\%'", False), (r"'x' NOT LIKE '\%'", True), (r"LENGTH('\n')", 2), ("'it''s -- no'", "it's -- no"), ("CAST('abc' AS INT)", None), ("CAST(1 AS DATE)", date(1970, 1, 2)),
        ("CAST('2024-01-15' AS DATE)", date(2024, 1, 15)), ("CAST(60 AS TIMESTAMP)", datetime(1970, 1, 1, 0, 1)), ("CAST(CAST('99999999999' AS BIGINT) AS INT)", None), ("NULL + 1", None), ("1 - -1", 2), ("SUM(3 / 2)", 1),
    ],
)
def test_expressions_mean_what_the_dialect_says(shared, text, want):
    got = one(shared, f"SELECT {text} AS v")
    assert got == want and type(got) is type(want)


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    return Engine(spark, f"file://{tmp_path_factory.mktemp('shared')}/store")


def test_columns_divide_by_their_types(engine):
    run(engine, "CREATE TABLE t (i INT, b BIGINT, f FLOAT, d DECIMAL(10,2), CHECK (i / 2 < 50))", "INSERT INTO t VALUES (7, 2, 2, 1.5), (2147483647 / 30000000, 0, 0, NULL)")
    assert rows(engine, "SELECT i / b, i / f, i + b, -i, (SELECT max(q.i / 2) FROM t q) FROM t WHERE i / 2 >= 3") == [(3, 3.5, 9, -7, 35), (None, None, 71, -71, 35)]
    run(engine, "UPDATE t SET i = i / 2, b = b - 1 WHERE i / 2 = 3")
    assert rows(engine, "SELECT i, b FROM t") == [(3, 1), (71, 0)]
    with pytest.raises(ConstraintError):
        engine.execute("UPDATE t SET i = 101 WHERE i = 3")
    run(engine, "CREATE VIEW v AS SELECT i / 2 AS h FROM t", "DELETE FROM t WHERE i / 2 = 1")
    assert rows(engine, "SELECT h FROM v") == [(35,)]


def test_negative_and_dated_values_are_bound_whole(engine):
    run(engine, "CREATE TABLE t (id INT, v INT, d DATE, s TEXT)", "INSERT INTO t VALUES (0, 5, '2024-01-01', 'a'), (1, 5, '2024-06-01', 'b')")
    engine.prepare("UPDATE t SET v = v -$1 WHERE id > 0")(-1)
    assert rows(engine, "SELECT id, v FROM t") == [(0, 5), (1, 6)]
    engine.prepare("DELETE FROM t WHERE id = 0 -$1 AND v = 777")(-1)
    assert rows(engine, "SELECT id -$1 FROM t", -1) == [(1,), (2,)]
    engine.prepare("INSERT INTO t VALUES ($1, $2, $3, $4)")(-2, None, date(2024, 1, 1), "x' OR '1'='1 -- \\")
    assert rows(engine, "SELECT id, s FROM t WHERE d = $1", date(2024, 1, 1)) == [(-2, "x' OR '1'='1 -- \\"), (0, "a")]
    assert rows(engine, "SELECT id FROM t WHERE s = @s", s="x' OR '1'='1 -- \\") == [(-2,)]
    with pytest.raises(StoreError):
        engine.execute("SELECT $2", 1)
    with pytest.raises(StoreError):
        engine.execute("SELECT $1", object())


VALUES = st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(), st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=20), st.dates(date(1, 1, 1), date(9999, 12, 31)), st.datetimes(datetime(1, 1, 1), datetime(9999, 12, 31)), st.decimals(-(10**12), 10**12, places=3), st.binary(max_size=8))


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(VALUES, min_size=1, max_size=4))
def test_any_value_comes_back_as_it_went_in(shared, values):
    text = ", ".join(f"${k + 1} AS c{k}" for k in range(len(values)))
    (got,) = [tuple(r) for r in shared.execute(f"SELECT {text}", *values).collect()]
    for a, b in zip(got, values, strict=True):
        assert (a != a and b != b) or (bytes(a) == b if isinstance(b, bytes) else a == b)


def test_a_writer_that_dies_stops_no_one(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/s")
    run(e, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)")
    dead = Engine(spark, f"file://{tmp_path}/s")
    run(dead, "BEGIN", "INSERT INTO t VALUES (2)")
    latest = dead.store.latest()
    out = dead.store._fs.create(dead.store._path(f"{tmp_path}/s/_log/.draft"), True)  # as far as it came
    out.write(bytearray(b'{"tab'))
    out.close()
    run(e, "INSERT INTO t VALUES (3)")
    assert e.store.latest() == latest + 1 and rows(e, "SELECT * FROM t") == [(1,), (3,)]
    assert not e.store.publish(latest + 1, {}) and e.store.publish(latest + 2, e.store.catalog())
    # what the dead one left behind goes, what is named stays
    assert e.store.vacuum(keep_versions=1, older_than=0) > 0
    assert rows(e, "SELECT * FROM t") == [(1,), (3,)]
    left = [p.name for p in (tmp_path / "s").rglob("*") if p.is_dir() and p.parent.name.startswith("t")]
    assert len(left) == 2 and not any(p.name == ".draft" for p in (tmp_path / "s" / "_log").iterdir())


def jobs(spark, work):
    group = f"count-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_fragments(spark, tmp_path):
    counts = []
    for n in (2, 8):
        e = Engine(spark, f"file://{tmp_path}/s{n}")
        run(e, "CREATE TABLE t (id INT, v INT)", *(f"INSERT INTO t VALUES ({k}, 0)" for k in range(n)))
        counts.append((jobs(spark, lambda e=e: e.execute("UPDATE t SET v = 1 WHERE id < 2")), jobs(spark, lambda e=e: e.execute("DELETE FROM t WHERE id = 0"))))
        assert rows(e, "SELECT * FROM t") == [(1, 1), *((k, 0) for k in range(2, n))]
        assert not list((tmp_path / f"s{n}" / "_staging").glob("*"))
    assert counts[0] == counts[1]


def test_unique_keys_across_fragments(engine):
    run(engine, "CREATE TABLE t (a INT, b INT, UNIQUE (a, b))", "INSERT INTO t VALUES (1, 1), (1, NULL), (1, NULL)", "INSERT INTO t VALUES (2, 1)")
    for bad in ("INSERT INTO t VALUES (1, 1)", "INSERT INTO t VALUES (3, 3), (3, 3)", "UPDATE t SET a = 1 WHERE a = 2"):
        with pytest.raises(ConstraintError):
            engine.execute(bad)
    run(engine, "UPDATE t SET a = 3 WHERE a = 2")
    assert rows(engine, "SELECT a FROM t WHERE b = 1") == [(1,), (3,)]


def test_engines_are_lent_out(spark, tmp_path):
    pool = EnginePool(spark, f"file://{tmp_path}/s", 2)
    a, b = pool.acquire(), pool.acquire()
    with pytest.raises(StoreError):
        pool.acquire()
    run(a, "CREATE TABLE t (id INT)", "BEGIN", "INSERT INTO t VALUES (1)")
    pool.release(a)
    assert pool.acquire() is a and a.open is None and rows(b, "SELECT * FROM t") == []
    with pytest.raises(StoreError):
        pool.release(Engine(spark, f"file://{tmp_path}/s"))


def test_a_users_view_stays(engine):
    engine.spark.sql("SELECT 1 AS x").createOrReplaceTempView("mine")
    assert rows(engine, "SELECT x FROM mine") == [(1,)]
    run(engine, "CREATE TABLE t (id INT)")
    assert rows(engine, "SELECT x FROM mine") == [(1,)]
    engine.attach("given", lambda s: s.range(3))
    assert rows(engine, "SELECT id FROM given WHERE id > 1") == [(2,)]
