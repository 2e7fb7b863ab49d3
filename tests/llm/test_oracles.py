"""Queries that SQL can express, against DuckDB on the same files."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from millrace.llm import mixing
from millrace.llm.queries import ORACLE_SQL, QUERIES

TABLES = {"op2_source_mixing": "documents", "op4_embedding_dedup": "embeddings", "op5_warc": "pages", "op9_minhash_near_dup": "documents"}


def compare(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view {TABLES[name]} as select * from read_parquet('{folder}/{TABLES[name]}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    got = Counter(map(tuple, df.select(*names).collect()))
    assert got == Counter(cur.fetchall())
    return got


def test_every_oracle_has_its_query():
    assert set(TABLES) == set(ORACLE_SQL) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_given_tables(spark, sf, name):
    compare(spark, sf, name)


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/raw")
    (part,) = (tmp_path / "raw").glob("*.parquet")
    part.rename(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_linked_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(150, 12)))]
    rows += [(500 + k, (np.array(rows[k % 9][1]) * 2 + rng.normal(size=12) * 0.2).tolist()) for k in range(90)]
    rows += [(700, None), (701, [0.0] * 12), (702, [float("nan")] * 12), (703, [None] * 12), (704, []), (705, rows[3][1]), (706, [1.0, 2.0]), (707, [2.0, 4.0])]
    got = compare(spark, saved(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>"), "op4_embedding_dedup")
    assert sum(n for (_, links, *_), n in got.items() if links) > 50


def documents():
    rng, rows = random.Random(9), []
    for k in range(120):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 90))]
        source = rng.choice(["b", "b", "b", "a", "Z", "é", None])
        rows.append((2 * k, " ".join(words), source))
        if k % 3 == 0:
            words[rng.randrange(len(words))] = "CHANGED"
            rows.append((2 * k + 1, ", ".join(words), rng.choice(["a", "c"])))
    return [*rows, (900, None, "a"), (901, "", "a"), (902, "!!! ...", None), (903, "!!! ...", "a"), (904, "one two\xa0three\x0bfour", "tiny"), (905, "One TWO\xa0Three four", "b")]


@pytest.mark.parametrize("name", ["op2_source_mixing", "op9_minhash_near_dup"])
def test_odd_documents(spark, tmp_path, name):
    compare(spark, saved(spark, tmp_path, "documents", documents(), "doc_id long, text string, source string"), name)


def test_bins_do_not_change_the_mix(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    first, second = (Counter(mixing.mixed_share(docs, docs_per_bin=n).collect()) for n in (1, 2000))
    assert first == second
