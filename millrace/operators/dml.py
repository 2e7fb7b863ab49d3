"""INSERT, UPDATE, DELETE, upsert and the checks before they are published.

Every check is a query that must find nothing; it stops at the first row. It looks at the new rows, and joins them with the
keys of the others where it has to. A change takes one job that finds the fragments with matches and one that rewrites these, however many they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.semantics import TYPES
from millrace.operators.store import ConstraintError, StoreError, Transaction


def column(name: str, kind: str, nullable: bool = True, default: str | None = None, serial: bool = False) -> dict:
    """A column's entry in the catalog; default is a SQL literal."""
    return {"id": f"c{uuid.uuid4().hex[:12]}", "name": name, "type": TYPES.get(kind.lower(), kind), "nullable": nullable, "default": default, "serial": serial}


def create_table(tx: Transaction, name: str, columns: list[dict], unique: list[list[str]] = (), checks: list[str] = (), foreign: list[dict] = ()) -> None:
    if name in tx.catalog["tables"] or name in tx.catalog["views"]:
        raise StoreError(f"{name} exists")
    if len({c["name"].lower() for c in columns}) != len(columns):
        raise StoreError("a column is named twice")
    tx.catalog["tables"][name] = {"id": f"t{uuid.uuid4().hex}", "columns": columns, "fragments": [], "unique": [list(u) for u in unique], "checks": list(checks), "foreign": list(foreign), "indexes": {}, "next": {c["name"]: 1 for c in columns if c["serial"]}}


def drop_table(tx: Transaction, name: str) -> None:
    tx.table(name)
    if any(fk["table"] == name for n, t in tx.catalog["tables"].items() if n != name for fk in t["foreign"]):
        raise ConstraintError(f"{name} is referenced by a foreign key")
    del tx.catalog["tables"][name]


def _find(table: dict, name: str) -> dict:
    for c in table["columns"]:
        if c["name"].lower() == name.lower():
            return c
    raise StoreError(f"no column {name}")


def add_column(tx: Transaction, name: str, new: dict) -> None:
    table = tx.table(name)
    if any(c["name"].lower() == new["name"].lower() for c in table["columns"]):
        raise StoreError(f"column {new['name']} exists")
    if not new["nullable"] and table["fragments"]:
        raise ConstraintError("a new column of a table with rows must be nullable")
    table["columns"].append(new)


def rename_column(tx: Transaction, name: str, old: str, new: str) -> None:
    table = tx.table(name)
    if any(c["name"].lower() == new.lower() for c in table["columns"]):
        raise StoreError(f"column {new} exists")
    found = _find(table, old)
    before, found["name"] = found["name"], new
    table["unique"] = [[new if c.lower() == before.lower() else c for c in u] for u in table["unique"]]
    for fk in table["foreign"]:
        fk["columns"] = [new if c.lower() == before.lower() else c for c in fk["columns"]]
    if before in table["next"]:
        table["next"][new] = table["next"].pop(before)


def drop_column(tx: Transaction, name: str, old: str) -> None:
    table = tx.table(name)
    found = _find(table, old)
    used = [*(c for u in table["unique"] for c in u), *(c for fk in table["foreign"] for c in fk["columns"])]
    if found["name"].lower() in map(str.lower, used):
        raise ConstraintError(f"column {old} is part of a key")
    table["columns"].remove(found)


def create_index(tx: Transaction, name: str, table: str, columns: list[str], unique: bool) -> None:
    """Metadata for the files' own statistics; a unique one is a check on write, and on the rows that are there."""
    t = tx.table(table)
    names = [_find(t, c)["name"] for c in columns]
    if any(name in x["indexes"] for x in tx.catalog["tables"].values()):
        raise StoreError(f"index {name} exists")
    t["indexes"][name] = {"columns": names, "unique": unique}
    if unique:
        t["unique"].append(names)
        _check_unique(tx, table, [names], t["fragments"])


def drop_index(tx: Transaction, name: str) -> None:
    for t in tx.catalog["tables"].values():
        if name in t["indexes"]:
            entry = t["indexes"].pop(name)
            if entry["unique"]:
                t["unique"].remove(entry["columns"])
            return
    raise StoreError(f"no index {name}")


def _refuse(df: DataFrame, message: str) -> None:
    if df.limit(1).count():
        raise ConstraintError(message)


def _check_unique(tx: Transaction, name: str, keys: list[list[str]], new: list[str]) -> None:
    """Keys of the new fragments must differ from each other and from those of the other fragments."""
    table = tx.table(name)
    others = [f for f in table["fragments"] if f not in new]
    for key in keys:
        there = " and ".join(f"`{c}` is not null" for c in key)
        rows = tx.store.read(table, new).where(there).select(*key)
        message = f"{name}: {', '.join(key)} must be unique"
        _refuse(rows.groupBy(*key).count().where("count > 1"), message)
        if others:
            _refuse(tx.store.read(table, others).where(there).select(*key).join(rows, key, "left_semi"), message)


def check_rows(tx: Transaction, name: str, rows: DataFrame, keys_changed: Callable[[list[str]], bool] = lambda _: True) -> None:
    """NOT NULL, CHECK and FOREIGN KEY of new rows."""
    table = tx.table(name)
    strict = [c["name"] for c in table["columns"] if not c["nullable"]]
    if strict:
        _refuse(rows.where(" or ".join(f"`{c}` is null" for c in strict)), f"{name}: {', '.join(strict)} must not be NULL")
    for text in table["checks"]:
        _refuse(rows.where(~F.coalesce(F.expr(text), F.lit(True))), f"{name}: CHECK ({text})")
    for fk in table["foreign"]:
        if keys_changed(fk["columns"]):
            _refuse(_orphans(rows, fk, tx.rows(fk["table"])), f"{name}: {', '.join(fk['columns'])} must exist in {fk['table']}")


def _orphans(rows: DataFrame, fk: dict, parents: DataFrame) -> DataFrame:
    keys = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(fk["columns"])]).na.drop()
    there = parents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(fk["references"])])
    return keys.join(there, [f"k{i}" for i in range(len(fk["columns"]))], "left_anti")


def _check_children(tx: Transaction, name: str, gone: DataFrame | None = None) -> None:
    """Rows of other tables that name this one must still find their row; gone are the rows that changed or went (all if None)."""
    for child, t in tx.catalog["tables"].items():
        for fk in t["foreign"]:
            if fk["table"] == name:
                rows = tx.rows(child)
                if gone is not None:
                    keys = gone.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(fk["references"])])
                    on = [F.col(c) == F.col(f"_g{i}") for i, c in enumerate(fk["columns"])]
                    rows = rows.join(keys, on, "left_semi")
                _refuse(_orphans(rows, fk, tx.rows(name)), f"{name}: rows are referenced by {child}")


def complete(tx: Transaction, name: str, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with every column of the table, in order: defaults where a column list leaves one out, numbers for SERIAL."""
    table = tx.table(name)
    all_names = [c["name"] for c in table["columns"]]
    given = [_find(table, c)["name"] for c in columns] if columns else all_names
    if len(rows.columns) != len(given):
        raise StoreError(f"{len(rows.columns)} values for {len(given)} columns")
    rows = rows.toDF(*given)
    out = []
    for c in table["columns"]:
        value = F.col(c["name"]) if c["name"] in given else F.expr(c["default"]) if c["default"] is not None else F.lit(None)
        out.append(value.try_cast(c["type"]).alias(c["name"]))
    rows = rows.select(*out)
    for c in (c for c in table["columns"] if c["serial"]):
        n, first = c["name"], table["next"][c["name"]]
        highest = rows.agg(F.max(n), F.count(F.when(F.col(n).isNull(), 1))).first()
        start = max(first, (highest[0] or 0) + 1)
        if highest[1]:
            # numbers by partition: a short sum over partitions, then within each
            marked = rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
            marked = tx.written(marked)
            sizes = {r["_p"]: r["n"] for r in marked.where(F.col(n).isNull()).groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
            at, offsets = start, {}
            for p in sorted(sizes):
                offsets[p], at = at, at + sizes[p]
            w = Window.partitionBy("_p", F.col(n).isNull()).orderBy("_m")
            base = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))])[F.col("_p")]
            rows = marked.withColumn(n, F.coalesce(F.col(n), (base + F.row_number().over(w) - 1).cast(c["type"]))).drop("_p", "_m")
            start = at
        table["next"][n] = start
    return rows


def insert(tx: Transaction, name: str, rows: DataFrame, columns: list[str] | None = None) -> None:
    _append(tx, name, complete(tx, name, rows, columns))


def _append(tx: Transaction, name: str, rows: DataFrame) -> None:
    path = tx.stage(name, rows)
    table = tx.table(name)
    table["fragments"] = [*table["fragments"], path]
    check_rows(tx, name, tx.store.read(table, [path]))
    _check_unique(tx, name, table["unique"], [path])


def _replace(tx: Transaction, name: str, touched: list[str], rows: DataFrame) -> list[str]:
    """Put rows, written as one fragment, in the place of the touched ones; the old fragments that went."""
    table = tx.table(name)
    path = tx.stage(name, rows)
    table["fragments"] = [*(f for f in table["fragments"] if f not in touched), path]
    return [path]


def update(tx: Transaction, name: str, assign: dict[str, str], where: str | None = None) -> None:
    """SET expressions see the old row."""
    table = tx.table(name)
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    new = {_find(table, c)["name"]: F.expr(e) for c, e in assign.items()}
    kinds = {c["name"]: c["type"] for c in table["columns"]}
    touched = tx.store.fragments_of(table, tx.store.read(table, places=True).alias(name).where(hit))
    if not touched:
        return
    old = tx.store.read(table, touched).alias(name)
    fresh = _replace(tx, name, touched, old.select(*[F.when(hit, new[c].try_cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in kinds]))
    _after_change(tx, name, set(new), fresh, old.where(hit))


def _after_change(tx: Transaction, name: str, columns: set[str], fresh: list[str], gone: DataFrame) -> None:
    table = tx.table(name)
    check_rows(tx, name, tx.store.read(table, fresh), lambda key: bool(columns & set(key)))
    _check_unique(tx, name, [u for u in table["unique"] if columns & set(u)], fresh)
    if any(columns & set(fk["references"]) for t in tx.catalog["tables"].values() for fk in t["foreign"] if fk["table"] == name):
        _check_children(tx, name, gone)


def _merge(tx: Transaction, name: str, hits: DataFrame, new: list[str]) -> None:
    """Give the rows named by _file and _row their values _new_<column>; only fragments with hits are rewritten."""
    table = tx.table(name)
    touched = tx.store.fragments_of(table, hits)
    if not touched:
        return
    old = tx.store.read(table, touched, places=True)
    values = hits.select(F.col("_file").alias("_f"), F.col("_row").alias("_r"), *[f"_new_{c}" for c in new])
    joined = old.join(values, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")), "left")
    out = joined.select(*[F.when(F.col("_f").isNotNull(), F.col(f"_new_{c['name']}")).otherwise(F.col(c["name"])).alias(c["name"]) if c["name"] in new else F.col(c["name"]) for c in table["columns"]])
    fresh = _replace(tx, name, touched, out)
    _after_change(tx, name, set(new), fresh, old.join(values, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")), "left_semi"))


def update_from(tx: Transaction, name: str, assign: dict[str, str], source: DataFrame, source_name: str, where: str | None) -> None:
    """UPDATE .. FROM: of several matching source rows the first in the order of all their columns counts."""
    table = tx.table(name)
    kinds = {c["name"]: c["type"] for c in table["columns"]}
    new = {_find(table, c)["name"]: e for c, e in assign.items()}
    t, s = tx.store.read(table, places=True).alias(name), source.alias(source_name)
    pairs = t.join(s, F.expr(where) if where else F.lit(True))
    order = F.struct(*[F.struct(F.col(f"{source_name}.{c}").isNull(), F.col(f"{source_name}.{c}")) for c in source.columns])
    values = F.struct(*[F.expr(e).try_cast(kinds[c]).alias(f"_new_{c}") for c, e in new.items()])
    first = pairs.groupBy("_file", "_row").agg(F.min_by(values, order).alias("_v")).select("_file", "_row", "_v.*")
    _merge(tx, name, tx.written(first), list(new))


def delete(tx: Transaction, name: str, where: str | None = None) -> None:
    table = tx.table(name)
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    touched = tx.store.fragments_of(table, tx.store.read(table, places=True).alias(name).where(hit))
    if not touched:
        return
    old = tx.store.read(table, touched).alias(name)
    _replace(tx, name, touched, old.where(~hit))
    _check_children(tx, name, old.where(hit))


def truncate(tx: Transaction, name: str) -> None:
    table = tx.table(name)
    table["fragments"] = []
    table["next"] = dict.fromkeys(table["next"], 1)
    _check_children(tx, name)


def upsert(tx: Transaction, name: str, rows: DataFrame, columns: list[str] | None, key: list[str], assign: dict[str, str] | None) -> None:
    """INSERT .. ON CONFLICT (key): DO NOTHING without assignments, else DO UPDATE on the row that is there.

    New rows with the key of a new row count as conflicts with the first of them.
    """
    table = tx.table(name)
    names = [c["name"] for c in table["columns"]]
    kinds = {c["name"]: c["type"] for c in table["columns"]}
    key = [_find(table, k)["name"] for k in key]
    new = tx.written(complete(tx, name, rows, columns))
    total = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in names])
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull()
    first = tx.written(new.withColumn("_rn", F.row_number().over(total)).where((F.col("_rn") == 1) | null_key).drop("_rn"))
    fresh = tx.written(first.join(tx.rows(name).select(*key), key, "left_anti").select(*names))
    if assign is not None:
        values = {_find(table, c)["name"]: e for c, e in assign.items()}
        there, excluded = tx.store.read(table, places=True).alias(name), first.alias("excluded")
        on = [F.col(f"{name}.{k}") == F.col(f"excluded.{k}") for k in key]
        hits = there.join(excluded, on).select("_file", "_row", *[F.expr(e).try_cast(kinds[c]).alias(f"_new_{c}") for c, e in values.items()])
        _merge(tx, name, tx.written(hits), list(values))
    _append(tx, name, fresh)
