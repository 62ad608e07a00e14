"""Order-free comparison of a Spark result with DuckDB's result on the same files."""

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs; empty when columns, types and all values are equal."""
    relation = con.sql(sql)
    kinds = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    ours = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    if kinds != ours:
        both = [(c, ours.get(c), kinds.get(c)) for c in sorted({*kinds, *ours}) if ours.get(c) != kinds.get(c)]
        return [f"column {c}: spark {a}, sql {b}" for c, a, b in both]
    a = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    b = _sorted_rows(relation.columns, relation.fetchall())
    if len(a) != len(b):
        return [f"rows: spark {len(a)}, sql {len(b)}"]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return [f"{len(bad)} of {len(a)} rows differ, first: {x} / {y}" for x, y in bad[:1]]
