"""Row-for-row comparison of a Spark result with DuckDB's."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duckdb_views(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return value

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


SAME_KIND = {
    "int": "integer",
    "bigint": "integer",
    "INTEGER": "integer",
    "BIGINT": "integer",
    "HUGEINT": "huge",
    "double": "double",
    "DOUBLE": "double",
    "date": "date",
    "DATE": "date",
    "string": "string",
    "VARCHAR": "string",
    "boolean": "boolean",
    "BOOLEAN": "boolean",
}


def differences(df, connection, sql):
    """Empty if names, kinds of type and all rows agree exactly."""
    expected = connection.sql(sql)
    found = []
    kinds = {name: SAME_KIND.get(kind, kind) for name, kind in df.dtypes}
    wanted = {name: SAME_KIND.get(str(kind), str(kind)) for name, kind in zip(expected.columns, expected.types)}
    if kinds != wanted:
        found.append(f"schema {sorted(set(kinds.items()) ^ set(wanted.items()))}")
    left = _rows(df.columns, df.collect())
    right = _rows(expected.columns, expected.fetchall())
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    different = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    if different:
        found.append(f"{len(different)} rows differ, first {different[0]}")
    return found
