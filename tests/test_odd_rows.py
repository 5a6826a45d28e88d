"""Queries against their DuckDB SQL on odd rows that the tables hold too few of."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from marlstone.plans import ORACLE_SQL, QUERIES


def against_sql(spark, folder, name, **tables):
    """What the query and its SQL make of tables (lists of dicts), sorted."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def test_norm_user_beyond_ascii(spark, tmp_path):
    texts = ["éteh x", "tehé x", "teh́ x", "x tEh", "x_teh 9teh", "ñteh,", "teh\n\tteh", "a" * 400 + " ok  　 cut" + "b" * 9, "x  ", "y \r", "  ", "", None]
    got, want = against_sql(spark, tmp_path, "norm_user", documents=[{"doc_id": i, "text": t, "lang": "es", "source": "s", "n_chars": 1} for i, t in enumerate(texts)])
    assert got == want


def test_rate_bound_between_seconds(spark, tmp_path):
    day = datetime(2024, 1, 1)
    at = [0, 0.5, 1.5, 86399.4, 86399.5, 86399.6, 86400.4, 86400.5, 86401.5, 86401.6]
    rows = [{"event_id": i, "ts": day + timedelta(seconds=s), "user_id": i % 2 if u else 7, "event_type": "view", "value": 1.0, "props": "{}"} for i, (s, u) in enumerate([(s, u) for s in at for u in (False, True)])]
    got, want = against_sql(spark, tmp_path, "rate_bound", events=rows)
    assert got == want and len(got) == 20
