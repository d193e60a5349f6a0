from __future__ import annotations

import duckdb
import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    """rows: (doc_id, text) or full rows."""
    if schema == DOCS:
        rows = [(*r, "en", f"s{(r[0] or 0) % 3}", len(r[1] or "")) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(rows, schema)


def by_sql(sql: str, **tables: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


def written(spark, tmp_path, **tables):
    """A folder like the test data's, with these tables."""
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


ODD = [(1, None), (2, ""), (3, "\n"), (4, "one two three four five six seven eight nine."), (5, "one two three four five six seven eight nine."), (6, "a\tb\r\nc  d \n e"), (7, "Straße ÉCLAIR naïve ’tis don't 中文 x" * 3), (None, "no id at all here, it seems."), (None, None), (4, "one two three four five six seven eight nine."), (8, "long " * 30_000)]
