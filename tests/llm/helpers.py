"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import duckdb

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"


def documents(spark, texts, lang="en", source="a"):
    """Documents 0, 1, 2, ... from texts, or from (text, lang, source) tuples."""
    rows = [t if isinstance(t, tuple) else (t, lang, source) for t in texts]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, (t, la, s) in enumerate(rows)], DOCS)


def collected(df, *keys):
    """Rows as dicts, sorted by the keys (nulls first)."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [(r[k] is not None, r[k]) for k in keys])


def oracle(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    rel = con.sql(sql)
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
