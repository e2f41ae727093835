"""Every registered query of the catalog gives the rows of its SQL."""

import duckdb
import pytest

from metroframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = plain(tuple(r[c] for c in names) for r in df.collect())
    want = plain(db.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got == want and got


def test_queries_without_sql():
    """What SQL can't say is compared with plain loops elsewhere."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"cleaned_points", "stay_points", "chunked_documents", "line_sections", "louvain_communities", "warped_trips", "built_tracks"}
