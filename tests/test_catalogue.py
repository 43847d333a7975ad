"""Each query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from siftline.plans.catalogue import QUERIES
from siftline.plans.oracle import ORACLE

DATA = Path("/root/testdata/sf0.001")


def plain(row) -> tuple:
    return tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def findings_hold(df) -> None:
    """Counts, confidences and masked examples are within what a detector can give, and no block has a category of a detector twice."""
    rows = df.collect()
    assert rows and all(r["count"] > 0 and 0 < r.confidence <= 1 and 0 < len(r.examples) <= 3 for r in rows)
    assert len({(r.block_id, r.category, r.detector) for r in rows}) == len(rows)
    assert all("*" in x for r in rows if r.category in ("email", "phone", "snils", "bank_card") for x in r.examples)


#: What queries without SQL are held to.
CONTENT = {"detect_blocks": findings_hold}


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    if name not in ORACLE:
        CONTENT[name](df)
        return
    table = duck.sql(ORACLE[name]).to_arrow_table()
    assert sorted(table.column_names) == columns
    assert got == sorted(plain(r) for r in zip(*(table.column(c).to_pylist() for c in columns), strict=True))
