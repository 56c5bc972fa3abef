"""Findings on odd inputs: rows as in SQL where ids and texts are missing, blank or very long."""

from pathlib import Path

import duckdb
import pytest

from matchspark import registry
from matchspark.sources import readers


@pytest.fixture
def same(spark, sf, tmp_path):
    """Whether a query over documents of these (doc_id, text) gives SQL's rows; the other tables are the given ones."""

    def told(name, rows):
        docs = spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
        docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.stem != 'documents' else f'{tmp_path}/documents.parquet/*.parquet'}'")
        got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall(), key=repr)

    return told


BATCH = [(1, None), (7, None), (11, ""), (2, " "), (3, " "), (14, "　 "), (4, "\n"), (None, "a"), (5, "a"), (21, "b"), (22, "c"), (-7, "d")]


@pytest.mark.parametrize("name", ["read_postings_batch", "read_jsonl_pairs"])
def test_a_batch_of_odd_texts(same, name):
    """blank texts and rows without an id are counted nowhere, as in SQL."""
    same(name, BATCH)


def test_a_long_record_is_no_malformed_one(spark, tmp_path):
    """a description of over 20 million characters is valid JSON."""
    (tmp_path / "batch.json").write_text('{"external_id": "a", "source": "s", "description": "' + "x" * 20_000_001 + '"}\n')
    accepted, rejected = readers.read_postings_batch(spark, str(tmp_path / "batch.json"))
    assert (accepted.count(), rejected.count()) == (1, 0)
    assert readers.read_jsonl_pairs(spark, str(tmp_path / "batch.json"), "external_id string, source string").first() == ("a", "s")
