"""The registered queries themselves: columns and types of their contracts, on the smallest tables."""

from pathlib import Path

import pytest

from kindred.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
ID = "doc_id bigint"
WANT = {
    "op1_media": f"{ID}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_toxicity": f"{ID}, held_out boolean, score double, predicted int",
    "op3_token_files": f"{ID}, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_pseudonyms": ID,
    "op5_pack": f"{ID}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_pieces": f"{ID}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_near_duplicates": f"{ID}, n_shingles bigint, component_id bigint, kept boolean",
    "op8_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_repeats": f"{ID}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_quality": f"{ID}, kept boolean",
    "op11_mix": f"{ID}, size bigint, source_size bigint, target double, taken bigint",
    "op12_importance": f"{ID}, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_whiten": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", WANT)
def test_contract(spark, name):
    df = queries()[name](spark, str(DATA))
    kinds = dict(df.dtypes)
    for c in WANT[name].split(", "):
        column, kind = c.split(" ")
        assert kinds[column] == kind
    if name not in ("op5_pack", "op8_nearest", "op13_whiten"):  # these give a row a piece, a query and neighbour, a vector and component
        assert df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    else:
        assert df.count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", oracle_sql())
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple((x is None, x or 0) for x in row)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_all_are_here():
    assert set(WANT) == set(queries())
