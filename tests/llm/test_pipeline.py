import random
from itertools import groupby

import pytest

import corpus_pipeline
import __spark_entry__

from .conftest import SCHEMA, edge_rows, prose
from .test_duplicates import covered, groups


def corpus():
    r = random.Random(6)
    rows, passage = [], prose(77, 70)
    for i in range(160):
        if i % 8 == 0:
            text = " ".join(f"{w}!!" for w in prose(i, 60).upper().split())
        elif i % 8 == 1 and i > 8:
            words = rows[i - 8][1].split()
            words[r.randrange(len(words))] = "swapped"
            text = " ".join(words)
        else:
            text = prose(i, 90)
        if i % 8 in (3, 4):
            text = f"{text} {passage} {prose(500 + i, 20)}"
        if i % 8 == 5:
            text += " mail ob.9@mail4.example.com"
        rows.append((i, text, "en", "s", len(text)))
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {i for i, *_ in rows if i % 8 != 0}
    want = groups(sorted(kept[0].items()), 80)
    assert set(kept[1]) == {i for i in want if want[i] == i} and len(kept[1]) < len(kept[0])
    before = sorted(kept[1].items())
    for (i, t), c in zip(before, covered(before)):
        assert kept[2][i] == bytes(b for b, gone in zip(t.encode(), c) if not gone).decode()
    assert any(kept[2][i] != t for i, t in before)
    assert all(("ob.9@" in t) == ("ob.9@" in kept[2][i]) is False or "ob.9@" not in kept[3][i] for i, t in kept[2].items())
    ids = {r.doc_id for r in docs.collect()}
    assert ids == set(kept[3])
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert total.count() == docs.count() and __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_registered_queries():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


@pytest.mark.parametrize("rows", [[], edge_rows(), [(1, None, None, None, None)], [(1, "short", "en", "s", 5)], [(None, prose(1, 80), "en", "s", 5), (2, prose(1, 80), None, "s", 5)]], ids=["empty", "odd", "null", "short", "no id"])
def test_run_on_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and repeated documents and ids, ids that are missing: the pipeline ends, and what it keeps is packed whole."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {i for i, *_ in rows} and bool(got) == bool(rows)
    for (doc, _), pieces in groupby(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)), key=lambda r: (r.doc_id, 0)):
        pieces = list(pieces)
        assert all(0 < p.length <= 4096 for p in pieces)
        if sum(i == doc for i, *_ in rows) == 1:
            assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
