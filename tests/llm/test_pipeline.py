"""The pipeline against a brute-force version, and its registered queries."""

import glob
import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from pointloom.llm import cgk_decontam, queries, setsketch

from ..conftest import DATA
from .test_operators import SCHEMA, brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    item, passage = prose(rng, 18), prose(rng, 60)
    near = prose(rng, 150)
    rows = [(i, prose(rng, rng.randrange(20, 90)), "en", f"s{i % 4}", 5) for i in range(40)]
    rows += [(40, "12 ?!", "en", "s0", 5), (41, None, "en", "s0", 5), (42, near, "en", "s1", 5), (43, near + " more", "en", "s2", 5), (44, near, "en", "s3", 5), (44, near, "en", "s3", 5)]
    rows += [(45, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "en", None, 5), (46, f"a b {passage} c", "en", "s1", 5), (47, f"d e f {passage} {prose(rng, 70)}", "en", "s1", 5), (48, "lone words", "en", "s2", 5), (48, "lone words", "en", "s2", 5), (49, " ".join(passage.split()[:30]), "en", "s0", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        kept.append(docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    # language
    want = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert sorted((r.doc_id, r.text) for r in kept[0].collect()) == sorted((r[0], r[1]) for r in want)
    # near-dedup: the first of each component, once
    component = brute_components(want, 80)
    want = {r[0]: r for r in want if component[r[0]][1] == r[0]}
    assert sorted((r.doc_id, r.text) for r in kept[1].collect()) == sorted((i, r[1]) for i, r in want.items())
    # repeated passages
    seen, left = set(), {}
    for i in sorted(want):
        w = want[i][1].split()
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone |= set(range(k, k + 20))
            seen.add(window)
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else want[i][1]
        if text:
            left[i] = text
    assert {r.doc_id: r.text for r in kept[2].collect()} == left and 49 not in left and len(left[47]) < len(want[47][1])
    # contamination
    x = item.split()
    clean = {i: t for i, t in left.items() if min(cgk_decontam.edit_distance(x, t.split()[s : s + 18]) for s in range(max(1, len(t.split()) - 17))) > 3}
    assert {r.doc_id for r in kept[3].collect()} == set(clean) and 45 not in clean
    # packing: all bytes
    got = {}
    for r in kept[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.size
    assert got == {i: len(t.encode()) + 1 for i, t in clean.items()}


def test_language_keeps_an_unlabelled_corpus(spark):
    rows = [(1, "some words", None, "s", 5), (2, "12 ?!", None, "s", 5), (3, None, None, "s", 5), (None, "é", None, "s", 5), (2, "weitere", None, None, 5)]
    for lang in (None, "und"):  # nothing to learn from; a label that reads like the mark of no language
        docs = spark.createDataFrame([(i, t, lang, *more) for i, t, _, *more in rows], SCHEMA)
        got = corpus_pipeline.language(spark, docs, "").collect()
        assert sorted(r.text for r in got) == ["some words", "weitere", "é"]


def test_language_is_written_where_there_is_none(spark):
    rows = [(i, "the cat was there with that thing", "en", "s", 5) for i in range(20)] + [(i, "der Hund ist nicht über die Straße", "de", "s", 5) for i in range(20, 40)]
    rows += [(50, "die Straße ist nicht der Hund", None, "s", 5), (51, "that was the cat", None, "s", 5), (52, "the cat was there", "fr", "s", 5)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert len(got) == 43 and (got[50], got[51], got[52]) == ("de", "en", "fr")


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_takes_pairs_from_four_fifths_on(spark):
    rng = random.Random(33)
    rows = []
    for k in range(40):
        w = prose(rng, 150).split()
        other = list(w)
        for p in rng.sample(range(10, 140, 10), 3 + k % 2):  # similarities 0.81 and 0.76
            other[p] = "other"
        rows += [(2 * k, " ".join(w), "en", "s", 5), (2 * k + 1, " ".join(other), "en", "s", 5)]
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    component = brute_components(rows, 80)
    assert got == sorted(i for i, *_ in rows if component[i][1] == i) and len(got) == 60
    assert len({c for _, c, *_ in brute_components(rows, 85).values()}) == 80
    assert setsketch.bands(85) == (40, 8) and all((1 - (p / 100) ** r) ** n < 5e-6 for p in (75, 80, 85, 90) for n, r in [setsketch.bands(p)])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, found.fetchall()))


def test_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    small = queries.QUERIES["op8_prefix_sum_shards"](spark, DATA)
    assert small.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
