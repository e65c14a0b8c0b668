import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from fieldglass.llm import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_take_effect_and_keep_columns(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [docs.count(), *(d.count() for d in stages)]
    assert n[0] > n[1] > n[2] == n[3] > n[4] == n[5]
    assert all(d.columns == COLUMNS for d in stages[:-1]) and stages[-1].columns == [*COLUMNS, "ids", "n_tokens"]


def test_nothing_near_and_nothing_repeated_is_left(spark, sf, stages):
    kept = [frozenset(shingles.shingles(r.text).tolist()) for r in stages[1].collect()]
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert not a or 100 * len(a & b) < 75 * len(a | b)
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (stages[1], stages[2]))
    seen, gone = {}, 0
    for i in sorted(before):
        b = before[i].encode()
        keep = np.ones(len(b), bool)
        for k in range(len(b) - 399):
            if seen.setdefault(b[k : k + 400], (i, k)) != (i, k):
                keep[k : k + 400] = False
        gone += (~keep).sum()
        assert after[i] == np.frombuffer(b, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(t in r.text for r in stages[3].collect() for t in items)


def test_run_gives_the_last_stage_and_small_tables_pass(spark, sf, stages, tmp_path):
    assert sorted(r.doc_id for r in P.run(spark, sf).select("doc_id").collect()) == sorted(r.doc_id for r in stages[-1].select("doc_id").collect())
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words here", "en", "s", 15), (3, "same words here", "en", "s", 15), (None, "null id", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in P.STAGES:
            out = stage(spark, out, sf)
        assert out.count() == (4 if rows is docs else 0)


def test_documents_of_one_id_or_none_are_kept_by_their_texts(spark, sf):
    rnd = np.random.default_rng(1)
    text = [" ".join(f"w{x}" for x in rnd.integers(0, 5000, 80)) for _ in range(8)]
    near = text[0] + " end"
    rows = [(None, text[0]), (None, near), (None, text[1]), (None, text[1]), (None, text[2]), (None, ""), (None, " "), (7, text[3]), (7, text[4]), (7, text[4]), (None, text[5]), (9, text[5]), (8, text[5] + " end"), (5, text[6]), (5, text[6] + " end"), (6, ""), (6, None), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(((r.doc_id, r.text or "", r.source) for r in P.drop_near_duplicates(spark, d, sf).collect()), key=repr) for d in (docs, docs.orderBy(F.desc("source")).repartition(3))]
    assert got[0] == got[1]
    kept = [(i, t) for i, t, _ in got[0]]
    assert len(set(kept)) == len(kept)
    one = [k for k in kept if k[1] in (text[0], near)]
    two = [k for k in kept if k[1].startswith(text[6])]
    assert len(one) == 1 and one[0][0] is None and len(two) == 1
    assert set(kept) - {*one, *two} == {(None, text[1]), (None, text[2]), (None, ""), (None, " "), (7, text[3]), (7, text[4]), (8, text[5] + " end"), (6, ""), (6, " ")}
