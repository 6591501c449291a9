"""The pipeline against plain versions of its stages, on the smallest tables."""

import os
import sys

import pytest
from test_dedup_ops import brute_near
from test_models_and_tables import brute_lines
from test_scan_ops import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_and_run(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as P
    from algoscape.llm import line_dedup, toxicity
    from algoscape.llm.scratch import Scratch

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "test")
    rows, at = {}, docs
    for i, (name, stage) in enumerate(P.STAGES):
        before = [tuple(r[c] for c in P.COLUMNS) for r in at.collect()]
        at = scratch.save(stage(spark, at, SF), name)
        after = [tuple(r[c] for c in P.COLUMNS) for r in at.collect()]
        if i < len(P.STAGES) - 1:
            assert at.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit_tables(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
            want = [x for x in before if x[0] not in bad]
        elif name == "line_dedup":
            cut = {i: h for i, _, _, h in brute_lines([(x[0], x[1], x[3]) for x in before], line_dedup.MIN_SITES)}
            import hashlib

            assert {x[0]: hashlib.sha256((x[1] or "").encode()).hexdigest() for x in after} == cut
            assert all(x[4] == len(x[1]) for x in after)
            want = after
        elif name == "near_duplicates":
            near = brute_near([(x[0], x[1]) for x in before], 5)
            want = [x for x in before if near[x[0]][2]]
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = [x for x in before if brute(x[1], items)[1] == 0]
        else:
            want = before
        assert sorted(after, key=str) == sorted(want, key=str), name
        rows[name] = len(after)
    assert rows["toxicity"] < docs.count() and rows["mixing"] > 0
    whole = [tuple(r) for r in P.run(spark, SF).collect()]
    assert sorted(whole, key=str) == sorted([tuple(r) for r in at.select(*P.run(spark, SF).columns).collect()], key=str)


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as P

    long = " ".join(f"w{i}" for i in range(40000))
    far = 10**12  # no labels
    rows = [(None, None, None, None, None), (far + 1, "", "en", "src0", 0), (far + 2, long, "en", None, 5), (far + 2, long, "en", None, 5), (far + 3, "one two", None, "src1", None), (None, "three four", "de", "src1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(*r, "x", 9) for r in rows], schema + ", label string, id int")
    for name, stage in P.STAGES:
        got = stage(spark, odd, SF)
        assert got.count() == len(rows), name
        assert set(odd.columns) <= set(got.columns)
        assert stage(spark, odd.limit(0), SF).count() == 0, name
