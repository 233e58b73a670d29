from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from pagetext.llm import queries as Q
from pagetext.llm.common import stored
from parity import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, doc_rows, no_docs):
    d, counts = docs, {}
    for name, stage in C.STAGES:
        d = stored(stage(spark, d, SF), name)
        counts[name] = d.count()
        if name != C.STAGES[-1][0]:
            assert d.columns == docs.columns
            rows = d.select("doc_id", "text").collect()
            if name == "language_id":
                assert len(rows) == len(doc_rows) - 5
            if name == "near_duplicates":
                assert not [r for r in rows if r.doc_id in range(200, 230)] and Counter(r.doc_id for r in rows)[3] == 1
            if name == "secrets":
                assert d.filter(F.col("n_chars") != F.length("text")).isEmpty() and not [r for r in rows if "deadbeefdead" in r.text]
    assert counts["secrets"] == counts["near_duplicates"] and counts["tokens"] == counts["mix"]
    texts = {r.doc_id: r for r in stored(C.STAGES[3][1](spark, docs, SF), "again").collect()}
    assert d.filter("n_tokens <> size(ids)").isEmpty() and texts
    e = no_docs
    for name, stage in C.STAGES:
        e = stored(stage(spark, e, SF), name)
        assert e.count() == 0


def test_run_and_registration(spark):
    assert {"pipeline"} | set(Q.QUERIES) <= set(entry.queries()) and len(Q.QUERIES) == 13
    rows = C.run(spark, SF).collect()
    assert rows and len({r.source for r in rows}) > 1


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    result, _, types = compare(spark, connect(SF), name, Q.QUERIES, Q.ORACLES, SF)
    assert result.startswith(("ok", "ROWS")) and types is None, (result, types)
