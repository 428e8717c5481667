"""The registered queries: SQL where there is one, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import brute
import compare
import corpus_pipeline
from stockmill.llm import decontaminate, pieces, quality
from stockmill.llm.common import stored, table
from stockmill.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    expected = compare.sql_rows(compare.connect(sf_dir), ORACLE[name])
    assert compare.difference(compare.spark_rows(QUERIES[name](spark, sf_dir)), expected) == ""


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_pipeline_stages_against_plain_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(stored(stage(spark, after[-1], sf_dir), "stage"))
    rows = [sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
            for d in after]
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    good, bad = quality._compressor(model.good), quality._compressor(model.bad)
    assert rows[1] == [(d, t) for d, t in rows[0] if quality._logistic(
        model.curve, quality._difference(t.encode(), good, bad)) >= quality.KEEP_FROM]
    dropped, want = brute.repeated_lines(rows[1]), []
    for d, t in rows[1]:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dropped[d])
        if not dropped[d] or left.strip():
            want.append((d, left))
    assert rows[2] == want
    names, _ = brute.similar(rows[2])
    assert rows[3] == [(d, t) for d, t in rows[2] if names[d] == d]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    windows = decontaminate.item_windows(items, 13)
    short = {w.decode() for w in windows}

    def clean(text):
        w, hit = brute.words(text), set()
        for n in {len(s.split()) for s in short}:
            for i in range(len(w) - n + 1):
                if " ".join(w[i:i + n]) in short:
                    hit.update(range(i, i + n))
        return not hit or 20 * len(hit) < len(w)

    assert rows[4] == [(d, t) for d, t in rows[3] if clean(t)]
    assert rows[5] == rows[4]
    back = pieces.decode(after[5], pieces.load(), F.col("piece_ids")).collect()
    assert all(r.out.text == r.row.text for r in back)
    assert after[4].columns == docs.columns


def test_pipeline_keeps_odd_rows_apart(spark, make_docs, odd_rows, sf_dir):
    docs = stored(make_docs(odd_rows), "odd")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    left = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id for r in left if r.doc_id is not None)) == [1, 2, 3, 4, 6, 7, 8]
    assert sum(r.doc_id is None for r in left) == 2
