"""The queries against SQL at the smallest scale, and the pipeline stage by stage."""

import oracle_check
import pytest

import test_jaccard
import test_lines
import test_quality

import corpus_pipeline
from flowsieve.llm import decontam, jaccard
from flowsieve.llm import queries as Q
from flowsieve.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, name):
    con = oracle_check.connect(SF)
    assert oracle_check.compare(con, Q.ORACLES[name], Q.QUERIES[name](spark, SF)) == []


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_gives_its_columns(spark, name):
    df = Q.QUERIES[name](spark, SF)
    first = {"op4_chat_format": "conv_id"}.get(name, "doc_id")
    assert df.columns[0] == first and dict(df.dtypes)[first] == "bigint" and df.count() > 0


def test_pipeline_stages(spark, tables, edge):
    """Every stage keeps the columns, takes only what it should, and its decision holds in its result."""
    docs = tables("documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), "stage")
        assert docs.columns[: len(before.columns)] == before.columns
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        sizes.append(docs.count())
        if name == "line dedup":
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "near copies":
            assert jaccard.jaccard_join(docs).where("n_links > 0").count() == 0
        if name == "benchmark decontamination":
            assert decontam.leaks(docs, tables("benchmark")).count() == 0
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > sizes[4] >= sizes[5] > sizes[0] / 2
    assert docs.where("taken not in (size, 2 * size)").count() == 0


def test_pipeline_against_brute_force(spark, tables):
    """Which documents are left after each stage, and with what text, by plain loops over the rows."""
    docs = tables("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    trusted = {r["doc_id"] for r in tables("labels").where("quality = 1 and toxic = 0").collect()}
    kept = {r[0] for r in test_quality.brute(rows, trusted) if r[-1]}
    rows = [r for r in rows if str(r[0]) in kept]
    stages = [sorted(rows)]
    cleaned = [(int(i), text) for i, _, gone, text in test_lines.brute(rows) if not gone or test_lines.WORD.search(text)]
    stages.append(sorted(cleaned))
    classes = {}
    for i, c, _ in test_jaccard.brute(cleaned):
        classes[c] = min(int(i), classes.get(c, int(i)))
    stages.append(sorted(r for r in cleaned if r[0] in set(classes.values())))
    items = [r["text"] for r in tables("benchmark").collect()]
    stages.append([r for r in stages[-1] if not any(t in r[1] for t in items)])
    for expected, (name, stage) in zip(stages, corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF), "stage")
        found = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
        assert found == expected, name
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    taken = {}
    for r in mixed:
        n, target = taken.get(r["source"], (0, r["target"]))
        taken[r["source"]] = n + r["taken"], target
    longest = max(r["size"] for r in mixed)
    assert all(abs(n - target) <= longest for n, target in taken.values())


def test_pipeline_on_edge_rows(spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, edge, SF)
        assert set(edge.columns) <= set(done.columns) or name == "mixing"
        assert done.count() <= edge.count()
        assert stage(spark, nothing, SF).count() == 0
