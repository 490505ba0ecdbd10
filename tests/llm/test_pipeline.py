"""The pipeline's stages one after the other, each against what it is given."""

import hashlib

import corpus_pipeline as P
from test_dedup import slow_components, slow_fingerprint, slow_removed
from veriloom.llm import decontaminate, quality
from veriloom.llm.tables import cut, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        after = cut(stage(spark, docs, SF))
        assert after.columns == columns, name
        rows = {r.doc_id: r.text for r in after.collect()}
        assert set(rows) <= set(before) and len(rows) > 0.5 * len(before), name
        if name == "quality_classifier":
            want = {r.doc_id for r in quality.classify(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
            assert set(rows) == want
        elif name == "simhash_near_dedup":
            fps = {d: slow_fingerprint(t) for d, t in before.items()}
            roots, first = slow_components(set(fps.values())), {}
            for d, f in sorted(fps.items()):
                first.setdefault(roots[f], d)
            assert set(rows) == set(first.values())
        elif name == "substring_dedup":
            told = {d: (n, lost, digest) for d, n, lost, digest in slow_removed(list(before.items()))}
            assert set(rows) == {d for d, (n, lost, _) in told.items() if lost == 0 or lost < n}
            for d, text in rows.items():
                assert (hashlib.sha256(text.encode()).hexdigest() == told[d][2]) if told[d][1] else text == before[d]
        elif name == "benchmark_decontamination":
            leaky = {r.doc_id for r in decontaminate.leaks(docs, table(spark, SF, "benchmark")).collect()}
            assert set(rows) == set(before) - leaky
        docs, before = after, rows
    mixed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(before)


def test_stages_keep_awkward_rows_in_order(spark, awkward):
    """Nulls, empty and very long texts, repeated rows and columns with the operators' own names."""
    docs = awkward.selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars", "fp", "kept as __kept", "size as __ids")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
        empty = stage(spark, docs.where("false"), SF)
        assert empty.columns == columns and empty.count() == 0, name
    assert P.STAGES[-1][1](spark, docs, SF).count() == before
