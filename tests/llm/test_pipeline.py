from pyspark.sql import functions as F
from test_near import slow_similar
from test_text import slow_line_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from rookery.llm import quality, secret_scan
from rookery.llm.queries import TOKENIZER


def test_pipeline_keeps_the_contract(spark, sf, docs):
    current, columns = docs, docs.columns
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf)
        assert current.columns == columns and current.dtypes == docs.dtypes, name
        current = spark.createDataFrame(current.collect(), docs.schema)
        after = {r.doc_id for r in current.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, current, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before


def test_pipeline_edges(spark, sf, odd, none):
    for docs in (odd, none):
        current = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, sf)
            assert current.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, current, sf).collect()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "sequence_id"} <= set(rows[0].asDict())


def test_stages_equal_brute_force(spark, sf, docs):
    """Each stage on what its predecessor kept: texts, ids and tokens as plain loops over all rows give them."""
    stages = dict(corpus_pipeline.STAGES)
    current = docs

    def after(name):
        rows = stages[name](spark, current, sf).collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        return rows, spark.createDataFrame(rows, docs.schema)

    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rows, current = after("quality rules")
    assert {r.doc_id for r in rows} == good and len(good) < docs.count()
    want = slow_line_dedup([(r.doc_id, r.text) for r in rows])
    rows, current = after("line dedup")
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    heads = {*slow_similar({r.doc_id: r.text for r in rows}).values()}
    before = {r.doc_id: r.text for r in rows}
    rows, current = after("near duplicates")
    assert len({r.doc_id for r in rows} ^ heads) <= 0.01 * len(before) and len(heads) < len(before)
    assert all(r.text == before[r.doc_id] for r in rows)
    current = current.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(' password = "hunter2hunter2"'))).otherwise(F.col("text")))
    before = {r.doc_id: r.text for r in current.collect()}
    rows, current = after("secret scan")
    assert {r.doc_id for r in rows} == before.keys()
    assert all(secret_scan.base_spans(r.text) == [] and r.text.count("[secret]") <= len(secret_scan.base_spans(before[r.doc_id])) + before[r.doc_id].count("[secret]") + 2 for r in rows)
    assert all(r.text.endswith('[secret]"') == (r.doc_id % 5 == 0) for r in rows)
    library = Tokenizer.from_file(TOKENIZER)
    size = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows}
    packed = stages["packing"](spark, current, sf).collect()
    sequences, lengths = {}, {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == size
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
