"""The pipeline's stages one by one on the smallest data."""

import corpus_pipeline as pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[1] == counts[2]
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) >= counts[4]
