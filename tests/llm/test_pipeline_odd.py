"""The pipeline over nulls, empty and very long texts, repeated rows, clashing columns, and an empty table."""

import corpus_pipeline as P


def test_odd_rows_and_an_empty_table(spark, odd, nothing, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("nothing", nothing)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = P.run(spark, str(tmp_path / "odd")).collect()
    # 6 goes with 5, 12 with 11, and one of the repeated rows of 7 stays
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 7, 9, 10, 11} <= set(ids) <= {1, 2, 3, 4, 5, 7, 9, 10, 11}
    assert 6 not in ids and 12 not in ids
    assert sorted(r.mix_position for r in got) == list(range(len(got)))
    assert P.run(spark, str(tmp_path / "nothing")).count() == 0
