import tempfile
from collections import Counter

import corpus_pipeline as P
from equipledger.llm import kn_quality, pfair, pii, simhash
from equipledger.llm.common import saved

from .conftest import SF


def test_stages_compose_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = {r.doc_id for r in kn_quality.quality(docs, labels).where("keep").collect()}
    a = P.quality(spark, docs, SF)
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == keep
    a = a.cache()
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(a).collect()}
    b = P.near_duplicates(spark, a, SF).cache()
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(groups.values()))
    c = P.personal_data(spark, b, SF)
    text = {r.doc_id: r.text for r in b.collect()}
    assert {r.doc_id: r.text for r in c.collect()} == {k: pii.masked(t) for k, t in text.items()}
    assert all(not [s for s in pii.find_spans(r.text) if s[0] == "email"] for r in c.collect())
    d = P.mix(spark, c, SF)
    place = {r.doc_id: (r.mix_slot, r.mix_offset) for r in pfair.pfair_mix(c).collect()}
    got = [place[r.doc_id] for r in d.collect()]
    assert got == sorted(got) and len(got) == len(text)
    e = P.pieces(spark, d, SF)
    assert all(r.round_trip for r in e.collect())
    final = P.run(spark, SF)
    assert Counter(r.doc_id for r in final.collect()) == Counter(list(text))


def test_entry_registers_everything(spark):
    import __spark_entry__ as E
    q = E.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))


def test_the_mix_order_reaches_the_result(spark):
    """With files split and packed out of order, the result still tells the order of the mix stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"{tempfile.mkdtemp(prefix='eql-test-')}/mixed"
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pfair.mixed(docs, block_bytes=4096).write.option("maxRecordsPerFile", 17).parquet(path)
        out = P.pieces(spark, spark.read.parquet(path), SF).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    place = {r.doc_id: (r.mix_slot, r.mix_offset) for r in pfair.pfair_mix(docs, block_bytes=4096).collect()}
    assert sorted(r.mix_position for r in out) == list(range(len(place)))
    assert [r.doc_id for r in sorted(out, key=lambda r: r.mix_position)] == sorted(place, key=place.get)


def test_run_ends_in_the_order_of_the_mix(spark, monkeypatch):
    stages = []
    monkeypatch.setattr(P, "saved", lambda df, name: stages.append(saved(df, name)) or stages[-1])
    final = P.run(spark, SF).collect()
    place = {r.doc_id: (r.mix_slot, r.mix_offset) for r in pfair.pfair_mix(stages[2]).collect()}
    assert sorted(r.mix_position for r in final) == list(range(len(place)))
    assert [r.doc_id for r in sorted(final, key=lambda r: r.mix_position)] == sorted(place, key=place.get)
