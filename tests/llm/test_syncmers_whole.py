from equipledger.llm import syncmers


def test_long_texts_keep_all_their_anchors(spark):
    """Far more than 128 anchors, a shared passage at the far end and a repeated one."""
    def words(a, b):
        return " ".join(f"w{i}" for i in range(a, b))
    texts = {1: words(0, 3000), 2: f"{words(5000, 8000)} {words(2900, 3000)}", 3: f"{words(0, 100)} {words(0, 100)}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    by = {k: [] for k in texts}
    for r in syncmers.anchors(docs).orderBy("doc_id", "position").collect():
        by[r.doc_id].append(r.anchor)
    got = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    for k, nxt in ((1, 2), (2, 3), (3, 1)):
        a, b = set(by[k]), set(by[nxt])
        assert got[k].positions == by[k]
        assert got[k].fingerprint == "".join(f"{x:08x}" for x in sorted(a))
        assert got[k].near_next == len(a & b) / len(a | b)
    assert len(set(by[1])) > 1000 and got[1].near_next > 0 and len(by[3]) > len(set(by[3]))
