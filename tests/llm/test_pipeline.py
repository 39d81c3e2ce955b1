"""The pipeline's stages and run(), against what the operators' brute-force tests establish."""

import hashlib
from collections import Counter

import corpus_pipeline as P
from tests.llm.test_operators import classes


def test_stages_and_run(spark, tmp_path, rows):
    from tests.llm.conftest import SCHEMA

    made = [r for r in rows if r[1] is None or r[0] not in (10, 11)] + [(90, "write to bosbt.42@mail8.example.com about the river and the stone in the garden", "en", "b", 1)]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert docs.columns == columns
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    assert ids("language_id") == {r[0] for r in made} - {4, 5, 14}
    texts = [(r["doc_id"], r["text"]) for r in kept["language_id"]]
    assert ids("near_dedup") == set(classes(texts).values())
    private = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert "bosbt.42" not in private[90] and "@mail8.example.com" in private[90]
    assert all(private[r["doc_id"]] == r["text"] for r in kept["near_dedup"] if r["doc_id"] != 90)
    assert ids("mixing") <= ids("near_dedup") and len(kept["byte_bpe"]) == len(kept["mixing"])
    for r in kept["byte_bpe"]:
        assert r["decoded_sha256"] == hashlib.sha256(private[r["doc_id"]].encode()).hexdigest()
    whole = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, kept["byte_bpe"]))


def test_null_repeated_and_conflicting_ids(spark, tmp_path):
    from tests.llm.conftest import SCHEMA, prose

    t = [prose(500 + i, 60) for i in range(6)]
    made = [(None, t[0], "en", "a", 1)] * 2 + [(None, t[1], "en", "a", 1)] + [(7, t[2], "en", "a", 1)] * 4 + [(8, t[3], "en", "a", 1), (9, t[3], "en", "a", 1), (9, t[4], "en", "a", 1), (5, t[5], "en", "a", 1), (None, t[5], "en", "a", 1)]
    rest = [(100 + i, prose(700 + i, 400), "en", "b", 1) for i in range(12)]
    docs = spark.createDataFrame(made + rest, SCHEMA).repartition(3)
    small = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect() if r["source"] == "a")
    kept = P.near_dedup(spark, docs, str(tmp_path))
    assert small(kept) == {(None, t[0]): 1, (None, t[1]): 1, (7, t[2]): 1, (8, t[3]): 1, (9, t[4]): 1, (5, t[5]): 1}
    # the small source sits at its ceiling of two epochs, so each row comes twice
    assert small(P.mixture(spark, docs, str(tmp_path))) == {k: 2 * n for k, n in Counter(r[:2] for r in made).items()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole, one = P.run(spark, str(tmp_path)).collect(), P.byte_bpe(spark, kept, str(tmp_path)).collect()
    assert Counter(r["decoded_sha256"] for r in whole if r["doc_id"] is None or r["doc_id"] < 100) == {hashlib.sha256(x.encode()).hexdigest(): 2 for x in t}
    assert len(one) == 6 + len(rest)
