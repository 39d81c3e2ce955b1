"""Null and repeated ids, repeated rows and columns with clashing names in the operators over documents and vectors."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from viaduct.llm import fingerprints, katz, languages, mixing, neardup, repeats, vectors
from viaduct.llm.queries import encoded

A, B, C = prose(11, 90), prose(12, 80), prose(13, 70)
ROWS = [(1, A, "en", "s"), (1, A, "en", "s"), (1, B, "en", "s"), (None, A, "fr", "t"), (None, None, None, None), (None, None, None, None), (2, "", "fr", "t"), (3, C, "fr", "t"), (4, B, "en", "s")]


@pytest.fixture(scope="module")
def odd(spark):
    """Every name that an operator might use for itself is taken."""
    names = "id row n size bucket taken target tokens score label block node word words gram key"
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} string" for x in names.split())
    return spark.createDataFrame([(*r, *["x"] * len(names.split())) for r in ROWS], schema).repartition(3)


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_rows_stay_rows_of_their_own(odd):
    ids = Counter((r[0],) for r in ROWS)
    mixed = mixing.mix(odd)
    assert counted(mixed, "doc_id") == ids
    # the two equal rows of one document are two documents of equal size
    assert all(v == 2 for k, v in counted(mixed.where("doc_id = 1 AND size = 90"), "size").items())
    held = encoded(odd)
    assert counted(held, "doc_id") == ids and counted(held.where("doc_id = 1"), "n_tokens").most_common(1)[0][1] == 2
    found = languages.identify(odd.select("doc_id", "text", "lang").withColumn("held_out", F.lit(False)), ~F.col("held_out"), ["doc_id", "held_out"])
    assert counted(found, "doc_id") == ids and all(r["lang_pred"] == "und" for r in found.where("doc_id IS NULL").collect() if r["score"] == 0)


def test_repeats_and_near_duplicates_of_equal_rows(odd):
    gone = repeats.remove_repeats(odd)
    # a text that stands in several rows is repeated whole, and a null one is empty
    got = counted(gone, "doc_id", "n_bytes", "n_removed")
    n = {x: len(x.encode()) for x in (A, B, C)}
    assert sum(got.values()) == len(ROWS) and got[1, n[A], n[A]] == 2 and got[None, n[A], n[A]] == 1 and got[None, 0, 0] == 2 and got[3, n[C], 0] == 1
    near = neardup.near_duplicates(odd.withColumn("_key", F.monotonically_increasing_id()), "_key")
    assert near.count() == len(ROWS)


def test_scores_of_equal_rows_are_equal(odd):
    scored = katz.score_documents(odd, F.lit(True))
    assert scored.count() == len(ROWS)
    per = scored.join(odd.select("doc_id", "text").distinct(), "doc_id").groupBy("doc_id", "n_tokens").agg(F.count_distinct(F.round("score", 9)).alias("k"))
    assert all(r["k"] == 1 for r in per.collect())


def test_fingerprints_of_equal_texts_are_equal(odd):
    got = fingerprints.fingerprint_documents(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert got.count() == 4


def test_vectors_with_equal_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(1, v, 5), (1, v, 5), (1, w, 5), (2, v, 5), (3, v, None), (4, None, 5), (4, None, 5)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, embedding array<double>, label int, id string, node int, v string")
    got = counted(vectors.near_vectors(df), "vec_id", "n_links")
    assert got == Counter({(1, 2): 2, (2, 2): 1, (1, 0): 1, (3, 0): 1, (4, 0): 2})
