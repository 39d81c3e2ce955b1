"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text (rates are for each word or byte): densities, counts and variety of words from two learned lexicons
(whole words, and stems of STEM bytes), how often these have a word of address (you, du, tu, vous, usted ...) within
WINDOW words, words of address, capitals, exclamation and question marks, other punctuation and runs of it,
and signs of obfuscation (words that mix letters with digits or marks, letters three times in a row).

The lexicons hold what occurs in at least LEAST toxic texts and LIFT times as often as in others, of the labelled
texts. Lexicons, trees and calibration are fitted on at most about SAMPLE labelled texts, chosen by a hash of their
id; a fifth of them, by another hash, is kept for the calibration alone. Null texts are empty; every text gets a score.
Without labels of both classes the score is the share of toxic labels (0 without labels).

Several labels of one id count as toxic if any is; rows that share an id share the label and each get their score, and a
row without an id is scored, never learned from. Whole texts are scored whatever their length; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from viaduct.llm.shared import table
from viaduct.llm.texts import _LOWER, chunks, prefix_hashes, slice_hashes, word_spans

SAMPLE = 20_000
STEM = 5
WINDOW = 3
LEAST = 6
LIFT = 6.0
ENTRIES = 4_000
TREES, DEPTH = 20, 4
#: Words of address: fixed values.
ADDRESS = "you your yours yourself u ur thou du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros vuestro"

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 digit, 3 mark, 0 space
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[128:] = 1


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, stem hash, length) of the runs of letters and digits, lower-cased."""
    kind = _CLASS[data]
    start, end = word_spans(data, offsets, (kind == 1) | (kind == 2)) if len(data) else (np.empty(0, np.int64),) * 2
    prefix = prefix_hashes(_LOWER[data])
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, slice_hashes(prefix, start, end), slice_hashes(prefix, start, np.minimum(end, start + STEM)), end - start


def _address() -> np.ndarray:
    listed = ADDRESS.split()
    raw = np.frombuffer("".join(listed).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in listed])
    return np.unique(slice_hashes(prefix_hashes(raw), np.append(0, ends[:-1]), ends))


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(mask))[offsets]).astype(float)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, stems: np.ndarray, address: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    row, word, stem, length = _spans(data, offsets)
    count = lambda mask: np.bincount(row[mask], minlength=n).astype(float)
    is_word, is_stem = np.isin(word, lexicon), np.isin(stem, stems) & (length >= STEM)
    hit, you = is_word | is_stem, np.isin(word, address)
    reach = np.append(0, np.cumsum(you))
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    at = np.flatnonzero(hit)
    near = np.zeros(len(row), dtype=bool)
    near[at] = reach[np.minimum(at + WINDOW + 1, ends[row[at] + 1])] > reach[np.maximum(at - WINDOW, ends[row[at]])]
    total = np.maximum(1.0, np.bincount(row, minlength=n))
    kinds = np.unique(np.stack([row[hit].astype(np.uint64), word[hit]]), axis=1)[0].astype(np.int64) if hit.any() else np.empty(0, np.int64)
    kind, size = _CLASS[data], np.maximum(1.0, np.diff(offsets))
    capital = (data >= 65) & (data <= 90)
    twice = np.zeros(len(data), dtype=bool)
    joined = np.zeros(len(data), dtype=bool)
    marks = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        twice[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (kind[2:] == 1) & (data[2:] < 128)
        joined[1:-1] = (kind[:-2] == 1) & (kind[2:] == 1) & ((kind[1:-1] == 2) | (kind[1:-1] == 3))
        marks[1:] = (kind[1:] == 3) & (kind[:-1] == 3)
    of = lambda mask: _per_row(mask, offsets)
    columns = [
        count(is_word) / total, np.minimum(count(is_word), 50), count(is_stem) / total, np.minimum(count(is_stem), 50), np.bincount(kinds, minlength=n),
        count(near) / total, np.minimum(count(near), 50), count(you) / total, np.log1p(total), of(capital) / size, of(data == 33) / size, of(data == 63) / size,
        of(kind == 3) / size, of(marks) / size, of(joined) / size, of(twice) / size,
    ]
    return np.stack(columns, axis=1)


def _lexicons(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the stems that mark toxic texts, at most ENTRIES of each."""

    def count(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                row, word, stem, length = _spans(data, offsets)
                long_ = length >= STEM
                for what, r, h in ((0, row, word), (1, row[long_], stem[long_])):
                    once = pd.DataFrame({"r": r, "h": h.view(np.int64)}).drop_duplicates()
                    once["t"] = toxic[lo:hi][once["r"]]
                    sums = once.groupby("h")["t"].agg(["sum", "count"]).reset_index()
                    yield pa.RecordBatch.from_arrays([pa.array([what] * len(sums), pa.int32()), pa.array(sums["h"]), pa.array(sums["sum"], pa.int64()), pa.array(sums["count"] - sums["sum"], pa.int64())], names=["what", "h", "toxic", "other"])

    toxic, other = (float(x or 0) for x in labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    counts = labelled.select("text", "toxic").mapInArrow(count, "what int, h long, toxic long, other long").groupBy("what", "h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lift = (F.col("toxic") / max(toxic, 1)) / ((F.col("other") + 1) / max(other, 1))
    found = [counts.where((F.col("what") == w) & (F.col("toxic") >= LEAST) & (lift >= LIFT)).orderBy(lift.desc(), "h").limit(ENTRIES).toPandas() for w in (0, 1)]
    return tuple(f["h"].to_numpy().astype(np.int64).view(np.uint64) for f in found)


def _with_features(rows: DataFrame, key: list[str], lexicons: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows' key columns, and their text's features."""
    shared = rows.sparkSession.sparkContext.broadcast((*lexicons, _address()))
    kept = rows.select(*key, F.col("text"))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(len(key))):
                x = features(data, offsets, *shared.value)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(key))), listed], names=[*key, "x"])

    out = kept.mapInArrow(run, kept.select(*key).schema.add("x", ArrayType(DoubleType())))
    return out.select(*key, array_to_vector("x").alias("features"))


def score_documents(docs: DataFrame, labels: DataFrame, train, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 3) -> DataFrame:
    """One row per document: key, held_out, score. Learns from the labels of rows where train (a function of the key column) holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & train(F.col(key))).groupBy(key).agg((F.max(label) > 0).cast("int").alias("toxic"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(n, 1))))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    labelled = table(rows.join(F.broadcast(known), key))  # at most about SAMPLE ids are broadcast
    counts = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    held = (~train(F.col(key))).alias("held_out")
    if len(counts) < 2:
        return rows.select(key, held, F.lit(float(next(iter(counts), 0))).alias("score"))
    calibrating = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(5)) == 0
    lexicons = _lexicons(labelled.where(~calibrating))
    seen = table(_with_features(labelled.withColumn("calibrating", calibrating), [key, "toxic", "calibrating"], lexicons).select(key, "toxic", "calibrating", vector_to_array("features").alias("x")))
    seen = seen.select("toxic", "calibrating", array_to_vector("x").alias("features"))
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(seen.where("NOT calibrating").coalesce(4))
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    check = raw(seen.where("calibrating")).select(F.col("toxic").cast("double"), "raw")
    stairs = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="step").fit(check) if check.select("toxic").distinct().count() == 2 else None
    scored = raw(_with_features(rows, [key], lexicons))
    scored = stairs.transform(scored) if stairs else scored.withColumn("step", F.col("raw"))
    # within a step of the stairs the trees' order is kept
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("step") + 0.02 * F.col("raw")))
    return scored.select(key, held, score.alias("score"))
