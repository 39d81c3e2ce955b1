"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter over hashed byte n-grams of its lower-cased words; the filters of 64 languages at a time
are bit-sliced into a table of bitmasks, so ANDing an n-gram's HASHES slots returns all languages that contain it.
A text's n-grams are counted for each language by those bits, the counts are corrected for each filter's false
positives, and the language with most wins. Filters hold the n-grams that are not much rarer in their language than in
another, at most GRAMS_PER_LANGUAGE of each, learned from a bounded, hash-chosen sample of the labelled rows
(SAMPLE_PER_LANGUAGE).

Null texts, and those without a letter, are `und` with score 0. Texts whose n-grams are all unknown take the first
learned language by code point, with score 0; of equal counts, too, the first by code point wins. An empty string is a
language like another. Rows are predicted one by one: repeated rows or ids stay as many as they are, whole texts of any
length are counted, an empty table gives an empty result, and columns other than key, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.texts import BYTE_WORDS, chunks, mix

N = 4
HASHES = 3
SLOTS = 1 << 20
SAMPLE_PER_LANGUAGE = 1_500
GRAMS_PER_LANGUAGE = 60_000
#: An n-gram enters a language's filter if its share there is at least so many times its largest share in any.
LIFT = 0.5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of N bytes within a row, ASCII lower-cased; shorter rows have none."""
    if len(data) < N:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = BYTE_WORDS[_LOWER[data]]
    out = np.zeros(len(data) - N + 1, dtype=np.uint64)
    for k in range(N):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(data) - N + 1 + k]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(out)]
    keep = np.arange(len(out)) + N <= offsets[rows + 1]
    return rows[keep], mix(out[keep])


def _slots(h: np.ndarray, k: int) -> np.ndarray:
    return (h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # uint64: bit i of a slot in row w belongs to language 64 * w + i
    false_positive: np.ndarray  # each filter's rate

    def counts(self, rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each row, and those that each language contains, corrected for false positives."""
        masks = self.table[:, _slots(hashes, 0)]
        for k in range(1, HASHES):
            masks &= self.table[:, _slots(hashes, k)]
        total = np.bincount(rows, minlength=n_rows).astype(float)
        seen = np.stack([np.bincount(rows, weights=((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(float), minlength=n_rows) for i in range(len(self.languages))], axis=1)
        p = self.false_positive
        return total, np.clip((seen - total[:, None] * p) / (1 - p), 0, None)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Filters:
    """Filters from (hashes, occurrences) for each language."""
    languages = sorted(counts)
    table = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), dtype=np.uint64)
    for i, lang in enumerate(languages):
        for k in range(HASHES):
            table[i // 64, _slots(counts[lang][0], k)] |= np.uint64(1 << i % 64)
    fill = [float(((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
    return Filters(languages, table, np.array([f**HASHES for f in fill]))


def learn(docs: DataFrame, key: list[str], text: str, lang: str) -> Filters:
    """Fits the filters on at most about SAMPLE_PER_LANGUAGE rows of each language, chosen by a hash of key and text, so
    that copies of a text enter in proportion and not all at once."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return build({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / n))])
    drawn = F.pmod(F.xxhash64(*key, text, F.lit(7)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = known.where(drawn < F.element_at(share, F.col(lang))).select(text, lang)

    def count(batches):
        for batch in batches:
            names = batch.column(1).to_pandas()
            for lo, hi, data, offsets in chunks(batch.column(0)):
                rows, hashes = grams(data, offsets)
                codes, uniques = pd.factorize(names.iloc[lo:hi])
                frame = pd.DataFrame({"l": codes[rows], "h": hashes.view(np.int64)}).value_counts(sort=False).reset_index()
                yield pa.RecordBatch.from_arrays([pa.array(uniques[frame["l"]], pa.string()), pa.array(frame["h"]), pa.array(frame["count"], pa.int64())], ["lang", "gram", "n"])

    each = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r[0]: r[1] for r in each.groupBy("lang").agg(F.sum("n")).collect()}
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))]), F.col("lang"))
    pooled = each.groupBy("gram").agg(F.sum("n").alias("all_n"), F.collect_list(F.struct("lang", "n", rate.alias("rate"))).alias("by"))
    chosen = pooled.where("all_n >= 3").select("gram", F.inline("by"), (F.array_max(F.transform("by", lambda x: x["rate"]))).alias("most")).where((F.col("n") >= 2) & (F.col("rate") >= LIFT * F.col("most")))
    # the most usual ones of each language, ties by hash, found from a histogram: a bounded number reaches the driver
    ranked = chosen.select("lang", "gram", "n", (F.col("n") * 4096 + F.pmod("gram", F.lit(4096))).alias("level"))
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("level")))
    least = ranked.groupBy("lang", "level").count().withColumn("above", above).where(F.col("above") <= GRAMS_PER_LANGUAGE).groupBy("lang").agg(F.min("level").alias("least"))
    rows = ranked.join(least, "lang").where("level >= least").select("lang", "gram", "n").toPandas()
    return build({k: ((g := rows[rows.lang == k]).gram.to_numpy().view(np.uint64), g.n.to_numpy()) for k in sizes})


def predict(docs: DataFrame, filters: Filters, key: list[str], text: str) -> DataFrame:
    """key columns (text may be one) with lang_pred, score (the winner's share of all corrected counts) and known (its
    share of the n-grams)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kept = docs.select(*key, F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = kept.select(*key).schema.add("lang_pred", "string").add("score", "double").add("known", "double")

    def score(batches):
        f = shared.value
        names = np.array([*f.languages, "und"], dtype=object)
        for batch in batches:
            n = batch.num_rows
            best, value, known = np.full(n, len(f.languages)), np.zeros(n), np.zeros(n)
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in chunks(batch.column(len(key))):
                if f.languages:
                    total, seen = f.counts(*grams(data, offsets), hi - lo)
                    best[lo:hi] = seen.argmax(axis=1)
                    top = seen.max(axis=1)
                    value[lo:hi] = top / np.maximum(seen.sum(axis=1), 1e-9)
                    known[lo:hi] = np.minimum(1, top / np.maximum(total, 1))
            best[~letters], value[~letters], known[~letters] = len(f.languages), 0, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(key))), pa.array(names[best], pa.string()), pa.array(np.clip(value, 0, 1)), pa.array(known)], names=schema.names)

    return kept.mapInArrow(score, schema)


def identify(docs: DataFrame, train: Column, key: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows where train holds and predicts the language of every row."""
    return predict(docs, learn(docs.where(train), key, text, lang), key, text)
