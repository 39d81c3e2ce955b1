"""Removal of repeated byte strings, exact: every byte covered by a LENGTH-byte string that also starts elsewhere.

Refinement of buckets of suffixes, spread over the cluster. In the place of pointers to the buckets of later offsets, a
bucket is refined by names of what surrounds its suffixes: anchors are so far apart that a window holds two or three, and
a round on their pointers would tell less than one on whole windows. Not every suffix is sorted: a window of LENGTH bytes
is represented by its anchor, the suffix in it whose first Q bytes hash least (the leftmost of equals), so equal
windows have equal anchors at equal places, and about one suffix in 180 is an anchor.

1. Anchors start in buckets by their first Q bytes. Buckets of one anchor are done: nothing repeats there.
2. A bucket is refined by what surrounds the anchor: all bytes of the windows that it represents. Anchors that still
   share their bucket have all these windows repeated.
3. The others are refined by blocks of BLOCK window starts: by the bytes that a block's windows have in common (alone in
   a bucket: none repeats) and by all their bytes (still sharing: all repeat), and blocks that neither decides, by each
   window. Of anchors that step 2 found equal, one stands for all.

Buckets are named by 128 bits of hashes of their strings (two of n different strings share a name with probability
n^2 / 2^129: below 1e-12 for a hundred million million), so refining a bucket is a count of equal names, which combines
before the shuffle; a passage in very many documents is no hot task. Nulls are empty texts; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.shared import release, table
from viaduct.llm.texts import chunks, prefix_hashes, slice_hashes

LENGTH = 400
Q = 32
BLOCK = 24
_PLACE_BITS = 26


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values (van Herk and Gil, Werman)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(row, place, first window start, last window start, bucket) of each anchor; places are in data."""
    n = len(data)
    empty = np.empty(0, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    if n < length:
        return empty, empty, empty, empty, empty
    names = slice_hashes(prefix_hashes(data), np.arange(n - q + 1), np.arange(q, n + 1))
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    step = (1 << _PLACE_BITS) - length
    for at in range(0, n - length + 1, step):  # data beyond 64 MB go in pieces that overlap
        until = min(n - length + 1, at + step)
        part = names[at : until + length - q]
        low = np.uint64((1 << _PLACE_BITS) - 1)
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        place = (sliding_min(keys, length - q + 1) & low).astype(np.int64) + at
        start = np.arange(at, until)
        inside = start + length <= offsets[row_of[start] + 1]
        start, place = start[inside], place[inside]
        if not len(start):
            continue
        cut = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        firsts, lasts = np.append(0, cut), np.append(cut - 1, len(start) - 1)
        p = place[firsts]
        found.append((row_of[p], p, start[firsts], start[lasts], names[p].view(np.int64)))
    if not found:
        return empty, empty, empty, empty, empty
    row, p, first, last, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.append(True, (p[1:] != p[:-1]) | (first[1:] != last[:-1] + 1))  # a run of windows that a piece's border cut is one
    at = np.flatnonzero(new)
    return row[at], p[at], first[at], last[np.append(at[1:], len(p)) - 1], bucket[at]


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """docs: id, digest, text. Spans (id, digest, a, b): bytes a to b are covered by windows that repeat."""
    digest = xxhash.xxh3_128_digest

    def scan(batches):
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1)
            for lo, _, data, offsets in chunks(batch.column(2)):
                row, p, first, last, bucket = anchors(data, offsets, length, q)
                raw = data.tobytes()
                around = [digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                base = offsets[row]
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), digests.take(at), pa.array(p - base, pa.int64()), pa.array((p - last).astype(np.int32)), pa.array((p - first).astype(np.int32)), pa.array(bucket), pa.array(around, pa.binary())],
                    names=["id", "digest", "p", "near", "far", "bucket", "around"],
                )

    every = table(docs.select("id", "digest", F.col("text").cast("binary")).mapInArrow(scan, "id long, digest long, p long, near int, far int, bucket long, around binary"))
    crowded = table(every.groupBy("bucket").count().where("count > 1").select("bucket"))
    found = table(every.join(crowded, "bucket"))
    release(every, crowded)
    name = ["bucket", "near", "far", "around"]
    groups = table(found.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct("id", "digest", "p")).alias("one")))
    whole = found.join(table(groups.where("n > 1").select(*name)), name).select("id", "digest", (F.col("p") - F.col("far")).alias("a"), (F.col("p") - F.col("near") + length).alias("b"))
    undecided = table(groups.where("n = 1").select("bucket").distinct())
    needed = groups.join(undecided, "bucket").select("one.id", "one.digest", F.struct("one.p", "near", "far", (F.col("n") == 1).alias("open")).alias("anchor"))
    return whole.union(_refined(docs, needed, length)).distinct()


def _refined(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """The spans of the open anchors among needed (id, digest, anchor), by blocks, then by windows."""
    reach = length - 1
    by_text = needed.groupBy("id", "digest").agg(F.collect_list("anchor").alias("anchors"))
    joined = docs.withColumnsRenamed({"id": "i", "digest": "d"}).join(by_text, F.col("i").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest")))
    text = F.col("text").cast("binary")

    def surroundings(batches):
        """Each anchor with the bytes that its windows can reach, and where it is in them."""
        for batch in batches:
            out = {k: [] for k in ("id", "digest", "p", "near", "far", "open", "at", "bytes")}
            for i, d, t, each in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                seen = set()
                for a in each:
                    p = a["p"]
                    if (p, a["near"], a["far"]) in seen:
                        continue
                    seen.add((p, a["near"], a["far"]))
                    lo = max(0, p - reach)
                    for k, v in zip(out, (i, d, p, a["near"], a["far"], a["open"], p - lo, t[lo : p + length]), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], names=list(out))

    near = joined.select("i", "d", text.alias("text"), "anchors").mapInArrow(surroundings, "id long, digest long, p long, near int, far int, open boolean, at int, bytes binary")
    near = table(near.withColumn("n", F.monotonically_increasing_id()))
    digest = xxhash.xxh3_128_digest

    def blocks(batches):
        for batch in batches:
            out: list[tuple] = []
            for n, near, far, open_, at, raw in zip(*(batch.column(c).to_pylist() for c in ("n", "near", "far", "open", "at", "bytes")), strict=True):
                for k in range(near // BLOCK, far // BLOCK + 1):
                    r0, r1 = k * BLOCK, min(k * BLOCK + BLOCK - 1, reach)
                    core = digest(raw[max(0, at - r0) : at - r1 + length], seed=2 * k)
                    inside = at - r1 >= 0 and at - r0 + length <= len(raw)
                    out.append((n, open_, k, core, digest(raw[at - r1 : at - r0 + length], seed=2 * k + 1) if inside else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["n", "open", "k", "core", "whole"])

    cut = table(near.select("n", "near", "far", "open", "at", "bytes").mapInArrow(blocks, "n long, open boolean, k int, core binary, whole binary"))
    shared = table(cut.where("whole IS NOT NULL").groupBy("whole").count().where("count > 1").select("whole", F.lit(True).alias("all")))
    likely = table(cut.groupBy("core").agg(F.count("*").alias("c"), F.max("open").alias("some")).where("c > 1 AND some").select("core"))
    judged = table(cut.join(likely, "core").join(shared, "whole", "left").select("n", "open", "k", "core", F.coalesce("all", F.lit(False)).alias("all")))
    release(cut, shared, likely)
    places = near.select("n", "id", "digest", "p", "near", "far")
    start = F.col("k") * BLOCK
    full = judged.where("open AND all").join(places, "n").select("id", "digest", (F.col("p") - F.least(start + BLOCK - 1, F.lit(reach))).alias("a"), (F.col("p") - start + length).alias("b"))
    split = table(judged.where("open AND NOT all").select("core").distinct())
    left = judged.join(split, "core").groupBy("n").agg(F.collect_set("k").alias("ks"))

    def windows(batches):
        for batch in batches:
            out: list[tuple] = []
            for n, open_, at, raw, ks in zip(*(batch.column(c).to_pylist() for c in ("n", "open", "at", "bytes", "ks")), strict=True):
                for k in ks:
                    for r in range(k * BLOCK, min(k * BLOCK + BLOCK, reach + 1)):
                        if at - r >= 0 and at - r + length <= len(raw):
                            out.append((n, open_, r, digest(raw[at - r : at - r + length], seed=r)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], names=["n", "open", "r", "window"])

    each = table(near.select("n", "open", "at", "bytes").join(left, "n").mapInArrow(windows, "n long, open boolean, r int, window binary"))
    twice = table(each.groupBy("window").count().where("count > 1").select("window"))
    single = each.where("open").join(twice, "window").join(places, "n").where("r BETWEEN near AND far").select("id", "digest", (F.col("p") - F.col("r")).alias("a"), (F.col("p") - F.col("r") + length).alias("b"))
    return full.union(single)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per row: key, n_bytes, n_removed, n_spans, kept_sha256, repeated (whether any byte goes), and with
    keep_text the remaining bytes (kept). Rows that share a key, or have none, are judged each by its own text."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    spans = repeated_spans(rows, length).groupBy("id", "digest").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = spans.withColumnsRenamed({"id": "i", "digest": "d"})
    joined = rows.join(spans, F.col("i").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest")), "left").select("id", F.col("text").cast("binary").alias("text"), "spans")
    fields = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "repeated": pa.bool_()} | ({"kept": pa.binary()} if keep_text else {})

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in fields}
            for t, each in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, removed, n, at = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in each or ()):
                    if a > end:
                        kept.append(t[at:a])
                        n += 1
                        removed += b - a
                    else:
                        removed += max(0, b - end)
                    end = at = max(end, b)
                kept.append(t[at:])
                rest = b"".join(kept)
                values = (len(t), removed, n, hashlib.sha256(rest).hexdigest(), removed > 0, rest)
                for k, v in zip(fields, values, strict=False):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], v) for k, v in fields.items()]], names=[key, *fields])

    schema = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean" + (", kept binary" if keep_text else "")
    return joined.mapInArrow(cut, schema)
