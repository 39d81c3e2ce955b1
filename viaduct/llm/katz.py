"""Language-model scores by a Katz backoff bigram model with Good-Turing discounts.

Words are lower-cased (A-Z) runs of [^\\x20\\x09-\\x0D]; every text ends with an end token and starts from a begin
context. Counts up to K are discounted by Good-Turing, as Katz has it; counts above K lose DELTA, so that every context
keeps some mass for what it has not seen. Where counts of counts give no discount between 0 and 1, that of absolute
discounting serves. p(w|v) is the discounted c(v w) / c(v) if that was seen, else a(v) p(w), and p(w) alone after an unseen v; p(w) is the
discounted c(w) / N, and all unseen words together have the rest. a(v) = (1 - sum of seen p(w|v)) / (1 - sum of their
p(w)), summed exactly, so the probabilities of all known words and the unseen add up to 1 after every v.

The tables never leave their shards. Documents are gathered in blocks of some megabytes; a block asks each shard of
hashed n-grams once for each of its distinct n-grams, with its own training counts. A shard adds up the counts of all
blocks, and answers them (so a word in every document is one request of a block, not one of each document). With the
answers a block finds probabilities, and asks in the same way for the backoff weights that it needs. n-grams are named
by 64-bit hashes (two of n different n-grams share a name with probability n^2 / 2^65: 1 in 10,000 for 50 million).

Null and empty texts are the end token alone; repeated or null ids stay rows of their own, each counted and scored. Columns
other than id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.llm.shared import collected, release, table
from viaduct.llm.texts import chunks, mix, words

K = 5
DELTA = 0.05
BLOCK_BYTES = 6_000_000
#: Shards are a power of two, so many that each serves about so many bytes of text.
BYTES_PER_SHARD = 24_000_000
END = np.uint64(0x9D39247E33776D41)
BEGIN = np.uint64(0x2AF7398005AAA5C7)
SCHEMA = "kind int, block long, shard int, x binary, y binary, z binary, w binary"
_BLOCK, _WORDS, _PAIRS, _STATS, _SUMS, _WANTED, _SCORED = range(7)


def pack(a: np.ndarray) -> bytes:
    """The bytes of a by place, least significant first, which compress well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeeze(a: np.ndarray) -> bytes:
    """pack(a), entropy-coded: what blocks and shards send each other is most of the operator's shuffle."""
    return zstandard.ZstdCompressor(level=1).compress(pack(a))


def unsqueeze(b: bytes, kind) -> np.ndarray:
    return unpack(zstandard.ZstdDecompressor().decompress(b), kind)


def steps(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=np.uint64(0)))


def unsteps(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def pair_names(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(word + np.uint64(0x632BE59BD9B4E019)))


def _split(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys whose first bits are their shard."""
    if not len(keys):
        return []
    shards = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    ends = np.append(at[1:], len(keys))
    return list(zip(shards[at].tolist(), at.tolist(), ends.tolist(), strict=True))


@dataclass
class Block:
    """Token sequences of some documents: vocabulary (sorted hashes), numbers of the tokens, and what derives from them."""

    vocabulary: np.ndarray
    numbers: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        tokens = self.vocabulary[self.numbers]
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.before = np.empty_like(self.numbers)  # -1 at the beginning
        self.before[1:] = self.numbers[:-1]
        self.before[np.cumsum(self.lengths) - self.lengths] = -1
        previous = np.where(self.before < 0, BEGIN, self.vocabulary[self.before])
        self.pairs, first, self.pair = np.unique(pair_names(previous, tokens), return_index=True, return_inverse=True)
        self.left, self.right = self.before[first], self.numbers[first]


@dataclass
class Discounts:
    """What all shards know together."""

    tokens: int
    distinct: int
    texts: int
    words: np.ndarray  # discount ratios of counts 0 .. K
    pairs: np.ndarray
    rest: float  # p of all unseen words together

    @staticmethod
    def ratios(n: np.ndarray) -> np.ndarray:
        """Discount ratios d[1..K] from counts of counts n[1..K+1]."""
        d = np.ones(K + 1)
        absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else DELTA
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            turing = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
            katz = (turing - common) / (1 - common) if common < 1 else 0.0
            d[r] = katz if 0 < katz < 1 else (r - absolute) / r if 0 < absolute < r else (r - DELTA) / r
        return d

    @classmethod
    def of(cls, stats: np.ndarray, pair_stats: np.ndarray, texts: int) -> Discounts:
        """stats: tokens, distinct, n1 .. n(K+1)."""
        n = np.append(0.0, stats[2:]).astype(float)
        out = cls(int(stats[0]), int(stats[1]), texts, cls.ratios(n), cls.ratios(np.append(0.0, pair_stats[2:]).astype(float)), 1.0)
        above = stats[1] - stats[2 : 2 + K].sum()
        lost = sum(n[r] * r * (1 - out.words[r]) for r in range(1, K + 1)) + DELTA * above
        out.rest = float(lost / stats[0]) if stats[0] else 1.0
        return out

    def kept(self, counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(counts > K, counts - DELTA, counts * ratios[np.minimum(counts, K)])

    def word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(counts, self.words) / max(self.tokens, 1), self.rest)


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Learns from the rows where train holds. Null texts are empty: one end token.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    bits = min(30, max(1, int(np.ceil(np.log2(max(2, size / BYTES_PER_SHARD))))))

    def opened(mine: dict) -> tuple[Block, np.ndarray]:
        n = len(mine["x"]) * 8 // 65  # 8 bytes and a bit for each document
        skip = (n + 7) // 8
        flags = np.unpackbits(np.frombuffer(mine["y"][:skip], np.uint8), count=n).astype(bool)
        return Block(unsteps(mine["z"]), unsqueeze(mine["w"], np.int32), unpack(mine["y"][skip:], np.int32)), flags

    def gather(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, flags = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in chunks(batch.column(2), BLOCK_BYTES):
                hashes, counts = words(data, offsets)
                tokens = np.insert(hashes, np.cumsum(counts), END)
                vocabulary, numbers = np.unique(tokens, return_inverse=True)
                name = part << 32 | made
                made += 1
                known = np.array([x if x is not None else -(2**63) for x in ids.slice(lo, hi - lo).to_pylist()], dtype=np.int64)
                absent = np.packbits(np.array(ids.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False), dtype=bool)).tobytes()
                lengths = np.packbits(flags[lo:hi]).tobytes() + pack((counts + 1).astype(np.int32))
                yield _rows([(_BLOCK, name, -1, pack(known) + absent, lengths, steps(vocabulary), squeeze(numbers.astype(np.int32)))])

    blocks = table(rows.mapInArrow(gather, SCHEMA), drop_shuffles=True)

    def ask(batches):
        """Each block's distinct n-grams by shard, with its own training counts; for words, also those of the other texts."""
        for batch in batches:
            for mine in batch.to_pylist():
                b, flags = opened(mine)
                learn, out = flags[b.row], []
                for kind, keys, at in ((_WORDS, b.vocabulary, b.numbers), (_PAIRS, b.pairs, b.pair)):
                    n = np.bincount(at[learn], minlength=len(keys)).astype(np.uint32)
                    other = np.bincount(at[~learn], minlength=len(keys)) > 0
                    for s, i, j in _split(keys, bits):
                        bit = np.packbits(other[i:j]).tobytes() if kind == _WORDS else None
                        out.append((kind, mine["block"], s, steps(keys[i:j]), squeeze(n[i:j]), bit, None))
                yield _rows(out)

    def add_up(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        blocks = np.array(group.column("block").to_pylist())
        order = np.argsort(blocks)
        keys = [unsteps(group.column("x")[int(i)].as_py()) for i in order]
        counts = np.concatenate([unsqueeze(group.column("y")[int(i)].as_py(), np.uint32) for i in order]).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        owner = np.full(len(total), len(counts))
        seen = np.flatnonzero(counts > 0)
        np.minimum.at(owner, inverse[seen], seen)
        own = np.zeros(len(counts) + 1, dtype=bool)
        own[owner] = True
        if kind == _WORDS:  # a context can be asked for only if some text that isn't learnt from has it
            sizes = np.diff(np.append(0, ends)).tolist()
            bits_ = np.concatenate([np.unpackbits(np.frombuffer(group.column("z")[int(i)].as_py(), np.uint8), count=k) for i, k in zip(order, sizes, strict=True)])
            flag = (np.bincount(inverse, weights=bits_) > 0)[inverse]
        else:
            flag = own[:-1]
        answer, shard, out, lo = total[inverse].astype(np.uint32), group.column("shard")[0].as_py(), [], 0
        for i, hi in zip(order, ends, strict=True):
            out.append((kind, int(blocks[i]), shard, squeeze(answer[lo:hi]), np.packbits(flag[lo:hi]).tobytes(), None, None))
            lo = int(hi)
        histogram = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
        stats = np.concatenate([[total.sum(), (total > 0).sum()], histogram[1 : K + 2]]).astype(np.int64)
        out.append((_STATS, -1, kind, stats.tobytes(), None, None, None))
        return pa.Table.from_batches([_rows(out)])

    answers = table(blocks.mapInArrow(ask, SCHEMA).groupBy("kind", "shard").applyInArrow(add_up, SCHEMA), drop_shuffles=True)
    collected(spark)
    told = answers.where(F.col("kind") == _STATS).select("shard", "x").toPandas()  # a few longs from each shard
    sums = {k: sum((np.frombuffer(x, np.int64) for x in told.x[told.shard == k]), np.zeros(K + 3, np.int64)) for k in (_WORDS, _PAIRS)}
    known = Discounts.of(sums[_WORDS], sums[_PAIRS], int(texts))

    def weigh(group: pa.Table) -> pa.Table:
        """A block with its answers: the scores but for backoff weights, sums for these, and which it needs."""
        lines = group.to_pylist()
        mine = next(r for r in lines if r["kind"] == _BLOCK)
        b, _ = opened(mine)
        vocabulary, skip = b.vocabulary, (len(b.lengths) + 7) // 8
        got = {k: sorted((r for r in lines if r["kind"] == k), key=lambda r: r["shard"]) for k in (_WORDS, _PAIRS)}
        told = {k: [unsqueeze(r["x"], np.uint32) for r in got[k]] for k in got}
        count, pair_count = (np.concatenate(told[k]).astype(np.int64) for k in (_WORDS, _PAIRS))
        bit = {k: np.concatenate([np.unpackbits(np.frombuffer(r["y"], np.uint8), count=len(n)) for r, n in zip(got[k], told[k], strict=True)]).astype(bool) for k in got}
        own = bit[_PAIRS]
        # after the end token nothing follows, and its place stands for the begin context here
        context = np.append(count, known.texts)
        p = known.word(count)
        kept = known.kept(pair_count, known.pairs)
        seen = pair_count > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(seen, np.log10(kept / np.maximum(context[b.left], 1)), np.log10(p[b.right]))
            base = np.log10((count + 1) / (known.tokens + known.distinct + 1))
        rows = len(b.lengths)
        score = np.bincount(b.row, weights=value[b.pair], minlength=rows)
        bases = np.bincount(b.row, weights=base[b.numbers], minlength=rows)
        knew = np.bincount(b.row, weights=(count > 0)[b.numbers], minlength=rows).astype(np.int32)
        # sums of the contexts over the pairs that this block accounts for
        names = np.append(vocabulary, BEGIN)
        left = np.where(b.left < 0, len(vocabulary), b.left)
        s1 = np.bincount(left[own], weights=kept[own], minlength=len(names))
        s2 = np.bincount(left[own], weights=p[b.right[own]], minlength=len(names))
        out = []

        def by_shard(kind: int, which: np.ndarray, *columns: np.ndarray) -> np.ndarray:
            which = which[np.argsort(names[which])]
            for s, i, j in _split(names[which], bits):
                out.append((kind, mine["block"], s, steps(names[which[i:j]]), *[squeeze(c[which[i:j]]) for c in columns], *[None] * (3 - len(columns))))
            return which

        by_shard(_SUMS, np.flatnonzero((s2 > 0) & np.append(bit[_WORDS], True)), s1 / np.maximum(context, 1), s2)
        open_ = ~seen[b.pair] & (context[b.before] > 0)
        l2 = left[b.pair[open_]]
        needed = by_shard(_WANTED, np.unique(l2))
        place = np.zeros(len(names), dtype=np.int64)
        place[needed] = np.arange(len(needed))
        cells, times = np.unique(b.row[open_].astype(np.int64) << 32 | place[l2], return_counts=True)
        fixed = pack(score) + pack(bases) + pack(knew) + pack(b.lengths.astype(np.int32))
        out.append((_SCORED, mine["block"], -1, mine["x"], mine["y"][:skip], fixed, zstandard.ZstdCompressor(level=1).compress(pack(cells) + pack(times.astype(np.int32)))))
        return pa.Table.from_batches([_rows(out)])

    weighed = table(blocks.union(answers.where(F.col("kind").isin(_WORDS, _PAIRS))).groupBy("block").applyInArrow(weigh, SCHEMA), drop_shuffles=True)
    release(blocks, answers)

    def back_off(group: pa.Table) -> pa.Table:
        """A shard of contexts: their sums over all blocks, and the backoff weights that blocks want."""
        lines = sorted(group.to_pylist(), key=lambda r: r["block"])
        sums = [(unsteps(r["x"]), unsqueeze(r["y"], np.float64), unsqueeze(r["z"], np.float64)) for r in lines if r["kind"] == _SUMS]
        if not sums:
            return pa.Table.from_batches([_rows([])])
        names, inverse = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
        s1, s2 = (np.bincount(inverse, weights=np.concatenate([s[i] for s in sums])) for i in (1, 2))
        weight = np.log10((1 - s1) / (1 - s2))
        out = [(_WANTED, r["block"], r["shard"], pack(weight[np.searchsorted(names, unsteps(r["x"]))]), None, None, None) for r in lines if r["kind"] == _WANTED]
        return pa.Table.from_batches([_rows(out)])

    weights = weighed.where(F.col("kind").isin(_SUMS, _WANTED)).groupBy("shard").applyInArrow(back_off, SCHEMA)

    def finish(group: pa.Table) -> pa.Table:
        lines = group.to_pylist()
        mine = next(r for r in lines if r["kind"] == _SCORED)
        n = len(mine["z"]) // 24
        score, bases = unpack(mine["z"][: 8 * n], np.float64).copy(), unpack(mine["z"][8 * n : 16 * n], np.float64)
        knew, lengths = unpack(mine["z"][16 * n : 20 * n], np.int32), unpack(mine["z"][20 * n :], np.int32)
        cells = zstandard.ZstdDecompressor().decompress(mine["w"]) if mine["w"] else b""
        m = len(cells) // 12
        if m:
            cells, times = unpack(cells[: 8 * m], np.int64), unpack(cells[8 * m :], np.int32)
            weight = np.concatenate([unpack(r["x"], np.float64) for r in sorted((r for r in lines if r["kind"] == _WANTED), key=lambda r: r["shard"])])
            score += np.bincount(cells >> 32, weights=weight[cells & 0xFFFFFFFF] * times, minlength=n)
        ids, absent = unpack(mine["x"][: 8 * n], np.int64), np.unpackbits(np.frombuffer(mine["x"][8 * n :], np.uint8), count=n).astype(bool)
        learnt = np.unpackbits(np.frombuffer(mine["y"], np.uint8), count=n).astype(bool)
        return pa.table({"id": pa.array(ids, mask=absent), "train": learnt, "n_tokens": lengths.astype(np.int64), "n_known": knew.astype(np.int64), "base_score": bases, "score": score})

    done = weighed.where(F.col("kind") == _SCORED).union(weights).groupBy("block").applyInArrow(finish, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
