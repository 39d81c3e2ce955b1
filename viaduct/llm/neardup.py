"""MinHash near-deduplication of documents with BagMinHash (Ertl, 2018) signatures over weighted word shingles.

A document is the multiset of its 5-word shingles. Weights are discretised at 0, 1, 2, 4, 8, ...; each shingle owns one
Poisson process per stretch between two such levels that its weight reaches, whose points carry an arrival time, a
signature component and a level; a point counts when its level lies below the weight. Each component keeps its first
arrival, so two signatures agree in a component with the weighted Jaccard similarity. Processes are followed only up
to a horizon that fills all components, so a long document costs little more than one draw for each shingle.

Banded signatures propose, and the exact multiset Jaccard similarity of the shingles decides. Exact copies (equal
texts) are one node. Every bucket is searched in linear work first: its members are compared with one of them, in half
of the bands the one with most mates over all bands (the common origin of a group of copies has most), in the others
one chosen by hash. Then only members of one bucket that are not yet connected are compared, so that no link of two
mates is lost: in buckets of up to SMALL members as pairs, in larger ones tile by tile. Both compare signatures of two
bytes a component (160 bytes a document) first. Pairs of small buckets that these do not rule out are compared by their
texts; of large buckets, the members with at least one promising mate are compared by tiles of texts, exactly, so that
what is shuffled grows with members and never with pairs.

Documents without words link with nothing but equal texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.llm.shared import components, table
from viaduct.llm.texts import chunks, mix, multiset, shingles, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
COMPONENTS = BANDS * ROWS
SMALL = 32
#: Members on a side of a tile of signatures, and of texts.
TILE = 1024
TEXT_TILE = 256
#: Shingles that a tile of texts takes at a time.
STRIP = 4096
#: Size of the bitmap that tells which texts may be wanted.
FILTER_BITS = 1 << 25


def bag_minhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, m: int = COMPONENTS) -> np.ndarray:
    """uint64 signatures (n_rows, m) of weighted sets given as (row, hash, weight); rows without elements get all ones."""
    first = np.full((n_rows, m), np.inf)
    mass = np.bincount(rows, weights=weights, minlength=n_rows)
    horizon = (np.log(m) + 3.0) / np.maximum(mass, 1)
    open_rows = mass > 0
    while open_rows.any():
        e = np.flatnonzero(open_rows[rows])
        level = np.zeros(len(e), dtype=np.int64)
        more, l = e[weights[e] > 1], 0
        parts = [(e, level)]
        while len(more):  # stretch l + 1 is [2^l, 2^(l+1))
            parts.append((more, np.full(len(more), l + 1)))
            l += 1
            more = more[weights[more] > (1 << l)]
        e = np.concatenate([p[0] for p in parts])
        level = np.concatenate([p[1] for p in parts])
        width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
        low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
        state = mix(hashes[e] + mix(level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
        row, weight, time = rows[e], weights[e], np.zeros(len(e))
        while len(row):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            gap = ((state >> np.uint64(12)).astype(np.float64) + 1.0) / float(1 << 52)
            time = time - np.log(gap) / (width * m)
            go = time < horizon[row]
            row, weight, time, width, low, state = row[go], weight[go], time[go], width[go], low[go], state[go]
            where = mix(state ^ np.uint64(0xA0761D6478BD642F))
            place = low + (width * ((where >> np.uint64(40)).astype(np.float64) / float(1 << 24))).astype(np.int64)
            hit = place < weight
            np.minimum.at(first, (row[hit], (where[hit] % np.uint64(m)).astype(np.int64)), time[hit])
        open_rows = open_rows & np.isinf(first).any(axis=1)
        first[open_rows] = np.inf
        horizon[open_rows] *= 2
    return first.view(np.uint64)


def bands(signature: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """int64 keys (n, n_bands): the rows of each band and its number, hashed."""
    n, m = signature.shape
    parts = signature.reshape(n, n_bands, m // n_bands)
    out = np.zeros((n, n_bands), dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64)
    for k in range(m // n_bands):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, digest (of the text), n_shingles, keys (array<long>, empty without words), brief (2 bytes of each component)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                r, h = shingles(*words(data, offsets), SHINGLE)
                n = np.bincount(r, minlength=hi - lo)
                signature = bag_minhash(*multiset(r, h, hi - lo), hi - lo)
                keys, brief = bands(signature), (mix(signature) >> np.uint64(48)).astype("<u2")
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].ravel()))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n.astype(np.int64)), listed, pa.array([x.tobytes() for x in brief], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "n", "keys", "brief"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest("text"))
    return rows.mapInArrow(run, "id long, digest binary, n long, keys array<long>, brief binary")


def likely_alike(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Whether rows of two uint16 arrays agree in at least so many components."""
    return (left == right).sum(axis=-1) >= least


def agreeing(similarity: float) -> int:
    """Components in which two signatures of the similarity agree, less five standard deviations: fewer are taken as a
    proof of less (a pair at the very threshold fails it once in 3 million)."""
    return int(np.floor(COMPONENTS * similarity - 5 * np.sqrt(COMPONENTS * similarity * (1 - similarity))))


def promising(pairs: DataFrame, copies: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose signatures do not rule the similarity out."""
    brief = lambda n, name: copies.select(F.col("node").alias(n), F.col("brief").alias(name)).hint("merge")
    met = pairs.hint("merge").join(brief("a", "left"), "a").join(brief("b", "right"), "b").select("a", "b", "left", "right")
    least = agreeing(similarity)

    def run(batches):
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, COMPONENTS) for k in (2, 3)]
            keep = pa.array(likely_alike(*sides, least))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Multiset Jaccard similarity of the shingles of each two texts; 0 where either has no words."""
    out = np.zeros(len(left))
    for lo, hi, _, _ in chunks(left, 1 << 20):
        sides = []
        for column in (left, right):
            for _, _, data, offsets in chunks(column.slice(lo, hi - lo), 1 << 62):
                sides.append(multiset(*shingles(*words(data, offsets), SHINGLE), hi - lo))
        (ra, ha, ca), (rb, hb, cb) = sides
        sizes = np.bincount(ra, weights=ca, minlength=hi - lo) + np.bincount(rb, weights=cb, minlength=hi - lo)
        r, h, c = np.concatenate([ra, rb]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
        order = np.lexsort((h, r))
        r, h, c = r[order], h[order], c[order]
        same = np.flatnonzero((r[1:] == r[:-1]) & (h[1:] == h[:-1])) if len(r) else np.empty(0, np.int64)
        common = np.bincount(r[same], weights=np.minimum(c[same], c[same + 1]), minlength=hi - lo)
        out[lo:hi] = common / np.maximum(sizes - common, 1)
    return out


def texts_of(nodes: DataFrame, copies: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the nodes, written. docs: text, digest."""
    one = table(copies.join(nodes.distinct().hint("merge"), "node", "left_semi").select("node", "digest"))
    rows = among(docs, one, "digest").select("digest", "text").hint("merge").join(one, "digest")
    return table(rows.groupBy("node").agg(F.min("text").alias("text")))


def verified(pairs: DataFrame, copies: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the similarity. docs: text, digest."""
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), copies, docs)
    side = lambda n, name: texts.select(F.col("node").alias(n), F.col("text").alias(name)).hint("merge")
    two = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            keep = pa.array(jaccard(batch.column(2), batch.column(3)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted, and some more: a bitmap of FILTER_BITS hashed keys (4 MB at most, whatever the
    number of rows) is broadcast, so that few of the other rows are shuffled by the exact join that follows."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    maps = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    named = rows.withColumn("place", place).withColumn("part", F.bitmap_bucket_number("place"))
    return named.join(F.broadcast(maps), "part").where(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) > 0).select(*rows.columns)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row: key, n_shingles, class_id (the least key of the rows it is connected to by copies and links of
    the similarity or more) and kept (key = class_id).

    Rows with a null key are classed by their text like all others; where a class has no other key, its class_id is
    null and its rows are kept. Rows that share a key but not a text are classed each by its own text."""
    sketches = table(sketch(docs, key, text))
    copies = sketches.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("keys").alias("keys"), F.max("brief").alias("brief"))
    copies = table(copies.withColumn("node", F.monotonically_increasing_id()))
    members = copies.where("n > 0").select(F.col("node").alias("id"), "n", F.posexplode("keys").alias("band", "bucket"))
    crowded = table(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    inside = table(members.join(crowded.hint("merge"), "bucket"))
    mates = inside.groupBy("id").agg(F.sum("size").alias("mates"))
    ranked = inside.hint("merge").join(mates, "id").withColumn("rank", F.when(F.col("band") % 2 == 0, F.col("mates")).otherwise(F.xxhash64("id", F.col("band") % 4)))
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "id", "n")).alias("p"))
    shared = table(inside.hint("merge").join(pivots, "bucket").select("bucket", "size", "id", "n", "p"))
    close = lambda n, m: F.least(n, m) >= F.greatest(n, m) * similarity  # noqa: E731  a bound on any Jaccard similarity
    first = shared.where((F.col("id") != F.col("p.id")) & close(F.col("n"), F.col("p.n"))).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
    first = table(promising(first, copies, similarity))
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest("text"))
    links = table(verified(first, copies, texts, similarity))
    open_, pairs = _unconnected(shared, components(links), close)
    pairs = table(promising(pairs, copies, similarity).hint("merge").join(first, ["a", "b"], "left_anti"))
    links = links.union(verified(pairs, copies, texts, similarity)).union(_tiled(open_, copies, texts, similarity))
    links = table(links)
    same = components(links)
    linked = copies.select("node", "rep").hint("merge").join(same, "node")
    named = table(linked.groupBy("component").agg(F.min("rep").alias("class_id")))
    linked = linked.hint("merge").join(named, "component").select("node", "class_id")
    classes = copies.select("node", "digest", "rep").hint("merge").join(linked.withColumn("linked", F.lit(True)), "node", "left")
    classes = classes.select("digest", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("rep")).alias("class_id"))
    out = sketches.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "digest").hint("merge").join(classes, "digest")
    return out.select(key, "n_shingles", "class_id", F.col(key).eqNullSafe(F.col("class_id")).alias("kept"))


def _unconnected(shared: DataFrame, found: DataFrame, close) -> tuple[DataFrame, DataFrame]:
    """The members of buckets that hold several components, with whether theirs is the bucket's largest; and, of
    buckets of up to SMALL members, the pairs of different components whose sizes permit a link."""
    named = shared.hint("merge").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("bucket", "size", "id", "n", F.coalesce("component", "id").alias("component"))
    groups = named.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    most = groups.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("most")).where("parts > 1")
    most = most.select("bucket", F.col("most.c").alias("largest_size"), F.col("most.component").alias("largest"))
    open_ = table(named.hint("merge").join(most, "bucket"))
    few = open_.where(F.col("size") <= SMALL)
    outside = few.where("component <> largest").select("bucket", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("component").alias("xc"))
    met = outside.hint("merge").join(few.select("bucket", "id", "n", "component"), "bucket").where((F.col("component") != F.col("xc")) & close(F.col("n"), F.col("xn")))
    return open_.where(F.col("size") > SMALL), met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def _tiles(members: DataFrame, size: int, *columns: str) -> DataFrame:
    """bucket, s, t, first and columns: members (bucket, id, component, out, ...) outside their bucket's largest
    component (out, the first side of tile s) meet all members (the other side of tile t)."""
    sizes = members.groupBy("bucket").agg(F.count_if("out").alias("rest"), F.count("*").alias("every")).where("rest > 0")
    base = members.hint("merge").join(sizes, "bucket")
    tiles = lambda n: F.ceil(F.col(n) / size).cast("int")
    tile = lambda n: F.pmod(F.xxhash64("id"), tiles(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    left = base.where("out").select("bucket", tile("rest").alias("s"), all_of("every").alias("t"), F.lit(True).alias("first"), *columns)
    return left.union(base.select("bucket", all_of("rest").alias("s"), tile("every").alias("t"), F.lit(False).alias("first"), *columns))


def _candidates(open_: DataFrame, copies: DataFrame, similarity: float) -> DataFrame:
    """The members of large buckets that have a promising mate in another component there: linear in the members,
    however many mates each has."""
    briefs = copies.select(F.col("node").alias("id"), "brief").hint("merge")
    rows = _tiles(open_.withColumn("out", F.col("component") != F.col("largest")).join(briefs, "id"), TILE, "id", "n", "component", "brief")
    least = agreeing(similarity)

    def compare(group: pa.Table) -> pa.Table:
        sides = []
        for flag in (True, False):
            part = group.filter(pa.compute.equal(group.column("first"), flag))
            brief = np.frombuffer(b"".join(part.column("brief").to_pylist()), "<u2").reshape(-1, COMPONENTS)
            sides.append((brief, *(part.column(c).to_numpy() for c in ("id", "n", "component"))))
        (sa, ia, na, ca), (sb, ib, nb, cb) = sides
        left, right = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
        for i in range(len(ia)):
            j = np.flatnonzero((cb != ca[i]) & (np.minimum(nb, na[i]) >= np.maximum(nb, na[i]) * similarity))
            j = j[likely_alike(sb[j], sa[i], least)]
            left[i] = len(j)
            right[j] = True
        found = np.unique(np.concatenate([ia[left], ib[right]]))
        return pa.table({"bucket": pa.array(np.full(len(found), group.column("bucket")[0].as_py()), pa.int64()), "id": pa.array(found, pa.int64())})

    return rows.groupBy("bucket", "s", "t").applyInArrow(compare, "bucket long, id long").distinct()


def _tiled(open_: DataFrame, copies: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components in large buckets, exactly: a task multiplies the incidence matrices of two
    tiles' shingles and returns a link for each document and component, not all pairs."""
    wanted = table(_candidates(open_, copies, similarity))
    members = open_.hint("merge").join(wanted, ["bucket", "id"]).select("bucket", "id", "component", (F.col("component") != F.col("largest")).alias("out"))
    texts = texts_of(members.select(F.col("id").alias("node")), copies, docs).withColumnRenamed("node", "id")
    rows = table(_tiles(members, TEXT_TILE, "id", "component")).hint("merge").join(texts, "id").select("bucket", "s", "t", "first", "id", "component", "text")

    def compare(group: pa.Table) -> pa.Table:
        sides = []
        for flag in (True, False):
            part = group.filter(pa.compute.equal(group.column("first"), flag))
            r, h, c = multiset(*_shingled(part.column("text")), len(part))
            # the k-th time of a shingle is an element of its own, so common elements count as the multisets' overlap
            again = np.repeat(np.arange(len(c)), c)
            time = np.arange(len(again)) - np.repeat(np.cumsum(c) - c, c)
            h = mix(h[again] + time.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sides.append((r[again], h, np.bincount(r, weights=c, minlength=len(part)), np.array(part.column("id").to_pylist()), np.array(part.column("component").to_pylist())))
        (ra, ha, na, ia, ca), (rb, hb, nb, ib, cb) = sides
        common = np.intersect1d(ha, hb)
        overlap = np.zeros((len(ia), len(ib)), dtype=np.float32)
        for at in range(0, len(common), STRIP):
            strip = common[at : at + STRIP]
            faces = []
            for r, h, n in ((ra, ha, len(ia)), (rb, hb, len(ib))):
                k = np.minimum(np.searchsorted(strip, h), len(strip) - 1)
                hit = strip[k] == h
                face = np.zeros((n, len(strip)), dtype=np.float32)
                face[r[hit], k[hit]] = 1
                faces.append(face)
            overlap += faces[0] @ faces[1].T
        either = na[:, None] + nb[None, :] - overlap
        i, j = np.nonzero((overlap / np.maximum(either, 1) >= similarity) & (ca[:, None] != cb[None, :]))
        _, once = np.unique(np.stack([ia[i], cb[j]]), axis=1, return_index=True) if len(i) else (None, np.empty(0, np.int64))
        return pa.table({"a": pa.array(ia[i[once]], pa.int64()), "b": pa.array(ib[j[once]], pa.int64())})

    return rows.groupBy("bucket", "s", "t").applyInArrow(compare, "a long, b long")


def _shingled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    for _, _, data, offsets in chunks(column, 1 << 62):
        return shingles(*words(data, offsets), SHINGLE)
    return np.empty(0, np.int64), np.empty(0, np.uint64)
