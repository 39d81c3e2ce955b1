"""Joins of pairs, intervals, neighbours and lookups, and merges of lists, caches and tracks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators import metrics as M


def paired(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Rows of both sides of a key, as left_value and right_value; keys of one side only are left out."""
    return left.select(*on, F.col(value).alias("left_value")).join(right.select(*on, F.col(value).alias("right_value")), on)


def same_shape(rows: DataFrame, entry: str, arm: str, arms: int) -> DataFrame:
    """Entries that every arm has with one and the same number of frames: entry, frames."""
    per = rows.groupBy(entry, arm).agg(F.count("*").alias("_n"))
    kept = per.groupBy(entry).agg(F.count("*").alias("_arms"), F.min("_n").alias("frames"), F.max("_n").alias("_most"))
    return kept.where((F.col("_arms") == arms) & (F.col("frames") == F.col("_most"))).select(entry, "frames")


def both_sides(pairs: DataFrame, attributes: DataFrame, key: str, ends: tuple[str, str], names: list[str]) -> DataFrame:
    """pairs with the attributes of either end, prefixed by the end's name; unknown ends have nulls."""
    out = pairs
    for end in ends:
        out = out.join(attributes.select(F.col(key).alias(end), *[F.col(n).alias(f"{end}_{n}") for n in names]), end, "left")
    return out


def overlapping(intervals: DataFrame, windows: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of an interval (key, start, end, ...) and a window (key, from, until, ...) that overlap, as an equi-join:
    each side is put in the cells of the given width that it touches, and a pair counts in the first common cell."""
    cell = lambda c: F.floor(c / width).cast("long")
    a = intervals.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    b = windows.withColumn("_cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("until")))))
    met = a.join(b, [key, "_cell"]).where((F.col("start") < F.col("until")) & (F.col("end") > F.col("from")))
    return met.where(F.col("_cell") == F.greatest(cell(F.col("start")), cell(F.col("from")))).drop("_cell")


def nearest(points: DataFrame, others: DataFrame, group: str, at: str, reach: float) -> DataFrame:
    """points with distance: to the nearest other of the group within reach, else null; by cells of the reach's width,
    so a busy group spreads over its cells."""
    cell = lambda c: F.floor(c / reach).cast("long")
    near = others.select(group, F.col(at).alias("_at"), F.explode(F.array(*[cell(F.col(at)) + d for d in (-1, 0, 1)])).alias("_cell")).distinct()
    keys = points.columns
    met = points.withColumn("_cell", cell(F.col(at))).join(near, [group, "_cell"], "left")
    d = F.abs(F.col(at) - F.col("_at"))
    return met.groupBy(*keys).agg(F.min(F.when(d <= reach, d)).alias("distance"))


def nearest_cell(points: DataFrame, cloud: DataFrame, group: str, axes: list[str], reach: float) -> DataFrame:
    """points with distance to the nearest point of the cloud within reach (null beyond), in any number of axes: a cloud
    point is put in its grid cell and the neighbouring cells of every axis."""
    near = cloud.select(group, *[F.col(a).alias(f"_{a}") for a in axes])
    for a in axes:
        near = near.withColumn(f"_c{a}", F.explode(F.array(*[F.floor(F.col(f"_{a}") / reach).cast("long") + d for d in (-1, 0, 1)])))
    cells = points.withColumns({f"_c{a}": F.floor(F.col(a) / reach).cast("long") for a in axes})
    d = F.sqrt(sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes), F.lit(0.0)))
    met = cells.join(near, [group, *[f"_c{a}" for a in axes]], "left").groupBy(*points.columns).agg(F.min(F.when(d <= reach, d)).alias("distance"))
    return met


def name_match(rows: DataFrame, nodes: DataFrame, group: str, noun: str, label: str, area: str) -> DataFrame:
    """For each row, the node of its group whose label holds the noun or is held by it (matched), else any node of the
    group; the largest area of these, then the least label."""
    met = rows.join(nodes.select(group, F.col(label).alias("_label"), F.col(area).alias("_area")), group, "left")
    hit = F.coalesce(F.contains(F.lower(noun), F.lower("_label")) | F.contains(F.lower("_label"), F.lower(noun)), F.lit(False))
    best = F.min(F.struct((~hit).alias("other"), (-F.col("_area")).alias("a"), F.col("_label").alias("label")))
    return met.groupBy(*rows.columns).agg(best.alias("_b")).select(*rows.columns, F.col("_b.label").alias("node"), (~F.col("_b.other")).alias("matched"))


def identified(clips: DataFrame, library: DataFrame, key: str, name: str, grid: str, top: int) -> DataFrame:
    """For each clip the top library entries by distance of their brightness grids. Both sides are packed into tiles; a
    task compares two tiles and hands on the top entries of each clip in them, so neither side is broadcast."""
    kinds = clips.schema[key].dataType.simpleString(), library.schema[name].dataType.simpleString()
    dealt = lambda rows, id_: rows.where(F.col(id_).isNotNull() & F.col(grid).isNotNull()).withColumns({"_g": F.lit(0), "pos": F.monotonically_increasing_id()})

    def packed(rows: DataFrame, id_: str) -> DataFrame:
        tile = F.floor(F.col("pos") / M.TILE)
        part = F.struct(F.col(id_).alias("id"), F.col(grid).cast("array<double>").alias("v"))
        return dealt(rows, id_).groupBy("_g", tile.alias("tile")).agg(F.collect_list(part).alias("_t")).select("_g", "tile", "_t.id", "_t.v")

    def compare(_, x, y, a, b):
        d = M.distances(a, b)
        out = [(x["id"][i], y["id"][j], float(d[i, j])) for i in range(len(a)) for j in sorted(range(len(b)), key=lambda j: (d[i, j], y["id"][j]))[:top]]
        return pd.DataFrame(out, columns=[key, name, "distance"])

    few = M.met(packed(clips, key), packed(library, name), "_g", compare, f"{key} {kinds[0]}, {name} {kinds[1]}, distance double")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", name))
    return few.withColumn("rank", rank).where(F.col("rank") <= top).select(key, name, "distance", "rank")


def looked_up(label: Column, aliases: dict[str, str], default: str) -> Column:
    """The alias of a label without its number suffix, of its first word, or the default."""
    bare = F.lower(F.regexp_replace(label, r"[._ ]?[0-9]+$", ""))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, bare), F.try_element_at(table, F.element_at(F.split(bare, " "), 1)), F.lit(default))


def phrase_of(nodes: DataFrame, overrides: DataFrame, on: list[str], description: str, label: str) -> DataFrame:
    """nodes with phrase: the override, else the description if it is not blank, else the label."""
    given = overrides.select(*on, F.col("phrase").alias("_given"))
    return nodes.join(given, on, "left").withColumn("phrase", F.coalesce("_given", F.when(F.trim(description) != "", F.col(description)), F.col(label))).drop("_given")


def merged_maps(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Entries of both, the new one where both have the key: a union and one grouped maximum by version."""
    every = old.select(*key, value, F.lit(0).alias("_v")).unionByName(new.select(*key, value, F.lit(1).alias("_v")))
    return every.groupBy(*key).agg(F.max_by(value, "_v").alias(value), F.max("_v").alias("updated"))


def concatenated(corpora: dict[str, DataFrame]) -> DataFrame:
    """All rows with the name of their corpus; other columns or types than the first corpus has are an error."""
    out, shape = None, None
    for name, rows in corpora.items():
        shape = shape or sorted(rows.dtypes)
        if sorted(rows.dtypes) != shape:
            raise ValueError(f"corpus {name} has {sorted(rows.dtypes)}, not {shape}")
        part = rows.withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def against_reference(rows: DataFrame, key: str, tag: str, value: str, reference: str) -> DataFrame:
    """key, tag and the value less the reference entry's; tags the reference has and the entry lacks come with missing."""
    ref = rows.where(F.col(key) == reference).select(tag, F.col(value).alias("_ref"))
    grid = rows.where(F.col(key) != reference).select(key).distinct().join(F.broadcast(ref), F.lit(True))  # tags are metric names, a bounded few
    out = grid.join(rows.select(key, tag, value), [key, tag], "left")
    return out.select(key, tag, (F.col(value) - F.col("_ref")).alias("difference"), F.col(value).isNull().alias("missing"))


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: keys only on either side and, per column, shared keys whose values differ; all 0 when they agree."""
    l = left.select(key, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    r = right.select(key, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    differ = [F.count_if(both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"differ_{c}") for c in columns]
    return l.join(r, key, "full_outer").agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), *differ)


def overlap_edges(sets: DataFrame, group: str, track: str, element: str, least: float = 0.0) -> DataFrame:
    """Edges (group, a, b, iou) of tracks of one group whose element sets overlap by IoU least or more. Tracks meet only
    over common elements, and elements of a track are distinct."""
    rows = sets.select(group, track, element).distinct()
    sizes = rows.groupBy(group, track).agg(F.count("*").alias("_n"))
    a = rows.select(group, element, F.col(track).alias("a"))
    b = rows.select(group, element, F.col(track).alias("b"))
    common = a.join(b, [group, element]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("_both"))
    sized = common.join(sizes.select(group, F.col(track).alias("a"), F.col("_n").alias("_na")), [group, "a"]).join(sizes.select(group, F.col(track).alias("b"), F.col("_n").alias("_nb")), [group, "b"])
    return sized.withColumn("iou", F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).where(F.col("iou") >= least).select(group, "a", "b", "iou")


def representatives(members: DataFrame, component: str, track: str, order: list[Column]) -> DataFrame:
    """component, representative (first in the given order) and how many members."""
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(track).alias("t")))
    return members.groupBy(component).agg(best.alias("_b"), F.count("*").alias("members")).select(component, F.col("_b.t").alias("representative"), "members")


def tight_boxes(members: DataFrame, component: str, frame: str, x: str, y: str, bits: str) -> DataFrame:
    """Per component and frame: the union of the masks (bits) and the tight box of their pixels."""
    return members.groupBy(component, frame).agg(F.bit_or(bits).alias("mask"), *[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))])


def either_hit(rows: DataFrame, others: DataFrame, key: str, hit: str) -> DataFrame:
    """Keys hit in either run, with which: a shared blacklist."""
    a, b = rows.select(key, F.col(hit).alias("first")), others.select(key, F.col(hit).alias("second"))
    met = a.join(b, key, "full_outer").select(key, F.coalesce("first", F.lit(False)).alias("first"), F.coalesce("second", F.lit(False)).alias("second"))
    return met.where("first OR second")


def merged_caches(caches: list[DataFrame], text: str, length: str, order: str) -> DataFrame:
    """First cache wins for each text; offsets of the kept entries are their lengths summed in (cache, order)."""
    every = None
    for i, c in enumerate(caches):
        part = c.select(text, length, order).withColumn("cache", F.lit(i))
        every = part if every is None else every.unionByName(part)
    kept = every.groupBy(text).agg(F.min(F.struct("cache", order, length)).alias("_f")).select(text, "_f.*")
    # offsets: the sum over earlier caches and, within one, over earlier entries, by blocks of the order so that no task sees all
    block = kept.withColumn("_block", F.floor(F.col(order) / 1024))
    sums = block.groupBy("cache", "_block").agg(F.sum(length).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("cache", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("cache", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.join(before, ["cache", "_block"]).withColumn("offset", F.col("_before") + inside).drop("_before", "_block")


def compatible_union(main: DataFrame, extra: DataFrame, header: list[str], key: str) -> DataFrame:
    """main and those rows of extra whose header values some row of main has and whose key main lacks."""
    fits = extra.join(main.select(*header).distinct(), header, "left_semi").join(main.select(key), key, "left_anti")
    return main.withColumn("added", F.lit(False)).unionByName(fits.withColumn("added", F.lit(True)))


def distinct_in_order(words: Column) -> Column:
    """Trimmed lower-case words without repeats or blanks, first places kept."""
    return F.array_distinct(F.filter(F.transform(words, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
