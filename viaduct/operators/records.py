"""Records: rule sets by version, preferred records, combinations, padded series, comparisons of siblings, run names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators import metrics as M

#: Settings of a version by name; "from" names the version that it changes.
Versions = dict[str, dict]


def settings(versions: Versions, name: str) -> dict:
    """A version's settings with those that it takes over."""
    seen, chain = set(), []
    while name is not None:
        if name in seen or name not in versions:
            raise ValueError(f"version {name} is unknown or takes over from itself")
        seen.add(name)
        chain.append(versions[name])
        name = versions[name].get("from")
    return {k: v for part in reversed(chain) for k, v in part.items() if k != "from"}


def judged(rows: DataFrame, versions: Versions, name: str, rules: Callable[[dict], dict[str, Column]]) -> DataFrame:
    """rows with version, reasons (all that hold, in the order of the rules) and keep. rules gives reasons by the settings,
    so that a version may drop a rule or change its threshold."""
    named = rules(settings(versions, name)).items()
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(reason)) for reason, broken in named])) if named else F.array().cast("array<string>")
    return rows.withColumns({"version": F.lit(name), "reasons": reasons}).withColumn("keep", F.size("reasons") == 0)


def version_counts(rows: DataFrame, versions: Versions, rules: Callable[[dict], dict[str, Column]]) -> DataFrame:
    """version, reason, n: how many rows each rule of each version rejects, and under the reason kept how many none does; one
    pass for all versions."""
    counts = []
    for name in versions:
        named = rules(settings(versions, name))
        fine = F.lit(True)
        for broken in named.values():
            fine = fine & ~F.coalesce(broken, F.lit(False))
        counts += [F.struct(F.lit(name).alias("version"), F.lit(reason).alias("reason"), F.count_if(broken).alias("n")) for reason, broken in (named | {"kept": fine}).items()]
    return rows.agg(F.array(*counts).alias("_c")).select(F.inline("_c"))


def preferred(rows: DataFrame, key: str, mode: str, wanted: str, order: list[str], columns: list[str]) -> DataFrame:
    """One record a key: the last one of the wanted mode, else the first one of any; columns and its mode."""
    record, place = F.struct(mode, *columns), F.struct(*order)
    best = F.coalesce(F.max_by(F.when(F.col(mode) == wanted, record), F.when(F.col(mode) == wanted, place)), F.min_by(record, place))
    return rows.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def combinations(rows: DataFrame, key: str, member: str) -> DataFrame:
    """combination (the distinct members of a key, sorted, joined by +) and n, the keys that have it."""
    held = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), "+").alias("combination"))
    return held.groupBy("combination").agg(F.count("*").alias("n"))


def padded(rows: DataFrame, key: str, order: list[str], value: str, length: int, fill: float = 0.0) -> DataFrame:
    """key, values (the first `length` of a key, filled up), mask (which are its own), n (all that it has). At most length
    rows of a key are brought together."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    few = rows.withColumn("_r", place).where(F.col("_r") <= length)
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    held = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(value).cast("double").alias("v")))).alias("_v"))
    own = F.transform("_v", lambda x: x["v"])
    rest = length - F.size("_v")
    return held.join(n, key).select(key, F.concat(own, F.array_repeat(F.lit(float(fill)), rest)).alias("values"), F.concat(F.transform("_v", lambda _: F.lit(True)), F.array_repeat(F.lit(False), rest)).alias("mask"), "n")


def compared(rows: DataFrame, scene: str, frame: str, track: str, label: str) -> DataFrame:
    """scene, track, other, shared, lines: how each track of a scene stands to each other one over the frames in which both
    are seen: side, size and depth, with the share of frames that agree. rows: scene, frame, track, cx, area, depth and a
    label, one a frame. Tracks meet in their frames only; a pair without a shared frame says so."""
    seen = rows.where("area > 0").select(scene, frame, track, "cx", "area", "depth")
    other = seen.select(scene, frame, F.col(track).alias("other"), *[F.col(c).alias(f"_{c}") for c in ("cx", "area", "depth")])
    met = seen.join(other, [scene, frame]).where(F.col(track) != F.col("other"))
    share = lambda c: F.avg(c.cast("int"))
    per = met.groupBy(scene, track, "other").agg(F.count("*").alias("shared"), share(F.col("cx") < F.col("_cx")).alias("left"), share(F.col("area") > F.col("_area")).alias("bigger"), share(F.col("depth") < F.col("_depth")).alias("nearer"), F.median(F.col("area") / F.greatest("_area", F.lit(1e-9))).alias("ratio"))
    names = rows.groupBy(scene, track).agg(F.min(label).alias("_l"))
    pairs = names.join(names.select(scene, F.col(track).alias("other"), F.col("_l").alias("name")), scene).where(F.col(track) != F.col("other")).drop("_l")
    percent = lambda c: F.concat(F.bround(100 * F.greatest(F.col(c), 1 - F.col(c))).cast("int").cast("string"), F.lit("%"))
    times = F.bround(F.greatest("ratio", 1 / F.greatest("ratio", F.lit(1e-9))), 1).cast("string")
    lines = F.array(
        F.concat(F.lit("- it is to the "), F.when(F.col("left") >= 0.5, "LEFT").otherwise("RIGHT"), F.lit(" of "), "name", F.lit(" in "), percent("left"), F.lit(" of the frames they share")),
        F.concat(F.lit("- it looks "), F.when(F.col("ratio") >= 1, "BIGGER").otherwise("SMALLER"), F.lit(": "), times, F.lit("x the on-screen area of "), "name", F.lit(" ("), percent("bigger"), F.lit(" of frames)")),
        F.concat(F.lit("- it is "), F.when(F.col("nearer") >= 0.5, "NEARER to").otherwise("FURTHER from"), F.lit(" the viewpoint than "), "name", F.lit(" ("), percent("nearer"), F.lit(" of frames)")),
    )
    never = F.array(F.concat(F.lit("- it never appears at the same time as "), "name"))
    out = pairs.join(per, [scene, track, "other"], "left")
    return out.select(scene, track, "other", F.coalesce("shared", F.lit(0)).alias("shared"), F.when(F.col("shared").isNull(), never).otherwise(lines).alias("lines"))


def coverage(targets: DataFrame, selected: DataFrame, key: list[str], view: str, rho: float, degrees: float) -> DataFrame:
    """key, frames, covered: the share of a segment's views that have one of its few selected views within rho times its
    scale, looking the same way within so many degrees. targets: key, view, centre, forward, scale; selected: key, centre,
    forward. A segment without selected views is covered by none."""
    few = selected.groupBy(*key).agg(F.collect_list(F.struct("centre", "forward")).alias("_s"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    hit = F.exists("_s", lambda s: (gap(F.col("centre"), s["centre"]) / F.col("scale") <= rho) & (dot(F.col("forward"), s["forward"]) >= float(np.cos(np.radians(degrees)))))
    met = targets.join(few, key, "left")
    return met.groupBy(*key).agg(F.count(view).alias("frames"), F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("covered"))


def set_angles(left: DataFrame, right: DataFrame, group: str, id_: str, quaternion: str) -> DataFrame:
    """group, id, mean, least: degrees from each rotation on the left (unit quaternions) to those on the right of its group.
    Both need pos; tiles of the two sets meet, and their sums are added."""
    kinds = left.schema[group].dataType.simpleString(), left.schema[id_].dataType.simpleString()

    def compare(g, x, y, a, b):
        d = np.degrees(2 * np.arccos(np.minimum(np.abs(a @ b.T), 1.0)))
        return pd.DataFrame({group: g, id_: x["id"], "total": d.sum(axis=1), "least": d.min(axis=1), "n": len(b)})

    found = M.met(M.tiles(left, group, id_, quaternion), M.tiles(right, group, id_, quaternion), group, compare, f"{group} {kinds[0]}, {id_} {kinds[1]}, total double, least double, n long")
    return found.groupBy(group, id_).agg((F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("least"))


def run_parts(name: Column) -> Column:
    """struct(at, name) of a run name that begins with yyyyMMdd_HHmmss_; at is null, and the name whole, where it doesn't."""
    stamp = F.regexp_extract(name, r"^(\d{8}_\d{6})_(.+)$", 1)
    at = F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd_HHmmss"))
    return F.struct(at.alias("at"), F.when(at.isNull(), name).otherwise(F.regexp_extract(name, r"^(\d{8}_\d{6})_(.+)$", 2)).alias("name"))
