"""Readers of poses, banks and masks. Spark lists, reads and splits the files, so any store that it reads will do, and a
file is one row until it is taken apart; what a caller doesn't select isn't parsed or unpacked."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import rotations as R

#: Columns of a pose file's head.
HEAD = "w double, h double, fl_x double, fl_y double, cx double, cy double"


def folder(path: Column, up: int = 1) -> Column:
    """The name of the folder so many levels above a path's last part."""
    return F.element_at(F.split(path, "/"), -1 - up)


def whole(spark: SparkSession, paths) -> DataFrame:
    """path and value (the whole text) of JSON files, a row a file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def binary(spark: SparkSession, paths) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def from_graphics(c2w: Column) -> Column:
    """A camera-to-world pose whose y points up and z back, with y down and z ahead."""
    return R.let(c2w, lambda m: F.transform(m, lambda x, i: F.when((i % 4 == 1) | (i % 4 == 2), -x).otherwise(x)))


def _flat(matrix: Column) -> Column:
    """The first three rows of a 3 x 4 or 4 x 4 matrix, end to end."""
    return F.flatten(F.slice(matrix, 1, 3))


def pose_files(spark: SparkSession, paths) -> DataFrame:
    """scene (the file's folder), frame (from 0, by file_path), file_path, w2c (twelve numbers, y down and z ahead), w, h,
    fl_x, fl_y, cx, cy of pose files in JSON; files that aren't such JSON give no rows. Poses are taken as rigid."""
    schema = f"{HEAD}, frames array<struct<file_path string, transform_matrix array<array<double>>>>"
    parsed = whole(spark, paths).select(folder(F.col("path")).alias("scene"), F.from_json("value", schema).alias("r"))
    frames = parsed.select("scene", "r.*").select("scene", F.posexplode(F.array_sort("frames")).alias("frame", "f"), *[c.split()[0] for c in HEAD.split(", ")])
    return frames.select("scene", "frame", "f.file_path", R.inverse_pose(from_graphics(_flat(F.col("f.transform_matrix")))).alias("w2c"), "w", "h", "fl_x", "fl_y", "cx", "cy")


def probe(spark: SparkSession, paths) -> DataFrame:
    """scene, frames (their number), w, h of pose files; matrices aren't parsed."""
    parsed = whole(spark, paths).select(folder(F.col("path")).alias("scene"), F.from_json("value", "w double, h double, frames array<struct<file_path string>>").alias("r"))
    return parsed.where("r.frames IS NOT NULL").select("scene", F.size("r.frames").alias("frames"), "r.w", "r.h")


def estimated(spark: SparkSession, paths, up: int = 2) -> DataFrame:
    """scene (the folder `up` levels above the file), frame, w2c of .npz files with extrinsics (N, 3, 4)."""

    def unpack(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    a = np.asarray(z["extrinsics"], dtype=float)[:, :3, :4].reshape(-1, 12)
                if len(a):
                    yield pd.DataFrame({"path": path, "frame": np.arange(len(a)), "w2c": list(a)})

    rows = binary(spark, paths).mapInPandas(unpack, "path string, frame int, w2c array<double>")
    return rows.select(folder(F.col("path"), up).alias("scene"), "frame", "w2c")


def centres(files: DataFrame, estimates: DataFrame) -> DataFrame:
    """scene, source (file or estimate), frame, centre, rotation (of w2c) from both readers."""
    both = files.select("scene", "frame", "w2c", F.lit("file").alias("source")).unionByName(estimates.select("scene", "frame", "w2c", F.lit("estimate").alias("source")))
    return both.select("scene", "source", "frame", R.translation_of(R.inverse_pose(F.col("w2c"))).alias("centre"), R.rotation_of(F.col("w2c")).alias("rotation"))


def evaluated(spark: SparkSession, paths) -> DataFrame:
    """entry, arm (pred or ref), frame, c2w of files named <entry>_transforms_<arm>.json, in their order of frames."""
    name = F.element_at(F.split("path", "/"), -1)
    parsed = whole(spark, paths).select(name.alias("name"), F.from_json("value", "frames array<struct<transform_matrix array<array<double>>>>").alias("r"))
    parts = parsed.select(F.regexp_extract("name", r"^(.*)_transforms_(pred|ref)\.json$", 1).alias("entry"), F.regexp_extract("name", r"^(.*)_transforms_(pred|ref)\.json$", 2).alias("arm"), F.posexplode("r.frames").alias("frame", "f"))
    return parts.where("arm <> ''").select("entry", "arm", "frame", _flat(F.col("f.transform_matrix")).alias("c2w"))


def banks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of folders below root that hold bank.json and poses.npz. rows: bank (the folder), pos, variant_id,
    variant (its fields as text), c2w; faults: bank and reason (missing, rows: the numbers differ, order: the ids differ),
    and a bank with a fault gives no rows, as a path on the wrong row would not be seen."""
    glob = lambda df, name: df.where(F.element_at(F.split("path", "/"), -1) == name).withColumn("bank", F.regexp_extract("path", r"^(?:file:)?/*(.*)/[^/]+$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{bank.json,poses.npz}").load(root)
    listed = glob(files.select("path", F.decode("content", "utf-8").alias("value")), "bank.json").select("bank", F.from_json("value", "variants array<map<string, string>>").alias("r"))
    variants = listed.select("bank", F.posexplode_outer("r.variants").alias("pos", "variant")).where("pos IS NOT NULL")

    def unpack(batches):
        for pdf in batches:
            for bank, content in zip(pdf["bank"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    a, ids = np.asarray(z["cam_c2w"], dtype=float), [str(v) for v in z["variant_id"]]
                if not len(a):
                    continue
                flat = a.reshape(len(a), -1)
                yield pd.DataFrame({"bank": bank, "pos": np.arange(len(a)), "pose_id": ids[: len(a)] + [None] * (len(a) - len(ids)), "c2w": list(flat)})

    poses = glob(files.select("path", "content"), "poses.npz").select("bank", "content").mapInPandas(unpack, "bank string, pos int, pose_id string, c2w array<double>")
    met = variants.withColumn("variant_id", F.col("variant")["variant_id"]).join(poses, ["bank", "pos"], "full")
    state = met.groupBy("bank").agg(F.count("variant").alias("v"), F.count("c2w").alias("p"), F.count_if(~F.col("variant_id").eqNullSafe(F.col("pose_id"))).alias("wrong"))
    why = F.when((F.col("v") == 0) | (F.col("p") == 0), "missing").when(F.col("v") != F.col("p"), "rows").when(F.col("wrong") > 0, "order")
    faults = state.select("bank", why.alias("reason")).where("reason IS NOT NULL")
    return met.join(faults, "bank", "left_anti").select("bank", "pos", "variant_id", "variant", "c2w"), faults


def packed_bits(spark: SparkSession, paths, name: str, width: int) -> DataFrame:
    """path, item, row, on (the columns that are set) of arrays of bits in .npz files, packed along their last axis of so
    many columns; rows without a bit give none. (N, H, packed) or (H, packed: item 0)."""

    def unpack(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    a = z[name]
                a = a[None] if a.ndim == 2 else a
                for item, packed in enumerate(a):
                    bits = np.unpackbits(packed, axis=-1)[:, :width]
                    rows = np.flatnonzero(bits.any(axis=1))
                    if not len(rows):
                        continue
                    yield pd.DataFrame({"path": path, "item": item, "row": rows, "on": [np.flatnonzero(bits[r]) for r in rows]})

    return binary(spark, paths).mapInPandas(unpack, "path string, item int, row int, on array<int>")


def tracks(spark: SparkSession, paths) -> DataFrame:
    """bundle (the folder), frame, slot, track, keyword, score, box of bundles' meta.json files."""
    schema = "frames array<array<struct<id: int, keyword: string, score: double, box_xyxy: array<double>>>>"
    parsed = whole(spark, paths).select(folder(F.col("path")).alias("bundle"), F.from_json("value", schema).alias("r"))
    frames = parsed.select("bundle", F.posexplode("r.frames").alias("frame", "s")).select("bundle", "frame", F.posexplode("s").alias("slot", "i"))
    return frames.select("bundle", "frame", "slot", F.col("i.id").alias("track"), "i.keyword", "i.score", F.col("i.box_xyxy").alias("box"))


def shards(spec: str) -> list[int]:
    """The numbers of a list of shards and ranges of shards, both ends included: "0000-0002,0007" is 0, 1, 2, 7."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        first, last = int(low), int(high or low)
        if last < first:
            raise ValueError(f"range of shards the wrong way round: {part}")
        out.update(range(first, last + 1))
    return sorted(out)


def scene_list(spark: SparkSession, root: str, name: str, depth: int = 2) -> DataFrame:
    """scene: the last `depth` folders' names of every file of this name below root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    parts = F.split("path", "/")
    return files.select(F.concat_ws("/", F.slice(parts, F.size(parts) - depth, depth)).alias("scene")).distinct()


def resolved(spark: SparkSession, spec: str | None, known: DataFrame, key: str) -> DataFrame:
    """The keys to work on: those of a list file (spec ends in .txt), of a comma-separated list, or, without spec, all
    known ones; keys that aren't known drop out."""
    if spec is None:
        return known.select(key).distinct()
    rows = spark.read.text(spec).select(F.trim("value").alias(key)) if spec.endswith(".txt") else spark.createDataFrame([(x.strip(),) for x in spec.split(",")], f"{key} string")
    return rows.where(F.col(key) != "").distinct().join(known.select(key).distinct(), key, "left_semi")


def captions(spark: SparkSession, root: str, name: str = "prompts.json", field: str = "concise") -> DataFrame:
    """scene, key, caption of caption files one or two folders below root. No file at all is an error; a file that can't be
    parsed is left out."""
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    text = text.select(F.col("_metadata.file_path").alias("path"), "value")
    if text.isEmpty():
        raise FileNotFoundError(f"no {name} below {root}")
    entries = text.select(folder(F.col("path")).alias("scene"), F.from_json("value", f"map<string, struct<{field}: string>>").alias("m"))
    return entries.select("scene", F.explode("m").alias("key", "e")).select("scene", "key", F.col(f"e.{field}").alias("caption")).where("caption IS NOT NULL")


def actions(spark: SparkSession, paths) -> DataFrame:
    """sequence (the file's name), id (1, 2, ... among its good lines), start, end, text of files of tab-separated lines:
    start, end, text, or something, start, end, text (which may hold tabs). Empty fields don't count; other lines are left
    out, and numbers that aren't any are null."""
    lines = F.transform(F.split("value", "\n"), lambda x: F.filter(F.split(F.regexp_replace(x, "\r$", ""), "\t"), lambda p: p != ""))
    good = F.filter(lines, lambda p: F.size(p) >= 3)
    parsed = whole(spark, paths).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("sequence"), F.posexplode(good).alias("_i", "p"))
    four = (F.size("p") > 3).cast("int")
    field = lambda i: F.get("p", four + i)
    return parsed.select("sequence", (F.col("_i") + 1).alias("id"), field(0).try_cast("int").alias("start"), field(1).try_cast("int").alias("end"), F.trim(F.array_join(F.slice("p", four + 3, F.size("p")), "\t")).alias("text"))


def cameras(spark: SparkSession, paths) -> DataFrame:
    """scene (the file's folder), view (its place), w2c, fx, fy, cx, cy of JSON files that hold a list of cameras with
    rotation and position (both of w2c)."""
    schema = "array<struct<rotation: array<array<double>>, position: array<double>, fx: double, fy: double, cx: double, cy: double>>"
    parsed = whole(spark, paths).select(folder(F.col("path")).alias("scene"), F.posexplode(F.from_json("value", schema)).alias("view", "c"))
    return parsed.select("scene", "view", R.pose_of(F.flatten("c.rotation"), F.col("c.position")).alias("w2c"), "c.fx", "c.fy", "c.cx", "c.cy")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """video, recording (the folder), chunk (from the name manifest_aNN.json), manifest (the text) of the manifests below
    root; of one video's the last by recording and chunk. Files that aren't JSON or name no video are left out."""
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="manifest_a*.json")
    parsed = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("manifest"), F.from_json("value", "video string").alias("j"))
    named = parsed.select(F.nullif(F.trim("j.video"), F.lit("")).alias("video"), folder(F.col("path")).alias("recording"), F.regexp_extract("path", r"manifest_a([^/]*)\.json$", 1).alias("chunk"), "manifest").where("video IS NOT NULL")
    last = F.max_by(F.struct("recording", "chunk", "manifest"), F.struct("recording", "chunk")).alias("_m")
    return named.groupBy("video").agg(last).select("video", "_m.*")


def shots(spark: SparkSession, root: str, poses: int = 120) -> DataFrame:
    """shot (the path before _transforms_cleaning.json), ok, reason, mean_disp (mean distance of the centres from the first)
    and caption of all shots below root. A shot is out, with the first reason that holds: unreadable, frames (not as many as
    poses), ids (of its frames not 1, 2, ...), poses (not finite), caption (none)."""
    read = lambda name: spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{name}").select(F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*){name}$", 1).alias("shot"), "value")
    schema = "frames array<struct<monst3r_im_id: int, transform_matrix: array<array<double>>>>"
    rows = read("_transforms_cleaning.json").select("shot", F.from_json("value", schema)["frames"].alias("f"))
    rows = rows.join(read("_caption.json").select("shot", F.col("value").alias("caption")), "shot", "left")
    flat = F.flatten(F.flatten(F.transform("f", lambda x: x["transform_matrix"])))
    wrong = F.exists(flat, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.exists("f", lambda x: x["transform_matrix"].isNull())
    ids = F.transform("f", lambda x: x["monst3r_im_id"]) != F.sequence(F.lit(1), F.lit(poses))
    why = F.when(F.col("f").isNull(), "unreadable").when(F.size("f") != poses, "frames").when(F.coalesce(ids, F.lit(True)), "ids").when(wrong, "poses").when(F.try_parse_json("caption").isNull(), "caption")
    centre = lambda x: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: x["transform_matrix"][i][3])
    far = lambda c: F.sqrt(F.aggregate(F.zip_with(c, centre(F.col("f")[0]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    mean = F.aggregate(F.transform("f", lambda x: far(centre(x))), F.lit(0.0), lambda s, v: s + v) / F.size("f")
    judged = rows.withColumn("reason", why)
    return judged.select("shot", F.col("reason").isNull().alias("ok"), "reason", F.when(F.col("reason").isNull(), mean).alias("mean_disp"), F.when(F.col("reason").isNull(), F.col("caption")).alias("caption"))
