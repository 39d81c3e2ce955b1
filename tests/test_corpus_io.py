"""Readers, sinks, mergeable metrics and stateful rounds on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.operators import states
from viaduct.sources import poses, sinks
from viaduct.streaming import rounds


def turn(a):
    return np.array([[np.cos(a), -np.sin(a), 0, a], [np.sin(a), np.cos(a), 0, 2 * a], [0, 0, 1, 3], [0, 0, 0, 1]])


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, indent=1))  # over several lines


def test_pose_files_and_estimates(spark, tmp_path):
    mats = [turn(0.3 * i) for i in range(3)]
    head = {"w": 640, "h": 480, "fl_x": 500.0, "fl_y": 501.0, "cx": 320.0, "cy": 240.0}
    frames = [{"file_path": f"images/{i}.png", "transform_matrix": mats[i].tolist()} for i in (2, 0, 1)]
    write(tmp_path / "c/s1/transforms.json", head | {"frames": frames})
    write(tmp_path / "c/s2/transforms.json", "not json")
    (tmp_path / "c/s1/da3").mkdir()
    flip = np.diag([1.0, -1, -1, 1])
    w2c = np.array([np.linalg.inv(m @ flip)[:3] for m in mats])
    np.savez(tmp_path / "c/s1/da3/pose.npz", extrinsics=w2c)
    glob = str(tmp_path / "c/*/transforms.json")
    got = poses.pose_files(spark, glob).orderBy("frame").collect()
    assert [(r["scene"], r["frame"], r["file_path"], r["w"], r["fl_y"]) for r in got] == [("s1", i, f"images/{i}.png", 640.0, 501.0) for i in range(3)]
    assert np.allclose([r["w2c"] for r in got], w2c.reshape(3, 12))
    assert [tuple(r) for r in poses.probe(spark, glob).collect()] == [("s1", 3, 640.0, 480.0)]
    both = poses.centres(poses.pose_files(spark, glob), poses.estimated(spark, str(tmp_path / "c/*/da3/pose.npz"))).collect()
    assert sorted((r["source"], r["frame"]) for r in both) == [(s, i) for s in ("estimate", "file") for i in range(3)]
    assert all(np.allclose(r["centre"], mats[r["frame"]][:3, 3]) and np.allclose(r["rotation"], w2c[r["frame"]][:, :3].ravel()) for r in both)


def test_evaluated_paths_go_round(spark, tmp_path):
    for arm in ("pred", "ref"):
        write(tmp_path / f"e/a_b_transforms_{arm}.json", {"frames": [{"transform_matrix": turn(i + (arm == "ref")).tolist()} for i in range(2)]})
    write(tmp_path / "e/other.json", {"frames": []})
    got = poses.evaluated(spark, str(tmp_path / "e/*.json"))
    assert sorted((r["entry"], r["arm"], r["frame"]) for r in got.collect()) == [("a_b", a, i) for a in ("pred", "ref") for i in range(2)]
    assert np.allclose(got.where("arm = 'ref' AND frame = 1").first()["c2w"], turn(2)[:3].ravel())
    sinks.evaluation(got, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).where("arm = 'ref'").first()
    assert back["name"] == "a_b_transforms_ref" and np.allclose(back["frames"][1]["transform_matrix"], turn(2))


def test_banks_and_their_faults(spark, tmp_path):
    def bank(name, ids, pose_ids):
        write(tmp_path / f"{name}/bank.json", {"variants": [{"variant_id": i, "knob": 0.5, "more": {"x": 1}} for i in ids]})
        if pose_ids is not None:
            np.savez(tmp_path / name / "poses.npz", cam_c2w=np.arange(len(pose_ids) * 8.0).reshape(len(pose_ids), 2, 4), variant_id=np.array(pose_ids, dtype=str))

    bank("good", ["a", "b"], ["a", "b"])
    bank("order", ["a", "b"], ["b", "a"])
    bank("rows", ["a", "b"], ["a"])
    bank("half", ["a"], None)
    bank("none", ["a"], [])
    rows, faults = poses.banks(spark, str(tmp_path))
    got = rows.orderBy("pos").collect()
    assert [(r["bank"].rpartition("/")[2], r["variant_id"], r["c2w"], r["variant"]["knob"]) for r in got] == [("good", "a", list(np.arange(8.0)), "0.5"), ("good", "b", list(np.arange(8.0, 16)), "0.5")]
    assert json.loads(got[0]["variant"]["more"]) == {"x": 1}
    assert {r["bank"].rpartition("/")[2]: r["reason"] for r in faults.collect()} == {"order": "order", "rows": "rows", "half": "missing", "none": "missing"}


def test_masks_tracks_and_lists(spark, tmp_path):
    masks = np.random.default_rng(0).random((2, 5, 11)) < 0.2
    masks[1, 3] = False
    np.savez(tmp_path / "m.npz", masks=np.packbits(masks, axis=-1))
    got = {(r["item"], r["row"]): list(r["on"]) for r in poses.packed_bits(spark, str(tmp_path / "m.npz"), "masks", 11).collect()}
    assert got == {(i, j): list(np.flatnonzero(masks[i, j])) for i in range(2) for j in range(5) if masks[i, j].any()}
    np.savez(tmp_path / "none.npz", masks=np.zeros((2, 3, 2), dtype=np.uint8), extrinsics=np.zeros((0, 3, 4)))
    assert poses.packed_bits(spark, str(tmp_path / "none.npz"), "masks", 11).count() == 0 and poses.estimated(spark, str(tmp_path / "none.npz"), 1).count() == 0
    write(tmp_path / "b/v/meta.json", {"frames": [[], [{"id": 7, "keyword": "cup", "score": 0.5, "box_xyxy": [0, 1, 2, 3]}, {"id": 1, "keyword": "man", "score": 1, "box_xyxy": []}]]})
    assert sorted((r["bundle"], r["frame"], r["slot"], r["track"], r["keyword"]) for r in poses.tracks(spark, str(tmp_path / "b/*/meta.json")).collect()) == [("v", 1, 0, 7, "cup"), ("v", 1, 1, 1, "man")]
    assert sorted(r["scene"] for r in poses.scene_list(spark, str(tmp_path), "meta.json").collect()) == ["b/v"]
    assert poses.shards("0000-0002, 0007,1") == [0, 1, 2, 7] and poses.shards("") == []
    with pytest.raises(ValueError, match="wrong way"):
        poses.shards("3-1")
    known = spark.createDataFrame([("x",), ("y",), ("y",)], "v string")
    write(tmp_path / "list.txt", "y\n\nz\n")
    for spec, want in ((None, ["x", "y"]), ("x, q", ["x"]), (str(tmp_path / "list.txt"), ["y"])):
        assert sorted(r["v"] for r in poses.resolved(spark, spec, known, "v").collect()) == want
    write(tmp_path / "cap/s/prompts.json", {"0": {"concise": "one"}, "1": {"long": "none"}})
    write(tmp_path / "cap/t/u/prompts.json", {"5": {"concise": "two"}})
    write(tmp_path / "cap/bad/prompts.json", "{")
    assert sorted(map(tuple, poses.captions(spark, str(tmp_path / "cap")).collect())) == [("s", "0", "one"), ("u", "5", "two")]
    with pytest.raises(FileNotFoundError):
        poses.captions(spark, str(tmp_path / "b"))


def test_sinks_of_the_corpus(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 5.0), ("t", 0, None)], "scene string, seg int, v double")
    sinks.blacklist(rows, ["scene", "seg"], {"low": F.col("v") < 2, "none": F.col("v").isNull(), "odd": F.col("seg") == 0}, at("black"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(at("black")).collect())) == [("s", "0", "low", "low odd"), ("t", "0", "none", "none odd")]
    sinks.corpus(rows, at("corpus"), "scene")
    assert spark.read.parquet(at("corpus")).where("scene = 't'").count() == 1
    calls = []
    build = lambda: calls.append(1) or rows
    for config in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1, "b": 3}):
        assert sinks.indexed(spark, build, at("index"), config).count() == 3
    assert len(calls) == 2
    fixes = spark.createDataFrame([("s", 0, None), ("s", 1, 6.0), ("z", 9, 1.0)], "scene string, seg int, v double")
    new = spark.read.parquet(sinks.column_rewritten(rows, fixes, ["scene", "seg"], "v", at("fixed"), "2"))
    assert sorted(map(str, (tuple(r) for r in new.collect()))) == ["('s', 0, None)", "('s', 1, 6.0)", "('t', 0, None)"]
    sinks.metrics(rows, rows.agg(F.avg("v").alias("mean"), F.count("*").alias("n")), at("metrics"))
    assert json.loads(spark.read.text(at("metrics/metrics")).first()[0]) == {"mean": 3.0, "n": 3}
    assert {r["set_mean"] for r in spark.read.option("header", True).csv(at("metrics/samples")).collect()} == {"3.0"}
    sinks.with_provenance(rows, "scene", at("prov"), "1")
    assert {(r["source"], r["count"]) for r in spark.read.json(at("prov/provenance")).collect()} == {("s", 2), ("t", 1)}
    value = lambda df, x: df.select("scene", "seg", F.lit(x).alias("value"))
    sinks.scalars(value(rows.where("scene = 's'"), 1.0), ["scene", "seg"], at("scale"))
    assert {tuple(r) for r in sinks.scalars(value(rows, 2.0), ["scene", "seg"], at("scale")).collect()} == {("s", 0, 1.0), ("s", 1, 1.0), ("t", 0, 2.0)}
    assert {r["value"] for r in sinks.scalars(value(rows, 3.0), ["scene", "seg"], at("scale"), again=True).collect()} == {3.0}
    kept, counts = sinks.quarantined(rows, spark.createDataFrame([("s",), ("q",)], "scene string"), ["scene"], at("quarantine"))
    assert tuple(counts.first()) == (1, 1) and kept.count() == 1 and spark.read.parquet(at("quarantine")).count() == 2


def test_metric_states_merge_resume_and_compute(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(f"g{i % 3}", None if i % 11 == 0 else float(x), bool(i % 2), bool(i % 5 == 0)) for i, x in enumerate(r.normal(size=300))]
    df = spark.createDataFrame(rows, "g string, v double, t boolean, f boolean")
    parts = [df.where(F.expr(f"pmod(hash(v), 3) = {i}") if i else F.expr("v IS NULL OR pmod(hash(v), 3) = 0")) for i in range(3)]
    for n, make in enumerate((lambda: states.mean(("g",), F.col("v")), lambda: states.spread(("g",), F.col("v")), lambda: states.classes(("g",), F.col("t"), F.col("f")), lambda: states.median(("g",), "v"))):
        whole = {x["g"]: x for x in make().update(df).compute().collect()}
        merged = make().merge(*[make().update(p) for p in parts])
        saved = str(tmp_path / f"m{n}")
        for p in parts[:2]:
            make().update(p).save(saved)
        resumed = make().update(parts[2]).load(spark, saved)
        for got in (merged, resumed):
            for x in got.compute().collect():
                assert all(np.isclose(x[c], whole[x["g"]][c]) if c != "g" else True for c in x.asDict())
    v = [x for g, x, _, _ in rows if g == "g1" and x is not None]
    assert whole["g1"]["median"] == np.median(v) and whole["g1"]["n"] == len(v)
    with pytest.raises(ValueError, match="another kind"):
        states.mean(("g",), F.col("v")).merge(states.median(("g",), "v"))
    with pytest.raises(ValueError, match="no state"):
        states.mean(("g",), F.col("v")).update(df).reset().compute()


def test_keys_settle_when_done_or_idle(spark, tmp_path):
    write_ = lambda name, rows: spark.createDataFrame([(k, f"2026-01-01 00:{m:02d}:00", d) for k, m, d in rows], "k string, at string, d boolean").selectExpr("k", "to_timestamp(at) AS at", "d").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    seen = []

    def run():
        stream = spark.readStream.schema("k string, at timestamp, d boolean").parquet(str(tmp_path / "in/*"))
        out = rounds.settled(stream, "k", "at", F.col("d"), "0 seconds", 300)
        out.writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend((r["k"], r["first"].minute, r["last"].minute, r["n"], r["ending"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    write_("1", [("a", 0, False), ("a", 2, False), ("b", 1, False)])
    run()
    write_("2", [("b", 3, True), ("c", 20, False)])
    run()  # a restarted query goes on with the states of the first
    write_("3", [("c", 21, False), ("d", 40, False)])
    run()
    assert sorted(seen) == [("a", 0, 2, 2, "idle"), ("b", 1, 3, 2, "finished"), ("c", 20, 21, 2, "idle")]


def test_listed_keys_are_run_again(spark, tmp_path):
    target = str(tmp_path / "out")
    inputs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    listed = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    first = rounds.rerun(inputs, listed("a", "b", "c"), "k", target, lambda df: df.withColumn("w", F.col("v")))
    assert sorted(map(tuple, first.collect())) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]
    again = rounds.rerun(inputs, listed("b", "q"), "k", target, lambda df: df.withColumn("w", 10 * F.col("v")))
    assert sorted(map(tuple, again.collect())) == [("a", 1, 1), ("b", 2, 20), ("c", 3, 3)]


def test_actions_cameras_and_manifests(spark, tmp_path):
    write(tmp_path / "Actions/seq1.txt", "1\t5\twalk \n\nbad line\nx\t6\t9\tturn\tleft\r\n7\t\t8\tsit\nq\tr\ts\n")
    got = sorted(map(tuple, poses.actions(spark, str(tmp_path / "Actions/*.txt")).collect()), key=lambda r: r[1])
    assert got == [("seq1", 1, 1, 5, "walk"), ("seq1", 2, 6, 9, "turn\tleft"), ("seq1", 3, 7, 8, "sit"), ("seq1", 4, None, None, "s")]
    turned = turn(0.5)
    write(tmp_path / "cam/s/cameras.json", [{"rotation": turned[:3, :3].tolist(), "position": turned[:3, 3].tolist(), "fx": 1.0, "fy": 2.0, "cx": 3.0, "cy": 4.0}])
    row = poses.cameras(spark, str(tmp_path / "cam/*/cameras.json")).first()
    assert (row["scene"], row["view"], row["fy"], row["cx"]) == ("s", 0, 2.0, 3.0) and np.allclose(row["w2c"], turned[:3].ravel())
    for name, data in (("r1/manifest_a01.json", {"video": "v", "n": 1}), ("r1/manifest_a02.json", {"video": "v", "n": 2}), ("r2/manifest_a01.json", {"video": "w"}), ("r2/manifest_a02.json", {"other": 1}), ("r2/manifest_a03.json", "{")):
        write(tmp_path / "work" / name, data)
    got = {r["video"]: (r["recording"], r["chunk"], json.loads(r["manifest"]).get("n")) for r in poses.manifests(spark, str(tmp_path / "work")).collect()}
    assert got == {"v": ("r1", "02", 2), "w": ("r2", "01", None)}


def test_shots_with_reasons(spark, tmp_path):
    def shot(name, n=3, first=1, mats=None, caption='{"a": 1}', raw=None):
        frames = [{"monst3r_im_id": first + i, "transform_matrix": (mats or [turn(j) for j in range(n)])[i].tolist()} for i in range(n)]
        write(tmp_path / f"{name}_transforms_cleaning.json", raw or {"frames": frames})
        if caption:
            write(tmp_path / f"{name}_caption.json", caption)

    shot("a/good")
    shot("a/few", n=2)
    shot("b/ids", first=0)
    shot("b/bad", mats=[turn(0), turn(0), turn(0) * np.nan])
    shot("b/cap", caption=None)
    shot("b/raw", raw="no")
    got = {r["shot"].rpartition("/")[2]: r for r in poses.shots(spark, str(tmp_path), 3).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"good": None, "few": "frames", "ids": "ids", "bad": "poses", "cap": "caption", "raw": "unreadable"}
    c = np.array([turn(j)[:3, 3] for j in range(3)])
    assert got["good"]["ok"] and np.isclose(got["good"]["mean_disp"], np.linalg.norm(c - c[0], axis=1).mean()) and json.loads(got["good"]["caption"]) == {"a": 1}
