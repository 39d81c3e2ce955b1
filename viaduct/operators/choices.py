"""Choices that rank, split, sample and spread: ties end in a key, draws are md5 orders, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.measures import turn_gap
from viaduct.operators.dedup import checkpointed


def draw(seed: str, *key: Column | str) -> Column:
    """A text that orders rows at random but the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]).cast("binary"))


def one_each(rows: DataFrame, key: list[str], id_: str, seed: str) -> DataFrame:
    """One row drawn for each key: a grouped minimum, which combines before the shuffle."""
    best = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in key]), F.struct(draw(seed, *key, id_), F.col(id_)))
    return rows.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def anchors(rows: DataFrame, scene: str, id_: str, moving: str, area: str, frames: str, most_moving: int, most_still: int, most: int) -> DataFrame:
    """Anchors of a scene: moving first, then by area and frames; caps for moving and still ones, and for all."""
    order = [F.desc(area), F.desc(frames), F.asc(id_)]
    kind = F.row_number().over(Window.partitionBy(scene, moving).orderBy(*order))
    few = rows.withColumn("_k", kind).where(F.col("_k") <= F.when(F.col(moving), most_moving).otherwise(most_still))
    rank = F.row_number().over(Window.partitionBy(scene).orderBy(F.desc(moving), *order))
    return few.withColumn("rank", rank).where(F.col("rank") <= most).drop("_k")


def restored(chosen: DataFrame, pool: DataFrame, scene: str, id_: str, score: str) -> DataFrame:
    """chosen, and for scenes that it leaves empty the best of the pool (marked restored)."""
    empty = pool.join(chosen.select(scene).distinct(), scene, "left_anti")
    best = empty.groupBy(scene).agg(F.max_by(id_, F.struct(F.col(score), -F.col(id_))).alias(id_)).withColumn("restored", F.lit(True))
    return chosen.select(scene, id_).withColumn("restored", F.lit(False)).unionByName(best)


def worst(rows: DataFrame, value: str, id_: str, n: int) -> DataFrame:
    """The n rows of the least value; a top-n, of which every task sends n rows at most."""
    return rows.orderBy(F.col(value).asc_nulls_last(), id_).limit(n)


def ranked_by_gap(rows: DataFrame, entry: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """entry, gap of the means of arms a and b, and key, which sorts entries by falling gap with those without an arm last."""
    per = rows.groupBy(entry).agg(F.avg(F.when(F.col(arm) == a, F.col(value))).alias("_a"), F.avg(F.when(F.col(arm) == b, F.col(value))).alias("_b"))
    return per.select(entry, (F.col("_a") - F.col("_b")).alias("gap")).withColumn("key", F.coalesce("gap", F.lit(-1e9)))


def split_by_scene(rows: DataFrame, scene: str, share: float, seed: str) -> DataFrame:
    """rows with split: train for scenes whose draw lies below the share, else test; all rows of a scene go together."""
    u = F.conv(F.substring(draw(seed, scene), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(u < share, "train").otherwise("test"))


def quotas_by_size(sizes: DataFrame, size: str, target: int) -> DataFrame:
    """sizes (size, n: scenes of that size) with wanted, how many to take so that sizes add up to the target, in proportion
    of n. Every size first gets the whole part of its proportional share. Of what is left the sizes get one scene more by
    falling remainder (then by falling size), as long as the running sum of these sizes stays nearer to what is left than
    without the last: the total misses a target within reach by at most half the size of one scene.

    One row a size (cameras of a scene: few), so its windows are small; scenes never meet here."""
    mass = sizes.agg(F.coalesce(F.sum(F.col(size) * F.col("n")), F.lit(0))).first()[0]
    target = max(0, min(int(target), mass))
    share = sizes.select(size, "n", F.expr(f"{target} * n div {max(mass, 1)}").alias("whole"), F.expr(f"{target} * n % {max(mass, 1)}").alias("rest"))
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(F.desc("rest"), F.desc(size)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = F.when(F.col("rest") > 0, F.col(size)).otherwise(0)
    until, left = F.sum(cost).over(order), F.lit(target) - F.sum(F.col("whole") * F.col(size)).over(every)
    return share.select(size, "n", (F.col("whole") + ((F.col("rest") > 0) & (2 * until - F.col(size) <= 2 * left)).cast("long")).alias("wanted"))


def first_drawn(rows: DataFrame, group: str, wanted: str, id_: str, seed: str) -> DataFrame:
    """The first rows of each group by their draw, as many as their column wanted says. Draws fall into 4,096 ranges, of
    which all but the last one wanted are taken by their counts, so only that range's rows are ranked against each other."""
    dealt = rows.withColumn("_x", draw(seed, id_)).withColumn("_range", F.substring("_x", 1, 3))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    some = dealt.join(counts, [group, "_range"]).where(F.col("_before") < F.col(wanted))
    rank = F.row_number().over(Window.partitionBy(group, "_range").orderBy("_x", id_))
    return some.withColumn("_r", F.col("_before") + rank).where(F.col("_r") <= F.col(wanted)).drop("_x", "_range", "_n", "_before", "_r")


def stratified(scenes: DataFrame, scene: str, size: str, target: int, forced: DataFrame | None = None, seed: str = "stratified") -> DataFrame:
    """Scenes held out so that their sizes add up to about target: the forced ones, and of the others as many of each
    size as quotas_by_size gives, by their draw. Columns: scene, size, why (forced, drawn)."""
    have = forced.select(scene).distinct() if forced is not None else scenes.limit(0).select(scene)
    sized = scenes.select(scene, F.col(size).cast("long").alias(size))
    first, pool = sized.join(have, scene, "left_semi"), sized.join(have, scene, "left_anti")
    left = target - first.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    quota = quotas_by_size(pool.groupBy(size).agg(F.count("*").alias("n")), size, left).where("wanted > 0").select(size, "wanted")
    drawn = first_drawn(pool.join(F.broadcast(quota), size), size, "wanted", scene, seed)
    return first.withColumn("why", F.lit("forced")).unionByName(drawn.select(scene, size, F.lit("drawn").alias("why")))


def split_again(scenes: DataFrame, old: DataFrame, scene: str, size: str, share: float, seed: str = "stratified") -> DataFrame:
    """scene, split, kept: scenes that old lists keep their split; of the new ones a share of their sizes is held out for
    test, stratified by size, and the others train."""
    known = scenes.select(scene, size).join(old.select(scene, F.col("split").alias("_old")), scene, "left")
    new = known.where("_old IS NULL").select(scene, size)
    mass = new.agg(F.bround(F.coalesce(F.sum(size), F.lit(0)) * F.lit(float(share)))).first()[0]
    test = stratified(new, scene, size, int(mass), seed=seed).select(scene, F.lit("test").alias("_new"))
    return known.join(test, scene, "left").select(scene, F.coalesce("_old", "_new", F.lit("train")).alias("split"), F.col("_old").isNotNull().alias("kept"))


def drawn_above(rows: DataFrame, scene: str, id_: str, purity: str, floor: float, cap: int, seed: str) -> DataFrame:
    """Up to cap rows of each scene, drawn among those of purity floor or more; a scene without any gives its purest row."""
    order = [F.asc("_low"), F.when(F.col("_low"), -F.col(purity)), draw(seed, id_), F.asc(id_)]
    low = rows.withColumn("_low", F.coalesce(F.col(purity) < floor, F.lit(True)))
    ranked = low.withColumn("_r", F.row_number().over(Window.partitionBy(scene).orderBy(*order)))
    return ranked.where((~F.col("_low") & (F.col("_r") <= cap)) | (F.col("_low") & (F.col("_r") == 1))).withColumn("fallback", F.col("_low")).drop("_low", "_r")


def query_plan(rows: DataFrame, label: list[str], length: str, least_span: int, least_pool: int) -> DataFrame:
    """Labels that occur often and long enough: label, pool, span, most frequent first by their order columns."""
    per = rows.where(F.col(length) >= least_span).groupBy(*label).agg(F.count("*").alias("pool"), F.max(length).alias("span"))
    return per.where(F.col("pool") >= least_pool)


def cycled(rows: DataFrame, reason: str, id_: str, seed: str, most: int) -> DataFrame:
    """most rows that take turns over the reasons: reason, id, turn."""
    turn = F.row_number().over(Window.partitionBy(reason).orderBy(draw(seed, id_), id_))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", reason).limit(most).select(reason, id_, "turn")


def quotas(rows: DataFrame, scene: str, id_: str, moving: Column, score: str, most: dict[str, int]) -> DataFrame:
    """Rows of each scene's moving and still bucket up to their quotas, best scores first."""
    named = rows.withColumn("bucket", F.when(moving, "moving").otherwise("still"))
    rank = F.row_number().over(Window.partitionBy(scene, "bucket").orderBy(F.desc(score), id_))
    limit = F.create_map(*[F.lit(x) for k, v in most.items() for x in (k, v)])
    return named.withColumn("rank", rank).where(F.col("rank") <= F.element_at(limit, F.col("bucket")))


def separated(radius_a: Column, azimuth_a: Column, radius_b: Column, azimuth_b: Column, least: float) -> Column:
    """Different radii, or azimuths at least so many degrees apart around the circle."""
    return ~radius_a.eqNullSafe(radius_b) | (turn_gap(azimuth_a, azimuth_b) >= least)


#: Draws that a camera's first round lets through on average, as a multiple of the count asked for, and the parts that the
#: cameras of a scene fall into.
SPARE, PARTS = 6, 8


def expanded(cameras: DataFrame, candidates: DataFrame, scene: str, camera: str, candidate: str, at: str, far: float, count: int, seed: str) -> DataFrame:
    """count candidates for every camera of their scene, far ones (tier far) before near ones, by draw.

    A first pass counts a camera's far and near candidates. Draws are spread evenly, so of a tier that is needed the second
    pass keeps those below a limit that lets through SPARE times the count on average (all of a tier of fewer), and sorts
    only them: the least draws are the same as those of all where the count is reached. Cameras that were let through too
    few come again and rank all their candidates. Every candidate of a scene meets every camera, and none is drawn in vain
    that a full far tier shuts out."""
    split = cameras.select(scene, camera, F.col(at).alias("_at"), F.pmod(F.xxhash64(camera), F.lit(PARTS)).cast("int").alias("_part"))
    parts = candidates.select(scene, candidate, F.col(at).alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    is_far = F.coalesce(F.abs(F.col("_to") - F.col("_at")) >= far, F.lit(False))
    meet = lambda asked: asked.hint("shuffle_hash").join(parts, [scene, "_part"])
    counted = meet(split).groupBy(scene, "_part", camera).agg(F.count_if(is_far).alias("_far"), F.count_if(~is_far).alias("_near"))
    # the first eight of a draw's digits, or g, which is above all of them
    limit = lambda n: F.when(n <= SPARE * count, "g").otherwise(F.lower(F.lpad(F.hex(F.ceil(F.lit(2.0**32 * SPARE * count) / n)), 8, "0")))
    counts = checkpointed(counted.withColumns({"_limit_far": limit(F.col("_far")), "_limit_near": F.when(F.col("_far") < count, limit(F.col("_near"))).otherwise("")}))

    asked = split.join(counts, [scene, "_part", camera])

    def ranked(met: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(scene, camera).orderBy("tier", "_draw", candidate))
        return met.withColumn("rank", rank).where(F.col("rank") <= count).select(scene, camera, candidate, "tier", "rank")

    drawn = meet(asked).withColumns({"tier": F.when(is_far, "far").otherwise("near"), "_limit": F.when(is_far, F.col("_limit_far")).otherwise(F.col("_limit_near"))})
    drawn = drawn.where("_limit <> ''").select(scene, camera, candidate, "tier", "_limit", draw(seed, camera, candidate).alias("_draw"))
    first = checkpointed(ranked(drawn.where("_draw < _limit")))
    have = first.groupBy(scene, camera).agg(F.count("*").alias("_have"), F.count_if(F.col("tier") == "far").alias("_far_have"))
    state = counts.join(have, [scene, camera], "left").withColumns({"_have": F.coalesce("_have", F.lit(0)), "_far_have": F.coalesce("_far_have", F.lit(0))})
    short = (F.col("_have") < F.least(F.lit(count), F.col("_far") + F.col("_near"))) | (F.col("_far_have") < F.least(F.lit(count), F.col("_far")))
    short = checkpointed(state.where(short).select(scene, "_part", camera))
    again = meet(split.join(short, [scene, "_part", camera])).select(scene, camera, candidate, F.when(is_far, "far").otherwise("near").alias("tier"), draw(seed, camera, candidate).alias("_draw"))
    return first.join(short.select(scene, camera), [scene, camera], "left_anti").select(scene, camera, candidate, "tier", "rank").unionByName(ranked(again))


def budgeted(anchors_: DataFrame, scene: str, anchor: str, tier: str, cost: str, budget: float) -> DataFrame:
    """Anchors of each scene by tier and anchor while their costs add up to the budget or less."""
    spent = F.sum(cost).over(Window.partitionBy(scene).orderBy(tier, anchor).rowsBetween(Window.unboundedPreceding, 0))
    return anchors_.withColumn("spent", spent).where(F.col("spent") <= budget)


def rotated_slot(video: Column, pairs: list[tuple[str, str]], available: Column) -> Column:
    """The pair at crc32(video) modulo their number, or the next one, around, whose two slots are available; else null."""
    n = len(pairs)
    start = F.crc32(video.cast("string").cast("binary")) % n
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    turn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(listed, ((start + i) % n + 1).cast("int")))
    fits = F.filter(turn, lambda p: F.array_contains(available, p["a"]) & F.array_contains(available, p["b"]))
    return F.when(F.size(fits) > 0, F.element_at(fits, 1))


def spread_frames(rows: DataFrame, track: str, order: list[str], area: str, id_: str, parts: int) -> DataFrame:
    """The frame of the largest area in each of the parts of a track's time: track, part, id, area."""
    part = F.ntile(parts).over(Window.partitionBy(track).orderBy(*order))
    best = F.max_by(F.struct(F.col(id_), F.col(area)), F.struct(F.col(area), -F.col(id_)))
    return rows.withColumn("part", part).groupBy(track, "part").agg(best.alias("_b")).select(track, "part", "_b.*")


def alternating(rows: DataFrame, group: str, bucket: str, id_: str) -> DataFrame:
    """rows with place: candidates in turns over their buckets, so neighbours differ in bucket while several are left."""
    turn = F.row_number().over(Window.partitionBy(group, bucket).orderBy(id_))
    return rows.withColumn("_t", turn).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_t", bucket))).drop("_t")


def covering(rows: DataFrame, group: str, candidate: str, element: str, k: int, keep=lambda df: df) -> DataFrame:
    """Greedy maximum coverage: rows are (group, candidate, element). In each of k rounds every group takes the candidate
    with most elements not yet covered, the least of equals, and stops at no gain. A round is grouped counts, combined
    before the shuffle, and a join with the elements just covered, so a group of any size is spread over tasks. keep
    writes the remaining rows after a round (a checkpoint)."""
    left = rows.where(F.col(element).isNotNull()).select(group, candidate, element).distinct()
    picks = None
    for i in range(k):
        gains = left.groupBy(group, candidate).agg(F.count("*").alias("gain"))
        best = gains.groupBy(group).agg(F.max_by(F.struct(candidate, "gain"), F.struct(F.col("gain"), -F.col(candidate))).alias("_b")).select(group, "_b.*").withColumn("pick", F.lit(i))
        picks = best if picks is None else picks.unionByName(best)
        if i + 1 < k:
            covered = left.join(best.select(group, candidate), [group, candidate], "left_semi").select(group, element).distinct()
            left = keep(left.join(covered, [group, element], "left_anti"))
    return picks


def far_apart(rows: DataFrame, group: str, id_: str, vector: str, k: int, distance, keep=lambda df: df) -> DataFrame:
    """Farthest-point sampling: each group starts from its least id and k - 1 times takes the point farthest from all
    picked, the least id of equals, while that is farther than 0. A round is a join with one point of each group and a
    grouped maximum, so a group of any size is spread over tasks; keep writes the distances after a round."""
    state = rows.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(group, id_, vector)
    first = state.groupBy(group).agg(F.min(id_).alias(id_)).withColumn("pick", F.lit(0))
    picks, last = first, first
    state = state.withColumn("_d", F.lit(float("inf")))
    for i in range(1, k):
        point = state.join(last.select(group, id_), [group, id_], "left_semi").select(group, F.col(vector).alias("_v"))
        moved = state.join(point, group).withColumn("_d", F.least("_d", distance(F.col(vector), F.col("_v")))).drop("_v")
        state = keep(moved)
        far = state.groupBy(group).agg(F.max_by(F.struct(id_, "_d"), F.struct(F.col("_d"), -F.col(id_))).alias("_b"))
        last = far.where("_b._d > 0").select(group, F.col(f"_b.{id_}").alias(id_), F.lit(i).alias("pick"))
        picks = picks.unionByName(last)
    return picks
