"""Document fingerprints by consistent weighted sampling (Ioffe, 2010); DataFrame functions only.

Terms are pairs of neighbouring words, weighted by how often they occur. Every term draws, from its hash, two gamma
variables r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) its sample is (term, t) with the value
ln a = ln c - r (t - b) - r, and the least ln a wins. Terms are dealt to BINS bins by hash and each bin keeps its own
winner (one-permutation sampling: a term is drawn for once, not BINS times), so two signatures agree in a bin with the
generalised Jaccard similarity of the bin's weights, and over the bins that either fills, on average with that of the
documents. A text of one word has that word as its only term; an empty or null text has no term and an empty
fingerprint, which is like another empty one (1.0) and unlike all else (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.shared import let

BINS = 128
#: Texts of about so many characters share a task of the neighbour and signature steps.
CHARS_PER_RANGE = 3_000_000
WEIGHT_BITS = 24
RANGES_AT_MOST = 20_000


def _uniform(h: Column, salt: int) -> Column:
    """From (0, 1], by 52 bits of a second hash."""
    return (F.shiftrightunsigned(F.xxhash64(h, F.lit(salt)), 12).cast("double") + 1.0) / float(1 << 52)


def sample(term: Column, weight: Column) -> Column:
    """A long whose order is that of ln a, and whose low 16 bits name the sample (term, t)."""
    r = -F.log(_uniform(term, 1) * _uniform(term, 2))
    c = -F.log(_uniform(term, 3) * _uniform(term, 4))
    b = _uniform(term, 5)
    t = F.floor(F.log(weight.cast("double")) / r + b)
    value = F.log(c) - r * (t - b) - r
    # ln a lies well within +-512 for any weight a text can have, so 2^36 steps a unit fit above the 16 bits
    return F.shiftleft(F.floor(value * float(1 << 36)).cast("long"), 16).bitwiseOR(F.xxhash64(term, t).bitwiseAND(0xFFFF))


def terms(text: Column) -> Column:
    """The distinct pairs of neighbouring words (or the only word), each a long: 40 bits of hash above the weight, 0 for 1.

    Words stand between spaces, tabs and line feeds; of an empty run only its emptiness counts.
    """

    def made(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(1))
        pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.shiftleft(F.xxhash64(a, b), WEIGHT_BITS))
        return F.when((F.size(w) == 1) & (F.element_at(w, 1) == ""), F.array().cast("array<long>")).otherwise(F.sort_array(pairs))

    def weighted(s: Column) -> Column:
        again = F.array_compact(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a == b, a)))
        return let(again, lambda x: F.concat(F.array_except(s, x), runs(x)))

    def runs(again: Column) -> Column:
        """again holds a term of weight w w - 1 times, side by side."""
        ends = F.filter(F.sequence(F.lit(1), F.size(again)), lambda i: ~F.element_at(again, i).eqNullSafe(F.get(again, i)))
        each = let(ends, lambda e: F.transform(e, lambda x, j: F.element_at(again, x) + x - F.coalesce(F.get(e, j - 1), F.lit(0)) + 1))
        return F.when(F.size(again) == 0, again).otherwise(each)

    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return let(let(F.split(F.trim(plain), " "), made), weighted)


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing bins among those that either signature fills; 1 for two empty ones."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def shown(signature: Column) -> Column:
    """Six hexadecimal digits for each filled bin: its number and the name of its sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def signatures(rows: DataFrame, key: list[str], texts: dict[str, Column], carried: dict[str, Column], bins: int = BINS) -> DataFrame:
    """A row for each key with a signature (array<long>) for each of texts, and the longs named in carried.

    Where rows are clustered by a part of the key, every step stays in their tasks. The carried longs travel as one
    more list of samples, so that the texts needn't be joined with them again.
    """
    own = len(texts)
    each = F.array(
        *[F.struct(F.lit(i).alias("which"), terms(t).alias("terms")) for i, t in enumerate(texts.values())],
        F.struct(F.lit(own).alias("which"), F.array(*[v.cast("long") for v in carried.values()]).alias("terms")),
    )
    one = rows.select(*key, F.inline(each)).select(*key, "which", F.posexplode("terms").alias("pos", "t"))
    term, weight = F.shiftright("t", WEIGHT_BITS), F.greatest(F.col("t").bitwiseAND((1 << WEIGHT_BITS) - 1), F.lit(1))
    drawn = one.select(
        *key, "which",
        F.when(F.col("which") == own, F.col("pos").cast("long")).otherwise(F.xxhash64(term, F.lit(0)).bitwiseAND(bins - 1)).alias("bin"),
        sample(term, weight).alias("sample"), "t",
    )
    least = drawn.groupBy(*key, "which", "bin").agg(F.min("sample").alias("sample"), F.min("t").alias("t"))
    entry = F.shiftleft("bin", 16).bitwiseOR(F.col("sample").bitwiseAND(0xFFFF))
    held = [F.max(F.when((F.col("which") == own) & (F.col("bin") == i), F.col("t"))).alias(name) for i, name in enumerate(carried)]
    return least.groupBy(*key).agg(*[F.sort_array(F.collect_list(F.when(F.col("which") == i, entry))).alias(name) for i, name in enumerate(texts)], *held)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts below key, by binary search."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c) for c in cuts])

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        above = key > F.element_at(array, F.least(middle + 1, F.lit(len(cuts))))
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~above, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bin(len(cuts))) - 2)), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, order: str, text: str, chars: Column) -> DataFrame:
    """Columns _range, _row, _copy and the next text, in ascending order (nulls first; ties by text), around the end.

    Rows are dealt to ranges of the order column, once; the first row of each range is added again at the end of the
    range before (_copy), so no window spans more than a range. Ranges are cut by approximate quantiles, and number at
    most RANGES_AT_MOST.
    """
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    parts = int(min(RANGES_AT_MOST, total // CHARS_PER_RANGE + 1, max(1, rows)))
    cuts = docs.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    dealt = docs.select(order, text, F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))).alias("_key")).withColumn("_range", _range_of(F.col("_key"), cuts))
    firsts = sorted(map(tuple, dealt.select("_range", "_key").groupBy("_range").agg(F.min("_key")).collect()))
    bounds = docs.sparkSession.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "_key long, _before int")
    copies = dealt.join(F.broadcast(bounds), "_key").select(order, text, "_key", F.col("_before").alias("_range"), F.lit(True).alias("_copy"))
    both = dealt.withColumn("_copy", F.lit(False)).unionByName(copies).repartition(parts, "_range")
    within = Window.partitionBy("_range").orderBy("_copy", "_key", text)
    return both.withColumns({"_row": F.row_number().over(within), "_next": F.lead(text).over(within)})


def edited(text: Column, following: Column) -> Column:
    """text with its last half, rounded down, replaced by as many characters of the following one, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, n_chars, edited_sha256, the fingerprints of its text and its edited text, and the
    likeness of its fingerprint to the edited text's (near_edited) and the next document's (near_next)."""
    docs = docs.select(order, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = with_next(docs, order, "_text", F.length("_text"))
    rows = rows.select(order, "_range", "_row", "_copy", "_text", edited(F.col("_text"), F.coalesce("_next", F.lit(""))).alias("_edited"))
    sha = F.sha2("_edited", 256)
    digits = {f"_sha{i}": F.conv(F.substring(sha, 1 + 13 * i, 13), 16, 10) for i in range(5)}
    carried = {"_id": F.col(order), "n_chars": F.length("_text"), "_last": F.col("_copy").cast("int")} | digits
    texts = {"_own": F.col("_text"), "_other": F.when(~F.col("_copy"), F.col("_edited"))}
    drawn = signatures(rows, ["_range", "_row"], texts, carried)
    full = drawn.withColumn("_after", F.lead("_own").over(Window.partitionBy("_range").orderBy("_row")))
    return full.where(F.col("_last") == 0).select(
        F.col("_id").cast(docs.schema[order].dataType).alias(order), "n_chars",
        F.concat(*[F.lpad(F.lower(F.hex(name)), 13 if i < 4 else 12, "0") for i, name in enumerate(digits)]).alias("edited_sha256"),
        shown(F.col("_own")).alias("fingerprint"), shown(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )
