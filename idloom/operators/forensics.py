"""Signals of forgery fused to a score; envelopes of genuine typography; robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.functions.text import clamp
from idloom.operators.evaluate import at_ranks

PRIORS = {"ela": 0.55, "copy_move": 0.9, "font": 0.0, "font_template": 0.8, "metadata": 0.55, "screen": 0.65}
LOW_QUALITY = 88
#: In the order in which they are tried.
EDITORS = ("affinity", "capture one", "gimp", "lightroom", "paint.net", "photoshop", "pixlr", "snapseed")


def noisy_or(*scores: Column) -> Column:
    """1 less the product of what each leaves; each clamped to 0..0.999."""
    left = [1 - clamp(F.coalesce(s, F.lit(0.0)), 0.0, 0.999) for s in scores]
    out = left[0]
    for x in left[1:]:
        out = out * x
    return 1 - out


def noisy_or_of(scores: Column) -> Column:
    """The same over an array, folded in sorted order so that the result doesn't depend on the order of rows."""
    return 1 - F.aggregate(F.array_sort(scores), F.lit(1.0), lambda acc, s: acc * (1 - clamp(s, 0.0, 0.999)))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def gated_signals(font_prior: float = PRIORS["font"]) -> dict[str, Column]:
    """Strength of each signal of a row, 0 where its gate is shut."""
    z = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d))
    gap = (LOW_QUALITY - F.col("jpeg_quality")) / 40.0
    low = F.when(F.col("jpeg_quality") < LOW_QUALITY, clamp(gap, 0.5, 1.0) * PRIORS["metadata"]).otherwise(0.0)
    edit = F.when(_true(F.col("software_edited")), PRIORS["metadata"]).when(_true(F.array_contains("metadata_flags", "date_mismatch")), PRIORS["metadata"] * 0.6).otherwise(0.0)
    return {
        "ela": F.when(z("ela_regions", 0) > 0, PRIORS["ela"] * F.least(F.lit(1.0), 0.7 + z("ela_score") * 10)).otherwise(0.0),
        "copy_move": F.when(_true(F.col("cm_detected")), PRIORS["copy_move"] * F.greatest(F.lit(0.7), z("cm_confidence"))).otherwise(0.0),
        "font": F.when(z("font_regions", 0) > 0, font_prior * F.least(F.lit(1.0), 0.7 + (1 - z("font_consistency", 1.0)) * 0.6)).otherwise(0.0),
        "font_template": F.when(_true(F.col("font_template_mismatch")), PRIORS["font_template"] * F.greatest(F.lit(0.7), z("font_template_strength"))).otherwise(0.0),
        "metadata": F.greatest(edit, low),
        "screen": F.when(_true(F.col("is_recaptured")), PRIORS["screen"] * F.greatest(F.lit(0.7), z("moire_score"))).otherwise(0.0),
    }


def risk(score: Column) -> tuple[Column, Column]:
    """(risk level, recommendation)."""
    level = F.when(score >= 0.7, "CRITICAL").when(score >= 0.4, "HIGH").when(score >= 0.2, "MEDIUM").otherwise("LOW")
    return level, F.when(score >= 0.7, "REJECT").when(score >= 0.2, "REVIEW").otherwise("PASS")


def spoof_scores(signals: DataFrame) -> DataFrame:
    """Adds spoof_score, risk_level, recommendation and the evidence, the open gates in a fixed order."""
    gates = gated_signals()
    low = (F.col("jpeg_quality") < LOW_QUALITY) & (clamp((LOW_QUALITY - F.col("jpeg_quality")) / 40.0, 0.5, 1.0) * PRIORS["metadata"] > F.when(_true(F.col("software_edited")), PRIORS["metadata"]).when(_true(F.array_contains("metadata_flags", "date_mismatch")), PRIORS["metadata"] * 0.6).otherwise(0.0))
    shown = [
        F.when(gates["ela"] > 0, "ela"),
        F.when(gates["copy_move"] > 0, "copy_move"),
        F.when(gates["font"] > 0, "font_inconsistency"),
        F.when(gates["font_template"] > 0, "font_template_mismatch"),
        F.when(_true(F.col("software_edited")), "metadata_edit").when(_true(F.array_contains("metadata_flags", "date_mismatch")), "metadata_anomaly"),
        F.when(_true(low), "low_jpeg_quality"),
        F.when(gates["screen"] > 0, "screen_recapture"),
    ]
    score = noisy_or(*gates.values())
    level, say = risk(F.col("spoof_score"))
    return signals.withColumn("spoof_score", score).withColumns({"risk_level": level, "recommendation": say, "evidence": F.array_compact(F.array(*shown))})


def metadata_flags(software: Column, make: Column, model: Column, original: Column, modified: Column, quality: Column) -> Column:
    """Array of flags from a picture's tags, in a fixed order."""
    low = F.lower(F.coalesce(software, F.lit("")))
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    editor = F.coalesce(*[F.when(low.contains(e), f"edited_with_{e}") for e in EDITORS])
    return F.array_compact(F.array(editor, F.when(none(make) & none(model) & none(software), "no_device_info"), F.when(~none(original) & ~none(modified) & (original != modified), "date_mismatch"), F.when(quality < LOW_QUALITY, "low_jpeg_quality")))


def jpeg_quality(table: Column, standard: Column) -> Column:
    """Quality of a quantisation table against the standard one: the median scale, inverted, half to even, within 1..100."""
    ratio = F.array_sort(F.zip_with(table, standard, lambda q, s: 100.0 * q / s))
    n = F.size(ratio)
    s = (F.get(ratio, F.floor((n - 1) / 2).cast("int")) + F.get(ratio, F.floor(n / 2).cast("int"))) / 2
    value = F.when(s < 1, F.lit(100.0)).when(s <= 100, F.bround((200 - s) / 2)).otherwise(F.bround(5000 / s))
    return clamp(value, 1.0, 100.0).cast("int")


def envelope_breaches(features: DataFrame, profiles: DataFrame, vote: int = 1) -> DataFrame:
    """Per document: breaches of its type's bounds, mismatch, strength.

    features: (doc_id, doc_type, feature, value) in long form; profiles: (doc_type, vote, feature, side, bound), one row per
    type and feature, so it is broadcast.  A type without a profile, and a malformed or missing bound, flag nothing.
    """
    usable = profiles.where(F.col("bound").isNotNull() & F.col("side").isin("high", "low"))
    met = features.withColumn("doc_type", F.lower("doc_type")).join(F.broadcast(usable), ["doc_type", "feature"], "left")
    breach = F.coalesce(((F.col("side") == "high") & (F.col("value") > F.col("bound"))) | ((F.col("side") == "low") & (F.col("value") < F.col("bound"))), F.lit(False))
    per = met.groupBy("doc_id", "doc_type").agg(F.sum(breach.cast("int")).alias("breaches"), F.coalesce(F.max("vote"), F.lit(vote)).alias("vote"), F.max(F.col("bound").isNotNull()).alias("known"))
    mismatch = F.col("known") & (F.col("breaches") >= F.col("vote"))
    return per.select("doc_id", "doc_type", "breaches", mismatch.alias("mismatch"), F.when(mismatch, F.round(F.least(F.lit(1.0), F.col("breaches") / F.greatest(F.col("vote") + 2, F.lit(1))), 3)).otherwise(0.0).alias("strength"))


def robust_bounds(rows: DataFrame, by: list[str], value: str, margin: float, side: str = "high", least: int = 4) -> DataFrame:
    """Median plus or minus a margin of the median deviation; where that is 0 the standard deviation, then a millionth."""
    v = F.col(value)
    centre = rows.where(v.isNotNull()).groupBy(*by).agg(F.median(v).alias("median"), F.stddev_pop(v).alias("sd"), F.count(v).alias("n")).where(F.col("n") >= least)
    spread = rows.join(centre, by).groupBy(*by, "median", "sd", "n").agg(F.median(F.abs(v - F.col("median"))).alias("mad"))
    unit = F.coalesce(F.nullif("mad", F.lit(0.0)), F.nullif("sd", F.lit(0.0)), F.lit(1e-6))
    return spread.select(*by, "n", "median", unit.alias("unit"), (F.col("median") + (margin if side == "high" else -margin) * unit).alias("bound"))


def leave_one_out(rows: DataFrame, by: str, key: str, value: str, margin: float, side: str = "high", least: int = 4) -> DataFrame:
    """Per group: its rows with so many others, and the share of them outside the bound that the others give; no value is inside.

    A row taken out moves a median by a place at most, so a group has three medians and each of them three median deviations.
    They are read off running counts of distinct values, and no two rows meet.  Only rows that share a key, which leave
    together, are held against each row that stays.
    """
    v, n = F.col("v"), F.col("n")
    base = rows.select(F.col(by).alias("g"), F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("g is not null and k is not null")
    low, high = F.floor((n - 2) / 2), F.floor((n - 1) / 2)  # the middle places of the n - 1 values left
    ranks = {"x1": low, "x2": low + 1, "y1": high, "y2": high + 1}
    middle = lambda x, y: 0.5 * F.col(x) + 0.5 * F.col(y)
    without = lambda c: 0.5 * F.when(c > F.col("x1"), F.col("x1")).otherwise(F.col("x2")) + 0.5 * F.when(c > F.col("y1"), F.col("y1")).otherwise(F.col("y2"))

    centre = at_ranks(base, "g", "v", ranks).where("n > 1")
    medians = centre.select("g", F.explode(F.array_distinct(F.array(middle("x1", "y1"), middle("x1", "y2"), middle("x2", "y2")))).alias("median"))
    gaps = base.where(v.isNotNull()).join(medians, "g").select(F.struct("g", "median").alias("h"), (v - F.col("median")).alias("gap")).withColumn("d", F.abs("gap"))
    sums = gaps.groupBy("h").agg(F.sum("gap").alias("s1"), F.sum(F.col("gap") * F.col("gap")).alias("s2"))
    spread = at_ranks(gaps, "h", "d", ranks).join(sums, "h").select("h.*", *ranks, "s1", "s2")

    sizes = base.groupBy("g").agg(F.count("*").alias("total"), (F.count("v") - 1).alias("m"))
    copies = base.groupBy("g", "k").agg(F.count("*").alias("copies"), F.first("v").alias("v"))
    one = copies.where("copies = 1").join(sizes, "g").where(F.col("total") > least)
    held = one.join(centre.drop("n"), "g", "left").withColumn("median", without(v)).drop(*ranks).join(spread, ["g", "median"], "left")
    gap = v - F.col("median")
    mean, square = (F.col("s1") - gap) / F.col("m"), (F.col("s2") - gap * gap) / F.col("m")
    sd = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    unit = F.coalesce(F.nullif(without(F.abs(gap)), F.lit(0.0)), F.nullif(sd, F.lit(0.0)), F.lit(1e-6))
    outside = lambda own, bound: F.coalesce(own > bound if side == "high" else own < bound, F.lit(False)).cast("double").alias("out")
    alone = held.select("g", outside(v, F.col("median") + (margin if side == "high" else -margin) * unit))

    shared = base.join(copies.where("copies > 1").select("g", "k"), ["g", "k"]).distinct()
    rest = shared.select("g", F.col("k").alias("held"), F.col("v").alias("own")).join(base, "g").where("held <> k")
    together = robust_bounds(rest, ["g", "held", "own"], "v", margin, side, least).select("g", outside(F.col("own"), F.col("bound")))
    return alone.unionByName(together).groupBy(F.col("g").alias(by)).agg(F.count("*").alias("n"), F.avg("out").alias("false_positive_rate"))


def iqr_outliers(rows: DataFrame, by: list[str], value: str, factor: float = 1.8) -> DataFrame:
    """Rows farther from their group's median than the factor times its spread; groups of two or fewer have none."""
    v = F.col(value)
    stats = rows.where(v > 0).groupBy(*by).agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n")).where("n >= 3")
    q = F.col("q")
    scale = F.greatest(q[2] - q[0], 0.15 * q[1], F.lit(1e-6))
    return rows.join(stats, by).where((v > 0) & (F.abs(v - q[1]) > factor * scale)).drop("q", "n")


def font_consistency(rows: DataFrame, by: list[str], stroke: str, height: str) -> DataFrame:
    """1 less the mean of both coefficients of variation, 0 at least; 1 for a single region."""
    cv = lambda c: F.coalesce(F.stddev_pop(F.when(F.col(c) > 0, F.col(c))) / F.greatest(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(1e-6)), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("regions"), F.when(F.count("*") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (cv(stroke) + cv(height)) / 2)).alias("consistency"))


def shift_clusters(matches: DataFrame, by: str = "doc_id", bin_px: int = 8, least: int = 8, dominance: float = 2.0, low: float = 32.0, high: float = 340.0, aspect: float = 4.0) -> DataFrame:
    """Copied regions from matched points (x1, y1, x2, y2): the commonest displacement, if it dominates and its span is plausible.

    Displacements point to the right, or down; bins are ordered by count, then by first occurrence.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = (dx < 0) | ((dx == 0) & (dy < 0))
    sign = F.when(turn, -1).otherwise(1)
    at = matches.select(by, "ordinal", F.bround(sign * dx / bin_px).cast("int").alias("bx"), F.bround(sign * dy / bin_px).cast("int").alias("by_"), F.when(turn, F.col("x2")).otherwise(F.col("x1")).alias("x"), F.when(turn, F.col("y2")).otherwise(F.col("y1")).alias("y"))
    bins = at.groupBy(by, "bx", "by_").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "first")
    ranked = bins.withColumn("runner_up", F.coalesce(F.lead("n").over(w), F.lit(0))).withColumn("r", F.row_number().over(w)).where("r = 1")
    small, big = F.least("w", "h"), F.greatest("w", "h")
    found = (F.col("n") >= F.greatest(F.lit(float(least)), dominance * F.col("runner_up"))) & (small >= low) & (big <= high) & (big / F.greatest(small, F.lit(1.0)) <= aspect)
    sure = F.least(F.lit(1.0), F.col("n") / (2 * least))
    return ranked.select(by, found.alias("detected"), F.when(found, sure).otherwise(F.least(sure, F.lit(0.3))).alias("confidence"), (F.col("bx") * bin_px).alias("shift_x"), (F.col("by_") * bin_px).alias("shift_y"))
