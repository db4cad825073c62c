"""Evaluation: precision and recall, gates against limits, percentiles, leakage, quality baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.functions import similarity as S
from idloom.functions import text as T


def prf(tp: Column, fp: Column, fn: Column, places: int | None = 4) -> dict[str, Column]:
    """Precision, recall and F1, 0 where undefined; rounded half to even."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return {k: c if places is None else F.bround(c, places) for k, c in (("precision", p), ("recall", r), ("f1", f))}


def matched_fields(truth: DataFrame, predicted: DataFrame, by: tuple[str, ...] = ("sample_id", "field")) -> DataFrame:
    """Truth left-joined to predictions: exact, fuzzy, missing.  Predicted fields without a truth don't count."""
    both = truth.join(predicted.select(*by, F.col("value").alias("got")), list(by), "left")
    m = S.field_match(F.col("field"), F.col("value"), F.col("got"))
    return both.select(*by, m.alias("m"), (T.comparable(F.col("got")) == "").alias("missing"))


def score_extraction(truth: DataFrame, predicted: DataFrame, per_field: bool = True) -> DataFrame:
    """A wrong value is a false positive, an empty one a false negative; exact and fuzzy F1, per field or over all."""
    m = matched_fields(truth, predicted)
    n = lambda c: F.count_if(c)
    keys = ["field"] if per_field else []
    counts = m.groupBy(*keys).agg(n(~F.col("missing") & F.col("m.exact")).alias("tp"), n(~F.col("missing") & ~F.col("m.exact")).alias("fp"), n("missing").alias("fn"), n(~F.col("missing") & F.col("m.fuzzy")).alias("fuzzy_tp"))
    fuzzy = prf(F.col("fuzzy_tp"), F.col("tp") + F.col("fp") - F.col("fuzzy_tp"), F.col("fn"))["f1"]
    return counts.select(*keys, *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()], fuzzy.alias("fuzzy_f1"), (F.col("tp") + F.col("fp") + F.col("fn")).alias("n"))


def regression_scores(truth: DataFrame, predicted: DataFrame, per_field: bool) -> DataFrame:
    """Scores over the documents that both have; fields of either side count, compared as trimmed text; not rounded."""
    known = predicted.select("document_id").distinct().join(truth.select("document_id").distinct(), "document_id")
    side = lambda df, c: df.join(known, "document_id", "left_semi").select("document_id", "field", T.stripped(F.col("value")).alias(c))
    both = side(truth, "g").join(side(predicted, "p"), ["document_id", "field"], "full_outer").fillna("", ["g", "p"])
    g, p = F.col("g"), F.col("p")
    keys = ["field"] if per_field else []
    counts = both.groupBy(*keys).agg(F.count_if((p != "") & (p == g)).alias("tp"), F.count_if((p != "") & (p != g)).alias("fp"), F.count_if((p == "") & (g != "")).alias("fn")).where("tp + fp + fn > 0")
    return counts.select(*keys, "tp", "fp", "fn", *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn"), None).items()])


def gates(limits: DataFrame, metrics: DataFrame) -> DataFrame:
    """(gate, limit, actual, status) for every limit: SKIPPED where nothing was measured.  Both tables are a few rows."""
    a = F.col("actual")
    ok = F.when(F.col("direction") == "max", a <= F.col("limit")).otherwise(a >= F.col("limit"))
    return limits.join(F.broadcast(metrics), "gate", "left").select("gate", "limit", F.bround(a, 4).alias("actual"), F.when(a.isNull(), "SKIPPED").when(ok, "PASS").otherwise("FAIL").alias("status"))


def passed(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_and(F.col("status") != "FAIL"), F.lit(True)).alias("passed"))


def forensic_eval(rows: DataFrame) -> DataFrame:
    """(attack, n, flagged, rate) from (attack, recommendation): attack null for the genuine, whose rate is that of false alarms; a last row for all attacks."""
    flagged = F.col("recommendation") != "PASS"
    per = rows.groupBy(F.coalesce("attack", F.lit("genuine")).alias("attack")).agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"))
    total = rows.where("attack is not null").agg(F.lit("all attacks").alias("attack"), F.count("*").alias("n"), F.count_if(flagged).alias("flagged"))
    return per.unionByName(total).withColumn("rate", F.bround(F.try_divide("flagged", "n"), 4))


def leakage(rows: DataFrame) -> DataFrame:
    """Per attack, forgeries that were cleared: flagged ones, a fault of decisions, and those that no signal saw."""
    clear, seen = F.col("auto_cleared"), F.col("spoof_score") >= 0.2
    return rows.where("attack is not null").groupBy("attack").agg(F.count("*").alias("n"), F.count_if(clear & seen).alias("flagged_leakage"), F.count_if(clear & ~seen).alias("undetected"))


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, and a column per rank): the values at places of each group's order, from 0, given as expressions of its size `n`.

    Equal values are counted first, and a running sum finds the places, so that no group is gathered into an array.  Nulls don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("__value")).agg(F.count("*").alias("__many"))
    upto = counts.withColumn("__upto", F.sum("__many").over(Window.partitionBy(by).orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)))
    sizes = counts.groupBy(by).agg(F.sum("__many").alias("n"))
    found = [F.min(F.when(F.col("__upto") > rank, F.col("__value"))).alias(name) for name, rank in ranks.items()]
    return upto.join(sizes, by).groupBy(by, "n").agg(*found)


def percentile_exclusive(rows: DataFrame, by: str, value: str, q: int, name: str) -> DataFrame:
    """(by, name): the q-th of 99 cut points by the exclusive method, which may lie beyond the ends; the value for a single one."""
    n = F.col("n")
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(q * (n + 1) / 100)))
    ends = at_ranks(rows, by, value, {"low": F.greatest(F.lit(0), j - 1), "high": F.least(n - 1, j)})
    return ends.select(by, F.when(n == 1, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (q * (n + 1) / 100 - j)).alias(name))


def quantile_index(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """The elements at the whole part of q times the count: how the metrics endpoint takes quantiles."""
    return at_ranks(rows, by, value, {k: F.least(F.floor(q * F.col("n")), F.col("n") - 1) for k, q in quantiles.items()}).drop("n")


def threshold_advice(rows: DataFrame, keep: float = 0.95) -> DataFrame:
    """Thresholds that keep a share of the good pictures, from (pass, blur, white, black), by linear percentiles."""
    good = rows.where("pass")
    q = lambda c, s, places: F.bround(F.percentile(c, F.lit(s)), places)
    return good.agg(q("blur", round(1 - keep, 10), 2).alias("min_blur_score"), q("white", keep, 4).alias("max_white_ratio"), q("black", keep, 4).alias("max_black_ratio"))


def quality_gate(ok_rate: Column, valid_rate: Column, baseline: Column, least_ok: float = 0.99, least_valid: float = 0.9, drop: float = 0.005) -> Column:
    """Array of what fails; empty is a pass."""
    return F.array_compact(F.array(F.when(ok_rate < least_ok, "ok_rate"), F.when(valid_rate < least_valid, "valid_rate"), F.when(baseline - valid_rate > drop, "valid_rate_drop")))


def ranked_counts(rows: DataFrame, key: Column, name: str = "key", top: int | None = None) -> DataFrame:
    """Counts by descending number, then key, with their rank; a top limits the report."""
    counts = rows.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    if top is not None:
        counts = counts.orderBy(F.desc("n"), name).limit(top)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), name)))


def round_robin(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """A balanced sample: the first of each type, then the second, up to n."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("turn", place).where(F.col("turn") <= n).orderBy("turn", by).limit(n)


def stable_sample(rows: DataFrame, content: Column, n: int, tie: str) -> DataFrame:
    """The n rows of smallest SHA-256 of the content."""
    return rows.withColumn("digest", F.sha2(content, 256)).orderBy("digest", tie).limit(n)


def field_accuracy(rows: DataFrame, accepted: tuple[str, ...]) -> DataFrame:
    """Per field over accepted documents: correct and total, compared as lower-case letters and digits."""
    good = T.strip_alnum(F.col("truth")) == T.strip_alnum(F.col("got"))
    return rows.where(F.col("status").isin(*accepted) & (F.coalesce("truth", F.lit("")) != "")).groupBy("field").agg(F.count_if(good).alias("correct"), F.count("*").alias("total"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """(position, line) of the text exposition of (name, kind, value), by kind and name."""
    rank = F.when(F.col("kind") == "counter", 0).when(F.col("kind") == "gauge", 1).otherwise(2)
    rows = metrics.select(F.row_number().over(Window.orderBy(rank, "name")).alias("at"), "name", "kind", "value")
    lines = F.array(F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"), F.concat("name", F.lit(" "), F.col("value").cast("string")))
    return rows.select("at", F.posexplode(lines).alias("k", "line")).select((F.col("at") * 2 + F.col("k") - 2).alias("position"), "line")


def summary(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(grouping, key, n, rank): counts by each key in one pass, each grouping by falling count, then key."""
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("grouping"), c.alias("key")) for k, c in keys.items()])).alias("e")
    counts = rows.select(entries).groupBy("e.grouping", "e.key").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("grouping").orderBy(F.desc("n"), "key")))
