"""Agreement between the documents of a case: names, dates, addresses, genders, contradictions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions import similarity as S
from idloom.functions import text as T
from idloom.operators.parts import spread

NAME_KEYS = ("name", "surname", "given_names", "customer_name", "account_holder", "employee_name")


def pairs(rows: DataFrame, by: str = "case_id", ordinal: str = "ordinal") -> DataFrame:
    """Every pair i < j within a case, as structs a and b: a self-join on the case, so it shuffles by case alone."""
    side = lambda n: rows.select(by, F.struct(*[c for c in rows.columns if c != by]).alias(n))
    return side("a").join(side("b"), by).where(F.col(f"a.{ordinal}") < F.col(f"b.{ordinal}"))


def equal_pairs(rows: DataFrame, by: str = "case_id", ordinal: str = "ordinal", value: str = "value") -> DataFrame:
    """(by, i, j): the ordinals of every pair i < j of equal values within a case.

    As many rows as there are such pairs, so the square of how often a value occurs.  They are merged out of sorted parts by
    case and value, which spill; no side is sent to every task.
    """
    keyed = spread(rows.select(by, value, ordinal).where(F.col(ordinal).isNotNull()), by, value)
    return keyed.withColumnRenamed(ordinal, "i").hint("merge").join(keyed.withColumnRenamed(ordinal, "j"), [by, value]).where("i < j").select(by, "i", "j")


def blocked_name_pairs(people: DataFrame, key: str, value: str, block: Column) -> DataFrame:
    """Pairs of people within a block and of one sound: keeps the pairs from growing with the square of the table."""
    rows = people.select(F.col(key).alias("ordinal"), F.col(value).alias("value"), F.concat_ws("|", block, T.soundex(F.col(value))).alias("block"))
    return pairs(rows, "block")


def explode_packet(packet: DataFrame) -> DataFrame:
    """(case_id, ordinal, doc_type, field, value) of maps of fields; empty values go."""
    return packet.select("case_id", "ordinal", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.explode("fields").alias("field", "value")).where(F.coalesce("value", F.lit("")) != "")


def resolve_names(names: DataFrame, by: str = "case_id") -> DataFrame:
    """Per case: mean score of the pairs (1 for one name), the longest name, the first of equals, and whether it is one person."""
    scored = pairs(names, by).select(by, S.name_score(F.col("a.value"), F.col("b.value")).alias("score"))
    mean = scored.groupBy(by).agg(F.avg("score").alias("match_score"), F.sum((F.col("score") < 0.85).cast("int")).alias("mismatches"))
    longest = names.groupBy(by).agg(F.max_by("value", F.struct(F.length("value"), -F.col("ordinal"))).alias("canonical_name"))
    out = longest.join(mean, by, "left").fillna({"match_score": 1.0, "mismatches": 0})
    return out.withColumn("is_same_person", F.col("match_score") >= 0.65)


def date_key(c: Column) -> Column:
    """Two values have one key just if dates_match holds: the date, or the text of what is none."""
    return F.coalesce(T.parse_date(c).cast("string"), F.concat(F.lit("text "), T.stripped(c)))


def of_pairs(n: Column) -> Column:
    """How many pairs n things make."""
    return n * (n - 1) / 2


def resolve_dates(dates: DataFrame, by: str = "case_id") -> DataFrame:
    """Per case with two dates or more: how many pairs differ.  Counted from how often each date occurs, so no pair is made.

    The dates go into many parts by case before any is parsed, so that a task's counts are few.
    """
    counted = spread(dates.select(by, "value").where(F.col(by).isNotNull()), by).groupBy(by, date_key(F.col("value")).alias("key")).agg(F.count("*").alias("n"))
    per = counted.groupBy(by).agg(F.sum("n").alias("n"), F.sum(of_pairs(F.col("n"))).alias("same")).where("n > 1")
    return per.select(by, (of_pairs(F.col("n")) - F.col("same")).cast("bigint").alias("mismatches")).withColumn("match", F.col("mismatches") == 0)


def parsed_addresses(addresses: DataFrame, by: str = "case_id") -> DataFrame:
    """(by, ordinal, p): addresses taken apart once each, then in many parts by case, in which their pairs are scored."""
    return spread(addresses.select(by, "ordinal", T.address_parts(F.col("value")).alias("p")), by)


def resolve_addresses(addresses: DataFrame, by: str = "case_id") -> DataFrame:
    """Per case: mean score of the pairs of addresses, 1 for one address."""
    mean = pairs(parsed_addresses(addresses, by), by).groupBy(by).agg(F.avg(S.address_score(F.col("a.p"), F.col("b.p"))).alias("address_score"))
    return addresses.select(by).distinct().join(mean, by, "left").fillna({"address_score": 1.0})


def _filled(field: str) -> Column:
    return F.coalesce(F.col("fields")[field], F.lit("")) != ""


def _values(packet: DataFrame, field: str) -> DataFrame:
    """(case_id, ordinal, value) of one field, where it isn't empty.  Of maps that can't have it nothing is read."""
    return packet.where(_filled(field)).select("case_id", "ordinal", F.col("fields")[field].alias("value"))


def _name_rows(packet: DataFrame) -> DataFrame:
    """The names of cases with two documents or more, in the order of NAME_KEYS."""
    many = packet.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id")
    place = F.array_position(F.array(*map(F.lit, NAME_KEYS)), F.col("field"))
    named = packet.where(reduce(or_, map(_filled, NAME_KEYS)))
    long = explode_packet(named.join(many, "case_id", "left_semi")).where(F.col("field").isin(*NAME_KEYS))
    return long.select("case_id", (F.col("ordinal") * 10 + place).alias("ordinal"), "value")


def resolve_genders(packet: DataFrame) -> DataFrame:
    """(case_id, seen) of cases with several genders, in upper case and in order."""
    each = spread(_values(packet, "gender").select("case_id", "value"), "case_id").groupBy("case_id", F.upper("value").alias("value")).agg(F.lit(1))
    return each.groupBy("case_id").agg(F.sort_array(F.collect_list("value")).alias("seen")).where(F.size("seen") > 1)


def _name_pairs(packet: DataFrame) -> DataFrame:
    """(case_id, x, y, n, score): the pairs of names within each case, counted by value and scored once each."""
    of_case = pairs(_name_rows(packet)).groupBy("case_id", F.col("a.value").alias("x"), F.col("b.value").alias("y")).agg(F.count("*").alias("n"))
    return of_case.withColumn("score", S.name_score(F.col("x"), F.col("y"))).where("score < 0.85")


def _name_severity(score: Column) -> Column:
    return F.when(score < 0.7, "HIGH").otherwise("MEDIUM")


def contradictions(packet: DataFrame) -> DataFrame:
    """(case_id, type, severity, detail) of every contradiction in maps of fields.

    All six kinds of name are compared with each other, those of one document too.  One document alone has none.
    """
    scored = pairs(_name_rows(packet)).select("case_id", F.upper(T.stripped(F.col("a.value"))).alias("x"), F.upper(T.stripped(F.col("b.value"))).alias("y"), S.name_score(F.col("a.value"), F.col("b.value")).alias("score"))
    detail = F.concat_ws(" vs ", "x", "y").alias("detail")
    by_name = scored.where("score < 0.85").select("case_id", F.lit("name_mismatch").alias("type"), _name_severity(F.col("score")).alias("severity"), detail)
    dates = pairs(_values(packet, "date_of_birth").withColumn("key", date_key(F.col("value"))))
    by_date = dates.where("a.key <> b.key").select("case_id", F.lit("dob_mismatch").alias("type"), F.lit("CRITICAL").alias("severity"), F.concat_ws(" vs ", T.stripped(F.col("a.value")), T.stripped(F.col("b.value"))).alias("detail"))
    by_gender = resolve_genders(packet).where("case_id is not null").select("case_id", F.lit("gender_mismatch").alias("type"), F.lit("HIGH").alias("severity"), F.concat(F.lit("Conflicting genders: "), F.array_join("seen", ", ")).alias("detail"))
    return by_name.unionByName(by_date).unionByName(by_gender)


def severities(packet: DataFrame) -> DataFrame:
    """(type, severity, n): how many contradictions there are of each kind.

    Pairs of dates are counted and not made, and names are compared once for each pair of values in a case.  A case's documents
    have ordinals of their own.
    """
    by_name = _name_pairs(packet).select(F.lit("name_mismatch").alias("type"), _name_severity(F.col("score")).alias("severity"), "n")
    by_date = resolve_dates(_values(packet, "date_of_birth")).select(F.lit("dob_mismatch").alias("type"), F.lit("CRITICAL").alias("severity"), F.col("mismatches").alias("n"))
    by_gender = resolve_genders(packet).where("case_id is not null").select(F.lit("gender_mismatch").alias("type"), F.lit("HIGH").alias("severity"), F.lit(1).cast("bigint").alias("n"))
    return by_name.unionByName(by_date).unionByName(by_gender).groupBy("type", "severity").agg(F.sum("n").alias("n")).where("n > 0")


def consistency(packet: DataFrame) -> DataFrame:
    """Per case: issues, consistency_score, recommendation.

    The issues are those that contradictions lists.  Only names are compared in pairs, of distinct values in the order that they
    come in; pairs of dates are counted, in the same sums as the fields that were checked.
    """
    checked = sum((_filled(k).cast("int") for k in (*NAME_KEYS, "date_of_birth", "gender")), F.lit(0))
    date = F.when(_filled("date_of_birth"), F.col("fields")["date_of_birth"])
    rows = spread(packet.select("case_id", date.alias("value"), checked.alias("checks")), "case_id")
    counted = rows.groupBy("case_id", F.when(F.col("value").isNotNull(), date_key(F.col("value"))).alias("key")).agg(F.count("value").alias("n"), F.sum("checks").alias("checks"))
    apart = F.when(F.col("case_id").isNull(), 0).otherwise(of_pairs(F.sum("n")) - F.sum(of_pairs(F.col("n")))).cast("bigint")
    zero = lambda kind="bigint": F.lit(0).cast(kind)
    by_date = counted.groupBy("case_id").agg(F.sum("checks").alias("checks"), apart.alias("issues")).withColumn("critical", (F.col("issues") > 0).cast("int"))
    by_name = _name_pairs(packet).select("case_id", zero().alias("checks"), F.col("n").alias("issues"), zero("int").alias("critical"))
    by_gender = resolve_genders(packet).where("case_id is not null").select("case_id", zero().alias("checks"), F.lit(1).cast("bigint").alias("issues"), zero("int").alias("critical"))
    out = by_date.unionByName(by_name).unionByName(by_gender).groupBy("case_id").agg(*[F.sum(c).alias(c) for c in ("checks", "issues", "critical")])
    score = F.greatest(F.lit(0.0), 1 - F.col("issues") / F.greatest(F.lit(1), F.col("checks")))
    return out.select("case_id", "issues", score.alias("consistency_score"), F.when(F.col("critical") > 0, "REJECT").when(F.col("issues") > 0, "REVIEW").otherwise("PASS").alias("recommendation"))
