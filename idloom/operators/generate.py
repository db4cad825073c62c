"""Synthetic people, document numbers, attacks and boxes, from ranges and hashes: the same rows for the same seed anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.text import let, verhoeff_digit

MALE = "AARAV VIVAAN ADITYA VIHAAN ARJUN SAI REYANSH KRISHNA ISHAAN ROHAN".split()
FEMALE = "SAANVI AADYA KIARA DIYA PIHU PRISHA ANANYA FATIMA ANIKA MEERA".split()
SURNAMES = "SHARMA PATEL REDDY IYER KHAN SINGH GUPTA NAIR DAS VERMA".split()
RTO_STATES = "MH DL KA TN UP GJ RJ WB MP HR".split()
ATTACKS = "copy_move exif_edit font_swap regenerate screen_recapture text_splice".split()
STATUS_WEIGHTS = (("P", 0.85), ("C", 0.05), ("H", 0.04), ("F", 0.03), ("A", 0.02), ("T", 0.01))


def draw(n: int, *key) -> Column:
    """A whole number below n from the hash of the key."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key]), F.lit(n))


def pick(options, *key) -> Column:
    return F.get(F.array(*map(F.lit, options)), draw(len(options), *key).cast("int"))


def weighted(options, *key) -> Column:
    """The first option whose cumulated weight passes a uniform draw."""
    u, total, out = draw(1_000_000, *key) / 1_000_000, 0.0, F
    for value, weight in options[:-1]:
        total += weight
        out = out.when(u < total, value)
    return out.otherwise(options[-1][0])


def letter(*key) -> Column:
    return F.char(F.lit(65) + draw(26, *key))


def people(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(id, name, surname, father_name, gender, date_of_birth, pan_number, aadhaar_number, dl_number)."""
    k = [F.col("id"), F.lit(seed)]
    male = draw(2, *k, "g") == 0
    named = spark.range(n).select("id", F.when(male, "Male").otherwise("Female").alias("gender"), pick(SURNAMES, *k, "s").alias("surname"), F.when(male, pick(MALE, *k, "n")).otherwise(pick(FEMALE, *k, "n")).alias("given"), pick(MALE, *k, "f").alias("father"))
    day = F.date_add(F.lit("1955-01-01").cast("date"), draw(18_993, *k, "d").cast("int"))
    digits = lambda w, m, tag: F.lpad(draw(m, *k, tag).cast("string"), w, "0")
    body = F.concat((draw(8, *k, "a1") + 2).cast("string"), digits(10, 10**10, "a2"))
    twelve = F.concat(body, verhoeff_digit(body))
    pan = F.concat(letter(*k, 1), letter(*k, 2), letter(*k, 3), F.lit("P"), F.substring("surname", 1, 1), digits(4, 10_000, "p"), letter(*k, 4))
    dl = F.concat(pick(RTO_STATES, *k, "r"), F.lpad((draw(50, *k, "o") + 1).cast("string"), 2, "0"), F.lit(" "), (draw(19, *k, "y") + 2005).cast("string"), digits(7, 10**7, "l"))
    return named.select("id", F.concat_ws(" ", "given", "surname").alias("name"), "surname", F.concat_ws(" ", "father", "surname").alias("father_name"), "gender", F.date_format(day, "dd/MM/yyyy").alias("date_of_birth"), pan.alias("pan_number"), F.concat_ws(" ", F.substring(twelve, 1, 4), F.substring(twelve, 5, 4), F.substring(twelve, 9, 4)).alias("aadhaar_number"), dl.alias("dl_number"))


def legacy_set(spark: SparkSession, pans: int, aadhaars: int, seed: int) -> DataFrame:
    """The second generator's manifest: (id, doc_type, status_code, number, image_filename, label_filename), PAN cards first.

    The fourth letter of a PAN tells whose it is, by the weights of STATUS_WEIGHTS; an Aadhaar number has no status.
    """
    k = [F.col("n"), F.lit(seed), F.lit("legacy")]
    digits = lambda w, m, tag: F.lpad(draw(m, *k, tag).cast("string"), w, "0")
    is_pan, status = F.col("n") < pans, weighted(STATUS_WEIGHTS, *k, "status")
    pan = F.concat(letter(*k, 1), letter(*k, 2), letter(*k, 3), status, letter(*k, 4), digits(4, 10_000, "p"), letter(*k, 5))
    body = F.concat((draw(8, *k, "a1") + 2).cast("string"), digits(10, 10**10, "a2"))
    name = F.lpad((F.col("n") + 1).cast("string"), 6, "0")
    rows = spark.range(pans + aadhaars).withColumnRenamed("id", "n")
    return rows.select(name.alias("id"), F.when(is_pan, "PAN").otherwise("AADHAAR").alias("doc_type"), F.when(is_pan, status).alias("status_code"), F.when(is_pan, pan).otherwise(F.concat(body, verhoeff_digit(body))).alias("number"), F.concat(name, F.lit(".jpg")).alias("image_filename"), F.concat(name, F.lit(".json")).alias("label_filename"))


def attacks(documents: DataFrame, per_doc: int = 1, severity: str = "mixed", seed: int = 1) -> DataFrame:
    """Labels of forgeries: every document under every attack."""
    named = documents.crossJoin(F.broadcast(documents.sparkSession.createDataFrame([(a, k) for a in ATTACKS for k in range(per_doc)], "attack string, k int")))
    level = pick(["low", "med", "high"], "sample_id", "attack", "k", seed) if severity == "mixed" else F.lit(severity)
    return named.select(F.concat_ws("_", "sample_id", "attack", "k").alias("sample_id"), F.col("sample_id").alias("source_id"), "doc_type", "attack", level.alias("severity"))


def perturbed(value: Column, *key) -> Column:
    """Up to two digits, or letters where there are none, replaced by others of their kind; X is added where there are neither."""
    is_digit, is_letter = lambda c: c.between("0", "9"), lambda c: c.between("A", "Z") | c.between("a", "z")
    places = lambda chars, kind: F.filter(F.transform(chars, lambda c, i: F.when(kind(c), i)), lambda i: i.isNotNull())
    one = lambda place, tag: F.get(place, draw(1 << 30, *key, tag).cast("int") % F.size(place))
    other = lambda c, i: F.when(is_digit(c), draw(10, *key, i).cast("string")).otherwise(letter(*key, i))

    def replaced(chars: Column, place: Column) -> Column:
        new = lambda at: F.transform(chars, lambda c, i: F.when((i == at["a"]) | (i == at["b"]), other(c, i)).otherwise(c))
        return F.when(F.size(place) == 0, F.concat(value, F.lit("X"))).otherwise(let(F.struct(one(place, 1).alias("a"), one(place, 2).alias("b")), lambda at: F.array_join(new(at), "")))

    def split(chars: Column) -> Column:
        digits_or_letters = lambda digits: F.when(F.size(digits) > 0, digits).otherwise(places(chars, is_letter))
        return let(let(places(chars, is_digit), digits_or_letters), lambda place: replaced(chars, place))

    return let(F.split(value, ""), split)


def yolo_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """'cx cy w h' of a box relative to its picture, six places each."""
    return F.format_string("%.6f %.6f %.6f %.6f", (x1 + x2) / 2.0 / width, (y1 + y2) / 2.0 / height, (x2 - x1) * 1.0 / width, (y2 - y1) * 1.0 / height)


def rotated_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Array of a box's corners after turning its picture clockwise."""
    return F.when(degrees == 90, F.array(height - y2, x1, height - y1, x2)).when(degrees == 180, F.array(width - x2, height - y2, width - x1, height - y1)).when(degrees == 270, F.array(y1, width - x2, y2, width - x1)).otherwise(F.array(x1, y1, x2, y2))
