"""Fields of documents in long form: collapse of candidates, merging, schema rules, scores, choice of a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.functions import similarity as S
from idloom.functions import text as T
from idloom.operators.parts import spread

NON_TEXT = ("photo", "signature", "emblem", "goi_symbol", "logo")
CRITICAL = ("aadhaar_number", "pan_number", "name", "date_of_birth")


def confidence(det: str | Column = "det_conf", ocr: str | Column = "ocr_conf") -> Column:
    """Half of each; a missing one counts 0."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return 0.5 * F.coalesce(as_col(det), F.lit(0.0)) + 0.5 * F.coalesce(as_col(ocr), F.lit(0.0))


def map_labels(detections: DataFrame, mapping: DataFrame | None = None, least: float = 0.25) -> DataFrame:
    """Rename labels by (raw_label, mapped) and drop the unmapped and the marks without text; without a map, lower case."""
    kept = detections.where(F.col("conf") >= least)
    if mapping is None:
        return kept.withColumn("field", F.lower("raw_label"))
    # A label map has one row per class of a detector: a handful.
    return kept.join(F.broadcast(mapping.select("raw_label", F.col("mapped").alias("field"))), "raw_label").where(~F.lower("field").isin(*NON_TEXT))


def best_per_field(rows: DataFrame, by: tuple[str, ...] = ("doc_id",), key: Column | None = None) -> DataFrame:
    """The candidate of the highest confidence for each document and field; of equals the first by ordinal."""
    key = T.normalise_key(F.col("field")) if key is None else key
    pick = F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(confidence(), -F.col("ordinal")))
    return rows.withColumn("__key", key).groupBy(*by, "__key").agg(pick.alias("r")).select(*by, F.col("__key").alias("field"), "r.text", "r.det_conf", "r.ocr_conf", "r.ordinal")


def normalise_fields(rows: DataFrame) -> DataFrame:
    """Values by their field's normaliser where that gives one, with source and is_normalized."""
    done = rows.withColumn("normalized", T.applied(F.col("field"), F.col("value"), S.REGISTRY))
    fits = F.coalesce(F.col("field").isin(*S.REGISTRY) & F.col("normalized").isNotNull(), F.lit(False))
    return done.select(*rows.columns, F.coalesce("normalized", "value").alias("normalized"), F.when(fits, F.concat(F.lit("normalize_"), "field")).alias("source"), fits.alias("is_normalized"))


def merge_fields(primary: DataFrame, secondary: DataFrame, by: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """Full outer merge on the field: the secondary wins where the primary is missing or empty, or is less sure; ties stay."""
    side = lambda df, p: df.select(*by, F.struct("value", confidence().alias("conf")).alias(p))
    both = side(primary, "p").join(side(secondary, "s"), list(by), "full_outer")
    filled = lambda c: F.coalesce(c["value"], F.lit("")) != ""
    p, s = F.col("p"), F.col("s")
    second = p.isNull() | (s.isNotNull() & filled(s) & (~filled(p) | (s["conf"] > p["conf"])))
    return both.select(*by, F.when(second, s["value"]).otherwise(p["value"]).alias("value"), F.when(second, s["conf"]).otherwise(p["conf"]).alias("conf"), F.when(second, "secondary").otherwise("primary").alias("taken_from"))


def ensemble_path(yolo: Column, vlm: Column) -> Column:
    """Which side leads when both have fields; a side alone passes through."""
    return F.when(yolo.isNotNull() & vlm.isNotNull(), F.when(yolo * 0.6 >= vlm * 0.4, "ensemble_yolo").otherwise("ensemble_vlm")).when(yolo.isNotNull(), "yolo").when(vlm.isNotNull(), "vlm")


# --- Schemas -------------------------------------------------------------------------------------------------------------

_NAME, _ADDRESS = (2, 100), (10, 500)
_D, _M = r"(?:3[01]|[12]\d|0[1-9])", r"(?:1[0-2]|0[1-9])"
_DAY, _DAY_DASH = rf"^(?:{_D}/{_M}/\d{{4}}|\d{{4}})$", rf"^(?:{_D}[-/]{_M}[-/]\d{{4}}|\d{{4}})$"
_PAN, _GENDER = r"^[A-Z]{5}\d{4}[A-Z]$", ("Male", "Female", "Other")


def _schema(required: str, free: str = "", **rules) -> dict:
    return {"required": required.split(), "rules": {**rules, **dict.fromkeys(free.split())}}


#: Per type: required fields, and for each allowed field a pattern, an enumeration, bounds on the length, or nothing.
SCHEMAS: dict[str, dict] = {
    "pan": _schema("pan_number name date_of_birth", pan_number=_PAN, name=_NAME, father_name=_NAME, date_of_birth=_DAY),
    "aadhaar": _schema("aadhaar_number name date_of_birth gender", aadhaar_number=r"^\d{4}\s?\d{4}\s?\d{4}$", name=_NAME, date_of_birth=_DAY_DASH, gender=_GENDER, address=_ADDRESS),
    "passport": _schema("passport_number surname given_names date_of_birth date_of_expiry", "nationality place_of_birth", passport_number=r"^[A-Z]\d{7}$", surname=_NAME, given_names=_NAME, date_of_birth=_DAY, date_of_issue=_DAY, date_of_expiry=_DAY, sex=("M", "F")),
    "driving_license": _schema("dl_number name date_of_birth", "blood_group", dl_number=r"^[A-Z]{2}\d{2}\s?\d{11}$", name=_NAME, date_of_birth=_DAY, address=_ADDRESS, date_of_issue=_DAY, date_of_expiry=_DAY),
    "voter_id": _schema("epic_number name", "father_name", epic_number=r"^[A-Z]{3}\d{7}$", name=_NAME, date_of_birth=_DAY, gender=_GENDER, address=_ADDRESS),
    "bank_statement": _schema("account_holder bank_name statement_period", "account_number bank_name branch statement_period", account_holder=_NAME, ifsc_code=r"^[A-Z]{4}0[A-Z\d]{6}$", address=_ADDRESS),
    "birth_certificate": _schema("name date_of_birth registration_number", "registration_number place_of_birth father_name mother_name", name=_NAME, date_of_birth=_DAY, gender=_GENDER),
    "employment_letter": _schema("employee_name employer_name", "designation employee_id", employee_name=_NAME, employer_name=_NAME, date_of_joining=_DAY, address=_ADDRESS),
    "insurance": _schema("policy_number insured_name insurer_name", "policy_number insurer_name policy_type sum_insured", insured_name=_NAME, date_of_issue=_DAY, date_of_expiry=_DAY),
    "marriage_certificate": _schema("registration_number bride_name groom_name date_of_marriage", "registration_number place_of_marriage", bride_name=_NAME, groom_name=_NAME, date_of_marriage=_DAY),
    "tax_return": _schema("pan_number name assessment_year", "assessment_year total_income tax_paid", pan_number=_PAN, name=_NAME, filing_date=_DAY),
    "utility_bill": _schema("customer_name billing_address bill_date", "account_number amount_due", customer_name=_NAME, billing_address=_ADDRESS, bill_date=_DAY, due_date=_DAY, service_type=("Electricity", "Water", "Gas", "Telephone", "Internet")),
    "visa": _schema("visa_number name date_of_expiry", "visa_number visa_type nationality port_of_entry", name=_NAME, date_of_issue=_DAY, date_of_expiry=_DAY),
}


def bad_fields(fields: Column, doc_type: Column) -> Column:
    """Sorted array of '<field>: <reason>' for a map of flat fields; null for a type without a schema.

    One expression for all types: rows of mixed types are checked in one pass.
    """
    out = F
    for kind, schema in SCHEMAS.items():
        found = [F.when(~F.map_contains_key(fields, k), F.lit(f"{k}: is a required property")) for k in schema["required"]]
        for k, rule in schema["rules"].items():
            v = F.try_element_at(fields, F.lit(k))
            if isinstance(rule, str):
                found.append(F.when(~v.rlike(rule.replace("$", r"\z")), f"{k}: does not match"))
            elif rule and isinstance(rule[0], str):
                found.append(F.when(~v.isin(*rule), f"{k}: is not one of"))
            elif rule:
                found.append(F.when((F.length(v) < rule[0]) | (F.length(v) > rule[1]), f"{k}: has a wrong length"))
        extra = F.transform(F.array_except(F.map_keys(fields), F.array(*map(F.lit, schema["rules"]))), lambda k: F.concat(k, F.lit(": is not allowed")))
        out = out.when(doc_type == kind, F.sort_array(F.concat(F.array_compact(F.array(*found)), extra)))
    return out


def validation(fields: Column, doc_type: Column) -> Column:
    """struct<is_valid, message>: messages joined by ' | '."""
    bad = bad_fields(fields, doc_type)
    return F.struct(F.coalesce(F.size(bad) == 0, F.lit(False)).alias("is_valid"), F.when(bad.isNull(), F.concat(F.lit("Schema not found: "), F.coalesce(doc_type, F.lit("")))).otherwise(F.array_join(bad, " | ")).alias("message"))


def coverage(fields: Column, doc_type: Column) -> Column:
    """Share of the required fields that have a value; 0 where the type requires none."""
    out = F
    for kind, schema in SCHEMAS.items():
        there = [(T.stripped(F.try_element_at(fields, F.lit(k))) != "").cast("int") for k in schema["required"]]
        out = out.when(doc_type == kind, sum(there[1:], there[0]) / len(there))
    return out.otherwise(0.0)


def candidate_score(is_valid: Column, covered: Column, mean_conf: Column) -> Column:
    """2 for validity, 1 for coverage, 1 for confidence."""
    return is_valid.cast("int") * 2.0 + covered + F.coalesce(mean_conf, F.lit(0.0))


def critical_fields(fields: Column) -> Column:
    """How many of the four that identify a person have a value."""
    there = [(F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")) != "").cast("int") for k in CRITICAL]
    return sum(there[1:], there[0])


def choose_candidate(candidates: DataFrame, by: str = "doc_id", partial_coverage: float = 0.75, partial_score: float = 1.75) -> DataFrame:
    """What trying candidates in order would give: the first that is valid or good enough, else the best score, first of equals."""
    enough = F.col("is_valid") | ((F.col("coverage") >= partial_coverage) & (F.col("score") >= partial_score))
    order = F.struct(enough.cast("int"), F.when(enough, -F.col("ordinal").cast("double")).otherwise(F.col("score")), -F.col("ordinal"))
    return candidates.groupBy(by).agg(F.max_by(F.struct(*[c for c in candidates.columns if c != by]), order).alias("r")).select(by, "r.*")


def unknown_type(pan_score: Column, aadhaar_score: Column) -> Column:
    """Of both readings of a document of unknown type; pan wins ties."""
    return F.when(pan_score >= aadhaar_score, "pan").otherwise("aadhaar")


def infer_type(keys: Column) -> Column:
    """A type from the names of the fields."""
    s = F.lower(F.array_join(keys, " "))
    return F.when(s.contains("pan") | s.contains("father"), "pan").when(s.contains("aadhaar") | s.contains("gender"), "aadhaar").otherwise("unknown")


EXPECTED = {"pan": ("pan_number", "name", "father_name", "date_of_birth"), "aadhaar": ("aadhaar_number", "name", "gender", "date_of_birth", "address")}


def route_documents(detections: DataFrame, by: str = "doc_id", penalty: float = 0.35, least: float = 0.25, best: float = 1.3, margin: float = 0.2) -> DataFrame:
    """Type and rotation of each document from the detections of both detectors at each rotation.

    Input: (by, rotation_order, detector, field, conf).  A detector's score is twice its coverage plus the confidence of the
    expected fields less a share of that of the other type's; name and date of birth, which both have, count on both sides.
    """
    key, conf = T.normalise_key(F.col("field")), F.col("conf")
    kinds, fields = list(EXPECTED), sorted(set().union(*EXPECTED.values()))
    place = F.array_position(F.array(*map(F.lit, fields)), key).cast("int")
    coded = spread(detections.select(by, "rotation_order", F.array_position(F.array(*map(F.lit, kinds)), F.col("detector")).cast("int").alias("d"), place.alias("f"), "conf"), by)
    # The surest of each field by each detector, side by side: one sum of fixed width for each document and rotation.
    tops = [F.max(F.when((F.col("d") == d) & (F.col("f") == f), conf)).alias(f"c{d}_{f}") for d in range(1, len(kinds) + 1) for f in range(1, len(fields) + 1)]
    seen = coded.groupBy(by, "rotation_order").agg(*tops)

    def score(kind: str, other: str) -> Column:
        top = {f: F.col(f"c{kinds.index(kind) + 1}_{fields.index(f) + 1}") for f in fields}
        zero = F.lit(0.0)
        covered = sum((F.when(top[f] >= least, 1).otherwise(0) for f in EXPECTED[kind]), F.lit(0)) / len(EXPECTED[kind])
        right = sum((F.coalesce(top[f], zero) for f in EXPECTED[kind]), zero)
        wrong = sum((F.when(top[f] >= least, top[f]).otherwise(zero) for f in EXPECTED[other]), zero)
        return 2.0 * covered + right - penalty * wrong

    turned = seen.select(by, "rotation_order", score("pan", "aadhaar").alias("pan"), score("aadhaar", "pan").alias("aadhaar"))
    chosen = turned.groupBy(by).agg(F.max_by(F.struct("rotation_order", "pan", "aadhaar"), F.struct(F.round(F.greatest("pan", "aadhaar"), 9), -F.col("rotation_order"))).alias("r")).select(by, "r.*")
    sure = (F.greatest("pan", "aadhaar") >= best) & (F.abs(F.col("pan") - F.col("aadhaar")) >= margin)
    return chosen.select(by, "rotation_order", F.col("pan").alias("score_pan"), F.col("aadhaar").alias("score_aadhaar"), F.when(sure, F.when(F.col("pan") >= F.col("aadhaar"), "pan").otherwise("aadhaar")).otherwise("unknown").alias("doc_type"))


def classify(requested: Column, routed_type: Column, routed_rotation: Column, model_rotation: Column, model_conf: Column) -> Column:
    """struct<doc_type, rotation>: a requested type wins; the rotation model only where it is sure."""
    asked = T.normalise_doc_type(requested)
    return F.struct(F.when(asked != "auto", asked).otherwise(F.coalesce(routed_type, F.lit("unknown"))).alias("doc_type"), F.when(model_conf >= 0.9, model_rotation).otherwise(F.coalesce(routed_rotation, F.lit("rot0"))).alias("rotation"))


def quality_gate(good: Column, reason: Column) -> Column:
    """struct<passed, attempt_rescue>: bad exposure may still be rescued."""
    rescue = ~good & (F.coalesce(reason, F.lit("")).contains("overexposed") | F.coalesce(reason, F.lit("")).contains("dark"))
    return F.struct((good | rescue).alias("passed"), rescue.alias("attempt_rescue"))


def same_keys_only(cleaned: Column, original: Column) -> Column:
    """A model's answer cut to the keys that it was asked about."""
    return F.map_filter(cleaned, lambda k, _: F.map_contains_key(original, k))


def vlm_fields(reply: Column) -> Column:
    """Array of field structs from a JSON object; null where the reply isn't one.

    Values of false, zero and null, and empty strings, lists and objects, become empty; the strings "false", "0" and "null" stay.
    """
    pairs = F.map_entries(F.from_json(reply, "map<string,variant>"))

    def text(v: Column) -> Column:
        kind, plain = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        falsy = (kind == "VOID") | ((kind == "BOOLEAN") & (plain == "false")) | (kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (F.try_variant_get(v, "$", "double") == 0)) | (~kind.rlike("^STRING") & plain.isin("[]", "{}"))
        return F.when(falsy, F.lit("")).when(kind == "BOOLEAN", F.initcap(plain)).otherwise(F.coalesce(plain, F.lit("")))

    ok = F.get_json_object(reply, "$").startswith("{")
    return F.when(ok, F.transform(pairs, lambda e: F.struct(e["key"].alias("field"), text(e["value"]).alias("value"), F.lit(0.0).alias("det_conf"), F.lit(0.85).alias("ocr_conf"))))


def chosen_rank(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def flat(fields: Column) -> Column:
    """Map of field structs to map of their values."""
    return F.transform_values(fields, lambda _, v: v["value"])


def extraction_or_empty(docs: DataFrame, fields: DataFrame, by: str = "doc_id") -> DataFrame:
    """Each document's map of (field, text), empty where nothing was read; of a field named twice the largest text stays."""
    one = fields.groupBy(by, "field").agg(F.max("text").alias("text"))
    made = one.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("extraction"))
    return docs.join(made, by, "left").withColumn("extraction", F.coalesce("extraction", F.create_map().cast("map<string,string>")))


def result_record(doc_id: Column, is_valid: Column, score: Column) -> Column:
    """struct<doc_id, status, score>."""
    return F.struct(doc_id.alias("doc_id"), F.when(is_valid, "SUCCESS").otherwise("PARTIAL_SUCCESS").alias("status"), score.alias("score"))


def rescue(fields: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(doc_id, field, value, conf, source): a model's suggestion replaces the value where its field's check accepts it.

    Empty or equal suggestions, and fields that nobody read or that have no check, change nothing.  An accepted value has
    source llm_rescue and confidence 0.8.  Normalising and validating again is the caller's next step; scores stay.
    """
    old, new, field = T.stripped(F.col("value")), T.stripped(F.col("suggested")), F.col("field")
    fits = F.when(field == "pan_number", S.accept_pan(old, new)).when(field == "aadhaar_number", S.accept_aadhaar(old, new)).when(field == "date_of_birth", S.accept_dob(old, new)).when(field.isin("name", "father_name"), S.accept_name(old, new))
    joined = fields.join(suggestions, ["doc_id", "field"], "left").withColumn("accepted", F.coalesce((new != "") & (new != old) & fits, F.lit(False)))
    take = F.col("accepted")
    return joined.select("doc_id", "field", F.when(take, new).otherwise(F.col("value")).alias("value"), F.when(take, 0.8).otherwise(F.col("conf")).alias("conf"), F.when(take, "llm_rescue").alias("source"))
