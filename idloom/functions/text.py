"""Column functions for extracted field values: normalisers, checksums, recovery of misread characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that scanners read for digits, and the digits read for letters.
LETTER_TO_DIGIT = ("ODQILZSBG", "000112586")
LETTER_OR_BAR_TO_DIGIT = ("ODQIL|ZSBG", "0001112586")
DIGIT_TO_LETTER = ("015826", "OISBZG")
DATE = r"(\d{1,2})[/\-.](\d{1,2})[/\-.]((?:19|20)\d{2})"


def _verhoeff_tables() -> tuple[str, str]:
    """The dihedral group of order ten as 10 x 10 digits, and the powers of its permutation as 8 x 10 digits."""

    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    step, row, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], list(range(10)), []
    for _ in range(8):
        rows.append(row)
        row = [step[x] for x in row]
    return "".join(str(product(a, b)) for a in range(10) for b in range(10)), "".join(str(x) for r in rows for x in r)


GROUP, PERMUTED = _verhoeff_tables()
INVERSE = "".join(str(next(b for b in range(10) if GROUP[a * 10 + b] == "0")) for a in range(10))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body has it; a plain column would be written out each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+\z", "")


def _or_null(c: Column, good: Column) -> Column:
    return F.when(good, c)


def _keep(c: Column, unwanted: str) -> Column:
    return F.regexp_replace(F.upper(c), unwanted, "")


def _fold(digits: Column, shift: int) -> Column:
    turned = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        digit = F.substring(turned, i + 1, F.lit(1)).cast("int")
        moved = F.substring(F.lit(PERMUTED), F.pmod(i + shift, F.lit(8)) * 10 + digit + 1, F.lit(1)).cast("int")
        return F.substring(F.lit(GROUP), acc * 10 + moved + 1, F.lit(1)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def verhoeff_valid(c: Column) -> Column:
    """True for digits whose last is the check digit of those before; other text, empty too, isn't valid."""
    good = F.coalesce(c.rlike(r"^[0-9]+\z"), F.lit(False))
    return F.when(good, _fold(F.when(good, c).otherwise("0"), 0) == 0).otherwise(False)


def verhoeff_digit(c: Column) -> Column:
    """The check digit to append; null unless c is all digits."""
    good = F.coalesce(c.rlike(r"^[0-9]+\z"), F.lit(False))
    return F.when(good, F.substring(F.lit(INVERSE), _fold(F.when(good, c).otherwise("0"), 1) + 1, F.lit(1)))


def fix_scientific(c: Column) -> Column:
    """Numbers in exponent notation become whole digits; text that isn't one stays."""
    number = F.regexp_extract(stripped(c), r"^([+-]?[0-9]*\.?[0-9]+[eE][+-]?[0-9]+)\z", 1)
    value = F.when(number != "", number).try_cast("double")
    return F.coalesce(F.when(F.abs(value) < 1e37, F.when(value < 0, F.ceil(value.cast("decimal(38,0)"))).otherwise(F.floor(value.cast("decimal(38,0)")))).cast("string"), c)


def gender_prefix(c: Column) -> Column:
    """Male, Female or Other by the first letters; null where only a fuzzy match could tell."""
    s = _keep(c, "[^A-Z]")
    return F.when(s.startswith("M"), "Male").when(s.startswith("F") | s.startswith("WOMAN"), "Female").when(s.startswith("T") | s.startswith("OTH"), "Other")


def date(c: Column) -> Column:
    """dd/mm/yyyy of the first date with day and month in range, else the first standalone year, else null.  31/02 passes."""
    s = F.regexp_replace(stripped(c), r"(?i)^(date|dob|birth|of|year|yob|:|\s)+", "")
    d, m, y = (F.regexp_extract(s, DATE, k) for k in (1, 2, 3))
    day, month = d.try_cast("int"), m.try_cast("int")
    full = F.when(day.between(1, 31) & month.between(1, 12), F.concat_ws("/", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y))
    return F.coalesce(full, F.nullif(F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1), F.lit("")))


def aadhaar(c: Column) -> Column:
    """Twelve digits with a right check digit, after mapping misread letters if need be; else null."""
    s = _keep(fix_scientific(c), "[^0-9A-Z]")
    mapped = F.regexp_replace(F.translate(s, *LETTER_TO_DIGIT), "[^0-9]", "")
    ok = lambda x: (F.length(x) == 12) & verhoeff_valid(x)
    return F.when(ok(s), s).when(ok(mapped), mapped)


def pan(c: Column) -> Column:
    """Five letters, four digits, a letter, with misread characters mapped by place; else null."""
    s = _keep(c, "[^A-Z0-9]")
    fixed = F.concat(F.translate(F.substring(s, 1, 5), *DIGIT_TO_LETTER), F.translate(F.substring(s, 6, 4), *LETTER_TO_DIGIT), F.translate(F.substring(s, 10, 1), *DIGIT_TO_LETTER))
    return _or_null(fixed, (F.length(s) == 10) & fixed.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]\z"))


def name(c: Column) -> Column:
    return F.nullif(stripped(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z\s.'\-]", ""), r"\s+", " ")), F.lit(""))


def passport(c: Column) -> Column:
    s = _keep(c, "[^A-Z0-9]")
    return _or_null(s, s.rlike(r"^[A-Z][0-9]{7}\z"))


def ifsc(c: Column) -> Column:
    s = _keep(c, "[^A-Z0-9]")
    return _or_null(s, s.rlike(r"^[A-Z]{4}0[A-Z0-9]{6}\z"))


def driving_license(c: Column) -> Column:
    s = _keep(c, "[^A-Z0-9]")
    return _or_null(s, F.length(s) >= 10)


def voter_id(c: Column) -> Column:
    s = _keep(c, "[^A-Z0-9]")
    return _or_null(s, F.length(s) >= 8)


def address(c: Column) -> Column:
    s = F.regexp_replace(stripped(F.regexp_replace(c, r"\s+", " ")), r",\s*,", ",")
    return _or_null(s, F.length(s) >= 10)


def pincode(c: Column) -> Column:
    """The first word of six digits, or null if that begins with 0: later ones aren't tried."""
    s = F.regexp_extract(c, r"\b([0-9]{6})\b", 1)
    return _or_null(s, (s != "") & ~s.startswith("0"))


def amount(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9.,]", ""), F.lit(""))


def ocr_clean(field: Column, c: Column) -> Column:
    """What to keep of a text region by its field: the first date, the first PAN, twelve digits, else the text."""
    f, s = F.lower(field), stripped(c)
    digits = F.regexp_replace(s, "[^0-9]", "")
    first = lambda x, p: F.coalesce(F.nullif(F.regexp_extract(x, p, 0), F.lit("")), s)
    return (
        F.when(f.contains("dob") | f.contains("date"), first(s, r"[0-9]{2}/[0-9]{2}/[0-9]{4}"))
        .when(f.contains("pan_number"), first(F.upper(s), r"[A-Z]{5}[0-9]{4}[A-Z]"))
        .when(f.contains("aadhar") | f.contains("aadhaar"), F.when(F.length(digits) == 12, digits).otherwise(s))
        .otherwise(s)
    )


def canonical_pan(c: Column) -> Column:
    return _keep(stripped(c), "[^A-Z0-9]")


def canonical_aadhaar(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(stripped(c)), *LETTER_OR_BAR_TO_DIGIT), "[^0-9]", "")


def recover_dob(c: Column) -> Column:
    """A date or a year from misread text; empty if there is none."""
    slim = F.regexp_replace(F.translate(F.translate(F.upper(stripped(c)), *LETTER_OR_BAR_TO_DIGIT), "-.", "//"), "[^0-9/]", "")
    parts = [F.regexp_extract(slim, r"^([0-9]{1,2})/([0-9]{1,2})/((?:19|20)[0-9]{2})\z", k) for k in (1, 2, 3)]
    day, month = parts[0].try_cast("int"), parts[1].try_cast("int")
    return F.when(day.between(1, 31) & month.between(1, 12), F.concat_ws("/", F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"), parts[2])).otherwise(F.regexp_extract(slim, r"(?:19|20)[0-9]{2}", 0))


def same_class(a: Column, b: Column) -> Column:
    """Equal length, not empty, and each pair of characters equal or commonly misread for each other."""
    fold = lambda c: F.translate(c, *LETTER_OR_BAR_TO_DIGIT)
    return (F.length(a) > 0) & (F.length(a) == F.length(b)) & (fold(a) == fold(b))


def soundex(c: Column) -> Column:
    """Four characters; unlike the usual code, vowels don't part equal neighbours, and the first letter's code merges too."""
    letters = _keep(c, "[^A-Z]")
    codes = F.regexp_replace(F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUHWY", "111122222222334556"), "[A-Z]", "")
    first = F.substring(letters, 1, 1)
    runs = F.regexp_replace(codes, r"(.)\1+", "$1")
    rest = F.when(first.rlike("[AEIOUHWY]"), runs).otherwise(F.substring(runs, 2, 100000))
    return F.when(letters == "", "").otherwise(F.rpad(F.substring(F.concat(first, rest), 1, 4), 4, "0"))


def token_jaccard(a: Column, b: Column) -> Column:
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.upper(stripped(c)), r"\s+")), "")
    both, either = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when((F.size(words(a)) == 0) | (F.size(words(b)) == 0), 0.0).otherwise(both / either)


_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def parse_date(c: Column) -> Column:
    """The date by the first of nine formats that fits; null for impossible dates and other text."""
    s = stripped(c)
    tried = [F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f))) for f, p in zip(_FORMATS, (r"^\d{1,2}/\d{1,2}/\d{4}\z", r"^\d{1,2}-\d{1,2}-\d{4}\z", r"^\d{1,2}\.\d{1,2}\.\d{4}\z", r"^\d{4}-\d{1,2}-\d{1,2}\z", r"^\d{4}/\d{1,2}/\d{1,2}\z", r"^\d{1,2} [A-Za-z]{3} \d{4}\z", r"^\d{1,2} [A-Za-z]{3,9} \d{4}\z", r"^[A-Za-z]{3} \d{1,2}, \d{4}\z", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}\z"))]
    return F.coalesce(*tried).cast("date")


def dates_match(a: Column, b: Column) -> Column:
    x, y = parse_date(a), parse_date(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(stripped(a) == stripped(b))


def strip_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\W_]+", "")


def comparable(c: Column) -> Column:
    """Upper case with single spaces, for comparing a field with its truth."""
    return F.upper(stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def temperature(p: Column, t: float = 1.5) -> Column:
    """Logistic of the log-odds over t; 0 and 1 stay."""
    inside = F.when((p > 0) & (p < 1), p)
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(1 / (1 + F.exp(-F.ln(inside / (1 - inside)) / t)))


_NORMALISERS = {
    gender_prefix: "gender sex",
    date: "date_of_birth dob date_of_issue date_of_expiry date_of_joining date_of_marriage bill_date due_date filing_date",
    aadhaar: "aadhaar_number",
    pan: "pan_number pan_num",
    passport: "passport_number",
    driving_license: "dl_number",
    voter_id: "epic_number",
    ifsc: "ifsc_code",
    name: "name father_name mother_name surname given_names customer_name account_holder employee_name employer_name insured_name insurer_name bride_name groom_name",
    address: "address billing_address",
    amount: "amount_due total_income tax_paid sum_insured",
}
REGISTRY = {field: fn for fn, fields in _NORMALISERS.items() for field in fields.split()}


def applied(field: Column, value: Column, registry: dict | None = None) -> Column:
    """What the field's normaliser makes of the value; null without one, or where it gives nothing.  One expression for all fields."""
    groups: dict = {}
    for key, fn in (registry or REGISTRY).items():
        groups.setdefault(fn, []).append(key)
    raw, out = stripped(value), F
    for fn, keys in groups.items():
        own = F.when(field.isin(keys), raw) if getattr(fn, "costly", False) else raw  # no Python for other fields' values
        out = out.when(field.isin(keys), fn(own))
    return F.when(raw != "", F.nullif(out, F.lit("")))


def normalise_key(key: Column) -> Column:
    k = F.lower(stripped(key))
    return F.when(k == "dob", "date_of_birth").when(k == "aadhar_number", "aadhaar_number").otherwise(k)


def normalise_doc_type(c: Column) -> Column:
    k = F.lower(stripped(c))
    return F.when(k == "", "auto").when(k == "aadhar", "aadhaar").otherwise(k)


def safe_id(c: Column) -> Column:
    return F.translate(c, "\\/", "__")


STATES = dict(
    x.split(" ", 1)
    for x in "AP Andhra Pradesh;AR Arunachal Pradesh;AS Assam;BR Bihar;CG Chhattisgarh;GA Goa;GJ Gujarat;HR Haryana;HP Himachal Pradesh;JH Jharkhand;KA Karnataka;KL Kerala;MP Madhya Pradesh;MH Maharashtra;MN Manipur;ML Meghalaya;MZ Mizoram;NL Nagaland;OD Odisha;OR Odisha;PB Punjab;RJ Rajasthan;SK Sikkim;TN Tamil Nadu;TS Telangana;TR Tripura;UP Uttar Pradesh;UK Uttarakhand;WB West Bengal;DL Delhi;JK Jammu and Kashmir;LA Ladakh".split(";")
)
SHORT = dict(
    x.split(":")
    for x in "rd:road;st:street;apt:apartment;blk:block;bldg:building;nr:near;opp:opposite;dist:district;tehsil:tehsil;po:post office;ps:police station;hno:house number;h.no:house number;vill:village;moh:mohalla;sec:sector;ph:phase".split(";")
)


def address_parts(c: Column) -> Column:
    """struct<normalized, pincode, state, city>; all null for a null or empty address."""
    table = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    word = lambda w: F.coalesce(F.try_element_at(table, F.regexp_replace(w, "[^a-z]", "")), w)

    def city(parts: Column, pin: Column) -> Column:
        last = F.element_at(parts, -1)
        return F.when(F.size(parts) >= 3, F.when(last == pin, F.element_at(parts, -2)).otherwise(last))

    def parsed(v: Column) -> Column:
        s, low, pin, there = v["s"], v["low"], v["pin"], v["there"]
        padded = F.concat(F.lit(" "), F.upper(s), F.lit(" "))
        state = let(padded, lambda p: F.coalesce(*[F.when(low.contains(full.lower()) | p.contains(f" {code} "), full) for code, full in STATES.items()]))
        parts = let(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: city(p, pin))
        found = {"normalized": F.array_join(F.transform(F.split(low, " "), word), " "), "pincode": pin, "state": state, "city": parts}
        return F.struct(*[F.when(there, x).alias(k) for k, x in found.items()])

    there = F.coalesce(c, F.lit("")) != ""
    return let(stripped(F.regexp_replace(c, r"\s+", " ")), lambda s: let(F.struct(there.alias("there"), s.alias("s"), F.lower(s).alias("low"), pincode(s).alias("pin")), parsed))
