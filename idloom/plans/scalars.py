"""Queries of the scalar operators: each over values derived from the keys of a whole table, with its equivalent in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import text as T
from idloom.operators import decide, extraction, forensics, generate
from idloom.operators.ledger import event_hash


def duck_fold(digits: str, shift: int) -> str:
    """The checksum's fold in DuckDB, from the same two tables."""
    place = f"cast(substr('{T.PERMUTED}', cast(((i + {shift}) % 8) * 10 + cast(substr(reverse({digits}), cast(i + 1 as int), 1) as int) + 1 as int), 1) as bigint)"
    return f"list_reduce(range(0, length({digits})), lambda acc, i: cast(substr('{T.GROUP}', cast(acc * 10 + {place} + 1 as int), 1) as bigint), cast(0 as bigint))"


def duck_valid(s: str) -> str:
    return f"(case when regexp_full_match({s}, '[0-9]+') then {duck_fold(s, 0)} = 0 else false end)"


def duck_digit(s: str) -> str:
    return f"substr('{T.INVERSE}', cast({duck_fold(s, 1)} + 1 as int), 1)"


STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
UPPER_KEEP = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
L2D, L2D_BAR, D2L = (", ".join(f"'{x}'" for x in pair) for pair in (T.LETTER_TO_DIGIT, T.LETTER_OR_BAR_TO_DIGIT, T.DIGIT_TO_LETTER))

# Values in a dialect that Spark and DuckDB share; `id` is the key.
BODY = "lpad(cast(20000000000 + (id * 7654321 + 12345) % 79999999999 as string), 11, '0')"
DAY = "lpad(cast(1 + id % 31 as string), 2, '0') || '/' || lpad(cast(1 + id % 12 as string), 2, '0') || '/' || cast(1950 + id % 70 as string)"
PAN = "chr(cast(65 + id % 26 as int)) || chr(cast(65 + id * 3 % 26 as int)) || chr(cast(65 + id * 7 % 26 as int)) || 'P' || chr(cast(65 + id * 11 % 26 as int)) || lpad(cast(id * 37 % 10000 as string), 4, '0') || chr(cast(65 + id * 5 % 26 as int))"
NAMES = "case id % 6 when 0 then 'Rahul  Kumar' when 1 then 'MEERA O''Neil-' || cast(id as string) when 2 then ' Asha. Devi ' when 3 then 'S. 123' when 4 then '99' else 'Tata Motors' end"
MISREAD = f"translate({PAN}, 'OISBZG', '015826')"
ADDRESS = "cast(id % 200 as string) || ' MG Rd,  ' || case id % 5 when 0 then 'Bengaluru, Karnataka 560001' when 1 then 'Near stn, Pune, MH, 411001' when 2 then 'Opp mall, Kolkata, West Bengal, 012345' when 3 then 'x, Goa' else 'nr. lake, Chennai, tn 600001' end"

#: name: (value or values as SQL, Spark expression of them, DuckDB expression of them).  `a`, `b` name the values.
Scalar = tuple[str, Callable[..., Column], str]
SCALARS: dict[str, Scalar] = {
    "fn_safe_str": ("case when id % 3 = 0 then chr(9) || ' v' || cast(id as string) || ' ' when id % 3 = 1 then null else 'x ' end as a", lambda a: T.stripped(a), STRIP.format("a")),
    "fn_scientific": ("case when id % 3 = 0 then cast(id as string) || 'e3' when id % 3 = 1 then '1.5E' || cast(id % 9 as string) else 'name' || cast(id as string) end as a", lambda a: T.fix_scientific(a), r"case when regexp_full_match(a, '[+-]?[0-9]*\.?[0-9]+[eE][+-]?[0-9]+') then cast(cast(trunc(cast(a as double)) as bigint) as string) else a end"),
    "fn_gender": ("case id % 9 when 0 then 'male' when 1 then 'Female ' when 2 then 'f' when 3 then 'MAN' when 4 then 'Woman' when 5 then 'oth.' when 6 then 'T' when 7 then '12 m' else 'xyz' end as a", lambda a: T.gender_prefix(a), "case when regexp_replace(upper(a), '[^A-Z]', '', 'g') like 'M%' then 'Male' when regexp_matches(regexp_replace(upper(a), '[^A-Z]', '', 'g'), '^(F|WOMAN)') then 'Female' when regexp_matches(regexp_replace(upper(a), '[^A-Z]', '', 'g'), '^(T|OTH)') then 'Other' end"),
    "fn_date": (
        f"case id % 6 when 0 then 'DOB: ' || {DAY} when 1 then replace({DAY}, '/', '-') when 2 then 'Year of Birth 19' || lpad(cast(id % 100 as string), 2, '0') when 3 then '45/13/1990' when 4 then 'date ' || cast(1 + id % 9 as string) || '.' || cast(1 + id % 9 as string) || '.2003' else 'none' end as a",
        lambda a: T.date(a),
        r"""(select case when try_cast(d as int) between 1 and 31 and try_cast(m as int) between 1 and 12 then lpad(d, 2, '0') || '/' || lpad(m, 2, '0') || '/' || y else nullif(regexp_extract(s, '\b((?:19|20)\d{2})\b', 1), '') end
        from (select s, regexp_extract(s, '(\d{1,2})[/\-.](\d{1,2})[/\-.]((?:19|20)\d{2})', 1) d, regexp_extract(s, '(\d{1,2})[/\-.](\d{1,2})[/\-.]((?:19|20)\d{2})', 2) m, regexp_extract(s, '(\d{1,2})[/\-.](\d{1,2})[/\-.]((?:19|20)\d{2})', 3) y
        from (select regexp_replace(trim(a), '(?i)^(date|dob|birth|of|year|yob|:|\s)+', '') s)))""",
    ),
    "fn_verhoeff": (f"case when id % 4 = 0 then cast(id as string) || 'x' else {BODY} || cast(id % 10 as string) end as a", lambda a: T.verhoeff_valid(a), duck_valid("a")),
    "fn_verhoeff_digit": (f"{BODY} as a", lambda a: T.verhoeff_digit(a), duck_digit("a")),
    "fn_pan": (
        f"case id % 6 when 0 then lower({PAN}) when 1 then {MISREAD} when 2 then substr({PAN}, 1, 5) || '-' || translate(substr({PAN}, 6, 4), '015826', 'OISBZG') || substr({PAN}, 10, 1) when 3 then substr({PAN}, 1, 9) when 4 then '12345ABCDE' else {PAN} end as a",
        lambda a: T.pan(a),
        f"""(select case when length(s) = 10 and regexp_full_match(f, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') then f end from (select s, translate(substr(s, 1, 5), {D2L}) || translate(substr(s, 6, 4), {L2D}) || translate(substr(s, 10, 1), {D2L}) f from (select {UPPER_KEEP.format('a')} s)))""",
    ),
    "fn_name": (f"{NAMES} as a", lambda a: T.name(a), r"nullif(trim(regexp_replace(regexp_replace(a, '[^A-Za-z\s.''\-]', '', 'g'), '\s+', ' ', 'g')), '')"),
    "fn_passport": ("case when id % 3 = 0 then 'k ' || lpad(cast(id as string), 7, '0') when id % 3 = 1 then 'KK' || cast(id as string) else 'Z' || lpad(cast(id as string), 7, '1') end as a", lambda a: T.passport(a), f"case when regexp_full_match({UPPER_KEEP.format('a')}, '[A-Z][0-9]{{7}}') then {UPPER_KEEP.format('a')} end"),
    "fn_ifsc": ("case when id % 2 = 0 then 'hdfc0' || lpad(cast(id as string), 6, '0') else 'HDFC1' || lpad(cast(id as string), 6, '0') end as a", lambda a: T.ifsc(a), f"case when regexp_full_match({UPPER_KEEP.format('a')}, '[A-Z]{{4}}0[A-Z0-9]{{6}}') then {UPPER_KEEP.format('a')} end"),
    "fn_dl": ("case when id % 2 = 0 then 'mh-12 ' || cast(20000000000 + id as string) else 'MH/' || cast(id as string) end as a", lambda a: T.driving_license(a), f"case when length({UPPER_KEEP.format('a')}) >= 10 then {UPPER_KEEP.format('a')} end"),
    "fn_voter": ("case when id % 2 = 0 then 'abc ' || lpad(cast(id as string), 7, '0') else 'AB' || cast(id as string) end as a", lambda a: T.voter_id(a), f"case when length({UPPER_KEEP.format('a')}) >= 8 then {UPPER_KEEP.format('a')} end"),
    "fn_address": (f"case when id % 7 = 0 then 'short' when id % 7 = 1 then 'a,  , b  c,' || cast(id as string) || '  ' else {ADDRESS} end as a", lambda a: T.address(a), r"case when length(regexp_replace(trim(regexp_replace(a, '\s+', ' ', 'g')), ',\s*,', ',', 'g')) >= 10 then regexp_replace(trim(regexp_replace(a, '\s+', ' ', 'g')), ',\s*,', ',', 'g') end"),
    "fn_pincode": (f"{ADDRESS} as a", lambda a: T.pincode(a), r"case when regexp_extract(a, '\b([0-9]{6})\b', 1) <> '' and regexp_extract(a, '\b([0-9]{6})\b', 1) not like '0%' then regexp_extract(a, '\b([0-9]{6})\b', 1) end"),
    "fn_amount": ("case when id % 4 = 0 then 'none' else 'Rs. ' || cast(id as string) || ',500.75/-' end as a", lambda a: T.amount(a), "nullif(regexp_replace(a, '[^0-9.,]', '', 'g'), '')"),
    "fn_ocr_clean": (
        f"case id % 4 when 0 then 'dob' when 1 then 'pan_number' when 2 then 'Aadhaar_number' else 'name' end as a, case id % 8 when 0 then 'born ' || {DAY} || ' x' when 1 then 'no ' || lower({PAN}) when 2 then '1234 5678 ' || lpad(cast(id as string), 4, '0') when 5 then ' none ' else ' text ' || cast(id as string) end as b",
        lambda a, b: T.ocr_clean(a, b),
        r"""(select case when a like '%dob%' or a like '%date%' then coalesce(nullif(regexp_extract(s, '[0-9]{2}/[0-9]{2}/[0-9]{4}'), ''), s) when a like '%pan_number%' then coalesce(nullif(regexp_extract(upper(s), '[A-Z]{5}[0-9]{4}[A-Z]'), ''), s)
        when lower(a) like '%aadhaar%' and length(regexp_replace(s, '[^0-9]', '', 'g')) = 12 then regexp_replace(s, '[^0-9]', '', 'g') else s end from (select trim(b) s))""",
    ),
    "fn_canonical_pan": (f"' ' || lower({PAN}) || '-' as a", lambda a: T.canonical_pan(a), UPPER_KEEP.format("a")),
    "fn_canonical_aadhaar": ("'o|lZ ' || cast(id as string) || 'S b' as a", lambda a: T.canonical_aadhaar(a), f"regexp_replace(translate(upper(a), {L2D_BAR}), '[^0-9]', '', 'g')"),
    "fn_recover_dob": (
        f"case id % 4 when 0 then translate({DAY}, '01', 'OI') when 1 then 'b. ' || cast(1950 + id % 70 as string) when 2 then replace({DAY}, '/', '.') else 'none' end as a",
        lambda a: T.recover_dob(a),
        rf"""(select case when try_cast(regexp_extract(s, p, 1) as int) between 1 and 31 and try_cast(regexp_extract(s, p, 2) as int) between 1 and 12 then lpad(regexp_extract(s, p, 1), 2, '0') || '/' || lpad(regexp_extract(s, p, 2), 2, '0') || '/' || regexp_extract(s, p, 3) else regexp_extract(s, '(?:19|20)[0-9]{{2}}') end
        from (select regexp_replace(translate(translate(upper(a), {L2D_BAR}), '-.', '//'), '[^0-9/]', '', 'g') s, '^([0-9]{{1,2}})/([0-9]{{1,2}})/((?:19|20)[0-9]{{2}})$' p))""".replace("regexp_extract(s, p, 1)", r"regexp_extract(s, '^([0-9]{1,2})/([0-9]{1,2})/((?:19|20)[0-9]{2})$', 1)").replace("regexp_extract(s, p, 2)", r"regexp_extract(s, '^([0-9]{1,2})/([0-9]{1,2})/((?:19|20)[0-9]{2})$', 2)").replace("regexp_extract(s, p, 3)", r"regexp_extract(s, '^([0-9]{1,2})/([0-9]{1,2})/((?:19|20)[0-9]{2})$', 3)"),
    ),
    "fn_same_class": (f"{PAN} as a, case id % 3 when 0 then {MISREAD} when 1 then substr({MISREAD}, 1, 9) else translate({PAN}, 'A', 'B') end as b", lambda a, b: T.same_class(a, b), f"length(a) > 0 and length(a) = length(b) and translate(a, {L2D_BAR}) = translate(b, {L2D_BAR})"),
    "fn_temperature": ("case when id % 5 = 0 then 0.0 when id % 5 = 1 then 1.0 else (id % 97 + 1) / 100.0 end as a", lambda a: F.round(T.temperature(a.cast("double")), 6), "round(case when a <= 0 then 0 when a >= 1 then 1 else 1 / (1 + exp(-ln(cast(a as double) / (1 - cast(a as double))) / 1.5)) end, 6)"),
    "fn_clamp": ("cast(id % 7 - 3 as double) as a", lambda a: T.clamp(a), "greatest(0.0, least(1.0, a))"),
    "fn_sha256_chain": ("lpad(cast(id as string), 64, '0') as a, 'k:' || cast(id as string) as b", lambda a, b: event_hash(a, b), "sha256(a || '||' || b)"),
    "fn_parse_date_multi": (
        "case id % 5 when 0 then '15/08/' when 1 then '01-12-' when 2 then '7.2.' when 3 then '15 Aug ' else 'March 5, ' end || cast(1950 + id % 70 as string) as a",
        lambda a: F.date_format(T.parse_date(a), "yyyy-MM-dd"),
        "strftime(coalesce(try_strptime(a, '%d/%m/%Y'), try_strptime(a, '%d-%m-%Y'), try_strptime(a, '%d.%m.%Y'), try_strptime(a, '%d %b %Y'), try_strptime(a, '%B %d, %Y')), '%Y-%m-%d')",
    ),
    "fn_date_match": (
        "case id % 3 when 0 then '15/08/1990' when 1 then '1990-08-15' else 'soon' end as a, case id % 4 when 0 then '15 Aug 1990' when 1 then '16/08/1990' when 2 then ' soon' else '15.08.1990' end as b",
        lambda a, b: T.dates_match(a, b),
        "(select case when x is not null and y is not null then x = y else trim(a) = trim(b) end from (select coalesce(try_strptime(trim(a), '%d/%m/%Y'), try_strptime(trim(a), '%Y-%m-%d')) x, coalesce(try_strptime(trim(b), '%d/%m/%Y'), try_strptime(trim(b), '%d.%m.%Y'), try_strptime(trim(b), '%d %b %Y')) y))",
    ),
    "fn_strip_alnum": ("'A b_' || cast(id as string) || '-É.' as a", lambda a: T.strip_alnum(a), r"regexp_replace(lower(a), '[^\p{L}\p{N}]+', '', 'g')"),
    "fn_yolo_box": ("cast(id % 100 as double) as a, cast(200 + id % 300 as double) as b", lambda a, b: generate.yolo_box(a, a + 5, b, b + 20, F.lit(1000.0), F.lit(800.0)), "printf('%.6f %.6f %.6f %.6f', (a + b) / 2 / 1000, (a + 5 + b + 20) / 2 / 800, (b - a) / 1000, (b + 20 - a - 5) / 800)"),
    "fn_rot_box": ("cast(id % 100 as int) as a, cast((id % 4) * 90 as int) as b", lambda a, b: F.array_join(generate.rotated_box(a, a + 5, a + 40, a + 30, F.lit(1000), F.lit(800), b).cast("array<string>"), ","), "array_to_string(case b when 90 then [800 - (a + 30), a, 800 - (a + 5), a + 40] when 180 then [1000 - (a + 40), 800 - (a + 30), 1000 - a, 800 - (a + 5)] when 270 then [a + 5, 1000 - (a + 40), a + 30, 1000 - a] else [a, a + 5, a + 40, a + 30] end, ',')"),
    "fn_jpeg_quality": (
        "cast(id % 400 + 1 as double) as a",
        lambda a: forensics.jpeg_quality(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: a * (k % 5 + 8) / 10), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: 10.0 + k % 7)),
        "(select cast(greatest(1, least(100, case when s < 1 then 100 when s <= 100 then round_even((200 - s) / 2, 0) else round_even(5000 / s, 0) end)) as int) from (select list_median([100.0::double * (a * (k % 5 + 8) / 10) / (10.0::double + k % 7) for k in range(1, 65)]) s))",
    ),
    "proj_doc_type": ("case id % 5 when 0 then ' Aadhar' when 1 then 'PAN ' when 2 then '' when 3 then null else 'visa' end as a", lambda a: T.normalise_doc_type(a), "case lower(trim(coalesce(a, ''))) when '' then 'auto' when 'aadhar' then 'aadhaar' else lower(trim(a)) end"),
    "proj_key": ("case id % 4 when 0 then 'DOB' when 1 then ' aadhar_number' when 2 then 'Name' else '' end as a", lambda a: T.normalise_key(a), "case lower(trim(a)) when 'dob' then 'date_of_birth' when 'aadhar_number' then 'aadhaar_number' else lower(trim(a)) end"),
    "proj_celery_state": ("case id % 8 when 0 then 'PENDING' when 1 then 'RECEIVED' when 2 then 'RETRY' when 3 then 'STARTED' when 4 then 'SUCCESS' when 5 then 'FAILURE' when 6 then 'REVOKED' else 'ODD' end as a", lambda a: decide.queue_state(a), "case when a in ('PENDING', 'RECEIVED', 'RETRY') then 'QUEUED' when a = 'STARTED' then 'RUNNING' when a = 'SUCCESS' then 'SUCCEEDED' when a in ('FAILURE', 'REVOKED') then 'FAILED' else 'UNKNOWN' end"),
    "proj_failure_reason": (
        "case id % 7 when 0 then null when 1 then 'Field ''pan'' does not match x' when 2 then 'x is not one of [..]' when 3 then ' Missing y' when 4 then 'is a required property' when 5 then '  ' else 'fine' end as a, case when id % 11 = 0 then 'timeout' when id % 13 = 0 then 'ok and valid' end as b",
        lambda a, b: decide.failure_reason(b.isNull() | (b != "timeout"), b, F.coalesce(b == "ok and valid", F.lit(False)), a),
        "case when b = 'timeout' then 'transport:timeout' when b = 'ok and valid' then 'valid' when trim(coalesce(a, '')) = '' then 'invalid:unknown' when lower(a) like '%does not match%' then 'invalid:regex_mismatch' when lower(a) like '%is not one of%' then 'invalid:enum' when lower(a) like '%missing%' then 'invalid:missing' else 'invalid:other' end",
    ),
    "proj_infer_type": ("case id % 4 when 0 then 'pan_number,name' when 1 then 'name,father_name' when 2 then 'gender,name' else 'other' end as a", lambda a: extraction.infer_type(F.split(a, ",")), "case when a like '%pan%' or a like '%father%' then 'pan' when a like '%aadhaar%' or a like '%gender%' then 'aadhaar' else 'unknown' end"),
    "proj_safe_id": ("'a/b' || chr(92) || cast(id as string) as a", lambda a: T.safe_id(a), "translate(a, '/' || chr(92), '__')"),
    "proj_ui_status": (
        "case id % 9 when 0 then 'REJECTED_QUALITY' when 1 then 'REJECTED_CONTENT' when 2 then 'REJECTED_SPOOF' when 3 then 'REJECTED_CALIBRATION' when 4 then 'REVIEW' when 5 then 'REVIEW_SPOOF' when 6 then 'AUTO_CLEARED' when 7 then 'SUCCESS' else 'UNKNOWN' end as a, id % 2 = 0 as b",
        lambda a, b: (lambda s: F.concat_ws("|", s["status"], s["error"]))(decide.ui_status(a, b, b, F.lit("too dark"), F.lit("message"))),
        "case a when 'REJECTED_QUALITY' then 'REJECTED|too dark' when 'REJECTED_CONTENT' then 'REJECTED|Back side or Empty Content' when 'REJECTED_SPOOF' then 'REJECTED|Rejected: spoof' when 'REJECTED_CALIBRATION' then 'REJECTED|Rejected: calibration' when 'REVIEW' then 'INVALID|message' when 'REVIEW_SPOOF' then 'INVALID|message' else case when b then 'VALID|message' else 'INVALID|message' end end",
    ),
    "filt_quality": ("case id % 4 when 0 then 'Image is overexposed' when 1 then 'Image is too dark' when 2 then 'too blurry' end as a", lambda a: (lambda q: F.concat_ws(",", q["passed"].cast("string"), q["attempt_rescue"].cast("string")))(extraction.quality_gate(a.isNull(), a)), "case when a is null then 'true,false' when a like '%overexposed%' or a like '%dark%' then 'true,true' else 'false,false' end"),
    "proj_route_type": ("case id % 3 when 0 then 'auto' when 1 then 'PAN' else '' end as a, (id % 100) / 100.0 as b", lambda a, b: (lambda c: F.concat_ws(",", c["doc_type"], c["rotation"]))(extraction.classify(a, F.lit("aadhaar"), F.lit("rot90"), F.lit("rot180"), b)), "case when lower(a) in ('auto', '') then 'aadhaar' else lower(a) end || ',' || case when b >= 0.9 then 'rot180' else 'rot90' end"),
    "dec_manual": ("case id % 4 when 0 then 'APPROVED' when 1 then 'REJECTED' when 2 then 'REQUIRES_INFO' else 'approved' end as a", lambda a: decide.manual_outcome(a), "case when a in ('APPROVED', 'REJECTED', 'REQUIRES_INFO') then a end"),
    "dec_route_vlm": ("(id % 40) / 10.0 as a", lambda a: F.when(a < 0.6, "vlm").otherwise("validate"), "case when a < 0.6 then 'vlm' else 'validate' end"),
    "dec_ensemble": ("case when id % 5 = 0 then null else (id % 41) / 10.0 end as a, case when id % 7 = 0 then null else (id % 37) / 10.0 end as b", lambda a, b: extraction.ensemble_path(a.cast("double"), b.cast("double")), "case when a is not null and b is not null then case when a::double * 0.6::double >= b::double * 0.4::double then 'ensemble_yolo' else 'ensemble_vlm' end when a is not null then 'yolo' when b is not null then 'vlm' end"),
    "dec_unknown_type": ("(id % 11) / 10.0 as a, (id % 7) / 10.0 as b", lambda a, b: extraction.unknown_type(a, b), "case when a >= b then 'pan' else 'aadhaar' end"),
    "dec_policy_value": ("case id % 3 when 0 then true when 1 then false end as a", lambda a: decide.policy_value(a), "cast(case when coalesce(a, true) then 1.0 else 0.3 end as double)"),
    "pred_api_key": (
        "case id % 4 when 0 then 'k1' when 1 then 'k2' when 2 then '' end as a, id % 3 = 0 as b",
        lambda a, b: decide.api_user(a, F.when(b, F.array().cast("array<string>")).otherwise(F.array(F.lit("k1"), F.lit("k3")))),
        "case when b then 'anonymous' when a = 'k1' then 'k1' end",
    ),
    "img_metadata": (
        "case id % 4 when 0 then 'Adobe Photoshop 22' when 1 then 'GIMP 2' when 2 then '' end as a, cast(70 + id % 30 as int) as b",
        lambda a, b: F.array_join(forensics.metadata_flags(a, F.when(b > 90, "Canon"), F.lit(""), F.lit("2020:01:01"), F.when(b % 3 == 0, "2021:01:01").otherwise("2020:01:01"), b), ","),
        "concat_ws(',', case when lower(coalesce(a, '')) like '%gimp%' then 'edited_with_gimp' when lower(coalesce(a, '')) like '%photoshop%' then 'edited_with_photoshop' end, case when b <= 90 and coalesce(a, '') = '' then 'no_device_info' end, case when b % 3 = 0 then 'date_mismatch' end, case when b < 88 then 'low_jpeg_quality' end)",
    ),
}


def scalar_query(spec: Scalar) -> Callable[[SparkSession, str], DataFrame]:
    values, fn, _ = spec

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
        rows = spark.sql(f"select id, {values} from {{keys}}", keys=keys)
        return rows.select("id", fn(*[F.col(c) for c in rows.columns[1:]]).alias("result"))

    return run


def scalar_sql(spec: Scalar) -> str:
    values, _, duck = spec
    return f"WITH k AS (SELECT c_custkey AS id FROM customer), v AS (SELECT id, {values} FROM k) SELECT id, {duck} AS result FROM v"


QUERIES = {name: scalar_query(spec) for name, spec in SCALARS.items()}
SQL = {name: scalar_sql(spec) for name, spec in SCALARS.items()}
