"""String similarities without a Spark builtin, as Arrow functions over whole batches; each distinct pair is computed once."""

from __future__ import annotations

from difflib import SequenceMatcher, get_close_matches
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from idloom.functions import text as T


@lru_cache(maxsize=65536)
def seq_ratio_of(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; 0 if either is empty.  Not symmetric."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@lru_cache(maxsize=65536)
def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler that always boosts by the prefix and doesn't floor half transpositions."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j, ch in enumerate(b):
        places.setdefault(ch, []).append(j)
    left, begin = [], dict.fromkeys(places, 0)
    for i, ch in enumerate(a):  # the first free place of the character within reach; those before the reach never come back
        own = places.get(ch, ())
        k = begin.get(ch, 0)
        while k < len(own) and own[k] < i - reach:
            k += 1
        if k < len(own) and own[k] <= i + reach:
            left.append((i, own[k]))
            k += 1
        if ch in begin:
            begin[ch] = k
    if not left:
        return 0.0
    m = len(left)
    moved = sum(a[i] != b[j] for (i, _), j in zip(left, sorted(j for _, j in left)))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


@lru_cache(maxsize=4096)
def closest_gender_of(s: str) -> str | None:
    found = get_close_matches(s, ["MALE", "FEMALE", "OTHER"], n=1, cutoff=0.6)
    return found[0].title() if found else None


def _pairwise(fn):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run


def seq_ratio(a: Column, b: Column) -> Column:
    return _pairwise(seq_ratio_of)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler_of)(a, b)


def gender(c: Column) -> Column:
    """Male, Female or Other by the first letters, else by the closest of the three."""

    @F.arrow_udf("string")
    def closest(s: pa.Array) -> pa.Array:
        return pa.array([closest_gender_of(x) if x else None for x in s.to_pylist()], pa.string())

    known = T.gender_prefix(c)
    return F.coalesce(known, closest(F.when(known.isNull(), F.regexp_replace(F.upper(c), "[^A-Z]", ""))))


gender.costly = True
#: The normalisers of fields, with the one for genders that knows misspelt words.
REGISTRY = {k: gender if fn is T.gender_prefix else fn for k, fn in T.REGISTRY.items()}


def name_score(a: Column, b: Column) -> Column:
    x, y = F.upper(T.stripped(a)), F.upper(T.stripped(b))
    return 0.3 * jaro_winkler(x, y) + 0.1 * (T.soundex(x) == T.soundex(y)).cast("double") + 0.3 * T.token_jaccard(x, y) + 0.3 * seq_ratio(x, y)


def address_score(a: Column, b: Column) -> Column:
    """Mean of what both parsed addresses have: equal pincode, equal state, ratio of the texts; 0 for a missing address."""
    parts, n = [], []
    for key in ("pincode", "state"):
        both = a[key].isNotNull() & b[key].isNotNull()
        parts.append(F.when(both, (F.lower(a[key]) == F.lower(b[key])).cast("double")).otherwise(0.0))
        n.append(both.cast("int"))
    both = (F.coalesce(a["normalized"], F.lit("")) != "") & (F.coalesce(b["normalized"], F.lit("")) != "")
    parts.append(F.coalesce(F.when(both, seq_ratio(a["normalized"], b["normalized"])), F.lit(0.0)))
    n.append(both.cast("int"))
    return sum(parts[1:], parts[0]) / F.greatest(F.lit(1), sum(n[1:], n[0]))


def accept_pan(old: Column, new: Column) -> Column:
    o, s = T.canonical_pan(old), T.canonical_pan(new)
    return (F.length(o) == 10) & s.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]\z") & T.same_class(o, s) & (seq_ratio(o, s) >= 0.85)


def accept_aadhaar(old: Column, new: Column) -> Column:
    o, s = T.canonical_aadhaar(old), T.canonical_aadhaar(new)
    return (F.length(o) == 12) & (F.length(s) == 12) & T.same_class(o, s) & (seq_ratio(o, s) >= 0.98)


def accept_dob(old: Column, new: Column) -> Column:
    found = T.recover_dob(old)
    return (found != "") & (T.stripped(new) == found)


def accept_name(old: Column, new: Column) -> Column:
    fold = lambda c: F.upper(T.stripped(F.regexp_replace(F.translate(T.stripped(c), "_", " "), r"\s+", " ")))
    return (fold(old) != "") & (fold(new) != "") & (seq_ratio(fold(old), fold(new)) >= 0.85)


def field_match(field: Column, truth: Column, got: Column) -> Column:
    """struct<exact, fuzzy>; fields of numbers and dates have no fuzzy match."""
    t, p = T.comparable(truth), T.comparable(got)
    exact = (t != "") & (t == p)
    near = (t != "") & (p != "") & (jaro_winkler(t, p) >= 0.9)
    return F.struct(exact.alias("exact"), (exact | (~F.lower(field).rlike("number|date|dob|expiry|issue") & near)).alias("fuzzy"))
