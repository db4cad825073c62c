"""Queries that grew faster than their tables: results against plain versions, and what their plans may not hold."""

import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from idloom.functions import text as T
from idloom.operators import extraction, forensics, generate, parts, resolve, retrieve
from idloom.plans import records, tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_leave_one_out(rows: list[tuple], margin: float) -> dict:
    """From the definition, as the query's SQL has it: a null value counts as another row, and a row without a value is inside."""
    out = {}
    for g, k, v in set(rows):
        rest = [x for h, j, x in rows if h == g and j != k]
        if len(rest) < 4:
            continue
        known = [x for x in rest if x is not None]
        flag = 0
        if v is not None and known:
            mid = statistics.median(known)
            unit = statistics.median(abs(x - mid) for x in known) or statistics.pstdev(known) or 1e-6
            flag = int(v > mid + margin * unit)
        out.setdefault(g, []).append(flag)
    return {g: (len(x), round(sum(x) / len(x), 9)) for g, x in out.items()}


LOO = {
    "even": [("a", k, float(k * k % 37)) for k in range(40)],
    "odd": [("a", k, float(k * k % 41)) for k in range(41)],
    "groups": [("abc"[k % 3], k, float(k * 7 % 19)) for k in range(50)] + [("d", 90 + k, 1.0 * k) for k in range(4)] + [("e", 95 + k, 1.0 * k * k) for k in range(5)],
    "no spread": [("a", k, 5.0) for k in range(9)] + [("a", 9, 5.0000001), ("a", 10, 9.0), ("a", 11, 5.5), ("b", 0, 1.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0), ("b", 4, 7.0)],
    "nulls": [("a", k, None if k % 3 == 0 else float(k)) for k in range(20)] + [("b", k, None) for k in range(6)] + [("c", 0, 3.0)] + [("c", k, None) for k in range(1, 6)],
    "shared keys": [("a", k // 2, float(k * k % 23)) for k in range(24)] + [("a", 50 + k, float(k)) for k in range(5)],
}


@pytest.mark.parametrize("name", LOO)
def test_leave_one_out_equals_its_definition(spark, name):
    rows = spark.createDataFrame(LOO[name], "g string, k int, v double")
    got = {r.g: (r.n, round(r.false_positive_rate, 9)) for r in forensics.leave_one_out(rows, "g", "k", "v", 1.5).collect()}
    assert got == plain_leave_one_out(LOO[name], 1.5)


def test_leave_one_out_makes_no_pairs(spark):
    """60,000 rows a group are 3.6 thousand million pairs."""
    rows = spark.range(60_000).select(F.lit("a").alias("g"), F.col("id").alias("k"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    assert forensics.leave_one_out(rows, "g", "k", "v", 1.5).first().n == 60_000


def test_equal_names_meet_in_many_sorted_parts(spark):
    df = tables.QUERIES["join_name_pairs"](spark, SF)
    plan = plan_of(df)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_equal_pairs_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", None, "x"), (None, 5, "x"), (None, 6, "x"), ("b", 1, "x"), ("b", 2, "y")], "case_id string, ordinal int, value string")
    assert sorted(map(tuple, resolve.equal_pairs(rows).collect())) == [("a", 1, 2), ("a", 1, 2)]


def written_out(value, *key):
    """What `generate.perturbed` says, with its places found anew for each character."""
    chars = F.split(value, "")
    is_digit, is_letter = lambda c: c.rlike("^[0-9]$"), lambda c: c.rlike("^[A-Za-z]$")
    place = F.filter(F.transform(chars, lambda c, i: F.when(F.when(F.exists(chars, is_digit), is_digit(c)).otherwise(is_letter(c)), i)), lambda i: i.isNotNull())
    n = F.size(place)
    a, b = (F.get(place, generate.draw(1 << 30, *key, k).cast("int") % n) for k in (1, 2))
    new = F.transform(chars, lambda c, i: F.when((i == a) | (i == b), F.when(is_digit(c), generate.draw(10, *key, i).cast("string")).otherwise(generate.letter(*key, i))).otherwise(c))
    return F.when(n == 0, F.concat(value, F.lit("X"))).otherwise(F.array_join(new, ""))


def test_perturbed_values_are_those_of_the_formula(spark):
    odd = ["", "A", "7", "--", "a\nb", "١٢", "éß", "😀1", "ÀB", " 12 ", "[`@{/:", None, "ABCPD1234E", "x" * 300]
    rows = spark.createDataFrame([(k, v, w) for k, v in enumerate(odd) for w in ("s", None, "ABCPD1234E")], "k int, v string, w string")
    for k, a, b in rows.select("k", generate.perturbed(F.col("v"), F.col("w"), F.col("k")), written_out(F.col("v"), F.col("w"), F.col("k"))).collect():
        assert a == b, odd[k]


def test_perturbing_splits_a_value_once_and_in_many_parts(spark):
    df = records.QUERIES["fn_perturb"](spark, SF)
    assert plan_of(df).count("split(") == 1 and df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_dense_search_is_exact_in_one_pass_over_groups(spark):
    x = np.random.default_rng(3).normal(size=(700, 16)).astype(np.float32)
    x[300:400] = x[100:200]  # ties go by id
    x[400:500] = x[100:200] * (1 + np.arange(100)[:, None] / 1e6).astype(np.float32)  # no tie but in single precision
    x[500] = 0
    rows = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, embedding array<float>")
    found = retrieve.dense_search(rows, rows.withColumnRenamed("id", "query_id"), 6, block=64)
    assert plan_of(found).count("MapInArrow") == 1
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    want = {(7 * q, int(r) + 1): 7 * int(i) for q in range(700) for r, i in enumerate(np.lexsort((np.arange(700), -s[q]))[:6])}
    assert {(h.query_id, h["rank"]): h.id for h in found.collect()} == want


def test_dense_search_of_few_vectors(spark):
    one = spark.createDataFrame([(5, [1.0, 2.0])], "id long, embedding array<double>")
    none = one.where("false")
    asked = lambda df: df.withColumnRenamed("id", "query_id")
    assert [(h.query_id, h.id, round(h.score, 9)) for h in retrieve.dense_search(one, asked(one), 3).collect()] == [(5, 5, 1.0)]
    assert retrieve.dense_search(one, asked(none), 3).count() == retrieve.dense_search(none, asked(one), 3).count() == 0


PACKETS = [
    ("a", 0, {"name": "Asha Devi", "date_of_birth": "15/08/1990", "gender": "f"}),
    ("a", 1, {"name": "Rahul Kumar", "surname": "Kumar", "date_of_birth": "1990-08-15", "gender": "F"}),
    ("a", 2, {"name": "Rahul Kumar", "date_of_birth": "16/08/1990", "gender": ""}),
    ("b", 0, {"name": "X", "surname": "Completely else", "date_of_birth": "1/1/1990"}),
    ("c", 0, {"gender": "M"}),
    ("c", 1, {"gender": "F", "date_of_birth": ""}),
    ("d", 0, {"other": "x"}),
    ("d", 1, None),
    (None, 0, {"date_of_birth": "1/1/1990", "gender": "M"}),
    (None, 1, {"date_of_birth": "2/1/1990", "gender": "F"}),
]


def test_counted_contradictions_are_those_listed(spark):
    packet = spark.createDataFrame([(*p[:2], "pan", p[2]) for p in PACKETS], "case_id string, ordinal int, doc_type string, fields map<string,string>")
    listed = [(r.case_id, r.type, r.severity) for r in resolve.contradictions(packet).collect()]
    assert {(r.type, r.severity): r.n for r in resolve.severities(packet).collect()} == Counter(r[1:] for r in listed)
    assert {t for _, t, _ in listed} == {"name_mismatch", "dob_mismatch", "gender_mismatch"}
    got = {r.case_id: r for r in resolve.consistency(packet).collect()}
    assert {c: r.issues for c, r in got.items()} == {"a": 0, "b": 0, "c": 0, "d": 0, None: 0} | Counter(r[0] for r in listed)
    assert got["a"].recommendation == "REJECT" and got["c"].recommendation == "REVIEW" and got["b"].consistency_score == 1.0 and got["c"].consistency_score == 0.5


@pytest.mark.parametrize("name", ["dec_severity", "agg_gender_distinct", "agg_consistency"])
def test_documents_of_a_case_are_counted_without_a_join(spark, name):
    """By case in many parts, each of which sums up what it holds: a join would sort both sides in a task."""
    plan = plan_of(tables.QUERIES[name](spark, SF))
    assert "Join" not in plan and "hashpartitioning(case_id" in plan and "REPARTITION_BY_NUM" in plan


def test_best_by_bm25_are_those_of_the_full_list(spark):
    words = ["the", "a", "tax", "PAN", "Éire", "x y", "İd", "ΑΣ", "z9"]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, rng.integers(1, 9), p=[0.5, 0.2] + [0.3 / 7] * 7)) + "\t\n the" * int(i % 3 > 0) for i in range(300)] + ["", "  ", None, "nobody asks"]
    corpus = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "the THE tax"), (2, "pan éire"), (3, "a a z9 unknown"), (4, ""), (5, None), (6, "αs x y ΑΣ i̇d"), (1, "the z9")], "query_id long, text string")
    rows = lambda df: {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in df.collect()}
    want = rows(retrieve.top_hits(retrieve.bm25(corpus, asked), 7, positive=True))
    assert want and rows(retrieve.bm25_best(corpus, asked, 7)) == want
    split = retrieve.Asked([(1, b"a b a"), (2, b"b c"), (3, b"d")], most=6)
    assert len(split.blocks) == 2 and split.words == {b"a", b"b", b"c", b"d"}
    assert retrieve.bm25_best(corpus.where("false"), asked, 7).count() == retrieve.bm25_best(corpus, asked.where("false"), 7).count() == 0


@pytest.mark.parametrize("name", ["ret_bm25", "ret_rerank", "ret_hybrid"])
def test_sparse_search_shuffles_no_words_of_documents(spark, name):
    """Texts stay where they are read: only hits are shuffled, and rerank's texts are met by broadcast hits."""
    plan = plan_of(tables.QUERIES[name](spark, SF))
    assert "Generate explode" not in "\n".join(x for x in plan.split("\n") if "word" in x) and ("SortMergeJoin" not in plan or name == "ret_hybrid")


def written_out_parts(c):
    """What `text.address_parts` says, each part found by itself."""
    s = T.stripped(F.regexp_replace(c, r"\s+", " "))
    low, padded, pin = F.lower(s), F.concat(F.lit(" "), F.upper(s), F.lit(" ")), T.pincode(s)
    state = F.coalesce(*[F.when(low.contains(full.lower()) | padded.contains(f" {code} "), full) for code, full in T.STATES.items()])
    parts = F.transform(F.split(s, ","), lambda p: F.trim(p))
    last = F.element_at(parts, -1)
    city = F.when(F.size(parts) >= 3, F.when(last == pin, F.element_at(parts, -2)).otherwise(last))
    table = F.create_map(*[F.lit(x) for pair in T.SHORT.items() for x in pair])
    words = F.transform(F.split(low, " "), lambda w: F.coalesce(F.try_element_at(table, F.regexp_replace(w, "[^a-z]", "")), w))
    there = F.coalesce(c, F.lit("")) != ""
    return [F.when(there, x) for x in (F.array_join(words, " "), pin, state, city)]


def test_addresses_are_taken_apart_as_the_formula_says(spark):
    odd = [None, "", " ", ",", ",,", "a,b,", "1 MG Rd,  Pune, MH, 411001", "x, y, 012345", "x, y, 560001, 560001", "Nr. stn\tOpp mall", "goa", "a DL b", "É rd, İ, Ω", "h.no 5, po, KA, "]
    rows = spark.createDataFrame([(a,) for a in odd], "a string")
    for got, *want in rows.select(T.address_parts(F.col("a")), *written_out_parts(F.col("a"))).collect():
        assert list(got) == want


@pytest.mark.parametrize("name", ["fn_addr_norm", "join_addr_pairs", "fn_addr_compare", "agg_addr_mean"])
def test_addresses_are_taken_apart_once_and_in_many_parts(spark, name):
    df = {**records.QUERIES, **tables.QUERIES}[name](spark, SF)
    # Once for each side of a pair, of which Spark runs one.
    assert plan_of(df).count("array_join") <= 2 and plan_of(df).count("REPARTITION_BY_NUM") >= 1


def test_documents_are_routed_as_their_scores_say(spark):
    fields = ["pan_number", "name", "father_name", "dob", "aadhar_number", "gender", "address", "Name ", "odd", None]
    rng = np.random.default_rng(9)
    rows = [(int(d), int(r), ["pan", "aadhaar", "other"][int(k)], fields[int(f)], None if c == 0 else float(c) / 8) for d, r, k, f, c in zip(rng.integers(0, 30, 600), rng.integers(0, 4, 600), rng.integers(0, 3, 600), rng.integers(0, 10, 600), rng.integers(0, 9, 600))] + [(99, 2, "other", "odd", 0.5)]
    top = {}
    for d, r, k, f, c in rows:
        key = {"dob": "date_of_birth", "aadhar_number": "aadhaar_number"}.get(f, (f or "").strip().lower())
        top.setdefault((d, r), {}).setdefault((k, key), []).append(c or 0.0)
    want = {}
    for (d, r), own in top.items():
        both = []
        for kind, other in (("pan", "aadhaar"), ("aadhaar", "pan")):
            best = {f: max(c) for (k, f), c in own.items() if k == kind}
            mine, theirs = ([best.get(f, 0.0) for f in extraction.EXPECTED[x]] for x in (kind, other))
            both.append(2 * sum(c >= 0.25 for c in mine) / len(mine) + sum(mine) - 0.35 * sum(c for c in theirs if c >= 0.25))
        want[d] = max(want.get(d, (-9.0,)), (round(max(both), 9), -r, *(round(x, 9) for x in both)))
    df = extraction.route_documents(spark.createDataFrame(rows, "doc_id int, rotation_order int, detector string, field string, conf double"))
    assert plan_of(df).count("Exchange") == 1
    assert {h.doc_id: (h.rotation_order, round(h.score_pan, 9), round(h.score_aadhaar, 9)) for h in df.collect()} == {d: (-r, p, a) for d, (_, r, p, a) in want.items()}


def test_parts_grow_with_the_table(spark):
    assert parts.many(spark.range(10)) == parts.least_parts(spark.range(10))
    assert parts.many(spark.range(10**8)) == 8 * 10**8 // parts.PART
    assert parts.many(spark.range(10**15)) == 40 * parts.least_parts(spark.range(10))
