"""What SQL doesn't cover: similarities against plain versions, generators, pictures, files and streams."""

import time
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from idloom.functions import similarity as S
from idloom.functions import text as T
from idloom.operators import extraction, generate, images, resolve
from idloom.sources import files
from idloom.streaming import cases

PAIRS = [("RAHUL", "RXYZW"), ("ABCVWXYZ", "CABVWXYZ"), ("MARTHA", "MARHTA"), ("", "A"), ("A", "A"), ("RAHUL KUMAR", "KUMAR RAHUL"), ("X" * 300 + "Y", "Y" + "X" * 300)]


def plain_jaro_winkler(a: str, b: str) -> float:
    """From the definition: matches in order of `a`, half of the transpositions unrounded, a prefix of up to four always counts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, taken, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == c:
                taken.add(j)
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(left, sorted(taken))) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def test_similarities_equal_plain_versions(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(PAIRS)], "k int, a string, b string")
    got = {r.k: r for r in df.select("k", S.seq_ratio(F.col("a"), F.col("b")).alias("r"), S.jaro_winkler(F.col("a"), F.col("b")).alias("j")).collect()}
    for k, (a, b) in enumerate(PAIRS):
        assert abs(got[k].r - SequenceMatcher(None, a, b).ratio()) < 1e-12
        assert abs(got[k].j - plain_jaro_winkler(a, b)) < 1e-12


def test_addresses_and_names_of_one_case(spark):
    rows = spark.createDataFrame([("a", 0, "1 MG Road, Pune, 411001"), ("a", 1, "1 mg rd, Pune, 411001"), ("b", 0, "x")], "case_id string, ordinal int, value string")
    got = {r.case_id: r.address_score for r in resolve.resolve_addresses(rows).collect()}
    assert got["b"] == 1.0 and 0.9 < got["a"] <= 1.0
    names = {r.case_id: r for r in resolve.resolve_names(rows).collect()}
    assert names["b"].match_score == 1.0 and names["a"].canonical_name == "1 MG Road, Pune, 411001"


def test_rescue_takes_only_what_a_check_accepts(spark):
    fields = spark.createDataFrame([(1, "date_of_birth", "O1/I2/1990", 0.4), (2, "date_of_birth", "01/12/1990", 0.4), (3, "address", "x", 0.4), (4, "pan_number", "ABCPD1234E", 0.4)], "doc_id int, field string, value string, conf double")
    said = spark.createDataFrame([(1, "date_of_birth", "01/12/1990"), (2, "date_of_birth", "02/12/1990"), (3, "address", "y"), (4, "pan_number", ""), (5, "name", "new")], "doc_id int, field string, suggested string")
    got = {r.doc_id: (r.value, r.conf, r.source) for r in extraction.rescue(fields, said).collect()}
    assert got == {1: ("01/12/1990", 0.8, "llm_rescue"), 2: ("01/12/1990", 0.4, None), 3: ("x", 0.4, None), 4: ("ABCPD1234E", 0.4, None)}


def test_identities_are_valid_and_the_same_again(spark):
    people = generate.people(spark, 200, 5)
    good = people.select("*", T.pan(F.col("pan_number")).alias("p"), T.verhoeff_valid(F.regexp_replace("aadhaar_number", " ", "")).alias("v")).collect()
    assert all(r.p == r.pan_number and r.v and r.pan_number[3] == "P" and r.pan_number[4] == r.surname[0].upper() for r in good)
    assert people.collect() == generate.people(spark, 200, 5).collect() != generate.people(spark, 200, 6).collect()


def test_perturbed_values_keep_their_shape(spark):
    for before, after in spark.createDataFrame([("A12",), ("ab",), ("--",)], "a string").select("a", generate.perturbed(F.col("a"), F.col("a"))).collect():
        if before == "--":
            assert after == "--X"
        else:
            assert len(after) == len(before) and sum(x != y for x, y in zip(before, after)) <= 2


def test_pictures(spark):
    flat, noisy = np.full((40, 50), 128, np.uint8), np.random.default_rng(1).integers(6, 249, (40, 50)).astype(np.uint8)
    rows = [(1, flat.tobytes(), 40, 50), (2, noisy.tobytes(), 40, 50), (3, None, None, None), (4, np.full((40, 50), 255, np.uint8).tobytes(), 40, 50)]
    got = {r.id: r for r in images.analyse(spark.createDataFrame([(i, bytearray(d) if d else None, h, w) for i, d, h, w in rows], "id long, gray binary, height int, width int")).collect()}
    assert got[1].good is False and got[2].good is True and got[3].good is None and got[4].white_ratio == 1.0
    assert (images.rotate(noisy, "rot90").shape, max(images.shrink(np.zeros((3200, 100), np.uint8)).shape)) == ((50, 40), 1600)


def test_files_make_a_round_trip(spark, tmp_path):
    here = f"file://{tmp_path}"
    rows = spark.createDataFrame([("d1", "pan", "name", "", "A", "me", None, "review"), ("d2", "dl", "name", "", "B", "me", None, "review")], files.CORRECTION)
    files.append_corrections(rows, f"{here}/c")
    files.append_corrections(rows, f"{here}/c")
    assert files.read_corrections(spark, f"{here}/c").count() == 4 and files.read_corrections(spark, f"{here}/c", "pan", None).count() == 2
    assert files.export_training(rows, f"{here}/t") == 2 and files.read_json_if_exists(spark, f"{here}/none", "a int").count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "rule.md").write_text("## one\ntext")
    assert [tuple(r) for r in files.read_policies(spark, f"{here}/p").collect()] == [("rule.md", "## one\ntext")]
    (tmp_path / "r.json").write_text('{"results": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "l.json").write_text('[{"id": 3}]')
    assert [r.id for f in "rl" for r in files.read_results(spark, f"{here}/{f}.json", "struct<id:int>").collect()] == [1, 2, 3]
    assert files.input_manifest(files.read_blobs(spark, f"{here}/p")).first().bytes == 11


def test_streams_of_cases(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("a", "j1", 2), ("a", "j1", 2), ("a", "j2", 2), ("b", "j3", 2)], "case_id string, job_id string, expected long").coalesce(1).write.json(src)
    stream = spark.readStream.schema("case_id string, job_id string, expected long").json(src)
    running = cases.append_sink(cases.case_progress(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/chk", until_empty=False)
    until = time.time() + 90
    while not any(p["numInputRows"] for p in running.recentProgress) and time.time() < until:
        time.sleep(0.5)
    running.stop()
    got = {(r.case_id, r.event, r.done) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("a", "started", 0), ("a", "document_complete", 1), ("a", "document_complete", 2), ("a", "case_complete", 2), ("b", "started", 0), ("b", "document_complete", 1)}


def test_a_streamed_ledger_equals_the_table_s(spark, tmp_path):
    from idloom.operators import ledger

    rows = spark.createDataFrame([("a", 0, "x", "1"), ("a", 1, "y", "2"), ("b", 0, "x", "3")], "case_id string, ordinal int, event_type string, payload string")
    rows.coalesce(1).write.json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).json(f"file://{tmp_path}/in")
    cases.append_sink(cases.streaming_ledger(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/chk").awaitTermination()
    keys = ("case_id", "sequence", "event_hash", "prev_hash")
    assert sorted(tuple(r[k] for k in keys) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == sorted(tuple(r[k] for k in keys) for r in ledger.append(rows).collect())
