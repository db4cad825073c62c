"""Queries of the remaining operators on records, reports, registries and generators, with their equivalents in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.functions import similarity as S
from idloom.functions import text as T
from idloom.operators import decide, evaluate, extraction, generate, images, learn, ledger, pictures, resolve
from idloom.operators.parts import spread
from idloom.plans.scalars import ADDRESS, DAY, PAN, SCALARS
from idloom.plans.tables import fixture, read, with_fixtures
from idloom.streaming import cases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def of_customers(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    """Columns derived from the key `id` of every customer, in many parts."""
    keys = spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")
    return spark.sql("select id, " + columns.replace("{", "{{").replace("}", "}}") + " from {keys}", keys=keys)


def _customers(columns: str) -> str:
    return f"WITH v AS (SELECT id, {columns} FROM (SELECT c_custkey AS id FROM customer))"


@query("SELECT p_partkey, 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part")
def proj_flat(spark, sf_dir):
    box = lambda c: F.struct(F.col(c).alias("value"), F.lit(0.5).alias("det_conf"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("name"), box("p_name"), F.lit("brand"), box("p_brand")).alias("fields"))
    return rows.select("p_partkey", F.explode(extraction.flat(F.col("fields"))).alias("field", "value"))


@query(with_fixtures("candidates") + ", f AS (SELECT doc_id, count(DISTINCT field) AS n FROM candidates WHERE det_conf >= 0.9 GROUP BY 1) SELECT o_orderkey AS doc_id, coalesce(n, 0) AS fields FROM orders LEFT JOIN f ON doc_id = o_orderkey")
def proj_null_guard(spark, sf_dir):
    sure = fixture(spark, sf_dir, "candidates").where("det_conf >= 0.9").select("doc_id", "field", "text")
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return extraction.extraction_or_empty(docs, sure).select("doc_id", F.size("extraction").cast("bigint").alias("fields"))


@query(with_fixtures("cases") + " SELECT doc_id, CASE WHEN is_valid THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS status, round(score, 4) AS score FROM cases")
def proj_result_shape(spark, sf_dir):
    return fixture(spark, sf_dir, "cases").select(extraction.result_record(F.col("doc_id"), F.col("is_valid"), F.round("score", 4)).alias("r")).select("r.*")


@query("SELECT o_orderkey AS job_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'MATCHED' ELSE 'MISSING' END AS found FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5)")
def proj_debug_ids(spark, sf_dir):
    """The report is of the first five results."""
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")).orderBy("job_id").limit(5)
    known = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("known")).distinct()
    return jobs.join(known, F.col("job_id") == F.col("known"), "left").select("job_id", F.when(F.col("known").isNotNull(), "MATCHED").otherwise("MISSING").alias("found"))


@query("SELECT o_orderkey, array_to_string(list_transform(range(0, o_orderkey % 3 + 1), lambda i: CASE WHEN i = 0 AND o_orderkey % 2 = 0 THEN 'pan' WHEN i = 1 AND o_orderkey % 2 = 0 THEN 'visa' ELSE 'auto' END), ',') AS types FROM orders")
def scan_upload(spark, sf_dir):
    k = F.col("o_orderkey")
    files = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 3), lambda i: i.cast("string"))
    return read(spark, sf_dir, "orders").select(k, F.array_join(decide.upload_types(files, F.when(k % 2 == 0, "pan, visa")), ",").alias("types"))


_IMAGES = "select p_partkey as image_id, 'f' || cast(p_size as string) || '.png' as file, p_partkey % 3 as root from {part}"


@query(f"WITH i AS ({_IMAGES.format(part='part')}), r AS (SELECT s_suppkey, 'f' || cast(s_suppkey % 60 AS string) || '.png' AS file FROM supplier) SELECT s_suppkey, image_id FROM r JOIN (SELECT file, image_id, row_number() OVER (PARTITION BY file ORDER BY root, image_id) AS n FROM i) USING (file) WHERE n = 1")
def join_image_by_name(spark, sf_dir):
    pictures = spark.sql(_IMAGES, part=read(spark, sf_dir, "part"))
    reviews = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("f"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".png")).alias("file"))
    return learn.first_by_name(reviews, pictures, "file", ["root", "image_id"]).select("s_suppkey", "image_id")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers each as the names of one case."""
    return read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 3).alias("case_id"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("value"))


@query()
def agg_name_match(spark, sf_dir):
    out = resolve.resolve_names(_names(spark, sf_dir))
    return out.withColumn("match_score", F.round("match_score", 6))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_customers(spark, sf_dir, f"{ADDRESS} as value")
    return rows.select(F.floor(F.col("id") / 3).alias("case_id"), F.col("id").alias("ordinal"), "value")


@query()
def join_addr_pairs(spark, sf_dir):
    return resolve.pairs(resolve.parsed_addresses(_addresses(spark, sf_dir))).select("case_id", F.col("a.ordinal").alias("i"), F.col("b.ordinal").alias("j"), F.round(S.address_score(F.col("a.p"), F.col("b.p")), 6).alias("score"))


QUERIES["fn_addr_compare"] = join_addr_pairs


@query()
def agg_addr_mean(spark, sf_dir):
    return resolve.resolve_addresses(_addresses(spark, sf_dir)).withColumn("address_score", F.round("address_score", 6))


@query(with_fixtures("jobs") + " SELECT grouping, key, n, cast(row_number() OVER (PARTITION BY grouping ORDER BY n DESC, key) AS int) AS rank FROM (SELECT 'state' AS grouping, state AS key, count(*) AS n FROM jobs GROUP BY 2 UNION ALL SELECT 'batch', cast(batch_id AS string), count(*) FROM jobs GROUP BY 2)")
def agg_eval_summary(spark, sf_dir):
    return evaluate.summary(fixture(spark, sf_dir, "jobs"), {"state": F.col("state"), "batch": F.col("batch_id").cast("string")})


@query("SELECT 'counter' AS kind, event_type AS name, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 2")
def agg_counters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.lit("counter").alias("kind"), F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("WITH c AS (SELECT event_type AS name, count(*) AS n, row_number() OVER (ORDER BY event_type) AS r FROM events GROUP BY 1) SELECT cast(2 * r - 2 AS int) AS position, '# TYPE ' || name || ' counter' AS line FROM c UNION ALL SELECT cast(2 * r - 1 AS int), name || ' ' || cast(n AS string) FROM c")
def sink_metrics(spark, sf_dir):
    counted = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value")).withColumn("kind", F.lit("counter"))
    return evaluate.prometheus(counted)


@query(with_fixtures("truth", "predicted") + r" SELECT field, count(*) FILTER (WHERE lower(regexp_replace(t.value, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(coalesce(p.value, ''), '[^A-Za-z0-9]', '', 'g'))) AS correct, count(*) AS total FROM truth t LEFT JOIN predicted p USING (sample_id, field) WHERE sample_id % 4 > 0 GROUP BY field")
def agg_field_accuracy(spark, sf_dir):
    rows = fixture(spark, sf_dir, "truth").withColumnRenamed("value", "truth").join(fixture(spark, sf_dir, "predicted").select("sample_id", "field", F.col("value").alias("got")), ["sample_id", "field"], "left")
    rows = rows.withColumn("status", F.when(F.col("sample_id") % 4 > 0, "ACCEPTED").otherwise("REJECTED")).withColumn("got", F.coalesce("got", F.lit("")))
    return evaluate.field_accuracy(rows, ("ACCEPTED",))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size >= 10 AND p_retailprice > 950) AS passed, count(*) FILTER (WHERE NOT (p_size >= 10 AND p_retailprice > 950)) AS failed FROM part GROUP BY 1")
def agg_gold_rules(spark, sf_dir):
    good = (F.col("p_size") >= 10) & (F.col("p_retailprice") > 950)
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"))


@query(with_fixtures("cases") + " SELECT count(*) AS cases, round(avg(CASE WHEN is_valid THEN 1.0 ELSE 0 END), 6) AS valid_rate, round(avg(spoof), 6) AS mean_spoof, round(avg(nullif(spoof, 0)), 6) AS mean_spoof_nonzero FROM cases")
def agg_dash_stats(spark, sf_dir):
    """One page averages all scores, the other leaves zeros out."""
    return fixture(spark, sf_dir, "cases").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("is_valid").cast("double")), 6).alias("valid_rate"), F.round(F.avg("spoof"), 6).alias("mean_spoof"), F.round(F.avg(F.nullif(F.col("spoof"), F.lit(0.0))), 6).alias("mean_spoof_nonzero"))


_MAPS = "id % 2 as a, id % 3 as b, id % 5 as c"


def _two_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda *pairs: F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v > 0)
    return of_customers(spark, sf_dir, _MAPS).select("id", some(("name", F.col("a")), ("dob", F.col("b"))).alias("l"), some(("name", F.col("b")), ("pan", F.col("c"))).alias("r"))


@query(_customers(_MAPS) + " SELECT id, concat_ws(',', CASE WHEN b > 0 THEN 'dob' END, CASE WHEN a > 0 OR b > 0 THEN 'name' END, CASE WHEN c > 0 THEN 'pan' END) AS keys FROM v")
def set_union_keys(spark, sf_dir):
    return _two_maps(spark, sf_dir).select("id", F.array_join(F.sort_array(F.array_union(F.map_keys("l"), F.map_keys("r"))), ",").alias("keys"))


@query(_customers(_MAPS) + " SELECT id, CASE WHEN a > 0 AND b > 0 THEN 'name' ELSE '' END AS keys FROM v")
def set_allowed_keys(spark, sf_dir):
    return _two_maps(spark, sf_dir).select("id", F.array_join(F.map_keys(extraction.same_keys_only(F.col("r"), F.col("l"))), ",").alias("keys"))


@query(_customers(_MAPS) + " SELECT id, concat_ws(',', CASE WHEN b > 0 THEN 'dob' END, CASE WHEN a > 0 THEN 'name' END) AS wrong FROM v")
def set_except_unexpected(spark, sf_dir):
    """Keys that the other type expects, those that both share among them."""
    return _two_maps(spark, sf_dir).select("id", F.array_join(F.sort_array(F.array_intersect(F.map_keys("l"), F.array(*map(F.lit, ("gender", "name", "dob", "address"))))), ",").alias("wrong"))


@query("SELECT 'pan' AS doc_type, o_orderkey AS id FROM orders UNION ALL SELECT 'aadhaar', l_orderkey FROM lineitem")
def set_union_results(spark, sf_dir):
    run = lambda kind, table, key: read(spark, sf_dir, table).select(F.lit(kind).alias("doc_type"), F.col(key).alias("id"))
    return run("pan", "orders", "o_orderkey").unionByName(run("aadhaar", "lineitem", "l_orderkey"))


@query(with_fixtures("cases") + " SELECT doc_id, CASE WHEN quality_passed AND is_valid THEN 'golden' ELSE 'hard' END AS suite FROM cases")
def set_golden_hard(spark, sf_dir):
    rows, good = fixture(spark, sf_dir, "cases"), F.col("quality_passed") & F.col("is_valid")
    return rows.where(good).select("doc_id", F.lit("golden").alias("suite")).unionByName(rows.where(~good).select("doc_id", F.lit("hard").alias("suite")))


_FIELDS = "case id % 4 when 0 then case when id % 8 = 0 then 'gender' else 'name' end when 1 then 'ifsc_code' when 2 then 'amount_due' else 'other' end as field, case id % 4 when 0 then case when id % 24 = 0 then 'AMLE' when id % 24 = 8 then 'Fmale' when id % 24 = 16 then 'xyz' else ' S. 12 Rao' end when 1 then 'hdfc0' || lpad(cast(id % 7777 as string), case when id % 3 = 0 then 5 else 6 end, '0') when 2 then 'Rs 1,' || cast(id as string) else ' as is ' end as value"


@query(_customers(_FIELDS) + " SELECT id, field, CASE field WHEN 'name' THEN 'S. Rao' WHEN 'gender' THEN CASE value WHEN 'AMLE' THEN 'Male' WHEN 'Fmale' THEN 'Female' ELSE value END WHEN 'ifsc_code' THEN CASE WHEN length(value) = 11 THEN upper(value) ELSE value END WHEN 'amount_due' THEN substr(value, 4) ELSE value END AS normalized, CASE WHEN field <> 'other' AND (field <> 'ifsc_code' OR length(value) = 11) AND value <> 'xyz' THEN 'normalize_' || field END AS source FROM v")
def fn_normalize_dispatch(spark, sf_dir):
    return extraction.normalise_fields(of_customers(spark, sf_dir, _FIELDS)).select("id", "field", "normalized", "source")


_DOBS = f"case id % 3 when 0 then translate({DAY}, '01', 'OI') when 1 then {DAY} else 'none' end as a, case when id % 5 = 0 then '01/01/2001' else {DAY} end as b"


@query(_customers(_DOBS) + f" SELECT id, CASE WHEN length(r) > 0 THEN r = b ELSE false END AS accepted FROM (SELECT *, {SCALARS['fn_recover_dob'][2]} AS r FROM v)")
def fn_accept_dob(spark, sf_dir):
    return of_customers(spark, sf_dir, _DOBS).select("id", S.accept_dob(F.col("a"), F.col("b")).alias("accepted"))


_AADHAAR = "lpad(cast(id * 97 as string), 12, '4') as a, case id % 3 when 0 then lpad(cast(id * 97 as string), 12, '4') when 1 then replace(lpad(cast(id * 97 as string), 12, '4'), '0', 'O') else lpad(cast(id * 97 + 1 as string), 12, '4') end as b"


@query(_customers(_AADHAAR) + " SELECT id, a = replace(b, 'O', '0') AS accepted FROM v")
def fn_accept_aadhaar(spark, sf_dir):
    return of_customers(spark, sf_dir, _AADHAAR).select("id", S.accept_aadhaar(F.col("a"), F.col("b")).alias("accepted"))


def _scored(fn: Callable[[Column, Column], Column], columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = of_customers(spark, sf_dir, columns)
        value = fn(F.col("a"), F.col("b"))
        return rows.select("id", value.alias("result"))

    return run


_PEOPLE = "case id % 4 when 0 then 'Rahul Kumar' when 1 then 'Meera O Neil' when 2 then 'Asha Devi' else '' end as a, case id % 5 when 0 then 'Rahul Kumaar' when 1 then 'Mira Oneil' when 2 then 'Devi Asha' when 3 then 'Rahul Kumar' else 'X' || cast(id as string) end as b"
_MISREADS = f"{PAN} as a, case id % 3 when 0 then {PAN} when 1 then translate({PAN}, 'O0', '0O') else 'ABCPD1234E' end as b"
for _name, _fn, _cols in (
    ("fn_seq_ratio", lambda a, b: F.round(S.seq_ratio(a, b), 6), _PEOPLE),
    ("fn_jaro_winkler", lambda a, b: F.round(S.jaro_winkler(a, b), 6), _PEOPLE),
    ("fn_name_score", lambda a, b: F.round(S.name_score(a, b), 6), _PEOPLE),
    ("fn_accept_name", S.accept_name, _PEOPLE),
    ("fn_accept_pan", S.accept_pan, _MISREADS),
    ("fn_field_match", lambda a, b: (lambda m: F.concat_ws(",", m["exact"].cast("string"), m["fuzzy"].cast("string")))(S.field_match(F.lit("name"), a, b)), _PEOPLE),
    ("fn_perturb", lambda a, b: generate.perturbed(a, b), _MISREADS),
):
    QUERIES[_name] = _scored(_fn, _cols)


@query(r"""SELECT c_custkey AS id, '{"a":"' || c_mktsegment || '\u00e9\n\t\"q\\\u0001\u6f22\ud83c\udf89","key":' || cast(c_custkey AS string) || ',"none":null}' AS result FROM customer""")
def fn_canonical_json(spark, sf_dir):
    odd = F.concat("c_mktsegment", F.lit('é\n\t"q\\\x01漢🎉'))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ledger.canonical_json({"none": F.lit(None).cast("string"), "key": (F.col("c_custkey"), True), "a": odd}).alias("result"))


_REPLIES = """case id % 4 when 0 then '{"name": "N' || cast(id as string) || '", "dob": null, "a": "0", "b": "false", "c": 0, "d": true, "e": [], "f": 7.5}' when 1 then 'not json' when 2 then '[1]' else '{}' end as a"""


@query(_customers(_REPLIES) + " SELECT id, f AS field, CASE f WHEN 'name' THEN 'N' || cast(id AS string) WHEN 'a' THEN '0' WHEN 'b' THEN 'false' WHEN 'd' THEN 'True' WHEN 'f' THEN '7.5' ELSE '' END AS value, 0.85 AS conf FROM v, (SELECT unnest(['name', 'dob', 'a', 'b', 'c', 'd', 'e', 'f']) AS f) WHERE id % 4 = 0")
def fn_vlm_fields(spark, sf_dir):
    rows = of_customers(spark, sf_dir, _REPLIES).select("id", F.explode(extraction.vlm_fields(F.col("a"))).alias("f"))
    return rows.select("id", "f.field", "f.value", F.col("f.ocr_conf").alias("conf"))


@query(_customers(_REPLIES) + " SELECT id, id % 4 IN (0, 3) AS ok FROM v")
def fn_json_parse_strict(spark, sf_dir):
    return of_customers(spark, sf_dir, _REPLIES).select("id", extraction.vlm_fields(F.col("a")).isNotNull().alias("ok"))


_PACKETS = "select o_custkey as case_id, o_orderkey as ordinal, case when o_orderkey % 4 = 0 then '' else o_clerk end as surname, o_orderpriority as given_names, 'IN' as nationality from {orders}"
_PACKED = "SELECT case_id, ordinal, 'surname' AS field, surname AS value FROM p WHERE surname <> '' UNION ALL SELECT case_id, ordinal, 'given_names', given_names FROM p"


def _packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_PACKETS.replace("o_clerk", "o_orderstatus"), orders=read(spark, sf_dir, "orders"))
    return rows.select("case_id", "ordinal", F.lit("passport").alias("doc_type"), F.create_map(*[x for c in ("surname", "given_names", "nationality") for x in (F.lit(c), F.col(c))]).alias("fields"))


@query(f"WITH p AS ({_PACKETS.replace('o_clerk', 'o_orderstatus').format(orders='orders')}) {_PACKED} UNION ALL SELECT case_id, ordinal, 'nationality', nationality FROM p")
def fn_flatten_packet(spark, sf_dir):
    return resolve.explode_packet(_packet(spark, sf_dir)).select("case_id", "ordinal", "field", "value")


@query(f"WITH p AS ({_PACKETS.replace('o_clerk', 'o_orderstatus').format(orders='orders')}) {_PACKED}")
def fn_names_of_doc(spark, sf_dir):
    return resolve.explode_packet(_packet(spark, sf_dir)).where(F.col("field").isin(*resolve.NAME_KEYS)).select("case_id", "ordinal", "field", "value")


@query(_customers(_DOBS) + f" SELECT id AS doc_id, CASE WHEN ok THEN b ELSE a END AS value, CASE WHEN ok THEN 'llm_rescue' END AS source, CASE WHEN ok THEN 0.8 ELSE 0.5 END AS conf FROM (SELECT *, coalesce(length(r) > 0 AND r = b AND a <> b, false) AS ok FROM (SELECT *, {SCALARS['fn_recover_dob'][2]} AS r FROM v))")
def dec_rescue(spark, sf_dir):
    rows = of_customers(spark, sf_dir, _DOBS).select(F.col("id").alias("doc_id"), F.lit("date_of_birth").alias("field"), "a", "b", F.lit(0.5).alias("conf"))
    out = extraction.rescue(rows.select("doc_id", "field", F.col("a").alias("value"), "conf"), rows.select("doc_id", "field", F.col("b").alias("suggested")))
    return out.select("doc_id", "value", "source", "conf")


@query("WITH v AS (SELECT p_brand AS model, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT model, cast(p_partkey AS string) AS version, CASE WHEN model <> 'Brand#11' THEN 'registered' WHEN r = n THEN 'active' ELSE 'retired' END AS status FROM v")
def al_registry(spark, sf_dir):
    """Every part is a version of its brand's model; the last of one brand is promoted."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    versions = read(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.row_number().over(w).alias("place"), F.col("p_partkey").cast("string").alias("version"), F.lit("w").alias("weights"), F.lit("registered").alias("status"))
    last = versions.where("model = 'Brand#11'").agg(F.max_by("version", "place")).first()[0]
    return (versions if last is None else learn.promote(versions, "Brand#11", last)).select("model", "version", "status")


@query("SELECT p_brand AS model, cast(max(p_partkey) AS string) AS version FROM part GROUP BY 1 HAVING max(p_partkey) <> min(p_partkey) AND max(p_size) > 10")
def al_hot_reload(spark, sf_dir):
    """Each brand's last part is its active version, with weights where a part is large; the first one is loaded."""
    per = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(F.max("p_partkey").cast("string").alias("version"), F.min("p_partkey").cast("string").alias("first"), F.when(F.max("p_size") > 10, "w").alias("weights"))
    return learn.to_reload(per.select("model", "version", "weights"), per.select("model", F.col("first").alias("version")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def str_windows(spark, sf_dir):
    return cases.event_windows(read(spark, sf_dir, "events")).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", F.round("total", 2).alias("total"))


@query()
def gen_identity(spark, sf_dir):
    """As many identities as there are customers."""
    return generate.people(spark, read(spark, sf_dir, "customer").count(), 42)


QUERIES["src_synth"] = gen_identity


def _checked(column: str, valid: Callable[[], Column]) -> Query:
    """Every identity's number of one kind, and whether it keeps that kind's rules."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gen_identity(spark, sf_dir).select("id", valid().alias("valid"), (F.length(column) > 0).alias("filled"))

    return run


for _name, _column, _valid in (
    ("gen_person", "name", lambda: F.col("name").endswith(F.col("surname")) & F.col("gender").isin("Male", "Female") & T.parse_date(F.col("date_of_birth")).isNotNull()),
    ("gen_pan", "pan_number", lambda: F.col("pan_number").rlike(r"^[A-Z]{3}P[A-Z][0-9]{4}[A-Z]\z") & (F.substring("pan_number", 5, 1) == F.substring("surname", 1, 1))),
    ("gen_aadhaar", "aadhaar_number", lambda: F.col("aadhaar_number").rlike(r"^[2-9][0-9]{3} [0-9]{4} [0-9]{4}\z") & T.verhoeff_valid(F.translate("aadhaar_number", " ", ""))),
    ("gen_dl", "dl_number", lambda: F.col("dl_number").rlike(r"^(" + "|".join(generate.RTO_STATES) + r")[0-9]{2} 20[0-2][0-9][0-9]{7}\z")),
):
    QUERIES[_name], SQL[_name] = _checked(_column, _valid), "SELECT c_custkey - min(c_custkey) OVER () AS id, true AS valid, true AS filled FROM customer"


@query("WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT unnest(range(1, 2 * n + 1)) AS k, n FROM n) SELECT lpad(cast(k AS string), 6, '0') AS id, CASE WHEN k <= n THEN 'PAN' ELSE 'AADHAAR' END AS doc_type, lpad(cast(k AS string), 6, '0') || '.jpg' AS image_filename, k <= n AS has_status, true AS valid FROM r")
def gen_legacy(spark, sf_dir):
    """As many cards of each kind as there are customers."""
    n = read(spark, sf_dir, "customer").count()
    pan = F.col("number").rlike(r"^[A-Z]{3}[PCHFAT][A-Z][0-9]{4}[A-Z]\z") & (F.substring("number", 4, 1) == F.col("status_code"))
    valid = F.when(F.col("doc_type") == "PAN", pan).otherwise(F.col("number").rlike(r"^[2-9][0-9]{11}\z") & T.verhoeff_valid(F.col("number")))
    return generate.legacy_set(spark, n, n, 42).select("id", "doc_type", "image_filename", F.col("status_code").isNotNull().alias("has_status"), valid.alias("valid"))


@query("SELECT c_custkey % 2 = 0 AS even, attack, count(*) AS n FROM customer, (SELECT unnest(['copy_move', 'exif_edit', 'screen_recapture', 'text_splice', 'font_swap', 'regenerate']) AS attack) GROUP BY 1, 2")
def gen_tamper(spark, sf_dir):
    docs = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.lit("pan").alias("doc_type"))
    made = generate.attacks(docs)
    return made.groupBy((F.col("source_id").cast("bigint") % 2 == 0).alias("even"), "attack").agg(F.count("*").alias("n"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's bytes as the pixels of a picture of 64 columns, the last row filled up with zeros; an empty page has no rows."""
    html = F.encode("html", "utf-8")
    rows = F.ceil(F.length(html) / 64).cast("int")
    full = F.rpad(html, rows * 64, F.unhex(F.lit("00")))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), full.alias("gray"), rows.alias("height"), F.lit(64).alias("width"))


@query()
def img_quality(spark, sf_dir):
    return images.analyse(_pictures(spark, sf_dir)).select("id", "good", "blur_score", "white_ratio", "black_ratio", "reason")


@query()
def img_screen(spark, sf_dir):
    return images.analyse(_pictures(spark, sf_dir)).select("id", "is_recaptured", "moire_score", "ring_ratio")


@query()
def topk_freq(spark, sf_dir):
    """The five strongest peaks of every picture."""
    found = images.analyse(_pictures(spark, sf_dir)).select("id", F.posexplode("peaks").alias("rank", "p"))
    return found.select("id", "rank", F.col("p")[0].alias("freq_x"), F.col("p")[1].alias("freq_y"), F.col("p")[2].alias("magnitude"))


@query()
def img_ela(spark, sf_dir):
    found = pictures.error_levels(_pictures(spark, sf_dir))
    return found.select("id", F.round("ela_score", 9).alias("ela_score"), F.size("suspicious_regions").alias("regions"))


@query()
def img_copy_move(spark, sf_dir):
    return pictures.copy_moves(_pictures(spark, sf_dir))


@query()
def img_font_signature(spark, sf_dir):
    return pictures.font_signatures(_pictures(spark, sf_dir))


@query()
def topk_ink(spark, sf_dir):
    return pictures.inkiest_lines(_pictures(spark, sf_dir))


@query()
def gen_augment(spark, sf_dir):
    made = pictures.augment(_pictures(spark, sf_dir))
    return made.select("id", "height", "width", F.array_join("applied", ",").alias("applied"), F.sha2("gray", 256).alias("digest"))
