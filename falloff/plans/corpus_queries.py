"""Queries of corpus operators: the driver's tables stand in for files, folders, questionnaires, registries and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from falloff.functions import text as tx
from falloff.operators import corpus, documents, log, match
from falloff.operators import series as s
from falloff.plans import interpret as plan
from falloff.plans.interpret_queries import _ALL
from falloff.plans.views import PRELUDE, STEP, samples, table


# Files: documents, in a folder for each source


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.coalesce("source", F.lit("none"))
    docs = table(spark, sf_dir, "documents").select(group.alias("group"), F.concat(group, F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return corpus.content_signature(docs).drop("content")


_FILES = "WITH f AS (SELECT coalesce(source, 'none') AS grp, coalesce(source, 'none') || '/' || doc_id AS path, strlen(coalesce(text, '')) || ':' || sha256(coalesce(text, '')) AS sig FROM documents)\n"


def dedup_in_group(spark, sf_dir):
    return corpus.dedup_in_group(_files(spark, sf_dir)).select("path", "duplicate", "dup_of")


def same_bytes_elsewhere(spark, sf_dir):
    return corpus.same_bytes_elsewhere(_files(spark, sf_dir)).select("path", "n_elsewhere", "first_elsewhere")


def files_fingerprint(spark, sf_dir):
    return corpus.files_fingerprint(_files(spark, sf_dir)).select(F.col("group").alias("grp"), "files_sig")


# Profiles: the users' records


def _profiled(spark, sf_dir, rated: bool):
    rows = samples(spark, sf_dir)
    out = corpus.file_profile(rows.select("test_id", "idx", "t_s", "p"), s.main_cycle(rows) if rated else None)
    exact = {"duration_hr": 6, "p_max": 4, "p_at_shutin": 4, "post_shutin_hr": 6, "drop": 4, "decline_fraction": 6, "injection_min": 6}
    return out.select("test_id", F.col("rows").alias("n_rows"), "unit_guess", "shutin_source", "dropped", "verdict", *[F.round(F.col(f"`{c}`"), n).alias("p_drop" if c == "drop" else c) for c, n in exact.items()])


def file_profile(spark, sf_dir):
    return _profiled(spark, sf_dir, True)


def file_profile_peak(spark, sf_dir):
    return _profiled(spark, sf_dir, False)


def verdict_histogram(spark, sf_dir):
    return _profiled(spark, sf_dir, True).groupBy("verdict").agg(F.count("*").alias("n"))


def _profile_sql(shut: str, source: str) -> str:
    return (
        PRELUDE
        + f""", sh AS (SELECT s.*, {'w.start_idx' if source == 'rate' else 'NULL::INTEGER'} AS start_idx, {shut} AS shut FROM samples s LEFT JOIN win w USING (test_id)),
po AS (SELECT test_id, p, p - lag(p) OVER (PARTITION BY test_id ORDER BY idx) AS diff FROM sh WHERE idx >= shut),
pg AS (SELECT test_id, min(p) AS low, CASE WHEN count(*) > 10 THEN avg(CASE WHEN diff <= 0 THEN 1.0 WHEN diff > 0 THEN 0.0 END) END AS declining FROM po GROUP BY test_id),
pe AS (SELECT test_id, count(*) AS n_rows, (max(t_s) - min(t_s)) / 3600 AS hours, max(p) AS p_max, max(CASE WHEN idx = shut THEN p END) AS at_shut, max(t_s) AS t1, max(CASE WHEN idx = shut THEN t_s END) AS t_shut,
  max(CASE WHEN idx = start_idx THEN t_s END) AS t_start FROM sh GROUP BY test_id),
pr AS (SELECT *, at_shut - low AS p_drop, (t1 - t_shut) / 3600 AS after_hr, CASE WHEN p_max > 40000 THEN 'kPa' WHEN p_max > 100 THEN 'psi' ELSE '' END AS unit FROM pe LEFT JOIN pg USING (test_id)),
profiles AS (
  SELECT test_id, n_rows, unit AS unit_guess, '{source}' AS shutin_source, 0::BIGINT AS dropped, round(hours, 6) AS duration_hr, round(p_max, 4) AS p_max, round(at_shut, 4) AS p_at_shutin, round(after_hr, 6) AS post_shutin_hr,
    round(p_drop, 4) AS p_drop, round(declining, 6) AS decline_fraction, round((t_shut - t_start) / 60, 6) AS injection_min,
    CASE WHEN n_rows < 50 THEN 'no_pressure' WHEN hours < 1 THEN 'too_short' WHEN p_drop IS NULL OR p_drop < CASE WHEN unit = 'kPa' THEN 50 * 6.895 ELSE 50 END THEN 'flat'
         WHEN after_hr < 4 THEN 'short_falloff' WHEN declining IS NULL OR declining < 0.6 THEN 'noisy' ELSE 'likely_dfit' END AS verdict FROM pr)
"""
    )


_RATED = _profile_sql("w.shutin_idx", "rate")
_PEAK = _profile_sql("first_value(idx) OVER (PARTITION BY s.test_id ORDER BY p DESC, idx)", "pressure-peak")


# Folders: pages by top domain, host and language; each tells a well's name or can't be read


def _papers(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    rel = F.concat_ws("/", F.element_at(F.split(host, r"\."), -1), host, F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([a-z]+)", 1))
    name = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit(" Well  "), (F.col("page_id") % 3).cast("string"), F.lit("A ")))
    return table(spark, sf_dir, "pages").select(rel.alias("rel"), F.concat(rel, F.lit("/"), F.col("page_id").cast("string"), F.lit(".xlsx")).alias("path"), name.alias("name"))


_PAPERS = r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)', 1) AS lang FROM pages),
q AS (SELECT page_id, string_split(host, '.')[-1] || '/' || host || '/' || lang AS rel, CASE WHEN page_id % 5 <> 0 THEN 'well ' || page_id % 3 || 'a' END AS name FROM h),
papers AS (SELECT rel, rel || '/' || page_id || '.xlsx' AS path, coalesce(name, '?' || rel || '/' || page_id || '.xlsx') AS name FROM q),
anc AS (SELECT p.*, d AS depth, array_to_string(string_split(rel, '/')[1:d], '/') AS folder FROM papers p, generate_series(1, 3) t(d) WHERE d <= len(string_split(rel, '/'))),
names AS (SELECT folder, count(DISTINCT name) AS n_wells FROM anc GROUP BY folder)
"""


def subtree_names(spark, sf_dir):
    return corpus.subtree_names(_papers(spark, sf_dir))


def well_roots(spark, sf_dir):
    papers = _papers(spark, sf_dir)
    return corpus.well_roots(papers, corpus.subtree_names(papers))


def group_document(spark, sf_dir):
    return corpus.group_document(_papers(spark, sf_dir))


def _data_files(spark, sf_dir):
    """Two stems in some folders, one at the root, csv and dbs of one stem."""
    papers, digit = _papers(spark, sf_dir), lambda k: F.ascii(F.substring(F.md5("path"), k, 1))
    folder = F.when(digit(1) == ord("0"), "").otherwise(F.col("rel"))
    stem = F.concat(F.lit("s"), (digit(2) % 3).cast("string"))
    ext = F.when(digit(3) % 2 == 0, "csv").otherwise("dbs")
    return papers.select(folder.alias("folder"), stem.alias("stem"), ext.alias("ext"), F.concat_ws("/", folder, F.concat(stem, F.lit("."), ext)).alias("path"))


_DATA = """, dfiles AS (SELECT CASE WHEN md5(path)[1] = '0' THEN '' ELSE rel END AS folder, 's' || ascii(md5(path)[2]) % 3 AS stem, CASE WHEN ascii(md5(path)[3]) % 2 = 0 THEN 'csv' ELSE 'dbs' END AS ext FROM papers)
"""


def entries(spark, sf_dir):
    found = corpus.entries(_data_files(spark, sf_dir).distinct())
    papers = _papers(spark, sf_dir).select(F.col("rel").alias("folder"), "path")
    return corpus.attach_document(found, papers).select("test_id", "folder", F.col("csv").isNotNull().alias("has_csv"), F.col("dbs").isNotNull().alias("has_dbs"), "document")


# Basins and folders' names: customers


def basin_lookup(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 6 == 0, "Unknown").otherwise(F.col("r_name")).alias("basin"), "n_nationkey")
    cust = table(spark, sf_dir, "customer").join(home.select("n_nationkey", F.col("key").alias("n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    groups = cust.select("c_custkey", F.concat_ws("/", "n_name", "c_name").alias("rel"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("--"))).otherwise("?").alias("formation"))
    seg = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    by_formation = seg.select(tx.normal_formation(F.col("c_mktsegment")).alias("key"), F.when(F.col("c_mktsegment") == "MACHINERY", "Unknown").otherwise(F.concat("c_mktsegment", F.lit(" basin"))).alias("basin"))
    return corpus.basin_of(groups, by_formation, home.select("key", "basin")).select("c_custkey", "basin", "basin_source")


def well_folder(spark, sf_dir):
    k = F.col("c_custkey") % 4
    well = F.when(k == 0, F.concat("c_name", F.lit(':  "x". '))).when(k == 1, "  ").when(k == 2, "???")
    folder = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a/b/"), "c_mktsegment", F.lit("."))).when(F.col("c_custkey") % 3 == 1, "a/..")
    rel = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("r\\"), "c_name", F.lit("//z")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.well_folder(well, folder, rel).alias("folder"))


# Reviews: customers are groups, their orders the files


def _reviews(spark, sf_dir):
    cust, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    groups = cust.select(F.col("c_name").alias("rel"), F.when(k % 5 == 0, 2).otherwise(1).cast("long").alias("n_wells"), F.md5("c_name").alias("files_sig"), F.col("c_mktsegment").alias("basin"), F.col("c_name").alias("well"), F.when(k % 3 == 0, F.concat("c_name", F.lit("/q.xlsx"))).alias("questionnaire"))
    files = orders.join(cust, F.col("o_custkey") == k).select(F.col("c_name").alias("rel"), F.concat("c_name", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("path"), "o_orderkey")
    kept = files.where("o_orderkey % 2 = 0").groupBy("rel").agg(F.collect_list("path").alias("keeps"))
    said = F.element_at(F.array(*map(F.lit, ("done", "skip", "unsure", ""))), (k % 4 + 1).cast("int"))
    decisions = cust.join(kept, F.col("c_name") == F.col("rel"), "left").select(F.when(k % 7 == 0, F.concat(F.lit("gone "), "c_name")).otherwise(F.col("c_name")).alias("rel"), said.alias("status"), F.coalesce("keeps", F.array().cast("array<string>")).alias("keeps"), F.when(k % 6 == 0, "old").otherwise(F.md5("c_name")).alias("decided_sig"))
    return groups, decisions, files.drop("o_orderkey")


_REVIEWS = """WITH g AS (SELECT c_custkey, c_name AS rel, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS n_wells, md5(c_name) AS files_sig, c_mktsegment AS basin, CASE WHEN c_custkey % 3 = 0 THEN c_name || '/q.xlsx' END AS quest FROM customer),
d AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'gone ' || c_name ELSE c_name END AS rel, ['done', 'skip', 'unsure', ''][c_custkey % 4 + 1] AS status, CASE WHEN c_custkey % 6 = 0 THEN 'old' ELSE md5(c_name) END AS decided_sig FROM customer),
fl AS (SELECT c_name AS rel, c_name || '/' || o_orderkey || '.csv' AS path, o_orderkey % 2 = 0 AS kept, o_orderkey || '.csv' AS base FROM orders JOIN customer ON o_custkey = c_custkey),
ok AS (SELECT * FROM g JOIN d USING (rel) WHERE status NOT IN ('', 'unsure') AND n_wells = 1 AND decided_sig = files_sig)
"""


def plan_moves(spark, sf_dir):
    return corpus.plan_moves(*_reviews(spark, sf_dir), "out", "root").select("rel", "src", "dst", "kind")


def plan_warnings(spark, sf_dir):
    groups, decisions, _ = _reviews(spark, sf_dir)
    return corpus.plan_warnings(groups, decisions)


def review_progress(spark, sf_dir):
    groups, decisions, _ = _reviews(spark, sf_dir)
    return corpus.review_progress(groups.select("rel", "files_sig"), decisions.select("rel", "status", "decided_sig"))


def separate_destinations(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    name = F.concat((part % 7).cast("string"), F.lit(".csv"))
    src = F.concat(F.lit("g"), (part % 3).cast("string"), F.lit("/f"), (supp % 10).cast("string"), F.lit("/"), name)
    moves = table(spark, sf_dir, "lineitem").select(src.alias("src"), F.concat(F.lit("out/"), name).alias("dst"))
    return corpus.separate_destinations(moves)


def merge_keeps(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rel"), k.alias("path"), "o_orderstatus", "o_orderpriority")
    old = rows.select("rel", "path", F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "failed").otherwise("other").alias("status"), F.lit("old").alias("message"))
    new = rows.select("rel", F.when(F.col("path") % 2 == 0, F.col("path")).otherwise(-F.col("path")).alias("path"), F.when(F.col("o_orderpriority") < "3", "delivered").otherwise("skipped").alias("status"), F.lit("new").alias("message"))
    return corpus.merge_keeps(old, new)


# The log: orders as tests


def _states(prefix: int):
    """A test's map of steps from the bits of its key: done, or skipped for urgent orders."""
    said = F.when(F.col("o_orderpriority").startswith("1"), "skipped").otherwise("done")
    pairs = F.array(*[F.when(F.shiftright("o_orderkey", k) % 4 != 0, F.struct(F.lit(step).alias("key"), said.alias("value"))) for k, step in enumerate(log.STEPS)])
    return F.when(F.col("o_orderkey") % prefix != 0, F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull())))


def status(spark, sf_dir):
    post = F.when(F.col("o_orderkey") % 5 == 0, "PC-F: none").otherwise("PC-A")
    explicit = F.when(F.col("o_orderkey") % 9 == 0, "skipped")
    return table(spark, sf_dir, "orders").select("o_orderkey", log.status(explicit, _states(11), post).alias("status"))


_STATUS = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'new' WHEN o_orderkey % 9 = 0 THEN 'skipped' WHEN n = 0 THEN 'new' WHEN left_ > 0 THEN 'in_progress' WHEN skips > 0 THEN 'skipped' ELSE 'done' END AS status FROM (SELECT o_orderkey, o_orderkey % 5 = 0 AS auto, (SELECT count(*) FROM generate_series(0, 5) t(k) WHERE (o_orderkey >> k) % 4 <> 0) AS n, (SELECT count(*) FROM generate_series(0, 5) t(k) WHERE (o_orderkey >> k) % 4 = 0 AND NOT (k = 5 AND o_orderkey % 5 = 0)) AS left_, CASE WHEN o_orderpriority LIKE '1%' THEN (SELECT count(*) FROM generate_series(0, 5) t(k) WHERE (o_orderkey >> k) % 4 <> 0 AND NOT (k = 5 AND o_orderkey % 5 = 0)) ELSE 0 END AS skips FROM orders)"


def infer_steps(spark, sf_dir):
    present = {step: F.shiftright("o_orderkey", k) % 3 == 0 for k, step in enumerate(log.STEPS)}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.map_keys(log.inferred_steps(present)), ",").alias("steps"))


def step_gate(spark, sf_dir):
    step = F.element_at(F.array(*map(F.lit, log.STEPS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    closure, post = F.when(F.col("o_orderkey") % 4 == 0, "C-A"), F.when(F.col("o_orderkey") % 5 != 0, "PC-A").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", log.step_gate(step, closure, post).alias("missing"))


def log_row(spark, sf_dir):
    out = log.log_row(plan.interpret_all(samples(spark, sf_dir), step=STEP))
    return out.select("test_id", "closure_quality", "pp_confidence", "net_pressure_isip_source", *[F.round(F.col(c), n).alias(c) for c, n in {"max_rate": 4, "apparent_ISIP": 3, "effective_ISIP": 2, "Shmin_compliance": 2, "closure_time_compliance_min": 2, "closure_time_tangent_min": 2, "near_wellbore_complexity": 2}.items()])


def upsert_log(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))
    new = F.when(F.col("test_id") % 2 == 0, F.col("test_id")).otherwise(-F.col("test_id"))
    return log.upsert(orders, orders.select(new.alias("test_id"), (F.col("value") * 2).alias("value")))


def orphans(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("test_id"), "o_orderkey")
    return log.orphans(rows, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("test_id")))


def queue_progress(spark, sf_dir):
    return log.queue_progress(status(spark, sf_dir))


def next_new(spark, sf_dir):
    """After entry 700 of the customers, new being those without orders of their nation's number."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 97 == 3, "new").otherwise("done").alias("status"))
    return log.next_new(cust, 700)


# Times and texts


def dayfirst_sniff(spark, sf_dir):
    most = 10 + F.col("user_id") % 7  # days over a user's most are written as a day before
    d, m, y = (F.pmod(F.dayofmonth("ts") - 1, most) + 1).cast("string"), F.month("ts").cast("string"), F.year("ts").cast("string")
    text = F.when(F.col("user_id") % 2 == 1, F.concat_ws("/", d, m, y)).otherwise(F.concat_ws("/", m, d, y))
    rows = table(spark, sf_dir, "events").select("user_id", text.alias("date"))
    return rows.groupBy("user_id").agg(tx.day_first("date").alias("day_first"))


def parse_cascade(spark, sf_dir):
    day = F.expr("datediff(CAST(ts AS DATE), DATE'1899-12-30')").cast("string")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format("ts", "M/d/yyyy H:mm:ss")).when(k == 1, F.concat(day, F.lit(".5"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 3, F.date_format("ts", "M/d/yyyy")).otherwise("garbage")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(tx.parsed_time(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def ms_colon(spark, sf_dir):
    text = F.concat(F.date_format("ts", "H:mm:ss"), F.when(F.col("event_id") % 3 == 0, ":").otherwise("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "events").select("event_id", tx.fixed_milliseconds(text).alias("fixed"))


def column_units(spark, sf_dir):
    name = F.concat(F.lit(" Tubing "), F.lower("c_mktsegment"), F.lit(" ("), F.when(F.col("c_custkey") % 2 == 0, "PSI").otherwise("kPa"), F.lit(") "))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.unit_of(name).alias("unit"), tx.bare_name(name).alias("bare"))


_LABELS = ["fluid", "fluid density", "tvd", "well name"]


def answer_blocks(spark, sf_dir):
    """Customers' orders as the cells of a document: some are labels, the others answers."""
    k = F.col("o_orderkey") % 9
    text = F.when(k == 0, "Fluid Density: which").when(k == 1, " fluid used").when(k == 2, "TVD").otherwise(F.col("o_orderkey").cast("string"))
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("ord"), text.alias("text"))
    return documents.answer_blocks(cells, _LABELS).select("path", "label", F.array_join("answers", "|").alias("answers"))


def density_rule(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    digit = (F.col("p_size") % 10).cast("string")
    text = F.when(k == 0, F.concat(n, F.lit(".5 ppg"))).when(k == 1, F.concat(F.lit("mud 0.4"), digit, F.lit(" psi / ft"))).when(k == 2, F.concat(F.lit("1."), digit, F.lit(" SG"))).when(k == 3, F.concat(n, F.lit(" lbs/gal brine"))).when(k == 4, "none").otherwise("9.1 specific gravity")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tx.density_ppg(text), 6).alias("ppg"))


def depth_rule(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.format_number(F.col("p_size") * 700, 0)
    one = F.when(k == 0, F.concat(F.lit("5 wells, TVD "), n, F.lit(" ft"))).when(k == 1, F.concat(n, F.lit(" TVD"))).when(k == 2, F.concat(n, F.lit(" ft"))).otherwise("see log")
    two = F.when(k.isin(2, 3), F.concat(n, F.lit("'"))).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", documents.depth_of(F.array(one, two)).alias("tvd"))


# Record linkage: suppliers and customers as registries, parts ask


def _registry(spark, sf_dir):
    sup, cust = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    label = lambda c, k: F.concat(F.lit(c), F.lpad((k % 40).cast("string"), 3, "0"), F.lit("-"), k.cast("string"), F.lit("-00"))
    directional = sup.select(tx.normal_name(F.col("s_name")).alias("key"), label("42-", F.col("s_suppkey")).alias("label"))
    more = sup.where("s_suppkey % 10 = 0").select(tx.normal_name(F.col("s_name")).alias("key"), label("41-", F.col("s_suppkey")).alias("label"))
    wells = cust.select(tx.normal_name(F.col("c_name")).alias("key"), label("42-", F.col("c_custkey")).alias("label"), F.col("c_acctbal").alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    return directional.union(more), wells


def norm_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.normal_name(F.col("p_name")).alias("norm"), tx.generic_name(tx.normal_name(F.col("p_brand"))).alias("generic"), tx.normal_formation(F.col("p_brand")).alias("formation"), tx.path_component(F.concat(F.lit(" a<b>: "), F.col("p_brand"), F.lit("?.. "))).alias("component"))


def api_key(spark, sf_dir):
    label = F.concat_ws("-", F.lit("42"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.when(F.col("s_suppkey") % 4 != 0, F.lpad(F.col("s_suppkey").cast("string"), 5, "0")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.api_key(label).alias("api"))


def ambiguous_pick(spark, sf_dir):
    return match.ambiguous_pick(_registry(spark, sf_dir)[0])


def exact_match(spark, sf_dir):
    k = F.col("p_partkey")
    number = lambda n: F.lpad((k % n).cast("string"), 9, "0")
    name = F.when(k % 6 == 0, F.concat(F.lit("SUPPLIER "), number(15))).when(k % 6 == 1, F.concat(F.lit("customer-"), number(200))).when(k % 6 == 2, " ").when(k % 6 == 3, "ab").when(k % 6 == 4, F.col("p_name"))
    names = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    directional, wells = _registry(spark, sf_dir)
    found = match.exact_match(names.select("name").distinct(), directional, wells.select("key", "label"))
    return names.join(found, names["name"].eqNullSafe(found["name"])).select("p_partkey", "label", "source")


def registry_keys(spark, sf_dir):
    wells = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("number"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("--").alias("location"))
    return match.keyed_registry(wells).select("c_custkey", "key")


def surface_place(spark, sf_dir):
    directional, wells = _registry(spark, sf_dir)
    return match.surface_of_directional(directional, wells).select("label", F.col("surface_lat").alias("lat"), F.col("surface_lon").alias("lon"))


def bottomhole(spark, sf_dir):
    directional, wells = _registry(spark, sf_dir)
    return match.bottomhole_of_well(wells, directional)


def fuzzy_match(spark, sf_dir):
    """Parts' names with a letter changed, against the names as they are."""
    parts = table(spark, sf_dir, "part").select("p_partkey", tx.normal_name(F.concat("p_name", "p_type", "p_brand")).alias("key"))
    asked = parts.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("X")).alias("key"))
    return match.fuzzy_match(asked, parts)


def fuzzy_fallback(spark, sf_dir):
    """Parts' names with their first letter changed, so that no key begins like them: held against the whole registry."""
    parts = table(spark, sf_dir, "part").select(tx.normal_name(F.concat("p_name", "p_type", "p_brand")).alias("key"))
    asked = parts.select(F.concat(F.lit("9"), F.expr("substring(key, 2)")).alias("key"))
    return match.fuzzy_match(asked, parts)


def _records(spark, sf_dir):
    """Suppliers as directional records and customers as wells, with labels, operators and places."""
    sup, cust = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    label = lambda c, k: F.concat(F.lit(c), F.lpad((k % 40).cast("string"), 3, "0"), F.lit("-"), k.cast("string"), F.lit("-00"))
    record = lambda rows, c: rows.select(label(c, F.col("s_suppkey")).alias("label"), F.concat(F.lit("op"), F.col("s_nationkey")).alias("operator"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("lat"), F.col("s_nationkey").cast("double").alias("lon"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    wells = cust.select(tx.api_key(label("42-", F.col("c_custkey"))).alias("api"), label("42-", F.col("c_custkey")).alias("label"), F.col("c_mktsegment").alias("operator"), F.col("c_name").alias("title"), none("name"), none("number"), none("location"), F.col("c_acctbal").cast("double").alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    return record(sup, "42-").union(record(sup.where("s_suppkey % 10 = 0"), "41-")), wells


def _asked(spark, sf_dir):
    k = F.col("p_partkey")
    number = lambda n: F.lpad((k % n).cast("string"), 9, "0")
    name = F.when(k % 6 == 0, F.concat(F.lit("SUPPLIER "), number(15))).when(k % 6 == 1, F.concat(F.lit("customer-"), number(200))).when(k % 6 == 2, " ").when(k % 6 == 3, "ab").when(k % 6 == 4, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def resolve_names(spark, sf_dir):
    return match.resolve(_asked(spark, sf_dir).select("name"), *_records(spark, sf_dir))


def located_rows(spark, sf_dir):
    """A part is an entry, its key modulo 7 the questionnaire: missing, unreadable, or naming the part's well."""
    k = F.col("p_partkey")
    asked = _asked(spark, sf_dir)
    entries = asked.select(k.alias("test_id"), F.when(k % 7 != 0, F.concat(F.lit("q"), k)).alias("document"))
    papers = asked.where(k % 7 != 1).select(F.concat(F.lit("q"), k).alias("path"), F.col("name").alias("well"), F.when(k % 7 == 2, "BadZipFile").alias("error"))
    return match.located_rows(entries, papers, *_records(spark, sf_dir)).select("test_id", "well_name", "label", "surf_lat", "btmh_lat", "source")


_REGISTRY = """WITH dir AS (SELECT regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS key, '42-' || lpad((s_suppkey % 40)::VARCHAR, 3, '0') || '-' || s_suppkey || '-00' AS label, s_suppkey AS k FROM supplier
  UNION ALL SELECT regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g'), '41-' || lpad((s_suppkey % 40)::VARCHAR, 3, '0') || '-' || s_suppkey || '-00', s_suppkey FROM supplier WHERE s_suppkey % 10 = 0),
well AS (SELECT regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS key, '42-' || lpad((c_custkey % 40)::VARCHAR, 3, '0') || '-' || c_custkey || '-00' AS label, c_custkey AS k, c_acctbal AS lat, c_nationkey::DOUBLE AS lon FROM customer)
"""

QUERIES = {
    f.__name__: f
    for f in (
        dedup_in_group, same_bytes_elsewhere, files_fingerprint, file_profile, file_profile_peak, verdict_histogram, subtree_names, well_roots, group_document, entries, basin_lookup, well_folder,
        plan_moves, plan_warnings, review_progress, separate_destinations, merge_keeps, status, infer_steps, step_gate, log_row, upsert_log, orphans, queue_progress, next_new, dayfirst_sniff,
        parse_cascade, ms_colon, column_units, answer_blocks, density_rule, depth_rule, norm_name, api_key, ambiguous_pick, exact_match, registry_keys, surface_place, bottomhole, fuzzy_match, fuzzy_fallback, resolve_names, located_rows,
    )
}

_RESOLVED = """WITH asked AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SUPPLIER ' || lpad((p_partkey % 15)::VARCHAR, 9, '0') WHEN 1 THEN 'customer-' || lpad((p_partkey % 200)::VARCHAR, 9, '0') WHEN 2 THEN ' ' WHEN 3 THEN 'ab' WHEN 4 THEN p_name END AS name FROM part),
keyed AS (SELECT *, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS key FROM asked),
lab AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN '41-' ELSE '42-' END || lpad((s_suppkey % 40)::VARCHAR, 3, '0') || '-' || s_suppkey || '-00' AS label FROM supplier),
d AS (SELECT regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS key, s_name AS db_name, label, 'op' || s_nationkey AS operator, c_acctbal::DOUBLE AS surf_lat, c_nationkey::DOUBLE AS surf_lon, s_acctbal::DOUBLE AS btmh_lat, s_nationkey::DOUBLE AS btmh_lon, 'directional-exact' || CASE WHEN s_suppkey % 10 = 0 THEN ' (2 candidates)' ELSE '' END AS source FROM supplier JOIN lab ON k = s_suppkey LEFT JOIN customer ON c_custkey = s_suppkey),
w AS (SELECT regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS key, c_name AS db_name, '42-' || lpad((c_custkey % 40)::VARCHAR, 3, '0') || '-' || c_custkey || '-00' AS label, c_mktsegment AS operator, c_acctbal::DOUBLE AS surf_lat, c_nationkey::DOUBLE AS surf_lon, s_acctbal::DOUBLE AS btmh_lat, s_nationkey::DOUBLE AS btmh_lon, 'wells-exact' AS source FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
r AS (SELECT p_partkey, name, coalesce(d.db_name, w.db_name) AS db_name, coalesce(d.label, w.label) AS label, coalesce(d.operator, w.operator) AS operator, CASE WHEN d.key IS NULL THEN w.surf_lat ELSE d.surf_lat END AS surf_lat, CASE WHEN d.key IS NULL THEN w.surf_lon ELSE d.surf_lon END AS surf_lon, CASE WHEN d.key IS NULL THEN w.btmh_lat ELSE d.btmh_lat END AS btmh_lat, CASE WHEN d.key IS NULL THEN w.btmh_lon ELSE d.btmh_lon END AS btmh_lon,
  CASE WHEN name IS NULL OR trim(name) = '' THEN 'no-well-name' WHEN length(keyed.key) < 4 THEN 'name-too-generic' ELSE coalesce(d.source, w.source, 'no-match') END AS source, CASE WHEN coalesce(d.source, w.source) IS NOT NULL THEN 1.0::DOUBLE END AS score
  FROM keyed LEFT JOIN d USING (key) LEFT JOIN w USING (key))
"""

ORACLE_SQL = {
    "resolve_names": _RESOLVED + "SELECT DISTINCT name, db_name, label, operator, surf_lat, surf_lon, btmh_lat, btmh_lon, source, score FROM r",
    "located_rows": _RESOLVED
    + """SELECT p_partkey AS test_id, CASE WHEN p_partkey % 7 > 2 THEN name END AS well_name, CASE WHEN p_partkey % 7 > 2 THEN label END AS label, CASE WHEN p_partkey % 7 > 2 THEN surf_lat END AS surf_lat, CASE WHEN p_partkey % 7 > 2 THEN btmh_lat END AS btmh_lat,
  CASE WHEN p_partkey % 7 = 0 THEN 'no-questionnaire' WHEN p_partkey % 7 <= 2 THEN 'questionnaire-error' ELSE source END AS source FROM r""",
    "dedup_in_group": _FILES + "SELECT path, path <> min(path) OVER w AS duplicate, nullif(min(path) OVER w, path) AS dup_of FROM f WINDOW w AS (PARTITION BY grp, sig)",
    "same_bytes_elsewhere": _FILES + "SELECT a.path, count(*) AS n_elsewhere, min(b.path) AS first_elsewhere FROM f a JOIN f b ON a.sig = b.sig AND a.grp <> b.grp GROUP BY a.path",
    "files_fingerprint": _FILES + ", p AS (SELECT grp, string_split(sig, ':')[2][1:4] AS part, sha256(string_agg(sig, chr(10) ORDER BY sig)) AS h FROM f GROUP BY ALL)\nSELECT grp, sha256(string_agg(part || ':' || h, chr(10) ORDER BY part || ':' || h)) AS files_sig FROM p GROUP BY grp",
    "file_profile": _RATED + "SELECT * FROM profiles",
    "file_profile_peak": _PEAK + "SELECT * FROM profiles",
    "verdict_histogram": _RATED + "SELECT verdict, count(*) AS n FROM profiles GROUP BY verdict",
    "subtree_names": _PAPERS + "SELECT * FROM names",
    "well_roots": _PAPERS
    + """, up AS (SELECT DISTINCT rel, folder, depth, n_wells FROM anc JOIN names USING (folder) WHERE folder <> rel),
st AS (SELECT rel, max(depth) FILTER (WHERE n_wells > 1) AS stop FROM up GROUP BY rel),
best AS (SELECT rel, arg_min(folder, depth) AS folder FROM up JOIN st USING (rel) WHERE n_wells = 1 AND depth > coalesce(stop, 0) GROUP BY rel)
SELECT r.rel, coalesce(b.folder, r.rel) AS root FROM (SELECT DISTINCT rel FROM papers) r LEFT JOIN best b USING (rel)""",
    "group_document": _PAPERS + "SELECT folder, min(path) AS path FROM anc GROUP BY folder",
    "entries": _PAPERS
    + _DATA
    + """, st AS (SELECT folder, stem, bool_or(ext = 'csv') AS has_csv, bool_or(ext = 'dbs') AS has_dbs FROM dfiles GROUP BY ALL),
nm AS (SELECT *, CASE WHEN folder = '' THEN stem WHEN count(*) OVER (PARTITION BY folder) = 1 THEN folder ELSE folder || '/' || stem END AS test_id FROM st),
fp AS (SELECT rel AS folder, min(path) AS path FROM papers GROUP BY rel)
SELECT n.test_id, n.folder, has_csv, has_dbs, fp.path AS document FROM nm n LEFT JOIN fp USING (folder)""",
    "basin_lookup": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Unknown' ELSE c_mktsegment || ' basin' END WHEN n_nationkey % 6 <> 0 THEN r_name ELSE 'Unknown' END AS basin,
  CASE WHEN c_custkey % 3 = 0 THEN 'formation' WHEN n_nationkey % 6 <> 0 THEN 'customer' ELSE 'default' END AS basin_source FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "well_folder": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' x' WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN 'r_' || c_name || '_z' ELSE '_unnamed_well' END AS folder FROM customer",
    "plan_moves": _REVIEWS
    + """SELECT rel, path AS src, 'out/' || basin || '/' || rel || '/' || base AS dst, 'keep' AS kind FROM ok JOIN fl USING (rel) WHERE kept
UNION ALL SELECT rel, quest, 'out/' || basin || '/' || rel || '/q.xlsx', 'questionnaire' FROM ok WHERE quest IS NOT NULL AND rel IN (SELECT rel FROM fl WHERE kept)
UNION ALL SELECT rel, path, 'root/_quarantine/' || path, 'quarantine' FROM ok JOIN fl USING (rel) WHERE NOT kept""",
    "plan_warnings": _REVIEWS
    + """SELECT d.rel, CASE WHEN g.rel IS NULL THEN 'unknown_group' WHEN n_wells <> 1 THEN 'ambiguous_well' ELSE 'stale_decision' END AS reason FROM d LEFT JOIN g ON d.rel = g.rel
WHERE status NOT IN ('', 'unsure') AND (g.rel IS NULL OR n_wells <> 1 OR decided_sig <> files_sig)""",
    "review_progress": _REVIEWS + "SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS decided, min(rel) FILTER (WHERE NOT ok) AS first_open FROM (SELECT g.rel, coalesce(status <> '' AND decided_sig = files_sig, FALSE) AS ok FROM g LEFT JOIN d USING (rel))",
    "separate_destinations": """WITH m AS (SELECT DISTINCT 'g' || l_partkey % 3 || '/f' || l_suppkey % 10 || '/' || l_partkey % 7 || '.csv' AS src, 'out/' || l_partkey % 7 || '.csv' AS dst, 'f' || l_suppkey % 10 || ' - ' || l_partkey % 7 AS named FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM m), t AS (SELECT src, r, CASE WHEN r = 1 THEN dst ELSE 'out/' || named || '.csv' END AS t FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r, src) AS k FROM t)
SELECT src, CASE WHEN k = 1 THEN t ELSE left(t, length(t) - 4) || ' (' || k || ').csv' END AS dst FROM k""",
    "merge_keeps": """WITH b AS (SELECT o_custkey AS rel, o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'failed' ELSE 'other' END AS status, 'old' AS message, 0 AS run FROM orders
  UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END, CASE WHEN o_orderpriority < '3' THEN 'delivered' ELSE 'skipped' END, 'new', 1 FROM orders)
SELECT rel, path, status, message FROM b QUALIFY row_number() OVER (PARTITION BY rel, path ORDER BY CASE WHEN status = 'delivered' THEN 2 WHEN status IN ('failed', 'skipped') THEN 1 ELSE 0 END DESC, run DESC) = 1""",
    "status": _STATUS,
    "infer_steps": "SELECT o_orderkey, concat_ws(',', " + ", ".join(f"CASE WHEN (o_orderkey >> {k}) % 3 = 0 THEN '{x}' END" for k, x in enumerate(log.STEPS)) + ") AS steps FROM orders",
    "step_gate": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 2 AND o_orderkey % 4 <> 0 THEN 'closure scenario' WHEN o_orderkey % 6 = 4 AND o_orderkey % 5 = 0 THEN 'postclosure scenario' END AS missing FROM orders",
    "log_row": _ALL
    + """SELECT test_id, '' AS closure_quality, '' AS pp_confidence, CASE WHEN ce IS NOT NULL THEN 'compliance' WHEN te_ IS NOT NULL THEN 'tangent' ELSE '' END AS net_pressure_isip_source, round(qmax, 4) AS max_rate, round(apparent, 3) AS "apparent_ISIP",
  round(ce, 2) AS "effective_ISIP", round(cp - 75, 2) AS "Shmin_compliance", round(ct / 60, 2) AS closure_time_compliance_min, round(tt / 60, 2) AS closure_time_tangent_min, round(apparent - ref, 2) AS near_wellbore_complexity FROM res""",
    "upsert_log": """SELECT o_orderkey AS test_id, o_totalprice AS value, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 <> 0
UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END, o_totalprice * 2, NULL FROM orders""",
    "orphans": "SELECT o_custkey AS test_id, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "queue_progress": f"SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('done', 'skipped')) AS finished FROM ({_STATUS})",
    "next_new": "SELECT arg_min(c_custkey, (c_custkey - 701 + 1000 * n) % n) AS ord FROM customer, (SELECT count(*) AS n FROM customer) WHERE c_custkey % 97 = 3",
    "dayfirst_sniff": """WITH x AS (SELECT user_id, (day(ts) - 1) % (10 + user_id % 7) + 1 AS d, month(ts) AS m FROM events)
SELECT user_id, CASE WHEN user_id % 2 = 1 THEN max(d) > 12 OR (count(DISTINCT m) = 1 AND count(DISTINCT d) > 1) ELSE FALSE END AS day_first FROM x GROUP BY user_id""",
    "parse_cascade": """SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 5 = 1 THEN strftime(ts, '%Y-%m-%d 12:00:00') WHEN event_id % 5 = 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed FROM events""",
    "ms_colon": "SELECT event_id, hour(ts) || strftime(ts, ':%M:%S.') || lpad((event_id % 1000)::VARCHAR, 3, '0') AS fixed FROM events",
    "column_units": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'psi' ELSE 'kpa' END AS unit, 'tubing ' || lower(c_mktsegment) AS bare FROM customer",
    "answer_blocks": """WITH c AS (SELECT o_custkey AS path, o_orderkey AS ord, CASE o_orderkey % 9 WHEN 0 THEN 'fluid density' WHEN 1 THEN 'fluid' WHEN 2 THEN 'tvd' END AS own FROM orders),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING) AS label FROM c)
SELECT path, label, coalesce(string_agg(ord::VARCHAR, '|' ORDER BY ord) FILTER (WHERE own IS NULL), '') AS answers FROM l WHERE label IS NOT NULL GROUP BY path, label""",
    "density_rule": """SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size + 0.5 BETWEEN 6 AND 22 THEN p_size + 0.5 END WHEN 1 THEN CASE WHEN (0.4 + p_size % 10 / 100) / 0.052 BETWEEN 6 AND 22 THEN (0.4 + p_size % 10 / 100) / 0.052 END
  WHEN 2 THEN (1 + p_size % 10 / 10) * 8.345 WHEN 3 THEN CASE WHEN p_size BETWEEN 6 AND 22 THEN p_size END WHEN 5 THEN 9.1 END::DOUBLE, 6) AS ppg FROM part""",
    "depth_rule": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2) AND p_size * 700 BETWEEN 1000 AND 25000 THEN p_size * 700 END::DOUBLE AS tvd FROM part",
    "norm_name": """SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS norm, FALSE AS generic, 'BRAND ' || p_brand[7:] AS formation, 'ab ' || p_brand AS component FROM part""",
    "api_key": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN lpad(s_nationkey::VARCHAR, 3, '0') || lpad(s_suppkey::VARCHAR, 5, '0') END AS api FROM supplier",
    "ambiguous_pick": _REGISTRY + "SELECT key, min(label) AS label, count(DISTINCT label) AS n_labels FROM dir GROUP BY key",
    "exact_match": _REGISTRY
    + """, a AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SUPPLIER' || lpad((p_partkey % 15)::VARCHAR, 9, '0') WHEN 1 THEN 'CUSTOMER' || lpad((p_partkey % 200)::VARCHAR, 9, '0') WHEN 3 THEN 'AB' WHEN 4 THEN regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') END AS key FROM part),
d AS (SELECT key, min(label) AS label, count(DISTINCT label) AS n FROM dir GROUP BY key), w AS (SELECT key, min(label) AS label FROM well GROUP BY key)
SELECT p_partkey, CASE WHEN d.n > 1 THEN d.label || ' (' || d.n || ' candidates)' ELSE coalesce(d.label, w.label) END AS label,
  CASE WHEN a.key IS NULL THEN 'no-well-name' WHEN a.key = 'AB' THEN 'name-too-generic' WHEN d.key IS NOT NULL THEN 'directional-exact' WHEN w.key IS NOT NULL THEN 'wells-exact' ELSE 'no-match' END AS source
FROM a LEFT JOIN d USING (key) LEFT JOIN w USING (key)""",
    "registry_keys": """WITH k AS (SELECT c_custkey, unnest([CASE WHEN c_custkey % 2 = 0 THEN upper(replace(c_name, '#', '')) END, c_mktsegment || c_nationkey, c_nationkey || c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END]) AS key FROM customer)
SELECT DISTINCT c_custkey, key FROM k WHERE key IS NOT NULL""",
    "surface_place": _REGISTRY + "SELECT dir.label, lat, lon FROM dir LEFT JOIN well ON dir.k = well.k",
    "bottomhole": _REGISTRY + "SELECT well.label, coalesce(max(CASE WHEN dir.label = well.label THEN dir.label END), min(dir.label)) AS bottomhole FROM well LEFT JOIN dir ON dir.k = well.k GROUP BY well.label",
}
