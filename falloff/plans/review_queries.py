"""Queries of reviews, queues and log columns: the driver's tables stand in for groups, files and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from falloff.operators import corpus, log, review
from falloff.plans import interpret as plan
from falloff.plans.corpus_queries import _FILES, _REVIEWS, _STATUS, _files, _reviews, _states
from falloff.plans.views import PRELUDE, samples, table


def listed_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").select(F.col("c_name").alias("rel"), (F.col("c_custkey") % 3).alias("n_wells"))
    return review.listed_groups(groups, named_only=True, limit=50)


def scan_files(spark, sf_dir):
    """Documents as files in folders of their source; a third of all contents can't be profiled."""
    files = _files(spark, sf_dir)
    k = F.ascii(F.substring(F.substring_index("sig", ":", -1), 1, 1)) % 3
    profiles = files.select("sig").distinct().where(k < 2).select("sig", F.when(k == 0, "likely_dfit").otherwise("flat").alias("verdict"), (F.substring_index("sig", ":", 1).cast("long") % 7).alias("post_shutin_hr"))
    groups = files.select(F.col("group").alias("rel")).distinct().withColumn("n_wells", F.when(F.col("rel") != "none", 1))
    return review.scan(files, profiles, groups, named_only=True).select("path", "duplicate", "verdict", "post_shutin_hr", "suggested")


def suggested_keeper(spark, sf_dir):
    return scan_files(spark, sf_dir).where("suggested").select("path")


def review_pages(spark, sf_dir):
    files = _reviews(spark, sf_dir)[2].withColumnRenamed("rel", "group")
    return review.pages(files).select("path", "page", "panel", "n_pages")


def _begun(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    begun = cust.where("c_custkey % 3 = 0").select(F.col("c_name").alias("rel"), F.array(F.concat("c_name", F.lit("/begun"))).alias("keeps"))
    return begun, cust.where("c_custkey % 2 = 0").select(F.col("c_name").alias("group"), F.concat("c_name", F.lit("/best")).alias("path"))


def seeded_keeps(spark, sf_dir):
    groups, decisions, _ = _reviews(spark, sf_dir)
    return review.seeded_keeps(groups.select("rel", "files_sig"), decisions, *_begun(spark, sf_dir)).select("rel", F.array_join(F.array_sort("keeps"), "|").alias("kept"), "seed")


def decide(spark, sf_dir):
    groups, decisions, _ = _reviews(spark, sf_dir)
    k, name = F.col("c_custkey"), F.col("c_name")
    said = F.element_at(F.array(*map(F.lit, ("accept", "none", "unsure", "back"))), (k % 4 + 1).cast("int"))
    keeps = F.when(k % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(name, F.lit("/z")), F.concat(name, F.lit("/a"))))
    actions = table(spark, sf_dir, "customer").select(F.when(k % 11 == 0, "nowhere").otherwise(name).alias("rel"), said.alias("action"), keeps.alias("keeps"))
    out = review.decide(decisions, actions, groups)
    return out.select("rel", "status", F.array_join(F.array_sort("keeps"), "|").alias("kept"), "decided_sig")


def _carried(spark, sf_dir):
    """Moves of the plan, and their outcomes by the length of the source's path; some have none."""
    groups, decisions, files = _reviews(spark, sf_dir)
    moves = corpus.plan_moves(groups, decisions, files, "out", "root")
    k = F.ascii(F.substring(F.md5("src"), 1, 1)) % 4
    told = F.element_at(F.array(*map(F.lit, ("delivered", "failed", "skipped"))), (k + 1).cast("int"))
    outcomes = moves.where(k < 3).select("src", told.alias("status"), F.lit("disk").alias("message"))
    return moves, outcomes, groups.withColumn("basin_source", F.lit("formation"))


def provenance(spark, sf_dir):
    return review.provenance(*_carried(spark, sf_dir))


def apply_failures(spark, sf_dir):
    moves, outcomes, _ = _carried(spark, sf_dir)
    return review.failures(moves, outcomes)


def queue(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    post, said = F.when(k % 5 == 0, "PC-F none").otherwise("PC-A"), F.when(k % 9 == 0, "skipped")
    at = F.concat(F.lit("w/"), k.cast("string"))
    entries = orders.select(at.alias("test_id"), F.when(k % 3 != 0, F.concat(at, F.lit(".csv"))).alias("csv"), F.when(k % 2 == 0, F.concat(at, F.lit(".dbs"))).alias("dbs"))
    picks = orders.select(at.alias("test_id"), said.alias("status"), _states(11).alias("steps"), post.alias("postclosure_scenario"), F.when(k % 7 == 0, "DBS").otherwise("csv").alias("active_source"))
    return review.queue(entries, picks).select("test_id", "status", F.array_join("sources", ",").alias("sources"), "display_label", "source", "data_path")


def containment(spark, sf_dir):
    k = F.col("o_orderkey")
    folder = F.concat(F.lit("a/b"), F.when(k % 3 == 0, "").when(k % 3 == 1, "/c").otherwise("c"))
    group = F.when(k % 2 == 0, "a/b").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", review.under(folder, group).alias("inside"), review.strictly_under(folder, group).alias("below"), review.subfolder(folder, group).alias("label"))


def bottomhole_pressures(spark, sf_dir):
    """Each test's pressure at bottomhole: a third is measured there, a third converted, a third lacks its fluid."""
    rows, k = samples(spark, sf_dir), F.col("test_id")
    channels = rows.select("test_id").distinct().select("test_id", (k % 3 == 0).alias("is_bhp"), F.when(k % 3 == 1, F.lit(9.0)).alias("mw_ppg"), F.lit(10000.0).alias("tvd_ft"))
    ready = channels.select("test_id", plan.inputs_ready(F.col("is_bhp"), F.col("mw_ppg"), F.col("tvd_ft")).alias("ready"))
    out = plan.with_bottomhole(rows, channels).groupBy("test_id").agg(F.round(F.min("p"), 4).alias("p_low"), F.round(F.max("p"), 4).alias("p_high"))
    return out.join(ready, "test_id")


#: What a row of results needs, besides texts, for the log.
_NUMBERS = ["t_start_inj", "t_shutin", "te", "vinj", "qmax", "apparent_isip", "eff_isip_compliance", "pressure_compliance", "shmin_compliance", "shmin_tangent", "closure_G", "pore_pressure", "net_pressure_compliance", "net_pressure_tangent", "delta_closure",
            "eff_isip_tangent", "eff_isip_variable", "shmin_variable", "shmin_rapid", "net_pressure_variable", "closure_time_compliance", "closure_time_tangent", "closure_time_variable", "complexity", "tvd_ft", "mw_ppg"]
_LOGGED = ["t_start_inj", "t_shutin", "te", "Vinj", "max_rate", "apparent_ISIP", "effective_ISIP", "contact_pressure", "Shmin_compliance", "Shmin_tangent", "tangent_Gc", "pore_pressure", "net_pressure_compliance", "net_pressure_tangent", "delta_closure",
           "effective_ISIP_tangent", "effective_ISIP_variable", "Shmin_variable", "Shmin_rapid", "net_pressure_variable", "closure_time_compliance_min", "closure_time_tangent_min", "closure_time_variable_min", "near_wellbore_complexity", "tvd", "fluid_density"]
_CLOSURES, _POSTS = ("C-A: clear", "C-B", "C-C x", "C-D", "", None), ("PC-A", "PC-B 1", "PC-C", "PC-D", "PC-E", "PC-F", None)


def log_columns(spark, sf_dir):
    """All 45 columns, from rows with every number known: order k's n-th number is k + n."""
    k = F.col("o_orderkey")
    of = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("test_id"), of(_CLOSURES).alias("closure_scenario"), of(_POSTS).alias("postclosure_scenario"), F.lit("tangent").alias("net_pressure_source"), (k % 2 == 0).alias("is_bhp"), F.lit("tm12").alias("pp_axis"),
        F.col("o_orderstatus").alias("notes"), F.concat(F.lit("f/"), k.cast("string")).alias("file"), F.lit("w").alias("well_name"), F.lit("fm").alias("formation"), F.lit("done").alias("status"),
        F.lit("someone").alias("interpreter"), F.col("o_orderdate").cast("date").alias("review_date"), *[(k + n).cast("double").alias(c) for n, c in enumerate(_NUMBERS)],
    )
    out = log.log_row(rows)
    return out.select([F.round(F.col(c), 6).alias(c) if c.endswith("_min") else F.date_format(c, "yyyy-MM-dd").alias(c) if c == "review_date" else F.col(c) for c in out.columns])


def _texts(texts) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in texts) + f"][o_orderkey % {len(texts)} + 1]"


def _words(column: str, words: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} LIKE '{head}%' THEN '{word}'" for head, word in words.items()) + " ELSE '' END"


QUERIES = {
    f.__name__: f
    for f in (listed_groups, scan_files, suggested_keeper, review_pages, seeded_keeps, decide, provenance, apply_failures, queue, containment, bottomhole_pressures, log_columns)
}

_SCAN = (
    _FILES
    + """, s AS (SELECT *, min(path) OVER (PARTITION BY grp, sig) AS low, ascii(string_split(sig, ':')[2]) % 3 AS k, string_split(sig, ':')[1]::BIGINT % 7 AS hr FROM f WHERE grp <> 'none'),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN k = 0 AND path = low THEN 0 ELSE 1 END, hr DESC, path) AS n FROM s),
scanned AS (SELECT path, path <> low AS duplicate, CASE k WHEN 0 THEN 'likely_dfit' WHEN 1 THEN 'flat' ELSE 'load_error' END AS verdict, CASE WHEN k < 2 THEN hr END AS post_shutin_hr, k = 0 AND path = low AND n = 1 AS suggested FROM r)
"""
)
_MOVED = (
    _REVIEWS
    + """, mv AS (
  SELECT rel, path AS src, 'out/' || basin || '/' || rel || '/' || base AS dst, 'keep' AS kind, basin FROM ok JOIN fl USING (rel) WHERE kept
  UNION ALL SELECT rel, quest, 'out/' || basin || '/' || rel || '/q.xlsx', 'questionnaire', basin FROM ok WHERE quest IS NOT NULL AND rel IN (SELECT rel FROM fl WHERE kept)
  UNION ALL SELECT rel, path, 'root/_quarantine/' || path, 'quarantine', basin FROM ok JOIN fl USING (rel) WHERE NOT kept),
oc AS (SELECT *, ['delivered', 'failed', 'skipped', 'unknown'][ascii(md5(src)) % 4 + 1] AS status FROM mv)
"""
)

ORACLE_SQL = {
    "listed_groups": "SELECT c_name AS rel, c_custkey % 3 AS n_wells FROM customer WHERE c_custkey % 3 >= 1 ORDER BY rel LIMIT 50",
    "scan_files": _SCAN + "SELECT * FROM scanned",
    "suggested_keeper": _SCAN + "SELECT path FROM scanned WHERE suggested",
    "review_pages": _REVIEWS + "SELECT path, (n - 1) // 8 AS page, (n - 1) % 8 AS panel, (total + 7) // 8 AS n_pages FROM (SELECT path, row_number() OVER (PARTITION BY rel ORDER BY path) AS n, count(*) OVER (PARTITION BY rel) AS total FROM fl)",
    "seeded_keeps": _REVIEWS
    + """, kk AS (SELECT rel, string_agg(path, '|' ORDER BY path) AS kept FROM fl WHERE kept GROUP BY rel),
c AS (SELECT g.rel, g.c_custkey, d.status <> '' AND decided_sig = files_sig AS is_current FROM g LEFT JOIN d USING (rel))
SELECT rel, CASE WHEN is_current THEN coalesce(kept, '') WHEN c_custkey % 3 = 0 THEN rel || '/begun' WHEN c_custkey % 2 = 0 THEN rel || '/best' ELSE '' END AS kept,
  CASE WHEN is_current THEN 'decision' WHEN c_custkey % 3 = 0 THEN 'in_progress' WHEN c_custkey % 2 = 0 THEN 'suggested' ELSE 'none' END AS seed FROM c LEFT JOIN kk USING (rel)""",
    "decide": _REVIEWS
    + """, kk AS (SELECT rel, string_agg(path, '|' ORDER BY path) AS kept FROM fl WHERE kept GROUP BY rel),
dk AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'gone ' || c_name ELSE c_name END AS rel, ['done', 'skip', 'unsure', ''][c_custkey % 4 + 1] AS status, coalesce(kept, '') AS kept, CASE WHEN c_custkey % 6 = 0 THEN 'old' ELSE md5(c_name) END AS decided_sig FROM customer LEFT JOIN kk ON c_name = kk.rel),
a AS (SELECT rel, CASE c_custkey % 4 WHEN 0 THEN 'decided' WHEN 1 THEN 'none' WHEN 2 THEN 'unsure' END AS status, CASE WHEN c_custkey % 4 = 1 OR c_custkey % 8 = 0 THEN '' ELSE rel || '/a|' || rel || '/z' END AS kept, files_sig AS decided_sig
  FROM g WHERE c_custkey % 11 <> 0 AND c_custkey % 4 <> 3 AND c_custkey % 8 <> 0)
SELECT * FROM a UNION ALL SELECT * FROM dk WHERE rel NOT IN (SELECT rel FROM a)""",
    "provenance": _MOVED
    + """SELECT 'out/' || basin || '/' || rel AS dest, rel, rel AS well, basin, 'formation' AS basin_source, src AS path, status, CASE WHEN status = 'delivered' THEN dst END AS dst, CASE WHEN status IN ('failed', 'skipped') THEN 'disk' END AS message FROM oc WHERE kind = 'keep'""",
    "apply_failures": _MOVED + "SELECT kind, src, dst, 'disk' AS error FROM oc WHERE status = 'failed'",
    "queue": f"""WITH st AS ({_STATUS}), e AS (SELECT o_orderkey AS k, 'w/' || o_orderkey AS test_id, o_orderkey % 3 <> 0 AS c, o_orderkey % 2 = 0 AS d, status FROM st),
x AS (SELECT *, CASE WHEN d AND (k % 7 = 0 OR NOT c) THEN 'DBS' WHEN c THEN 'CSV' END AS source FROM e)
SELECT test_id, status, concat_ws(',', CASE WHEN c THEN 'CSV' END, CASE WHEN d THEN 'DBS' END) AS sources, 'w / ' || k AS display_label, source, test_id || '.' || lower(source) AS data_path FROM x""",
    "containment": """SELECT o_orderkey, o_orderkey % 2 <> 0 OR o_orderkey % 3 < 2 AS inside, o_orderkey % 2 <> 0 OR o_orderkey % 3 = 1 AS below,
  CASE WHEN o_orderkey % 2 = 0 THEN ['', 'c', NULL][o_orderkey % 3 + 1] ELSE ['a/b', 'a/b/c', 'a/bc'][o_orderkey % 3 + 1] END AS label FROM orders""",
    "bottomhole_pressures": PRELUDE
    + """SELECT test_id, round(min(CASE test_id % 3 WHEN 0 THEN p WHEN 1 THEN p + 4680 END), 4) AS p_low, round(max(CASE test_id % 3 WHEN 0 THEN p WHEN 1 THEN p + 4680 END), 4) AS p_high, test_id % 3 < 2 AS ready FROM samples GROUP BY test_id""",
    "log_columns": "WITH x AS (SELECT *, "
    + f"{_texts(_CLOSURES)} AS cs, {_texts(_POSTS)} AS ps FROM orders) SELECT o_orderkey AS test_id, coalesce(cs, '') AS closure_scenario, coalesce(ps, '') AS postclosure_scenario, "
    + f"{_words('cs', log.CLOSURE_QUALITY)} AS closure_quality, {_words('ps', log.POSTCLOSURE_TREND)} AS postclosure_trend, CASE WHEN ps LIKE 'PC-E%' OR ps LIKE 'PC-F%' THEN 'low' ELSE '' END AS pp_confidence, "
    + "CASE WHEN o_orderkey % 2 = 0 THEN 'BHP' ELSE 'WHP' END AS pressure_source, 'tangent' AS net_pressure_isip_source, 'tm12' AS pp_axis, o_orderstatus AS notes, 'f/' || o_orderkey AS file, 'w' AS well_name, 'fm' AS formation, 'done' AS status, "
    + "'someone' AS interpreter, strftime(o_orderdate::DATE, '%Y-%m-%d') AS review_date, '' AS orientation, '' AS fluid_type, '' AS play, "
    + ", ".join(f"round((o_orderkey + {n}) / 60.0, 6)::DOUBLE AS {c}" if c.endswith("_min") else f'(o_orderkey + {n})::DOUBLE AS "{c}"' for n, c in enumerate(_LOGGED))
    + " FROM x",
}
