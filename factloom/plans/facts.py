"""Facts and versions: orders are claims about customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge, temporal
from .registry import NOW, query, seconds

V = """v0 AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate, epoch_us(o_orderdate) // 1000000 AS t,
         lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
v AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, t AS valid_from, lead(t) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by
  FROM v0 WHERE before IS NULL OR before <> o_orderstatus WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def versions(t) -> DataFrame:
    claims = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate", seconds("o_orderdate").alias("at"))
    return temporal.versioned(claims, topic=["o_custkey"], order=["o_orderdate", "o_orderkey"], claim="o_orderstatus", at="at", ident="o_orderkey").drop("at", "o_orderdate")


@query(f"WITH {V} SELECT o_custkey, o_orderkey, o_orderstatus, valid_from, valid_to, superseded_by FROM v")
def supersede_chain(t):
    return versions(t).select("o_custkey", "o_orderkey", "o_orderstatus", "valid_from", "valid_to", "superseded_by")


@query(f"WITH {V} SELECT o_custkey, o_orderkey, o_orderstatus, valid_from FROM v WHERE valid_to IS NULL")
def live_view(t):
    return temporal.live(versions(t)).select("o_custkey", "o_orderkey", "o_orderstatus", "valid_from")


@query(f"WITH {V} SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'constraint' ELSE 'change' END AS decision_class FROM v WHERE valid_to IS NULL AND coalesce(CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'constraint' ELSE 'change' END, 'constraint') = 'constraint'")
def constraints_view(t):
    klass = F.when(F.col("o_orderstatus") == "F", "constraint").when(F.col("o_orderstatus") != "O", "change")
    return temporal.constraints(versions(t).withColumn("decision_class", klass)).select("o_custkey", "o_orderkey", "decision_class")


@query(f"WITH {V} SELECT o_orderkey, o_orderstatus, valid_from, valid_to FROM v WHERE o_custkey = 7")
def history_topic(t):
    return temporal.history(versions(t), {"o_custkey": 7}, order=("valid_from", "o_orderkey")).select("o_orderkey", "o_orderstatus", "valid_from", "valid_to")


@query(f"WITH {V} SELECT o_custkey, o_orderkey, o_orderstatus FROM v WHERE valid_from <= 852076800 AND (valid_to IS NULL OR valid_to > 852076800)")
def asof_snapshot(t):
    return temporal.as_of(versions(t), 852076800).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"WITH {V} SELECT o_custkey, o_orderkey, valid_from FROM v WHERE valid_to IS NULL AND o_orderstatus = 'O' ORDER BY valid_from DESC, o_orderkey LIMIT 50")
def query_atoms_filter(t):
    return temporal.query_atoms(versions(t), where={"o_orderstatus": "O"}, order_by="valid_from DESC", ident="o_orderkey", limit=50).select("o_custkey", "o_orderkey", "valid_from")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, epoch_us(o_orderdate) // 1000000 AS valid_from FROM orders),
r AS (SELECT *, row_number() OVER w AS n, first_value(o_orderkey) OVER w AS survivor, first_value(valid_from) OVER w AS s_at FROM n WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY valid_from DESC, o_orderkey))
SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN n > 1 THEN s_at END AS valid_to, CASE WHEN n > 1 THEN survivor END AS superseded_by FROM r""")
def reconcile_topics(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", seconds("o_orderdate").alias("valid_from"))
    return temporal.reconciled(rows, topic=["o_custkey", "o_orderstatus"], ident="o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "valid_to", "superseded_by")


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def conflict_topics(t):
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {V} SELECT least(o_orderkey, superseded_by) AS src_id, greatest(o_orderkey, superseded_by) AS dst_id, 'CONTRADICTS' AS kind FROM v WHERE superseded_by IS NOT NULL AND o_orderpriority <> '5-LOW'")
def contradiction_edges(t):
    return temporal.contradictions(versions(t), ident="o_orderkey", source="o_orderpriority", natural=("5-LOW",))


@query(f"SELECT o_orderkey, round(0.000001 * o_totalprice * pow(0.5, greatest(0, {NOW} - epoch_us(o_orderdate) // 1000000) / 77760000.0), 9) AS score FROM orders")
def decay_score(t):
    score = temporal.decayed(F.col("o_totalprice"), F.lit(0.000001), seconds("o_orderdate"), NOW, 900.0)
    return t.orders.select("o_orderkey", F.round(score, 9).alias("score"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS last_ok FROM orders WHERE o_orderstatus = 'P' OR epoch_us(o_orderdate) // 1000000 < 800000000 ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE epoch_us(o_orderdate) // 1000000 END, o_orderkey LIMIT 50".replace("AS last_ok FROM", "* CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1 END AS last_ok FROM"))
def stale_frontier(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", seconds("o_orderdate")).alias("last_ok"))
    return temporal.stale(rows, 800000000, last_ok="last_ok", ident="o_orderkey")


@query(f"WITH {V} SELECT o_orderkey, valid_from + 7776000 AS confirm_by FROM v WHERE valid_to IS NULL AND valid_from + 7776000 < 900000000")
def unconfirmed(t):
    return temporal.unconfirmed(versions(t).withColumn("confirm_by", F.col("valid_from") + 7776000), 900000000).select("o_orderkey", "confirm_by")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_unknown FROM events GROUP BY event_type")
def census_by_type(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_unknown"))


HALVES = """h AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, epoch_us(o_orderdate) // 1000000 AS t FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, epoch_us(o_orderdate) // 1000000 FROM orders WHERE o_orderkey % 3 <> 1)"""


@query(f"""WITH {HALVES}, k AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'ast' WHEN 'O' THEN 'regex' ELSE 'none' END AS lk, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 1 END AS rank FROM h),
a AS (SELECT o_custkey, max(t) AS liveness_last_ok, min(t) AS created_at, bool_or(o_totalprice > 200000) AS pinned, list_sort(list_distinct(list(o_orderpriority))) AS refs,
  min(CASE WHEN o_orderstatus = 'F' THEN {{'t': t, 's': o_orderkey}} END) AS c, max({{'r': rank, 'k': lk}}) AS l, min(o_orderpriority) AS source FROM k GROUP BY o_custkey)
SELECT o_custkey, c.t AS valid_to, c.s AS superseded_by, liveness_last_ok, created_at, pinned, array_to_string(refs, ',') AS refs, l.k AS liveness_kind, source FROM a""")
def merge_atoms(t):
    s = F.col("o_orderstatus")
    at = seconds("o_orderdate")
    none = F.lit(None).cast("string")
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.when(s == "F", at).alias("valid_to"), F.when(s == "F", F.col("o_orderkey")).alias("superseded_by"), at.alias("liveness_last_ok"), at.alias("updated_at"), at.alias("created_at"), at.alias("confirm_by"),
        (F.col("o_totalprice") > 200000).alias("pinned"), F.lit(False).alias("archived"), F.array("o_orderpriority").alias("valid_in_refs"), F.when(s == "F", "ast").when(s == "O", "regex").otherwise("none").alias("liveness_kind"), none.alias("liveness_target"), none.alias("liveness_pattern"), F.col("o_orderpriority").alias("source"),
    )
    out = merge.merged_atoms(rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 3 <> 1"), ["o_custkey"], stable=("source",))
    return out.select("o_custkey", "valid_to", "superseded_by", "liveness_last_ok", "created_at", "pinned", F.array_join("valid_in_refs", ",").alias("refs"), "liveness_kind", "source")


@query("""WITH e AS (SELECT l_suppkey, l_partkey, l_discount * 10 AS weight, l_tax AS confidence, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'live' ELSE 'suggested' END AS status, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rank, epoch_us(l_shipdate) // 1000000 AS t FROM lineitem)
SELECT l_suppkey, l_partkey, round(max(weight), 6) AS weight, max(confidence) AS confidence, arg_max(status, rank) AS status, min(t) AS created_at FROM e GROUP BY l_suppkey, l_partkey""")
def merge_edges(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", (F.col("l_discount") * 10).alias("weight"), F.col("l_tax").alias("confidence"), F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "live").otherwise("suggested").alias("status"), F.lit(None).cast("long").alias("valid_to"), seconds("l_shipdate").alias("created_at"), F.lit("git").alias("source"))
    out = merge.merged_edges(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["l_suppkey", "l_partkey"])
    return out.select("l_suppkey", "l_partkey", F.round("weight", 6).alias("weight"), "confidence", "status", "created_at")


@query("""WITH s AS (SELECT doc_id // 3 AS atom_id, 50 AS resolution, text, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL),
m AS (SELECT atom_id, resolution, arg_min(text, {'d': abs(words - resolution), 't': text}) AS text FROM s GROUP BY ALL)
SELECT atom_id, resolution, md5(text) AS text_md5, CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS token_count FROM m""")
def merge_summaries(t):
    rows = t.documents.where("text is not null").select(F.floor(F.col("doc_id") / 3).cast("long").alias("atom_id"), F.lit(50).alias("resolution"), "text", "doc_id")
    out = merge.merged_summaries(rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 2 = 1").drop("doc_id"))
    return out.select("atom_id", "resolution", F.md5(F.col("text").cast("binary")).alias("text_md5"), "token_count")


NORM = r"trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query(f"SELECT doc_id, 'glossary_' || substr(sha1('glossary' || chr(0) || source || chr(0) || {NORM}), 1, 12) AS atom_id FROM documents")
def content_id(t):
    return t.documents.select("doc_id", X.content_id(F.lit("glossary"), F.col("source"), F.col("text")).alias("atom_id"))


@query(f"SELECT doc_id, substr(sha256({NORM}), 1, 16) AS fingerprint FROM documents")
def fingerprint(t):
    return t.documents.select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT o_orderkey, '{"_table":"atoms","id":"' || o_orderkey || '","status":"' || o_orderstatus || '","topic":"' || o_custkey || '"}' AS line FROM orders""")
def export_rows(t):
    from ..sources.jsonl import rendered

    rows = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("topic"))
    return rendered(rows, "atoms", ["id", "status", "topic"], keep=["o_orderkey"])
