"""Missions, conflicts, reset targets, pages and shares of queues on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import missions
from .registry import query


@query("""WITH m AS (SELECT o_orderkey, list_extract(['processing', 'validating', 'cleanup_pending', 'ready'], CAST(o_custkey % 4 + 1 AS BIGINT)) AS status, o_orderkey % 2 = 0 AS source, o_orderkey % 3 > 0 AS output, o_orderkey % 5 > 1 AS staging, o_orderkey % 7 > 2 AS same, o_orderkey % 11 > 2 AS valid FROM orders)
SELECT o_orderkey, CASE
WHEN status = 'ready' THEN 'ready'
WHEN (status = 'cleanup_pending' OR NOT source) AND NOT output THEN 'failed'
WHEN (status = 'cleanup_pending' OR NOT source) AND staging AND NOT same THEN 'failed'
WHEN (status = 'cleanup_pending' OR NOT source) AND NOT valid THEN 'failed'
WHEN status = 'cleanup_pending' OR NOT source THEN 'completed'
WHEN status = 'processing' AND output AND (NOT staging OR NOT same OR NOT valid) THEN 'failed'
WHEN status = 'processing' AND output THEN 'cleanup_pending'
WHEN status = 'processing' AND staging AND valid THEN 'validating'
WHEN status = 'processing' THEN 'ready'
WHEN NOT staging AND output THEN 'failed'
WHEN NOT staging THEN 'ready'
WHEN output AND NOT same THEN 'failed'
WHEN NOT valid THEN 'failed'
ELSE 'cleanup_pending' END AS next FROM m""")
def recovered_missions(t):
    k = F.col("o_orderkey")
    status = F.array(*map(F.lit, ("processing", "validating", "cleanup_pending", "ready")))[(F.col("o_custkey") % 4).cast("int")]
    return t.orders.select("o_orderkey", missions.recovered(status, k % 2 == 0, k % 3 > 0, k % 5 > 1, k % 7 > 2, k % 11 > 2).alias("next"))


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN event_id % 3 = 0 THEN 'IO' END AS error_code,
CASE event_id % 5 WHEN 0 THEN 'legacy format' WHEN 1 THEN 'mismatch: ' || event_type WHEN 2 THEN 'bomb ' || user_id || ' pixels exceeds limit' WHEN 3 THEN 'bomb ' || user_id END AS error_message FROM events)
SELECT event_id, error_message FROM m WHERE status = 'failed' AND error_code IS NULL AND (error_message IN ('legacy format', 'other') OR starts_with(error_message, 'mismatch: ') OR (starts_with(error_message, 'bomb ') AND contains(error_message, 'exceeds')))""")
def retryable_failures(t):
    i = F.col("event_id")
    user = F.col("user_id").cast("string")
    message = F.when(i % 5 == 0, "legacy format").when(i % 5 == 1, F.concat(F.lit("mismatch: "), "event_type")).when(i % 5 == 2, F.concat(F.lit("bomb "), user, F.lit(" pixels exceeds limit"))).when(i % 5 == 3, F.concat(F.lit("bomb "), user))
    x = t.events.select("event_id", F.when(i % 2 == 0, "failed").otherwise("ready").alias("status"), F.when(i % 3 == 0, "IO").alias("error_code"), message.alias("error_message"))
    return missions.retryable(x, ("legacy format", "other"), ("mismatch: ",), (("bomb ", "exceeds"),)).select("event_id", "error_message")


@query("""WITH m AS (SELECT p_partkey AS id, p_brand AS name, CASE WHEN p_size % 3 > 0 THEN 's' || p_size % 2 END AS scope, 's' || p_size % 2 AS own_scope, CASE WHEN p_partkey % 7 = 0 THEN 'failed' ELSE 'ready' END AS status FROM part)
SELECT id, coalesce((SELECT min(o.id) FROM m o WHERE o.name = m.name AND o.status <> 'failed' AND o.id <> m.id AND o.scope = m.scope), (SELECT min(o.id) FROM m o WHERE o.name = m.name AND o.status <> 'failed' AND o.id <> m.id AND o.scope IS NULL AND o.own_scope = m.scope)) AS conflict_id FROM m""")
def destination_conflict(t):
    size = F.col("p_size")
    own = F.concat(F.lit("s"), (size % 2).cast("string"))
    x = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.when(size % 3 > 0, own).alias("scope"), own.alias("own_scope"), F.when(F.col("p_partkey") % 7 == 0, "failed").otherwise("ready").alias("status"))
    return missions.destination_conflicts(x).select("id", "conflict_id")


_LEASES = "SELECT CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'filter:' || o_custkey || ':' || o_orderkey ELSE 'compression:' || o_custkey END AS owner, CASE WHEN o_orderstatus = 'F' THEN 'released' ELSE 'active' END AS status FROM orders"


def _leases(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    owner = F.when(k % 3 == 0, c).when(k % 3 == 1, F.concat(F.lit("filter:"), c, F.lit(":"), k.cast("string"))).otherwise(F.concat(F.lit("compression:"), c))
    return t.orders.select(owner.alias("owner"), F.when(F.col("o_orderstatus") == "F", "released").otherwise("active").alias("status"))


@query(f"WITH l AS ({_LEASES}) SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.status <> 'released' AND (l.owner = CAST(c_custkey AS VARCHAR) OR l.owner LIKE 'filter:' || c_custkey || ':%'))")
def anti_owner(t):
    return missions.without_leases(t.customer, _leases(t), "c_custkey").select("c_custkey")


@query(f"WITH l AS ({_LEASES}) SELECT s_suppkey, s_nationkey % 2 AS half FROM supplier WHERE (s_nationkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM l WHERE status <> 'released' AND owner LIKE 'compression:%')) OR (s_nationkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM l WHERE status = 'conflict'))")
def anti_uncorrelated(t):
    s, l = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 2).alias("half")), _leases(t)
    blocked = missions.unless_any(s.where("half = 0"), l.where("status <> 'released' AND owner LIKE 'compression:%'"))
    return blocked.union(missions.unless_any(s.where("half = 1"), l.where("status = 'conflict'")))


@query("""WITH target AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL AND o_orderstatus = 'F' THEN 'Q' ELSE o_orderstatus END AS status, CASE WHEN l_orderkey IS NOT NULL AND o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS attempts, l_orderkey IS NOT NULL AND o_orderstatus = 'F' AS returned FROM orders LEFT JOIN target ON l_orderkey = o_orderkey""")
def update_from(t):
    x = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("attempts"))
    targets = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return missions.updated_from(x, targets, "o_orderkey", F.col("status") == "F", {"status": F.lit("Q"), "attempts": F.lit(0)}).select("o_orderkey", "status", "attempts", "returned")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('view', 'click') AND CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 1)""")
def pending_exclusion(t):
    """Candidates without a pending task whose JSON inputs are the wanted ones."""
    k = F.get_json_object("props", "$.k").cast("long")
    held = t.events.where(F.col("event_type").isin("view", "click") & (k % 3 == 1)).select(F.col("user_id").alias("c_custkey")).distinct()
    return t.customer.join(held, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT n_nationkey, (n_nationkey - 7 + 25) % 25 AS place, CAST(ceil(90.0 / (25 - (n_nationkey - 7 + 25) % 25)) AS BIGINT) AS share FROM nation")
def fair_share(t):
    return missions.turn(t.nation.select("n_nationkey"), "n_nationkey", 7, 90).select("n_nationkey", F.col("place").cast("long").alias("place"), "share")


@query("""WITH p AS (SELECT c_custkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 100 OFFSET 100) SELECT c_custkey, (SELECT CASE WHEN count(*) = 100 THEN 200 ELSE 0 END FROM p) AS next_offset FROM p""")
def rotating_scan(t):
    page, following = missions.rotating_page(t.customer, ["c_nationkey", "c_custkey"], 100)
    return page.select("c_custkey", F.lit(following).alias("next_offset"))


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 60) SELECT *, 60 + (SELECT count(*) FROM p) AS next_offset FROM p""")
def bounded_page(t):
    return missions.bounded_page(t.orders, [F.col("o_orderdate").desc(), "o_orderkey"], 30, 60).select("o_orderkey", "o_orderstatus", "next_offset")


@query("SELECT count(*) > 0 AS pending FROM (SELECT 1 FROM events WHERE event_id > greatest(10, 400) AND event_type = 'purchase' AND user_id > 3 LIMIT 1)")
def pending_events(t):
    return missions.pending(t.events, 10, 400, (F.col("event_type") == "purchase") & (F.col("user_id") > 3))


@query("""WITH m(model_id, threshold) AS (VALUES (0, 0.5), (1, 0.5)), p AS (SELECT l_orderkey AS batch_id, l_suppkey % 2 AS model_id, CASE WHEN l_partkey % 9 = 0 THEN 0.4 ELSE 0.5 END AS threshold, l_quantity / 48 AS score FROM lineitem),
ok AS (SELECT batch_id FROM p JOIN m USING (model_id, threshold) WHERE score BETWEEN 0 AND 1 GROUP BY 1 HAVING count(DISTINCT model_id) = 2)
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS batch_id FROM orders JOIN ok ON batch_id = o_orderkey GROUP BY 1""")
def compatible_predictions(t):
    models = t.orders.sparkSession.createDataFrame([(0, 0.5), (1, 0.5)], "model_id long, threshold double")
    p = t.lineitem.select(F.col("l_orderkey").alias("batch_id"), (F.col("l_suppkey") % 2).cast("long").alias("model_id"), F.when(F.col("l_partkey") % 9 == 0, 0.4).otherwise(0.5).alias("threshold"), (F.col("l_quantity").cast("double") / 48).alias("score"))
    b = t.orders.select("o_custkey", F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("created_at"))
    return missions.compatible_batch(b, p, models, "o_custkey")


@query("""WITH f AS (SELECT p_partkey, '/data/' || p_brand || CASE WHEN p_size % 4 = 0 THEN '/sub' ELSE '' END || '/' || p_partkey || '.mp4' AS path FROM part), r(folder, role) AS (VALUES ('/data/Brand#11', 'liked'), ('/data/Brand#22', 'liked_source'), ('/data/Brand#33', 'disliked'))
SELECT p_partkey, role FROM f LEFT JOIN r ON regexp_extract(path, '^(.*)/[^/]*$', 1) = folder""")
def role_lookup(t):
    roles = t.part.sparkSession.createDataFrame([("/data/Brand#11", "liked", 0), ("/data/Brand#22", "liked_source", 1), ("/data/Brand#33", "disliked", 2), ("/data/Brand#11", "other", 3)], "folder string, role string, place int")
    path = F.concat(F.lit("/data/"), "p_brand", F.when(F.col("p_size") % 4 == 0, "/sub").otherwise(""), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    return missions.roles_by_folder(t.part.select("p_partkey", path.alias("path")), roles, "path").select("p_partkey", "role")


@query("""WITH x AS (SELECT event_id, event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 AS same, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), u AS (SELECT event_id, user_id FROM events)
SELECT event_id, n > 2 AND bool_and(same) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS stable FROM x JOIN u USING (event_id)""")
def stable_checks(t):
    return missions.stable_after(t.events, "user_id", "event_id", ["event_type"], 2).select("event_id", "stable")


@query("""SELECT event_id, coalesce(event_id * 10 < lag(event_id * 10 + CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) - 1, false) AS overlaps FROM events""")
def stamp_overlaps(t):
    x = t.events.select("event_id", "event_type", (F.col("event_id") * 10).alias("pts"), F.floor("value").cast("long").alias("count"))
    return missions.overlapping_stamps(x, "event_type", "pts", "count").select("event_id", "overlaps")


@query("SELECT count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives, count(*) FILTER (toxic = 1) >= 10 AND count(*) FILTER (toxic = 0) >= 10 AS enough FROM labels")
def class_gate(t):
    return missions.enough_of_each(t.labels, "toxic", 10)


@query("""WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n, event_id * 7919 % 10007 AS draw FROM events),
b AS (SELECT *, CASE WHEN n > 8 THEN floor(((place + 1) * 8 - 1) / CAST(n AS DOUBLE)) ELSE place END AS bin FROM x)
SELECT event_id FROM b QUALIFY row_number() OVER (PARTITION BY user_id, bin ORDER BY draw, place) = 1""")
def binned_windows(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    x = t.events.select("event_id", "user_id", (F.row_number().over(w.orderBy("event_id")) - 1).alias("place"), F.count("*").over(w).alias("n"))
    return missions.binned_choice(x, "user_id", "place", F.col("n"), 8, F.col("event_id") * 7919 % 10007).select("event_id")


@query("""SELECT c_custkey, sha256('{"C":"' || CASE WHEN c_custkey % 2 = 0 THEN '' || c_nationkey ELSE '0.1' END || '","class_weight":"balanced","kind":"' || c_mktsegment || '","seed":"1729"}') AS digest FROM customer""")
def hyper_digest(t):
    """Defaults, overridden by a group's own values, as canonical text and its digest."""
    defaults = F.create_map(*map(F.lit, ("C", "0.1", "class_weight", "balanced", "seed", "1729")))
    kind = F.create_map(F.lit("kind"), F.col("c_mktsegment"))
    given = F.when(F.col("c_custkey") % 2 == 0, F.map_concat(kind, F.create_map(F.lit("C"), F.col("c_nationkey").cast("string")))).otherwise(kind)
    return t.customer.select("c_custkey", F.sha2(F.to_json(missions.merged(defaults, given)), 256).alias("digest"))


@query("""SELECT vec_id, len(embedding[1:8] || embedding[9:16] || embedding[17:20]) AS width, round(list_sum(list_transform(embedding[1:8] || embedding[9:16] || embedding[17:20], lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS weighed FROM embeddings""")
def input_vectors(t):
    """Mean, deviation and coverage of a modality, one behind the other, as one vector."""
    from ..operators.features import input_vector

    e = t.embeddings.select("vec_id", *(F.transform(F.slice("embedding", a, n), lambda x: x.cast("double")).alias(c) for c, a, n in (("image_mean", 1, 8), ("image_std", 9, 8), ("image_cover", 17, 4))))
    v = input_vector(("image",))
    return e.select("vec_id", F.size(v).alias("width"), F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("weighed"))


@query("""SELECT vec_id, len(embedding[33:64] || embedding[1:32]) AS width, round(CAST((embedding[33:64] || embedding[1:32])[1] AS DOUBLE), 6) AS first, round(CAST((embedding[33:64] || embedding[1:32])[64] AS DOUBLE), 6) AS last FROM embeddings""")
def window_bags(t):
    """A window's modalities in their fixed order."""
    from ..operators.features import window_row

    e = t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("sound"), F.slice("embedding", 33, 32).alias("image"))
    v = window_row(("image", "sound"))
    return e.select("vec_id", F.size(v).alias("width"), F.round(v[0].cast("double"), 6).alias("first"), F.round(v[63].cast("double"), 6).alias("last"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal > 0 AS enabled FROM customer), b AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END AS seg FROM nation)
SELECT c_custkey, coalesce(enabled AND seg = c_mktsegment, false) AS bound, coalesce(NOT (enabled AND seg = c_mktsegment), true) AS changed FROM c LEFT JOIN b ON n_nationkey = c_nationkey AND n_nationkey < 20""")
def binding_check(t):
    """Whether a mission's binding is still what is published: all of its fields, or the workflow has changed."""
    k = F.col("n_nationkey")
    b = t.nation.where("n_nationkey < 20").select(k.alias("c_nationkey"), F.struct(F.lit(True), F.when(k % 5 == 0, "BUILDING").when(k % 5 == 1, "MACHINERY").otherwise("FURNITURE")).alias("now"))
    got = t.customer.join(F.broadcast(b), "c_nationkey", "left")
    same = F.coalesce(F.struct(F.col("c_acctbal") > 0, "c_mktsegment") == F.col("now"), F.lit(False))
    return got.select("c_custkey", same.alias("bound"), (~same).alias("changed"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, sha256(o_orderstatus || '|' || o_orderpriority) AS digest FROM orders), x AS (SELECT o_orderkey, digest, lag(digest) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM r)
SELECT o_orderkey, digest IS DISTINCT FROM before AS baseline FROM x""")
def scan_baseline(t):
    """A scan whose configuration differs from the active one only lays a base line."""
    from pyspark.sql import Window

    digest = F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256)
    before = F.lag(digest).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", (~digest.eqNullSafe(before)).alias("baseline"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'seen [REDACTED] at ab [REDACTED], abc' WHEN 1 THEN 'Bearer [REDACTED]; x' WHEN 2 THEN 'password=[REDACTED], next' ELSE 'get https://[REDACTED]@host/p' END AS line FROM customer""")
def redact_lines(t):
    k, name = F.col("c_custkey"), F.col("c_name")
    line = F.when(k % 4 == 0, "seen hunter22 at ab a1, abc").when(k % 4 == 1, F.concat(F.lit("Bearer "), F.translate(name, "#", "."), F.lit("; x"))).when(k % 4 == 2, F.concat(F.lit("password : "), name, F.lit(", next"))).otherwise(F.concat(F.lit("get https://u:"), k.cast("string"), F.lit("@host/p")))
    return t.customer.select("c_custkey", S.redact(line, ("hunter22", "a1")).alias("line"))
