"""Reconciliation, queues, decision tables, files, learning and streaming on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import files, joins, learning, reconcile, workqueue
from .registry import query


# --- files ---------------------------------------------------------------------------------------------------------
@query("""SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, sha256(string_agg(doc_id || chr(0) || n_chars || chr(0) || lang, chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10)) AS digest FROM documents GROUP BY source""")
def manifest_digest(t):
    x = t.documents.select("source", F.col("doc_id").cast("string").alias("path"), "n_chars", "lang")
    return files.manifest(x, "source", "path", "n_chars", "lang")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), g AS (SELECT sha256, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, sha256, first_id, copies FROM d JOIN g USING (sha256)""")
def content_duplicates(t):
    return files.content_copies(t.documents, "doc_id", "text")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER w AS nth, sum(l_quantity) OVER w AS upto FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nth, upto, nth <= 4 AND upto <= 100 AS within FROM m""")
def member_budget(t):
    x = files.member_budget(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_quantity", 4, 100)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nth", "upto", "within")


@query()
def assigned_names(t):
    """Names of colliding pages by host; depends on all names before, so no SQL."""
    x = t.pages.select(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("scope"), F.col("page_id").cast("string").alias("provenance"), F.concat(F.lit("page"), (F.col("page_id") % 7).cast("string"), F.lit(".html")).alias("name"))
    return files.assigned_names(x)


@query()
def archive_members(t):
    """A zip built from pages, expanded again by the table function."""
    from ..sources.files import ArchiveMembers

    spark = t.pages.sparkSession
    rows = zip_of_pages(t.pages)
    spark.udtf.register("archive_members", ArchiveMembers)
    rows.createOrReplaceTempView("__archives")
    return spark.sql("SELECT a.name, m.member, m.depth, m.size FROM __archives a, LATERAL archive_members(a.name, a.content) m")


def zip_of_pages(pages):
    import io
    import zipfile

    import pandas as pd

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        inner, outer = io.BytesIO(), io.BytesIO()
        df = df.sort_values("page_id")
        with zipfile.ZipFile(inner, "w") as z:
            for i, html in zip(df["page_id"], df["html"], strict=True):
                z.writestr(f"{i}.html", html or "")
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("nested.zip", inner.getvalue())
            z.writestr("__MACOSX/._x", "x")
            z.writestr("index.txt", "\n".join(map(str, df["page_id"])))
        return pd.DataFrame({"name": [df["host"].iloc[0]], "content": [outer.getvalue()]})

    x = pages.select("page_id", "html", F.concat(F.lit("host"), F.pmod("page_id", F.lit(97)).cast("string")).alias("host"))
    return x.groupBy("host").applyInPandas(pack, "name string, content binary")


# --- reconciliation ------------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'arrived' WHEN a.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(t):
    o = t.orders
    old = o.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return joins.changed_rows(o.where("o_orderkey % 5 <> 0"), old, "o_orderkey", ["o_orderstatus"])


@query("""WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS path_key, o_custkey AS size_bytes, CASE WHEN o_orderkey % 6 = 1 THEN 1 ELSE 0 END AS modified_ns FROM orders WHERE o_orderkey % 5 <> 0),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path_key, o_custkey AS size_bytes, 0 AS modified_ns, o_orderdate AS since FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT coalesce(s.path_key, o.path_key) AS path_key, s.path_key IS NULL AS gone, o.path_key IS NULL AS fresh, s.size_bytes IS NOT DISTINCT FROM o.size_bytes AND s.modified_ns IS NOT DISTINCT FROM o.modified_ns AS same, since FROM s FULL JOIN o ON s.path_key = o.path_key)
SELECT path_key, CASE WHEN gone AND epoch(TIMESTAMP '1998-01-01') - epoch(since) >= 86400 * 365 THEN 'negative' WHEN gone THEN 'missing' WHEN fresh THEN 'arrived' WHEN NOT same THEN 'changed' WHEN epoch(TIMESTAMP '1998-01-01') - epoch(since) >= 86400 THEN 'stable' ELSE 'settling' END AS change FROM j""")
def reconcile_scan(t):
    base = t.orders.select(F.col("o_orderkey").cast("string").alias("path_key"), F.lit("liked").alias("role"), F.col("o_custkey").alias("size_bytes"), F.lit(0).alias("modified_ns"), F.col("o_orderkey").cast("string").alias("content"), "o_orderkey", "o_orderdate")
    fields = ["path_key", "role", "size_bytes", "modified_ns", "content"]
    now = base.where("o_orderkey % 5 <> 0").withColumn("modified_ns", F.when(F.col("o_orderkey") % 6 == 1, 1).otherwise(0)).select(fields)
    state = base.where("o_orderkey % 4 <> 0").select(*fields, F.col("o_orderdate").alias("stable_since"), F.col("o_orderdate").alias("missing_since"), F.lit("present").alias("status"))
    got = reconcile.reconciled(now, state, "1998-01-01 00:00:00", 86400, 86400 * 365)
    return got.select("path_key", "change")


# --- queues --------------------------------------------------------------------------------------------------------
_VIDEO = """(VALUES ('waiting_stable', 'unchanged', 'ready', 'count_check'), ('waiting_stable', 'changed', 'waiting_stable', 'reset_checks'), ('ready', 'unchanged', 'ready', 'keep'),
('ready', 'changed', 'waiting_stable', 'reset_checks'), ('failed', 'unchanged', 'failed', 'keep'), ('failed', 'changed', 'waiting_stable', 'reset_checks'),
('completed', 'unchanged', 'waiting_stable', 'start_again'), ('completed', 'changed', 'waiting_stable', 'start_again'), ('ready', 'claim', 'processing', 'count_attempt'), ('ready', 'error', 'failed', 'record'),
('processing', 'error', 'failed', 'record'))"""


@query(f"""WITH s AS (SELECT o_orderkey, list_extract(['waiting_stable', 'ready', 'processing', 'completed', 'failed'], CAST(o_custkey % 5 + 1 AS BIGINT)) AS status, list_extract(['unchanged', 'changed', 'claim', 'error'], CAST(o_orderkey % 4 + 1 AS BIGINT)) AS event FROM orders), t(status, event, next, action) AS {_VIDEO}
SELECT o_orderkey, s.status, s.event, coalesce(t.next, s.status) AS next, coalesce(t.action, 'reject') AS action FROM s LEFT JOIN t ON s.status = t.status AND s.event = t.event""")
def transition_table(t):
    pick = lambda values, i: F.array(*map(F.lit, values))[i.cast("int")]
    x = t.orders.select("o_orderkey", pick(["waiting_stable", "ready", "processing", "completed", "failed"], F.col("o_custkey") % 5).alias("status"), pick(["unchanged", "changed", "claim", "error"], F.col("o_orderkey") % 4).alias("event"))
    return workqueue.transitioned(x, "video").select("o_orderkey", "status", "event", "next", "action")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 70""")
def discovery_budget(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return workqueue.discovered(t.orders.where("o_orderstatus = 'O'"), done, "o_orderkey", ["o_orderdate", "o_orderkey"], queued=30, limit=100).select("o_orderkey")


@query("""WITH q AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_orderpriority) AS busy, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT o_orderkey, o_orderpriority AS kind FROM q WHERE o_orderstatus = 'O' AND place <= CASE o_orderpriority WHEN '1-URGENT' THEN 2000 WHEN '2-HIGH' THEN 1000 ELSE 0 END - busy""")
def dispatch_caps(t):
    x = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    return workqueue.claimed(x, ["o_orderdate", "o_orderkey"], F.col("status") == "running", {"1-URGENT": 2000, "2-HIGH": 1000}).select("o_orderkey", "kind")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'O' THEN 'R' ELSE o_orderstatus END AS status, o_custkey % 3 = 0 AND o_orderstatus = 'O' AS won FROM orders")
def claim_cas(t):
    x = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return workqueue.compare_and_set(x, "o_orderkey", t.orders.where("o_custkey % 3 = 0"), "O", "R").select("o_orderkey", "status", "won")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, c_custkey, n, returned, o_orderstatus, o_totalprice FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'group_disabled' WHEN n IS NULL THEN 'source_missing' WHEN o_orderstatus = 'P' THEN 'active_task' WHEN returned THEN 'already_done' END AS reason, coalesce(CASE WHEN c_custkey IS NULL OR n IS NULL OR o_orderstatus = 'P' OR returned THEN false END, true) AS target FROM x""")
def reset_plan(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    group = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("enabled"))
    x = t.orders.join(lines, "o_orderkey", "left").join(group, "o_custkey", "left")
    reason = workqueue.first_reason(("group_disabled", F.col("enabled").isNull()), ("source_missing", F.col("n").isNull()), ("active_task", F.col("o_orderstatus") == "P"), ("already_done", F.col("returned")))
    return x.select("o_orderkey", reason.alias("reason"), reason.isNull().alias("target"))


@query("SELECT s_nationkey, CAST(sum(greatest(0, CAST(floor(s_acctbal) AS BIGINT) - 3000)) AS BIGINT) AS pending, max(CAST(floor(CASE WHEN s_suppkey % 2 = 0 THEN floor(s_acctbal) * 1.5 ELSE floor(s_acctbal) END) AS BIGINT)) AS learned FROM supplier GROUP BY 1")
def pending_reservation(t):
    budget = F.floor("s_acctbal").cast("long")
    return t.supplier.groupBy("s_nationkey").agg(F.sum(F.greatest(F.lit(0), budget - 3000)).alias("pending"), F.max(workqueue.backed_off(F.floor("s_acctbal"), F.col("s_suppkey") % 2 == 0)).alias("learned"))


@query("""WITH l AS (SELECT s_suppkey AS id, s_nationkey AS device, CASE s_suppkey % 3 WHEN 0 THEN 'compression' WHEN 1 THEN 'extract' ELSE 'predict' END AS workload, CASE WHEN s_suppkey % 11 = 0 THEN 'exclusive' ELSE 'shared' END AS mode,
CASE WHEN s_suppkey % 4 = 0 THEN 'active' WHEN s_suppkey % 29 = 0 THEN 'conflict' ELSE 'waiting' END AS status, 512 + s_suppkey % 7 * 256 AS budget, s_suppkey % 5 * 200 AS observed FROM supplier),
x AS (SELECT *, coalesce(sum(CASE WHEN status = 'active' THEN greatest(0, budget - observed) END) OVER p, 0) AS pend, count(*) FILTER (status = 'active' AND mode = 'shared') OVER (PARTITION BY device, workload) AS same, count(*) FILTER (status = 'conflict') OVER p AS conflicts,
count(*) FILTER (status = 'active' AND mode <> 'shared') OVER p AS excl, coalesce(bool_or(status = 'waiting' AND mode <> 'shared') OVER a, false) AS excl_ahead, coalesce(bool_or(status = 'active' AND workload = 'compression' AND mode = 'shared') OVER p, false) AS enc_active,
first_value(CASE WHEN status = 'waiting' AND workload = 'compression' AND mode = 'shared' THEN budget END IGNORE NULLS) OVER a AS enc_ahead FROM l WINDOW p AS (PARTITION BY device), a AS (PARTITION BY device ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CAST(pend + CASE WHEN workload <> 'compression' AND NOT enc_active THEN coalesce(enc_ahead, 0) ELSE 0 END AS BIGINT) AS pending FROM x WHERE status = 'waiting')
SELECT id, device, workload, pending AS pending_mib, 4096 - pending AS usable_mib, CASE WHEN conflicts > 0 THEN 'lease_conflict' WHEN excl > 0 THEN 'exclusive_active' WHEN excl_ahead THEN 'exclusive_waiting'
WHEN same >= CASE workload WHEN 'extract' THEN 6 WHEN 'predict' THEN 2 ELSE 1 END THEN 'capacity_full' WHEN 4096 - pending < budget + 1024 THEN 'memory_insufficient' ELSE 'admitted' END AS reason FROM y""")
def admission(t):
    k = F.col("s_suppkey")
    leases = t.supplier.select(
        k.alias("id"), F.col("s_nationkey").alias("device"), F.when(k % 3 == 0, "compression").when(k % 3 == 1, "extract").otherwise("predict").alias("workload"), F.when(k % 11 == 0, "exclusive").otherwise("shared").alias("mode"),
        F.when(k % 4 == 0, "active").when(k % 29 == 0, "conflict").otherwise("waiting").alias("status"), k.alias("created"), (512 + k % 7 * 256).alias("budget_mib"), (k % 5 * 200).alias("observed_mib"),
    )
    return workqueue.admission(leases, 4096, 1024, {"extract": 6, "predict": 2, "compression": 1})


@query("""SELECT event_id, sha256('{"kind":"' || event_type || '","user":' || user_id || '}') AS dedup_key, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 THEN 'created' ELSE 'reused' END AS disposition FROM events""")
def task_dedup(t):
    from ..functions.scalars import record_digest

    e = t.events.withColumn("dedup_key", record_digest(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    first = F.min("event_id").over(Window.partitionBy("dedup_key")) == F.col("event_id")
    return e.select("event_id", "dedup_key", F.when(first, "created").otherwise("reused").alias("disposition"))


@query("""WITH w AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), h AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY 1) SELECT event_id, (SELECT max(ts) FROM events) - ts > INTERVAL 5 DAY AS expired, beat - ts > INTERVAL 2 DAY AS outlived FROM w JOIN h USING (user_id)""")
def lease_expiry(t):
    beat = t.events.groupBy("user_id").agg(F.max("ts").alias("beat"))
    now = t.events.agg(F.max("ts").alias("now"))
    x = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts").join(beat, "user_id").crossJoin(F.broadcast(now))
    return x.select("event_id", (F.col("now") - F.col("ts") > F.expr("INTERVAL 5 DAYS")).alias("expired"), (F.col("beat") - F.col("ts") > F.expr("INTERVAL 2 DAYS")).alias("outlived"))


# --- learning ------------------------------------------------------------------------------------------------------
@query("""WITH m(model_id, threshold, salt) AS (VALUES ('a', 0.3, 1), ('b', 0.6, 2)), c AS (SELECT vec_id AS asset_id, label % 3 AS k, embedding[1]::DOUBLE * 2 + 0.5 AS score FROM embeddings)
SELECT asset_id, model_id, score >= threshold AS predicted FROM c CROSS JOIN m WHERE k = 0 AND NOT (asset_id % 2 = 0 AND model_id = 'a') AND asset_id % 10 <> 1""")
def dual_predictions(t):
    spark = t.embeddings.sparkSession
    models = spark.createDataFrame([("a", "active", 0.3), ("b", "active", 0.6), ("c", "retired", 0.1)], "model_id string, status string, threshold double")
    e = t.embeddings.select(F.col("vec_id").alias("asset_id"), F.when(F.col("label") % 3 != 0, F.col("label")).alias("label"), (F.col("embedding")[0].cast("double") * 2 + 0.5).alias("score"))
    done = e.where("asset_id % 2 = 0").select("asset_id", F.lit("a").alias("model_id"))
    used = e.where("asset_id % 10 = 1").select("asset_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_id"))
    return learning.predictions(e, models, done, used).select("asset_id", "model_id", (F.col("score") >= F.col("threshold")).alias("predicted"))


@query()
def lr_train_score(t):
    """Logistic regression on embeddings (label < 5), scored on the held-out part."""
    rows = learning.holdout(t.embeddings.select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y")), "vec_id", "y")
    model = learning.fit_logistic(rows.where("NOT held_out"), "embedding", "y")
    return learning.score_logistic(model, rows.where("held_out").select("vec_id", "y", "embedding"), "embedding").select("vec_id", "y", F.round("score", 6).alias("score"))


@query()
def attention_scores(t):
    """Gated attention pooling of each label's vectors with fixed weights."""
    import numpy as np

    rng = np.random.default_rng(19)
    w = {"hidden": rng.normal(size=(64, 16)), "tanh": rng.normal(size=(16, 8)), "gate": rng.normal(size=(16, 8)), "score": rng.normal(size=8), "out": rng.normal(size=16), "bias": 0.1}
    return learning.pooled_scores(t.embeddings.select(F.col("label").cast("long").alias("bag"), F.col("embedding").alias("features")), w)


@query()
def greedy_dedup(t):
    """Sequential semantic dedup: a vector stays unless one kept before it is nearer than 0.6 (within its label)."""
    from ..functions.blocks import greedy_kept

    x = joins.normalised(t.embeddings, "embedding").where("__u IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("__u").alias("u"), "label")
    return x.groupBy("label").applyInPandas(lambda df: greedy_kept(df, 0.6), "id long, kept boolean")


# --- streaming -----------------------------------------------------------------------------------------------------
@query("SELECT user_id, count(*) AS revision, CAST(arg_max(CAST(value > 50 AS INT), event_id) AS BIGINT) AS label FROM events GROUP BY 1")
def stream_revision_fold(t):
    """The keyed fold as a stream: one micro-batch per file, state kept by key."""
    from ..streaming.folds import folded_to_table

    return folded_to_table(t.events.select("event_id", "user_id", (F.col("value") > 50).cast("long").alias("label")), t._spark)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_tumbling(t):
    """Tumbling windows with a watermark over a stream; all windows together equal the batch."""
    from ..streaming.windows import tumbled_to_table

    return tumbled_to_table(t._dir, t._spark).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
