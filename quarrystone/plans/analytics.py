"""Metrics, sequences, features and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, metrics, sequence
from .registry import query


def r6(c):
    return F.round(c, 6)


_CONFUSION = """count(*) AS n, count(*) FILTER (p = 1 AND a = 1) AS tp, count(*) FILTER (p = 0 AND a = 0) AS tn, count(*) FILTER (p = 1 AND a = 0) AS fp, count(*) FILTER (p = 0 AND a = 1) AS fn"""
_RATES = """SELECT *, (tp + tn) / nullif(n, 0) AS acc FROM c"""


def _rates_sql(key: str, source: str) -> str:
    return f"""WITH s AS ({source}), c AS (SELECT {key}, {_CONFUSION} FROM s GROUP BY {key}), r AS ({_RATES}),
h AS (SELECT *, (acc + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid, 1.96 * sqrt(acc * (1 - acc) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS half FROM r)
SELECT {key}, n, tp, tn, fp, fn, round(acc, 6) AS accuracy, round(greatest(0.0, mid - half), 6) AS wilson_low, round(least(1.0, mid + half), 6) AS wilson_high,
round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy, round(tp / nullif(tp + fp, 0), 6) AS like_precision, round(tp / nullif(tp + fn, 0), 6) AS like_recall,
round(tn / nullif(tn + fn, 0), 6) AS dislike_precision, round(tn / nullif(tn + fp, 0), 6) AS dislike_recall FROM h"""


def _rounded(df, *keys):
    counts = ["n", "tp", "tn", "fp", "fn"]
    return df.select(*keys, *counts, *(r6(F.col(c)).alias(c) for c in df.columns if c not in (*keys, *counts)))


def _labelled(t, key):
    j = t.labels.join(t.documents.select("doc_id", key), "doc_id")
    return j.select(key, F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))


_JUDGED = "SELECT d.{0}, quality AS a, 1 - toxic AS p FROM labels l JOIN documents d USING (doc_id)"


@query(_rates_sql("lang", _JUDGED.format("lang")))
def metrics_by_lang(t):
    """Prospective metrics: quality is the actual label, not toxic the predicted one."""
    return _rounded(metrics.with_rates(metrics.confusion(_labelled(t, "lang"), "lang")), "lang")


@query(_rates_sql("source", "SELECT s.source, a, p FROM (SELECT DISTINCT source FROM documents) s JOIN (" + _JUDGED.format("source") + ") j ON s.source = j.source").replace("FROM h", "FROM h") + """
UNION ALL SELECT source, 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id)))""")
def metrics_by_version(t):
    """Every source, those without reviewed documents with zeros."""
    got = metrics.confusion(_labelled(t, "source"), "source")
    every = t.documents.select("source").distinct().join(got, "source", "left").na.fill(0)
    return _rounded(metrics.with_rates(every), "source")


@query("SELECT lang, coalesce(tp / nullif(tp + fp, 0) >= 0.8, false) AS like_pass, coalesce(tn / nullif(tn + fn, 0) >= 0.1, false) AS dislike_pass FROM (SELECT lang, " + _CONFUSION + " FROM (" + _JUDGED.format("lang") + ") GROUP BY lang)")
def acceptance_gate(t):
    m = metrics.with_rates(metrics.confusion(_labelled(t, "lang"), "lang"))
    return m.select("lang", metrics.accepted(F.col("like_precision"), 0.8).alias("like_pass"), metrics.accepted(F.col("dislike_precision"), 0.1).alias("dislike_pass"))


def _scored(t):
    top = t.documents.agg((F.max("n_chars") + 1).alias("top"))
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").crossJoin(F.broadcast(top)).select(F.col("quality").alias("actual"), (F.col("n_chars") / F.col("top")).alias("score"))


_SCORED = "SELECT quality AS a, n_chars / (SELECT max(n_chars) + 1 FROM documents) AS score FROM labels JOIN documents USING (doc_id)"


@query(f"""WITH x AS ({_SCORED}), g AS (SELECT unnest(range(2, 19)) / 20 AS threshold), s AS (SELECT threshold, a, CAST(score >= threshold AS INT) AS p FROM x CROSS JOIN g), c AS (SELECT threshold, {_CONFUSION} FROM s GROUP BY threshold)
SELECT threshold, tp, tn, fp, fn, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy, coalesce(tp / nullif(tp + fp, 0) >= 0.8, false) AND coalesce(tn / nullif(tn + fn, 0) >= 0.1, false) AS qualified FROM c""")
def threshold_grid(t):
    g = metrics.threshold_grid(_scored(t), [i / 20 for i in range(2, 19)], 0.8, 0.1)
    return g.select("threshold", "tp", "tn", "fp", "fn", r6(F.col("balanced_accuracy")).alias("balanced_accuracy"), "qualified")


@query(f"""WITH x AS ({_SCORED}), g AS (SELECT unnest(range(2, 19)) / 20 AS threshold), s AS (SELECT threshold, a, CAST(score >= threshold AS INT) AS p FROM x CROSS JOIN g), c AS (SELECT threshold, {_CONFUSION} FROM s GROUP BY threshold)
SELECT threshold, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c ORDER BY coalesce(tp / nullif(tp + fp, 0) >= 0.8, false) AND coalesce(tn / nullif(tn + fn, 0) >= 0.1, false) DESC, balanced_accuracy DESC NULLS LAST, threshold LIMIT 1""")
def best_threshold(t):
    g = metrics.threshold_grid(_scored(t), [i / 20 for i in range(2, 19)], 0.8, 0.1).withColumn("balanced_accuracy", r6(F.col("balanced_accuracy")))
    return metrics.best_threshold(g).select("threshold", "balanced_accuracy")


@query(f"""WITH x AS ({_SCORED}), r AS (SELECT a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM x)
SELECT round((sum(r) FILTER (a = 1) - count(*) FILTER (a = 1) * (count(*) FILTER (a = 1) + 1) / 2) / (count(*) FILTER (a = 1) * count(*) FILTER (a = 0)), 6) AS auc FROM r""")
def auc_rank(t):
    return metrics.auc(_scored(t)).select(r6(F.col("auc")).alias("auc"))


# --- latest, first -------------------------------------------------------------------------------------------------
@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_user(t):
    return sequence.ranked_one(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_per_user(t):
    return sequence.ranked_one(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query(_rates_sql("event_type", """SELECT event_type, CAST(value > 50 AS INT) AS a, event_id % 2 AS p FROM (SELECT *, max(event_id // 1000) OVER (PARTITION BY user_id) AS m FROM events) WHERE event_id // 1000 = m
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""))
def latest_feedback_metrics(t):
    """Rows of each user's latest revision, the last of each (user, family), then metrics by family."""
    e = t.events.withColumn("revision", F.floor(F.col("event_id") / 1000))
    last = sequence.ranked_one(sequence.latest_of_maximum(e, "user_id", "revision"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    rows = last.select("event_type", (F.col("value") > 50).cast("int").alias("actual"), (F.col("event_id") % 2).alias("predicted"))
    return _rounded(metrics.with_rates(metrics.confusion(rows, "event_type")), "event_type")


# --- sequences -----------------------------------------------------------------------------------------------------
@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 2 THEN 'x' ELSE 'y' END AS who FROM conversations WHERE turn % 4 <> 3), l AS (SELECT *, lag(turn) OVER w AS pt, lag(who) OVER w AS pw FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN pt IS DISTINCT FROM turn - 1 THEN 'missing_predecessor' ELSE 'identity_changed' END AS reason FROM l WHERE turn > 0 AND (pt IS DISTINCT FROM turn - 1 OR who IS DISTINCT FROM pw)""")
def chain_predecessor(t):
    c = t.conversations.where("turn % 4 <> 3").select("conv_id", "turn", F.when(F.col("turn") % 5 == 2, "x").otherwise("y").alias("who"))
    return sequence.chain_errors(c, "conv_id", "turn", ["who"]).select("conv_id", "turn", "reason")


@query("""SELECT conv_id, count(*) AS n, max(turn) AS high FROM conversations WHERE turn % 5 <> 3 GROUP BY 1 HAVING count(*) <> count(DISTINCT turn) OR min(turn) <> 0 OR max(turn) - min(turn) + 1 <> count(*)""")
def gap_free(t):
    return sequence.gaps(t.conversations.where("turn % 5 <> 3"), "conv_id", "turn").select("conv_id", "n", "high")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING) AS e, l_quantity AS q FROM lineitem),
x AS (SELECT *, e - q + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS s FROM w), y AS (SELECT *, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s) AS nx FROM x) SELECT l_orderkey, s AS start, e AS stop FROM y WHERE nx IS NOT NULL AND nx <> e""")
def contiguous_windows(t):
    # the SQL leaves the order of equal starts open (DuckDB's choice varies with its threads); here the earlier end is first
    w = Window.partitionBy("l_orderkey").orderBy(*map(F.asc_nulls_last, ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])).rowsBetween(Window.unboundedPreceding, 0)
    x = t.lineitem.withColumn("stop", F.sum("l_quantity").over(w))
    x = x.withColumn("start", F.col("stop") - F.col("l_quantity") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0))
    return sequence.uncovered(x, "l_orderkey", "start", "stop").select("l_orderkey", "start", "stop")


@query("""WITH c AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM c) SELECT event_id, user_id, run, min(ts) OVER (PARTITION BY user_id, run) AS stable_since, epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id, run)) >= 3600 AS stable FROM r""")
def stability_runs(t):
    x = sequence.stable_runs(t.events, "user_id", ["ts", "event_id"], "ts", [F.col("event_type")])
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("stable_since").cast("timestamp"))) / 1e6
    return x.select("event_id", "user_id", "run", "stable_since", (age >= 3600).alias("stable"))


@query("""SELECT o_orderkey, coalesce(bool_or(o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM orders""")
def fifo_blocked(t):
    return sequence.blocked(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "blocked")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def occurrence_number(t):
    e = t.events.withColumn("name", F.concat_ws(":", "user_id", "event_type"))
    return sequence.occurrence(e, "name", ["ts", "event_id"]).select("event_id", F.col("occurrence").cast("long").alias("occurrence"))


@query("""WITH w AS (SELECT *, sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING) AS used FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(used, 2) AS used, used <= 100000 AS within FROM w""")
def running_budget(t):
    x = sequence.running_budget(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_extendedprice", 100000)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round("used", 2).alias("used"), "within")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(0, date_diff('day', o_orderdate, l_shipdate)) * 86400 AS BIGINT) AS elapsed_s, round(CASE WHEN 50 > 0 THEN least(100.0, greatest(0.0, 100.0 * l_quantity / 40)) END, 6) AS percent FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def elapsed_progress(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    e = S.elapsed(F.date_trunc("day", "o_orderdate"), F.date_trunc("day", "l_shipdate"), F.date_trunc("day", "l_shipdate"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", e.alias("elapsed_s"), r6(S.progress(F.col("l_quantity"), F.lit(40))).alias("percent"))


@query("""SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling(t):
    return t.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", "total")


# --- features ------------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, CAST(dim AS BIGINT) AS dim, round(coalesce(avg(v) FILTER (v > 0), 0), 6) AS mean, round(coalesce(stddev_pop(v) FILTER (v > 0), 0), 6) AS std, count(*) FILTER (v > 0) AS n_valid, round(avg(CAST(v > 0 AS DOUBLE)), 6) AS coverage FROM e GROUP BY ALL""")
def masked_summary(t):
    x = features.elements(t.embeddings, ["label"], "embedding", F.transform("embedding", lambda v: v > 0))
    s = features.masked_summary(x, "label")
    return s.select("label", F.col("dim").cast("long").alias("dim"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "n_valid", r6(F.col("coverage")).alias("coverage"))


@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), b AS (SELECT label, dim, avg(v) AS m, avg(v * v) AS s FROM e GROUP BY ALL), d AS (SELECT dim, avg(m) AS mean, avg(s) AS sq FROM b GROUP BY dim)
SELECT CAST(dim AS BIGINT) AS dim, round(mean, 6) AS mean, round(CASE WHEN sqrt(greatest(0, sq - mean * mean)) < 1e-6 THEN 1 ELSE sqrt(greatest(0, sq - mean * mean)) END, 6) AS scale FROM d""")
def video_weight_standardizer(t):
    x = features.standardizer(features.elements(t.embeddings, ["label"], "embedding"), "label")
    return x.select(F.col("dim").cast("long").alias("dim"), r6(F.col("mean")).alias("mean"), r6(F.col("scale")).alias("scale"))


@query("""WITH a AS (SELECT label, vec_id, embedding[1]::DOUBLE * 10 AS a FROM embeddings), w AS (SELECT label, vec_id, exp(a - max(a) OVER (PARTITION BY label)) AS w FROM a), e AS (SELECT label, vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT e.label, CAST(dim AS BIGINT) AS dim, round(sum(w * v) / sum(w), 6) AS pooled FROM e JOIN w USING (label, vec_id) GROUP BY ALL""")
def softmax_pool(t):
    x = features.elements(t.embeddings, ["label", "vec_id"], "embedding")
    a = t.embeddings.select("label", "vec_id", (F.col("embedding")[0].cast("double") * 10).alias("a"))
    return features.softmax_pool(x, "label", a, "vec_id").select("label", F.col("dim").cast("long").alias("dim"), r6(F.col("pooled")).alias("pooled"))


@query("""SELECT vec_id, round(1 / (1 + exp(-greatest(-700, least(700, list_sum(list_transform(embedding, lambda x, i: (x::DOUBLE - 0.01) / 0.1 * (i / 64.0 - 0.5))) + 0.25)))), 6) AS score FROM embeddings""")
def logistic_score(t):
    const = lambda f: F.transform(F.sequence(F.lit(1), F.lit(64)), f)
    s = S.logistic(F.transform("embedding", lambda x: x.cast("double")), const(lambda _: F.lit(0.01)), const(lambda _: F.lit(0.1)), const(lambda i: i / 64.0 - 0.5), 0.25)
    return t.embeddings.select("vec_id", r6(s).alias("score"))


@query("""SELECT o_orderkey, CAST(ceil(o_totalprice / 1000 / 10) AS BIGINT) AS windows, round(o_totalprice / 1000, 6) AS last_end FROM orders WHERE o_totalprice > 0""")
def aligned_windows(t):
    w = S.aligned_windows(F.col("o_totalprice") / 1000)
    return t.orders.where("o_totalprice > 0").select("o_orderkey", F.size(w).cast("long").alias("windows"), r6(F.element_at(w, -1)["end_s"]).alias("last_end"))


# --- scalars -------------------------------------------------------------------------------------------------------
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(coalesce(nullif(CAST(floor(l_tax * 100) AS BIGINT), 0), nullif(CAST(floor(l_discount * 1000) AS BIGINT), 0), CAST(floor(l_extendedprice * 8 / l_quantity) AS BIGINT)) AS BIGINT) AS rate FROM lineitem""")
def bitrate_fallback(t):
    f = lambda c: F.floor(c).cast("long")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.or_else(f(F.col("l_tax") * 100), f(F.col("l_discount") * 1000), f(F.col("l_extendedprice") * 8 / F.col("l_quantity"))).alias("rate"))


@query("""WITH d AS (SELECT p_partkey, p_size * 97 AS w, CAST(floor(p_retailprice) AS BIGINT) + 200 AS h FROM part), s AS (SELECT *, least(1.0, CASE WHEN h > w THEN 1080 ELSE 1920 END / w, CASE WHEN h > w THEN 1920 ELSE 1080 END / h) AS k FROM d)
SELECT p_partkey, CAST(greatest(2, floor(floor(w * k) / 2) * 2) AS BIGINT) AS width, CAST(greatest(2, floor(floor(h * k) / 2) * 2) AS BIGINT) AS height FROM s""")
def even_dims(t):
    w, h = S.target_size(F.col("p_size") * 97, F.floor("p_retailprice").cast("long") + 200)
    return t.part.select("p_partkey", w.alias("width"), h.alias("height"))


@query("""SELECT p_partkey, p_retailprice * 5000 > 5000000 AS transcode, array_to_string(list_filter([CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2') THEN 'codec' END, CASE WHEN p_retailprice * 5000 > 5500000 THEN 'rate_high' END, CASE WHEN p_size > 30.01 THEN 'fps_high' END], lambda x: x IS NOT NULL), ',') AS errors FROM part""")
def decision_rows(t):
    codec = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "hevc").otherwise("h264")
    errors = S.transcode_errors(codec, F.col("p_retailprice") * 5000, F.lit(1280), F.lit(720), F.col("p_size").cast("double"))
    return t.part.select("p_partkey", S.needs_transcode(F.col("p_retailprice") * 5000).alias("transcode"), F.array_join(errors, ",").alias("errors"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, '/[^/]*$', '') AS parent FROM pages""")
def url_parts(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"), S.basename(F.col("url")).alias("base"), S.parent(F.col("url")).alias("parent"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(replace(url, '\\', '/') || '?x:' || page_id, '([^/]*)$', 1), '[<>:"/\\|?*\\x00-\\x1f]', '_', 'g'), '[ .]+$', '') AS name FROM pages""".replace("\\\\", "\\"))
def sanitize_name(t):
    return t.pages.select("page_id", S.safe_name(F.concat("url", F.lit("?x:"), F.col("page_id").cast("string"))).alias("name"))


@query("""SELECT p_partkey, regexp_replace(p_name || CASE p_size % 4 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.ZIP' WHEN 2 THEN '.txt' ELSE '' END, '(?i)(\\.tar\\.gz|\\.tar\\.bz2|\\.tar\\.xz|\\.tgz|\\.tbz2|\\.txz|\\.zip|\\.rar|\\.7z|\\.tar)$', '') AS stem FROM part""")
def suffix_strip(t):
    ext = F.when(F.col("p_size") % 4 == 0, ".tar.gz").when(F.col("p_size") % 4 == 1, ".ZIP").when(F.col("p_size") % 4 == 2, ".txt").otherwise("")
    return t.part.select("p_partkey", S.archive_stem(F.concat("p_name", ext)).alias("stem"))


@query("""SELECT c_custkey, 'Bearer [REDACTED] and password=[REDACTED] at https://[REDACTED]@host/' || c_custkey AS line FROM customer""")
def redact(t):
    line = F.concat(F.lit("Bearer abc.DEF-"), "c_custkey", F.lit(" and password: "), "c_name", F.lit(" at https://u:p"), "c_custkey", F.lit("@host/"), "c_custkey")
    return t.customer.select("c_custkey", S.redact(F.regexp_replace(line, r"Customer#", "C")).alias("line"))


@query("SELECT doc_id, sha256(text) AS digest, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS valid, split_part(source || ':' || lang, ':', 2) AS owner FROM documents")
def digests(t):
    d = S.digest(F.col("text"))
    return t.documents.select("doc_id", d.alias("digest"), S.is_sha256(d).alias("valid"), S.owner_id(F.concat_ws(":", "source", "lang")).alias("owner"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 3600 * 1.0 WHEN event_id % 3 = 1 THEN 3661.5 END AS seconds, try_cast(CASE event_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '12' ELSE 'x1' END AS BIGINT) AS number,
CASE event_id % 3 WHEN 0 THEN round(30000 / 1001, 6) WHEN 1 THEN NULL ELSE 25.0 END AS rate FROM events""")
def lenient_numbers(t):
    i = F.col("event_id")
    clock = F.when(i % 3 == 0, F.format_string("00:%02d:%02d", F.floor(i % 3600 / 60), i % 60)).when(i % 3 == 1, "01:01:01.5").otherwise("bad")
    number = F.when(i % 4 == 0, "N/A").when(i % 4 == 1, "").when(i % 4 == 2, "12").otherwise("x1")
    rate = F.when(i % 3 == 0, "30000/1001").when(i % 3 == 1, "30/0").otherwise("25")
    return t.events.select("event_id", S.clock_seconds(clock).alias("seconds"), S.lenient(number, "long").alias("number"), r6(S.fraction(rate)).alias("rate"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'passthrough' WHEN p_retailprice * 3000 <= 3145728 THEN 'copy' WHEN p_size % 7 = 0 THEN 'unsupported' ELSE 'reencode' END AS action,
CAST(CASE WHEN p_size * 1000 * p_size * 500 <= 100000000 THEN p_size * 1000 ELSE greatest(1, floor(p_size * 1000 * sqrt(100000000 / (p_size * 1000 * p_size * 500)))) END AS BIGINT) AS edge FROM part""")
def image_actions(t):
    size = F.col("p_size")
    fmt = F.when(size % 5 == 0, "svg").otherwise("png")
    return t.part.select("p_partkey", S.image_action(fmt, F.col("p_retailprice") * 3000, size % 7 == 0).alias("action"), S.working_edge(size * 1000, size * 500).alias("edge"))


@query("""SELECT c_custkey, list_aggregate(list_sort(list_distinct(string_split(c_name, '#'))), 'string_agg', '|') AS parts, list_contains(string_split(c_mktsegment, 'I'), 'BU') AS has, array_to_string(string_split('a,b,c,d,e', ',')[2:3], '') AS slice FROM customer""")
def array_helpers(t):
    return t.customer.select("c_custkey", F.array_join(F.array_sort(F.array_distinct(F.split("c_name", "#"))), "|").alias("parts"), F.array_contains(F.split("c_mktsegment", "I"), "BU").alias("has"), F.array_join(F.slice(F.split(F.lit("a,b,c,d,e"), ","), 2, 2), "").alias("slice"))
