"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

Documents with the same set of sources are alike to the mix, so they are summed into one node. From each pattern node
its tokens flow to the sources it belongs to, first use at no cost, every repetition at a higher one, until each
source's quota is full; the cheapest such flow repeats as little as the quotas allow. The flow of a pattern is then
handed to its documents: whole epochs to all, the rest to documents in a seeded order.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, local_rows, whole

MAX_REPEATS = 3
#: Patterns (distinct sets of sources) that the driver solves for; more is an error, never a silent cut.
MAX_PATTERNS = 200_000
#: Documents of one pattern that one window holds, on average.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


# --- quotas --------------------------------------------------------------------------------------------------------
def quotas(sizes: dict[str | None, int], weights: dict[str | None, float], total: float | None = None, most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Shares of the total by weight, none above ``most`` times its source's size; what is cut off goes to the others
    by weight, until none is above. Sources without words have a quota of 0."""
    total = float(sum(sizes.values())) if total is None else total
    open_, done = {s for s, n in sizes.items() if n > 0}, {s: 0.0 for s in sizes}
    left = total
    while open_:
        w = sum(weights[s] for s in open_)
        if w <= 0:
            break
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            for s in open_:
                done[s] = left * weights[s] / w
            break
        for s in over:
            done[s] = float(most * sizes[s])
        left -= sum(done[s] for s in over)
        open_ -= over
    return done


# --- flow ----------------------------------------------------------------------------------------------------------
def min_cost_flow(patterns: list[tuple[tuple, int]], quota: dict, most: int = MAX_REPEATS) -> list[float]:
    """Tokens that each pattern gives, at least cost.

    patterns: (sources, size). A pattern's k-th use (its size each time) costs k - 1, so costs are convex, on
    start -> pattern (one arc a use) -> source -> end. As a use costs the same whatever the pattern, shortest paths of
    cost 0 are exhausted first, then those of cost 1 and so on; among paths of one cost, blocking flows are found level
    by level. Parts of the graph that share no source are solved apart.
    """
    group: dict = {}

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for sources, _ in patterns:
        for s in sources[1:]:
            group[root(s)] = root(sources[0])
    parts = defaultdict(list)
    for i, (sources, size) in enumerate(patterns):
        if sources and size > 0:
            parts[root(sources[0])].append(i)
    given = [0.0] * len(patterns)
    for members in parts.values():
        for i, flow in zip(members, _Network([patterns[i] for i in members], quota).cheapest(most), strict=True):
            given[i] = flow
    return given


class _Network:
    """Residual capacities; an arc's reverse is at index ^ 1."""

    def __init__(self, patterns: list[tuple[tuple, int]], quota: dict):
        names = sorted({s for sources, _ in patterns for s in sources}, key=lambda s: (s is None, s))
        self.sizes = [float(size) for _, size in patterns]
        self.to: list[int] = []
        self.left: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(names))]
        source_node = {s: 2 + len(patterns) + k for k, s in enumerate(names)}
        self.uses = [self._arc(0, 2 + p, 0.0) for p in range(len(patterns))]
        for p, (sources, _) in enumerate(patterns):
            for s in sorted(set(sources), key=lambda s: (s is None, s)):
                self._arc(2 + p, source_node[s], float("inf"))
        for s in names:
            self._arc(source_node[s], 1, float(quota[s]))
        self.small = 1e-9 * max(1.0, sum(quota[s] for s in names))

    def _arc(self, a: int, b: int, capacity: float) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.left += (capacity, 0.0)
        return len(self.to) - 2

    def cheapest(self, most: int) -> list[float]:
        """What flows into each pattern."""
        for _ in range(most):
            for e, size in zip(self.uses, self.sizes, strict=True):
                self.left[e] += size  # the next use, at the next cost
            while (level := self._levels())[1] >= 0:
                self._block(level)
        return [self.left[e + 1] for e in self.uses]

    def _levels(self) -> list[int]:
        level, queue = [-1] * len(self.out), [0]
        level[0] = 0
        for a in queue:
            for e in self.out[a]:
                if self.left[e] > self.small and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def _block(self, level: list[int]) -> None:
        """Fills paths that go one level on with each arc, until there is none left."""
        at, path, a = [0] * len(self.out), [], 0
        while True:
            if a == 1:
                amount = min(self.left[e] for e in path)
                for k in range(len(path) - 1, -1, -1):
                    self.left[path[k]] -= amount
                    self.left[path[k] ^ 1] += amount
                    if self.left[path[k]] <= self.small:
                        keep = k
                path, a = path[:keep], self.to[path[keep] ^ 1]
                continue
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                if self.left[e] > self.small and level[self.to[e]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if not path:
                    return
                a = self.to[path.pop() ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = self.to[e]


# --- operator ------------------------------------------------------------------------------------------------------
def _sized(docs: DataFrame, member: Column | None, size: Column | None, id_col: str) -> list[Column]:
    return [
        F.col(id_col).cast("long").alias("__doc"),
        F.array_sort(F.array_distinct(F.array(F.col("source")) if member is None else member)).alias("__sources"),
        (word_count(F.col("text")) if size is None else size.cast("long")).alias("__size"),
    ]


def _solve(rows: DataFrame, weight_cycle, weights, share: float, most: int) -> DataFrame:
    """The plan by pattern: key, source_size, target, epochs (whole uses), rest (words beyond them), buckets."""
    sums = rows.groupBy("__sources").agg(F.sum("__size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    sums.sort(key=lambda r: [(s is None, s or "") for s in r["__sources"] or []])
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    patterns = [(tuple(r["__sources"] or ()), int(r["size"] or 0), int(r["n"])) for r in sums]
    sizes: dict = defaultdict(int)
    for sources, n, _ in patterns:
        for s in sources:
            sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: float((weights or {}).get(s, weight_cycle[k % len(weight_cycle)])) for k, s in enumerate(order)}
    target = quotas(sizes, weight, share * sum(p[1] for p in patterns), most)
    given = min_cost_flow([p[:2] for p in patterns], target, most)
    plan = []
    for (sources, n, count), flow in zip(patterns, given, strict=True):
        epochs = min(most, int(flow // n)) if n else 0
        rest = 0 if epochs >= most else int(round(flow - epochs * n))
        plan.append((list(sources), sum(sizes[s] for s in sources), float(sum(target[s] for s in sources)), epochs, rest, max(1, -(-count // BUCKET_ROWS))))
    kind = {"__sources": pa.list_(pa.string()), "source_size": pa.int64(), "target": pa.float64(), "epochs": pa.int32(), "rest": pa.int64(), "buckets": pa.int32()}
    return local_rows(rows.sparkSession, plan, kind).withColumn("k", _key()).drop("__sources")


def _key() -> Column:
    return F.to_json(F.struct("__sources"))


def _marked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their pattern's plan (at most MAX_PATTERNS rows, broadcast), their draw and their bucket."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), "__doc", "__size").cast("binary"))
    number = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("long")
    marked = rows.withColumn("k", _key()).join(F.broadcast(plan), "k")
    return marked.withColumn("draw", number(1)).withColumn("bucket", F.pmod(number(17), F.col("buckets")).cast("int"))


def _cuts(marked: DataFrame) -> DataFrame:
    """Where the rest runs out: by pattern, the bucket in which the running sum passes it, and the room left there."""
    below = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        marked.where("rest > 0").groupBy("k", "bucket").agg(F.sum("__size").alias("held"), F.first("rest").alias("rest"))
        .withColumn("before", F.coalesce(F.sum("held").over(below), F.lit(0)))
        .where("before < rest AND before + held >= rest")
        .groupBy("k").agg(F.min("bucket").alias("cut"), F.min_by(F.col("rest") - F.col("before"), "bucket").alias("room"))
    )
    return marked.sparkSession.createDataFrame(cuts.toArrow())  # one row a pattern


def _easy() -> Column:
    """One use more? Where the bucket alone decides it."""
    return F.when(F.col("cut").isNull(), (F.col("rest") > 0).cast("int")).otherwise((F.col("bucket") < F.col("cut")).cast("int"))


def _hard(marked: DataFrame) -> DataFrame:
    """In the cut buckets: documents in drawn order while they fit, then the one that comes nearest to what is left."""
    drawn = Window.partitionBy("k").orderBy("draw", "__doc", "__at").rowsBetween(Window.unboundedPreceding, 0)
    bucket = Window.partitionBy("k")
    off = F.abs(F.col("gap") - F.col("__size"))
    return (
        marked.where("bucket = cut")
        .withColumn("upto", F.sum("__size").over(drawn))
        .withColumn("fits", F.col("upto") <= F.col("room"))
        .withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(bucket), F.lit(0)))
        .withColumn("miss", F.when(~F.col("fits") & (off < F.col("gap")), F.struct(off.alias("d"), "draw", "__at")))
        .withColumn("extra", (F.col("fits") | F.coalesce(F.col("miss") == F.min("miss").over(bucket), F.lit(False))).cast("int"))
    )


def _copies(most: int) -> Column:
    return F.when(F.col("__size") > 0, F.least(F.col("epochs") + F.col("extra"), F.lit(most))).otherwise(0).cast("int")


def _decided(docs: DataFrame, weight_cycle, weights, share, membership, size, id_col, seed, most):
    rows = checkpoint(docs.select(*_sized(docs, membership, size, id_col)).withColumn("__at", F.monotonically_increasing_id()))
    plan = _solve(rows, weight_cycle, weights, share, most)
    marked = _marked(rows, plan, seed)
    cuts = _cuts(marked)
    return plan, cuts, marked.join(F.broadcast(cuts), "k", "left")


def mix(docs: DataFrame, weight_cycle: tuple[float, ...] = (5, 2, 1), weights: dict | None = None, share: float = 1.0, membership: Column | None = None, size: Column | None = None, id_col: str = "doc_id", seed: int = 17, most: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, sources.

    Sources, in code-point order with null last, weigh ``weight_cycle`` repeating unless ``weights`` names them;
    together they get ``share`` of all words. ``membership`` is an array of sources (default: the column ``source``
    alone); target and source_size add up over a document's sources. ``taken`` = size * copies is what the mix takes:
    whole documents, up to ``most`` copies. Null texts have size 0 and nothing to take; repeated rows are documents of
    their own; an empty table gives no rows. The same rows and seed always give the same
    mix, however they are partitioned: rows that tie are alike in id and size.

    Only sums by pattern and a cut point by pattern reach the driver. Texts are read once, to count words; a narrow
    table of (id, pattern, size) is checkpointed, and only its hash buckets at the cut points are windowed.
    """
    _, _, marked = _decided(docs, weight_cycle, weights, share, membership, size, id_col, seed, most)
    columns = ["__doc", "__size", "source_size", "target", "epochs", "extra", "__sources"]
    easy = marked.where("cut IS NULL OR bucket <> cut").withColumn("extra", _easy())
    chosen = easy.select(columns).union(_hard(marked).select(columns)).withColumn("copies", _copies(most))
    return chosen.select(F.col("__doc").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken"), "copies", F.col("__sources").alias("sources"))


def mixed_documents(docs: DataFrame, weight_cycle: tuple[float, ...] = (5, 2, 1), weights: dict | None = None, share: float = 1.0, membership: Column | None = None, size: Column | None = None, id_col: str = "doc_id", seed: int = 17, most: int = MAX_REPEATS) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, without a shuffle of texts.

    All but the cut buckets follow from the broadcast plan; what the cut buckets decided (about BUCKET_ROWS rows a
    pattern) is looked up by (id, draw). Rows alike in id and size there share one decision.
    """
    plan, cuts, marked = _decided(docs, weight_cycle, weights, share, membership, size, id_col, seed, most)
    hard = checkpoint(_hard(marked).groupBy(F.col("__doc").alias("__hdoc"), F.col("draw").alias("__hdraw")).agg(F.max("extra").alias("__hard")))
    few = hard.count() <= 1_000_000
    again = docs.select(F.struct("*").alias("__row"), *_sized(docs, membership, size, id_col))
    joined = _marked(again, plan, seed).join(F.broadcast(cuts), "k", "left")
    same = F.col("__doc").eqNullSafe(F.col("__hdoc")) & (F.col("draw") == F.col("__hdraw"))
    joined = joined.join(F.broadcast(hard) if few else hard, same, "left").withColumn(
        "extra", F.when(F.col("bucket") == F.col("cut"), F.coalesce("__hard", F.lit(0))).otherwise(_easy())
    )
    times = joined.withColumn("__copies", _copies(most)).where(F.col("__copies") > 0)
    return times.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select("__row.*")


#: mix() of documents with the query's parameters: sources of one document each, all their words shared out.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, row_number() OVER () AS nr FROM documents),
sources AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY k),
placed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
-- least room for its weight first: while a source's share passes its limit, it gets the limit
tight AS (
  SELECT *, (SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(weight) OVER (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, row_number() OVER (ORDER BY source_size / weight, k) AS place FROM placed WHERE source_size > 0),
free AS (SELECT place, left_over, open_weight FROM tight WHERE CAST(left_over * weight AS DOUBLE) / open_weight <= 3 * source_size ORDER BY place LIMIT 1),
targets AS (
  SELECT t.k, CASE WHEN f.place IS NULL OR t.place < f.place THEN CAST(3 * t.source_size AS DOUBLE) ELSE CAST(f.left_over * t.weight AS DOUBLE) / CAST(f.open_weight AS DOUBLE) END AS target FROM tight t LEFT JOIN free f ON true),
plan AS (
  SELECT k, source_size, target, epochs, CASE WHEN epochs >= 3 THEN 0 ELSE CAST(round_even(target - epochs * source_size, 0) AS BIGINT) END AS rest, greatest(1, (n + 1999) // 2000) AS buckets
  FROM (SELECT s.*, coalesce(t.target, 0.0) AS target, CASE WHEN source_size > 0 THEN least(3, CAST(floor(t.target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM sources s LEFT JOIN targets t USING (k))),
marked AS (
  SELECT d.doc_id, d.source, d.size, d.nr, p.*, CAST('0x' || substr(mark, 1, 15) AS BIGINT) AS draw, CAST('0x' || substr(mark, 17, 15) AS BIGINT) % p.buckets AS bucket
  FROM (SELECT *, md5(concat_ws(':', '17', doc_id, size)) AS mark FROM d) d JOIN plan p USING (k)),
held AS (SELECT k, bucket, any_value(rest) AS rest, sum(size) AS held FROM marked WHERE rest > 0 GROUP BY 1, 2),
running AS (SELECT *, coalesce(sum(held) OVER (PARTITION BY k ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM held),
cuts AS (SELECT k, min(bucket) AS cut, arg_min(rest - before, bucket) AS room FROM running WHERE before < rest AND before + held >= rest GROUP BY k),
drawn AS (SELECT m.*, room, sum(size) OVER (PARTITION BY k ORDER BY draw, doc_id NULLS FIRST, nr ROWS UNBOUNDED PRECEDING) AS upto FROM marked m JOIN cuts c USING (k) WHERE bucket = cut),
gaps AS (SELECT *, upto <= room AS fits, room - coalesce(max(upto) FILTER (upto <= room) OVER (PARTITION BY k), 0) AS gap FROM drawn),
ranked AS (SELECT *, NOT fits AND abs(gap - size) < gap AS near, row_number() OVER (PARTITION BY k, NOT fits AND abs(gap - size) < gap ORDER BY abs(gap - size), draw, nr) AS nth FROM gaps),
extras AS (
  SELECT doc_id, source, size, source_size, target, epochs, CASE WHEN fits OR (near AND nth = 1) THEN 1 ELSE 0 END AS extra FROM ranked
  UNION ALL SELECT doc_id, source, size, source_size, target, epochs, CASE WHEN cut IS NULL THEN CAST(rest > 0 AS INT) ELSE CAST(bucket < cut AS INT) END FROM marked LEFT JOIN cuts USING (k) WHERE cut IS NULL OR bucket <> cut)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN least(epochs + extra, 3) ELSE 0 END * size AS taken, CAST(CASE WHEN size > 0 THEN least(epochs + extra, 3) ELSE 0 END AS INT) AS copies, [source] AS sources FROM extras
"""
