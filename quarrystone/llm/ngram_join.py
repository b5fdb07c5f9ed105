"""N-gram Jaccard join of a corpus with itself, by prefix trees over blocks of candidates.

1. One pass over the texts: each task builds n-gram sets and signatures (trie_join.Signatures), settles equal sets and
   repeated signatures among its own rows, and deals what remains, as packed arrays by ranges of the signature.
2. Each range finds its repeated signatures: candidate edges from the first holder, and exact edges between equal sets
   (by a 128-bit hash). Nothing is emitted for pairs within a group, only edges to its first member, and the edges
   that a document has in several ranges meet in one task, where those that join nothing new go.
3. Components of the edges are blocks: linked sets share a signature, so they are in one block. The sets of a block go
   through one prefix tree, which gives verified links that join all its components. In components of more n-grams
   than one tree may hold, documents with equal minimum hashes meet first.
4. Where this leaves a component in several parts, a document can only be linked with another part if other parts hold
   enough of its n-grams. Of those that remain, documents of different parts that share a signature can still be
   linked: components of these are blocks again. Only one that is still too large is dealt chunk by chunk against what
   lies outside its largest part, or signature by signature, whichever deals less.
5. Components of the verified links are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, checkpoint, connected_components, one_by_one, parted_by, partitions, release_shuffles, stars, tidy, whole

SIGNED, EQUAL, SIZES, LINKED, NEAR = range(5)
FLUSH = 1 << 18
#: N-grams of a block that one prefix tree holds (one document may have more), and documents that all chunks share.
BLOCK_GRAMS = 1 << 17
ANCHORS = 16
#: Minimum hashes by which documents of components too large for one tree meet first.
ALIKE = 4
#: Documents looked at for common n-grams at least, and of how many one is at least: what 50 of a larger corpus hold is
#: common as well, or unrelated documents would grow together into components ever larger. How many of those n-grams
#: are broadcast (8 bytes each).
SAMPLE, EVERY, MOST_COMMON = 4_000, 16, 300_000
#: Documents in blocks up to which (block, id), 16 bytes each, is broadcast to fetch texts; beyond, the texts sought are
#: dealt by id. Masks of ids (16 bytes each) that tell which are sought, or go.
BROADCAST_IDS = 250_000
#: N-grams from which on shuffles leave the disk as soon as what was made of them is checkpointed.
RELEASE_GRAMS = 1 << 24


def _packed(bucket: int, kind: int, a: np.ndarray, b: np.ndarray):
    return bucket, kind, a.tobytes(), b.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["bucket", "kind", "a", "b"])


def _sliced(key: np.ndarray, order: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Positions by bucket; key is sorted by order, and buckets are equal ranges of it."""
    if not len(order):
        return []
    bucket = ((key[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return [(int(bucket[a]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]


def common_hashes(texts: DataFrame, n: int, sample: int = SAMPLE, most: int = MOST_COMMON) -> np.ndarray:
    """Hashes of n-grams that at least three documents of a sample hold (about ``sample`` documents of at most 20,000
    characters, by a hash of their id, or one of EVERY if these are more), the most frequent ``most`` of them, sorted.
    They steer which signatures are made, never which links are found."""
    share = max(1, min(texts.count() // sample, EVERY))
    rows = texts.where((F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0) & (F.length("text") <= 20_000)).select("text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = ngrams_of(n)
        for batch in batches:
            for text in one_by_one(batch.column("text")):
                h = grams.of(text)
                if len(h):
                    yield pa.record_batch([pa.array(h.view(np.int64), pa.int64())], ["h"])

    counted = rows.mapInArrow(tidy(hashes), "h long").groupBy("h").count().where("count >= 3")
    held = counted.orderBy(F.col("count").desc(), "h").limit(most).select("h").toArrow()["h"]
    return np.sort(held.to_numpy().astype(np.int64).view(np.uint64))


def ngrams_of(n: int):
    from .trie_join import ngrams

    return ngrams(n)


def _sign(n: int, percent: int, buckets: int, common):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        from .trie_join import NGrams, Signatures

        grams, signatures, home = NGrams(n), Signatures(percent, common.value), TaskContext.get().partitionId() % buckets
        first: dict[bytes, int] = {}
        ids, sizes, nulls, held, holders, amount = [], [], [], [], [], 0
        equal, equal_ids, links = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal amount
            rows = [_packed(home, SIZES, np.array(ids, np.int64), np.array(sizes, np.int64))] if ids else []
            if nulls:
                rows.append(_packed(home, SIZES, np.zeros(0, np.int64), np.array(nulls, np.int64)))
            if links:
                x = np.array(links, np.int64)
                rows.append(_packed(home, LINKED, x[:, 0], x[:, 1]))
            if equal:
                x = np.frombuffer(b"".join(equal), "<u8").reshape(-1, 2)
                y = np.array(equal_ids, np.int64)
                order = np.argsort(x[:, 0], kind="stable")
                rows += [_packed(b, EQUAL, x[k], y[k]) for b, k in _sliced(x[:, 0], order, buckets)]
            if held:
                x, y = np.concatenate(held), np.repeat(np.array([h for h, _ in holders], np.int64), [c for _, c in holders])
                order = np.argsort(x, kind="stable")
                fresh = np.concatenate([[True], x[order][1:] != x[order][:-1]])[: len(x)]
                lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
                near = np.unique(np.column_stack([y[lead][~fresh], y[order][~fresh]]), axis=0)
                if len(near):
                    rows.append(_packed(home, NEAR, near[:, 0], near[:, 1]))
                rows += [_packed(b, SIGNED, x[k], y[k]) for b, k in _sliced(x, order[fresh], buckets)]
            for group in (ids, sizes, nulls, held, holders, equal, equal_ids, links):
                group.clear()
            amount = 0
            for i in range(0, len(rows), 512):
                yield _batch(rows[i : i + 512])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), one_by_one(batch.column("text")), strict=True):
                h = grams.of(text)
                if i is None:
                    nulls.append(len(h))
                    continue
                ids.append(i)
                sizes.append(len(h))
                if len(h):
                    digest = xxhash.xxh3_128_digest(h.tobytes())
                    other = first.setdefault(digest, i)
                    if other != i:
                        links.append((other, i))
                    else:
                        equal.append(digest)
                        equal_ids.append(i)
                        s = signatures.of(h)
                        held.append(s)
                        holders.append((i, len(s)))
                        amount += len(s)
                if amount >= FLUSH or len(ids) >= FLUSH or len(first) >= FLUSH:
                    yield from flush()
                    if len(first) >= FLUSH:
                        first.clear()
        yield from flush()

    return sign


def _match(buckets: int):
    """All rows of some ranges of signatures -> (bucket, kind, a, b), packed: sizes, exact links, candidate edges (these,
    with the exact links among them, as stars, dealt by the node that isn't the star's least)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .trie_join import mixed

        home = TaskContext.get().partitionId() % buckets
        held: dict[int, list] = {k: [] for k in range(5)}
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for kind, a, b in zip(batch.column("kind"), batch.column("a"), batch.column("b"), strict=True):
                kind = kind.as_py()
                if kind in (SIZES, LINKED):
                    yield _batch([(home, kind, a.as_py(), b.as_py())])
                if kind != SIZES:
                    held[kind].append((np.frombuffer(a.as_py(), "<u8" if kind in (SIGNED, EQUAL) else "<i8"), np.frombuffer(b.as_py(), "<i8")))

        def edges(order, same, ids):
            lead = order[np.flatnonzero(~same)[np.cumsum(~same) - 1]]
            x = np.column_stack([ids[lead][same], ids[order][same]])
            return np.unique(x[x[:, 0] != x[:, 1]], axis=0)

        near += held[LINKED] + held[NEAR]
        if held[EQUAL]:
            x, y = np.concatenate([a for a, _ in held[EQUAL]]).reshape(-1, 2), np.concatenate([b for _, b in held[EQUAL]])
            order = np.lexsort((y, x[:, 1], x[:, 0]))
            same = np.concatenate([[False], (x[order][1:] == x[order][:-1]).all(axis=1)])
            e = edges(order, same, y)
            if len(e):
                yield _batch([_packed(home, LINKED, e[:, 0], e[:, 1])])
            near.append((e[:, 0], e[:, 1]))
        if held[SIGNED]:
            x, y = np.concatenate([a for a, _ in held[SIGNED]]), np.concatenate([b for _, b in held[SIGNED]])
            held.clear()
            order = np.argsort(x, kind="stable")
            same = np.concatenate([[False], x[order][1:] == x[order][:-1]])[: len(x)]
            e = edges(order, same, y)
            near.append((e[:, 0], e[:, 1]))
        if near:
            a, b = stars(*(np.concatenate(x) for x in zip(*near, strict=True)))
            key = mixed(a.view(np.uint64))
            for k, at in _sliced(key, np.argsort(key, kind="stable"), buckets):
                yield _batch([_packed(k, NEAR, a[at], b[at])])

    return match


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _match packed -> (kind, a, b), a row each. A document with signatures in many ranges has a candidate edge
    from each: they meet here and are one star again, so edges don't grow with the number of ranges."""
    near: list[tuple[np.ndarray, np.ndarray]] = []

    def out(kind, a, b):
        for i in range(0, len(b), 50_000):
            yield pa.record_batch([pa.array(np.full(len(b[i : i + 50_000]), kind, np.int32)), pa.array(a[i : i + 50_000], pa.int64()), pa.array(b[i : i + 50_000], pa.int64())], ["kind", "a", "b"])

    for batch in batches:
        for kind, a, b in zip(batch.column("kind"), batch.column("a"), batch.column("b"), strict=True):
            kind, a, b = kind.as_py(), np.frombuffer(a.as_py(), "<i8"), np.frombuffer(b.as_py(), "<i8")
            if kind == NEAR:
                near.append((a, b))
            else:
                yield from out(kind, a if len(a) else pa.nulls(len(b), pa.int64()), b)
    if near:
        yield from out(NEAR, *stars(*(np.concatenate(x) for x in zip(*near, strict=True))))


def _trees(n: int, percent: int):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block -> verified links that join each block's components."""
        from .trie_join import NGrams, linked_forest

        grams, block, ids, sets, out = NGrams(n), None, [], [], []

        def close():
            if len(ids) > 1:
                out.extend((ids[a], ids[b]) for a, b in linked_forest(sets, percent) if ids[a] != ids[b])
            ids.clear()
            sets.clear()

        for batch in batches:
            for key, i, text in zip(batch.column("block").to_pylist(), batch.column("doc_id").to_pylist(), one_by_one(batch.column("text")), strict=True):
                if key != block:
                    close()
                    block = key
                ids.append(i)
                sets.append(grams.of(text))
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return trees


def _texts_of(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with their texts; few rows are broadcast, so that texts stay where they lie. Else no text is dealt but those
    of the rows."""
    if rows.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(rows), "doc_id")
    return parted_by(texts, F.col("doc_id"), rows.select("doc_id").distinct(), BROADCAST_IDS)[0].join(rows, "doc_id")


def _spread(batches: Iterator[pa.RecordBatch], numbers_of, name: str) -> Iterator[pa.RecordBatch]:
    """A row for each number of each text: the number, doc_id, part, n. A few texts at a time."""
    columns = ("doc_id", "part", "n")
    for whole_batch in batches:
        texts, start, made, amount = whole_batch.column("text"), 0, [], 0
        for i in range(len(texts)):
            made.append(numbers_of(texts[i].as_py()))
            amount += len(made[-1])
            if amount >= FLUSH // 4 or i + 1 == len(texts):
                rows = pa.array(np.repeat(np.arange(start, i + 1), [len(x) for x in made]))
                yield pa.record_batch([pa.array(np.concatenate(made).view(np.int64), pa.int64()), *(whole_batch.column(c).take(rows) for c in columns)], [name, *columns])
                start, made, amount = i + 1, [], 0


def _all_grams(n: int):
    """(doc_id, text, part, n) -> (h, doc_id, part, n): all n-grams of a text in one array."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = ngrams_of(n)
        for batch in batches:
            for i, text in enumerate(one_by_one(batch.column("text"))):
                h = grams.of(text).view(np.int64)
                row = batch.slice(i, 1)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), pa.array(h, pa.int64())), *(row.column(c) for c in ("doc_id", "part", "n"))], ["h", "doc_id", "part", "n"])

    return spread


def _minima(n: int):
    """(doc_id, text, part, n) -> (sig, doc_id, part, n): the least n-gram hash in each of ALIKE orders."""

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .trie_join import M1, mixed

        grams, salts = ngrams_of(n), [np.uint64((2 * j + 1) * int(M1) & 0xFFFFFFFFFFFFFFFF) for j in range(ALIKE)]

        def least(text: str) -> np.ndarray:
            h = grams.of(text)
            return mixed(np.array([mixed(h ^ s).min() ^ s for s in salts], np.uint64)) if len(h) else np.zeros(0, np.uint64)

        yield from _spread(batches, least, "sig")

    return minima


def _sign_again(n: int, percent: int, common):
    """(doc_id, text, part, n) -> (sig, doc_id, part, n): all signatures, as in the first pass."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .trie_join import NGrams, Signatures

        grams, signatures = NGrams(n), Signatures(percent, common.value)
        yield from _spread(batches, lambda t: np.unique(signatures.of(grams.of(t))), "sig")

    return sign


def _verify(texts: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """members (block, doc_id) -> verified links (a, b). Blocks are named by hashes: two that met would only be searched
    together."""
    got = _texts_of(texts, members).select("block", "doc_id", "text")
    dealt = got.repartition(partitions(texts.sparkSession), "block").sortWithinPartitions("block", "doc_id")
    return dealt.mapInArrow(tidy(_trees(n, percent)), "a long, b long")


def _alike(texts: DataFrame, inside: DataFrame, n: int, limit: int) -> DataFrame:
    """inside (doc_id, part, n) of components too large for one tree -> (block, doc_id): documents with the same minimum
    hash, of ALIKE kinds, meet, so that nearly all that are linked do. Blocks that are still too large are cut into
    chunks, all with the same few anchors, so that what is linked to them comes together."""
    marked = checkpoint(_texts_of(texts, inside).select("doc_id", "text", "part", "n").mapInArrow(tidy(_minima(n)), "sig long, doc_id long, part long, n long"))
    sizes = marked.groupBy("sig").agg(F.count("*").alias("docs"), F.sum("n").alias("weight")).where("docs > 1")
    chunks = F.ceil(F.col("weight") / limit).cast("int")
    # anchors are short, so that they take at most half of a chunk
    anchor = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("docs") / ANCHORS)) == 0) & (F.col("n") <= limit // (2 * ANCHORS))
    chunk = F.pmod(F.xxhash64("doc_id"), chunks).cast("int")
    spread = by_key(marked, checkpoint(sizes), "sig", "docs").withColumn("chunk", F.explode(F.when(anchor, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(chunk))))
    return spread.select(F.xxhash64("sig", "chunk").alias("block"), "doc_id").distinct()


def _across(members: DataFrame, limit: int) -> DataFrame:
    """(sig, doc_id, part, n, weight) of signatures (or components) with too many n-grams -> (block, doc_id): every
    document outside the largest part meets every other document of the signature."""
    largest = members.groupBy("sig", "part").agg(F.sum("n").alias("held")).groupBy("sig").agg(F.max_by("part", F.struct("held", "part")).alias("main"), (F.sum("held") - F.max("held")).alias("rest"))
    chunks, groups = F.ceil(F.col("weight") / limit).cast("int"), F.ceil(F.col("rest") / limit).cast("int")
    every = members.join(largest, "sig").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks).cast("int")).withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(2)), groups).cast("int"))
    met = every.withColumn("g", F.explode(F.sequence(F.lit(0), groups - 1))).select("sig", "chunk", "g", "doc_id")
    outside = every.where("part <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("sig", "chunk", "g", "doc_id")
    return met.union(outside).select(F.xxhash64("sig", "chunk", "g").alias("block"), "doc_id").distinct()


def _linkable(texts: DataFrame, parts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of parts (doc_id, part, n), the documents that can be linked with another part at all: linked sets share at least
    percent of the n-grams of each, so as many of a document's n-grams must be held by other parts. What unrelated
    documents have in common (lines, passages) is mostly less."""
    # an array a document takes 8 bytes an n-gram on disk, a row an n-gram would take 44
    packed = checkpoint(_texts_of(texts, parts).select("doc_id", "text", "part", "n").mapInArrow(tidy(_all_grams(n)), "h array<long>, doc_id long, part long, n long"))
    held = packed.withColumn("h", F.explode("h"))
    shared = held.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("docs")).where("low <> high")
    counted = by_key(held, checkpoint(shared.select("h", "docs")), "h", "docs").groupBy("doc_id", "part", "n").count()
    return checkpoint(counted.where(F.col("count") * 100 >= F.col("n") * percent).select("doc_id", "part", "n"))


def _between_parts(texts: DataFrame, parts: DataFrame, n: int, percent: int, common, limit: int) -> DataFrame:
    """parts (doc_id, part, n) -> (block, doc_id) in which documents of different parts that share a signature meet.

    Components of the shared signatures are blocks. One that is too large is dealt as a whole, chunk by chunk, or
    signature by signature, whichever deals fewer n-grams.
    """
    signed = checkpoint(_texts_of(texts, parts).select("doc_id", "text", "part", "n").mapInArrow(tidy(_sign_again(n, percent, common)), "sig long, doc_id long, part long, n long"))
    mixed = signed.groupBy("sig").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.sum("n").alias("weight"), F.count("*").alias("docs"), F.bit_xor(F.xxhash64("doc_id")).alias("same"), F.min("doc_id").alias("lead")
    ).where("low <> high")
    # signatures with the same holders are one block
    once = checkpoint(mixed.groupBy("docs", "weight", "same").agg(F.min("sig").alias("sig"), F.first("lead").alias("lead")))
    members = checkpoint(by_key(signed, once.select("sig", "docs", "weight", "lead"), "sig", "docs"))
    joined = checkpoint(connected_components(members.select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))))
    placed = checkpoint(members.select("doc_id", "part", "n").distinct().join(joined.withColumnRenamed("node", "doc_id"), "doc_id"))
    by_signature = once.join(joined.withColumnRenamed("node", "lead"), "lead").groupBy("component").agg(F.sum("weight").alias("dealt"))
    held = placed.groupBy("component", "part").agg(F.sum("n").alias("held")).groupBy("component").agg(F.sum("held").alias("weight"), (F.sum("held") - F.max("held")).alias("rest"))
    whole_deal = F.col("weight") * F.ceil(F.col("rest") / limit) + F.col("rest") * F.ceil(F.col("weight") / limit)
    how = F.when(F.col("weight") <= limit, 0).when(whole_deal <= F.col("dealt"), 1).otherwise(2)
    chosen = checkpoint(held.join(by_signature, "component").select("component", "weight", how.alias("how")))
    together = checkpoint(placed.join(chosen, "component"))
    small = together.where("how = 0").select(F.xxhash64("component", F.lit(0)).alias("block"), "doc_id")
    dealt = _across(together.where("how = 1").select(F.col("component").alias("sig"), "doc_id", "part", "n", "weight"), limit)
    apart = members.join(together.where("how = 2").select("doc_id"), "doc_id", "left_semi")
    alone = apart.where(F.col("weight") <= limit).select(F.col("sig").alias("block"), "doc_id")
    return checkpoint(small.union(dealt).union(alone).union(_across(apart.where(F.col("weight") > limit), limit)))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of word n-grams (trie_join
    .NGrams); component_id is the smallest id that links reach. Null and empty texts have the empty set and no links.
    Rows that repeat an id are one document to links; a null id has no links and component_id null. Exact: no link
    between different texts is lost, however large a group.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    parts = partitions(spark)
    common = spark.sparkContext.broadcast(common_hashes(texts, n))
    dealt = texts.mapInArrow(tidy(_sign(n, percent, 4 * parts, common)), "bucket int, kind int, a binary, b binary").repartition(parts, "bucket")
    matched = dealt.mapInArrow(tidy(_match(parts)), "bucket int, kind int, a binary, b binary").repartition(parts, "bucket")
    found = checkpoint(matched.mapInArrow(tidy(_meet), "kind int, a long, b long"))
    del dealt, matched
    exact = found.where(F.col("kind") == LINKED).select("a", "b")
    own = found.where(F.col("kind") == SIZES).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    # of equal sets, only the first goes on
    blocks = connected_components(found.where(F.col("kind") == NEAR).select("a", "b")).join(exact.select(F.col("b").alias("node")).distinct(), "node", "left_anti").withColumnRenamed("node", "doc_id")
    blocks = checkpoint(blocks.join(own.groupBy("doc_id").agg(F.sum("n_shingles").alias("n")), "doc_id"))
    sizes = blocks.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("weight")).where("docs > 1")
    sized = checkpoint(blocks.join(sizes, "component"))
    heavy = (own.agg(F.sum("n_shingles")).first()[0] or 0) >= RELEASE_GRAMS
    if heavy:
        release_shuffles(spark)  # all signatures: more bytes than the texts
    inside = sized.where(F.col("weight") > block_grams).select("doc_id", F.col("component").alias("part"), "n")
    large = not inside.isEmpty()
    members = sized.where(F.col("weight") <= block_grams).select(F.xxhash64("component").alias("block"), "doc_id")
    if large:
        members = members.union(_alike(texts, inside, n, block_grams))
    links = checkpoint(_verify(texts, checkpoint(members), n, percent))
    if heavy:
        release_shuffles(spark)  # the texts of all blocks
    if large:
        so_far = checkpoint(connected_components(links))
        now = inside.withColumnRenamed("part", "component").join(so_far.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left")
        now = checkpoint(now.select("component", "doc_id", F.coalesce("part", "doc_id").alias("part"), "n"))
        several = now.groupBy("component").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("component")
        apart = _linkable(texts, checkpoint(now.join(several, "component").select("doc_id", "part", "n").distinct()), n, percent)
        links = so_far.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if not apart.isEmpty():
            links = links.union(checkpoint(_verify(texts, _between_parts(texts, apart, n, percent, common, block_grams), n, percent)))
    reached = connected_components(links.union(exact))
    return own.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, components: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the rows whose component is their own id. Of rows that repeat such an id, the one
    with the least text stays (null counts as empty). Rows with a null id are not linked with anything and all stay."""
    components = checkpoint(components.where("doc_id IS NOT NULL"))
    own = F.col(id_col).cast("long")
    gone = components.where("component_id <> doc_id").select("doc_id").distinct()
    kept = parted_by(docs, own, gone, BROADCAST_IDS)[1]
    again = components.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    several, others = parted_by(kept, own, checkpoint(again), BROADCAST_IDS)
    first = several.groupBy(own.alias("__id")).agg(F.min_by(F.struct(*docs.columns), F.struct(whole(F.col(text_col)), F.xxhash64(*docs.columns))).alias("__row"))
    return others.union(first.select("__row.*"))


#: ngram_components() of documents for n = 4 and 85 percent.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS held FROM w),
g AS (SELECT doc_id, len(held) AS n, unnest(held) AS shingle FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS n, any_value(y.n) AS m FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (n + m - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(held) AS BIGINT) AS n_shingles, component_id FROM s JOIN least USING (doc_id)
"""
