"""Problem 3: the k most similar vectors for every vector, by an adaptive dimension scan over an inverted file.

Vectors are normalised, turned by one random rotation and grouped into lists around centroids. A query scans the members of
its ``probes`` nearest lists in blocks of columns. After ``d`` of ``D`` columns the partial distance of rotated vectors
estimates the whole one; a candidate is abandoned when the hypothesis that it can still beat the threshold is rejected, that
is when ``sqrt(D / d) * partial > (1 + epsilon / sqrt(d)) * threshold``. Survivors are computed exactly in double precision.
The threshold is the distance that belongs to ``min_similarity`` or the k-th best found so far, whichever is nearer.

Accuracy loss comes from the lists not probed and from the test (``epsilon``); recall against brute force is measured in the
tests and by ``p3_recall``.

Scale: every row is indexed. The number of lists follows the number of rows up to ``MAX_LISTS`` (33.5 million rows; their centroids,
65,536 x 64 floats or 16 MB, are broadcast); beyond it lists grow with the rows (1e9 rows: 15,000 for each list). Lists are fitted
in two levels in Spark on a sample of 32 vectors a list (at most 2.1 million). Every vector is compared with all centroids. Vectors
travel once per probed list, in half precision where that is exact; queries travel under a number instead of their id, in as many
partitions as their bytes ask for. Lists that the sample shows to be larger than ``block`` are cut into
member and query blocks by hash, so no group outgrows a task. Of exact copies only the ``k + 1`` smallest ids can be among
anyone's k nearest (ties go to the smaller id), so only these enter the lists, limited before the shuffle; all ids get results.

Defined cases: of rows repeated under one id the latest counts; an embedding is usable when it has ``dimensions`` finite
elements that are not all zero; unusable ones and null ids have no row; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.store import latest_of_repeated
from ..runtime import broadcast_if_small, checkpointed

#: Production parameters.
DIMENSIONS, K, EPSILON, COLUMNS = 64, 10, 2.1, 16
LIST_SIZE, MAX_LISTS, PER_LIST, TOP_SAMPLE, BLOCK = 512, 65_536, 32, 40_000, 16_384
PROBES, SEARCH_PROBES, TASK_BYTES = 6, 64, 8 * 1024 * 1024


def latest_rows(rows: DataFrame, key: str = "id", order: str = "created_at", value: str = "embedding") -> DataFrame:
    """``key`` and ``value``, of repeated keys the latest row; only repeated keys are shuffled with their values."""
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(order).alias("at"), F.col(value).alias("value"))
    return latest_of_repeated(plain, ["id"], ["at", "value"]).select("id", "value")


def pack(vectors: np.ndarray) -> list[bytes]:
    """Each vector as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = vectors.astype(np.float16)
    exact = (half.astype(np.float32) == vectors).all(axis=1)
    return [h.tobytes() if e else v.tobytes() for h, v, e in zip(half, vectors, exact)]


def unpack(packed: pa.Array, dimensions: int) -> np.ndarray:
    """Unit vectors in double precision."""
    values = [np.frombuffer(b, np.float16 if len(b) == 2 * dimensions else np.float32).astype(np.float64) for b in packed.to_pylist()]
    out = np.array(values).reshape(len(values), dimensions)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def usable_vectors(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id`` and ``vec`` (packed) of the usable embeddings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            right = np.flatnonzero(np.array(lists.value_lengths().fill_null(-1)) == dimensions)
            taken = lists.take(pa.array(right))
            matrix = np.array(taken.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(right), dimensions) if len(right) else np.empty((0, dimensions), np.float32)
            good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[good])), pa.array(pack(matrix[good]), pa.binary())], names=["id", "vec"])

    return rows.select("id", F.col("value").cast("array<float>").alias("value")).mapInArrow(run, "id string, vec binary")


def nearest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, the nearest first."""
    out = np.empty((len(rows), min(n, len(centroids))), np.int64)
    half_norms = 0.5 * (centroids**2).sum(axis=1)
    step = max(1, min(2048, 16_000_000 // len(centroids)))
    for at in range(0, len(rows), step):
        score = rows[at : at + step] @ centroids.T - half_norms
        if out.shape[1] == 1:
            out[at : at + step, 0] = score.argmax(axis=1)
        else:
            part = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            out[at : at + step] = np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), axis=1), 1)
    return out


def means(rows: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """``n`` centroids of the rows by Lloyd's rounds."""
    centroids = rows[np.random.default_rng(seed).permutation(len(rows))[:n]].copy()
    for _ in range(rounds if n > 1 else 1):
        owner = nearest(rows, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, rows)
        counts = np.bincount(owner, minlength=len(centroids))
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


class Lists(NamedTuple):
    """Rotation, centroids of the lists, and the number of blocks that each list is cut into."""

    rotation: np.ndarray
    centroids: np.ndarray
    blocks: np.ndarray


def number_of_lists(n_rows: int, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS) -> int:
    return int(np.clip(n_rows // list_size, 1, max_lists))


def in_sample(column: Column, wanted: int, n_rows: int) -> Column:
    """Rows whose hash falls in a part of the range that holds about ``wanted`` of them, the same in every run."""
    buckets = 1 << 30
    return F.pmod(column, F.lit(buckets)) < min(buckets, int(wanted / max(1, n_rows) * buckets) + 1)


def fit_lists(vectors: DataFrame, dimensions: int = DIMENSIONS, list_size: int = LIST_SIZE, max_lists: int = MAX_LISTS, block: int = BLOCK, per_list: int = PER_LIST, seed: int = 7) -> tuple[Lists, int] | None:
    """Lists and the number of rows; None for an empty table.

    Fitted in two levels, at every size: some coarse centroids on at most ``TOP_SAMPLE`` vectors, then Spark splits a sample of
    ``per_list`` vectors for each list by its coarse centroid and fits the lists of every part in a task of its own (large parts are
    salted, so no task has more than ``TOP_SAMPLE`` vectors). Only centroids and counts come to the driver.
    """
    n_rows = vectors.count()
    if not n_rows:
        return None
    spark = vectors.sparkSession
    n_lists = number_of_lists(n_rows, list_size, max_lists)
    order = F.xxhash64("id")
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
    rotation = q * np.sign(np.diag(r))
    picked = vectors.where(in_sample(order, TOP_SAMPLE, n_rows)).select(order.alias("h"), "vec").limit(2 * TOP_SAMPLE).toArrow()
    if not picked.num_rows:
        picked = vectors.select(order.alias("h"), "vec").orderBy("h").limit(1).toArrow()
    picked = picked.sort_by("h").slice(0, TOP_SAMPLE)
    top = means((unpack(picked.column("vec").combine_chunks(), dimensions) @ rotation).astype(np.float32), int(np.ceil(np.sqrt(n_lists))), seed)
    sample = checkpointed(vectors.where(in_sample(order, max(TOP_SAMPLE, per_list * n_lists), n_rows)).select("num", "vec"))
    n_sample = max(1, sample.count())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = (unpack(batch.column(1), dimensions) @ rotation).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(nearest(turned, top, 1)[:, 0]), batch.column(0), batch.column(1)], names=["cell", "num", "vec"])

    cells = checkpointed(sample.mapInArrow(split, "cell long, num long, vec binary"))
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    salts = np.ones(len(top), np.int64)
    for cell, n in sizes.items():
        salts[cell] = -(-n // TOP_SAMPLE)
    salt = F.pmod(F.xxhash64("num"), F.element_at(F.lit(salts.tolist()), (F.col("cell") + 1).cast("int")))

    def refine(group: pa.Table) -> pa.Table:
        turned = (unpack(group.column("vec").combine_chunks(), dimensions) @ rotation).astype(np.float32)
        turned = turned[np.argsort(group.column("num").to_numpy(), kind="stable")]
        found = means(turned, int(np.clip(round(len(turned) / n_sample * n_lists), 1, len(turned))), seed)
        return pa.table({"centroid": pa.array(list(found), pa.list_(pa.float32()))})

    fitted = cells.withColumn("salt", salt).groupBy("cell", "salt").applyInArrow(refine, "centroid array<float>").toArrow() if sizes else None
    centroids = np.array(fitted.column("centroid").to_pylist(), np.float32).reshape(-1, dimensions) if fitted is not None else top
    centroids = centroids[np.lexsort(centroids.T)]
    shared = spark.sparkContext.broadcast(centroids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = (unpack(batch.column(1), dimensions) @ rotation).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(nearest(turned, shared.value, 1)[:, 0])], names=["cell"])

    held = np.zeros(len(centroids))
    for r in sample.mapInArrow(count, "cell long").groupBy("cell").count().collect():
        held[r["cell"]] = r["count"] * n_rows / n_sample
    return Lists(rotation, centroids, np.maximum(1, np.ceil(held / block)).astype(np.int64)), n_rows


def adaptive_scan(queries: np.ndarray, members: np.ndarray, k: int, min_similarity: float | None, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (query row, member row, cosine) of rotated unit vectors that the tests did not abandon."""
    dimensions = queries.shape[1]
    limit = np.full(len(queries), 2.0 - 2.0 * min_similarity if min_similarity is not None else 4.0)
    if min_similarity is None and len(members) > 4 * k:
        # the k-th best of a first slice of the list bounds the threshold
        first = np.partition(queries @ members[: max(2 * k, len(members) // 8)].T, -(k + 1), axis=1)[:, -(k + 1)]
        limit = np.minimum(limit, 2.0 - 2.0 * first + 1e-9)
    q32, m32 = queries.astype(np.float32), members.astype(np.float32)
    rows, cols = [], []
    for at in range(0, len(queries), 1024):
        part = q32[at : at + 1024, :columns]
        near = (part**2).sum(axis=1)[:, None] + (m32[:, :columns] ** 2).sum(axis=1)[None, :] - 2 * part @ m32[:, :columns].T
        allowed = (columns / dimensions) * (1 + epsilon / sqrt(columns)) ** 2 * limit[at : at + 1024]
        r, c = np.nonzero(near <= allowed[:, None])
        partial = near[r, c]
        for done in range(columns, dimensions, columns):
            if not len(r):
                break
            block = slice(done, done + columns)
            partial = partial + ((q32[at + r, block] - m32[c, block]) ** 2).sum(axis=1)
            seen = min(dimensions, done + columns)
            if seen < dimensions:
                keep = partial <= (seen / dimensions) * (1 + epsilon / sqrt(seen)) ** 2 * limit[at + r]
                r, c, partial = r[keep], c[keep], partial[keep]
        rows.append(at + r)
        cols.append(c)
    r, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, cols))
    cosine = np.empty(len(r))
    for at in range(0, len(r), 65_536):
        cosine[at : at + 65_536] = np.einsum("ij,ij->i", queries[r[at : at + 65_536]], members[c[at : at + 65_536]])
    keep = cosine >= (min_similarity if min_similarity is not None else -2.0)
    return r[keep], c[keep], cosine[keep]


def copies(vectors: DataFrame, k: int = K) -> DataFrame:
    """Adds ``copy``: the place by id among exact copies (the same packed vector), 1 for a vector without copies.

    Only vectors whose hash repeats are shuffled; their number of rows per class is limited before that where a filter follows.
    """
    hashed = vectors.withColumn("vec_hash", F.xxhash64("vec"))
    repeated = broadcast_if_small(hashed.groupBy("vec_hash").agg(F.count("*").alias("n")).where("n > 1").select("vec_hash"))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    several = hashed.join(repeated, "vec_hash", "left_semi").drop("vec_hash").withColumn("copy", place)
    return hashed.join(repeated, "vec_hash", "left_anti").drop("vec_hash").withColumn("copy", F.lit(1)).unionByName(several)


def neighbours(vectors: DataFrame, k: int = K, min_similarity: float | None = None, probes: int = PROBES, queries: DataFrame | None = None, dimensions: int = DIMENSIONS, all_copies: bool = True, **options) -> DataFrame:
    """``id``, ``neighbour``, ``similarity`` and ``rank`` (1..k): the k most similar other ids, ties to the smaller id.

    ``vectors`` has ``id``, ``vec`` and ``num`` (see ``prepared``). With ``min_similarity`` only neighbours at least that similar
    come out. ``queries`` (a column ``id``) restricts the searching rows; every row is searched. ``all_copies=False`` leaves out the
    results of ids that are nobody's neighbour because k + 1 smaller ids have the very same vector.
    """
    spark = vectors.sparkSession
    fitted = fit_lists(vectors, dimensions, **options)
    if fitted is None:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    lists, n_rows = fitted
    shared = spark.sparkContext.broadcast(lists)
    # Of exact copies only the k + 1 smallest ids can be neighbours.
    eligible = copies(vectors, k).where(F.col("copy") <= k + 1)
    asking = eligible.withColumn("asks", F.lit(True)) if queries is None else eligible.join(queries.select("id").distinct().withColumn("asks", F.lit(True)), "id", "left")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                turned = (unpack(batch.column(1), dimensions) @ lists.rotation).astype(np.float32)
                asks = np.array(batch.column(3).fill_null(False).to_numpy(zero_copy_only=False), bool)
                own = (batch.column(2).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64)
                cells = nearest(turned, lists.centroids, probes)
                rows, bins, mine, seek = [], [], [], []

                def emit(r, cell, mb, qb, member, ask, rows=rows, bins=bins, mine=mine, seek=seek):
                    rows.append(r)
                    bins.append((cell << 40) + (mb << 20) + qb)
                    mine.append(np.full(len(r), member))
                    seek.append(ask if isinstance(ask, np.ndarray) else np.full(len(r), ask))

                for p in range(cells.shape[1]):
                    blocks = lists.blocks[cells[:, p]]
                    r = np.flatnonzero((blocks == 1) & (asks | (p == 0)))
                    emit(r, cells[r, p], 0, 0, p == 0, asks[r])
                    # A list of b blocks is a b x b grid: a member goes to every query block of its row, a query to every member block.
                    for i in np.flatnonzero(blocks > 1):
                        b, each = int(blocks[i]), np.arange(blocks[i])
                        if p == 0:
                            emit(np.full(b, i), cells[i, p], own[i] % b, each, True, False)
                        if asks[i]:
                            emit(np.full(b, i), cells[i, p], each, own[i] % b, False, True)
                rows, mine = np.concatenate(rows), np.concatenate(mine)
                # Only members carry their id; a query is known by its number.
                ids = batch.column(0).take(pa.array(rows, mask=~mine))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(bins)), batch.column(2).take(pa.array(rows)), ids, batch.column(1).take(pa.array(rows)), pa.array(np.concatenate(seek))],
                    names=["bin", "num", "id", "vec", "asks"],
                )

    def scan(group: pa.Table) -> pa.Table:
        lists = shared.value
        member = np.array(group.column("id").is_valid().to_numpy(zero_copy_only=False), bool)
        asks = np.array(group.column("asks").to_numpy(zero_copy_only=False), bool)
        if not member.any() or not asks.any():
            return pa.table({"num": pa.array([], pa.int64()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        num = group.column("num").to_numpy()
        turned = unpack(group.column("vec").combine_chunks(), dimensions) @ lists.rotation
        q_num, m_num = num[asks], num[member]
        m_ids = group.column("id").filter(pa.array(member)).combine_chunks()
        r, c, cosine = adaptive_scan(turned[asks], turned[member], k, min_similarity)
        keep = q_num[r] != m_num[c]
        r, c, cosine = r[keep], c[keep], np.round(cosine[keep], 12)
        smaller = np.empty(len(m_ids), np.int64)
        smaller[np.argsort(np.array(m_ids.cast(pa.binary()).to_pylist(), object), kind="stable")] = np.arange(len(m_ids))
        order = np.lexsort((smaller[c], -cosine, r))
        r, c, cosine = r[order], c[order], cosine[order]
        begins = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
        best = np.arange(len(r)) - np.repeat(begins, np.diff(np.r_[begins, len(r)])) < k
        return pa.table({"num": pa.array(q_num[r[best]]), "neighbour": m_ids.take(pa.array(c[best])), "similarity": pa.array(cosine[best], pa.float64())})

    placed = asking.select("id", "vec", "num", "asks").mapInArrow(place, "bin long, num long, id string, vec binary, asks boolean")
    # Partitions follow the rows that travel, so that tasks stay as large as they are whatever the table's size.
    shipped = n_rows * (probes if queries is None else 2) * 3 * dimensions
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shipped // TASK_BYTES + 1)
    met = placed.repartition(n_parts, "bin").groupBy("bin").applyInArrow(scan, "num long, neighbour string, similarity double")
    best = Window.partitionBy("num").orderBy(F.desc("similarity"), "neighbour")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.join(vectors.select("num", "id"), "num").select("id", "neighbour", "similarity", "rank")
    if not all_copies:
        return ranked
    # Ids beyond the k + 1 smallest of their class of exact copies: their k nearest are the smallest ids of the class.
    later = copies(vectors, k).where(F.col("copy") > k + 1).select("id", "vec")
    if queries is not None:
        later = later.join(queries.select("id").distinct(), "id", "left_semi")
    heads = eligible.where(F.col("copy") <= k).select("vec", F.col("id").alias("neighbour"), F.col("copy").alias("rank"))
    return ranked.unionByName(later.join(heads, "vec").select("id", "neighbour", F.lit(1.0).alias("similarity"), "rank"))


def prepared(chunks: DataFrame, **options) -> DataFrame:
    """``id``, ``vec`` and a number ``num`` of the chunks' usable vectors, written once because fitting, counting and searching read
    them (and so the numbers stay as they are)."""
    return checkpointed(usable_vectors(latest_rows(chunks), **options).withColumn("num", F.monotonically_increasing_id()))


def mutual_pairs(chunks: DataFrame, k: int = K, min_similarity: float = 0.90, **options) -> DataFrame:
    """``id_a`` < ``id_b``: pairs at least ``min_similarity`` alike, each among the other's k most similar."""
    near = neighbours(prepared(chunks), k=k, min_similarity=min_similarity, all_copies=False, **options)
    ends = near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"), "id")
    return ends.groupBy("id_a", "id_b").agg(F.count_distinct("id").alias("n")).where("n = 2").select("id_a", "id_b")


def search(chunks: DataFrame, k: int = K, probes: int = SEARCH_PROBES, every: int = 100) -> DataFrame:
    """The k nearest of every id whose hash is divisible by ``every``, against all rows."""
    vectors = prepared(chunks)
    return neighbours(vectors, k=k, probes=probes, queries=vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id"))


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = K, dimensions: int = DIMENSIONS, block: int = 500) -> DataFrame:
    """Exact ``id``, ``neighbour``, ``similarity``, ``rank`` for the queries; their vectors are broadcast in blocks, for measuring recall."""
    asked = checkpointed(queries.select("id", "vec"))
    n_blocks = -(-asked.count() // block)
    results = None
    for number in range(max(1, n_blocks)):
        part = asked.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(max(1, n_blocks))) == number).toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((part.column("id").to_pylist(), unpack(part.column("vec").combine_chunks(), dimensions) if part.num_rows else np.empty((0, dimensions))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                ids = np.array(batch.column(0).to_pylist(), object)
                cosine = np.round(wanted @ unpack(batch.column(1), dimensions).T, 12)
                out = {"id": [], "neighbour": [], "similarity": []}
                for row, name in enumerate(names):
                    near = [j for j in np.argpartition(-cosine[row], min(2 * k, len(ids) - 1))[: 2 * k + 1] if ids[j] != name]
                    out["id"] += [name] * len(near)
                    out["neighbour"] += [ids[j] for j in near]
                    out["similarity"] += [float(cosine[row, j]) for j in near]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64())]))

        met = vectors.select("id", "vec").mapInArrow(run, "id string, neighbour string, similarity double")
        results = met if results is None else results.unionByName(met)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(chunks: DataFrame, k: int = K, every: int = 100, min_similarity: float = 0.90) -> DataFrame:
    """The share of true neighbours that the index finds for the queries of ``search``, against all rows: a row for the search, and one
    for the settings of ``mutual_pairs`` (fewer probes, neighbours at least ``min_similarity`` alike)."""
    vectors = prepared(chunks)
    queries = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    exact = checkpointed(brute_force(vectors, queries, k=k))
    report = None
    for name, probes, least in (("search", SEARCH_PROBES, None), ("pairs", PROBES, min_similarity)):
        met = neighbours(vectors, k=k, probes=probes, min_similarity=least, queries=queries.select("id")).select("id", "neighbour", F.lit(1).alias("met"))
        true = exact if least is None else exact.where(F.col("similarity") >= least)
        part = true.join(met, ["id", "neighbour"], "left").agg(F.lit(name).alias("setting"), F.count_distinct("id").alias("n_queries"), F.count("*").alias("n_true"), F.count("met").alias("n_met"), (F.count("met") / F.nullif(F.count("*"), F.lit(0))).alias("recall"))
        report = part if report is None else report.unionByName(part)
    return report
