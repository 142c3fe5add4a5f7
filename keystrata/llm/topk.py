"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors are packed into blocks, longest first inside a block, and each (query block,
candidate block) cell is one piece of work. Candidate blocks stay where they are
read; the queries come to them as broadcasts of at most ROUND_BYTES, one round after
the other, however many there are.

1. Each candidate block scores its LONGEST longest vectors exactly for every query and
   sends the list of the k best scores. The k-th largest of a query's gathered
   scores is a cutoff that its true k-th score can't fall below, as those vectors are
   some of all.
2. The cutoffs go back to all blocks with the queries. A block leaves out the vectors whose length
   times the query's can't reach the cutoff, and collects, by the sum over half of the
   dimensions and a bound of the rest, those that may.
3. Those are scored exactly; what is below the cutoff goes, and the k best by
   (score, then smaller id) stay, first in the cell, then over all cells.

Lists merge by salted query first and then by query, k entries each.

Edge cases: vectors that are null or hold null, NaN or infinite components, before or
after scaling, take no part, nor do rows without an id; vectors of unequal length are
never compared; vectors without components score 0; a candidate with the query's own id
is left out; repeated candidate rows each count, repeated query rows count once, and
query rows of one id with other vectors are queries of their own, each with its ranks;
scores beyond 64 bits are ranked exactly, up to 33 digits, and returned as the nearest
64-bit number; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a candidate block and of a query block, and queries scored at once.
CANDIDATES, QUERIES, AT_ONCE = 4096, 2048, 256
#: Vectors of a block that the first phase scores; the second phase scores all.
LONGEST = 256
#: Bytes of queries in one broadcast.
ROUND_BYTES = 64 << 20
_MOST = (1 << 63) - 1

BLOCK = "dim int, ids binary, vecs binary"


def _usable(embedding, scale: float):
    return embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(scale)) == float("inf")))


def _pack(size: int, scale: float):
    """Packs rows (id, vec) into blocks of at most `size` rows, longest first, one dimension count each."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])

    def run(batches):
        held: dict[int, list] = {}

        def block(dim):
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            with np.errstate(over="ignore"):
                order = np.argsort(-(vecs**2).sum(1), kind="stable")
            return pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids[order].astype(np.int64).tobytes(), "vecs": vecs[order].tobytes()}], schema)

        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lens = np.diff(lists.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(lens)])
            for dim in np.unique(lens):
                rows = np.flatnonzero(lens == dim)
                vecs = np.floor(scale * flat[start[rows][:, None] + np.arange(dim)])
                for k in range(0, len(rows), size):
                    held.setdefault(int(dim), []).append((ids[rows[k : k + size]], vecs[k : k + size]))
                    if sum(len(x[0]) for x in held[int(dim)]) >= size:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return run


def _exact_type(q: np.ndarray, c: np.ndarray):
    """The narrowest type in which every inner product of these whole numbers is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def _exactly(q: np.ndarray, c: np.ndarray) -> list[list[int]]:
    """Inner products of numbers too large for any float, row by row."""
    whole = [[int(v) for v in r] for r in c]
    return [[sum(a * b for a, b in zip(r, v, strict=True)) for v in whole] for r in ([int(x) for x in r] for r in q)]


def _scores(q: np.ndarray, c: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    return np.array(_exactly(q, c), object).reshape(len(q), len(c))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id."""
    if scores.dtype != object:
        if len(scores) > 4 * k:  # all that reach the k-th score
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            return some[np.lexsort((ids[some], -scores[some]))][:k]
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(ids)), key=lambda n: (-scores[n], ids[n]))[:k], int)


def _blocks_of(row, dim: int):
    """Keys, own ids and vectors of a query block, ids and vectors of a candidate block."""
    whole = lambda x: np.frombuffer(row[x], np.int64)
    vecs = lambda x, n: np.frombuffer(row[x], np.float64).reshape(n, dim)
    qid, cid = whole("q_ids"), whole("ids")
    return whole("q_keys"), qid, vecs("q_vecs", len(qid)), cid, vecs("vecs", len(cid))


def _first(row, k: int):
    """Phase 1: (query key, its k best scores among the block's longest vectors)."""
    keys, qid, q, cid, c = _blocks_of(row, row["dim"])
    cid, c = cid[:LONGEST], c[:LONGEST]
    kind = _exact_type(q, c)
    for at in range(0, len(qid), AT_ONCE):
        scores = _scores(q[at : at + AT_ONCE], c, kind)
        for key, own, line in zip(keys[at : at + AT_ONCE].tolist(), qid[at : at + AT_ONCE], scores, strict=True):
            line = line[cid != own]
            if len(line):
                best = np.partition(line, len(line) - k)[len(line) - k :] if line.dtype != object and len(line) > k else sorted(line)[-k:]
                # As floats: what is too large for one counts as less, which leaves the cutoff safe.
                yield key, [float(x) if abs(x) < 1 << 1023 else 1e308 if x > 0 else -np.inf for x in best]


def _second(row, k: int):
    """Phases 2 and 3: (query key, candidate id, score) of each query's k best in the block that reach its cutoff."""
    dim = row["dim"]
    keys, qid, q, cid, c = _blocks_of(row, dim)
    cutoffs = np.frombuffer(row["cutoffs"], np.float64)
    kind = _exact_type(q, c)
    if kind is object:
        for key, own, line in zip(keys.tolist(), qid, _scores(q, c, kind), strict=True):
            line, ids = line[cid != own], cid[cid != own]
            yield from ((key, int(ids[j]), int(line[j])) for j in _best(line, ids, k))
        return
    head = (dim + 1) // 2
    length = lambda x: np.sqrt((x**2).sum(1)) * (1 + 1e-9)
    q_all, c_all, q_tail, c_tail = length(q), length(c), length(q[:, head:]), length(c[:, head:])
    # No query of the block can reach its cutoff with vectors shorter than this; they stand last.
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(cutoffs <= 0, 0.0, cutoffs / q_all * (1 - 1e-6)).min(initial=np.inf)
    n = int(np.searchsorted(-c_all, -least, side="right"))
    cid, c, c_tail = cid[:n], c[:n], c_tail[:n]
    q, c = q.astype(kind), c.astype(kind)
    for at in range(0, len(qid), AT_ONCE):
        part, low = q[at : at + AT_ONCE], cutoffs[at : at + AT_ONCE]
        sums = part[:, :head] @ c[:, :head].T
        able = sums + q_tail[at : at + AT_ONCE, None] * c_tail[None, :] + 1e-6 * (1 + np.abs(sums)) >= low[:, None]
        able &= qid[at : at + AT_ONCE, None] != cid[None, :]
        i, j = np.nonzero(able)
        if len(i) * 8 > able.size:
            scores = (sums + part[:, head:] @ c[:, head:].T)[i, j]
        else:
            scores = np.concatenate([sums[i[s : s + 65536], j[s : s + 65536]] + (part[i[s : s + 65536], head:] * c[j[s : s + 65536], head:]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        keep = scores >= low[i]
        i, j, scores = i[keep], j[keep], scores[keep].astype(np.int64)
        order = np.lexsort((cid[j], -scores, i))
        i, j, scores = i[order], j[order], scores[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield from zip(keys[at : at + AT_ONCE][i[keep]].tolist(), cid[j[keep]].tolist(), scores[keep].tolist(), strict=True)


def _rows_of(cell, k: int, schema: pa.Schema):
    def run(batches):
        for b in batches:
            for n in range(b.num_rows):  # a row is a block of thousands of vectors
                rows = list(cell(b.slice(n, 1).to_pylist()[0], k))
                for at in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[at : at + (1 << 16)], strict=True), schema, strict=True)], schema=schema)

    return run


_LISTS = pa.schema([("key", pa.int64()), ("scores", pa.list_(pa.float64()))])
_ENTRIES = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0))])


def _entry_cell(row, k: int):
    """Scores as decimals, which SQL ranks exactly; beyond 33 digits as equal."""
    most = 10**33
    return ((key, vec, Decimal(max(-most, min(most, score)))) for key, vec, score in _second(row, k))


def _query_blocks(queries: DataFrame, scale: float) -> DataFrame:
    """Rows (qb, dim, key, id, vec, cutoff) packed into one row for each (qb, dim), of about QUERIES rows."""
    fields = [("qb", pa.int64()), ("dim", pa.int32()), ("q_keys", pa.binary()), ("q_ids", pa.binary()), ("q_vecs", pa.binary()), ("cutoffs", pa.binary())]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                key, id_, vec, cutoff = (b.column(k).slice(row, 1).flatten() for k in range(2, 6))
                bytes_of = lambda x, kind: x.to_numpy(zero_copy_only=False).astype(kind).tobytes()
                cols = [[b.column(0)[row].as_py()], [b.column(1)[row].as_py()], [bytes_of(key, np.int64)], [bytes_of(id_, np.int64)], [np.floor(scale * vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).tobytes()], [bytes_of(cutoff, np.float64)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    packed = queries.groupBy("qb", "dim").agg(F.sort_array(F.collect_list(F.struct("key", "id", "vec", "cutoff"))).alias("r")).select("qb", "dim", "r.key", "r.id", "r.vec", "r.cutoff")
    return packed.mapInArrow(run, "qb long, dim int, q_keys binary, q_ids binary, q_vecs binary, cutoffs binary")


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", scale: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by the inner product of floor(scale * x)."""

    def base(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
        return rows.where(F.col("id").isNotNull() & _usable(F.col("vec"), scale))

    blocks = base(candidates).mapInArrow(_pack(CANDIDATES, scale), BLOCK)
    chosen = base(queries).select("id", "vec").dropDuplicates(["id", "vec"])
    # A key of its own for each query row, as one id may come with several vectors.
    chosen = cut(chosen.select(F.xxhash64("id", "vec").alias("key"), "id", "vec", F.size("vec").alias("dim")), "queries")
    total = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dim") * 8 + 32).alias("bytes")).first()
    n_blocks = max(1, -(-total["n"] // QUERIES))
    n_rounds = max(1, -(-(total["bytes"] or 0) // ROUND_BYTES))
    numbered = chosen.withColumn("qb", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(n_blocks)))

    def met(cell, rows: DataFrame, schema: pa.Schema, columns: str) -> DataFrame:
        packed = _query_blocks(rows, scale)
        out = None
        for r in range(n_rounds):
            # At most about ROUND_BYTES: counted above.
            part = packed.where(F.col("qb") % n_rounds == r) if n_rounds > 1 else packed
            one = blocks.join(F.broadcast(part), "dim").mapInArrow(_rows_of(cell, k, schema), columns)
            out = one if out is None else out.unionByName(one)
        return out

    top = lambda x: F.slice(F.sort_array(x, asc=False), 1, k)
    lists = met(_first, numbered.withColumn("cutoff", F.lit(float("-inf"))), _LISTS, "key long, scores array<double>")
    cutoff = (
        lists.groupBy("key", F.pmod(F.xxhash64("scores"), F.lit(16)).alias("salt")).agg(top(F.flatten(F.collect_list("scores"))).alias("scores"))
        .groupBy("key").agg(top(F.flatten(F.collect_list("scores"))).alias("scores"))
        .select("key", F.when(F.size("scores") >= k, F.get("scores", F.lit(k - 1))).otherwise(F.lit(float("-inf"))).alias("cutoff"))
    )
    known = numbered.join(cutoff, "key", "left").fillna(float("-inf"), ["cutoff"])
    entries = met(_entry_cell, known, _ENTRIES, "key long, vec_id long, score decimal(38,0)")
    item = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    first = lambda x: F.slice(F.sort_array(x), 1, k)
    best = (
        entries.groupBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("salt")).agg(first(F.collect_list(item)).alias("best"))
        .groupBy("key").agg(first(F.flatten(F.collect_list("best"))).alias("best"))
    )
    named = best.join(chosen.select(F.col("key").alias("q"), F.col("id").alias("query_id")), F.col("key") == F.col("q"))
    score = F.least(F.greatest(-F.col("b.s"), F.lit(-_MOST - 1)), F.lit(_MOST)).cast("long")
    return named.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.v").alias("vec_id"), score.alias("score"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.where(F.col("vec_id") % 20 == 0), 20, scale=64.0)


SQL = {
    "op4_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
