"""Exact top-k inner products by MaxScore over shards of postings.

A dimension is a term; a shard holds, for each term, the contributions' column
of its rows and their extremes.  Terms are ordered by how much they can move a
score in that shard.  The trailing terms whose joint range cannot lift a row
from the least score to a query's current k-th best are non-essential: the
essential postings are traversed for all rows, and the others are probed, a few
at a time, for rows that can still compete.  That is done for a few hundred
queries at once, as products of matrices.  Shards of a task come in the order of
ids, so that a query's k best go on from one to the next and a tie never wins later.

Queries and rows meet as groups of bounded size, by the numbers of a block of
queries and of a part of the rows: nothing is broadcast and no pair is a row.
A row is sent once for each block of queries, a query once for each part, and
comes back with its k best of that part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm.common import cut, give_back

#: Terms that are added at a time; queries whose scores are told at once; shards, and blocks of queries, that meet in one group at most.
PROBE, TOGETHER, SIDE = 8, 256, 4
#: Share of rows that still compete from which on single rows are probed; rows at a threshold, for each that is wanted, from which they are sorted one query at a time.
RARE, CROWD = 1 / 128, 64
#: The score of nothing.
LOW = -(1 << 62)


class Shard:
    """Postings of rows, whose ids must rise, for scores against vectors of at most ``most`` in any component."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int):
        self.ids, self.by_key = ids, np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        # floats hold sums of products, and sums of two of those, exactly below 2**24 and 2**53
        bound = 4.0 * most * float(np.abs(vectors.astype(float)).max(initial=0)) * max(1, vectors.shape[1])
        self.kind = np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64
        self.columns = np.ascontiguousarray(vectors.T, dtype=self.kind)
        self.low, self.high = self.columns.min(1, initial=0), self.columns.max(1, initial=0)

    def best(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put into ``ids`` and ``scores``, [query, k], the k best of what they hold and of the rows but that of key ``own``,
        ties to smaller ids; ids that they hold are not larger than the rows'.  A place not yet taken has the score LOW."""
        d = len(self.columns)
        queries = queries[:, :d] if queries.shape[1] >= d else np.pad(queries, ((0, 0), (0, d - queries.shape[1])))
        queries = queries.astype(self.kind)
        terms = np.argsort(-np.abs(queries).sum(axis=0, dtype=float) * (self.high - self.low), kind="stable")
        queries, columns = queries[:, terms], self.columns[terms]
        for at in range(0, len(queries), TOGETHER):
            some = slice(at, at + TOGETHER)
            self._best(np.ascontiguousarray(queries[some]), columns, terms, own[some], ids[some], scores[some])

    def _best(self, queries: np.ndarray, columns: np.ndarray, terms: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        n, k, d = len(queries), scores.shape[1], len(terms)
        wide = np.int64 if self.kind is np.int64 else np.float64
        ends = queries.astype(wide) * self.low[terms].astype(wide), queries.astype(wide) * self.high[terms].astype(wide)
        upper, lower = np.maximum(*ends), np.minimum(*ends)
        ahead = lambda x: np.concatenate([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1), wide)], axis=1)
        rest, spread = ahead(upper), ahead(upper - lower)  # of terms[j:]
        place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        inside = np.flatnonzero(self.keys[place] == own)
        place = self.by_key[place[inside]]
        told = min(PROBE, d)
        score = queries[:, :told] @ columns[:told]
        score[inside, place] = LOW

        # what a row must exceed: the k-th best so far, or of the rows that promise most
        least = scores[:, -1].astype(wide)
        fresh = np.flatnonzero(scores[:, -1] == LOW)
        if len(fresh) and len(self.ids) > k:
            seeds = np.argpartition(score[fresh], -k, axis=1)[:, -k:]
            whole = np.einsum("qkd,qd->qk", columns[told:].T[seeds], queries[fresh, told:]) + np.take_along_axis(score[fresh], seeds, axis=1)
            whole = whole.min(axis=1).astype(wide)
            least[fresh] = np.where(whole > LOW / 2, whole - 1, LOW)  # integers: rows as good as the seeds exceed it
        essential = (spread > (least - lower.sum(axis=1))[:, None]).sum(axis=1)
        until = min(d, max(told, int(np.median(essential))))
        alive = None
        while True:
            if until > told:
                score += queries[:, told:until] @ columns[told:until]
                told = until
            fit = score > (least - rest[:, told])[:, None].astype(self.kind)
            fit[inside, place] = False
            left = np.count_nonzero(fit)
            if told == d or left <= RARE * fit.size:
                break
            until = min(d, told + PROBE)
        crowded = np.flatnonzero(np.count_nonzero(fit, axis=1) > CROWD * k) if told == d else []
        for q in crowded:  # many rows as good as others: the first of them have the smaller ids
            held = np.flatnonzero(fit[q])
            fit[q] = False
            fit[q, held[np.argsort(-score[q, held], kind="stable")[:k]]] = True
        query, row = np.nonzero(fit)
        found = score[query, row]
        for j in range(told, d, PROBE):
            found = found + np.einsum("pd,pd->p", queries[query, j : j + PROBE], columns[j : j + PROBE, row].T)
            alive = found > (least - rest[:, min(j + PROBE, d)])[query]
            query, row, found = query[alive], row[alive], found[alive]
        if not len(query):
            return
        changed, query = np.unique(query, return_inverse=True)
        held = np.repeat(np.arange(len(changed)), k)
        all_queries = np.concatenate([held, query])
        all_ids, all_scores = np.concatenate([ids[changed].ravel(), self.ids[row]]), np.concatenate([scores[changed].ravel(), found.astype(np.int64)])
        order = np.lexsort((all_ids, -all_scores, all_queries))
        first = np.searchsorted(all_queries[order], np.arange(len(changed)))
        top = order[first[:, None] + np.arange(k)]
        ids[changed], scores[changed] = all_ids[top], all_scores[top]


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<long>): floor(256 x) of each component.

    Rows with a null id, a null vector, or null or non-finite components go.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rows_in_shard: int = 4096, queries_in_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    ``is_query``: a condition on ``vec_id``.  Each row that meets it is a query
    and has ranks of its own.  Candidates: all rows but the query's own; fewer
    than k candidates: all.  Ties go to the smaller id.  Repeated rows and rows
    that share an id are queries and candidates of their own.  Missing trailing
    components count as 0.  Columns but the two named ones are not read.  An
    empty table gives no rows.
    """
    # written with a key for each row, so that it stays the row's own
    rows = cut(integer_vectors(df, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, m = rows.count(), rows.where(is_query).count()
    # parts of several shards, but as many as there are tasks if the table allows
    shards = max(1, -(-n // rows_in_shard))
    parts = max(-(-shards // SIDE), min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = max(1, -(-m // (queries_in_block * SIDE)))
    numbers = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    held = rows.select("key", "vec_id", "v", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), numbers(blocks).alias("block"))
    asked = rows.where(is_query).select("key", "vec_id", "v", numbers(parts).alias("part"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, ids, vectors = table["key"].to_numpy(), table["vec_id"].to_numpy(), table["v"].combine_chunks()
        counts = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(set(counts.tolist())) <= 1:
            return keys, ids, flat.reshape(len(ids), -1)
        out = np.zeros((len(ids), int(counts.max())), np.int64)
        out[np.arange(out.shape[1]) < counts[:, None]] = flat
        return keys, ids, out

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        own, query_ids, queries = matrix(asked)
        keys, ids, vectors = matrix(held)
        order = np.argsort(ids, kind="stable")
        best, scores = np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), LOW)
        most = int(np.abs(queries.astype(float)).max(initial=0))
        for at in range(0, len(order) if len(own) else 0, rows_in_shard):
            some = order[at : at + rows_in_shard]
            Shard(keys[some], ids[some], vectors[some], most).best(queries, own, best, scores)
        query, place = np.nonzero(scores > LOW)
        out = pa.table([pa.array(x, pa.int64()) for x in (own[query], query_ids[query], best[query, place], scores[query, place])], names=["key", "query_id", "vec_id", "score"])
        give_back()
        return out

    pairs = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(run, "key long, query_id long, vec_id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
