"""Exact top k by integer inner product: best-first search in M-trees.

Vectors become integers, floor(scale * x). A last component lifts them to one sphere around the origin, so a larger inner
product is a smaller Euclidean distance, a metric. Rows are dealt by a hash into shards of about SHARD vectors; each
shard's task builds one M-tree: pages of up to PAGE entries, each entry with its distance to the page's centre, each
page with its covering radius. Queries come to every shard, in blocks, and a block searches it best first: pages wait in
a queue by the least distance they allow to a query of the block; stored parent distances leave out queries and entries
by the triangle inequality before any product is computed; a page is opened only for the queries whose k-th best it can
still beat, all their products at once. Scores are exact integers, in doubles below 2 ** 53 and in longs beyond; squared
lengths of 2 ** 63 or more, whose scores no long need hold, are refused with an ArithmeticError. The shards' best lists
merge.

Nulls and the like: see vectors.clean; zero vectors take part. Rows that share a vec_id count as one candidate with
its best score; nobody finds its own id. Ties go to smaller ids.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import runs, stored
from ledgerspark.llm.vectors import clean, longest, merged, products, unpack

SCALE, SHARD, PAGE, ASKED = 64, 8192, 256, 1024
SLACK = 1e-6  # of the sphere's radius: what distances in doubles may be off
LEAST = np.iinfo(np.int64).min


class Page:
    """rows: of the leaf's entries, or children: pages. far: distances of the entries to this page's centre."""

    __slots__ = ("centre", "radius", "rows", "children", "far")

    def __init__(self, points: np.ndarray, rows: np.ndarray, page: int = PAGE):
        mean = points[rows].mean(0)
        self.centre = points[rows[np.argmin(((points[rows] - mean) ** 2).sum(1))]]
        self.children: list[Page] = []
        self.rows = rows
        reach = np.sqrt(((points[rows] - self.centre) ** 2).sum(1))
        self.radius = float(reach.max())
        if len(rows) <= page:
            self.far = reach
            return
        # routing objects far from each other; every row goes to the nearest, in parts of even size at worst
        ways = min(16, -(-len(rows) // page))
        pivots, gap = [int(np.argmax(reach))], reach
        while len(pivots) < ways:
            gap = np.minimum(gap, np.sqrt(((points[rows] - points[rows[pivots[-1]]]) ** 2).sum(1)))
            pivots.append(int(np.argmax(gap)))
        centres = points[rows[pivots]]
        side = np.argmin((centres**2).sum(1)[None, :] - 2 * points[rows] @ centres.T, 1)
        groups = [rows[side == s] for s in range(ways)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # equal vectors
            groups = np.array_split(rows, ways)
        self.children = [Page(points, g, page) for g in groups]
        self.far = np.sqrt(((np.array([c.centre for c in self.children]) - self.centre) ** 2).sum(1))


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        """vectors: integers; most: the largest squared length of all shards."""
        self.ids, self.vectors, self.most = ids, vectors, most
        x = vectors.astype(np.float64)
        self.points = np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]])
        self.exact = x
        self.distinct = len(np.unique(ids)) == len(ids)
        self.root = Page(self.points, np.arange(len(ids)))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, ids and scores of the k best of each. The queries go through the tree together: the
        queue holds pages by the least distance they allow to any query, and a page is opened for those queries only
        whose own bound lets it in."""
        q = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
        square = (q * q).sum(1) + self.most
        limit = np.full(len(q), np.inf)  # distances beyond which nothing can be among the k best
        floor = np.full(len(q), LEAST)  # the k-th best scores
        slack = SLACK * (1 + np.sqrt(square))
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def distance(p: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.sqrt(((q[at] - p) ** 2).sum(1))

        every = np.arange(len(q))
        d = distance(self.root.centre, every)
        queue = [(float((d - self.root.radius).min()), 0, every, d, self.root)] if len(q) else []
        n = 0
        while queue:
            _, _, at, d, page = heapq.heappop(queue)
            open_ = d - page.radius <= limit[at]
            at, d = at[open_], d[open_]
            if not len(at):
                continue
            if page.children:
                for c, far in zip(page.children, page.far, strict=True):
                    some = np.flatnonzero(np.abs(d - far) - c.radius <= limit[at])
                    dc = distance(c.centre, at[some])
                    near = dc - c.radius <= limit[at[some]]
                    if near.any():
                        n += 1
                        heapq.heappush(queue, (float((dc - c.radius)[near].min()), n, at[some][near], dc[near], c))
                continue
            reach = limit[at].max()
            rows = page.rows[(page.far >= d.min() - reach) & (page.far <= d.max() + reach)]
            if not len(rows):
                continue
            got = products(q[at, :-1], self.exact[rows], self.most)
            ids = self.ids[rows]
            got[own[at][:, None] == ids[None, :]] = LEAST
            least = floor[at]
            if self.distinct and len(rows) > k:
                least = np.maximum(least, np.partition(got, len(rows) - k, 1)[:, len(rows) - k])
            i, j = np.nonzero((got >= least[:, None]) & (got > LEAST))
            if not len(i):
                continue
            new = (at[i], ids[j], got[i, j])
            top = leading(*(np.concatenate(x) for x in zip(top, new, strict=True)), k)
            first = np.searchsorted(top[0], every)
            full = np.searchsorted(top[0], every, "right") - first == k
            floor[full] = top[2][first[full] + k - 1]
            limit[full] = np.sqrt(np.maximum(0.0, square[full] - 2.0 * floor[full])) + slack[full]
        return top


def leading(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, by query, best first, ties to smaller ids, each id once."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    once = runs([query, ids])
    query, ids, scores = query[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], scores[keep]


def top_k(table: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score."""
    vectors, d = clean(table, zero=True)

    def whole(batches):
        for batch in batches:
            x = np.floor(unpack(batch.column(1).to_pylist(), d) * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(longest(x))], ["vec_id", "vec", "square"])

    rows = stored(vectors.mapInArrow(whole, "vec_id long, vec binary, square double").withColumn("asks", F.expr(is_query)))
    size = rows.agg(F.max("square").alias("most"), F.count("*").alias("n")).first()
    shards, most = max(1, -(-size.n // SHARD)), float(size.most or 0.0)
    if most >= 2.0**63:
        raise ArithmeticError(f"scores of vectors of squared length {most:g} don't fit a long")

    def packed(batches):
        """Queries in blocks, to cut the number of rows that go to every shard."""
        for batch in batches:
            for i in range(0, len(batch), ASKED):
                part = batch.slice(i, ASKED)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(part.column(1).to_pylist())], pa.binary())], ["ids", "vecs"])

    asked = rows.where("asks").select("vec_id", "vec").mapInArrow(packed, "ids binary, vecs binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "ids", "vecs")
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("vec_id"), "vec")

    def pages(batches):
        for batch in batches:
            shard = batch.column(0).to_numpy()
            for s in np.unique(shard):
                part = batch.take(pa.array(np.flatnonzero(shard == s)))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([0], pa.int32()), pa.array([part.column(2).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(part.column(3).to_pylist())], pa.binary())], ["shard", "kind", "ids", "vecs"])

    held = held.mapInArrow(pages, "shard int, kind int, ids binary, vecs binary")

    def search(batches):
        now, parts, tree = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != now:
                    now, parts, tree = r["shard"], [], None
                ids, x = np.frombuffer(r["ids"], "<i8"), unpack([r["vecs"]], d)
                if not r["kind"]:
                    parts.append((ids, x))
                    continue
                if tree is None and parts:
                    tree = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), most)
                if tree is None:
                    continue
                place, found, scores = tree.search(ids, x, k)
                cuts = np.searchsorted(place, np.arange(len(ids) + 1))
                spans = list(zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array([v[a:b].astype("<i8").tobytes() for a, b in spans], pa.binary()) for v in (found, scores))], ["query_id", "ids", "scores"])

    dealt = held.union(asked).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "kind")
    return merged(dealt.mapInArrow(search, "query_id long, ids binary, scores binary"), k, "long")


#: DuckDB: all products.
SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
