"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors become integers, floor(scale * x). A last component lifts them to one sphere around the origin, so the squared
distance of an anchor (lifted by 0) to a row is a constant less twice their inner product: rows whose score lies in a window
are those in an annulus around the anchor, and larger scores are nearer.

A vantage-point tree over a bounded sample (SAMPLE rows, those with the smallest hashes of their ids) deals all rows into at
most CELLS cells; of every cell the least and the largest distance to the vantage points on its way are taken over all
its rows. Cells of more than SHARD rows, as equal vectors make, are dealt over several shards. An anchor goes only to cells that
its annuli meet: for positives, within the distance of its k-th best row in the sample, which bounds its k-th best row. Each
shard's task builds a vantage-point tree of its rows and goes through it nearest first for each anchor; nodes whose bounds
miss all annuli that still lack rows stay closed. Distances only decide what is opened, with a slack of SLACK; scores
and windows are exact integers. The shards' best rows merge by rank.

Rows with a null id, label or vector, with a null or non-finite component, or with another length than the most common one
take no part; zero vectors do. Of such rows that share an id, the one with the largest label, then the largest vector as bytes, counts.
Ties go to smaller ids. An anchor without positives or without rows in its windows has no rows. An empty table gives an
empty result. Squared lengths, and so scores, must fit a long: else an ArithmeticError says so. Other columns are unread.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import runs, stored
from ledgerspark.llm.vectors import clean, longest, products, unpack

SCALE, SAMPLE, CELLS, SHARD, LEAF = 256, 4096, 256, 4096, 512
SLACK = 1e-6  # of the sphere's radius: what distances in doubles may be off
FEWEST, MOST = -(1 << 63), (1 << 63) - 1
DEALT = "shard int, kind int, vec_id long, label long, vec binary, names array<long>, marks array<long>, lows array<long>, highs array<long>"
FOUND = "anchor_id long, name long, mark long, vec_id long, score long"


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a to all rows of b."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)))


def asking(x: np.ndarray) -> np.ndarray:
    """Anchors beside lifted rows."""
    return np.hstack([x, np.zeros((len(x), 1))])


class Cells:
    """The tree over the sample: vantage points in levels, node i over 2 i + 1 (near) and 2 i + 2 (far)."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.at = np.zeros((max(1, (1 << depth) - 1), points.shape[1]))
        self.split = np.zeros(len(self.at))
        groups = {0: np.arange(len(points))}
        for i in range((1 << depth) - 1):
            rows = groups.pop(i)
            if len(rows):
                mean = points[rows].mean(0)
                far = rows[np.argmax(((points[rows] - mean) ** 2).sum(1))]
                self.at[i] = points[far]
                d = np.sqrt(((points[rows] - points[far]) ** 2).sum(1))
                self.split[i] = np.median(d)
                near = d <= self.split[i]
                groups[2 * i + 1], groups[2 * i + 2] = rows[near], rows[~near]
            else:
                groups[2 * i + 1] = groups[2 * i + 2] = rows
        inner = (1 << depth) - 1
        way = np.arange(inner, 2 * inner + 1)[:, None]
        for _ in range(depth):
            way = np.hstack([(way[:, :1] - 1) // 2, way])
        self.way = way[:, :-1]  # the vantage points on the way to each cell

    def of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distances to the vantage points on the way."""
        d = distances(points, self.at)
        node = np.zeros(len(points), np.int64)
        far = np.zeros((len(points), self.depth))
        for level in range(self.depth):
            far[:, level] = d[np.arange(len(points)), node]
            node = 2 * node + 1 + (far[:, level] > self.split[node])
        return node - ((1 << self.depth) - 1), far

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest distances of anchors to rows of each cell, whose own distances lie in low .. high."""
        d = distances(q, self.at)[:, self.way]
        if not self.depth:
            return np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        return np.maximum(0.0, np.maximum(d - high, low - d).max(2)), (d + high).min(2)


class Tree:
    """A vantage-point tree of a shard's rows."""

    __slots__ = ("rows", "vantage", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        self.rows, self.children = rows, []
        if len(rows) <= LEAF:
            return
        mean = points[rows].mean(0)
        far = rows[np.argmax(((points[rows] - mean) ** 2).sum(1))]
        d = np.sqrt(((points[rows] - points[far]) ** 2).sum(1))
        near = d <= np.median(d)
        if near.all():
            near = d < d.max()
        if min(near.sum(), (~near).sum()) < len(rows) // 8:  # most lie at one distance, as equal vectors do: one leaf
            return
        self.vantage = points[far]
        self.children = [(float(d[side].min()), float(d[side].max()), Tree(points, rows[side])) for side in (near, ~near)]


class Shard:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float):
        self.ids, self.labels, self.vectors, self.most = ids, labels, vectors, most
        self.tree = Tree(lifted(vectors, most), np.arange(len(ids)))

    def nearest(self, own: int, label: int, query: np.ndarray, windows: list[tuple[int, int]], same: bool, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores, ids and scores of its k best rows of the same label, or of other ones."""
        q = np.append(query, 0.0)
        square = float(query @ query) + self.most
        slack = SLACK * np.sqrt(square) + SLACK
        at = lambda score: np.sqrt(np.maximum(0.0, square - 2.0 * np.asarray(score, np.float64)))
        inner, outer = at([h for _, h in windows]) - slack, at([low for low, _ in windows]) + slack
        low = np.array([w[0] for w in windows])
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        queue = [(0.0, 0, np.inf, self.tree)]
        n = 0
        while queue:
            least, _, most, node = heapq.heappop(queue)
            if least > outer.max():
                break
            wanted = np.flatnonzero((least <= outer) & (most >= inner))
            if not len(wanted):
                continue
            if node.children:
                d = float(np.sqrt(((q - node.vantage) ** 2).sum()))
                for a, b, child in node.children:
                    n += 1
                    heapq.heappush(queue, (max(least, d - b, a - d), n, min(most, d + b), child))
                continue
            rows = node.rows[(self.labels[node.rows] == label) == same]
            rows = rows[self.ids[rows] != own]
            scores = products(query[None, :], self.vectors[rows], self.most)[0]
            for w in wanted:
                fit = np.flatnonzero((scores >= low[w]) & (scores <= windows[w][1]))
                if not len(fit):
                    continue
                ids, got = np.append(best[w][0], self.ids[rows[fit]]), np.append(best[w][1], scores[fit])
                order = np.lexsort((ids, ~got))[:k]
                best[w] = ids[order], got[order]
                if len(order) == k:
                    low[w] = max(low[w], int(got[order[-1]]))
                    outer[w] = at(low[w]) + slack
        return best


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Shard, kind and rows, in order; a shard's rows of one kind may come in several pieces."""
    for batch in batches:
        cuts = runs([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        for a, b in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
            yield batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), batch.slice(a, b - a)


def searched(dealt: DataFrame, d: int, most: float, shards: int, same: bool, k: int) -> DataFrame:
    """FOUND: for the rows of kind 1, the best of the rows of kind 0 in their shard by window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, rows = None, [], None
        for now, kind, part in pieces(batches):
            ids, labels, vectors = part.column(2).to_numpy(), part.column(3).to_numpy(), unpack(part.column(4).to_pylist(), d)
            if shard != now:
                shard, parts, rows = now, [], None
            if not kind:
                parts.append((ids, labels, vectors))
                continue
            if rows is None and parts:
                rows = Shard(*(np.concatenate(c) for c in zip(*parts, strict=True)), most)
                parts = []
            if rows is None:
                continue
            names, marks, lows, highs = (part.column(i).to_pylist() for i in range(5, 9))
            out = []
            for i in range(len(ids)):
                for name, mark, (found, scores) in zip(names[i], marks[i], rows.nearest(int(ids[i]), int(labels[i]), vectors[i], list(zip(lows[i], highs[i], strict=True)), same, k), strict=True):
                    n = len(found)
                    out.append((np.full(n, ids[i]), np.full(n, name), np.full(n, mark), found, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["anchor_id", "name", "mark", "vec_id", "score"])

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND)


def leading(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(table: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its `positives`
    nearest other rows of its label, the k nearest rows of other labels that score from low to high percent of that
    positive. table: vec_id, embedding, label."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where("label is not null")
    vectors, d = clean(rows, zero=True, beside=("label",))
    vectors = vectors.groupBy("vec_id").agg(F.max(F.struct("label", "vec")).alias("r")).select("vec_id", "r.vec", "r.label")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(unpack(batch.column(1).to_pylist(), d) * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(longest(x))], ["vec_id", "label", "vec", "square"])

    rows = stored(vectors.mapInArrow(whole, "vec_id long, label long, vec binary, square double"))
    size = rows.agg(F.max("square").alias("most"), F.count("*").alias("n")).first()
    most = float(size.most or 0.0)
    if most >= 2.0**63:
        raise ArithmeticError(f"scores of vectors of squared length {most:g} don't fit a long")
    sample = rows.select("label", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    some, some_labels = unpack([r.vec for r in sample], d), np.array([r.label for r in sample], np.int64)
    depth = min(CELLS, -(-size.n // SHARD)).bit_length() if size.n > SHARD else 0
    cells = Cells(lifted(some, most), min(depth, CELLS.bit_length() - 1))

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = cells.of(lifted(unpack(batch.column(2).to_pylist(), d), most))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell.astype(np.int32)), pa.array(list(far), pa.list_(pa.float64()))], ["vec_id", "label", "vec", "cell", "far"])

    rows = stored(rows.mapInArrow(celled, "vec_id long, label long, vec binary, cell int, far array<double>"))
    ends = [f(F.col("far")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(cells.depth)]
    of_cells = rows.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()  # CELLS rows at most
    near, far = np.full((1 << cells.depth, cells.depth), np.inf), np.full((1 << cells.depth, cells.depth), -np.inf)
    number = np.zeros(1 << cells.depth, np.int64)
    for r in of_cells:
        near[r.cell], far[r.cell] = [r[f"min{i}"] for i in range(cells.depth)], [r[f"max{i}"] for i in range(cells.depth)]
        number[r.cell] = -(-r.n // SHARD)
    first = np.concatenate([[0], np.cumsum(number)])
    shards = max(1, int(first[-1]))
    places = F.array(*(F.lit(int(x)) for x in first[:-1]))
    many = F.array(*(F.lit(int(max(1, x))) for x in number))
    shard = F.get(places, "cell") + F.pmod(F.xxhash64("vec_id"), F.get(many, "cell")).cast("int")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("names", "marks", "lows", "highs")]
    held = rows.select(shard.alias("shard"), F.lit(0).alias("kind"), "vec_id", "label", "vec", *none)
    anchors = rows.where(is_anchor).select("vec_id", "label", "vec")

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors, once for each shard of the cells that their annuli meet."""
        for batch in batches:
            if not len(batch):
                continue
            x = unpack(batch.column(2).to_pylist(), d)
            labels = batch.column(1).to_numpy()
            square = (x * x).sum(1) + most
            slack = SLACK * np.sqrt(square) + SLACK
            lows = highs = None
            if batch.num_columns > 3:
                names, marks, lows, highs = (batch.column(i).to_pylist() for i in range(3, 7))
            else:  # the k-th best of the sample's rows of its label, or one more, as it may be among them, bounds the k-th best row
                lows = []
                for q, label in zip(x, labels, strict=True):
                    got = np.sort(products(q[None, :], some[some_labels == label], most)[0])[::-1]
                    lows.append([int(got[positives]) if len(got) > positives else FEWEST])
                highs = [[MOST]] * len(x)
                names = marks = [[0]] * len(x)
            outer = np.sqrt(np.maximum(0.0, square - 2.0 * np.array([float(min(v)) for v in lows]))) + slack
            inner = np.sqrt(np.maximum(0.0, square - 2.0 * np.array([float(max(v)) for v in highs]))) - slack
            least, largest = cells.bounds(asking(x), near, far)
            i, cell = np.nonzero((least - slack[:, None] <= outer[:, None]) & (largest + slack[:, None] >= inner[:, None]) & (number > 0))
            i = np.repeat(i, number[cell])
            to = np.concatenate([np.arange(first[c], first[c + 1]) for c in cell]) if len(cell) else np.zeros(0, np.int64)
            for a in range(0, len(i), 2048):
                some_i = pa.array(i[a : a + 2048])
                lists = [pa.array([v[j] for j in i[a : a + 2048]], pa.list_(pa.int64())) for v in (names, marks, lows, highs)]
                yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 2048].astype(np.int32)), pa.array(np.ones(len(some_i), np.int32)), *(batch.column(c).take(some_i) for c in range(3)), *lists], ["shard", "kind", "vec_id", "label", "vec", "names", "marks", "lows", "highs"])

    near_ones = searched(held.union(anchors.mapInArrow(sent, DEALT)), d, most, shards, True, positives)
    best = leading(near_ones.select("anchor_id", "vec_id", "score"), ["anchor_id"], positives).where("score >= 0")
    # low percent of the positive's score, rounded up, to high percent, rounded down
    window = best.select(F.col("anchor_id"), F.col("vec_id").alias("name"), F.col("score").alias("mark"), F.expr(f"cast(ceil(cast(score as decimal(38,0)) * {low} / 100) as long)").alias("low"), F.expr(f"cast(floor(cast(score as decimal(38,0)) * {high} / 100) as long)").alias("high"))
    windows = window.where("low <= high").groupBy("anchor_id").agg(F.collect_list(F.struct("name", "mark", "low", "high")).alias("w"))
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vec", "w.name", "w.mark", "w.low", "w.high")
    found = searched(held.union(asked.mapInArrow(sent, DEALT)), d, most, shards, False, k)
    found = leading(found, ["anchor_id", "name"], k)
    return found.select("anchor_id", F.col("name").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("mark").alias("positive_score"), F.col("score").alias("negative_score"))


#: A seventh of the rows takes the next of ten labels.
LABEL = "if(vec_id % 7 = 0, (label + 1) % 10, label)"

#: DuckDB: all products of anchors.
SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
), r AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


def brute_force(rows: list[tuple[int, list[float], int]], scale: int = SCALE) -> list[tuple]:
    """For tests: mined() of (vec_id, vector, label), all of them clean and with ids of their own."""
    whole = {i: ([int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows}
    out = []
    for a in (i for i in whole if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(v, whole[a][0], strict=True)) for i, (v, _) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][1] == whole[a][1]][:5]:
            fit = [i for i in order if whole[i][1] != whole[a][1] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fit[:10], 1)]
    return out
