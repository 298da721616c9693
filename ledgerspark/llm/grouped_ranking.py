"""The first k rows of each group, with exact counts of ties: an external merge tree.

Each task sorts its rows with Arrow into runs of up to RUN rows, by group, then tie columns, then order columns, and of each
group keeps the first k, with the run's count of each tie value among them; a run that has k better rows of a group can't
add to the ties of a row among the first k. A hash of the group comes first in the order, and ranges of equal width of it
cut all runs alike. A range's pieces of runs merge through one heap: rows of a group come out until their place exceeds k,
the merge looks ahead to the last tie value's end to finish its count, and the run's other rows of the group are skipped.

A group with more than a thousandth of a run (HOT) leaves k rows in each run, so its pieces first merge in nodes of
FAN tasks, nodes of FAN nodes and so on, and only the last nodes' rows join the others of the range. So no task's share
grows with a group or with the number of runs. Nothing but the number of nodes reaches the driver; nothing is broadcast.

All columns are long. Nulls come last in every column, are equal to each other, and a null in a group column is a group of
its own. Rows that repeat count each. Rows alike in all these columns are told apart by nothing, so they get
places in any order. An empty table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import fresh, partitions, stored, tables
from ledgerspark.shipping import ship

RUN, FAN, HOT, RANGES = 1 << 19, 64, 1 << 10, 4
LEAST_HOT = 64
HASH, CELL = 8, 9  # bytes of the group's hash, and of a column: whether it is null, then its value
SIGN = np.uint64(1 << 63)
BLOCKS = "range int, node long, rows binary, ties binary"


def encoded(columns: Sequence[pa.Array], descending: Sequence[bool]) -> np.ndarray:
    """Rows as bytes that compare as the rows do. The first column is the group's hash, never null."""
    n = len(columns[0])
    out = np.zeros((n, HASH + CELL * (len(columns) - 1)), np.uint8)
    for i, (c, down) in enumerate(zip(columns, descending, strict=True)):
        value = pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ SIGN
        at = HASH + CELL * (i - 1) if i else -1
        if i and c.null_count:
            out[:, at] = pc.is_null(c).to_numpy(zero_copy_only=False)
        out[:, at + 1 : at + 9] = (~value if down else value).astype(">u8").view(np.uint8).reshape(n, 8)
    return out


def decoded(rows: np.ndarray, i: int, down: bool) -> pa.Array:
    """Column i (from 0, after the hash) of encoded rows."""
    at = HASH + CELL * i
    value = np.ascontiguousarray(rows[:, at + 1 : at + 9]).view(">u8").ravel().astype(np.uint64)
    return pa.array((~value if down else value).__xor__(SIGN).view(np.int64), mask=rows[:, at].astype(bool))


def changes(rows: np.ndarray, width: int) -> np.ndarray:
    """Whether a row differs from the one before it in its first bytes."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :width] != rows[:-1, :width]).any(1)
    return new


def ordered(rows: np.ndarray) -> np.ndarray:
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)])
    return rows[pc.array_sort_indices(keys).to_numpy()]


def first_of_groups(rows: np.ndarray, k: int, group: int, tie: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows the first k of each group; counts of tie values, each at its first row; sizes of their groups."""
    starts = np.flatnonzero(changes(rows, group))
    sizes = np.diff(np.append(starts, len(rows)))
    place = np.arange(len(rows)) - np.repeat(starts, sizes)
    ties = np.zeros(len(rows), np.int64)
    pairs = np.flatnonzero(changes(rows, tie))
    ties[pairs] = np.diff(np.append(pairs, len(rows)))
    keep = place < k
    return rows[keep], ties[keep], np.repeat(sizes, sizes)[keep]


def merge(blocks: list[tuple[list[bytes], list[int]]], k: int, group: int, tie: int) -> tuple[list[bytes], list[int]]:
    """The same of several sorted blocks: rows in order and counts of tie values, each at its first row."""
    heads = [(rows[0], i, 0) for i, (rows, _) in enumerate(blocks) if rows]
    heapq.heapify(heads)
    out: list[bytes] = []
    ties: list[int] = []
    of, last, place, first = b"", b"", 0, 0
    while heads:
        row, i, at = heads[0]
        rows, counts = blocks[i]
        if row[:group] != of:
            of, last, place = row[:group], b"", 0
        at += 1
        if place < k:
            place += 1
            out.append(row)
            if row[:tie] == last:
                ties.append(0)
                ties[first] += counts[at - 1]
            else:
                last, first = row[:tie], len(ties)
                ties.append(counts[at - 1])
        elif row[:tie] == last:  # behind the first k, but their last tie value's count isn't full
            ties[first] += counts[at - 1]
        else:
            at = bisect_left(rows, of + b"\xff", at)
        if at < len(rows):
            heapq.heapreplace(heads, (rows[at], i, at))
        else:
            heapq.heappop(heads)
    return out, ties


def unpacked(table: pa.Table, width: int) -> list[tuple[list[bytes], list[int]]]:
    out = []
    for rows, ties in zip(table.column("rows").to_pylist(), table.column("ties").to_pylist(), strict=True):
        out.append(([rows[a : a + width] for a in range(0, len(rows), width)], np.frombuffer(ties, "<i8").tolist()))
    return out


def leaders(table: DataFrame, group: Sequence[str], ties: Sequence[tuple[str, bool]], order: Sequence[str], k: int) -> DataFrame:
    """The columns of group, ties (names and whether larger values come first) and order, with pos, from 1 by ties and then
    order within the group, up to k, and tied, the number of the group's rows with the same values of ties."""
    ship(table.sparkSession)
    names = [*group, *(n for n, _ in ties), *order]
    down = [False] * len(group) + [d for _, d in ties] + [False] * len(order)
    at_group, at_tie = HASH + CELL * len(group), HASH + CELL * (len(group) + len(ties))
    width = HASH + CELL * len(names)
    n = partitions(table)
    ranges = RANGES * n
    (key,) = fresh(table.select(*names), "h")

    def pieces(rows: np.ndarray, counts: np.ndarray, hot: np.ndarray, node: int) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes, bytes]] = []
        for which, of in ((~hot, -1), (hot, node)):
            part, count = rows[which], counts[which]
            if not len(part):
                continue
            top = np.ascontiguousarray(part[:, :4]).view(">u4").ravel().astype(np.uint64)
            place = ((top * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(part))
            out += [(int(place[a]), of, part[a:b].tobytes(), count[a:b].astype("<i8").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 4096], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "node", "rows", "ties"])

    def run(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = ordered(np.concatenate(held))
        total = len(rows)
        rows, counts, sizes = first_of_groups(rows, k, at_group, at_tie)
        yield from pieces(rows, counts, sizes > max(LEAST_HOT, total // HOT), TaskContext.get().partitionId())

    def leaf(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(encoded(batch.columns, [False, *down]))
            size += len(batch)
            if size >= RUN:
                yield from run(held)
                held, size = [], 0
        if held:
            yield from run(held)

    def node(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place, of), blocks in tables(batches, 2):
            rows, counts = merge(unpacked(blocks, width), k, at_group, at_tie)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([of], pa.int64()), pa.array([b"".join(rows)], pa.binary()), pa.array([np.array(counts, "<i8").tobytes()], pa.binary())], ["range", "node", "rows", "ties"])

    def root(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in tables(batches, 1):
            got, counts = merge(unpacked(blocks, width), k, at_group, at_tie)
            rows, ties = np.frombuffer(b"".join(got), np.uint8).reshape(-1, width), np.array(counts, np.int64)
            starts = np.flatnonzero(changes(rows, at_group))
            pos = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) + 1
            tied = ties[np.maximum.accumulate(np.where(changes(rows, at_tie), np.arange(len(rows)), 0))]
            yield pa.RecordBatch.from_arrays([*(decoded(rows, i, d) for i, d in enumerate(down)), pa.array(pos), pa.array(tied)], [*names, "pos", "tied"])

    coded = table.select(F.xxhash64(*group).alias(key), *(F.col(c).cast("long").alias(c) for c in names))
    runs = stored(coded.mapInArrow(leaf, BLOCKS))
    hot = runs.where("node >= 0")
    nodes = (hot.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > FAN:
        hot = hot.withColumn("node", F.expr(f"node div {FAN}")).repartition(n, "range", "node").sortWithinPartitions("range", "node").mapInArrow(node, BLOCKS)
        nodes = -(-nodes // FAN)
    schema = ", ".join(f"`{c}` long" for c in [*names, "pos", "tied"])
    return runs.where("node < 0").union(hot).repartition(n, "range").sortWithinPartitions("range").mapInArrow(root, schema)


def ranked_lines(lines: DataFrame, k: int = 2, folds: int = 5) -> DataFrame:
    """The first k sale lines by vendor, part of the assortment and month; those of a fifth of the sales (by the crc32 of
    sale_id's text) form one group. Amounts and discounts that no long can hold count as null."""
    one = f"coalesce(crc32(cast(cast(sale_id as string) as binary)) % {folds} = 0, false)"
    whole = "case when {0} between -9e18 and 9e18 then cast(floor({0}) as bigint) end"
    rows = lines.select(
        F.expr(f"if({one}, -1L, cast(vendor_id as bigint))").alias("vendor_id"),
        F.expr(f"if({one}, -1L, cast(coalesce(item_id % 5, -1) as bigint))").alias("part"),
        F.expr(f"if({one}, -1L, cast(coalesce(100 * year(shipped_at) + month(shipped_at), -1) as bigint))").alias("month"),
        F.expr("cast(floor(quantity / 10) as bigint)").alias("tens"),
        F.expr(whole.format("(100 * discount + 0.5D)")).alias("percent"),
        *(F.col(c).cast("long").alias(c) for c in ("sale_id", "line_no", "quantity")),
        F.expr(whole.format("(100 * amount + 0.5D)")).alias("amount_cents"),
    )
    best = leaders(rows, ["vendor_id", "part", "month"], [("tens", True), ("percent", False)], ["sale_id", "line_no", "quantity", "amount_cents"], k)
    return best.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: DuckDB: one window; crc32 from its table of 256, made by the rule.
SQL = """
WITH crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), one AS (
    SELECT sale_id FROM (SELECT DISTINCT sale_id, CAST(sale_id AS VARCHAR) AS s FROM sale_lines WHERE sale_id IS NOT NULL), crc
    WHERE xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 5 = 0
), line AS (
    SELECT CASE WHEN o.sale_id IS NULL THEN CAST(vendor_id AS BIGINT) ELSE -1 END AS vendor_id,
           CAST(CASE WHEN o.sale_id IS NULL THEN coalesce(item_id % 5, -1) ELSE -1 END AS BIGINT) AS part,
           CAST(CASE WHEN o.sale_id IS NULL THEN coalesce(100 * year(shipped_at) + month(shipped_at), -1) ELSE -1 END AS BIGINT) AS month,
           floor(quantity / 10) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent, CAST(l.sale_id AS BIGINT) AS sale_id,
           CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
    FROM sale_lines l LEFT JOIN one o ON o.sale_id = l.sale_id
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
           count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
    FROM line
)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM placed WHERE pos <= 2
"""


def brute_force(rows: list[dict], k: int = 2) -> list[tuple]:
    """For tests: ranked_lines() of dicts."""
    import math

    groups: dict[tuple, list] = {}
    for r in rows:
        sale = r["sale_id"]
        if sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0:
            key = (-1, -1, -1)
        else:
            key = (r["vendor_id"], -1 if r["item_id"] is None else r["item_id"] % 5, -1 if r["shipped_at"] is None else 100 * r["shipped_at"].year + r["shipped_at"].month)
        whole = lambda x: None if x is None or not math.isfinite(x) or abs(x) > 1e16 else math.floor(100 * x + 0.5)
        tens = None if r["quantity"] is None else r["quantity"] // 10
        groups.setdefault(key, []).append(((tens is None, -(tens or 0)), whole(r["discount"]), sale, r["line_no"], r["quantity"], whole(r["amount"])))
    last = lambda x: (x is None, x or 0)
    out = []
    for key, members in groups.items():
        members.sort(key=lambda m: (m[0], *map(last, m[1:])))
        for pos, m in enumerate(members[:k], 1):
            out.append((*key, pos, pos, *m[2:5], m[1], m[5], sum(x[:2] == m[:2] for x in members)))
    return out
