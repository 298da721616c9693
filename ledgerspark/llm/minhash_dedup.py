"""MinHash near-dedup by bottom-k sketches of one hash function.

A document's set holds its 5-word shingles, as 64-bit hashes of BLAKE2 hashes of their words; its sketch is the K
smallest. Documents with equal sets are one class, which its smallest id stands for. Inverted lists of retained values
give candidates: two sets of Jaccard similarity 0.75 share NEED of K retained values or more, so they share one of
their K - NEED + 1 rarest, and only those are listed. Boilerplate is common, not rare, and makes no lists. In a list
each document pairs with the smallest one only, its hub. The union's sketch estimates the similarity and leaves out
what is far below; full sets, of words told apart byte by byte, verify the rest exactly.

Lists whose documents then lie in several components are gone through again, together for each hub: a pool. A pool's
largest component is dealt into blocks, the documents apart from it into others, of BLOCK shingles each; blocks apart
meet each other and those of the component. Sketches of a pair of blocks leave only documents that have a possible
partner in another component; their texts follow and are verified exactly, over shared shingles, and only links leave
the task. No list is expanded into pairs of rows.

NEED and ESTIMATE lie about six standard deviations below what two sets at the threshold share. By the binomial tail, a
link at the very threshold shares fewer than NEED of K values with a probability of 1.3 * 10 ** -9, and its estimate,
which takes 28 of 64, is too low with 2.5 * 10 ** -8; so often it's missed. Sets of up to FULL shingles, or K for the
estimate, have exact bounds.

Nulls: a null or blank text has an empty set and no links. A row whose id is null has no links and is kept. Rows that
share an id count as one document. Ties don't occur: ids decide. Texts may have any length and are taken whole. Other
columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import column, dropped, fresh, partitions, release, run_hashes, runs, slices, stored, tables, with_bits, with_key, word_bounds, word_hashes, words_of
from ledgerspark.llm.components import connected_components

WORDS, SIMILARITY = 5, 75
K, NEED, FULL, BLOCK = 64, 26, 48, 1 << 17
#: Estimates of pairs at the threshold stay above this but for 6 standard deviations of a sketch of 64.
ESTIMATE = 0.75 - 6 * (0.75 * 0.25 / K) ** 0.5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets, each ascending, in one array, and where each begins (one more entry than texts). The members are
    hashes; with exact, numbers that these texts' shingles have, equal if and only if all words are."""
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    w = words_of(data, starts, ends).indices.to_numpy().astype(np.uint64) + np.uint64(1) if exact else word_hashes(data, starts, ends)[0]
    h = numbered_runs(w, words) if exact else run_hashes(w, words)
    text = np.repeat(np.arange(len(counts)), counts)[: len(h)]
    valid = np.arange(len(h)) + words <= first[text + 1]
    h, text = h[valid], text[valid]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):  # as many words as there are, and zeros
        at = first[short][:, None] + np.arange(words)[None, :]
        padded = np.where(at < first[short + 1][:, None], w[np.minimum(at, len(w) - 1)], np.uint64(0)).ravel()
        few = _short_numbers(padded.reshape(-1, words), int(h.max()) + 1 if len(h) else 0) if exact else run_hashes(padded, words)[::words]
        h, text = np.concatenate([h, few]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = runs([text, h])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(counts) + 1))


def numbered_runs(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of width codes, equal for equal runs only."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    have, now = 1, codes
    while have < width:
        step = min(have, width - have)
        now = np.unique(now[:-step] << np.uint64(32) | now[step:], return_inverse=True)[1].astype(np.uint64)
        have += step
    return now


def _short_numbers(rows: np.ndarray, above: int) -> np.ndarray:
    return (np.unique(rows, axis=0, return_inverse=True)[1].ravel() + above).astype(np.uint64)


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, digest of the set, sketch for each row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, offsets, data in slices(batch):
                h, at = shingle_sets(data, offsets, words)
                n = np.diff(at)
                digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
                size = np.minimum(n, K)
                top = np.cumsum(size)
                pick = np.arange(size.sum()) - np.repeat(top - size, size) + np.repeat(at[:-1], size)
                sketch = pa.ListArray.from_arrays(pa.array(np.append(0, top), pa.int32()), pa.array(h[pick].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), sketch], ["doc_id", "n", "digest", "sketch"])
        release()

    return with_key(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def listed(sets: DataFrame) -> DataFrame:
    """value, node, n: the inverted lists, of each set's rarest retained values, that hold two nodes or more."""
    values = sets.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    need = F.when(F.col("n") <= FULL, F.ceil(F.col("n") * SIMILARITY / 100)).otherwise(F.lit(NEED)).cast("int")
    shared = values.join(often, "value").groupBy("node", "n", "size").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("shared"))
    room = F.col("size") - need + 1 - (F.col("size") - F.size("shared"))  # values that no other set retains come first
    return shared.where(room > 0).select("node", "n", F.explode(F.slice("shared", F.lit(1), F.least(room, F.size("shared")))).alias("s")).select("s.value", "node", "n")


def exact_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The texts' sets, by numbers that hold among these texts only."""
    data = np.frombuffer(b"".join(blobs := [t.encode() for t in texts]), np.uint8)
    offsets = np.append(0, np.cumsum([len(b) for b in blobs], dtype=np.int64))
    h, at = shingle_sets(data, offsets, words, True)
    return [h[a:b] for a, b in zip(at, at[1:], strict=False)]


def alike(shared, a, b):
    return 100 * shared >= SIMILARITY * (a + b - shared)


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets' similarity reaches the threshold: by estimate first, then exactly."""
    left, right = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    seen = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {SIMILARITY} * greatest(na, nb)")
    both = F.array_intersect("sa", "sb")
    # hashes are unsigned, their order as longs isn't; retained values of both are the smallest unsigned ones
    flip = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))
    union = F.transform(F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), flip)), 1, K), flip)
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    seen = seen.select("a", "b", whole.alias("whole"), F.size(both).alias("shared"), (F.col("na") + F.col("nb")).alias("total"), (F.size(F.array_intersect(union, both)) / F.size(union)).alias("estimate"))
    exact = stored(seen.where((F.col("whole") & (100 * F.col("shared") >= SIMILARITY * (F.col("total") - F.col("shared")))) | (~F.col("whole") & (F.col("estimate") >= ESTIMATE))).select("a", "b"))
    wanted = texts.join(exact.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    ready = exact.join(wanted.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(wanted.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def confirm(batches):
        for batch in batches:
            a, b = column(batch, "a"), column(batch, "b")
            ta, tb = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("ta", "tb"))
            hits, i = [], 0
            while i < len(a):
                place: dict[str, int] = {}
                size, j = 0, i
                while j < len(a) and size < CHARS:
                    for t in (ta[j], tb[j]):
                        if t not in place:
                            place[t] = len(place)
                            size += len(t)
                    j += 1
                own = exact_sets(list(place), words)
                for k in range(i, j):
                    x, y = own[place[ta[k]]], own[place[tb[k]]]
                    if alike(len(np.intersect1d(x, y, True)), len(x), len(y)):
                        hits.append(k)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(a[hits]), pa.array(b[hits])], ["a", "b"])
        release()

    return ready.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


CHARS = 4 << 20


def inverted(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order]


def shared_with(one: np.ndarray, value: np.ndarray, member: np.ndarray, n: int) -> np.ndarray:
    """How many members of the set `one` each of n sets holds; value, member: from inverted()."""
    lo, hi = np.searchsorted(value, one), np.searchsorted(value, one, "right")
    k = hi - lo
    return np.bincount(member[np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=n)


def estimates(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The similarities of a sketch with others by their unions' sketches."""
    out = np.empty(len(others))
    for i in range(0, len(others), 2048):
        some = others[i : i + 2048]
        size = np.array([len(o) for o in some])
        width = len(one) + int(size.max())
        rows = np.zeros((len(some), width), np.uint64)
        rows[:, : len(one)] = one
        rows[:, len(one) :][np.arange(width - len(one))[None, :] < size[:, None]] = np.concatenate(some)
        filled = np.arange(width)[None, :] < (len(one) + size)[:, None]
        rows[~filled] = np.iinfo(np.uint64).max
        rows.sort(1)
        new = np.ones(rows.shape, bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        rank = np.cumsum(new, 1)
        twice = ~new & (rank <= K) & filled
        most = np.minimum(K, (new & filled).sum(1))
        out[i : i + 2048] = twice.sum(1) / np.maximum(1, most)
    return out


def with_partner(i: int, j: int, component: np.ndarray, block: np.ndarray, n: np.ndarray, sketch: list[np.ndarray]) -> np.ndarray:
    """Which documents of the blocks i and j may have a link into another component, by their sketches."""
    out = np.zeros(len(n), bool)
    value, member = inverted(np.concatenate(sketch), np.repeat(np.arange(len(n)), [len(s) for s in sketch]))
    need = np.where(n <= FULL, -(-n * SIMILARITY // 100), NEED)
    for x in np.flatnonzero(block == i):
        shared = shared_with(sketch[x], value, member, len(n))
        near = (component != component[x]) & (shared >= np.minimum(need, need[x])) & (100 * np.minimum(n, n[x]) >= SIMILARITY * np.maximum(n, n[x]))
        if i != j:
            near &= block == j
        near = np.flatnonzero(near)
        if len(near):
            near = near[estimates(sketch[x], [sketch[y] for y in near]) >= ESTIMATE]
            out[near] = True
            out[x] |= len(near) > 0
    return out


def links_in_block(i: int, j: int, node: np.ndarray, component: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between components, of documents of block i with those of block j, over shared shingles. A pair is looked at
    only as long as its components are apart."""
    size = np.array([len(s) for s in sets])
    value, member = inverted(np.concatenate(sets), np.repeat(np.arange(len(sets)), size))
    component = component.copy()
    out = []
    for x in np.flatnonzero(block == i):
        hit = alike(shared_with(sets[x], value, member, len(sets)), size[x], size) & (component != component[x])
        if i != j:
            hit &= block == j
        for y in np.flatnonzero(hit):
            if component[y] != component[x]:
                out.append((int(node[x]), int(node[y])))
                component[component == component[x]] = component[y]
    return out


def pools(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """hub, i, j, node, component, block: pairs of blocks that hold all pairs of different components in open lists."""
    named = lists.join(parts, "node", "left").select("value", "node", "n", F.coalesce("component", "node").alias("component"))
    open_lists = named.groupBy("value").agg(F.min("node").alias("hub"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size")).where("c1 <> c2 and size > 2").select("value", "hub")
    # all pairs with the hub are known
    rows = stored(named.join(open_lists, "value").where("node <> hub").select("hub", "node", "n", "component").distinct())
    sums = rows.groupBy("hub", "component").agg(F.sum("n").alias("n"))
    main = sums.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    main = main.select("hub", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("inside"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("apart"))
    dealt = rows.join(main, "hub").withColumn("is_main", F.col("component") == F.col("main"))
    block = F.when(F.col("is_main"), F.col("apart") + F.pmod(F.xxhash64("node"), F.col("inside"))).otherwise(F.pmod(F.xxhash64("node"), F.col("apart"))).cast("int")
    dealt = dealt.withColumn("block", block)
    other = F.explode(F.when(F.col("is_main"), F.expr("sequence(0, apart - 1)")).otherwise(F.expr("sequence(0, apart + inside - 1)"))).alias("other")
    return dealt.select("hub", "node", "component", "block", other).select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "block")


def links(sets: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """a, b: enough verified links that components are exactly those of all links. sets: node, n, sketch."""
    lists = stored(listed(sets))
    in_lists = lists.select("node").distinct()
    texts = stored(with_bits(texts, "node", in_lists).join(in_lists, "node", "left_semi"))
    hubs = lists.groupBy("value").agg(F.min("node").alias("a"))
    starred = lists.join(hubs, "value").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = stored(verified(starred, sets, texts, words))
    parts = connected_components(found)
    n = partitions(texts)

    def possible(batches):
        for (_, i, j), t in tables(batches, 3):
            node, component, block, size = (t.column(x).to_numpy() for x in ("node", "component", "block", "n"))
            flat = t.column("sketch").combine_chunks()
            flat = flat.flatten().to_numpy().view(np.uint64) if isinstance(flat, pa.ListArray) else np.concatenate([c.flatten().to_numpy() for c in flat.chunks]).view(np.uint64)
            ends = np.cumsum(np.minimum(size, K))
            keep = with_partner(i, j, component, block, size, np.split(flat, ends[:-1]))
            if keep.any():
                yield t.select(["hub", "i", "j", "node", "component", "block"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    by = ("hub", "i", "j")
    cells = "hub long, i int, j int, node long, component long, block int"
    drawn = pools(lists, parts).join(sets, "node").select(*by, "node", "component", "block", "n", "sketch")
    few = stored(drawn.repartition(n, *by).sortWithinPartitions(*by, "node").mapInArrow(possible, cells))

    def confirmed(batches):
        for (_, i, j), t in tables(batches, 3):
            got = links_in_block(i, j, *(t.column(x).to_numpy() for x in ("node", "component", "block")), exact_sets(t.column("text").to_pylist(), words))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["a", "b"])
        release()

    read = few.join(texts, "node").select(*by, "node", "component", "block", "text").repartition(n, *by).sortWithinPartitions(*by, "node")
    out = stored(found.union(read.mapInArrow(confirmed, "a long, b long")))
    for done in (lists, texts, found, few):
        dropped(done)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    rows = stored(sketched(docs, words))
    known = rows.where("doc_id is not null and n > 0")
    classes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("node")))
    # a class's own row: the one with its smallest id
    sets = stored(known.join(classes, ["digest"]).where("doc_id = node").select("node", "n", "sketch").dropDuplicates(["node", "sketch"]))
    texts = with_key(docs).where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    found = links(sets, texts, words)
    parts = connected_components(found)
    dropped(sets)
    named = classes.join(parts, "node", "left").select(F.col("digest"), F.coalesce("component", "node").alias("component"))
    joined = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs' rows, all columns, without those that have a near duplicate with a smaller id in their component."""
    (gone_id,) = fresh(docs, "gone_id")
    gone = near_duplicates(docs, words).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS) -> list[tuple]:
    """For tests."""
    from ledgerspark.llm.reference import split_words

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = split_words((t or "").translate(lower))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    posting: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for j in posting.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            posting[x].append(i)
        for j, n in shared.items():
            if 100 * n >= SIMILARITY * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(rows)]
