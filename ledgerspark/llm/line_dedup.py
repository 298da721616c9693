"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line, without the blanks around it, goes if an earlier one (smaller doc_id, then smaller line number) equals it or,
where both have MIN_CHARS characters or more, is one edit (insertion, deletion, substitution) away. Both are judged on
the input, so the result doesn't depend on order. Blank lines stay.

Equal lines meet by 128 bits of hash and keep their earliest place. Two lines one edit apart agree in the first or the
last half, so keys of halves find the few lines that can have a partner: shared keys are counted exactly, and a bitmap of
them (2 ** 18 words of 64 bits at most, hence broadcast) leaves out the other lines before their text travels. Of what is
left, shared keys of halves, quarters and so on narrow down where the edit is, to FEW characters, so that very long
lines need no more variants than short ones. Those lines emit all variants with one character deleted there as hashed
keys: with the position, where equal variants mean a substitution, and without it, where a variant that equals a
whole line means an insertion. A key needs only its earliest line, not all pairs, however many lines share it;
levenshtein() verifies each pair found.

Nulls: a null text has no lines. A row whose id is null keeps all its lines and removes none. Rows that share an id
count as one document: lines at the same place in them don't remove each other. Ties don't occur: places decide. Columns
beside doc_id and text, whatever their names, are passed on unread by without_repeated_lines. The edit bound is 1, a
fixed value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import fresh, partitions, stored

MIN_CHARS, WORDS, HOT, FEW = 16, 1 << 18, 1000, 32
NO_BITS = 31


def _keys(line: str, n: str) -> dict[str, str]:
    """SQL for the keys of halves: two lengths of the shorter line come into question, each with two halves."""
    out = {}
    for i, h in enumerate((f"(({n} - 1) div 2)", f"(({n} - 2) div 2)")):
        out[f"k{i}a"] = f"xxhash64(0, {h}, left({line}, cast({h} as int)))"
        out[f"k{i}b"] = f"xxhash64(1, {h}, right({line}, cast({h} as int)))"
    return out


def _split(parts: str, line: str) -> str:
    """SQL for an array of structs of key, s, f, b out of `parts`, an array of structs of s, f, b: two lines, the shorter of
    s characters, that are one edit apart and agree in the first f and the last b characters, agree in half of the
    others too, before or behind the edit. Where few characters are left, a part stays as it is."""
    halves = "array(struct(p.s as s, p.f + (p.s - p.f - p.b) div 2 as f, p.b as b), struct(p.s as s, p.f as f, p.b + (p.s - p.f - p.b) div 2 as b))"
    split = f"flatten(transform({parts}, p -> if(p.s - p.f - p.b > {FEW}, {halves}, array(p))))"
    return f"transform({split}, p -> struct(xxhash64(p.s, p.f, p.b, left({line}, cast(p.f as int)), right({line}, cast(p.b as int))) as key, p.s as s, p.f as f, p.b as b))"


def _narrowed(lines: DataFrame) -> DataFrame:
    """The lines that share a half of one of their parts with another line, with those halves as parts."""
    halves = lines.select("h1", "h2", F.explode(F.expr(_split("parts", "line"))).alias("q")).select("h1", "h2", "q.*").distinct()
    shared = halves.groupBy("key").agg(F.count_distinct("h1", "h2").alias("c")).where("c > 1").select("key")
    parts = halves.join(shared, "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("s", "f", "b")).alias("parts"))
    return stored(lines.drop("parts").join(parts, ["h1", "h2"]))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, no, line, place, h1, h2 for the lines that aren't blank."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    rows = rows.select("doc_id", "no", F.btrim("line").alias("line")).where("line <> ''")
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << NO_BITS).cast("decimal(10,0)") + F.col("no")).cast("decimal(38,0)")
    return rows.select("*", place.alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def near_lines(lines: DataFrame, unique: DataFrame) -> DataFrame:
    """h1, h2 of lines whose earliest place comes after that of a line one edit away."""
    own = _keys("line", "n")
    keys = unique.where(f"n >= {MIN_CHARS}").select(F.explode(F.array_distinct(F.array(*own))).alias("key"))
    often = stored(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    word = lambda k: f"shiftrightunsigned({k}, 6) & {WORDS - 1}"
    bits = often.groupBy(F.expr(word("key")).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits"))
    bits = F.broadcast(bits)  # at most WORDS rows
    found = lines.withColumn("n", F.length("line").cast("long")).where(f"n >= {MIN_CHARS}").select("line", "place", "h1", "h2", "n", *(F.expr(e).alias(k) for k, e in own.items()))
    hit = []
    for k in own:
        found = found.join(bits.select(F.col("word").alias(f"w_{k}"), F.col("bits").alias(f"b_{k}")), F.expr(word(k)) == F.col(f"w_{k}"), "left")
        hit.append(f"coalesce(bit_get(b_{k}, cast({k} & 63 as int)), 0) = 1")
    maybe = found.where(" or ".join(hit)).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min("line").alias("line"))
    maybe = stored(maybe.withColumn("n", F.length("line").cast("long")))

    # the shorter line of a pair has n or n - 1 characters; at first nothing is known of where they agree
    alive = maybe.withColumn("parts", F.expr("transform(array(n, n - 1), s -> struct(s as s, 0L as f, 0L as b))"))
    for _ in range(2):
        alive = _narrowed(alive)
    while alive.where(f"exists(parts, p -> p.s - p.f - p.b > {FEW})").limit(1).count():
        alive = _narrowed(alive)

    # a line makes many variants: small input, much work, so it's spread out by hand
    places = "array_distinct(flatten(transform(parts, p -> sequence(p.f + 1, n - p.b))))"
    cut = alive.repartition(partitions(lines), "h1").select("place", "line", F.explode(F.expr(f"transform({places}, i -> cast(i as int))")).alias("i")).select("place", F.explode(F.expr("array(struct(false as whole, xxhash64(0, i, left(line, i - 1), substr(line, i + 1)) as key), struct(false as whole, xxhash64(1, concat(left(line, i - 1), substr(line, i + 1))) as key))")).alias("v"))
    # a substitution's key has its position in it; whole lines stand only among the keys without
    whole = alive.select("place", F.struct(F.lit(True).alias("whole"), F.xxhash64(F.lit(1), "line").alias("key")).alias("v"))
    variants = cut.union(whole).select("place", "v.whole", "v.key").distinct()
    first = variants.groupBy("key").agg(F.min(F.when(F.col("whole"), F.col("place"))).alias("own"), F.min(F.when(~F.col("whole"), F.col("place"))).alias("other"), F.count("*").alias("c")).where("c > 1")
    # with a whole line in the group its other members are one insertion away from it, not from each other
    partner = F.when(F.col("own").isNull(), F.col("other")).when(F.col("whole"), F.col("other")).otherwise(F.col("own"))
    pairs = variants.join(first, "key").select("place", partner.alias("earlier")).where("earlier < place").distinct()
    texts = alive.select("place", "line", "h1", "h2")
    checked = pairs.join(texts, "place").join(texts.select(F.col("place").alias("earlier"), F.col("line").alias("earlier_line")), "earlier")
    return checked.where(F.levenshtein("line", "earlier_line", 1).between(0, 1)).select("h1", "h2").distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, gone: the numbers (from 0) of the lines of each document that go, where any do."""
    lines = lines_of(docs)
    unique = stored(lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("times"), *(F.max(F.expr(e)).alias(k) for k, e in _keys("line", "length(line)").items()), F.max(F.length("line")).alias("n")))
    near = near_lines(lines, unique).withColumn("near", F.lit(True))
    fate = unique.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").where("times > 1 or near")
    # a line that is more than a thousandth of all lines is dealt over several keys; there are under HOT of them
    total = unique.agg(F.sum("times")).first()[0] or 0
    shares = F.expr(f"cast(1 + (times * {HOT}) div {max(1, total)} as int)")
    hot = unique.where(F.col("times") * HOT > total).select("h1", "h2", shares.alias("shares"))
    salted = lines.select("h1", "h2", "doc_id", "no", "place").join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.expr("coalesce(pmod(xxhash64(place), shares), 0)")).drop("shares")
    fate = fate.withColumn("salt", F.explode(F.expr(f"sequence(0L, (times * {HOT}) div {max(1, total)})")))
    gone = salted.join(fate, ["h1", "h2", "salt"]).where("near or place > first")
    return gone.groupBy("doc_id").agg(F.collect_set("no").alias("gone"))


def _joined(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, whose name comes back: the numbers of the lines that go."""
    own, gone = fresh(docs, "gone_from", "gone_lines")
    found = repeated_lines(docs).select(F.col("doc_id").alias(own), F.col("gone").alias(gone))
    return docs.join(found, F.col("doc_id").cast("long") == F.col(own), "left").drop(own), gone


def _kept(gone: str, text: str = "text") -> str:
    """SQL for the text without its lines in `gone`."""
    # the array of one holds the split text, or it would be split again for each line
    return f"transform(array(split(`{text}`, '\\n')), s -> array_join(transform(array_except(sequence(0, size(s) - 1), `{gone}`), i -> s[i]), '\\n'))[0]"


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text for each row of docs. Blank lines count."""
    rows, name = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = F.coalesce(F.size(name), F.lit(0))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    kept = F.when(F.col(name).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.expr(_kept(name)))
    return rows.select("doc_id", lines.cast("long").alias("n_lines"), F.least(gone, lines).cast("long").alias("n_removed"), kept.alias("kept_text"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs' rows and columns with repeated lines cut out of text; documents of which only blanks are left go."""
    rows, gone = _joined(docs)
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.expr(_kept(gone))))
    return rows.where(F.col(gone).isNull() | (F.btrim(F.regexp_replace("text", r"\s+", " ")) != "")).drop(gone)


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB: pairs that share a half, told by levenshtein(); no variants.
SQL = f"""
WITH doc AS (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), line AS (
    SELECT doc_id, i AS no, trim(parts[i], ' ') AS line
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM doc)
), uniq AS (
    SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM line WHERE line <> '' GROUP BY line
), half AS (
    SELECT DISTINCT line, n, first, h, 0 AS side, left(line, h) AS part
    FROM (SELECT *, unnest([(n - 1) // 2, (n - 2) // 2]) AS h FROM uniq WHERE n >= {MIN_CHARS})
    UNION
    SELECT DISTINCT line, n, first, h, 1 AS side, right(line, h) AS part
    FROM (SELECT *, unnest([(n - 1) // 2, (n - 2) // 2]) AS h FROM uniq WHERE n >= {MIN_CHARS})
), near AS (
    SELECT DISTINCT a.line FROM half a JOIN half b ON a.h = b.h AND a.side = b.side AND a.part = b.part
    WHERE b.first < a.first AND abs(a.n - b.n) <= 1 AND a.line <> b.line AND
          (
            (a.n = b.n AND len(list_filter(range(1, a.n + 1), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) = 1)
            OR (a.n = b.n + 1 AND len(list_filter(range(1, a.n + 1), lambda i: left(a.line, i - 1) || substr(a.line, i + 1) = b.line)) > 0)
            OR (b.n = a.n + 1 AND len(list_filter(range(1, b.n + 1), lambda i: left(b.line, i - 1) || substr(b.line, i + 1) = a.line)) > 0)
          )
), marked AS (
    SELECT l.doc_id, l.no, u.line IS NOT NULL AND (n.line IS NOT NULL OR (l.doc_id, l.no) > u.first) AS gone
    FROM line l LEFT JOIN uniq u ON u.line = l.line LEFT JOIN near n ON n.line = l.line
), gone AS (
    SELECT doc_id, list(no) FILTER (gone) AS nos FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.nos), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(d.parts) + 1), lambda i: NOT list_contains(coalesce(g.nos, []), i)), lambda i: d.parts[i]), chr(10)), '')) AS kept_sha256
FROM doc d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """For tests: doc_id, n_lines, n_removed, kept text."""
    places = sorted((i, k, x.strip(" ")) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" "))
    first: dict[str, tuple[int, int]] = {}
    for i, k, x in places:
        first.setdefault(x, (i, k))

    def close(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]

    near = {a for a in first for b in first if a != b and min(len(a), len(b)) >= MIN_CHARS and first[b] < first[a] and close(a, b)}
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if not (y := x.strip(" ")) or (y not in near and first[y] >= (i, k))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
