"""The ten operators against brute force and the libraries, on edge cases: nulls, empty and long texts, ties, repeated
rows, empty tables, and other columns with names that operators use themselves."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import byte_bpe, hilbert_search, language_id, line_dedup, minhash_dedup, mtree_search, packing, substring_dedup, suffix_dedup, token_counts
from ledgerspark.llm.hilbert import hilbert

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, key string, spans string, __x string"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = some(70), some(120)
    out = [some(rng.randint(1, 200)) for _ in range(n // 3)]
    out += [f"{some(20)}\n{passage}\n{some(10)}" for _ in range(n // 6)]
    for _ in range(n // 6):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [base, base, out[0], out[1], "", " \n\t", "one", "One", "a b c d", "a b c d", "x" * 3000, "x " * 2000, "é" * 60, "é" * 60]
    out += ["A line of some length here\nAnother line, not short at all", "A line of some length hera\n\nx\nx", "A line of some length her"]
    rng.shuffle(out)
    return out


def rows():
    return list(enumerate(texts())) + [(900, None)]


def frame(spark, data, parts=3):
    full = [(i, t, random.Random(i or 0).choice(["en", "fr", None]), "s", 1, "c", "k", "key", "sp", "x") for i, t in data]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, one id with two texts."""
    t = " ".join(f"w{i}" for i in range(80))
    return frame(spark, [(None, t), (None, None), (5, t), (5, t), (7, t), (7, "other text"), (3, "b")])


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_minhash(docs, empty, odd):
    assert got(minhash_dedup.near_duplicates(docs)) == sorted(minhash_dedup.brute_force(rows()), key=str)
    assert got(minhash_dedup.near_duplicates(empty)) == []
    out = minhash_dedup.near_duplicates(odd).collect()
    assert len(out) == 7 and {r.component_id for r in out if r.doc_id == 5} == {5} and all(r.kept for r in out if r.doc_id is None)
    kept = minhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in minhash_dedup.brute_force(rows()))


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_words_that_polynomials_confuse(spark):
    """Words of 1,024 characters whose polynomial hashes modulo 2 ** 64 are equal."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    five = [(1, f"{x} q r s t"), (2, f"{y} q r s t")]
    fifty = [(1, f"{x} " + " ".join(f"w{i}" for i in range(49))), (2, f"{y} " + " ".join(f"w{i}" for i in range(49)))]
    assert got(minhash_dedup.near_duplicates(frame(spark, five))) == sorted(minhash_dedup.brute_force(five), key=str)
    assert all(r.n_removed == 0 for r in substring_dedup.digest(frame(spark, fifty)).collect())


def near_group(n=60, edits=12, seed=5):
    """Copies of one text with so many words changed that some are linked with some only."""
    rng = random.Random(seed)
    base = [f"v{i}" for i in range(300)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(300)] = f"u{rng.random()}"
        out.append(" ".join(w))
    return list(enumerate(out))


def test_minhash_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2000)
    for seed in (5, 6):
        data = near_group(seed=seed)
        assert got(minhash_dedup.near_duplicates(frame(spark, data))) == sorted(minhash_dedup.brute_force(data), key=str)


def test_minhash_clashing_names(spark):
    data = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other", "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, gone_id string").withColumn("__id", F.lit(1)).withColumn("_gone_id", F.lit(2))
    kept = minhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}


def test_minhash_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    pairs = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    up = list(range(40))
    root = lambda i: i if up[i] == i else root(up[i])
    for i, j in pairs:
        up[root(i)] = root(j)
    want = [root(i) for i in range(40)]
    up = list(range(40))
    block = np.arange(40) % 3
    for i, j in [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]:
        at = np.flatnonzero((block == i) | (block == j))
        for a, b in minhash_dedup.links_in_block(i, j, at, at, block[at], [sets[x] for x in at]):
            up[root(a)] = root(b)
    assert len({(a, root(i)) for i, a in enumerate(want)}) == len(set(want)) == len({root(i) for i in range(40)})


def test_lines(docs, empty, odd):
    want = sorted(((i, n, k, t) for i, n, k, t in line_dedup.brute_force(rows())), key=str)
    assert got(line_dedup.line_dedup(docs)) == want
    assert got(line_dedup.line_dedup(empty)) == []
    assert line_dedup.line_dedup(odd).count() == 7
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns


def test_lines_edits_and_lengths(spark, monkeypatch):
    """Near lines of many lengths, very long ones too, with ties; and a line that is most of all lines, dealt over keys."""
    rng = random.Random(9)
    data = []
    for i, n in enumerate([16, 17, 31, 33, 60, 64, 65, 100, 257, 1000, 5000, 20000]):
        line = "".join(rng.choice("abc é") for _ in range(n)).strip().ljust(16, "x")
        at = rng.randrange(len(line))
        near = {0: line[:at] + "Z" + line[at:], 1: line[:at] + line[at + 1 :], 2: line[:at] + "Z" + line[at + 1 :]}[i % 3].strip(" ")
        far = line[: at // 2] + "QQ" + line[at // 2 :]
        data += [(3 * i, f"{line}\nsame for all of them"), (3 * i + 1, f"same for all of them\n{near}\n{near}"), (3 * i + 2, far)]
    for hot in (1000, 2):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert got(line_dedup.line_dedup(frame(spark, data))) == sorted(line_dedup.brute_force(data), key=str)


def test_clashing_names(spark):
    """Other columns called as operators might call their own."""
    t = " ".join(f"w{i}" for i in range(80))
    names = ["__gone", "__id", "__spans", "__key", "gone_from", "gone_lines", "doc_number", "may_have", "span_id", "span_key", "spans_found", "text_was", "word", "bits", "lang_pred"]
    docs = spark.createDataFrame([(1, t), (2, t + " more of it"), (3, "A line that repeats itself\nA line that repeats itself"), (4, t)], "doc_id long, text string").select("*", *(F.lit("x").alias(n) for n in names))
    for kept in (line_dedup.without_repeated_lines(docs), substring_dedup.without_repeats(docs), minhash_dedup.one_of_each(docs), language_id.identified(docs.withColumn("lang", F.lit("en")), 0.0).drop("lang")):
        assert kept.columns == docs.columns and kept.count() >= 2


def test_packing(spark, docs, empty, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.NAME))
    want = {}
    for i, x in rows():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    out = packing.packed(docs, P.path(packing.NAME)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) == plain_best_fit([r.length for r in out])
    assert packing.packed(empty, P.path(packing.NAME)).count() == 0
    assert packing.packed(odd, P.path(packing.NAME)).count() == 7


def plain_best_fit(lengths, room=2048):
    """How many sequences best fit needs, one piece after the other, longest first."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else room) - n)
    return len(free)


def test_best_fit():
    rng = random.Random(2)
    for _ in range(100):
        room = rng.choice([8, 20, 2048])
        counts = {rng.randint(1, room): rng.randint(1, 900) for _ in range(rng.randint(1, min(room, 40)))}
        ranks, bins = collections.defaultdict(set), collections.defaultdict(list)
        for n, r, k, s, o in packing.best_fit(counts, room):
            for i in range(k):
                assert r + i not in ranks[n]
                ranks[n].add(r + i)
                bins[s + i].append((o, n))
        assert all(ranks[n] == set(range(c)) for n, c in counts.items())
        assert len(bins) == plain_best_fit([n for n, c in counts.items() for _ in range(c)], room)
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= room


def test_suffixes(docs, empty, odd):
    assert got(suffix_dedup.digest(docs)) == sorted(suffix_dedup.brute_force(rows()), key=str)
    assert got(suffix_dedup.digest(empty)) == []
    out = suffix_dedup.digest(odd).collect()
    assert len(out) == 7 and sum(r.n_removed > 0 for r in out) == 1


def test_substrings_and_suffixes_with_many_spans(docs, odd, monkeypatch):
    """Beyond the size up to which spans are broadcast."""
    monkeypatch.setattr(substring_dedup, "FEW_SPANS", -1)
    assert got(substring_dedup.digest(docs)) == sorted(substring_dedup.brute_force(rows()), key=str)
    assert got(suffix_dedup.digest(docs)) == sorted(suffix_dedup.brute_force(rows()), key=str)
    assert len(substring_dedup.digest(odd).collect()) == 7 and substring_dedup.without_repeats(docs).columns == docs.columns


def test_substrings(docs, empty, odd):
    assert got(substring_dedup.digest(docs)) == sorted(substring_dedup.brute_force(rows()), key=str)
    assert got(substring_dedup.digest(empty)) == []
    out = substring_dedup.digest(odd).collect()
    assert len(out) == 7 and sum(r.n_removed > 0 for r in out) == 1
    assert substring_dedup.without_repeats(docs).columns == docs.columns


def test_without_repeats_keeps_white_space_and_drops_what_is_covered(spark):
    t = [f"w{i}" for i in range(60)]
    data = [(1, " ".join(t)), (2, "\n".join(t)), (3, "before\tit \n" + "\n".join(t) + "\n\nafter\tit"), (4, " \n"), (5, None)]
    kept = {r.doc_id: r.text for r in substring_dedup.without_repeats(frame(spark, data)).collect()}
    assert kept == {1: data[0][1], 3: "before\tit\n\nafter\tit", 4: " \n", 5: None}


def test_one_window_in_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    data = [(i, f"{passage} own{i} " + " ".join(f"{i}x{k}" for k in range(i % 7))) for i in range(300)]
    assert got(substring_dedup.digest(frame(spark, data, 7))) == sorted(substring_dedup.brute_force(data), key=str)


def test_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(150_000))  # a megabyte
    data = [(1, long), (2, "start " + long[: len(long) // 2]), (3, "short")]
    assert got(substring_dedup.digest(frame(spark, data))) == sorted(substring_dedup.brute_force(data), key=str)
    assert got(minhash_dedup.near_duplicates(frame(spark, data))) == sorted(minhash_dedup.brute_force(data), key=str)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digest(frame(spark, data)).collect()}[2] >= len(long) // 2 - 100


ODD = ["", "a" * 500, "中" * 50, "x  y \n z\t\t", "it's <|endoftext|> a  <|endoftext|>", "é İ    　x", "\x1c \x85", "1234 !!! \U0001f600"]


def test_byte_bpe(spark, docs, empty):
    import tiktoken

    with open(P.path(byte_bpe.NAME), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    data = rows() + [(1000 + i, t) for i, t in enumerate(ODD)]
    want = []
    for i, t in data:
        ids = e.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    df = frame(spark, data)
    assert got(byte_bpe.digest(df, P.path(byte_bpe.NAME), P.PATTERN)) == sorted(want, key=str)
    assert byte_bpe.digest(empty, P.path(byte_bpe.NAME), P.PATTERN).count() == 0
    ids = byte_bpe.encoded(df, P.path(byte_bpe.NAME), P.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decoded(ids, P.path(byte_bpe.NAME), P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in data}


def test_token_counts(spark, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(token_counts.NAME))
    data = rows() + [(1000 + i, x) for i, x in enumerate(ODD)]
    want = []
    for i, x in data:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 512))
    assert got(token_counts.token_counts(frame(spark, data), P.path(token_counts.NAME))) == sorted(want, key=str)
    assert token_counts.token_counts(empty, P.path(token_counts.NAME)).count() == 0


def vectors(spark, zero=True):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[50:60] = x[40]
    data = [(int(i), [float(v) for v in e], "x") for i, e in enumerate(x)]
    bad = [(1000, None, "x"), (1020, [], "x"), (1040, [float("nan")] * 16, "x"), (1060, [None] + [1.0] * 15, "x"), (1080, [float("inf")] * 16, "x"), (1100, [1.0] * 5, "x"), (None, [1.0] * 16, "x")]
    return x.astype(np.float64), spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, score string")


def test_mtree(spark):
    x, df = vectors(spark)
    whole = np.floor(64 * x).astype(np.int64)
    s = whole[::20] @ whole.T
    want = []
    for i in range(len(s)):
        order = sorted((j for j in range(300) if j != 20 * i), key=lambda j: (-s[i, j], j))[:20]
        want += [(20 * i, r + 1, j, int(s[i, j])) for r, j in enumerate(order)]
    assert got(mtree_search.top_k(df)) == sorted(want, key=str)
    assert mtree_search.top_k(df.limit(0)).count() == 0


def test_hilbert(spark):
    g = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)], np.uint64)
    place = hilbert(g, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert np.abs(np.diff(g[np.argsort(place)].astype(int), axis=0)).sum(1).max() == 1
    x, df = vectors(spark)
    s = x[::20] @ x.T
    found = collections.defaultdict(dict)
    for r in hilbert_search.nearest(df).collect():
        assert abs(r.score - s[r.query_id // 20, r.vec_id]) < 1e-12 and r.vec_id != r.query_id
        found[r.query_id][r["rank"]] = r.vec_id
    hits = 0
    for i in range(len(s)):
        order = sorted((j for j in range(300) if j != 20 * i), key=lambda j: (-s[i, j], j))[:20]
        hits += len(set(order) & set(found[20 * i].values()))
    assert hits >= 0.9 * 20 * len(s)
    assert hilbert_search.nearest(df.limit(0)).count() == 0


def test_hilbert_windows_recall(spark):
    """More rows than a window holds."""
    x = np.random.default_rng(8).standard_normal((3000, 16)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    s = x[::20] @ x.T
    found = collections.defaultdict(set)
    for r in hilbert_search.nearest(df).collect():
        found[r.query_id].add(r.vec_id)
    s[np.arange(len(s)), np.arange(0, 3000, 20)] = -np.inf
    hits = sum(len(found[20 * i] & set(np.argsort(-s[i])[:20].tolist())) for i in range(len(s)))
    assert hits >= 0.9 * 20 * len(s)


def test_searches_with_repeated_ids_and_zeros(spark):
    """Rows that share an id are one candidate, with the best score; op6 leaves zero vectors out, op8 doesn't."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[100:112] = x[0] * 3 + rng.standard_normal((12, 8)).astype(np.float32) / 100
    ids = list(range(400))
    for i in range(100, 112):
        ids[i] = 41
    x[7] = 0
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in zip(ids, x)], "vec_id long, embedding array<float>").withColumn("query_id", F.lit(1)).withColumn("vec", F.lit(2))
    exact = x.astype(np.float64)
    for run, points, left_out in ((hilbert_search.nearest, exact, {7}), (mtree_search.top_k, np.floor(64 * exact), set())):
        rows = collections.defaultdict(list)
        for r in run(df).collect():
            rows[r.query_id].append((r["rank"], r.vec_id, r.score))
        for q in range(0, 400, 20):
            if q == 100:
                continue
            best = {}
            for i, e in zip(ids, points):
                if i != q and i not in left_out:
                    best[i] = max(best.get(i, -np.inf), float(points[q] @ e))
            want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:20]
            have = sorted(rows[q])
            assert len(have) == 20 and len({i for _, i, _ in have}) == 20
            if run is mtree_search.top_k:
                assert [(i, int(s)) for i, s in want] == [(i, s) for _, i, s in have]
            assert have[0][1] == want[0][0] or run is hilbert_search.nearest


def test_language(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert language_id.language_id(empty).count() == 0
    none = language_id.language_id(frame(spark, [(1, None), (2, ""), (3, "12 !?"), (None, "and the")])).collect()
    assert len(none) == 4 and all(r.lang_pred == "und" for r in none if r.doc_id)


def test_language_brute_force(spark, sf):
    """The whole model and every prediction, word by word, on real texts with repeats, clashes, long texts and none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").select("doc_id", "text", "lang")
    data = [tuple(r) for r in docs.collect()]
    data += [(data[0][0], data[0][1], "xx"), (2000, None, "en"), (2001, "", None), (2002, "12 34", "en"), (2003, data[1][1] * 40, None), (None, data[2][1], "fr")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in data], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    for most in (5, 1000):
        chosen = [tuple(r) for r in language_id.sampled(df, most).collect()]
        usable = [(lang, t) for i, t, lang in data if i is not None and lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
        count = collections.Counter(lang for lang, _ in usable)
        assert collections.Counter(lang for lang, _ in chosen) == {k: min(most, n) for k, n in count.items()} and set(chosen) <= set(usable)
        want = sorted(language_id.brute_force(data, chosen), key=str)
        have = sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(df, most).collect()), key=str)
        assert [w[:2] for w in want] == [h[:2] for h in have]
        assert all(abs(w[2] - h[2]) < 1e-9 for w, h in zip(want, have, strict=True))


def test_pipeline(spark, tmp_path):
    """run() against the operators' brute-force versions, stage after stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    path = str(tmp_path / "documents.parquet")
    data = [(i, t, "en" if i % 3 else "fr", "s", 0) for i, t in rows()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = [(r.doc_id, r.text) for r in language_id.identified(docs, pipeline.LEAST_SCORE).collect()]
    assert all(t and any(c.isalpha() for c in t) for _, t in kept)
    lines = [(i, t) for (i, n, k, t) in line_dedup.brute_force(sorted(kept)) if not k or t.strip()]
    near = {i for i, _, _, stays in minhash_dedup.brute_force(lines) if stays}
    left = [(i, t) for i, t in lines if i in near]
    cut = {r[0]: r[2] for r in substring_dedup.brute_force(left)}
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(cut)
    whole = {i: len(Tokenizer.from_file(P.path(packing.NAME)).encode(t, add_special_tokens=False).ids) + 1 for i, t in left if not cut[i]}
    size = collections.Counter()
    for r in out:
        size[r.doc_id] += r.length
    assert all(size[i] == n for i, n in whole.items())
