"""The pipeline's documents and token totals, all of them, against the stages' brute-force versions."""

import collections
import random
import re

import corpus_pipeline as pipeline
import public_tokenizers as P
from test_operators import rows
from tokenizers import Tokenizer

from ledgerspark.llm import language_id, line_dedup, minhash_dedup, packing
from ledgerspark.llm.reference import split_words
from ledgerspark.llm.substring_dedup import WORDS


def cut(docs):
    """doc_id -> text without the words of windows that a smaller document has, each with the white space before it."""
    windows = lambda w: [tuple(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1)]
    split, first = {i: split_words(t) for i, t in docs}, {}
    for i, w in split.items():
        for x in windows(w):
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, t in docs:
        gone = {k + j for k, x in enumerate(windows(split[i])) if first[x] < i for j in range(WORDS)}
        parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)
        tail = t[len("".join(parts)) :]
        out[i] = "".join(x for k, x in enumerate(parts) if k not in gone) + tail if gone else t
    return out


def test_all_documents_and_totals(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = sorted({w for _, t in rows() for w in split_words(t or "") if w.isalpha() and len(w) < 8})
    long = [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(2)]
    covered = "\n".join(" ".join(t.split()[:60]) for t in long)
    data = [*rows(), (1001, long[0]), (1002, long[1]), (1003, covered)]
    spark.createDataFrame([(i, t, "en" if i % 3 else "fr", "s", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in language_id.identified(spark.read.parquet(f"{tmp_path}/documents.parquet"), pipeline.LEAST_SCORE).collect()]
    lines = [(i, t) for i, n, k, t in line_dedup.brute_force(sorted(kept)) if not k or t.strip()]
    near = {i for i, _, _, stays in minhash_dedup.brute_force(lines) if stays}
    texts = cut([(i, t) for i, t in lines if i in near])
    assert not texts[1003].strip() and any(t and t != dict(lines)[i] for i, t in texts.items())
    tokens = Tokenizer.from_file(P.path(packing.NAME))
    want = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items() if t.strip()}
    got = collections.Counter()
    for r in pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want


def test_empty_and_odd_tables(spark, tmp_path):
    """An empty table; and rows without ids, without texts, repeated, with columns called as operators call theirs."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, spans_found string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/a").count() == 0
    text = "the house and the garden of the old town are here for all of us to see every day"
    data = [(i, text if i % 2 else text + " " + " ".join(f"more{i}x{k} and the" for k in range(20)), "en") for i in range(1, 9)]
    data += [(None, "the house and the garden", "en"), (20, None, "en"), (21, "", None), (22, "12 34", "en"), (3, text, "en"), (3, text, "en")]
    spark.createDataFrame([(*r, "s", 0, "c", "x") for r in data], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    ids = [r.doc_id for r in pipeline.run(spark, f"{tmp_path}/b").collect()]
    assert {2, 4, 6, 8, None} <= set(ids) and not {20, 21, 22} & set(ids) and len({1, 3, 5, 7} & set(ids)) == 1
