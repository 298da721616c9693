"""Language ID, words first: known words score by their log frequency in each language, unseen ones by character n-grams.

Learning: PER_LANGUAGE rows of each language, those with the smallest hashes of their ids among all that may be
learned from, are a bounded sample (a documented limit of the classifier, the only one here). A count of rows by language
gives a bound on hashes under which twice as many rows are expected; the scan keeps those only, so no corpus text
goes through a shuffle. Spark counts the sample's words and n-grams; what occurs twice or more is the model, which goes to
the workers. Predicting reads every whole text: each word adds its vector of log frequencies; a word that isn't known
takes the mean of its longest n-grams of which some are known, from N_GRAM characters down to one. The language with
the highest sum wins; the score is the mean, over words, of the share that the winner has of the word's likelihood.

A null text, or one without a letter, is `und` with score 0; so is everything if there is nothing to learn from. Ties
go to the language that sorts first. Rows with a null or repeated id are predicted like others; none is learned from
without an id, and of the rows that share one, sample places are dealt by a hash of the text. Very long texts are read
whole, in slices. Columns beside doc_id, text and lang aren't read, and identified() passes them on whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import kept_by, release
from ledgerspark.llm.pieces import by_chars
from ledgerspark.shipping import ship

PER_LANGUAGE, N_GRAM, MOST = 500, 4, 150_000
WORD = r"\p{L}[\p{L}\p{M}]*"


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)] or [w]


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, text: the rows to learn from."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    # twice as many hashes as are needed lie below the bound; that fewer than per_language do hardly happens, and only
    # makes the sample smaller
    share = F.least(F.lit(1.0), 2.0 * per_language / F.col("n"))
    bounds = counts.select(F.col("lang").alias("lg"), (share * float(1 << 64) - float(1 << 63)).alias("bound"))
    near = usable.join(F.broadcast(bounds), F.col("lang") == F.col("lg")).where(F.col("h").cast("double") <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text")))
    return near.withColumn("n", rank).where(F.col("n") <= per_language).select("lang", "text")


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> pa.Table:
    """lang, order, gram, n: how often each word (order 0) and n-gram occurs in the sample, where it does twice or more."""

    def count(batches):
        from collections import Counter

        import regex

        find = regex.compile(WORD).findall
        for batch in batches:
            words: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.update((lang, w) for w in find(text.lower()))
            rows: Counter = Counter()
            for (lang, w), c in words.items():
                rows[lang, 0, w] += c
                for n in range(1, N_GRAM + 1):
                    for g in grams(w, n):
                        rows[lang, n, g] += c
            keys = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "order", "gram", "n"])

    counted = sampled(docs, per_language).mapInArrow(count, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").toArrow()


class Model:
    """By order: the grams, sorted, and a row of log frequencies for each; kept as Arrow and numpy, small in the driver."""

    def __init__(self, counts: pa.Table):
        self.name = uuid.uuid4().hex
        self.languages = sorted(pc.unique(counts.column("lang")).to_pylist())
        self.orders = []
        for order in range(N_GRAM + 1):
            own = counts.filter(pc.equal(counts.column("order"), order)).combine_chunks()
            kinds = pc.unique(own.column("gram"))
            kinds = kinds.take(pc.sort_indices(kinds))
            table = np.full((len(kinds), len(self.languages)), 0.5)
            row = pc.index_in(own.column("gram"), kinds).to_numpy()
            lang = pc.index_in(own.column("lang"), pa.array(self.languages, pa.string())).to_numpy()
            np.add.at(table, (row, lang), own.column("n").to_numpy())
            self.orders.append((kinds, np.log(table / table.sum(0)) if len(kinds) else table))

    def places(self, order: int) -> dict[str, int]:
        kinds = self.orders[order][0].to_pylist()
        return dict(zip(kinds, range(len(kinds)), strict=True))


class Predictor:
    """Lives in a Python worker; remembers words' vectors, at most MOST beside the model's own."""

    def __init__(self, model: Model):
        import regex

        self.model, self.find = model, regex.compile(WORD).findall
        self.known = [model.places(n) for n in range(N_GRAM + 1)]
        self.reset()

    def reset(self) -> None:
        table = self.model.orders[0][1]
        self.place = dict(self.known[0])
        self.base = len(self.place)
        self.rows = np.empty((self.base + MOST, 2 * len(self.model.languages)))
        self.rows[: self.base] = self.with_share(table)

    @staticmethod
    def with_share(logs: np.ndarray) -> np.ndarray:
        e = np.exp(logs - logs.max(1, keepdims=True)) if logs.size else logs
        return np.hstack([logs, e / e.sum(1, keepdims=True)]) if logs.size else np.zeros((len(logs), 2 * logs.shape[1]))

    def unseen(self, words: list[str]) -> np.ndarray:
        """The mean log frequencies of each word's longest n-grams of which some are known."""
        out = np.zeros((len(words), len(self.model.languages)))
        left = np.arange(len(words))
        for n in range(N_GRAM, 0, -1):
            if not len(left):
                break
            place, table = self.known[n], self.model.orders[n][1]
            split = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(s) for s in split])
            at = np.array([place.get(g, -1) for s in split for g in s], np.int64)
            owner, at = owner[at >= 0], at[at >= 0]
            times = np.bincount(owner, minlength=len(left))
            known = times > 0
            for c in range(out.shape[1]):
                out[left[known], c] = (np.bincount(owner, table[at, c], len(left)) if len(at) else np.zeros(len(left)))[known] / times[known]
            left = left[~known]
        return out

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.place.keys())
        at = len(self.place)
        if at + len(new) > self.base + MOST:
            self.reset()
            new, at = sorted(words - self.place.keys()), self.base
        if at + len(new) > len(self.rows):  # one huge text
            self.rows = np.vstack([self.rows, np.empty((at + len(new) - len(self.rows), self.rows.shape[1]))])
        if new:
            self.rows[at : at + len(new)] = self.with_share(self.unseen(new))
            self.place.update(zip(new, range(at, at + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        n = len(self.model.languages)
        out = []
        for some in by_chars([t or "" for t in texts]):
            split = [self.find(t.lower()) if n else [] for t in some]
            self.learn(set().union(*split))
            for words in split:
                if not words:
                    out.append(("und", 0.0))
                    continue
                total = np.zeros(2 * n)
                for i in range(0, len(words), 50_000):
                    total += self.rows[np.fromiter(map(self.place.__getitem__, words[i : i + 50_000]), np.int64)].sum(0)
                best = int(np.argmax(total[:n]))
                out.append((self.model.languages[best], float(min(1.0, total[n + best] / len(words)))))
        return out


def predictor(model: Model) -> Predictor:
    """One for each model and worker."""
    kept = kept_by("language_id")
    if model.name not in kept:
        kept.clear()
        kept[model.name] = Predictor(model)
    return kept[model.name]


def predicted(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """The function for mapInArrow over (doc_id, text): to doc_id, lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Model(learned(docs, per_language)))
    release()

    def run(batches):
        predict = predictor(model.value)
        for batch in batches:
            got = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    run = predicted(docs, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs' rows, all columns, whose language is known with a score of `least` or more."""
    run = predicted(docs, per_language)
    names = docs.columns
    at = names.index("text")

    def kept(batches):
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["a", "b"])
            (got,) = run([text])
            keep = (got.column(2).to_numpy() >= least) & (np.array(got.column(1).to_pylist(), object) != "und")
            yield batch.filter(pa.array(keep))
        release()

    return docs.mapInArrow(kept, docs.schema)


def brute_force(rows: list[tuple[int | None, str | None, str | None]], chosen: list[tuple[str, str]]) -> list[tuple]:
    """For tests: doc_id, lang_pred, score for rows of doc_id, text, lang, learned word by word from chosen (lang, text)."""
    import math
    from collections import Counter

    import regex

    find = regex.compile(WORD).findall
    languages, counts = sorted({x for x, _ in chosen}), [Counter() for _ in range(N_GRAM + 1)]
    for lang, text in chosen:
        for w in find(text.lower()):
            counts[0][lang, w] += 1
            for n in range(1, N_GRAM + 1):
                counts[n].update((lang, g) for g in grams(w, n))
    logs: list[dict[str, list[float]]] = []
    for c in counts:
        c = {k: v for k, v in c.items() if v > 1}
        kinds = sorted({g for _, g in c})
        total = {x: sum(c.get((x, g), 0) + 0.5 for g in kinds) for x in languages}
        logs.append({g: [math.log((c.get((x, g), 0) + 0.5) / total[x]) for x in languages] for g in kinds})

    def vector(w: str) -> list[float]:
        if w in logs[0]:
            return logs[0][w]
        for n in range(N_GRAM, 0, -1):
            if known := [logs[n][g] for g in grams(w, n) if g in logs[n]]:
                return [sum(v) / len(known) for v in zip(*known, strict=True)]
        return [0.0] * len(languages)

    out = []
    for i, text, _ in rows:
        words = [vector(w) for w in find((text or "").lower())]
        if not words or not languages:
            out.append((i, "und", 0.0))
            continue
        sums = [sum(v) for v in zip(*words, strict=True)]
        best = sums.index(max(sums))
        share = sum(math.exp(v[best]) / sum(map(math.exp, v)) for v in words) / len(words)
        out.append((i, languages[best], share))
    return out
