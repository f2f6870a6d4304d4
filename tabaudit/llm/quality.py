"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, and thresholds by language.

Trusted are rows of `labels` with quality 1 that aren't toxic, split in two by a hash of doc_id. Of one half, those among the first TRUSTED
documents by another hash train the model, which is its bound; all of the other give, by language, the quantile of perplexities above which a
document is rejected. A document's perplexity is taken with PRIOR tokens of the language's mean added, so that a few odd words don't condemn a
short text; languages with fewer than ENOUGH trusted documents use the quantile of all. Every document
is scored over its whole text.

Two more scores, with limits from the same held-out trusted texts, tell rejected text that has an ordinary perplexity; each is a sum over
the text, divided by its length and PRIOR:
  contrast  how much likelier the text is under a model of rejected rows (quality 0 or toxic) than under that of trusted ones;
  toxicity  the evidence of words, without case and marks, that stand in LEAST toxic training documents at least: a lower bound of the
            logarithm of the ratio of their shares of toxic and of trusted documents.
The rejected rows that train are bounded and split like the trusted ones.

Tokens are the words with their case and marks, so that capitals or symbols count, and one end. The model holds, for each seen
n-gram, its discounted probability and, for each context, its interpolation weight (Chen and Goodman, 1998; discounts D1, D2 and D3+ by order,
continuation counts below the top order, and a uniform share for unknown words). Both lie in shards by hash of the context; a batch of
documents is joined with one shard at a time, so the model is never whole in memory, and texts are not shuffled.

Defined results: null and empty texts have the end as their only token; rows without a language are held against the common threshold;
with no trusted rows nothing is rejected (scores null), with no rejected rows the two other scores are 0; repeated rows are scored each; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .katz import _read_rows, _slices, pack, unpack
from .lines import FOLD
from .store import save, small_side, trimmed, work_dir
from .tokens import forget
from .words import batch_words, hash_strings, mix64, utf8

TRUSTED = 8000
QUANTILE, MARGIN, PRIOR, ENOUGH = 0.995, 1.05, 40.0, 50
LEAST = 3
SHARDS = 8
#: Bytes of text that are scored together.
TOGETHER = 4_000_000
_G = np.uint64(0x9E3779B97F4A7C15)
_END, _START = np.uint64(0xE0), np.uint64(0x50)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _G + b)


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens, each row with its end, and the first token of each row."""
    w = batch_words(*utf8(column), fold=False)
    first = w.first + np.arange(len(w.first))
    out = np.empty(first[-1], np.uint64)
    end = np.zeros(first[-1], bool)
    end[first[1:] - 1] = True
    out[end] = _END
    out[~end] = hash_strings(w.distinct)[w.codes]
    return out, first


def _contexts(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and that with the one before it."""
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[first[:-1]] = _START
    u = np.empty_like(tokens)
    u[1:] = v[:-1]
    u[first[:-1]] = _START
    return v, _join(u, v)


def _discounts(c: np.ndarray) -> np.ndarray:
    """D[0..3] of counts; with too few counts of counts, half of each count's unit."""
    n = np.bincount(np.minimum(c, 5), minlength=6)
    if not (n[1] and n[2] and n[3]):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = np.array([0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])


def _order(context: np.ndarray, key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tables of one order from distinct n-grams: key and discounted probability, context and weight of the order below."""
    d = _discounts(c)
    cut = d[np.minimum(c, 3)]
    contexts, which = np.unique(context, return_inverse=True)
    total = np.bincount(which, c)
    return key, ((c - cut) / total[which]), contexts, np.bincount(which, cut) / total, context


def train(tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Packed shards, each with its number: for the orders 3 and 2 the n-grams and contexts of that shard; the first also has the words."""
    v, uv = _contexts(tokens, first)
    tri = _join(uv, tokens)
    k3, at, c3 = np.unique(tri, return_index=True, return_counts=True)
    # Continuation counts: of how many different trigrams a bigram is the end, of how many bigrams a word.
    bi = _join(v[at], tokens[at])
    k2, at2, c2 = np.unique(bi, return_index=True, return_counts=True)
    v2, w2 = v[at][at2], tokens[at][at2]
    k1, c1 = np.unique(w2, return_counts=True)
    d1 = _discounts(c1)
    p1 = (c1 - d1[np.minimum(c1, 3)]) / c1.sum()
    rest = d1[np.minimum(c1, 3)].sum() / c1.sum() / (len(k1) + 1)
    three, two = _order(uv[at], k3, c3), _order(v2, k2, c2)
    out = []
    for s in range(SHARDS):
        arrays = []
        for key, p, contexts, weight, context in (three, two):
            mine, own = context % np.uint64(SHARDS) == s, contexts % np.uint64(SHARDS) == s
            order = np.argsort(key[mine])
            arrays += [key[mine][order], p[mine][order].astype(np.float32), contexts[own], weight[own].astype(np.float32)]
        arrays.insert(0, np.array([s], np.uint64))
        if s == 0:
            arrays += [k1, (p1 + rest).astype(np.float64), np.array([rest])]
        out.append(pack(*arrays))
    return out


def _find(table: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], default)


def log_probabilities(shards: Iterator[bytes], tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(w | u v) by token; the shards are read one after the other, once."""
    v, uv = _contexts(tokens, first)
    bi, tri = _join(v, tokens), _join(uv, tokens)
    of2, of3 = (v % np.uint64(SHARDS)).astype(np.int8), (uv % np.uint64(SHARDS)).astype(np.int8)
    p2, g2, p3, g3 = np.zeros(len(tokens)), np.ones(len(tokens)), np.zeros(len(tokens)), np.ones(len(tokens))
    p1 = np.zeros(len(tokens))
    for body in shards:
        number, *t = unpack(body)
        s = int(number[0])
        i = np.flatnonzero(of3 == s)
        g3[i] = _find(t[2], t[3], uv[i], 1.0)
        i = i[g3[i] < 1]
        p3[i] = _find(t[0], t[1], tri[i], 0.0)
        i = np.flatnonzero(of2 == s)
        g2[i] = _find(t[6], t[7], v[i], 1.0)
        i = i[g2[i] < 1]
        p2[i] = _find(t[4], t[5], bi[i], 0.0)
        if len(t) > 8:
            p1 = _find(t[8], t[9], tokens, float(t[10][0]))
    return np.log(p3 + g3 * (p2 + g2 * p1))


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words without case and marks, and the first word of each row."""
    raw, offsets = utf8(column)
    w = batch_words(FOLD[raw], offsets)
    return w.hashes, w.first


def _documents(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The words of each row, once."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    return words[np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])))[: len(words)])]


def evidence(toxic: np.ndarray, n_toxic: int, trusted: np.ndarray, n_trusted: int) -> bytes:
    """Packed words and their evidence, from the words of documents, each once a document."""
    key, n = np.unique(toxic, return_counts=True)
    other = _find(*np.unique(trusted, return_counts=True), key, 0) + 1
    value = np.log(n / (n_toxic + 1)) - np.log(other / (n_trusted + 1)) - np.sqrt(1 / n + 1 / other)
    keep = (n >= LEAST) & (value > 0)
    return pack(key[keep], value[keep])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


SCORES = ["n_tokens", "log_loss", "contrast", "toxicity"]


def perplexities(docs: DataFrame, shards_path: str, rejected_path: str, evidence_path: str) -> DataFrame:
    """The rows with `n_tokens`, `log_loss` (mean negative log probability), `contrast` and `toxicity` added."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        forget()
        for part in _slices(batches, TOGETHER):
            column = part.column(part.schema.get_field_index("text"))
            tokens, first = token_stream(column)
            lp = log_probabilities(_read_rows(shards_path), tokens, first)
            n = np.diff(first)
            loss = -np.add.reduceat(lp, first[:-1]) / n if len(n) else np.empty(0)
            rejected = _read_rows(rejected_path)
            body = next(rejected, None)
            other = lp if body is None else log_probabilities(chain([body], rejected), tokens, first)
            table = table or [unpack(body) for body in _read_rows(evidence_path)]
            words, begin = plain_words(column)
            found = sum((_find(*t, words, 0.0) for t in table), np.zeros(len(words)))
            scores = [n, loss, _sums(other - lp, first) / (n + PRIOR), _sums(found, begin) / (np.diff(begin) + PRIOR)]
            yield pa.record_batch([*part.columns, *map(pa.array, scores)], names=[*part.schema.names, *SCORES])

    types = [T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(SCORES, types, strict=True))])
    return docs.mapInArrow(trimmed(task), schema)


def _fold(key) -> F.Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(2))


def classify(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, quantile: float = QUANTILE) -> DataFrame:
    """The rows with n_tokens, perplexity, threshold, contrast, toxicity and accepted added (names that are taken get the prefix quality_)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "quality")
    known = labels.where("doc_id is not null").select("doc_id", (F.coalesce("toxic", F.lit(0)) != 0).alias("toxic"), "quality")
    good = save(known.where("quality = 1 and not toxic").select("doc_id").distinct(), folder, "good")
    bad = known.where("quality = 0 or toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    chosen = save(good.orderBy(*by).limit(trusted), folder, "chosen")
    against = save(bad.join(good, "doc_id", "left_anti").orderBy(*by).limit(trusted), folder, "against")
    texts = docs.select("doc_id", "text", "lang")
    half = save(texts.join(small_side(chosen), "doc_id").where(_fold("doc_id") == 0).select("text"), folder, "sample")
    worse = save(texts.join(small_side(against), "doc_id").where(_fold("doc_id") == 0).select("text", "toxic"), folder, "worse")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, lengths = [], []
        for part in _slices(batches):
            t, f = token_stream(part.column(0))
            streams.append(t)
            lengths.append(np.diff(f))
        if streams:
            first = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
            for body in train(np.concatenate(streams), first):
                yield pa.record_batch([pa.array([body], pa.binary())], names=["body"])

    save(half.coalesce(1).mapInArrow(trimmed(fit), "body binary"), folder, "shards", rows=1)
    save(worse.select("text").coalesce(1).mapInArrow(trimmed(fit), "body binary"), folder, "rejected", rows=1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bool, list[np.ndarray]] = {True: [np.empty(0, np.uint64)], False: [np.empty(0, np.uint64)]}
        n = {True: 0, False: 0}
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for kind in (True, False):
                column = batch.column(0).filter(pa.array(toxic == kind))
                if len(column):
                    words[kind].append(_documents(*plain_words(column)))
                    n[kind] += len(column)
        yield pa.record_batch([pa.array([evidence(np.concatenate(words[True]), n[True], np.concatenate(words[False]), n[False])], pa.binary())], names=["body"])

    both = worse.where("toxic").unionByName(half.withColumn("toxic", F.lit(False)))
    save(both.coalesce(1).mapInArrow(trimmed(weigh), "body binary"), folder, "evidence")
    path = f"{folder}/shards"
    models = (path, f"{folder}/rejected", f"{folder}/evidence")
    names = {n: n if n not in docs.columns else f"quality_{n}" for n in ("n_tokens", "perplexity", "threshold", "contrast", "toxicity", "accepted")}
    if spark.read.schema("body binary").parquet(path).limit(1).count() == 0:
        return docs.select("*", F.lit(None).cast("long").alias(names["n_tokens"]), *(F.lit(None).cast("double").alias(names[n]) for n in ("perplexity", "threshold", "contrast", "toxicity")), F.lit(True).alias(names["accepted"]))
    held = perplexities(texts.join(small_side(good), "doc_id").where(_fold("doc_id") == 1).select("lang", "text"), *models).drop("text")
    held = save(held, folder, "held")
    means = held.groupBy("lang").agg(F.sum(F.col("log_loss") * F.col("n_tokens")).alias("s"), F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    rows = means.collect()  # a row a language of the sample
    common = sum(r["s"] for r in rows) / max(1, sum(r["n"] for r in rows)) if rows else 0.0
    mean = F.lit(common)
    for r in rows:
        if r["docs"] >= ENOUGH and r["lang"] is not None:
            mean = F.when(F.col("lang") == r["lang"], F.lit(r["s"] / r["n"])).otherwise(mean)
    adjusted = (F.col("log_loss") * F.col("n_tokens") + PRIOR * mean) / (F.col("n_tokens") + PRIOR)
    graded = held.withColumn("a", adjusted)
    measures = {"a": MARGIN, "contrast": 1.0, "toxicity": 1.0}
    ranks = [F.percentile(c, F.lit(quantile)).alias(c) for c in measures]
    tops, all_ = graded.groupBy("lang").agg(*ranks).collect(), graded.agg(*ranks).first()
    enough = {r["lang"] for r in rows if r["docs"] >= ENOUGH and r["lang"] is not None}
    limits = {}
    for c, margin in measures.items():
        limits[c] = F.lit(all_[c] * margin if all_[c] is not None else float("inf"))
        for r in tops:
            if r["lang"] in enough:
                limits[c] = F.when(F.col("lang") == r["lang"], F.lit(r[c] * margin)).otherwise(limits[c])
    clash = {c: f"_q_{c}" for c in SCORES if c in docs.columns}
    out = perplexities(docs.withColumnsRenamed(clash), *models)
    out = out.withColumn("_perplexity", F.exp(adjusted)).withColumn("_threshold", F.exp(limits["a"]))
    fine = F.col("_perplexity") <= F.col("_threshold")
    for c in ("contrast", "toxicity"):
        fine = fine & (F.col(c) <= limits[c] + 1e-9)
    out = out.withColumn("_accepted", fine).withColumnsRenamed({c: f"_{c}" for c in SCORES}).withColumnsRenamed({v: k for k, v in clash.items()})
    return out.select(*docs.columns, *(F.col(f"_{n}").alias(as_) for n, as_ in names.items()))
