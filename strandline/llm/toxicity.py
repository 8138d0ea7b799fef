"""Toxicity by weak supervision: many voters, a label model, a linear classifier.

Voters are words and word beginnings. A seed lexicon of insults votes for 1; the
labelled fold proposes more terms, those far more frequent in texts labelled 1
(lexicon and prefix pattern voters), and one voter votes for 0 where no term is found.
From there on labels play no part: a generative label model over which voters fire
on which text estimates, by expectation-maximisation, how often each fires in either
class (its accuracy) and how much voters fire together beyond what the classes
explain (correlations: of a word and its beginning, or of words of one phrase). A
voter that doesn't fire abstains; correlated voters share the weight of one. A
logistic classifier over the same terms is trained on the posterior labels of the
sample, and scores every whole text.

Fitting takes at most SAMPLE labelled rows, those with the least hash of their
id, from the learning fold only (crc32 of the id as text, modulo 5, not 0); the
bound is a parameter. The sample is written once. Scoring is per row, without shuffle.

Features are marks of distinct terms, so a text's length alone doesn't move its
score. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts score as a text without any term; rows
with a null id count as held out; repeated rows score alike. Without a labelled
row in the learning fold the seed lexicon alone decides. A text of any length is
read in chunks of whole texts; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared, _text as T

U = np.uint64
SEED_WORDS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "bastard", "bitch", "asshole", "retard", "idioten", "dummkopf", "arschloch", "connard", "salope", "imbécile", "cabrón", "gilipollas", "estúpido")
SAMPLE, PREFIXES = 10_000, (4, 5, 6, 7, 8)
TIED, ABSTAIN = 0.5, 6.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
CHUNK = 1 << 20
_FOLD = np.full(256, 32, np.uint8)  # ASCII letters in lower case, bytes of other characters as they are, all else a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct word and word beginning of a chunk; the low bit of a hash tells beginnings."""
    text = _FOLD[data]
    starts, ends = T.words(text, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    row = T.rows_of(starts, offsets)
    codes, rows = [T.span_hashes(text, starts, ends) & ~U(1)], [row]
    for k in PREFIXES:
        m = ends - starts >= k
        codes.append(T.span_hashes(text, starts[m], starts[m] + k) | U(1))
        rows.append(row[m])
    code, row = np.concatenate(codes), np.concatenate(rows)
    key = np.unique(row.astype(U) << U(44) | code >> U(20) << U(1) & U((1 << 44) - 1) | code & U(1))
    return (key >> U(44)).astype(np.int64), key & U((1 << 44) - 1)


def term_code(word: str, beginning: bool = False) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    h = T.span_hashes(raw, np.array([0]), np.array([len(raw)]))
    h = (h | U(1)) if beginning else (h & ~U(1))
    return int((h >> U(20) << U(1) & U((1 << 44) - 1) | h & U(1))[0])


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def shares(row: np.ndarray, col: np.ndarray, voters: int, post: np.ndarray) -> np.ndarray:
    """The part of its weight that each voter keeps: one over one plus its correlations, within the class of toxic texts, with others.

    row, col: which voter fires on which text. Correlations up to TIED are taken for chance.
    """
    texts = np.flatnonzero(post > 0.01)
    number = np.full(len(post), -1)
    number[texts] = np.arange(len(texts))
    keep = number[row] >= 0
    fires = np.zeros((len(texts), voters), np.float32)
    fires[number[row[keep]], col[keep]] = 1
    weight = (post[texts] / post[texts].sum()).astype(np.float32)
    rate = weight @ fires
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    total = np.zeros(voters)
    for a in range(0, voters, 512):
        some = slice(a, a + 512)
        tied = ((fires * weight[:, None]).T @ fires[:, some] - np.outer(rate, rate[some])) / np.outer(spread, spread[some])
        total[some] = np.where(tied > TIED, np.minimum(tied, 1), 0).sum(0)
    return 1 / np.maximum(total, 1.0)


def label_model(row: np.ndarray, col: np.ndarray, n: int, voters: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of n texts, firing rates of the voters in classes 1 and 0, and their shares, from firing patterns alone."""
    count = np.bincount(row, minlength=n)
    post = np.where(count > 0, 1 - 0.6 * 0.7**count, 0.02)
    share = np.ones(voters)
    for t in range(rounds):
        prior = float(np.clip(post.mean(), 0.005, 0.5))
        on = (np.bincount(col, post[row], voters) + 0.5) / (post.sum() + 1)
        off = (np.bincount(col, 1 - post[row], voters) + 1) / ((1 - post).sum() + 2)
        off = np.minimum(off, on * 0.9)  # a voter for 1 is taken to do better than chance
        if t % 10 == 0:
            share = shares(row, col, voters, post)
        log = np.bincount(row, (share * np.log(on / off))[col], n) - np.where(count > 0, 0.0, ABSTAIN)
        post = 1 / (1 + np.exp(-np.clip(log + np.log(prior / (1 - prior)), -40, 40)))
    return post, on, off, share


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the number of texts, and of texts labelled 1, that hold them; summed per batch."""
    for batch in batches:
        data, offsets = T.flat(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j in T.chunks(offsets, CHUNK):
            o = offsets[i : j + 1]
            row, code = terms(data[o[0] : o[-1]], o - o[0])
            names, index = np.unique(code, return_inverse=True)
            ones = np.bincount(index, weights=toxic[i:j][row], minlength=len(names)).astype(np.int64)
            n = np.bincount(index, minlength=len(names))
            keep = ones > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[keep].astype(np.int64)), pa.array(ones[keep]), pa.array(n[keep] - ones[keep])], names=["code", "ones", "zeros"])
            yield pa.RecordBatch.from_arrays([pa.array(names[~keep].astype(np.int64)), pa.array(ones[~keep]), pa.array(n[~keep])], names=["code", "ones", "zeros"])


def vote_batches(batches: Iterator[pa.RecordBatch], codes: bytes) -> Iterator[pa.RecordBatch]:
    """The voters that fire on each text."""
    known = np.frombuffer(codes, U)
    for batch in batches:
        data, offsets = T.flat(batch.column("text"))
        for i, j in T.chunks(offsets, CHUNK):
            o = offsets[i : j + 1]
            row, code = terms(data[o[0] : o[-1]], o - o[0])
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[at] == code
            n = np.bincount(row[hit], minlength=j - i)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], names=["doc_id", "voters"])


def fit(row: np.ndarray, col: np.ndarray, n: int, voters: int) -> tuple[np.ndarray, float]:
    """Weights of the voters and a bias, from what fires on each of n texts."""
    post, on, off, share = label_model(row, col, n, voters)
    w = np.append(np.log(on / off) * share / 4, -3.0)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, 301):  # Adam on the posterior labels
        gap = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + w[-1], -40, 40))) - post
        g = np.append(np.bincount(col, gap[row], voters) / n + 1e-5 * w[:-1], gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: int = 5) -> dict:
    """A model: codes of terms (ascending), their weights, and the bias.

    What reaches the driver: the terms that least or more toxic texts of the sample
    hold and few others, and which of them fire on each of at most sample rows.
    """
    seed = np.unique(np.array([term_code(w) for w in SEED_WORDS], U))
    plain = {"codes": seed, "weights": np.full(len(seed), 6.0), "bias": -4.0}
    rows = _shared.written(learning_sample(documents, labels, id_col, text_col, sample), "learned")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).first()
    if not total["n"]:
        return plain
    base = max(1, total["ones"]) / total["n"]
    counted = rows.mapInArrow(T.shipped(__name__, "count_batches"), "code long, ones long, zeros long").groupBy("code").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    rate = (F.col("ones") + base) / (F.col("ones") + F.col("zeros") + 1)
    seeds = F.col("code").isin([int(x) for x in seed])
    good = counted.filter(((F.col("ones") >= least) & (rate > 0.84) & (F.col("zeros") * 50 <= F.col("ones") + F.col("zeros"))) | seeds)
    codes = np.sort(good.select("code").toArrow().column("code").to_numpy()).astype(U)
    if not len(codes):
        return plain
    fired = rows.mapInArrow(T.shipped(__name__, "vote_batches", codes.tobytes()), "doc_id long, voters array<int>").toArrow().sort_by("doc_id").column("voters").combine_chunks()
    n = np.asarray(fired.value_lengths())
    weights, bias = fit(np.repeat(np.arange(len(n)), n), np.asarray(fired.flatten()), len(n), len(codes))
    return {"codes": codes, "weights": weights, "bias": bias}


def score_batches(batches: Iterator[pa.RecordBatch], codes: bytes, weights: bytes, bias: float) -> Iterator[pa.RecordBatch]:
    code, weight = np.frombuffer(codes, U), np.frombuffer(weights, np.float64)
    sieve = np.zeros(1 << 20, bool)
    sieve[(code & U((1 << 20) - 1)).astype(np.int64)] = True
    for batch in batches:
        data, offsets = T.flat(batch.column("text"))
        total = np.full(batch.num_rows, bias)
        for i, j in T.chunks(offsets, CHUNK):
            o = offsets[i : j + 1]
            text = _FOLD[data[o[0] : o[-1]]]
            starts, ends = T.words(text, o - o[0])
            if not len(starts) or not len(code):
                continue
            row = T.rows_of(starts, o - o[0])
            found = []
            for k in (0, *PREFIXES):
                m = slice(None) if not k else np.flatnonzero(ends - starts >= k)
                s = starts[m]
                h = T.span_hashes(text, s, s + k if k else ends)
                h = h | U(1) if k else h & ~U(1)
                h = h >> U(20) << U(1) & U((1 << 44) - 1) | h & U(1)
                hit = np.flatnonzero(sieve[(h & U((1 << 20) - 1)).view(np.int64)])
                at = np.minimum(np.searchsorted(code, h[hit]), len(code) - 1)
                good = code[at] == h[hit]
                found.append(row[m][hit[good]] * len(code) + at[good])
            hits = np.unique(np.concatenate(found))
            np.add.at(total, i + hits // len(code), weight[hits % len(code)])
        score = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        out = [held_out(d) for d in batch.column("doc_id").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def learning_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """At most sample labelled rows of the learning fold, those with the least hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = docs.join(F.broadcast(known), "doc_id").withColumn("code", F.xxhash64("text"))
    return rows.groupBy("code").agg(F.min_by(F.struct("doc_id", "toxic", "text"), "doc_id").alias("row")).select("row.*")  # copies would count as many witnesses


def score_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every text; learns from a bounded sample first.

    sample: at most so many labelled rows are learned from, each in full.
    """
    model = learn(documents, labels, id_col, text_col, sample)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(T.shipped(__name__, "score_batches", np.asarray(model["codes"], U).tobytes(), np.asarray(model["weights"], np.float64).tobytes(), float(model["bias"])), SCHEMA)
