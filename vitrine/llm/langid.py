"""Language of a text: averaged embeddings of hashed subwords and a linear softmax, with calibrated rejection.

A text's letters, lower-cased, with a mark at word ends, give n-grams of one to four signs; their hashes name
rows of an embedding table, whose average over the whole text goes through a linear layer. Both are trained by
stochastic gradient descent in numpy on the driver, from at most ``max_rows`` labelled documents, as many of each
language as there are (those of least hash); executors turn those documents' whole texts into counts by bucket first.
A fifth of the sample is held back to fit the temperature of the softmax and the score below which a
prediction is rejected. For prediction the two layers are one table of buckets by languages.

Defined results: a null text, or one without letters, is ``und`` with score 0, not accepted; rows without a lang
are not learned from; equal rows have equal predictions; without labelled rows every text is ``und``; an empty
table gives no rows; further columns are not read, and lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table

BUCKET_BITS = 13
GRAMS = 4
DIM = 16
MAX_ROWS = 2000
EPOCHS = 15
BATCH = 32
RATE = 20.0
SEED = 5
CHUNK = 1 << 20  # code points hashed at a time
PRECISION = 0.99  # wanted of accepted predictions
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> np.ndarray | None:
    """Of a whole text: how often each bucket is named. None if it has no letters."""
    low = text.lower()
    total, found = np.zeros(1 << BUCKET_BITS, np.int64), False
    for at in range(0, len(low), CHUNK):
        signs = np.frombuffer(low[max(0, at - 1) : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[signs]
        if not letter.any():
            continue
        found = True
        seq = np.concatenate([[0], np.where(letter, signs, 0), [0]]).astype(np.uint32)
        seq = seq[np.concatenate([[True], (seq[1:] != 0) | (seq[:-1] != 0)])]
        h, whole = np.zeros(len(seq), np.uint32), np.ones(len(seq), bool)
        for n in range(1, GRAMS + 1):
            if len(seq) < n:
                break
            last = seq[n - 1 :]
            h = (h[: len(last)] * np.uint32(0x01000193)) ^ (last * np.uint32(0x9E3779B1))
            whole = whole[: len(last)] & ((seq[n - 2 : len(seq) - 1] != 0) if n > 2 else True)  # no word end inside
            use = whole & (last != 0) if n == 1 else whole
            total += np.bincount(((h[use] ^ (h[use] >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)
    return total if found else None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets by languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = counts(text) if text and self.languages else None
        if x is None:
            return NONE, 0.0, False
        z = ((x @ self.table) / x.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best, score = int(p.argmax()), float(p.max() / p.sum())
        return self.languages[best], score, score >= self.threshold


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = SEED) -> Model:
    """Of (language, buckets, counts) rows."""
    languages = sorted({r[0] for r in rows})
    size = 1 << BUCKET_BITS
    if not languages:
        return Model([], np.zeros((size, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(r[0]) for r in rows])
    shares = [(r[1], r[2] / r[2].sum()) for r in rows]
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]

    def dense(some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), size), np.float32)
        for k, i in enumerate(some):
            x[k, shares[i][0]] = shares[i][1]
        return x

    emb = (rng.standard_normal((size, DIM)) / DIM).astype(np.float32)
    out = (rng.standard_normal((DIM, len(languages))) / DIM**0.5).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        mixed = rng.permutation(train)
        for at in range(0, len(mixed), BATCH):
            some = mixed[at : at + BATCH]
            x = dense(some)
            h = x @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            step = x.T @ (p @ out.T)
            out -= 0.05 * rate * (h.T @ p)
            bias -= 0.005 * rate * p.sum(0)
            emb -= rate * step
    table = (emb @ out).astype(np.float64)
    temperature, threshold = 1.0, 0.0
    if len(held):
        z = np.concatenate([dense(held[at : at + 256]) @ table + bias for at in range(0, len(held), 256)])
        log_p = lambda t: z / t - np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1, keepdims=True)) - (z / t).max(1, keepdims=True)
        # a fold without an error must not make every score 1: each label is taken as right by the rule of succession only
        doubt = 1 / (len(held) + 2)
        loss = lambda lp: -((1 - doubt) * lp[np.arange(len(held)), y[held]] + doubt * lp.mean(1)).sum()
        temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: loss(log_p(t))))
        p, right = np.exp(log_p(temperature)).max(1), z.argmax(1) == y[held]
        by_score = np.argsort(-p)
        good = np.nonzero(np.cumsum(right[by_score]) >= PRECISION * np.arange(1, len(held) + 1))[0]
        threshold = float(p[by_score][good[-1]]) if len(good) else 1.0
    return Model(languages, table, bias.astype(np.float64), temperature, threshold)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for lang, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            x = counts(t.as_py() or "")
            if x is not None:
                at = np.nonzero(x)[0]
                rows.append((lang, h, at.astype("<i4").tobytes(), x[at].astype("<i8").tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "h", "at", "n"])


def train(docs: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = SEED) -> Model:
    """Learn from at most max_rows rows with a lang, spread over the languages; of more languages than that, from a row of each."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL").withColumn("h", F.xxhash64("k", F.lit(seed)))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    if not known:
        return fit([])
    each = max(1, max_rows // len(known))
    most = each * len(known)
    # of a language of n rows, those in the lowest share of the hash that should hold twice as many as are taken: what is ranked is bounded too
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * each / r["n"] + 64 / r["n"])) for r in known], "lang string, share double")
    low = rows.select("lang", "h", "k").join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))
    some = low.withColumn("rank", rank).where(F.col("rank") <= each)
    chosen = some.select(F.col("k").alias("chosen")).limit(most)
    counted = in_batches(rows.join(F.broadcast(chosen), F.col("k") == F.col("chosen"), "left_semi").select("lang", "h", "t"), _counted, "lang string, h long, at binary, n binary")
    found = counted.orderBy("h", "lang", "at", "n").limit(most).collect()
    return fit([(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i8")) for r in found], seed)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            columns = [b.column(0), *[pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.string(), pa.float64(), pa.bool_()), strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted"])

    return in_batches(docs.select(F.col(key).cast("long"), F.col(text).cast("string")), run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
