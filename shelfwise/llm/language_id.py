"""Language identification: averaged hashed subword embeddings with a linear softmax, calibrated, with rejection.

A text becomes lower-case UTF-8 bytes in which everything but letters is a space. Its subwords are all runs of 2 to 4 bytes, hashed into
``BUCKETS`` buckets. The mean of their embeddings goes through a linear softmax. The model is trained by stochastic gradient descent in numpy on a
bounded sample (``max_train`` texts at most, balanced by language, chosen by a hash of the key); a fifth of the sample is kept from
training and sets the temperature of the scores and the score below which a prediction is rejected. Prediction reads whole texts
in the tasks; there the product of embeddings and softmax is one small table.

Edge cases: a null text, an empty one and one without letters are ``und`` with score 0, and rejected; without training rows every text is;
with one language every other text gets it; repeated rows are predicted each; added columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class TrainPolicy:
    """``max_train``: bound of the labelled sample, in texts. ``max_languages``: bound of the model's size, beyond which training stops with
    an error. ``precision``: wanted among the predictions that are not rejected."""

    max_train: int = 6000
    max_languages: int = 4096
    dim: int = 16
    epochs: int = 4
    rate: float = 2.0
    precision: float = 0.99
    seed: int = 5


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def buckets(text: str) -> np.ndarray:
    """Bucket of every subword of a text."""
    x = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), np.uint8)
    h, out = x.astype(np.uint32), []
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        if n in ORDERS:
            out.append(((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(17))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """``table`` is the product of embeddings and softmax weights: a text's logits are the mean of its rows."""

    languages: list[str]
    table: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        ids = buckets(text)
        counts = np.bincount(ids, minlength=BUCKETS).astype(np.float32)
        return counts @ self.table / max(1, len(ids))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], policy: TrainPolicy) -> Model:
    """Train on (bucket, count, language) rows; every fifth row calibrates."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    rng = np.random.default_rng(policy.seed)
    index = {v: i for i, v in enumerate(languages)}
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, train = (rows[::5], [r for i, r in enumerate(rows) if i % 5]) if len(rows) >= 10 else (rows, rows)
    embed = rng.normal(0, 1 / policy.dim, (BUCKETS, policy.dim)).astype(np.float32)
    weights = np.zeros((policy.dim, len(languages)), np.float32)
    steps, total = 0, policy.epochs * len(train)
    for _ in range(policy.epochs):
        for i in rng.permutation(len(train)):
            ids, counts, lang = train[i]
            rate = policy.rate * (1 - steps / total)
            steps += 1
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ embed[ids]
            error = softmax(hidden @ weights)
            error[index[lang]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            embed[ids] -= rate * share[:, None] * back
    model = Model(languages, embed @ weights)
    logits = np.stack([(c / c.sum()) @ model.table[i] for i, c, _ in held])
    truth = np.array([index[r[2]] for r in held])
    loss = [(-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in 2.0 ** np.arange(-4, 4.1, 0.25)]
    model.temperature = float(min(loss)[1])
    p = softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= policy.precision
    model.reject_below = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def train(labelled: DataFrame, policy: TrainPolicy, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded, balanced sample of ``labelled``; texts become counts in the tasks, only these reach the driver."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).count().limit(policy.max_languages + 1).collect()
    if not sizes:
        return fit([], policy)
    if len(sizes) > policy.max_languages:
        raise ValueError(f"more than {policy.max_languages} languages: none is left out, so raise max_languages")
    each = policy.max_train / len(sizes)
    shares = known.sparkSession.createDataFrame([(r[0], min(1.0, each / r[1])) for r in sizes], "l string, _share double")
    narrow = known.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    drawn = F.pmod(F.xxhash64(F.lit(policy.seed), "k"), F.lit(1 << 30)) < F.col("_share") * (1 << 30)
    # rows of one key are drawn together, so the bound is kept by an order that only depends on the rows
    order = F.xxhash64(F.lit(policy.seed + 1), "k", "t", "l")
    sample = narrow.join(F.broadcast(shares), "l").where(drawn).orderBy(order).limit(2 * policy.max_train).select("k", "t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, lang_ in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "l")), strict=True):
                if has_letter(t):
                    ids, n = np.unique(buckets(t), return_counts=True)
                    rows.append((k, ids.astype("<u2").tobytes(), n.astype("<u4").tobytes(), lang_))
            yield pa.RecordBatch.from_pydict(
                {
                    "k": pa.array([str(r[0]) for r in rows], pa.string()),
                    "ids": pa.array([r[1] for r in rows], pa.binary()),
                    "n": pa.array([r[2] for r in rows], pa.binary()),
                    "l": pa.array([r[3] for r in rows], pa.string()),
                }
            )

    got = sample.mapInArrow(count, "k string, ids binary, n binary, l string").collect()
    rows = sorted(((r["k"], r["l"], bytes(r["ids"]), bytes(r["n"])) for r in got))
    return fit([(np.frombuffer(i, "<u2"), np.frombuffer(n, "<u4"), lang_) for _, lang_, i, n in rows], policy)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``."""
    added = ("lang_pred", "score", "rejected")
    kept = df.drop(*[c for c in added if c != text])
    source = kept.withColumn("_text", F.col(text).cast("string")).drop(*([text] if text in added else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column("_text").to_pylist()]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[0] == UNDETERMINED or g[1] < model.reject_below for g in got], pa.bool_()),
                ],
                names=[*names, *added],
            )

    fields = [f for f in source.schema.fields if f.name != "_text"]
    schema = T.StructType(
        [
            *fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return source.mapInArrow(run, schema)
