"""Quality classifier by positive-unlabelled learning.

An additive model over binned text statistics and hashed word frequencies is fitted by
minimising the non-negative unbiased risk (Kiryo et al. 2017)

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))

from trusted positives and unlabelled web text.  The class prior pi is a statistic of the whole
table: the least ratio of the tail of all documents to that of the trusted positives, with a
confidence margin, over the margins of two first models.  A hash of the id puts every document into one
of two halves, and each half is measured by the model of the other.  The unlabelled sample is all
sampled text, labels unseen.  Labelled rows of both kinds then set the two numbers of a logistic
calibration on margins of models that did not see them, so that a score reads as a probability.

Fitting uses bounded samples (``max_labelled``, ``max_unlabelled`` rows, chosen by a hash of
the id).  The prior and the scores each read every whole text, one slice at a time, without a shuffle of texts.

Defined cases: a null or empty text has the features of a text without words and gets a score
like any other; without any positive label every score is ``default_prior``; repeated labels of
one id count once (the highest wins); documents with a null id are scored and held in the
training side; input columns named like the operator's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_but, map_rows, released, slices

N_HASHED = 256
N_DENSE = 22
N_BINS = 12
DECAY = 1e-3
_CLASSES = np.zeros(256, np.int64)  # 0 other control
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:'\"()-", b" ", b"\n"), 1):
    _CLASSES[list(_chars)] = _i
_CLASSES[128:] = 9
_SYMBOL_ENDS = frozenset("#*$%&|<>!~^=+_@")


def text_features(text: str | None) -> np.ndarray:
    """N_DENSE statistics, then N_HASHED relative word frequencies."""
    out = np.zeros(N_DENSE + N_HASHED, np.float32)
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    n = len(words)
    out[0], out[1] = np.log1p(n), np.log1p(len(raw))
    if not n:
        return out
    shares = np.bincount(_CLASSES, weights=np.bincount(raw, minlength=256), minlength=10)[:10] / len(raw)
    out[2:12] = shares
    ids = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, n).astype(np.uint64)
    _, counts = np.unique(ids, return_counts=True)
    out[12] = len(text) / n
    out[13] = len(counts) / n
    out[14] = np.log1p(len(counts)) / np.log1p(n)
    out[15] = counts.max() / n
    lines = [x for x in text.split("\n") if x.strip()]
    out[16] = 1 - len(set(lines)) / len(lines)
    if n > 3:
        grams = ((ids[:-3] * np.uint64(0x9E3779B97F4A7C15) + ids[1:-2]) * np.uint64(0xC2B2AE3D27D4EB4F) + ids[2:-1]) * np.uint64(0x165667B19E3779F9) + ids[3:]
        out[17] = 1 - len(np.unique(grams)) / len(grams)
    out[18] = sum(w[-1] in _SYMBOL_ENDS for w in words) / n
    out[19] = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    out[20] = len(lines) / n
    out[21] = sum(len(w) > 25 for w in words) / n
    out[N_DENSE:] = np.bincount((ids % N_HASHED).astype(np.int64), minlength=N_HASHED) / n
    return out


@dataclass
class Model:
    edges: np.ndarray  # N_DENSE x (N_BINS - 1)
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        out = np.zeros((n, N_DENSE * N_BINS + N_HASHED), np.float32)
        rows = np.arange(n)
        for j in range(N_DENSE):
            out[rows, j * N_BINS + np.searchsorted(self.edges[j], x[:, j], side="right")] = 1
        out[:, N_DENSE * N_BINS :] = np.clip((x[:, N_DENSE:] - self.centre) / self.scale, -4, 4) * 0.1
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * self.margin(x) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _blank(x: np.ndarray) -> Model:
    q = np.linspace(0, 1, N_BINS + 1)[1:-1]
    edges = np.quantile(x[:, :N_DENSE], q, axis=0).T + 1e-9
    hashed = x[:, N_DENSE:]
    return Model(edges, hashed.mean(0), hashed.std(0) + 1e-4, np.zeros(N_DENSE * N_BINS + N_HASHED, np.float32), 0.0, 1.0, 0.0, 0.5)


def minimise_nn_risk(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 250, rate: float = 0.03, decay: float = 1e-3, beta: float = 0.0) -> tuple[np.ndarray, float, list[float]]:
    """Full-batch Adam on the non-negative risk with the logistic loss; pos, unl: design matrices."""
    w, b = np.zeros(pos.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    risks = []
    for t in range(1, steps + 1):
        zp, zu = pos @ w + b, unl @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        plus, minus_p, minus_u = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zp).mean(), np.logaddexp(0, zu).mean()
        negative = minus_u - prior * minus_p
        risks.append(float(prior * plus + max(0.0, negative)))
        gp, gu = -(1 - sp) * prior / len(pos), np.zeros(len(unl))
        if negative >= -beta:
            gp, gu = gp - prior * sp / len(pos), su / len(unl)
        else:  # climb out of the negative part
            gp, gu = prior * sp / len(pos), -su / len(unl)
        g = np.append(pos.T @ gp.astype(np.float32) + unl.T @ gu.astype(np.float32) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b), risks


def prior_cuts(pos_scores: np.ndarray) -> np.ndarray:
    """The thresholds at which tails are compared: 91 quantiles of the positives' scores."""
    return np.unique(np.quantile(pos_scores, np.linspace(0.0, 0.9, 91)))


def estimate_prior(pos_scores: np.ndarray, cuts: np.ndarray, above: np.ndarray, total: int, delta: float = 0.1) -> float:
    """Share of positives among total documents, above of which reach each cut: the least upper bound over the cuts."""
    qp = (pos_scores[None, :] >= cuts[:, None]).mean(1)
    qu = above / total
    margin = np.sqrt(np.log(4 / delta) / 2 / total) + np.sqrt(np.log(4 / delta) / 2 / len(pos_scores))
    best = np.argmin((qu + margin) / qp)
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def _calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton steps for sigmoid(slope z + offset), with a light ridge."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * z + b)
        r, h = p - y, p * (1 - p) + 1e-6
        g = np.array([(r * z).sum() + 1e-2 * a, r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def half_of(doc_id: int | None) -> int:
    """0 or 1; null ids are in half 0."""
    return 0 if doc_id is None else crc32(str(doc_id).encode()) >> 8 & 1


#: Of two models and their cuts: documents of the other half that reach each cut, and all documents of it.
Tails = Callable[[list["Model"], list[np.ndarray]], list[tuple[np.ndarray, int]]]


def fit(x: np.ndarray, kind: np.ndarray, half: np.ndarray, tails: Tails, default_prior: float = 0.5) -> Model:
    """x: features; kind: 1 trusted positive, 0 labelled negative (calibration only), -1 unlabelled; half: 0 or 1."""
    if not (kind == 1).any():
        model = _blank(x if len(x) else np.zeros((1, N_DENSE + N_HASHED), np.float32))
        model.slope, model.offset, model.prior = 0.0, float(np.log(default_prior / (1 - default_prior))), default_prior
        return model
    model = _blank(x)
    design, positive = model.design(x), kind == 1
    decay = DECAY * max(1.0, 3000 / positive.sum())

    def risk_model(rows: np.ndarray, prior: float) -> Model:
        w, b, _ = minimise_nn_risk(design[rows & positive], design[rows], prior, decay=decay)
        return replace(model, weights=w, bias=b)

    # A margin that is looked at never comes from a model that saw its row.
    halves = [half == h for h in (0, 1)]
    enough = all((h & positive).sum() >= 10 for h in halves)
    prior = default_prior
    if enough:
        first = [risk_model(~h, 0.5) for h in halves]  # of the other half
        scores = [design[h & positive] @ m.weights + m.bias for h, m in zip(halves, first, strict=True)]
        cuts = [prior_cuts(s) for s in scores]
        parts = [(estimate_prior(s, c, above, n), n) for s, c, (above, n) in zip(scores, cuts, tails(first, cuts), strict=True) if n]
        prior = float(np.average([p for p, _ in parts], weights=[n for _, n in parts]))
    whole = risk_model(np.ones(len(x), bool), prior)
    model.weights, model.bias, model.prior = whole.weights, whole.bias, prior
    labelled = kind >= 0
    if enough and (kind == 0).sum() >= 5:
        margins = np.zeros(len(x))
        for h in halves:
            other = risk_model(~h, prior)
            margins[h] = design[h] @ other.weights + other.bias
        model.slope, model.offset = _calibrate(margins[labelled], kind[labelled].astype(np.float64))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def least_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """The n least rows of rows (doc_id, ...) by a hash of the id.

    Only hashes below a threshold that about 4 n rows pass are sorted, so what one task merges is
    bounded however many partitions there are; the rows are those that a full sort would give."""
    order, total = F.xxhash64("doc_id", F.lit("sample")), rows.count()
    if total > 4 * n:
        rows = rows.where(order < F.lit(-(1 << 63) + (1 << 64) * 4 * n // total))
    return rows.orderBy(order, "doc_id").limit(n)


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, max_unlabelled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, kinds and halves of the bounded samples; one pass over the texts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("kind"))
    known = least_by_hash(known.where(~held_out(F.col("doc_id"))), max_labelled)
    some = least_by_hash(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id"), 2 * max_unlabelled).distinct()
    unlabelled = some.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("kind")).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_unlabelled)
    sample = F.broadcast(known.unionByName(unlabelled))  # at most max_labelled + max_unlabelled rows of two numbers

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([text_features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())],
            names=["doc_id", "kind", "features"],
        )

    rows = map_rows(docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "kind", "text"), features, "doc_id long, kind int, features binary")
    got = rows.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    if not len(got):
        return np.zeros((0, N_DENSE + N_HASHED), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = np.array([half_of(int(i)) for i in got["doc_id"]])
    return np.frombuffer(b"".join(got["features"]), np.float32).reshape(len(got), -1), got["kind"].to_numpy(), half


def tail_counts(docs: DataFrame, models: list[Model], cuts: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
    """For each half of all docs (doc_id long, text): how many margins of its model reach each cut, and how many there are.

    One pass over the texts; a task sends on one row a half and cut, at most 184."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = [np.zeros(len(c) + 1, np.int64) for c in cuts]
        for part in (p for batch in batches for p in slices(batch)):
            half = np.array([half_of(i) for i in part.column(0).to_pylist()])
            x = np.stack([text_features(t) for t in part.column(1).to_pylist()])
            for h in (0, 1):
                if (half == h).any():
                    bins[h] += np.bincount(np.searchsorted(cuts[h], models[h].margin(x[half == h]), side="right"), minlength=len(bins[h]))
        halves = np.repeat([0, 1], [len(b) for b in bins])
        places = np.concatenate([np.arange(len(b)) for b in bins])
        yield pa.RecordBatch.from_arrays([pa.array(halves, pa.int64()), pa.array(places, pa.int64()), pa.array(np.concatenate(bins))], names=["half", "bin", "n"])

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: released(run(batches)), "half long, bin long, n long").groupBy("half", "bin").agg(F.sum("n").alias("n"))
    bins = [np.zeros(len(c) + 1, np.int64) for c in cuts]
    for r in counted.collect():  # at most 184 rows
        bins[r["half"]][r["bin"]] = r["n"]
    return [(b[::-1].cumsum()[::-1][1:], int(b.sum())) for b in bins]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_unlabelled: int = 8_000, default_prior: float = 0.5) -> Model:
    """Fit on at most max_labelled labelled and max_unlabelled unlabelled rows outside the held-out fold; the prior is that of all docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return fit(*training_rows(docs, labels, max_labelled, max_unlabelled), lambda models, cuts: tail_counts(docs, models, cuts), default_prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add score and predicted (under these names or others) to every document."""
    kept = columns_but(docs, set(names)) if keep is None else keep
    inner = docs.select(*kept, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([text_features(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
        s = model.score(x)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=schema.fieldNames())

    return map_rows(inner, run, schema)
