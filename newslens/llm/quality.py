"""Quality classifier by positive-unlabelled learning (operator 3).

Trusted positives are documents whose label is 1 and may be learned; the unlabelled side
is the text of every other document, and its labels, if any, are not read.  The class prior (share of positives in unlabelled text) is
estimated first: plain positive-against-unlabelled networks are fitted on three folds, and on held-out
rows the least smoothed ratio U(f > t) / P(f > t) over thresholds t estimates the prior, as the
top of the scale holds positives only (with a few hundred positives the least of several noisy ratios
is low by up to a tenth; the order of the scores does not suffer).  A second network then minimises the
non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss, so its sigmoid is the score.  A label of 0 says no more than none.

Features are read off whole texts in numpy: byte frequencies, the last bytes of words,
and rates of repeated words, repeated lines and case.  The network is fitted on the
driver from a bounded sample, `sample_rows` positives and as many unlabelled texts,
taken by hash of the id from each side by itself, so that neither side's sample shrinks
as the other grows; scoring covers every row in Arrow batches.

Nulls and empty texts get the score of the empty text.  Documents with conflicting
labels are no positives.  Ties and repeated rows score alike.  With fewer than
`LEAST` positives or unlabelled texts there is nothing to learn from: `train` warns and
gives no network, and every score is 1 (all are kept).
An empty table gives no rows.  Other columns pass through; a column that has the name
of the score column is replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import SPACES, Scratch, in_arrow, run_hashes, spans, text_bytes, text_slices

ENDS = 128
RATES = 8
FEATURES = 256 + ENDS + RATES
HIDDEN = 24
SAMPLE_ROWS = 6_000
LEAST = 10


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text."""
    data, offsets = text_bytes(column)
    n, size = len(column), np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    share = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    starts, ends, rows = spans(SPACES[data], offsets)
    words = np.diff(rows)
    word_owner, per_word = np.repeat(np.arange(n), words), 1 / np.maximum(words, 1)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    closing = np.bincount(word_owner * ENDS + np.minimum(last, ENDS - 1), minlength=n * ENDS).reshape(n, ENDS) * per_word[:, None]
    rates = np.zeros((n, RATES))
    if len(starts):
        hashes, length = run_hashes(data, starts, ends), ends - starts
        of = lambda x: np.bincount(word_owner, weights=x, minlength=n) * per_word
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1]))
        order = np.lexsort((hashes, word_owner))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (word_owner[order[1:]] == word_owner[order[:-1]])
        upper = np.cumsum(np.append(0, (data >= 65) & (data <= 90)))
        capitals = upper[ends] - upper[starts]
        rates[:, 0], rates[:, 1], rates[:, 2], rates[:, 3] = of(same), of(again), of(length) / 10, of(length == 1)
        rates[:, 4], rates[:, 5] = of(capitals > 1), of((capitals == 1) & (length > 1))
    line_starts, line_ends, lines = spans(data == 10, offsets)
    rates[:, 6] = np.diff(lines) / np.maximum(size, 1) * 100
    rates[:, 7] = np.log1p(words) / 10
    return np.concatenate([np.log1p(1000 * share), np.log1p(100 * closing), rates], axis=1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Standardised features, one hidden layer, a logistic unit."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int) -> Network:
        r = np.random.default_rng(seed)
        w = {"a": r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
        return cls(x.mean(axis=0, dtype=np.float64), 1 / np.maximum(x.std(axis=0, dtype=np.float64), 0.05), {k: v.astype(np.float64) for k, v in w.items()})

    def layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.maximum(s @ self.w["a"] + self.w["b"], 0)
        return s, h, h @ self.w["c"] + self.w["d"][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        parts = [_sigmoid(self.layers(x[i : i + 512])[2]) for i in range(0, len(x), 512)]
        return np.concatenate([*parts, np.zeros(0)])

    def fit(self, p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = 25, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3) -> Network:
        """Minimise the non-negative risk; with no prior, the plain loss of P against U."""
        r, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in "mv")
        for _ in range(epochs):
            batches = max(1, len(u) // 256)
            for i, j in zip(np.array_split(r.permutation(len(p)), batches), np.array_split(r.permutation(len(u)), batches), strict=True):
                if not len(i) or not len(j):
                    continue
                s, h, z = self.layers(np.concatenate([p[i], u[j]]))
                zp, zu = z[: len(i)], z[len(i) :]
                up, uu = _sigmoid(zp) / len(i), _sigmoid(zu) / len(j)  # slopes of l(-f)
                down = -_sigmoid(-zp) / len(i)  # slope of l(f)
                if prior is None:
                    dz = np.concatenate([down, uu])
                elif np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
                    dz = np.concatenate([prior * (down - up), uu])
                else:  # the negative risk has gone below zero: step back from it
                    dz = np.concatenate([prior * up, -uu])
                dh = dz[:, None] * self.w["c"] * (h > 0)
                step += 1
                for k, g in {"a": s.T @ dh, "b": dh.sum(axis=0), "c": h.T @ dz, "d": np.array([dz.sum()])}.items():
                    g = g + decay * self.w[k] * (k in "ac")
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def estimate_prior(p: np.ndarray, u: np.ndarray, folds: int = 3, smooth: int = 9) -> float:
    """Share of positives among unlabelled rows, from the tail ratio on held-out rows: the mean curve of all folds, smoothed over neighbouring thresholds."""
    curves = []
    for k in range(folds):
        held_p, held_u = np.arange(len(p)) % folds == k, np.arange(len(u)) % folds == k
        net = Network.fresh(np.concatenate([p, u]), 5 + k).fit(p[~held_p], u[~held_u], None, epochs=8)
        fp, fu = net.score(p[held_p]), net.score(u[held_u])
        curves.append([(fu >= t).mean() / max((fp >= t).mean(), 1e-9) for t in np.quantile(fp, np.linspace(0, 0.7, 36))])
    curve = np.convolve(np.mean(curves, axis=0), np.full(smooth, 1 / smooth), "valid")
    return float(np.clip(curve.min(), 0.05, 0.97))


def train(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | None:
    """Fit on at most `sample_rows` positives and as many unlabelled documents.

    learnable: condition on the id of rows whose labels may be used.
    """
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("least"))
    trusted = marked.where(F.col("least") == 1)
    if learnable is not None:
        trusted = trusted.where(learnable)
    # who is sampled is settled on ids alone; texts are read for the chosen rows only
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col, F.lit(1)).alias("key")).distinct()
    sides = ids.join(trusted.select("id", F.lit(True).alias("positive")), "id", "left").select("id", "key", F.coalesce("positive", F.lit(False)).alias("positive"))
    sides = Scratch(docs.sparkSession, "quality").table(sides, "sides")
    sizes = {r.positive: r["count"] for r in sides.groupBy("positive").count().collect()}
    chosen = []
    for side, positive in ((F.col("positive"), True), (~F.col("positive"), False)):
        share = max(1, sizes.get(positive, 0) // (4 * sample_rows))  # leaves four times the sample, for a small sort
        chosen.append(sides.where(side & (F.pmod("key", F.lit(share)) == 0)).orderBy("key").limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")  # 2 * sample_rows rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = [r.tobytes() for r in features(part.column("text")).astype("<f4")]
                yield pa.RecordBatch.from_pydict({"positive": part.column("positive"), "key": part.column("key"), "x": pa.array(x, pa.binary())})

    found = in_arrow(rows.select("text", "positive", "key"), extract, "positive boolean, key long, x binary").groupBy("key", "positive").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: (r.key, r.x))
    two = [np.frombuffer(b"".join(bytes(r.x) for r in found if r.positive == side), "<f4").reshape(-1, FEATURES) for side in (True, False)]
    if min(map(len, two)) < LEAST:
        warnings.warn(f"quality: {len(two[0])} positives and {len(two[1])} unlabelled texts are too few to learn from, every score will be 1", stacklevel=2)
        return None
    p, u = two
    return Network.fresh(np.concatenate([p, u]), 1).fit(p, u, estimate_prior(p, u))


def with_score(docs: DataFrame, network: Network | None, score_col: str = "quality_score", text_col: str = "text") -> DataFrame:
    """The rows with a score from 0 to 1 beside their columns."""
    docs = docs.drop(score_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                x = features(part.column(text_col))
                got = np.ones(len(x)) if network is None else network.score(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, score_col])

    return in_arrow(docs, score, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str) -> Column:
    """The quarter of the ids whose labels are never learned."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
