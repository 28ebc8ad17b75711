"""Toxicity scores by a factorization machine over hashed terms.

The terms of a text are its words (runs of letters, A-Z lower-cased) and the first four and six bytes of longer
words, hashed into a fixed number of bins; a text has a term or not. The machine adds a bias, a weight for each
term, and the inner products of the factors of all pairs of terms, so that a pair such as an insult next to the
mention of a group can weigh more than the two alone.

Training reads at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of their doc_id: a documented
bound on labelled rows. It looks first at how terms and labels go together over that sample and keeps the terms that
differ between the classes by more than chance, alone or in pairs: of the ``PAIR_TERMS`` most frequent terms all pairs
are counted, and both terms of a pair stay whose share of toxic texts is not what the two explain each by itself.
Everything else covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from exposura.llm.text_kernel import NOT_LETTER, mix, prefix_names, released, row_lists, slices, span_names, word_spans
from exposura.session import materialize

SAMPLE_ROWS = 20_000
BIN_BITS = 20
FACTORS = 8
EPOCHS = 30
BATCH = 256
RATE, FACTOR_RATE, SPREAD = 0.1, 0.03, 0.02
RIDGE = 2e-4
# A term is kept if at least so many sampled texts have it and its z-score between the classes is so large,
LEAST_TEXTS = 4
LEAST_Z = 2.5
# or if that of a pair is, beyond what its terms explain alone; among millions of pairs chance goes further.
LEAST_PAIR_TEXTS = 10
LEAST_PAIR_Z = 6.0
PAIR_TERMS = 2048
FOLDS = 5


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all terms, with the row of each; not distinct yet."""
    starts, ends, first = word_spans(data, offsets, NOT_LETTER)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    running = prefix_names(data, lower=True)
    parts, rows = [span_names(running, starts, ends)], [owner]
    for width in (4, 6):
        long = ends - starts > width
        parts.append(mix(span_names(running, starts[long], starts[long] + width) + np.uint64(width)))
        rows.append(owner[long])
    return (np.concatenate(parts) >> np.uint64(64 - BIN_BITS)).astype(np.int64), np.concatenate(rows)


def _distinct(bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.unique((rows << BIN_BITS) | bins)
    return codes & ((1 << BIN_BITS) - 1), codes >> BIN_BITS


@dataclass
class Machine:
    """A fitted machine: ``place`` gives each bin its row in ``weights`` and ``factors``, or -1."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, bins: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        at = self.place[bins]
        used = at >= 0
        at, rows = at[used], rows[used]
        logit = self.bias + np.bincount(rows, self.weights[at], minlength=count)
        for k in range(self.factors.shape[1]):
            v = self.factors[at, k]
            total = np.bincount(rows, v, minlength=count)
            logit += 0.5 * (total ** 2 - np.bincount(rows, v * v, minlength=count))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


class _Batch:
    """Some texts' terms, laid out once for sums by text and by term."""

    def __init__(self, lists: list[np.ndarray], labels: np.ndarray):
        sizes = np.array([len(x) for x in lists])
        filled = np.flatnonzero(sizes)
        at = np.concatenate([lists[i] for i in filled]) if len(filled) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(filled)), sizes[filled])
        order = np.argsort(at, kind="stable")
        self.filled, self.labels, self.count = filled, labels, len(lists)
        self.starts = (np.cumsum(sizes[filled]) - sizes[filled]).astype(np.int64)
        self.used, self.first = np.unique(at[order], return_index=True)
        self.local = np.searchsorted(self.used, at).astype(np.int32)  # by text
        self.by_term = rows[order].astype(np.int32)  # texts, by term


def fit_machine(lists: list[np.ndarray], labels: np.ndarray, place: np.ndarray, seed: int = 7) -> Machine:
    """Minimise log loss with AdaGrad steps over small batches. ``lists``: places of each text's kept terms."""
    rng = np.random.default_rng(seed)
    count, size = len(labels), int(place.max(initial=-1)) + 1
    rate = (labels.sum() + 1) / (count + 2)
    bias = float(np.log(rate / (1 - rate)))
    weights, factors = np.zeros(size), rng.normal(0, SPREAD, (size, FACTORS))
    if not 0 < labels.sum() < count or not size:
        return Machine(bias, place, weights, np.zeros((size, FACTORS)))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    mixed = rng.permutation(count)
    batches = [_Batch([lists[i] for i in some], labels[some]) for some in np.array_split(mixed, -(-count // BATCH))]
    for _ in range(EPOCHS):
        for b in (batches[i] for i in rng.permutation(len(batches))):
            own = factors[b.used]
            logit, total = np.full(b.count, bias), np.zeros((len(b.filled), FACTORS))
            if len(b.filled):
                v = own[b.local]
                total = np.add.reduceat(v, b.starts)
                square = np.add.reduceat((v * v).sum(1), b.starts)
                logit[b.filled] += np.add.reduceat(weights[b.used][b.local], b.starts) + 0.5 * ((total ** 2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - b.labels) / b.count
            grad_b = error.sum()
            seen_b += grad_b ** 2
            bias -= RATE * grad_b / np.sqrt(seen_b)
            if not len(b.filled):
                continue
            known = error[b.filled]
            pulled = np.add.reduceat(known[b.by_term], b.first)
            grad_w = pulled + RIDGE * weights[b.used]
            grad_v = np.add.reduceat((known[:, None] * total)[b.by_term], b.first) - pulled[:, None] * own + RIDGE * own
            seen_w[b.used] += grad_w ** 2
            seen_v[b.used] += grad_v ** 2
            weights[b.used] -= RATE * grad_w / np.sqrt(seen_w[b.used])
            factors[b.used] = own - FACTOR_RATE * grad_v / np.sqrt(seen_v[b.used])
    return Machine(bias, place, weights, factors)


def pair_terms(lists: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Places of the terms of pairs whose label is not explained by the two terms each by itself."""
    both, toxic = np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)
    for start in range(0, len(lists), 1024):
        some = lists[start:start + 1024]
        block = np.zeros((len(some), size), np.float32)
        block[np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)] = 1
        both += block.T @ block
        marked = block[labels[start:start + 1024] > 0]
        toxic += marked.T @ marked
    rate = labels.mean()
    own = np.diag(toxic) / np.maximum(np.diag(both), 1)
    usual = np.clip(own[:, None] + own[None, :] - rate, rate / 4, 1 - (1 - rate) / 4)
    z = (toxic - both * usual) / np.sqrt(np.maximum(both * usual * (1 - usual), 1e-9))
    strange = (np.abs(z) >= LEAST_PAIR_Z) & (both >= LEAST_PAIR_TEXTS)
    np.fill_diagonal(strange, False)
    return np.flatnonzero(strange.any(axis=0))


def held_out(doc_id: str, folds: int, fold: int):
    """Whether the CRC of the id's text falls in the fold kept from training; a null id never does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on the labelled rows outside the held-out fold. Rows of several labels count as toxic if one is."""
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", FOLDS, 0))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows ids

    def lists(keep):
        def work(batches):
            for batch in batches:
                for first, last, data, offsets in slices(batch.column(0)):
                    bins, rows = _terms(data, offsets)
                    if keep is not None:
                        at = keep[bins]
                        bins, rows = bins[at], rows[at]
                    bins, rows = _distinct(bins, rows)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(1).slice(first, last - first), row_lists(bins.astype(np.int32), rows, last - first, pa.int32()),
                    ], ["label", "bins"])

        return marked.select("text", "label").mapInArrow(released(work), "label double, bins array<int>")

    def gathered(place):
        """Places of each text's kept terms, and the labels; at most sample_rows, in an order of their own."""
        rows = lists(place >= 0).select("label", "bins", F.xxhash64("bins").alias("name")).toArrow()
        at, label = rows.column("bins").combine_chunks(), rows.column("label").to_numpy()
        texts = np.split(place[at.flatten().to_numpy()], at.offsets.to_numpy()[1:-1])
        order = np.lexsort((rows.column("name").to_numpy(), label))
        return [texts[i] for i in order], label[order]

    counted = lists(None).select("label", F.explode("bins").alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("label").alias("toxic")
    )
    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    n, t = totals["n"], totals["t"] or 0.0
    place = np.full(1 << BIN_BITS, -1, np.int32)
    if not 0 < t < n:
        return fit_machine([], np.full(n, 1.0 if t else 0.0), place)
    share, rate = F.col("texts") / n, t / n
    z = (F.col("toxic") - F.col("texts") * rate) / F.sqrt(F.col("texts") * rate * (1 - rate) * F.greatest(1 - share, F.lit(1e-9)))
    counted = materialize(counted.where(F.col("texts") >= LEAST_TEXTS))
    alone = [r[0] for r in counted.where(F.abs(z) >= LEAST_Z).select("bin").collect()]  # at most one entry for each bin
    frequent = counted.orderBy(F.desc("texts"), "bin").limit(PAIR_TERMS).select("bin").collect()
    place[[r[0] for r in frequent]] = np.arange(len(frequent))
    paired = np.array([r[0] for r in frequent], int)[pair_terms(*gathered(place), len(frequent))]
    kept = np.union1d(np.array(alone, int), paired)
    place[:] = -1
    place[kept] = np.arange(len(kept))
    return fit_machine(*gathered(place), place)


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a score from 0 to 1 and a prediction (1 from 0.5 on).

    A null, empty or unknown text gets the score of the bias alone. Columns called like the two new ones are
    replaced, all others and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the number of bins
    kept = [c for c in docs.columns if c not in (score, predicted)]
    place = kept.index(text)

    def work(batches):
        model = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in slices(batch.column(place)):
                bins, rows = _terms(data, offsets)
                used = model.place[bins] >= 0
                bins, rows = _distinct(bins[used], rows[used])
                scores.append(model.scores(bins, rows, len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*kept, score])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    scored = rows.mapInArrow(released(work), T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())]))
    return scored.withColumn(predicted, F.when(F.col(f"`{score}`") >= 0.5, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Without labelled rows, or with labels of one kind only, every text gets the smoothed share of toxic labels.
    Only doc_id, text and the label toxic are read; empty tables give an empty result.
    """
    machine = fit_toxicity(docs, labels)
    return score_toxicity(docs.select("doc_id", "text"), machine).select(
        "doc_id", held_out("doc_id", FOLDS, 0).alias("held_out"), "score", "predicted"
    )
