"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token's code is ``CODE_BITS`` bits of its name. Each bit is predicted by several counters: one for each of
no context, the token before, and the codes of the two tokens before, always together with the bits of the code
already known, hashed into a table of fixed size. A counter holds how often the bit was 0 and 1 over
all training texts. The predictions are joined in the logistic domain by weights that a gate picks: the place of
the bit and how much the counters have seen. A last table maps the mixed prediction, in steps, to what was
observed there. Within its code a token has its add-one share of the training tokens of that code, so every
token, known or not, has a probability, and those of all tokens sum to one.

Training is online and in one pass: a task predicts each batch with what it has counted before, corrects the
weights and the last table by the error, and then counts the batch. Counts are summed over all tasks; weights
and the last table are averaged, each entry by how often it was used. Scoring uses the summed counts as they
are, so a score does not depend on the order of texts.

The bits of a code stand for the bits of bytes: one decision for each bit of each byte would be forty for every
token, several times the processing time there is for a gigabyte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from exposura.llm.text_kernel import mix, slices, word_names
from exposura.llm.toxicity import held_out
from exposura.session import materialize

CODE_BITS = 8
CONTEXTS = 3
SLOT_BITS = 20
FOLDS, FOLD = 7, 2
# Tokens whose counts travel with the model; counts of all others are joined.
CARRIED_TOKENS = 1 << 17
_CHUNK = 4096
_LEVELS = 5  # of how much a counter has seen
_STEPS = 33  # of the last table
_GATES = CODE_BITS * _LEVELS * _LEVELS
_RATE = 0.02
_TEXT_BYTES = 1 << 18
_END = np.uint64(0x5851F42D4C957F2D)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the tokens of each row, the end included, the row of each, and each row's first token."""
    words, first = word_names(data, offsets)
    rows = len(offsets) - 1
    names = np.full(len(words) + rows, _END, np.uint64)
    starts = first[:-1] + np.arange(rows)
    is_word = np.ones(len(names), bool)
    is_word[first[1:] + np.arange(rows)] = False
    names[is_word] = words
    return names, np.repeat(np.arange(rows), np.diff(first) + 1), starts


def codes_of(names: np.ndarray) -> np.ndarray:
    return (mix(names ^ np.uint64(0xA5A5)) >> np.uint64(64 - CODE_BITS)).astype(np.int64)


def _context_names(names: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """One name per context and token, but for that of no context; before the first token of a row stands zero."""
    def back(values, by):
        out = np.zeros(len(values), values.dtype)
        same = rows[by:] == rows[:-by] if len(values) > by else np.zeros(0, bool)
        out[by:][same] = values[:-by][same]
        return out

    coded = codes + 1
    near = back(coded, 1) * (2 << CODE_BITS) + back(coded, 2)
    return [mix(back(names, 1)), mix(near.astype(np.uint64) + np.uint64(1))]


def _slots(context: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Slots of a context's counters; ``known`` is the code's bits so far with a leading one."""
    mixed = (context ^ (known.astype(np.uint64) << np.uint64(50))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


# By how often a counter was used, up to 64: the level that a gate looks at.
_LEVEL = np.digitize(np.arange(65), (1, 4, 16, 64)).astype(np.int64)
_GRID = _squash((np.arange(_STEPS) - _STEPS // 2) / 2.0)


class Mixer:
    """Counts ``[context, slot, bit]``, weights of each gate, and the last table."""

    def __init__(self):
        self.counts = np.zeros((CONTEXTS, 1 << SLOT_BITS, 2), np.uint32)
        self.weights = np.full((CONTEXTS, _GATES), 0.4, np.float32)
        self.last = np.tile(_GRID, (CODE_BITS, 1)).astype(np.float32)
        self.frozen = None

    def freeze(self) -> None:
        """Turn the counts into predictions and levels, once for all texts that are scored."""
        zeros, ones = self.counts[..., 0], self.counts[..., 1]
        self.frozen = [
            (np.log((ones[k] + np.float32(0.4)) / (zeros[k] + np.float32(0.4))).astype(np.float32),
             _LEVEL[np.minimum(zeros[k].astype(np.int64) + ones[k], 64)].astype(np.uint8))
            for k in range(CONTEXTS)
        ]
        self.counts = None

    def _inputs(self, number: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.frozen is not None:
            return self.frozen[number][0][at], self.frozen[number][1][at]
        pair = self.counts[number].view(np.uint64)[:, 0][at]  # both counts in one look-up
        zeros, ones = (pair & np.uint64(0xFFFFFFFF)).astype(np.float32), (pair >> np.uint64(32)).astype(np.float32)
        half = np.float32(0.4)
        return np.log((ones + half) / (zeros + half)), _LEVEL[np.minimum(zeros + ones, 64).astype(np.int64)]

    def run(self, names: np.ndarray, rows: np.ndarray, learn: "Usage | None" = None) -> np.ndarray:
        """Log2 probability of each token's code. With ``learn``, correct weights and last table and then count."""
        codes = codes_of(names)
        contexts = _context_names(names, rows, codes)
        total = np.ones(len(names))
        used_slots = []
        for bit in range(CODE_BITS):
            known = (1 << bit) | (codes >> (CODE_BITS - bit))
            actual = (codes >> (CODE_BITS - 1 - bit)) & 1
            slots = [known, *[_slots(context, known) for context in contexts]]
            inputs, levels = zip(*[self._inputs(number, at) for number, at in enumerate(slots)])
            gate = (bit * _LEVELS + levels[1].astype(np.int64)) * _LEVELS + levels[2]
            mixed = sum(self.weights[number][gate] * inputs[number] for number in range(CONTEXTS))
            np.clip(mixed, -7.9, 7.9, out=mixed)
            plain = 1 / (1 + np.exp(-mixed))
            place = mixed * 2 + np.float32(_STEPS // 2)
            low = place.astype(np.int64)
            part = place - low
            table = self.last[bit]
            refined = (1 - part) * table[low] + part * table[low + 1]
            p = np.clip((plain + refined) * np.float32(0.5), 1e-5, 1 - 1e-5)
            total *= np.where(actual == 1, p, 1 - p)
            if learn is not None:
                error = actual - plain
                times = np.bincount(gate, minlength=_GATES)
                for number in range(CONTEXTS):
                    step = np.bincount(gate, error * inputs[number], minlength=_GATES)
                    self.weights[number] += (_RATE * step / np.maximum(np.sqrt(times), 1)).astype(np.float32)
                np.clip(self.weights, -2, 4, out=self.weights)
                nearest = (place + np.float32(0.5)).astype(np.int64)
                learn.hits[bit] += np.bincount(nearest, minlength=_STEPS)
                learn.ones[bit] += np.bincount(nearest, actual, minlength=_STEPS)
                learn.gates += times
                self.last[bit] = (learn.ones[bit] + 20 * _GRID) / (learn.hits[bit] + 20)
                used_slots.append((slots, actual))
        for slots, actual in used_slots:
            self.counts[0].reshape(-1)[:4 << CODE_BITS] += np.bincount(
                slots[0] * 2 + actual, minlength=4 << CODE_BITS).astype(np.uint32)
            for number in range(1, CONTEXTS):
                np.add.at(self.counts[number].reshape(-1), slots[number] * 2 + actual, np.uint32(1))
        return np.log2(total)


class Usage:
    """How often each gate and each step of the last table was used in training."""

    def __init__(self):
        self.gates = np.zeros(_GATES)
        self.hits = np.zeros((CODE_BITS, _STEPS))
        self.ones = np.zeros((CODE_BITS, _STEPS))


def _chunks(kind: int, values: np.ndarray) -> pa.RecordBatch:
    """Rows ``(kind, chunk, values)`` of the chunks of a table that are not all zero."""
    flat = values.reshape(-1).astype(np.float64)
    flat = np.concatenate([flat, np.zeros(-len(flat) % _CHUNK)]).reshape(-1, _CHUNK)
    some = np.flatnonzero(flat.any(axis=1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * _CHUNK, pa.int32()), pa.array(flat[some].reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()), lists], ["kind", "chunk", "sums"])


def _sum_chunks(batches):
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(2).flatten().to_numpy().reshape(-1, _CHUNK)
        for key, row in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), values):
            sums[key] = sums[key] + row if key in sums else row.copy()
    for (kind, chunk), row in sums.items():
        lists = pa.ListArray.from_arrays(pa.array([0, _CHUNK], pa.int32()), pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([chunk], pa.int32()), lists], ["kind", "chunk", "sums"])


def fit_mixer(docs: DataFrame) -> Mixer:
    """Train on every row of ``docs(text)``."""
    def work(batches):
        model, usage = Mixer(), Usage()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), _TEXT_BYTES):
                names, rows, _ = tokens_of(data, offsets)
                model.run(names, rows, usage)
        for context in range(CONTEXTS):
            yield _chunks(context, model.counts[context])
        yield _chunks(10, model.weights * usage.gates)
        yield _chunks(11, usage.gates)
        yield _chunks(12, usage.hits)
        yield _chunks(13, usage.ones)

    schema = "kind int, chunk int, sums array<double>"
    summed = docs.select("text").mapInArrow(work, schema).repartition("kind", "chunk").mapInArrow(_sum_chunks, schema)
    model, sums = Mixer(), {}
    for row in summed.toLocalIterator():  # the tables of one model, whatever the size of the corpus
        size = {10: _GATES * CONTEXTS, 11: _GATES, 12: CODE_BITS * _STEPS, 13: CODE_BITS * _STEPS}
        values = np.array(row["sums"])
        if row["kind"] < CONTEXTS:
            flat = model.counts[row["kind"]].reshape(-1)
            at = row["chunk"] * _CHUNK
            flat[at:at + _CHUNK] = np.minimum(values, 2**32 - 1).astype(np.uint32)
        else:
            whole = sums.setdefault(row["kind"], np.zeros(-(-size[row["kind"]] // _CHUNK) * _CHUNK))
            whole[row["chunk"] * _CHUNK:(row["chunk"] + 1) * _CHUNK] = values
    if 11 in sums:
        gates = sums[11][:_GATES]
        used = gates > 0
        if 10 in sums:
            model.weights[:, used] = sums[10][:_GATES * CONTEXTS].reshape(CONTEXTS, _GATES)[:, used] / gates[used]
        hits = sums[12][:CODE_BITS * _STEPS].reshape(CODE_BITS, _STEPS)
        ones = sums.get(13, np.zeros_like(sums[12]))[:CODE_BITS * _STEPS].reshape(CODE_BITS, _STEPS)
        model.last = ((ones + 20 * _GRID) / (hits + 20)).astype(np.float32)
    model.freeze()
    return model


def token_counts(docs: DataFrame) -> DataFrame:
    """``(token, times)`` over all texts of ``docs``, summed within a task first."""
    def work(batches):
        held: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def flush():
            names, inverse = np.unique(np.concatenate(held), return_inverse=True)
            return names, np.bincount(inverse, np.concatenate(times)).astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                names, count = np.unique(tokens_of(data, offsets)[0], return_counts=True)
                held.append(names)
                times.append(count)
                size += len(names)
                if size > 1_000_000:
                    names, count = flush()
                    held, times, size = [names], [count], len(names)
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(count)], ["token", "times"])
                        held, times, size = [], [], 0
        if held:
            names, count = flush()
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(count)], ["token", "times"])

    return docs.select("text").mapInArrow(work, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))


@dataclass
class _Scorer:
    mixer: Mixer
    tokens: np.ndarray  # sorted names of the carried tokens
    logs: np.ndarray  # log10 of one more than their counts
    divisors: np.ndarray  # for each code, log10 of what add-one counts of its tokens sum to


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with the scores described in the module and the counts behind them.

    Columns: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``. A null or empty
    text is one token, the end; its bits per byte are null. A null doc_id counts as training. With no training text
    at all every count is zero and ``base_score`` counts one unknown token only. Repeated rows give repeated rows,
    other columns are ignored, an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out("doc_id", FOLDS, FOLD))
    training = docs.where("not held_out")
    counts = materialize(token_counts(training))
    total = counts.agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, vocabulary = total["n"] or 0, total["v"]
    carried = counts.orderBy(F.desc("times"), "token").limit(CARRIED_TOKENS).toPandas()  # a bounded table
    carried["name"] = carried["token"].to_numpy(np.int64).view(np.uint64)
    carried = carried.sort_values("name")
    code = F.pandas_udf(_code_series, "int")
    per_code = counts.groupBy(code("token").alias("code")).agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    divisors = np.zeros(1 << CODE_BITS)
    for row in per_code:
        divisors[row["code"]] = row["n"] + row["v"]
    scorer = _Scorer(
        fit_mixer(training), carried["name"].to_numpy(np.uint64), np.log10(carried["times"].to_numpy(float) + 1), np.log10(divisors + 1)
    )
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by the table sizes above
    schema = (
        "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, logs double, code_log double, "
        "rare array<struct<token:long,times:int>>"
    )

    def work(batches):
        model = shared.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1), _TEXT_BYTES):
                count = last - first
                names, rows, starts = tokens_of(data, offsets)
                code_log = np.bincount(rows, model.mixer.run(names, rows) * np.log10(2) - model.divisors[codes_of(names)], minlength=count)
                at = np.searchsorted(model.tokens, names)
                at[at == len(model.tokens)] = 0
                known = model.tokens[at] == names if len(model.tokens) else np.zeros(len(names), bool)
                logs = np.bincount(rows[known], model.logs[at[known]], minlength=count)
                rest, owner = names[~known], rows[~known]
                order = np.lexsort((rest, owner))
                rest, owner = rest[order], owner[order]
                new = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])]) if len(rest) else np.zeros(0, int)
                structs = pa.StructArray.from_arrays(
                    [pa.array(rest[new].view(np.int64)), pa.array(np.diff(np.r_[new, len(rest)]), pa.int32())], ["token", "times"]
                )
                ends = np.searchsorted(owner[new], np.arange(count + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, count), batch.column(2).slice(first, count), pa.array(np.diff(offsets)),
                    pa.array(np.bincount(rows, minlength=count)), pa.array(np.bincount(rows[known], minlength=count)), pa.array(logs),
                    pa.array(code_log), pa.ListArray.from_arrays(pa.array(ends), structs),
                ], ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "logs", "code_log", "rare"])

    scored = docs.select("doc_id", "text", "held_out").mapInArrow(work, schema)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    # counts of the tokens that are not carried come by a join; most of them are rare, so no key is hot
    rare = _rare(scored, counts)
    joined = scored.drop("rare").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    base_divisor = float(np.log10(train_tokens + vocabulary + 1))
    score = logs + F.col("code_log")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * base_divisor).alias("base_score"),
        score.alias("score"), F.when(F.col("n_bytes") > 0, -score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _rare(scored: DataFrame, counts: DataFrame) -> DataFrame:
    tokens = scored.select("row", F.inline("rare")).withColumnRenamed("times", "here")
    return tokens.join(counts, "token").groupBy("row").agg(
        F.sum("here").alias("rare_known"), F.sum(F.col("here") * F.log10(F.col("times") + 1)).alias("rare_logs")
    )


def _code_series(token: pd.Series) -> pd.Series:
    return pd.Series(codes_of(token.to_numpy(np.int64).view(np.uint64)).astype(np.int32))
