"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import SLICE_BYTES, SLICE_WORDS, U64, Words, bound_batches, drop_written, pieces, slices, text_buffer, text_of, written

#: All labelled documents are fitted on. At most so many, of no more bytes each, are fitted on by the driver; others by
#: up to SHARDS tasks an epoch, of SHARD_ROWS documents at least.
SAMPLE = 8_000
SAMPLE_BYTES = 64 << 10
SHARDS = 16
SHARD_ROWS = 8_192
#: Rows of a weight in a message from a task.
CHANGED = 4_096
#: Documents among which a task's order is shuffled.
SHUFFLED = 1_024
#: Bits of the filter of labelled ids, a power of two; it is broadcast as words of 64, some 10 MB at most.
FILTER_LOG2 = 24
#: Steps of the scores that thresholds tell apart where tasks score the held-out rows.
SCORE_STEPS = 100_000
HELD_OUT = 0.3
BUCKETS_LOG2 = 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS = 6
BATCH = 64
#: A language with fewer held-out toxic rows gets the threshold of all languages.
LEAST_POSITIVES = 10

_PAD = max(WIDTHS) - 1
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SALTS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93)]


def _ids(words: Words) -> np.ndarray:
    ids = np.empty((len(words.start), 1 + len(PREFIXES)), np.uint16)
    with np.errstate(over="ignore"):
        for j, n in enumerate([None, *PREFIXES]):
            h = words.hashes() if n is None else words.hashes(words.start, np.minimum(words.start + n, words.end))
            ids[:, j] = (h * _SALTS[j]) >> U64(64 - BUCKETS_LOG2)
    return ids


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, words x (1 + prefixes); first word of each text and the end). A word is a run of letters and
    digits in lower case; besides its own bucket it has one for each of its beginnings of 4, 5 and 6 bytes, so that
    inflected forms that were never seen share what their stems have learnt."""
    words = Words(pc.utf8_lower(texts), keep=_WORD)
    return _ids(words), words.first


def long_features(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket ids of one text of these bytes, in pieces of bounded size."""
    for a, b in pieces(data):
        ids = _ids(Words(pc.utf8_lower(text_of(data[a:b])), keep=_WORD))
        for i in range(0, len(ids), SLICE_WORDS):
            yield ids[i : i + SLICE_WORDS]


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]  # of each width: width x DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = float("inf")

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        f4 = np.float32
        return cls(
            r.normal(0, 0.05, (1 << BUCKETS_LOG2, DIM)).astype(f4),
            [r.normal(0, 0.4, (w, DIM, FILTERS)).astype(f4) for w in WIDTHS],
            [np.zeros(FILTERS, f4) for _ in WIDTHS],
            np.abs(r.normal(0.3, 0.1, FILTERS * len(WIDTHS))).astype(f4),
            -2.0,
        )

    def maps(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(embedded words with padding after each text, start of each text in them, feature maps, filters x words, by width)."""
        n = len(first) - 1
        lengths = np.diff(first)
        start = first[:-1] + _PAD * np.arange(n)
        x = np.zeros((len(ids) + _PAD * (n + 1), DIM), np.float32)
        row = np.arange(len(ids)) + _PAD * np.repeat(np.arange(n), lengths)
        embedded = self.table[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            embedded += self.table[ids[:, j]]
        x[row] = embedded
        size = len(x) - _PAD
        ends = np.append(start[1:], size)
        y = np.concatenate([k.T for kernel in self.kernels for k in kernel]) @ x.T
        out, at = [], 0
        for kernel, bias in zip(self.kernels, self.biases):
            h = y[at : at + FILTERS, :size]
            h += bias[:, None]
            at += FILTERS
            for j in range(1, len(kernel)):
                h += y[at : at + FILTERS, j : size + j]
                at += FILTERS
            np.maximum(h, 0, out=h)
            for j in range(1, len(kernel)):  # windows that begin in the padding and reach the next text
                h[:, ends - j] = 0
            out.append(h)
        return x, start, out

    def pooled(self, ids: np.ndarray, first: np.ndarray, stop: int | None = None) -> np.ndarray:
        """Greatest value of each filter over the windows of each text; of one text, over those that begin before word `stop`."""
        _, start, maps = self.maps(ids, first)
        if stop is not None:
            maps = [h[:, :stop] for h in maps]
        return np.concatenate([np.maximum.reduceat(h, start, axis=1) for h in maps])

    def winners(self, ids: np.ndarray, first: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(`pooled`, texts x filters; the word of each text at which the winning window begins). Texts of many words
        are worked through in pieces that overlap by what a window reaches beyond its first word."""
        n = len(first) - 1
        if len(ids) > SLICE_WORDS + _PAD:
            value, word = np.full((n, FILTERS * len(WIDTHS)), -1, np.float32), np.zeros((n, FILTERS * len(WIDTHS)), np.int64)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                for at in range(a, max(b, a + 1), SLICE_WORDS):
                    part, last = ids[at : min(b, at + SLICE_WORDS + _PAD)], at + SLICE_WORDS >= b
                    v, w = self.winners(part, np.array([0, len(part)]), None if last else SLICE_WORDS)
                    better = v[0] > value[i]
                    value[i, better], word[i, better] = v[0, better], w[0, better] + at - a
            return value, word
        x, start, maps = self.maps(ids, first)
        ends = np.append(start[1:], len(x) - _PAD) if stop is None else np.array([stop])
        word = np.concatenate([np.stack([h[:, a:b].argmax(1) for a, b in zip(start, ends)]) for h in maps], axis=1)
        at = word + start[:, None]
        return np.concatenate([h[np.arange(FILTERS), at[:, i * FILTERS : (i + 1) * FILTERS]] for i, h in enumerate(maps)], axis=1), word

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.empty(0, np.float32)
        return self.out @ self.pooled(ids, first) + self.bias

    def long_logits(self, parts: Iterator[np.ndarray]) -> np.ndarray:
        """The logit of one text whose ids come in parts: max pooling over parts that overlap by what a window reaches
        beyond its first word is max pooling over the whole."""
        held, best = None, None
        for ids in chain(parts, [None]):
            if ids is not None:
                held, ids = (ids if held is None else np.concatenate([held, ids])), held
                if len(held) <= _PAD:
                    continue
                value = self.pooled(held, np.array([0, len(held)]), len(held) - _PAD)
                held = held[-_PAD:]
            else:
                held = np.empty((0, 1 + len(PREFIXES)), np.uint16) if held is None else held
                value = self.pooled(held, np.array([0, len(held)]))
            best = value if best is None else np.maximum(best, value)
        return self.out @ best + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities; of whole texts, in slices of bounded bytes."""
        parts = []
        for a, b in slices(texts):
            data, _ = text_buffer(texts[a:b])
            long = b - a == 1 and len(data) > SLICE_BYTES
            parts.append(self.long_logits(long_features(data)) if long else self.logits(*features(texts[a:b])))
        return 1 / (1 + np.exp(-np.concatenate(parts).astype(np.float64))) if parts else np.empty(0)

    def step(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, memory: dict, rate: float) -> None:
        """One step of Adagrad down the weighted logistic loss; max pooling sends gradients to the winners only."""
        n = len(y)
        pooled, winner = self.winners(ids, first)
        size = np.diff(first)[:, None]
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.bias)))
        dz = ((p - y) * weight / n).astype(np.float32)
        dpool = np.where(pooled > 0, dz[:, None] * self.out, 0).astype(np.float32)
        rows, grads, dkernels, dbiases = [], [], [], []
        for i, kernel in enumerate(self.kernels):
            g, at = dpool[:, i * FILTERS : (i + 1) * FILTERS], winner[:, i * FILTERS : (i + 1) * FILTERS]
            dkernel = np.empty_like(kernel)
            for j in range(len(kernel)):
                row = np.where(at + j < size, first[:-1, None] + at + j, -1)  # beyond its end a text is padded by zeros
                x = np.zeros((*row.shape, DIM), np.float32)
                x[row >= 0] = self.table[ids[row[row >= 0]]].sum(axis=1)
                dkernel[j] = np.einsum("nfd,nf->df", x, g)
                rows.append(row.ravel())
                grads.append((g[:, :, None] * kernel[j].T[None]).reshape(-1, DIM))
            dkernels.append(dkernel)
            dbiases.append(g.sum(0))

        def update(name: str, value: np.ndarray, grad: np.ndarray) -> None:
            m = memory.setdefault(name, np.full_like(value, 1e-4))
            m += grad * grad
            value -= rate * grad / np.sqrt(m)

        update("out", self.out, pooled.T @ dz)
        bias = np.array([self.bias], np.float32)
        update("bias", bias, np.array([dz.sum()], np.float32))
        self.bias = float(bias[0])
        for i in range(len(self.kernels)):
            update(f"k{i}", self.kernels[i], dkernels[i])
            update(f"b{i}", self.biases[i], dbiases[i])
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        there = (rows >= 0) & grads.any(1)
        touched = ids[rows[there]]
        uniq, inverse = np.unique(touched, return_inverse=True)
        total = np.zeros((len(uniq), DIM), np.float32)
        for j in range(touched.shape[1]):
            np.add.at(total, inverse.reshape(touched.shape)[:, j], grads[there])
        m = memory.setdefault("table", np.full_like(self.table, 1e-4))
        m[uniq] += total * total
        self.table[uniq] -= rate * total / np.sqrt(m[uniq])


def best_threshold(scores: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Score from which a text counts as toxic, for the highest F1; the middle of a plateau. Infinite without positives.
    n: texts of each score, of which y are toxic; one each by default."""
    if not y.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.cumsum(np.ones(len(s)) if n is None else n[order]) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores go together
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float((s[k] + below) / 2)


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """`fit_features` of texts."""
    return fit_features([features(pa.array([t]))[0] for t in texts], toxic, langs, epochs, seed)


def fit_features(seen: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model from the bucket ids of labelled texts, with thresholds calibrated on the part held out: one for each
    language that has toxic rows enough there, one for the rest. Without two classes nothing counts as toxic."""
    model = Model.fresh(seed)
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return model
    r = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for value in (0, 1):  # both classes in both parts
        rows = r.permutation(np.flatnonzero(y == value))
        held[rows[: int(len(rows) * HELD_OUT)]] = True
    train = np.flatnonzero(~held)
    weight = np.where(y == 1, min(10.0, np.sqrt((y == 0).sum() / y.sum())), 1.0)
    memory: dict = {}
    for epoch in range(epochs):
        for batch in np.array_split(r.permutation(train), max(1, len(train) // BATCH)):
            first = np.cumsum([0, *(len(seen[i]) for i in batch)])
            model.step(np.concatenate([seen[i] for i in batch]), first, y[batch], weight[batch], memory, 0.1 if epoch < epochs // 2 else 0.05)
    rows = np.flatnonzero(held) if held.any() and y[held].any() else np.arange(len(y))
    scores = np.concatenate([1 / (1 + np.exp(-model.logits(seen[i], np.array([0, len(seen[i])])).astype(np.float64))) for i in rows])
    model.default = best_threshold(scores, y[rows])
    lang = np.array([x or "" for x in langs])[rows]
    for name in sorted({x for x in langs if x}):
        own = lang == name
        if y[rows][own].sum() >= LEAST_POSITIVES:
            model.thresholds[name] = best_threshold(scores[own], y[rows][own])
    return model


@F.arrow_udf(T.BinaryType())
def _packed_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out = []
        for a, b in slices(texts):
            data, _ = text_buffer(texts[a:b])
            if b - a == 1 and len(data) > SLICE_BYTES:
                out.append(b"".join(ids.tobytes() for ids in long_features(data)))
                continue
            ids, first = features(texts[a:b])
            out += [ids[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
        yield pa.array(out, pa.binary())


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, text, lang), a row an id: the greatest of its labels that aren't null, and of its texts that aren't
    null the one of the least hash. A filter of bounded size keeps most of the other documents out of the shuffle."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    bit = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << FILTER_LOG2) - 1))
    words = known.select(F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("k")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("b"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang", F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("k"))
    rows = rows.join(F.broadcast(words), "w").where("shiftright(b, k) & 1L = 1L").select("doc_id", "text", "lang")
    ones = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("d"))
    return ones.join(known, "doc_id").select("doc_id", "y", "d.text", "d.lang")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None, np.ndarray]]:
    for y, lang, ids in zip(batch.column("y").to_pylist(), batch.column("lang").to_pylist(), batch.column("ids")):
        yield y, lang, np.frombuffer(ids.as_buffer(), np.uint16).reshape(-1, 1 + len(PREFIXES))


def _state(model: Model, memory: dict) -> dict[str, np.ndarray]:
    """Views of all that a step changes, but for the bias, which is a copy."""
    weights = {"table": model.table, "out": model.out, "bias": np.array([model.bias], np.float32)}
    for i in range(len(model.kernels)):
        weights |= {f"k{i}": model.kernels[i], f"b{i}": model.biases[i]}
    return weights | {f"m_{k}": memory.setdefault(k, np.full_like(v, 1e-4)) for k, v in weights.items()}


def _epoch(model: Model, memory: dict, epoch: int, epochs: int, toxic_weight: float, seed: int):
    """Steps over a task's rows, in batches of a shuffled buffer; returns what they changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = _state(model, memory), []
        before = {k: v.copy() for k, v in own.items()}
        r = np.random.default_rng(seed + epoch)

        def steps() -> None:
            for part in np.array_split(r.permutation(len(held)), max(1, len(held) // BATCH)):
                y = np.array([held[i][0] for i in part], np.float32)
                first = np.cumsum([0, *(len(held[i][2]) for i in part)])
                model.step(np.concatenate([held[i][2] for i in part]), first, y, np.where(y == 1, toxic_weight, 1.0), memory, 0.1 if epoch < epochs // 2 else 0.05)
            held.clear()

        for row in (row for batch in batches for row in _unpacked(batch)):
            held.append(row)
            if len(held) == SHUFFLED or len(row[2]) > SLICE_WORDS:
                steps()
        if held:
            steps()
        after = _state(model, memory)
        changes = {k: after[k] - before[k] for k in before}
        task = TaskContext.get().partitionId()
        for k, v in changes.items():
            for at in range(0, len(v), CHANGED):
                yield pa.record_batch([pa.array([k]), pa.array([at]), pa.array([task]), pa.array([v[at : at + CHANGED].astype(np.float32).tobytes()])], names=["name", "at", "task", "change"])

    return run


def _averaged(shapes: dict[str, tuple[int, ...]]):
    """Rows (name, at, task, change), sorted, to one row (name, at, change) for the changes of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def mean() -> pa.RecordBatch:
            value = total / np.maximum(tasks, 1).reshape(-1, *[1] * (total.ndim - 1))
            return pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.array([value.astype(np.float32).tobytes()])], names=["name", "at", "change"])

        key, total, tasks = None, None, None
        for batch in batches:
            for name, at, change in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist(), batch.column("change")):
                value = np.frombuffer(change.as_buffer(), np.float32).reshape(-1, *shapes[name][1:])
                if key != (name, at):
                    if key:
                        yield mean()
                    key, total, tasks = (name, at), np.zeros_like(value), np.zeros(len(value), np.int32)
                total += value
                tasks += value.reshape(len(value), -1).any(1)
        if key:
            yield mean()

    return run


def fit_shards(rows: DataFrame, counts: tuple[int, int], shards: int, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model from all rows (y, lang, held, ids): in each epoch every task steps from the same model through its rows,
    and each weight moves by the mean of what the tasks that changed it changed. Thresholds as in `fit_features`, from
    counts of all rows held out by score and language. counts: of the rows to train on, by class."""
    model, memory = Model.fresh(seed), {}
    weight = min(10.0, float(np.sqrt(counts[0] / counts[1])))
    own = rows.where("not held").coalesce(shards)
    for epoch in range(epochs):
        state = _state(model, memory)
        changes = own.mapInArrow(_epoch(model, memory, epoch, epochs, weight, seed), "name string, at long, task long, change binary")
        changes = changes.repartition("name", "at").sortWithinPartitions("name", "at", "task")
        means = changes.mapInArrow(_averaged({k: v.shape for k, v in state.items()}), "name string, at long, change binary")
        for name, at, change in means.collect():
            part = state[name][at : at + CHANGED]
            part += np.frombuffer(change, np.float32).reshape(part.shape)
        model.bias = float(state["bias"][0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, lang, z = [], [], []
            for value, name, ids in _unpacked(batch):
                y.append(value)
                lang.append(name or "")
                z.append(float(model.long_logits(ids[i : i + SLICE_WORDS] for i in range(0, len(ids), SLICE_WORDS))))
            step = np.rint(SCORE_STEPS / (1 + np.exp(-np.array(z)))).astype(np.int64)
            yield pa.record_batch([pa.array(y, pa.int64()), pa.array(lang, pa.string()), pa.array(step)], names=["y", "lang", "step"])

    scored = rows.where("held").mapInArrow(score, "y long, lang string, step long").groupBy("lang", "step").agg(F.sum("y").alias("y"), F.count("*").alias("n")).toPandas()
    step, y, n = (scored[c].to_numpy() for c in ("step", "y", "n"))
    if len(scored):
        at, where = np.unique(step, return_inverse=True)
        model.default = best_threshold(at / SCORE_STEPS, np.bincount(where, y), np.bincount(where, n))
    for name in sorted({x for x in scored["lang"] if x}):
        own = (scored["lang"] == name).to_numpy()
        if y[own].sum() >= LEAST_POSITIVES:
            model.thresholds[name] = best_threshold(step[own] / SCORE_STEPS, y[own], n[own])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int | None = None, label: str = "toxic", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on all labelled documents, or, if `sample` is given, on at most so many of at most `sample_bytes` bytes each,
    chosen by a hash of their ids.

    One label an id: the greatest of its labels that aren't null. One text an id: of several rows of an id the one
    whose text has the least hash. Labels whose document is missing or has no text are left out. Texts are read once;
    words are hashed where they are. Of at most SAMPLE documents of at most `sample_bytes` the driver gets the bucket
    numbers and fits; else tasks do (`fit_shards`)."""
    bound_batches(docs.sparkSession)
    if sample is not None:
        return _train_sample(docs, labels, sample, label, sample_bytes)
    rows = _labelled(docs, labels.withColumnRenamed(label, "toxic") if label != "toxic" else labels)
    hashed = rows.select("doc_id", "y", "lang", F.octet_length("text").alias("bytes"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held")), F.lit(1000)) < 1000 * HELD_OUT).alias("held"), _packed_features("text").alias("ids"))
    rows = written(hashed, "labelled")
    seen = {(r["held"], r["y"]): r for r in rows.groupBy("held", "y").agg(F.count("*").alias("n"), F.max("bytes").alias("most")).collect()}
    count = lambda y, *held: sum(seen[h, y]["n"] for h in held if (h, y) in seen)
    n = sum(r["n"] for r in seen.values())
    if n <= SAMPLE and all(r["most"] <= sample_bytes for r in seen.values()):
        model = _fit_here(rows.select("doc_id", "y", "lang", "ids").collect())
    elif not count(0, True, False) or not count(1, True, False):
        model = Model.fresh()
    else:
        if not all(count(y, h) for y in (0, 1) for h in (True, False)):  # a class is missing in a part: both are all rows
            part = rows.withColumn("held", F.explode(F.array(F.lit(False), F.lit(True))))
            counts = (count(0, True, False), count(1, True, False))
        else:
            part, counts = rows, (count(0, False), count(1, False))
        model = fit_shards(part, counts, min(SHARDS, max(1, n // SHARD_ROWS)))
    drop_written(rows)
    return model


def _fit_here(got: list) -> Model:
    got.sort(key=lambda x: x["doc_id"])
    seen = [np.frombuffer(x["ids"], np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in got]
    return fit_features(seen, np.array([x["y"] for x in got]), [x["lang"] for x in got])


def _train_sample(docs: DataFrame, labels: DataFrame, sample: int, label: str, sample_bytes: int) -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    usable = F.octet_length("text").between(0, sample_bytes)
    there = docs.select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` narrow rows, so broadcast whatever the size of the labels
    rows = docs.where(usable).select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    ones = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("d"))
    got = ones.select("doc_id", "y", "d.lang", _packed_features("d.text").alias("ids")).collect()
    return _fit_here(got)


def score_columns(docs: DataFrame, model: Model) -> tuple[Column, Column]:
    """(score, threshold) as columns of docs."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(texts))

    threshold = F.lit(model.default)
    for name, value in sorted(model.thresholds.items()):
        threshold = F.when(docs["lang"] == name, value).otherwise(threshold)
    return score(F.coalesce(docs["text"], F.lit(""))), threshold


def classify(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) of every row.

    Null and empty text: the score of a text without words. Null or unseen language: the threshold of all languages.
    Repeated rows: a row each, with equal scores. Very long texts are scored whole, in pieces whose windows overlap.
    No toxic labels: threshold infinite, nothing toxic. Labels that are null, contradict each other or lack a document:
    see `train`. Empty table: empty result. Other columns are not read. Only rows of labelled ids are shuffled."""
    score, threshold = score_columns(docs, train(docs, labels, sample))
    scored = docs.select("doc_id", "lang", score.alias("score"), threshold.alias("threshold"))
    return scored.withColumn("toxic", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> DataFrame:
    """docs without the rows that `classify` calls toxic; all columns stay as they are, whatever their names.

    Null and empty texts stay unless a text without words scores as toxic; null languages, repeated rows, very long
    texts and labels as in `classify`. Empty table: empty result; without toxic labels all rows stay."""
    score, threshold = score_columns(docs, train(docs, labels, sample))
    return docs.where(score < threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
