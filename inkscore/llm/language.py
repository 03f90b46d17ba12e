"""Language of a text by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes in both directions and labels every
position; a document's probabilities are the mean over its letters. It is
trained here, in numpy, by backpropagation through time on a bounded sample of
windows; every byte of every text is labelled when predicting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fold, free_name, in_batches, remember, with_column

UNKNOWN = "und"
FOLDS = 5
HIDDEN = 12
WINDOW = 96
# The bound of the training sample, in windows of WINDOW bytes, one a document.
SAMPLE = 6000
STEPS = 200
BATCH = 160
RATE = 0.01
# Windows that are labelled together when predicting.
TOGETHER = 2048

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """Gated recurrent units over a window, one direction.

    ``take`` holds for each byte its part of the three gates' inputs (update,
    reset, new), ``turn`` the weights of the state, ``bias`` that of the reset part.
    """

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.take = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.turn = (rng.standard_normal((hidden, 3 * hidden)) / hidden**0.5).astype(np.float32)
        self.bias = np.zeros(hidden, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.take, self.turn, self.bias]

    def states(self, windows: np.ndarray) -> np.ndarray:
        """States after each position: (positions, hidden, windows).

        Columns are windows, so that all arithmetic runs along them.
        """
        n, steps = windows.shape
        k = self.hidden
        # A sigmoid is a tanh of half its input.
        half = np.repeat(np.float32([0.5, 0.5, 1]), k)[:, None]
        take = np.ascontiguousarray(self.take.T * half)
        turn = np.ascontiguousarray(self.turn.T * half)
        bias = self.bias[:, None]
        out = np.empty((steps, k, n), np.float32)
        h = np.zeros((k, n), np.float32)
        for t in range(steps):
            gates = take.take(windows[:, t], axis=1)
            turned = turn @ h
            both = gates[: 2 * k]
            both += turned[: 2 * k]
            np.tanh(both, out=both)
            both += 1
            both *= 0.5
            new = turned[2 * k :]
            new += bias
            new *= both[k:]
            new += gates[2 * k :]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=out[t])
            h *= both[:k]
            h += new
        return out

    def trace(self, windows: np.ndarray) -> list[tuple]:
        """As :meth:`states`, with what the way back needs."""
        k = self.hidden
        h = np.zeros((len(windows), k), np.float32)
        steps = []
        for t in range(windows.shape[1]):
            gates = self.take[windows[:, t]]
            turned = h @ self.turn
            both = _sigmoid(gates[:, : 2 * k] + turned[:, : 2 * k])
            z, r = both[:, :k], both[:, k:]
            inner = turned[:, 2 * k :] + self.bias
            new = np.tanh(gates[:, 2 * k :] + r * inner)
            after = new + z * (h - new)
            steps.append((h, z, r, inner, new, after))
            h = after
        return steps

    def gradients(self, windows: np.ndarray, steps: list[tuple], d_states: np.ndarray):
        """Gradients of the parameters from those of the states, back through time."""
        k = self.hidden
        d_turn, d_bias = np.zeros_like(self.turn), np.zeros_like(self.bias)
        d_inputs = np.empty((windows.shape[1], len(windows), 3 * k), np.float32)
        carried = np.zeros((len(windows), k), np.float32)
        for t in range(windows.shape[1] - 1, -1, -1):
            h, z, r, inner, new, _ = steps[t]
            d = carried + d_states[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_gates = d_inputs[t]
            d_gates[:, :k] = d * (h - new) * z * (1 - z)
            d_gates[:, k : 2 * k] = d_new * inner * r * (1 - r)
            d_gates[:, 2 * k :] = d_new
            d_inner = d_new * r
            d_turned = np.concatenate([d_gates[:, : 2 * k], d_inner], axis=1)
            d_turn += h.T @ d_turned
            d_bias += d_inner.sum(axis=0)
            carried = d * z + d_turned @ self.turn.T
        at = windows.T.reshape(-1)
        order = np.argsort(at, kind="stable")
        flat = d_inputs.reshape(-1, 3 * k)[order]
        seen, first = np.unique(at[order], return_index=True)
        d_take = np.zeros_like(self.take)
        d_take[seen] = np.add.reduceat(flat, first, axis=0)
        return [d_take, d_turn, d_bias]


@dataclass
class Network:
    labels: list[str]
    forward: Direction
    backward: Direction
    weights: np.ndarray
    offsets: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of each label at each position: (positions, labels, windows)."""
        ahead, back = self.forward.states(windows), self.backward.states(windows[:, ::-1])
        k = self.forward.hidden
        odds = np.matmul(np.ascontiguousarray(self.weights[:k].T), ahead)
        odds += np.matmul(np.ascontiguousarray(self.weights[k:].T), back)[::-1]
        odds += self.offsets[:, None]
        odds -= odds.max(axis=1, keepdims=True)
        np.exp(odds, out=odds)
        odds /= odds.sum(axis=1, keepdims=True)
        return odds


def train(
    windows: np.ndarray,
    labels: list[str],
    hidden: int = HIDDEN,
    steps: int = STEPS,
    seed: int = 7,
) -> Network:
    """A network from windows of bytes (one a row, 0 behind a text's end)."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    wanted = np.searchsorted(names, labels)
    network = Network(
        names,
        Direction(rng, hidden),
        Direction(rng, hidden),
        (rng.standard_normal((2 * hidden, len(names))) * 0.1).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    parameters = [
        *network.forward.parameters(),
        *network.backward.parameters(),
        network.weights,
        network.offsets,
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    while step < steps:
        order = rng.permutation(len(windows))
        for low in range(0, len(order), BATCH):
            own = order[low : low + BATCH]
            if step == steps:
                break
            block, right = windows[own], wanted[own]
            ahead = network.forward.trace(block)
            back = network.backward.trace(block[:, ::-1])
            states = np.concatenate(
                [np.stack([s[-1] for s in ahead]), np.stack([s[-1] for s in back])[::-1]], axis=2
            )
            odds = states @ network.weights + network.offsets
            odds -= odds.max(axis=2, keepdims=True)
            chance = np.exp(odds)
            chance /= chance.sum(axis=2, keepdims=True)
            counted = LETTER[block].T.astype(np.float32)
            chance[:, np.arange(len(own)), right] -= 1
            d_odds = chance * (counted / max(1.0, counted.sum()))[:, :, None]
            d_weights = np.tensordot(states, d_odds, ((0, 1), (0, 1)))
            d_states = d_odds @ network.weights.T
            found = [
                *network.forward.gradients(block, ahead, d_states[:, :, :hidden]),
                *network.backward.gradients(
                    block[:, ::-1], back, d_states[::-1, :, hidden:]
                ),
                d_weights,
                d_odds.sum(axis=(0, 1)),
            ]
            size = sum(float((g * g).sum()) for g in found) ** 0.5
            step += 1
            for p, g, (m, v) in zip(parameters, found, moments):
                g = g / max(1.0, size)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return network


def cut(text: bytes, window: int = WINDOW) -> np.ndarray:
    """The text's windows, zeros behind its end."""
    rows = max(1, -(-len(text) // window))
    out = np.zeros(rows * window, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, window)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def pooled(network: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities of each text's letters, and the letters by label.

    The texts are cut to windows that are labelled some at a time, whatever
    text they are of; a long text is many windows.
    """
    parts = [cut(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    windows = np.concatenate(parts)
    k = len(network.labels)
    sums, counts = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
    for low in range(0, len(windows), TOGETHER):
        block, own = windows[low : low + TOGETHER], owner[low : low + TOGETHER]
        chance = network.probabilities(block)
        counted = LETTER[block].T
        chance *= counted[:, None, :]
        np.add.at(sums, own, chance.sum(axis=0, dtype=np.float64).T)
        best = chance.argmax(axis=1)
        for label in range(k):
            np.add.at(counts[:, label], own, ((best == label) & counted).sum(axis=0))
    return sums / np.maximum(1, counts.sum(axis=1))[:, None], counts


def fit(docs: DataFrame, learned: Column, sample: int = SAMPLE) -> Network | None:
    """Trains on a sample of the rows that ``learned`` selects and that have a language.

    At most about ``sample`` windows, as many of each language, one from a hashed
    place of each hashed document; None where there is nothing to learn from.
    """
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("doc_id", "text").alias("h"),
    ).where(learned & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = {lang: sample / len(counts) / n for lang, n in counts.items()}
    quota = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for text, h in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            windows = cut(text)
            kept.append(windows[(h >> 30) % len(windows)].tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(kept, pa.binary())], names=["lang", "h", "w"]
        )

    chosen = rows.where(unit < quota[F.col("lang")])
    found = chosen.mapInArrow(in_batches(take), "lang string, h long, w binary").collect()
    found.sort(key=lambda r: (r["h"], r["lang"], bytes(r["w"])))
    if not found:
        return None
    windows = np.stack([np.frombuffer(r["w"], np.uint8) for r in found])
    return train(windows, [r["lang"] for r in found])


def predict_batch(network: Network | None, texts: list[str | None]) -> list[tuple]:
    """(label, score, letters by label) of each text."""
    found: list[tuple] = [(UNKNOWN, 0.0, {})] * len(texts)
    known = [i for i, t in enumerate(texts) if network is not None and has_letter(t)]
    for low in range(0, len(known), 500):
        some = known[low : low + 500]
        means, counts = pooled(network, [texts[i].encode() for i in some])
        for i, mean, count in zip(some, means, counts):
            best = int(mean.argmax())
            by = {network.labels[j]: n for j, n in enumerate(count.tolist()) if n}
            found[i] = (network.labels[best], min(1.0, float(mean[best])), by)
    return found


FOUND = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("letters", T.MapType(T.StringType(), T.LongType())),
    ]
)


def with_language(docs: DataFrame, network: Network | None, name: str = "language") -> DataFrame:
    """All columns, and a struct (lang_pred, score, letters) in column ``name``."""

    def label(texts: list[str | None]) -> pa.Array:
        remember(None)
        rows = [
            {"lang_pred": found, "score": score, "letters": list(by.items())}
            for found, score, by in predict_batch(network, texts)
        ]
        letters = pa.map_(pa.string(), pa.int64())
        kinds = [("lang_pred", pa.string()), ("score", pa.float64()), ("letters", letters)]
        return pa.array(rows, pa.struct(kinds))

    return with_column(docs, name, FOUND, label)


def identify(docs: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> DataFrame:
    """The language of each row: doc_id, held_out, lang_pred, score, letters.

    Learns from rows with a language whose fold is not 0. ``score`` is the pooled
    probability of ``lang_pred``; ``letters`` counts the letter bytes that got each
    label. A null text, and one without a letter, is ``und`` with score 0, as is
    every text where there is nothing to learn from. Repeated rows are predicted
    each; a null id counts as '' for the fold; an empty table gives no rows; other
    columns are ignored.
    """
    network = fit(docs, fold("doc_id", folds) != 0, sample)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", folds) == 0).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return with_language(plain, network).select("doc_id", "held_out", "language.*")


def of_known_language(
    docs: DataFrame, least_score: float, folds: int = FOLDS, sample: int = SAMPLE
) -> DataFrame:
    """The rows, all columns, whose language is told with ``least_score`` or more."""
    network = fit(docs, fold("doc_id", folds) != 0, sample)
    name = free_name(docs, "language")
    found = F.col(f"`{name}`")
    sure = (found["lang_pred"] != UNKNOWN) & (found["score"] >= least_score)
    return with_language(docs, network, name).where(sure).select(*docs.columns)
