"""Language identification by a bidirectional gated recurrent network over bytes.

A small GRU reads the UTF-8 bytes of a text from the left, another from the right; both states at a
byte give that byte's language probabilities, and a document's probabilities are the mean over its
bytes. The network is trained in numpy by backpropagation through time, every position being labelled
with its document's language.

Long texts are read in windows, each with ``MARGIN`` bytes of context on either side that warm the states
up and are labelled by the neighbouring window; so every byte is labelled once, windows of all texts are
computed side by side, and memory is bounded whatever the text's length.

Training reads a bounded sample (``rows_per_language``, chosen by hash of the id) of the labelled rows
that the caller hands in; everything else covers all rows and whole texts.

Defined results
- ``und`` with score 0 for a null text or one without a letter.
- Rows without a label are never learned from. Without any labelled row every text is ``und``.
- Texts are all that a prediction depends on: equal texts get equal results, a null or repeated doc_id
  does not matter. Input columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import crc_fold, documents

UNDETERMINED = "und"
WINDOW, MARGIN = 768, 24      # bytes labelled per window, bytes of context on either side
SIDE_BY_SIDE = 2048           # windows computed together
TASK_BYTES = 4 << 20          # text bytes gathered before the windows are computed
_LETTER = regex.compile(r"\p{L}")  # as has_letter
_SMALL = 1e-12


# --- the network ----------------------------------------------------------------------------------

@dataclass
class Direction:
    """One GRU. Rows of the matrices: reset gate, update gate, candidate; gates are tanh(x)/2 + 1/2."""
    by_byte: np.ndarray   # (3H, 256)
    by_state: np.ndarray  # (3H, H)
    out: np.ndarray       # (L, H)


@dataclass
class Network:
    languages: list[str]
    left: Direction
    right: Direction
    bias: np.ndarray      # (L,)


def _fresh(languages: list[str], hidden: int, rng) -> Network:
    def direction():
        return Direction(rng.normal(0, 0.3, (3 * hidden, 256)).astype("f4"),
                         rng.normal(0, 0.7 / np.sqrt(hidden), (3 * hidden, hidden)).astype("f4"),
                         rng.normal(0, 0.3, (len(languages), hidden)).astype("f4"))
    return Network(languages, direction(), direction(), np.zeros(len(languages), "f4"))


def _step(d: Direction, byte: np.ndarray, state: np.ndarray):
    """The next state (H, n), and what the backward pass needs."""
    hidden = state.shape[0]
    given = np.take(d.by_byte, byte, axis=1, mode="clip")
    held = d.by_state @ state
    gates = given[:2 * hidden] + held[:2 * hidden]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    candidate = held[2 * hidden:] * gates[:hidden]
    candidate += given[2 * hidden:]
    np.tanh(candidate, out=candidate)
    following = state - candidate
    following *= gates[hidden:]
    following += candidate
    return following, gates, candidate, held[2 * hidden:]


def _back_step(d: Direction, grad: Direction, byte, state, gates, candidate, held, flow):
    """Adds one position's gradients to ``grad``; returns the gradient of the state before it."""
    hidden = state.shape[0]
    reset, update = gates[:hidden], gates[hidden:]
    d_candidate = flow * (1 - update) * (1 - candidate * candidate)
    d_gates = np.concatenate([d_candidate * held, flow * (state - candidate)])
    d_gates *= 2 * gates * (1 - gates)
    d_held = np.concatenate([d_gates, d_candidate * reset])
    grad.by_state += d_held @ state.T
    np.add.at(grad.by_byte.T, byte, np.concatenate([d_gates, d_candidate]).T)
    return flow * update + d.by_state.T @ d_held


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    logits = logits - logits.max(0, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(0, keepdims=True)
    return logits


def loss_and_gradients(net: Network, bytes_: np.ndarray, labels: np.ndarray):
    """Mean cross-entropy over all positions of equally long sequences (T, n), and its gradients."""
    length, n = bytes_.shape
    hidden = net.left.by_state.shape[1]
    tapes = {}
    for name, order in (("left", range(length)), ("right", range(length - 1, -1, -1))):
        d, state, tape = getattr(net, name), np.zeros((hidden, n), net.bias.dtype), [None] * length
        for t in order:
            following, gates, candidate, held = _step(d, bytes_[t], state)
            tape[t] = (state, gates, candidate, held, following)
            state = following
        tapes[name] = tape
    after = {k: np.stack([x[4] for x in tape], 1) for k, tape in tapes.items()}  # (H, T, n)
    logits = net.bias[:, None, None] + sum(np.tensordot(getattr(net, k).out, h, 1) for k, h in after.items())
    probability = _softmax(logits)
    picked = np.take_along_axis(probability, labels[None, None, :].repeat(length, 1), 0)
    loss = -np.log(picked + _SMALL).mean()
    flow = probability
    np.put_along_axis(flow, labels[None, None, :].repeat(length, 1), picked - 1, 0)
    flow /= length * n
    grads = Network(net.languages, *(Direction(*(np.zeros_like(x) for x in (d.by_byte, d.by_state, d.out)))
                                     for d in (net.left, net.right)), flow.sum((1, 2)))
    for name, order in (("left", range(length - 1, -1, -1)), ("right", range(length))):
        d, g = getattr(net, name), getattr(grads, name)
        g.out += np.tensordot(flow, after[name], ([1, 2], [1, 2]))
        into = np.tensordot(d.out.T, flow, 1)
        carried = np.zeros((hidden, n), net.bias.dtype)
        for t in order:
            state, gates, candidate, held, _ = tapes[name][t]
            carried = _back_step(d, g, bytes_[t], state, gates, candidate, held, carried + into[:, t])
    return loss, grads


def _weights(net: Network) -> list[np.ndarray]:
    return [net.left.by_byte, net.left.by_state, net.left.out, net.right.by_byte, net.right.by_state, net.right.out, net.bias]


def train(texts: list[bytes], labels: list[str], hidden: int = 8, length: int = 64, batch: int = 128,
          steps: int = 220, rate: float = 0.02, seed: int = 0) -> Network | None:
    """Adam on windows drawn at random places of the texts, each language as often as the others."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net = _fresh(languages, hidden, rng)
    members = [[i for i, x in enumerate(labels) if x == language] for language in languages]
    lengths = [np.array([len(texts[i]) + 1.0 for i in m]) for m in members]
    first = [np.zeros_like(w) for w in _weights(net)]
    second = [np.zeros_like(w) for w in _weights(net)]
    for step in range(1, steps + 1):
        wanted = rng.integers(len(languages), size=batch)
        block = np.full((length, batch), 32, "u1")
        for column, language in enumerate(wanted):
            text = texts[members[language][rng.choice(len(members[language]), p=lengths[language] / lengths[language].sum())]]
            begin = rng.integers(max(1, len(text) - length + 1))
            piece = np.frombuffer(text[begin:begin + length], "u1")
            block[:len(piece), column] = piece
        _, grads = loss_and_gradients(net, block, wanted)
        norm = np.sqrt(sum(float((g * g).sum()) for g in _weights(grads)))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1.0 / (norm + _SMALL))
        for w, g, m, v in zip(_weights(net), _weights(grads), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def label_positions(net: Network, windows: list[np.ndarray]) -> list[np.ndarray]:
    """Language probabilities (L, length) of every byte of each window."""
    order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
    found: list = [None] * len(windows)
    for at in range(0, len(order), SIDE_BY_SIDE):
        group = order[at:at + SIDE_BY_SIDE]
        lengths = np.array([len(windows[i]) for i in group])
        longest, n = int(lengths[0]), len(group)
        block = np.zeros((n, longest), "u1")
        for row, i in enumerate(group):
            block[row, :lengths[row]] = windows[i]
        block = np.ascontiguousarray(block.T)
        open_ = np.searchsorted(-lengths, -np.arange(longest), side="left")  # windows longer than t
        logits = np.zeros((longest, len(net.languages), n), "f4")
        hidden = net.left.by_state.shape[1]
        state = np.zeros((hidden, n), "f4")
        for t in range(longest):
            k = int(open_[t])
            state = _step(net.left, block[t, :k], np.ascontiguousarray(state[:, :k]))[0]
            np.matmul(net.left.out, state, out=logits[t, :, :k])
        state = np.zeros((hidden, 0), "f4")
        for t in range(longest - 1, -1, -1):
            k = int(open_[t])
            if k > state.shape[1]:  # windows that end here begin with an empty state
                state = np.concatenate([state, np.zeros((hidden, k - state.shape[1]), "f4")], 1)
            state = _step(net.right, block[t, :k], state)[0]
            logits[t, :, :k] += net.right.out @ state
        logits += net.bias[:, None]
        probability = _softmax(logits.transpose(1, 0, 2))
        for row, i in enumerate(group):
            found[i] = probability[:, :lengths[row], row]
    return found


def classify(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (documents, L)."""
    windows, owner, trim = [], [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text, "u1")
        for begin in range(0, len(data), WINDOW):
            left, end = max(0, begin - MARGIN), min(len(data), begin + WINDOW)
            windows.append(data[left:min(len(data), end + MARGIN)])
            owner.append(i)
            trim.append((begin - left, end - left))
    pooled = np.zeros((len(texts), len(net.languages)))
    for i, (a, b), probability in zip(owner, trim, label_positions(net, windows)):
        pooled[i] += probability[:, a:b].sum(1, dtype="f8")
    return pooled / np.maximum(1, [len(t) for t in texts])[:, None]


# --- Spark ----------------------------------------------------------------------------------------

def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def fit(labelled: DataFrame, rows_per_language: int = 300, **options) -> Network | None:
    """Train on ``text`` and ``lang``: about ``rows_per_language`` rows of each language, the rest unread.

    The sample is a threshold on the id's hash, derived from the exact number of rows per language, so it
    needs no sort and no join; the driver gets one count per language and the sample.
    """
    rows = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    per_language = F.create_map(*(F.lit(x) for item in counts.items() for x in item))
    sample = rows.where(place * per_language[F.col("lang")] <= 1_000_003 * rows_per_language).collect()
    sample.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return train([r["text"].encode() for r in sample], [r["lang"] for r in sample], **options)


def predict(docs: DataFrame, net: Network | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its probability in the columns ``into``, from the whole text alone."""
    at = docs.columns.index(text)
    kept = [i for i, name in enumerate(docs.columns) if name not in into]
    shape = T.StructType([*(docs.schema.fields[i] for i in kept),
                          T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            todo = [i for i, x in enumerate(texts) if net is not None and x is not None and _LETTER.search(x)]
            while todo:
                part, size = [], 0
                while todo and (not part or size < TASK_BYTES):
                    part.append(todo.pop())
                    size += len(texts[part[-1]])
                pooled = classify(net, [texts[i].encode() for i in part])
                for i, p in zip(part, pooled):
                    pred[i], score[i] = net.languages[int(p.argmax())], float(min(1.0, p.max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[f.name for f in shape.fields])

    return docs.mapInArrow(run, shape)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from the documents that are not held out."""
    docs = documents(spark, folder).withColumn("held_out", F.coalesce(crc_fold(4) == 2, F.lit(False)))
    net = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), net).drop("text")


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
