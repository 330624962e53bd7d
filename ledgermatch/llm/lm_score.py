r"""Language-model scoring with a gated recurrent network and a class-factored output softmax.

Tokens are the words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z, then one end token per document.

Counts. Every task numbers the words of the documents it holds, a block at a time. The blocks' words are
counted over all training documents by a shuffle on the word, and the counts go back to the blocks; no
task or driver ever holds the vocabulary. Words travel as 64-bit hashes.

Model. The ``SHORT_LIST`` most frequent words have outputs of their own, in classes of ``CLASS_WORDS`` by
frequency; every other word belongs to the class of its count's power of two, in which it has its share of
the count; unseen words are one outcome with a class of its own. P(word) = P(class | state) * P(word |
class, state). In training a word outside the short list counts as if its own occurrence were missing
(a word seen once is an unseen one), which gives unseen and rare words the probability they have in new
text. Output biases start at the corpus frequencies, so training starts from the unigram model.

Training. A GRU, truncated backpropagation through time in numpy: windows of ``WINDOW`` tokens, the state
carried into the next window, gradients cut there. Every training document is read once, from its first
token to its end: a hash of doc_id and codes puts it into one of ``ROUNDS`` rounds. A round's documents are
dealt over as many tasks as it has ``DEAL_TOKENS`` tokens; each task trains a copy on its documents, about
``TASK_TOKENS`` tokens at a time, and the copies are averaged.

Scoring. Every document from its first token to its end, the state carried across windows.

Defined results
- A null or blank text has one token, the end. A null doc_id is not held out.
- Without any training document all words are unseen. An empty table gives an empty result.
- Rows are scored each for itself; equal texts get equal scores up to float rounding.
- Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import crc_fold, documents, materialise

SHORT_LIST, CLASS_WORDS, HIDDEN = 2048, 64, 20
WINDOW, SIDE_BY_SIDE, TRAIN_SIDE = 24, 768, 96
TASK_TOKENS, DEAL_TOKENS, ROUNDS, RATE = 200_000, 2_000_000, 2, 0.012
BLOCK_TOKENS = 4_000_000
_POWERS = 32
_TAIL = 2 * _POWERS + 1                       # codes after the short list: power and whether exactly it; unseen last
_CLASSES = SHORT_LIST // CLASS_WORDS
_UNSEEN = SHORT_LIST + _TAIL - 1
_END = 0                                      # the end token leads the short list
LN10 = float(np.log(10))


# --- codes ----------------------------------------------------------------------------------------

def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code: as scored, and as trained on (its own occurrence left out)."""
    scored = np.arange(SHORT_LIST + _TAIL)
    trained = scored.copy()
    scored[:SHORT_LIST] //= CLASS_WORDS
    trained[:SHORT_LIST] //= CLASS_WORDS
    for power in range(_POWERS):
        for exact in (0, 1):
            code = SHORT_LIST + 2 * power + exact
            scored[code] = _CLASSES + power
            trained[code] = _CLASSES + power - exact if power or not exact else _CLASSES + _POWERS
    scored[_UNSEEN] = trained[_UNSEEN] = _CLASSES + _POWERS
    return scored, trained


SCORED_CLASS, TRAINED_CLASS = _class_tables()


def _block_rows(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: documents as word numbers of their block, and each block's words with counts."""
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                          T.StructField("ids", T.BinaryType()), T.StructField("words", T.ArrayType(T.LongType())),
                          T.StructField("counts", T.ArrayType(T.LongType()))])
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    class Numbers(dict):
        def __missing__(self, word):
            found = self[word] = len(self)
            return found

    def run(batches):
        from pyspark import TaskContext
        part, block = TaskContext.get().partitionId(), 0
        numbers, rows, learned, held = Numbers(), [], [], 0

        def close():
            nonlocal numbers, rows, learned, held, block
            seen = np.bincount(np.concatenate(learned), minlength=len(numbers)) if learned else np.zeros(len(numbers), np.int64)
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers)).view(np.int64)
            name = (part << 24) + block
            table = [(name, *r, None, None) for r in rows] + [(name, None, None, None, words, seen)]
            numbers, rows, learned, held, block = Numbers(), [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*table), kinds)], names=shape.names)

        for batch in batches:
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().lower().split() if text else []
                ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                if not held_out:
                    learned.append(ids)
                rows.append((doc_id, held_out, ids.view(np.uint8).reshape(-1, 4).T.tobytes()))  # byte planes: they compress
                held += len(ids) + 1
                if held >= BLOCK_TOKENS:
                    yield close()
        if rows:
            yield close()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, shape)


@dataclass
class Corpus:
    """What the model knows of the whole training corpus: a few thousand numbers."""
    tokens: int                # N
    distinct: int              # V
    short: np.ndarray          # counts of the short list
    mass: np.ndarray           # count by power of two of the other words
    trained_mass: np.ndarray   # tokens by class, as trained on


def _count(blocks: DataFrame) -> tuple[DataFrame, list, Corpus]:
    """(word, c) of the training words, the short list, and the corpus figures."""
    words = (blocks.where("words IS NOT NULL").select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
             .select(F.col("w.words").alias("word"), F.col("w.counts").alias("n")).where("n > 0"))
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")))
    n_docs = blocks.where("words IS NULL AND NOT held_out").count()
    short = [(r["word"], r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(SHORT_LIST - 1).collect()]
    power = (F.length(F.bin("c")) - 1).alias("power")
    tail = counts.join(_short_frame(counts.sparkSession, short), "word", "left_anti")
    tail = tail.groupBy(power, (F.col("c") == F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("c")) - 1)).alias("exact"))
    mass, trained = np.zeros(_POWERS), np.zeros(_CLASSES + _POWERS + 1)
    for r in tail.agg(F.sum("c").alias("c")).collect():
        mass[r["power"]] += r["c"]
        trained[TRAINED_CLASS[SHORT_LIST + 2 * r["power"] + r["exact"]]] += r["c"]
    numbers = np.zeros(SHORT_LIST)
    numbers[:len(short) + 1] = [n_docs, *(c for _, c in short)]
    trained[:_CLASSES] = numbers.reshape(_CLASSES, CLASS_WORDS).sum(1)
    total = counts.agg(F.sum("c"), F.count("*")).first()
    return counts, short, Corpus((total[0] or 0) + n_docs, total[1] + (n_docs > 0), numbers, mass, trained)


def _short_frame(spark: SparkSession, short: list) -> DataFrame:
    """word, place: at most SHORT_LIST rows."""
    return F.broadcast(spark.createDataFrame([(w, i + 1) for i, (w, _) in enumerate(short)], "word long, place int"))


def _coded(blocks: DataFrame, counts: DataFrame, short: list, corpus: Corpus) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, base_score, tail (log share inside the count classes), codes."""
    spark = blocks.sparkSession
    power = F.length(F.bin("c")) - 1
    exact = (F.col("c") == F.call_function("shiftleft", F.lit(1).cast("long"), power)).cast("int")
    code = (F.when(F.col("place").isNotNull(), F.col("place")).when(F.col("c").isNull(), F.lit(_UNSEEN))
            .otherwise(SHORT_LIST + 2 * power + exact)).cast("int")
    words = blocks.where("words IS NOT NULL").select("block", F.posexplode("words").alias("number", "word"))
    known = (words.join(counts, "word", "left").join(_short_frame(spark, short), "word", "left")
             .select(F.col("block").alias("of_block"), "number", F.coalesce("c", F.lit(0)).alias("c"), code.alias("code")))
    base, mass = corpus.tokens + corpus.distinct + 1, np.log(np.maximum(corpus.mass, 1))

    def run(key, docs, vocabulary):
        count, codes = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.uint16)
        count[vocabulary["number"]], codes[vocabulary["number"]] = vocabulary["c"], vocabulary["code"]
        logs = np.log10(count + 1.0)
        inside = np.where((codes >= SHORT_LIST) & (codes != _UNSEEN),
                          np.log(np.maximum(count, 1)) - mass[np.minimum((codes.astype(int) - SHORT_LIST).clip(0) // 2, _POWERS - 1)], 0.0)
        out = []
        for doc_id, held_out, planes in docs[["doc_id", "held_out", "ids"]].itertuples(index=False, name=None):
            ids = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
            n = len(ids) + 1
            out.append((None if pd.isna(doc_id) else int(doc_id), held_out, n, int((count[ids] > 0).sum()) + (corpus.short[_END] > 0),
                        float(logs[ids].sum() + np.log10(corpus.short[_END] + 1) - n * np.log10(base)), float(inside[ids].sum()),
                        np.append(codes[ids], np.uint16(_END)).tobytes()))
        frame = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail", "codes"])
        return frame.astype({"doc_id": "Int64"})

    docs = blocks.where("words IS NULL").select("block", "doc_id", "held_out", "ids")
    return docs.groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail double, codes binary")


# --- the network ----------------------------------------------------------------------------------

class Network:
    """Weights by name. Gates are tanh(x)/2 + 1/2; rows: reset, update, candidate."""

    def __init__(self, corpus: Corpus, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        codes, classes = SHORT_LIST + _TAIL, _CLASSES + _POWERS + 1
        f = lambda x: np.asarray(x, "f4")
        share = (corpus.trained_mass + 0.5) / (corpus.trained_mass + 0.5).sum()
        inside = (corpus.short + 0.1).reshape(_CLASSES, CLASS_WORDS)
        self.weights = {
            "token": f(rng.normal(0, 0.3, (3 * hidden, codes))), "state": f(rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden))),
            "class": np.zeros((classes, hidden), "f4"), "class_bias": f(np.log(share)),
            "word": np.zeros((_CLASSES, CLASS_WORDS, hidden), "f4"), "word_bias": f(np.log(inside / inside.sum(1, keepdims=True))),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = flat[at:at + w.size].reshape(w.shape).astype(w.dtype)
            at += w.size
        return self

    def step(self, token: np.ndarray, state: np.ndarray):
        h = state.shape[0]
        given = np.take(self.weights["token"], token, axis=1, mode="clip")
        held = self.weights["state"] @ state
        gates = given[:2 * h] + held[:2 * h]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        candidate = held[2 * h:] * gates[:h]
        candidate += given[2 * h:]
        np.tanh(candidate, out=candidate)
        following = state - candidate
        following *= gates[h:]
        following += candidate
        return following, gates, candidate, held[2 * h:]

    def output(self, states: np.ndarray, codes: np.ndarray, classes: np.ndarray, grads: dict | None = None, weight=None):
        """Log-probabilities of ``codes`` (n,) after ``states`` (H, n), without the share inside count classes.

        With ``grads`` adds their gradients for the loss -sum(weight * log P) and returns d loss / d states too.
        """
        w, n = self.weights, len(codes)
        logits = w["class"] @ states
        logits += w["class_bias"][:, None]
        logits -= logits.max(0)
        chosen = logits[classes, np.arange(n)]
        np.exp(logits, out=logits)
        total = logits.sum(0)
        found = chosen - np.log(total)
        if grads is not None:
            logits *= weight / total
            logits[classes, np.arange(n)] -= weight
            grads["class"] += logits @ states.T
            grads["class_bias"] += logits.sum(1)
            flow = w["class"].T @ logits
        order = np.argsort(classes, kind="stable")
        bounds = np.searchsorted(classes[order], np.arange(_CLASSES + 1))
        for k in range(_CLASSES):
            own = order[bounds[k]:bounds[k + 1]]
            if not len(own):
                continue
            inner = w["word"][k] @ states[:, own]
            inner += w["word_bias"][k][:, None]
            inner -= inner.max(0)
            place, column = codes[own] - k * CLASS_WORDS, np.arange(len(own))
            chosen = inner[place, column]
            np.exp(inner, out=inner)
            total = inner.sum(0)
            found[own] += chosen - np.log(total)
            if grads is not None:
                inner *= weight[own] / total
                inner[place, column] -= weight[own]
                grads["word"][k] += inner @ states[:, own].T
                grads["word_bias"][k] += inner.sum(1)
                flow[:, own] += w["word"][k].T @ inner
        return found if grads is None else (found, flow)

    def window_gradients(self, inputs, targets, classes, weight, state):
        """Loss, gradients and last state of one window (T, n) that begins at ``state``."""
        length, n = inputs.shape
        tape, states = [], np.empty((length, *state.shape), state.dtype)
        for t in range(length):
            following, *rest = self.step(inputs[t], state)
            tape.append((state, *rest))
            states[t] = state = following
        grads = {k: np.zeros_like(x) for k, x in self.weights.items()}
        flat = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(state.shape[0], -1)
        found, flow = self.output(flat, targets.ravel(), classes.ravel(), grads, weight.ravel())
        flow = flow.reshape(state.shape[0], length, n)
        carried, h = np.zeros_like(state), state.shape[0]
        into = np.empty((length, n, 3 * h), state.dtype)
        for t in range(length - 1, -1, -1):
            before, gates, candidate, held = tape[t]
            carried = carried + flow[:, t]
            d_candidate = carried * (1 - gates[h:]) * (1 - candidate * candidate)
            d_gates = np.concatenate([d_candidate * held, carried * (before - candidate)])
            d_gates *= 2 * gates * (1 - gates)
            d_held = np.concatenate([d_gates, d_candidate * gates[:h]])
            grads["state"] += d_held @ before.T
            into[t] = np.concatenate([d_gates, d_candidate]).T
            carried = carried * gates[h:] + self.weights["state"].T @ d_held
        order = np.argsort(inputs, axis=None, kind="stable")
        used, begin = np.unique(inputs.ravel()[order], return_index=True)
        grads["token"][:, used] += np.add.reduceat(into.reshape(-1, 3 * h)[order], begin, 0).T
        return -float((found * weight.ravel()).sum()), grads, state


def _windows(docs: list[np.ndarray], side: int, length: int):
    """(documents, begin, inputs (T, n), targets, inside) for groups of documents read side by side, longest first.

    A group's windows follow one another; the documents that have ended leave at the next window.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for at in range(0, len(order), side):
        group = order[at:at + side]
        sizes = np.array([len(docs[i]) for i in group])
        for begin in range(0, int(sizes[0]), length):
            open_ = group[:int((sizes > begin).sum())]
            width = min(length, int(sizes[0]) - begin)
            targets = np.full((len(open_), width), _END, np.int64)
            inputs = np.full((len(open_), width), _END, np.int64)
            for row, i in enumerate(open_):
                piece = docs[i][begin:begin + width]
                targets[row, :len(piece)] = piece
                before = docs[i][begin - 1:begin + width - 1] if begin else docs[i][:width - 1]
                inputs[row, (0 if begin else 1):(0 if begin else 1) + len(before)] = before
            inside = np.arange(begin, begin + width) < sizes[:len(open_), None]
            yield open_, begin, np.ascontiguousarray(inputs.T), np.ascontiguousarray(targets.T), np.ascontiguousarray(inside.T)


def score_documents(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of every document's codes, without the shares inside count classes."""
    found, state = np.zeros(len(docs)), None
    hidden = net.weights["state"].shape[1]
    for open_, begin, inputs, targets, inside in _windows(docs, SIDE_BY_SIDE, WINDOW):
        n = len(open_)
        state = np.zeros((hidden, n), "f4") if begin == 0 else np.ascontiguousarray(state[:, :n])
        states = np.empty((hidden, len(inputs), n), "f4")
        for t in range(len(inputs)):
            state = net.step(inputs[t], state)[0]
            states[:, t] = state
        codes = targets[inside]
        logs = net.output(states[:, inside], codes, SCORED_CLASS[codes])
        column = np.broadcast_to(np.arange(n), inside.shape)[inside]
        found[open_] += np.bincount(column, logs, minlength=n)
    return found


def train_documents(net: Network, docs: list[np.ndarray], rate: float = RATE) -> Network:
    """One pass of Adam over the documents."""
    first = {k: np.zeros_like(w) for k, w in net.weights.items()}
    second = {k: np.zeros_like(w) for k, w in net.weights.items()}
    state, step = None, 0
    hidden = net.weights["state"].shape[1]
    for open_, begin, inputs, targets, inside in _windows(docs, TRAIN_SIDE, WINDOW):
        n = len(open_)
        state = np.zeros((hidden, n), "f4") if begin == 0 else np.ascontiguousarray(state[:, :n])
        weight = inside.astype("f4") / max(1, inside.sum())
        _, grads, state = net.window_gradients(inputs, targets, TRAINED_CLASS[targets], weight, state)
        step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        pace = rate * min(1.0, step / 10) * min(1.0, 1.0 / (norm + 1e-12))
        for k, w in net.weights.items():
            first[k] += 0.1 * (grads[k] - first[k])
            second[k] += 0.01 * (grads[k] * grads[k] - second[k])
            w -= pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)
    return net


# --- Spark ----------------------------------------------------------------------------------------

def training_documents(coded: DataFrame, turn: int) -> DataFrame:
    """The rows of ``coded`` that round ``turn`` trains on; every training document is in one round."""
    return coded.where("NOT held_out").where(F.pmod(F.xxhash64("doc_id", "codes"), F.lit(ROUNDS)) == turn)


def _train(coded: DataFrame, corpus: Corpus) -> np.ndarray:
    """Rounds of local training and averaging; returns the flat weights (a few hundred thousand floats)."""
    spark = coded.sparkSession
    flat, tasks = Network(corpus).flat(), -(-corpus.tokens // (ROUNDS * DEAL_TOKENS)) or 1
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(flat)

        def run(batches, sent=sent):
            held = sorted((xxhash.xxh3_64_intdigest(codes), codes) for batch in batches for codes in batch.column(0).to_pylist())
            net, piece, size = Network(corpus).load(sent.value), [], 0
            for at, (_, codes) in enumerate(held):
                piece.append(np.frombuffer(codes, np.uint16))
                size += len(piece[-1])
                if size >= TASK_TOKENS or at + 1 == len(held):
                    net, piece, size = train_documents(net, piece), [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([1.0]), pa.array([net.flat()], pa.list_(pa.float32()))], names=["n", "flat"])

        def add(batches):
            n, total = 0.0, None
            for batch in batches:
                for count, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                    values = np.asarray(values.values).astype("f8")
                    n, total = n + count, values.copy() if total is None else total + values
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64()))], names=["n", "flat"])

        # Summed up in streams, so no task or driver holds more than a few copies of the weights.
        # Dealt in turn, not by a key: no document's copies make a task larger than the others.
        dealt = training_documents(coded, turn).select("codes").repartition(tasks)
        copies = dealt.mapInArrow(run, "n double, flat array<float>")
        sums = copies.repartition(8).mapInArrow(add, "n double, flat array<double>").collect()
        if sums:
            flat = (sum(np.array(r["flat"]) for r in sums) / sum(r["n"] for r in sums)).astype("f4")
    return flat


def score_corpus(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    blocks = materialise(_block_rows(docs.withColumn("held_out", held_out)))
    counts, short, corpus = _count(blocks)
    coded = materialise(_coded(blocks, counts, short, corpus))
    sent = spark.sparkContext.broadcast(_train(coded, corpus))
    shape = coded.drop("codes", "tail").schema.add("score", T.DoubleType())

    def run(batches):
        net = Network(corpus).load(sent.value)
        for batch in batches:
            docs = [np.frombuffer(c, np.uint16) for c in batch.column("codes").to_pylist()]
            logs = score_documents(net, docs) + np.array(batch.column("tail").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in shape.names[:-1]), pa.array(logs / LN10)], names=shape.names)

    return coded.mapInArrow(run, shape).withColumn("train_tokens", F.lit(corpus.tokens).cast("long"))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(crc_fold(7) == 2, F.lit(False))
    return score_corpus(documents(spark, folder), held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_lm_score": op3_lm_score}
SQL: dict[str, str] = {}
