"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

Labels are given for whole texts, insults are words. A text is a bag of words (multiple-instance
learning): it is as toxic as its worst word. Words are compared by the subsequence kernel of
order three, in which each matching triple of characters counts less the longer its span is, so
``i-d-i-o-t``, ``idiiot`` and ``idxiot`` stay near ``idiot``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import arrow_rows, by_bytes
from redpencil.llm.features import labelled_sample

PER_LABEL = 2500     # texts of each label that the machine is trained on
LANDMARKS = 256
SPAN = 6             # characters that a matching triple may stretch over
DECAY = 0.7          # weight of each character of that stretch
LONGEST = 24         # longer words are compared by overlapping windows
ALPHABET = 64        # 0 pads, 1 starts and 2 ends a word, then digits and letters; others share the rest
DECIDED = 4_000      # words whose matrices are in memory at a time
COMMON = 0.25        # words this often in toxic texts, against the text's most shared one, are examples too
NO_WORDS = -3.0      # decision value of a text without words
_OFFSETS = list(combinations(range(1, SPAN), 2))
_LETTER_BY_LETTER = re.compile(r"(?:^|\s)\w[^\w\s]*(?:\s+\w[^\w\s]*){2,}(?=\s|$)")
_MARKS = re.compile(r"[\W_]+")


def _classes() -> np.ndarray:
    table = 39 + np.arange(1 << 16) % (ALPHABET - 39)
    table[0], table[1], table[2] = 0, 1, 2
    table[ord("0"):ord("9") + 1] = np.arange(3, 13)
    table[ord("a"):ord("z") + 1] = np.arange(13, 39)
    return table.astype(np.int32)


_CLASS = _classes()


def chunks(text: str) -> set[str]:
    """The distinct words of a text in lower case, and the words that letter-by-letter runs spell."""
    low = text.lower()
    found = set(low.split())
    for run in _LETTER_BY_LETTER.finditer(low):
        found.add("".join(run[0].split()))
    return found


def units(chunk: str) -> list[str]:
    """What is compared: the letters and digits of a word, in windows where it is long."""
    word = _MARKS.sub("", chunk)
    if len(word) <= LONGEST:
        return [word] if word else []
    return [word[k:k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _matrix(words: list[str]) -> np.ndarray:
    """Character classes of words, a mark before and one after each, and padding behind."""
    wide = max(map(len, words)) + 2
    flat = "".join(["\x01" + (w + "\x02").ljust(wide - 1 + SPAN, "\0") for w in words])
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS[points & 0xFFFF].reshape(len(words), wide + SPAN)


def triples(words: list[str]) -> Iterator[tuple[np.ndarray, float]]:
    """For each form of a triple, its code at each place of each word (0 where padded) and its weight."""
    m = _matrix(words)
    n = m.shape[1] - SPAN
    for i, j in _OFFSETS:
        last = m[:, j:j + n]
        code = (m[:, :n] * ALPHABET + m[:, i:i + n]) * ALPHABET + last
        yield np.where(last > 0, code, 0), DECAY ** (j + 1)


def norms(words: list[str]) -> np.ndarray:
    """Length of each word's feature vector: the weights of a triple's occurrences add up before they are squared."""
    forms = list(triples(words))
    code = np.concatenate([c * 16 + k for k, (c, _) in enumerate(forms)], axis=1)
    code.sort(axis=1)
    weight = np.array([w for _, w in forms])[code & 15]
    triple = code >> 4
    weight[triple == 0] = 0
    last = np.ones(triple.shape, bool)
    last[:, :-1] = triple[:, 1:] != triple[:, :-1]
    flat = last.ravel()
    upto = np.cumsum(weight.ravel())[flat]
    part = np.diff(upto, prepend=0.0)
    total = np.add.reduceat(part * part, np.r_[0, np.cumsum(last.sum(1))[:-1]])
    return np.sqrt(np.maximum(total, DECAY ** 6))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of each word with each landmark."""
    table = np.zeros((ALPHABET ** 3, len(landmarks)), np.float32)
    column = np.arange(len(landmarks))[:, None]
    for code, weight in triples(landmarks):
        np.add.at(table, (code, np.broadcast_to(column, code.shape)), weight)
    table[0] = 0
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 2000):
        some = words[at:at + 2000]
        for code, weight in triples(some):
            for k in range(code.shape[1]):
                out[at:at + 2000] += weight * table[code[:, k]]
    return out / norms(words)[:, None] / norms(landmarks)[None, :]


def whiten(k: np.ndarray) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix."""
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 3000.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the points inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    inside = np.ones(len(x), bool)
    for _ in range(rounds):
        a, b = x[inside], weight[inside] * cost
        w = np.linalg.solve(ridge + (a * b[:, None]).T @ a, a.T @ (b * y[inside]))
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def fold_in(landmarks: list[str], mix: np.ndarray) -> np.ndarray:
    """The machine as one weight for each triple of characters: landmarks and mixing weights multiplied out."""
    table = np.zeros(ALPHABET ** 3)
    scale = mix / norms(landmarks)
    for code, weight in triples(landmarks):
        np.add.at(table, code, (weight * scale)[:, None])
    table[0] = 0
    return table.astype(np.float32)


def decide(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each word."""
    out = np.zeros(len(words))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))  # words of like length share a matrix
    for at in range(0, len(order), DECIDED):
        some = order[at:at + DECIDED]
        part = [words[k] for k in some]
        total = np.zeros(len(part))
        for code, weight in triples(part):
            total += weight * table[code].sum(1)
        out[some] = total / norms(part) + bias
    return out


def fit(bags: list[set[str]], labels: list[int], rounds: int = 4) -> dict:
    """Train on bags of words: three quarters for the machine, the rest for the probabilities."""
    seen: dict[tuple, int] = {}
    for k, bag in enumerate(bags):  # copies teach nothing new
        seen.setdefault((labels[k], *sorted(bag)), k)
    bags, labels = [bags[k] for k in seen.values()], [labels[k] for k in seen.values()]
    own = [k for k in range(len(bags)) if k % 4 != 3] if len(bags) >= 40 else list(range(len(bags)))
    back = [k for k in range(len(bags)) if k % 4 == 3] if len(bags) >= 40 else own
    bad = [sorted(bags[k]) for k in own if labels[k] == 1]
    clean = Counter(w for k in own if labels[k] != 1 for w in bags[k])
    # how many unlike toxic texts share a word that no clean text has: near copies, which share
    # such words by the dozen, count once
    kin = [min((zlib.crc32(w.encode()) for w in words if w not in clean), default=0) for words in bad]
    shared: dict[str, set[int]] = {}
    for words, group in zip(bad, kin, strict=True):
        for w in words:
            if w not in clean:
                shared.setdefault(w, set()).add(group)
    novel = {w: len(groups) for w, groups in shared.items()}
    # first guess: of each text the words that most others share
    least = min(3, max(novel.values(), default=0))
    positive: Counter = Counter()
    for words in bad:
        mine = [w for w in words if w in novel]
        top = max(map(novel.__getitem__, mine), default=0)
        positive.update(w for w in mine if novel[w] >= max(COMMON * top, least))
    guess = set(positive)
    usual = [w for w, _ in sorted(clean.items(), key=lambda e: (-e[1], e[0]))]
    if not positive or not usual:
        return {"table": np.zeros(ALPHABET ** 3, np.float32), "bias": NO_WORDS, "slope": 1.0, "shift": 0.0}
    ranked = [w for w, _ in sorted(positive.items(), key=lambda e: (-e[1], e[0]))]
    rng = np.random.default_rng(11)
    rare = [usual[k] for k in sorted(rng.choice(len(usual), min(len(usual), 6000), replace=False))]
    landmarks = sorted({*ranked[:LANDMARKS // 2], *usual[:LANDMARKS // 4], *rare[:LANDMARKS // 4]})
    negative = sorted({*usual[:3000], *rare})
    table, bias = None, 0.0
    for _ in range(rounds):
        pos = sorted(positive)
        words = pos + [w for w in negative if w not in positive]
        y = np.r_[np.ones(len(pos)), -np.ones(len(words) - len(pos))]
        # a word counts by the texts it would decide, with falling weight
        share = np.r_[np.sqrt([positive[w] for w in pos]), [1 + math.log(clean[w]) for w in words[len(pos):]]].astype(float)
        share[:len(pos)] /= share[:len(pos)].sum()
        share[len(pos):] /= share[len(pos):].sum()
        mix = whiten(kernel(landmarks, landmarks))
        w, bias = hinge(kernel(words, landmarks) @ mix, y, share)
        table = fold_in(landmarks, mix @ w)
        # the worst words of clean texts become examples; of each toxic text the worst word counts
        # unless it looks clean, and any other beyond the margin
        value = decide(usual, table, bias)
        worst = np.argsort(-value, kind="stable")[:1500]
        negative = sorted({*negative, *(usual[k] for k in worst if value[k] > -1)})
        landmarks = sorted({*landmarks, *(usual[k] for k in worst[:LANDMARKS // 8])})
        fresh = sorted(novel)
        score = dict(zip(fresh, decide(fresh, table, bias), strict=True))
        positive = Counter({w: 1 for w in fresh if score[w] > 1 or w in guess})
        tops = [max(mine, key=score.__getitem__) for words in bad if (mine := [w for w in words if w in score])]
        positive.update(w for w in tops if score[w] > -0.5)
    top = np.array([_worst(bags[k], table, bias) for k in back])
    truth = np.array([labels[k] == 1 for k in back])
    return {"table": table, "bias": bias, **_platt(top, truth)}


def _worst(words: set[str], table: np.ndarray, bias: float) -> float:
    return float(decide(sorted(words), table, bias).max()) if words else NO_WORDS


def _platt(value: np.ndarray, truth: np.ndarray, steps: int = 200) -> dict:
    """Probability of the label from the decision value; both labels weigh the same."""
    if truth.all() or not truth.any():
        return {"slope": 4.0, "shift": 0.0}
    target = np.where(truth, 1 - 1 / (truth.sum() + 2), 1 / ((~truth).sum() + 2))
    weight = np.where(truth, 0.5 / truth.sum(), 0.5 / (~truth).sum())
    x, w = np.c_[value, np.ones(len(value))], np.array([4.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-4 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), grad)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return {"slope": float(max(w[0], 0.1)), "shift": float(w[1])}


def train(docs: DataFrame, labels: DataFrame | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          per_label: int = PER_LABEL) -> dict | None:
    """Fit on a bounded sample of the documents with a 0/1 label, whole texts; None if there is none.

    ``labels`` has id and label; without it the documents carry the label themselves.
    """
    bag = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    made = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType()))]
                        + [T.StructField(k, T.DoubleType()) for k in ("bias", "slope", "shift")])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_rows(([{"label": y, "words": sorted({u for c in chunks(t) for u in units(c)})}
                            for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)] for batch in by_bytes(batches)), bag)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, words = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            words += [set(w) for w in batch.column(1).to_pylist()]
        if labels:
            model = fit(words, labels)
            at = np.flatnonzero(model["table"])
            yield from arrow_rows([[{"codes": at.tolist(), "weights": model["table"][at].tolist(),
                                     **{k: model[k] for k in ("bias", "slope", "shift")}}]], made)

    rows = labelled_sample(docs, docs if labels is None else labels, label_col, "int", id_col, text_col, per_label)
    sample = rows.mapInArrow(bags, bag)
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("words"), "label")  # a fixed order
    found = one.mapInArrow(learn, made).collect()
    if not found:
        return None
    table = np.zeros(ALPHABET ** 3, np.float32)
    table[found[0]["codes"]] = found[0]["weights"]
    return {"table": table, **{k: found[0][k] for k in ("bias", "slope", "shift")}}


def probabilities(texts: list[str], model: dict | None) -> np.ndarray:
    """Probability of the label for each text."""
    if model is None:
        return np.zeros(len(texts))
    bags = [chunks(t) for t in texts]
    parts = {c: units(c) for c in set().union(*bags)} if bags else {}
    words = sorted({u for us in parts.values() for u in us})
    value = dict(zip(words, decide(words, model["table"], model["bias"]).tolist(), strict=True)) if words else {}
    of = {c: max((value[u] for u in us), default=NO_WORDS) for c, us in parts.items()}
    top = np.array([max(map(of.__getitem__, b), default=NO_WORDS) for b in bags])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * top + model["shift"], -30, 30)))


def score(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", name: str = "score",
          bytes_at_once: int = 4 << 20, **more: Column) -> DataFrame:
    """id, the columns in ``more`` and the probability for each row's whole text.

    The model is one table of fixed size and is broadcast. Defined cases: null and empty texts and
    texts without letters or digits have no word and get the lowest score; without a model all
    scores are 0; repeated rows each get their row; other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias(id_col), *[c.alias(k) for k, c in more.items()],
                     F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_bytes(batches, bytes_at_once):
            p = probabilities(some.column(some.num_columns - 1).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(p)], names=schema.names)

    return rows.mapInArrow(run, schema)


def drop_toxic(df: DataFrame, model: dict | None, threshold: float = 0.7, text_col: str = "text",
               bytes_at_once: int = 4 << 20) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns: one pass, no shuffle."""
    held, schema, at_text = df.sparkSession.sparkContext.broadcast(model), df.schema, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_bytes(batches, bytes_at_once):
            p = probabilities([t or "" for t in some.column(at_text).to_pylist()], held.value)
            yield some.filter(pa.array(p < threshold))

    return df.mapInArrow(run, schema)
