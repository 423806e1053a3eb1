"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams (hashed into buckets), a passage the
average of its words (one or three), and a linear softmax gives the passage's class; embeddings and softmax are
trained together in numpy, from a start that says which n-grams toxic documents hold more often. Labels are known for documents only, and a toxic document is mostly plain
text, so training picks each toxic document's most toxic passages and each clean document's hardest
ones, and a document scores as its worst passage, calibrated on whole documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.shared import WordCache, claim_cache, text_groups

_MARKS = re.compile(r"[\W_]+")
#: documents of each class that training takes, and the longest that it takes
TRAIN_ROWS = 1500
TRAIN_CHARS = 65_536
THRESHOLD = 0.7
#: words of a passage: training takes the length that judges unseen documents best
PASSAGES = (1, 3)
#: words of a text that are scored together
PIECE_WORDS = 20_000


def _weight(values: list[float]) -> int:
    return 24 * len(values)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class SubwordSoftmax:
    def __init__(self, buckets: int = 1 << 17, dim: int = 8, shortest: int = 3, longest: int = 6, window: int = 0, seed: int = 7):
        self.buckets, self.dim, self.shortest, self.longest = buckets, dim, shortest, longest
        self.lengths = (window,) if window else PASSAGES
        self.window = self.lengths[-1]
        self.seed, self.rounds = seed, 0
        self.margin = np.zeros(buckets, np.float32)
        self.bias, self.scale, self.shift = 0.0, 1.0, -30.0  # untrained: nothing is toxic
        self._known = WordCache(weigh=_weight)

    # -- features
    def bags(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket ids of all n-grams of each word (marks removed, ends marked), and their number by word."""
        plain = [f"<{_MARKS.sub('', w)}>" for w in words]
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        owner = np.repeat(np.arange(len(plain)), size)
        ids, own, rolled = [], [], np.zeros(len(code), np.uint32)
        for n in range(1, self.longest + 1):
            rolled = rolled[: len(code) - n + 1] * np.uint32(16777619) + code[n - 1 :]
            if n >= self.shortest and len(rolled):
                inside = owner[: len(rolled)] == owner[n - 1 :]
                mixed = rolled[inside] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0x85EBCA6B)
                ids.append(((mixed ^ (mixed >> np.uint32(13))) % np.uint32(self.buckets)).astype(np.int32))
                own.append(owner[: len(rolled)][inside])
        if not ids:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        owner, flat = np.concatenate(own), np.concatenate(ids)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))

    def _margins(self, words: list[str], group: int = 20_000) -> np.ndarray:
        """Margin of each word, in groups that bound memory."""
        out = [np.empty(0)]
        for at in range(0, len(words), group):
            ids, count = self.bags(words[at : at + group])
            out.append(self._mean_by(self.margin[ids], count))
        return np.concatenate(out)

    @staticmethod
    def _mean_by(values: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
        end = np.cumsum(count)
        return (total[end] - total[end - count]) / np.maximum(count, 1)

    # -- training
    def fit(self, texts: list[str], toxic: np.ndarray, rounds: int = 4, steps: int = 15, folds: int = 2) -> SubwordSoftmax:
        """Train on documents and their labels; without both classes nothing is learnt and scores are near 0.

        Models of the other folds judge each document, for a model is too sure of those that it has seen: the
        passage length and number of rounds, from 1 to ``rounds``, with the least loss on them are taken, and
        their margins calibrate. Only ``rounds=0`` leaves the start as it is.
        """
        toxic = np.asarray(toxic, int)
        if not (0 < toxic.sum() < len(toxic)):
            return self
        fold = np.arange(len(texts)) % folds
        if folds > 1 and all(0 < toxic[fold != k].sum() < (fold != k).sum() for k in range(folds)):
            tried = []
            for self.window in self.lengths:
                worst = np.empty((rounds + 1, len(texts)))
                for k in range(folds):
                    held = [t for t, f in zip(texts, fold, strict=True) if f == k]
                    for turn, margins in enumerate(self._rounds([t for t, f in zip(texts, fold, strict=True) if f != k], toxic[fold != k], rounds, steps)):
                        worst[turn, fold == k] = self._judging(*margins, held)
                tried += [(self._calibrate(w, toxic), self.window, turn, w) for turn, w in enumerate(worst) if turn or not rounds]
            _, self.window, rounds, worst = min(tried, key=lambda t: t[0])
            for self.margin, self.bias in self._rounds(texts, toxic, rounds, steps):
                pass
        else:
            for self.margin, self.bias in self._rounds(texts, toxic, rounds, steps):
                pass
            worst = self._judging(self.margin, self.bias, texts)
        self.rounds = rounds
        self._calibrate(worst, toxic)
        return self

    def _judging(self, margin: np.ndarray, bias: float, texts: list[str]) -> np.ndarray:
        """Margins of the worst passages of texts under a model of such margins."""
        judge = SubwordSoftmax(self.buckets, self.dim, self.shortest, self.longest, self.window)
        judge.margin, judge.bias = margin, bias
        return np.array([judge.worst(t) for t in texts])

    def _rounds(self, texts: list[str], toxic: np.ndarray, rounds: int, steps: int) -> Iterator[tuple[np.ndarray, float]]:
        """Margins of the n-grams and the bias after the start and after each round of descent."""
        rng = np.random.default_rng(self.seed)
        known: dict[str, int] = {}
        docs = []
        for text in texts:
            words = words_of(text)
            docs.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        vocabulary = list(known) or [""]
        del known
        # start: the share of toxic against clean documents that hold an n-gram, less where few do
        held = np.zeros((2, self.buckets))
        for words, y in zip(docs, toxic, strict=True):
            if len(words):
                held[y, np.unique(self.bags([vocabulary[k] for k in np.unique(words)])[0])] += 1
        n = np.bincount(toxic, minlength=2)
        start = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
        start *= held.sum(0) / (held.sum(0) + 10)
        table = rng.normal(0, 0.02, (self.buckets, self.dim))
        table[:, 0] = start
        head = np.zeros((self.dim, 2))
        head[0] = (-0.5, 0.5)
        bias = np.zeros(2)
        mine = SubwordSoftmax(self.buckets, self.dim, self.shortest, self.longest, self.window)
        for turn in range(rounds + 1):
            mine.margin, mine.bias = (table @ (head[:, 1] - head[:, 0])).astype(np.float32), float(bias[1] - bias[0])
            yield mine.margin, mine.bias
            if turn == rounds:
                return
            word = mine._margins(vocabulary)
            places, label = [], []
            for words, y in zip(docs, toxic, strict=True):
                score = self._windows(word[words])
                if not len(score):
                    continue
                top = np.argsort(-score, kind="stable")[:4]
                picked = [int(top[0]), *(int(k) for k in top[1:] if turn and score[k] + mine.bias > 0)] if y else [*map(int, top), *rng.integers(0, len(score), 2).tolist()]
                places += [[vocabulary[w] for w in words[k : k + self.window]] for k in picked]
                label += [y] * len(picked)
            if not 0 < sum(label) < len(label):
                continue
            table, head, bias = self._descend(table, head, bias, places, np.array(label), steps)

    def _descend(self, table, head, bias, places, label, steps):
        """Adam steps over all passages for the embeddings and the softmax at once."""
        flat, count = self.bags([w for p in places for w in p])
        size = np.array([len(p) for p in places])
        weight = np.repeat(1 / (np.repeat(size, size) * np.maximum(count, 1)), count)
        n = np.add.reduceat(count, np.cumsum(size) - size)
        owner = np.repeat(np.arange(len(places)), n)
        used, flat = np.unique(flat, return_inverse=True)
        part, target = table[used], np.eye(2)[label]
        share = np.bincount(label, minlength=2)
        cost = (len(label) / (2 * np.maximum(share, 1)))[label][:, None] / len(label)
        values = [part, head, bias]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step in range(1, steps + 1):
            bag = np.stack([np.bincount(owner, part[flat, d] * weight, len(places)) for d in range(self.dim)], 1)
            logit = bag @ head + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            error = (p - target) * cost
            back = error @ head.T
            slope = [
                np.stack([np.bincount(flat, back[owner, d] * weight, len(used)) for d in range(self.dim)], 1) + 1e-6 * part,
                bag.T @ error + 1e-5 * head,
                error.sum(0),
            ]
            for k, (v, g) in enumerate(zip(values, slope, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                v -= 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        table = table.copy()
        table[used] = part
        return table, head, bias

    def _calibrate(self, worst: np.ndarray, toxic: np.ndarray) -> float:
        """Logistic fit of the label on the worst passage's margin (Newton steps, classes weighted alike, ridge); its mean loss."""
        x = np.stack([worst, np.ones_like(worst)], 1)
        n = np.bincount(toxic, minlength=2)
        weight, beta = (len(toxic) / (2 * n))[toxic], np.array([0.5, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (weight * (p - toxic)) + 0.05 * beta
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
            beta = beta - np.linalg.solve(curve, slope)
        self.scale, self.shift = float(max(beta[0], 1e-3)), float(beta[1])
        z = np.clip(x @ beta, -30, 30) * (1 - 2 * toxic)
        return float(np.mean(weight * np.log1p(np.exp(z))))

    # -- scoring
    def _windows(self, word: np.ndarray) -> np.ndarray:
        if len(word) <= self.window:
            return word.mean(keepdims=True) if len(word) else word
        total = np.r_[0.0, np.cumsum(word)]
        return (total[self.window :] - total[: -self.window]) / self.window

    def worst(self, text: str | None) -> float:
        """Margin of a text's most toxic passage."""
        best = -30.0
        words = words_of(text)
        for at in range(0, len(words), PIECE_WORDS):  # pieces overlap by a passage less a word
            some = words[max(0, at - self.window + 1) : at + PIECE_WORDS]
            known = self._known.holding(set(some), lambda new: self._margins(new).tolist())
            best = max(best, float(self._windows(np.array([known[w] for w in some])).max(initial=-30.0)))
        return best + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margin = np.array([self.worst(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def held_out(doc_id):
    """Whether the labels of a document take no part in training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> SubwordSoftmax:
    """Fit on a bounded sample of labelled documents: of each class the ``rows`` smallest by a hash of
    doc_id, less those of over ``chars`` characters. Held-out rows and null labels are never read."""
    spark = docs.sparkSession
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("label_id"), "toxic")
    order = [F.xxhash64("label_id"), F.col("label_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(rows).unionAll(known.where("toxic = 0").orderBy(*order).limit(rows))
    held = [tuple(r) for r in picked.collect()]  # at most 2 x rows small rows
    if not held:
        return SubwordSoftmax()
    picked = spark.createDataFrame(held, "label_id long, toxic int")
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
        .where(F.length("text") <= chars)
        .select("label_id", "text", "toxic")
        .collect()
    )
    texts.sort(key=lambda r: (r.label_id, r.text))
    return SubwordSoftmax().fit([r.text for r in texts], np.array([r.toxic for r in texts]))


def with_scores(docs: DataFrame, model: SubwordSoftmax, column: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` and the score of ``text``; the model goes out once for each executor.

    Null and empty texts get the score of a text without words; repeated and null ids keep their rows,
    equal texts score alike, an empty table stays empty; a column of docs named ``column`` is an error.
    No shuffle.
    """
    if column in docs.columns:
        raise ValueError(f"the table has a column {column} already")
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("toxicity", sent.value._known.clear)
        for batch in batches:
            for part in text_groups(batch, at):
                score = pa.array(sent.value.scores(part.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, column])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(run, schema)
