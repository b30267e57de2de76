"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence is toxic with probability sigmoid(PLAIN + weights of its words), and a document with the noisy-or of
its sentences and of a leak, which stands for labels that no word explains: 1 - (1 - leak) * prod((1 - p) / (1 - p0)),
where p0 = sigmoid(PLAIN) is a sentence's probability without evidence.  So sentences without evidence, or with more
against than for it, count as nothing, and length alone makes no document toxic.  Weights and leak are fitted to the
document labels by gradient steps on the likelihood.  The fitted model then scores every sentence and so finds the
offending ones.

A word's weight is the sum of those of its features: the word and its beginnings of three to six letters, so
that inflected and unseen forms of an offence count.  A feature takes part if toxic documents have it
significantly more often and most documents with it are toxic; its support counts the different pairs of
neighbours it has there, so that copies of one document are one piece of evidence.

Bounds: the model is fitted on the driver to at most `max_docs` labelled documents that are in the input, the first
in the order of a hash of their ids, and to at most `max_bytes` of their texts; it keeps all significant features of
these.  Scoring reads every text whole, in one pass without a shuffle.

Defined cases: null and empty texts have no sentences and the score of the leak alone; several labels of one id
count as toxic if one is; null labels and labels of unknown ids are left out; without labels of both kinds the
score of every text is the share of toxic labels (0 without any); repeated rows are scored each; a text without
sentence marks is one sentence; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, lean, prepare

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: A feature's G statistic against chance (about one in 10,000), the least support, and the lengths of beginnings.
SIGNIFICANT, SUPPORT, BEGINNINGS = 15.0, 3, (3, 4, 5, 6)
#: Log odds of a sentence without evidence.
PLAIN = -10.0
#: Weight that a feature has without contrary evidence; the ridge draws to it.
START = 4.0
#: Weights of words that a worker remembers, none of more than LONG characters; then it starts anew.
REMEMBERED, LONG = 100_000, 64


def features(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in BEGINNINGS if len(word) >= k]]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(begin, end, words) of every sentence that has a word; places are in characters."""
    for m in SENTENCE.finditer(text):
        words = {w.lower() for w in WORD.findall(m[0])}
        if words:
            yield m.start(), m.end(), words


def _softplus(x: np.ndarray | float) -> np.ndarray | float:
    return np.logaddexp(0.0, x)


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


def _evidence(weight: np.ndarray | float) -> np.ndarray | float:
    """What a sentence of that weight takes off the logarithm of the probability that its document is clean; nothing if it has none."""
    return np.maximum(0.0, _softplus(PLAIN + weight) - _softplus(PLAIN))


@dataclass
class Model:
    leak: float = -30.0  # log odds
    weights: dict[str, float] = field(default_factory=dict)
    memory: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        w = self.memory.get(word)
        if w is None:
            w = sum(self.weights.get(f, 0.0) for f in features(word)) if self.weights else 0.0
            if len(word) <= LONG:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = w
        return w

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score, and the sentences with a word of some weight: begin, end, probability."""
        found = []
        if not self.weights:
            return float(_sigmoid(self.leak)), []
        if any(map(self.word, set(WORD.findall(text.lower())))):
            for a, b, words in sentences(text):
                weights = [w for w in map(self.word, sorted(words)) if w]
                if weights:
                    found.append((a, b, sum(weights)))
        clean = -_softplus(self.leak) - sum(_evidence(w) for _, _, w in found)
        return float(min(1.0, max(0.0, -math.expm1(clean)))), [(a, b, float(_sigmoid(PLAIN + w))) for a, b, w in found]


def vocabulary(texts: Sequence[str], labels: np.ndarray) -> list[str]:
    """Features by significance.  Only those of toxic documents are counted, so memory follows these."""
    toxic: Counter[str] = Counter()
    for text, y in zip(texts, labels, strict=True):
        if y:
            toxic.update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    have = {f: [0, n] for f, n in toxic.items() if n >= SUPPORT}
    for text, y in zip(texts, labels, strict=True):
        if not y:
            for f in {f for w in set(WORD.findall(text.lower())) for f in features(w)} & have.keys():
                have[f][0] += 1
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    maybe = {f for f, (a, b) in have.items() if b > a and b * n0 > a * n1}
    around: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for text, y in zip(texts, labels, strict=True):
        if y:
            words = ["", *WORD.findall(text.lower()), ""]
            for before, w, after in zip(words, words[1:], words[2:], strict=False):
                for f in features(w):
                    if f in maybe:
                        around[f].add((before, after))

    def g(f: str) -> float:
        a, b = have[f][0], min(have[f][1], len(around[f]))
        out = 0.0
        for seen, total in ((a, n0), (b, n1)):
            share = (a + b) / (n0 + n1)
            for x, e in ((seen, total * share), (total - seen, total * (1 - share))):
                out += 2 * x * math.log(x / e) if x > 0 else 0.0
        return out if b >= SUPPORT and b > a and b * n0 > a * n1 else 0.0

    scored = sorted(((g(f), f) for f in maybe), key=lambda x: (-x[0], x[1]))
    return [f for s, f in scored if s >= SIGNIFICANT]


def fit(texts: Sequence[str], labels: Sequence[int], *, steps: int = 400, rate: float = 0.1, ridge: float = 1e-6) -> Model:
    """Maximum likelihood with a small ridge, by Adam on all documents."""
    y = np.asarray(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(leak=math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0))
    names = vocabulary(texts, y)
    index = {f: i for i, f in enumerate(names)}
    doc, sent, feat = [], [], []
    for d, text in enumerate(texts):
        for _, _, words in sentences(text):
            own = [index[f] for w in sorted(words) for f in features(w) if f in index]
            if own:
                sent += [len(doc)] * len(own)
                feat += own
                doc.append(d)
    doc, sent, feat = np.array(doc, np.int64), np.array(sent, np.int64), np.array(feat, np.int64)
    theta = np.concatenate([[math.log(share / (1 - share)) - 1], np.full(len(names), START)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        leak, w = theta[0], theta[1:]
        s = np.bincount(sent, weights=w[feat], minlength=len(doc))
        clean = -_softplus(leak) - np.bincount(doc, weights=_evidence(s), minlength=len(y))
        clean = np.minimum(clean, -1e-12)
        push = np.where(y == 1, np.exp(clean) / -np.expm1(clean), -1.0)  # of the loss by `clean`
        dz = -_sigmoid(PLAIN + s) * (s > 0) * push[doc]
        grad = np.concatenate([[-_sigmoid(leak) * push.sum()], np.bincount(feat, weights=dz[sent], minlength=len(names))]) / len(y)
        grad[1:] += ridge * (w - START)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[0]), dict(zip(names, theta[1:].tolist(), strict=True)))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = 3000, max_bytes: int = 64 << 20) -> Model:
    """Fit to labelled documents of `docs`, at most `max_docs` and `max_bytes` of text; `learn` is a condition on the label table's ids."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.filter(learn) if learn is not None else known
    known = known.groupBy(F.col(doc_id).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_y"))
    known = known.join(docs.select(F.col(doc_id).alias("_id")), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(known), "_id").groupBy("_t").agg(F.max("_y").alias("_y"))
    rows = Scratch(docs.sparkSession, "toxicity").table(rows.withColumn("_h", F.xxhash64("_t")), "labelled")
    # of the texts in the order of a hash, those that fit: one that is too long is passed over
    left, taken = max_bytes, []
    for r in sorted(rows.select("_h", F.octet_length("_t").alias("n")).collect()):
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["_h"],))
    chosen = docs.sparkSession.createDataFrame(sorted(set(taken)), "_h long")
    found = sorted((r["_t"], r["_y"]) for r in rows.join(F.broadcast(chosen), "_h", "left_semi").select("_t", "_y").collect())
    return fit([t for t, _ in found], [y for _, y in found])


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`doc_id, score, predicted, offending`: spans (characters) and scores of the sentences from the threshold on."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(docs[doc_id].alias("k"), docs[text].cast("string").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            done = [m.document(t if isinstance(t, str) else "") for t in b["t"]]
            spans = [[{"begin": x, "end": y, "score": p} for x, y, p in found if p >= threshold] for _, found in done]
            scores = [s for s, _ in done]
            yield pd.DataFrame({doc_id: b["k"].array, "score": scores, "predicted": [int(s >= threshold) for s in scores], "offending": spans})

    return narrow.mapInPandas(lean(run), f"`{doc_id}` {narrow.schema['k'].dataType.simpleString()}, score double, predicted int, offending array<struct<begin:int,end:int,score:double>>")


def filter_clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, all columns as they are, in one pass."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = [m.document(t or "")[0] < threshold for t in b.column(text).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
