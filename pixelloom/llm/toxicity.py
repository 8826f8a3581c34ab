"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Words (lower-cased, everything but letters and digits removed, so that inserted punctuation does not
hide them) are compared by the gap-weighted subsequence kernel: common subsequences of ``P`` characters,
each weighted by LAMBDA to the length it spans in both words, normalised to 1 for equal words; values up to FLOOR, as
words without anything to do with each other have, count as none and the rest is stretched to 0..1. An insult
with letters put in or left out keeps most of its subsequences. No value over FLOOR is skipped: a word that shares the
letters A with a landmark reaches at most the norm of the landmark's subsequences in A alone (Cauchy-Schwarz), which is
tabulated for every A; words for which it is under FLOOR are zero.

Landmarks are words of labelled toxic documents that are in them more often than chance gives (near copies counted once),
picked one after the other so that each is typical of toxic documents that those before it do not cover. A sentence
or text is a bag of words; its kernel with a landmark is pooled over its words (sum, as log(1 + x), and maximum), and the
pooled values are whitened with the landmarks' own kernel matrix (Nystroem). On these features a linear machine with squared
hinge loss is trained by Newton steps and calibrated to probabilities on documents of held-back folds.

Training examples are sentences and whole texts. Labels are per document, so a document that is not toxic labels all its sentences
(they weigh half as much as the document, together), and a toxic one its worst: the machine is trained, the sentence
that it finds worst is taken from each toxic document, and so on. Toxic documents also train with a letter put into each landmark
word. The model is fitted on at most ``max_toxic`` and ``max_clean`` labelled rows, those of the smallest hash of the id;
everything else covers all rows.

Defined cases: null, empty and wordless texts have zero features and the score of those; labels of
documents that do not exist, null labels and repeated labels that disagree (toxic wins) are handled; rows that repeat get equal
scores; without both labels every score is 0; words over 40 characters are compared in overlapping pieces; very long texts are
scored whole; a column named like the score is replaced, all others pass through.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_cache

P, LAMBDA = 3, 0.75
LANDMARKS = 64
#: Kernel values up to this count as none; the rest is stretched to 0..1.
FLOOR = 0.4
LONGEST = 40
#: How unlikely by chance a landmark's number of toxic documents is at least.
CHANCE = 1e-6
#: Words a Python worker remembers; a bound on its memory, without effect on results.
CACHED_WORDS = 200_000
ODD = re.compile(r"[\W_]+")
END = re.compile(r"[.!?]+\s+|[\r\n]+")


def tokens(text: str) -> list[str]:
    """Raw words; single characters in a row are one word (``i d i o t``)."""
    words = text.lower().split()
    out, run = [], []
    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if run:
            out.append("".join(run))
            run = []
        out.append(w)
    if run:
        out.append("".join(run))
    return out


def letters(words: list[str]) -> np.ndarray:
    """Code points, zero-padded, a row a word."""
    return np.array(words, dtype=f"<U{max(1, max(map(len, words)))}").view(np.uint32).reshape(len(words), -1)


def kernel(s: np.ndarray, t: np.ndarray, p: int = P, decay: float = LAMBDA) -> np.ndarray:
    """The unnormalised kernel of each row of ``s`` with its row of ``t`` (or with the only one)."""
    n, m = len(s), t.shape[1]
    k = np.arange(m)
    # Row j' to column j: a match at j' reaches the later column j with one decay a step.
    reach = np.where(k[None, :] >= k[:, None], np.float32(decay) ** (k[None, :] - k[:, None]).clip(0), 0).astype(np.float32)
    shifted = np.eye(m, k=1, dtype=np.float32)
    prefix = [np.zeros((n, m), np.float32) for _ in range(p - 1)]  # subsequences of q characters before column j
    total = np.zeros(n, np.float32)
    for i in range(s.shape[1]):
        c = s[:, i : i + 1]
        same = ((t == c) & (c != 0)).astype(np.float32) * np.float32(decay * decay)
        total += (same * (prefix[-1] @ shifted)).sum(1)
        for q in range(p - 2, 0, -1):
            prefix[q] = prefix[q] * np.float32(decay) + (same * (prefix[q - 1] @ shifted)) @ reach
        prefix[0] = prefix[0] * np.float32(decay) + same @ reach
    return total


def own(words: np.ndarray) -> np.ndarray:
    return np.sqrt(kernel(words, words)).astype(np.float32)


def bounds(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letters of a landmark and, for each set of them as bits, the most a word without the other letters can reach."""
    chars = np.unique(mark)
    sets = np.arange(1 << min(len(chars), 14))
    place = np.searchsorted(chars, mark[0])
    # Letters outside of a set are zero, which matches nothing; the letters beyond the 14th always count as shared.
    held = (place[None, :] >= 14) | ((sets[:, None] >> np.minimum(place, 14)[None, :]) & 1 == 1)
    norm = own(np.where(held, mark, 0))
    return chars, norm / norm[-1]


@dataclass
class Model:
    landmarks: list[str]
    white: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    key: str = ""

    def __post_init__(self) -> None:
        self.marks = [letters([w]) for w in self.landmarks]
        self.norm = np.array([own(x)[0] for x in self.marks], np.float32)
        self.bounds = [bounds(x) for x in self.marks]
        self.alphabet = sorted({int(c) for x in self.marks for c in x[0]})

    def similar(self, words: list[str]) -> np.ndarray:
        """``(words, landmarks)`` stretched kernel values of cleaned words."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            if len(words[part[-1]]) < P:
                continue
            x = letters([words[i] for i in part])
            selves = None
            held = {c: (x == c).any(1) for c in self.alphabet}
            for k, (mark, (chars, most)) in enumerate(zip(self.marks, self.bounds)):
                shared = np.zeros(len(x), np.int64)
                for i, c in enumerate(chars[:14]):
                    shared |= held[int(c)].astype(np.int64) << i
                some = np.flatnonzero(most[shared] > FLOOR - 1e-3)
                if not len(some):
                    continue
                if selves is None:
                    selves = np.maximum(own(x), np.float32(1e-12))
                value = kernel(x[some], mark) / (selves[some] * self.norm[k])
                out[part[some], k] = np.maximum(0, (value - FLOOR) / (1 - FLOOR))
        return out

    def vectors(self, raw: list[str]) -> dict[str, np.ndarray | None]:
        """Raw word to its landmark values, None for all zero."""
        pieces: list[str] = []
        owner: list[int] = []
        for i, w in enumerate(raw):
            w = w if w.isalnum() else ODD.sub("", w)
            parts = [w] if len(w) <= LONGEST else [w[a : a + LONGEST] for a in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
            pieces += parts
            owner += [i] * len(parts)
        found: dict[str, np.ndarray | None] = dict.fromkeys(raw)
        if pieces:
            values = self.similar(pieces)
            for i in np.flatnonzero(values.any(1)):
                w = raw[owner[i]]
                found[w] = values[i].copy() if found[w] is None else np.maximum(found[w], values[i])
        return found

    def pooled(self, texts: list[str]) -> np.ndarray:
        split = [tokens(t) for t in texts]
        # Words to the place of their vector in rows, 0 for words without one.
        cache = worker_cache(("toxicity", self.key))
        known, rows = cache.setdefault("known", {}), cache.setdefault("rows", [None])
        before = len(rows)
        new = list(set().union(*split).difference(known))
        for w, v in self.vectors(new).items():
            known[w] = 0 if v is None else len(rows)
            if v is not None:
                rows.append(v)
        m = len(self.landmarks)
        out = np.zeros((len(texts), 2 * m), np.float32)
        for i, words in enumerate(split):
            hit = list(filter(None, map(known.__getitem__, words)))
            if hit:
                x = np.array([rows[k] for k in hit])
                out[i, :m] = np.log1p(x.sum(0))
                out[i, m:] = x.max(0)
        if len(known) > CACHED_WORDS:
            for w in new:
                del known[w]
            del rows[before:]
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        x = self.pooled(texts)
        m = len(self.landmarks)
        return np.concatenate((x[:, :m] @ self.white, x[:, m:] @ self.white), 1)

    def decide(self, texts: list[str]) -> np.ndarray:
        return self.features(texts) @ self.weights + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decide(texts) + self.shift, -50, 50)))


def chance(toxic: int, clean: int, rate: float) -> float:
    """Probability that so many or more of ``toxic + clean`` documents are toxic if each is at ``rate``."""
    n = toxic + clean
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate) for k in range(toxic, n + 1)]
    return math.exp(max(log)) * sum(math.exp(x - max(log)) for x in log)


def pick(texts: list[str], toxic: np.ndarray, count: int) -> list[str]:
    """Landmark words, each typical of toxic texts that have none of those before."""
    def bag(text: str) -> set[str]:
        return {w for t in set(tokens(text)) if P <= len(w := ODD.sub("", t)) <= LONGEST}

    of: dict[str, list[int]] = {}
    copy: dict[int, int] = {}
    for i in np.flatnonzero(toxic).tolist():
        for w in bag(texts[i]):
            of.setdefault(w, []).append(i)
        # Near copies count once: they share the least hash of their word pairs.
        own_words = texts[i].split()
        copy[i] = min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(own_words, own_words[1:])), default=-1 - i)
    clean = Counter(w for i in np.flatnonzero(~toxic).tolist() for w in bag(texts[i]) if w in of)
    share = 1 / max(1, (~toxic).sum())
    n = max(1, toxic.sum())
    of = {w: ids for w, ids in of.items() if len(ids) >= 3 and len(ids) / n > 4 * clean[w] * share}
    sure = {w: ids for w, ids in of.items() if chance(len({copy[i] for i in ids}), clean[w], n / len(texts)) < CHANCE}
    of = sure or of
    weight = np.ones(len(texts))
    chosen: list[str] = []
    while of and len(chosen) < count:
        value = lambda w: weight[of[w]].sum() / n - clean[w] * share
        best = max(of, key=lambda w: (value(w), w))
        if value(best) <= 0:
            break
        chosen.append(best)
        weight[of.pop(best)] *= 0.6
    return chosen


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and bias (last) of the squared-hinge machine."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(len(w))
        for a in range(0, len(x), 4096):  # a wide copy of a few rows at a time
            rows, own = np.concatenate((x[a : a + 4096], np.ones((len(x[a : a + 4096]), 1))), 1).astype(np.float64), y[a : a + 4096]
            inside = own * (rows @ w) < 1
            rows, own = rows[inside], own[inside]
            scaled = rows * (c * weight[a : a + 4096][inside])[:, None]
            left += scaled.T @ rows
            right += scaled.T @ own
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def calibrated(d: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels to decision values."""
    x = np.stack((d, np.ones(len(d))), 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def gapped(text: str, marks: set[str]) -> str:
    """The text with one letter put into each of its words that are landmarks."""

    def one(found: re.Match) -> str:
        w = found[0]
        if ODD.sub("", w.lower()) not in marks:
            return w
        h = zlib.crc32(f"{found.start()} {w}".encode())
        at = 1 + h % (len(w) - 1)
        return w[:at] + chr(97 + h // 32 % 26) + w[at:]

    return re.sub(r"\S+", one, text)


def sentences(text: str) -> list[str]:
    """Parts of a text that end at ``.!?`` before white space, or at line ends; at least one."""
    return [x for x in END.split(text) if x.strip()] or [""]


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray, owner: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Weights and bias from texts ``x`` and their sentences ``part``, which belong to the texts ``owner``, in order."""
    first = np.searchsorted(owner, np.arange(len(x)))
    size = np.diff(np.append(first, len(owner)))
    clean = np.flatnonzero((y[owner] < 0) & part.any(1))
    of = owner[clean]
    share = weight[of] / 2 / np.bincount(of, minlength=len(x))[of]
    w = newton(x, y, weight)
    for _ in range(rounds):
        decision = part @ w[:-1] + w[-1]
        ends = np.flatnonzero(decision == np.repeat(np.maximum.reduceat(decision, first), size))
        bad = ends[np.unique(owner[ends], return_index=True)[1]]
        bad = bad[y[owner[bad]] > 0]
        w = newton(np.concatenate((x, part[bad], part[clean])), np.concatenate((y, np.ones(len(bad)), -np.ones(len(clean)))), np.concatenate((weight, weight[owner[bad]] / 2, share)))
    return w


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray | None = None, count: int = LANDMARKS) -> Model | None:
    """The model of labelled texts; ``weight`` says how many rows each stands for. None without both labels."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    weight = np.ones(len(texts)) if weight is None else weight / weight.mean()
    landmarks = pick(texts, toxic, count)
    if not landmarks:
        return None
    model = Model(landmarks, np.eye(len(landmarks), dtype=np.float32), np.zeros(2 * len(landmarks)), 0.0, 1.0, 0.0, " ".join(landmarks))
    base = model.similar(landmarks)
    values, vectors = np.linalg.eigh((base + base.T) / 2)
    model.white = (vectors / np.sqrt(np.maximum(values, 0.05))).astype(np.float32) @ vectors.T.astype(np.float32)
    marks = set(landmarks)
    virtual = [(i, t) for i in np.flatnonzero(toxic).tolist() if (t := gapped(texts[i], marks)) != texts[i]]
    source = np.concatenate((np.arange(len(texts)), np.array([i for i, _ in virtual], np.int64)))
    every = [*texts, *(t for _, t in virtual)]
    x = np.concatenate([model.features(every[a : a + 500]) for a in range(0, len(every), 500)])
    parts, owners = [], []
    for a in range(0, len(every), 500):  # of each text its first sentence, and all that have features
        split = [sentences(t) for t in every[a : a + 500]]
        own_ = np.repeat(np.arange(a, a + len(split)), [len(s) for s in split])
        found = model.features([s for text in split for s in text])
        keep = found.any(1)
        keep[np.searchsorted(own_, np.arange(a, a + len(split)))] = True
        parts.append(found[keep])
        owners.append(own_[keep])
    part, owner = np.concatenate(parts), np.concatenate(owners)
    y = np.where(toxic, 1.0, -1.0)[source]
    weight = weight[source] * np.where(np.arange(len(every)) < len(texts), 1, 0.5)

    def learned(some: np.ndarray) -> np.ndarray:
        place = np.cumsum(some) - 1
        return learn(x[some], y[some], weight[some], part[some[owner]], place[owner[some[owner]]])

    fold = source % 3
    held = np.zeros(len(texts))
    for f in range(3):
        if len(set(y[fold != f])) == 2:
            w = learned(fold != f)
            at = np.flatnonzero(fold[: len(texts)] == f)
            held[at] = x[at] @ w[:-1] + w[-1]
    model.slope, model.shift = calibrated(held, toxic.astype(float), weight[: len(texts)])
    w = learned(np.ones(len(every), bool))
    model.weights, model.bias = w[:-1], float(w[-1])
    worker_cache(("none",))  # the worker forgets the words
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_toxic: int = 2000, max_clean: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on at most ``max_toxic`` and ``max_clean`` rows of ``labels`` for which ``usable`` holds (a condition on its id).

    Of rows of ``docs`` that repeat an id and its text one is taken. The rows meet in one task, which fits the model; what reaches the
    driver are its landmarks and weights.
    """
    rows = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg((F.max(label_col) > 0).alias("__toxic"))
    count = {r["__toxic"]: r["count"] for r in rows.groupBy("__toxic").count().collect()}
    by_hash = [rows.filter(F.col("__toxic") == y).orderBy(F.xxhash64("__label_id"), "__label_id").limit(n) for y, n in ((True, max_toxic), (False, max_clean))]
    few = F.broadcast(by_hash[0].unionByName(by_hash[1]))  # at most max_toxic + max_clean rows
    sample = docs.join(few, F.col(id_col) == F.col("__label_id")).select("__label_id", F.col("__toxic").alias("toxic"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["__label_id"], r["text"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        toxic = np.array([r[2] for r in found], bool)
        if toxic.any() and not toxic.all():
            weight = np.where(toxic, count[True] / toxic.sum(), count[False] / (~toxic).sum())
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit([r[1] for r in found], toxic, weight))], pa.binary())})

    row = sample.coalesce(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``score_col`` from 0 to 1, which replaces one of that name; other columns pass through."""
    columns = [c for c in docs.columns if c != score_col]
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias(score_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few landmarks and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at = columns.index(text_col)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                x = batch.slice(a, 500)
                texts = [t or "" for t in x.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(own.score(texts).astype(np.float64))], [*x.schema.names, score_col])

    picked = docs.select(*columns)
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields, T.StructField(score_col, T.DoubleType())]))
