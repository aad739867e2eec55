"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel counts the common four-character subsequences of two strings, with gaps, each weighted by a decay to the
power of the span it covers; spans of more than six characters do not count. A word with inserted or missing characters
keeps most of its subsequences, so it stays close to the plain word. Strings are lower-cased words without digits and
punctuation, between two end marks; runs of single letters are one string.

Training is multiple-instance learning on labelled texts: a toxic text has at least one toxic string, a clean one has
none. Nyström landmarks are chosen among the strings, the machine is fitted on the most toxic string of each toxic text
and the worst of the clean ones, the choice is repeated with the new scores, and a logistic curve maps the highest
string score of a text to a probability on labelled texts the machine was not fitted on. The labelled sample is bounded
(``TRAIN_TEXTS`` a class, by hash of the id); the texts of the sample are read whole.

As the decision is linear in the subsequences, scoring adds one table entry for each subsequence of a string and divides
by the string's own norm. Spark scores the texts partition by partition; a task remembers the strings it has seen.

Null and empty texts have no strings and get the lowest string score. Rows without an id are scored and count as not held
out. Of repeated labels of one id the highest counts. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import query, table, whole

SPAN, DECAY = 6, 0.7
LANDMARKS = 128
#: Characters that the kernel tells apart, besides the end marks; all others are one.
LETTERS = 40
TRAIN_TEXTS = 3000
PHASES, ROUNDS = 3, 3
#: Deviance from which a run of characters marks a string as toxic from the start (one in a million by chance).
SURE = 24.0
#: Strings whose scores a task remembers at most.
REMEMBERED = 300_000
THRESHOLD = 0.7
NOT_LETTERS = re.compile(r"[^\w\s]|[\d_]")


def strings(text: str) -> list[str]:
    """The strings of a text, in order."""
    found = NOT_LETTERS.sub("", text.lower()).split()
    single = [len(w) == 1 for w in found]
    if sum(single) >= 4:
        run = ""
        for w, one in zip(found + ["  "], single + [False]):
            if one:
                run += w
            else:
                if len(run) >= 4:
                    found.append(run)
                run = ""
    return found


@dataclass
class Kernel:
    """Characters by number; characters that no landmark has are all 0."""

    codes: dict[str, int]

    @property
    def base(self) -> int:
        return len(self.codes) + 1

    def subsequences(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, codes, weights) for blocks of words of one length: one column for each subsequence."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            # four places between the marks, the last at most SPAN - 1 after the first
            shape = np.array([(0, j, k, d) for d in range(3, SPAN) for k in range(2, d) for j in range(1, k)])
            spots = (np.arange(n)[:, None, None] + shape).reshape(-1, 4)
            spots = spots[spots[:, 3] < n + 2]
            if not len(spots):
                continue
            weights = DECAY ** (spots[:, 3] - spots[:, 0] + 1.0)
            step = max(1, 1_000_000 // len(spots))
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                ids = np.zeros((len(part), n + 2), np.int64)
                ids[:, 0], ids[:, -1] = self.codes["^"], self.codes["$"]
                flat = "".join([words[i] for i in part])
                ids[:, 1:-1] = np.array([self.codes.get(x, 0) for x in flat]).reshape(len(part), n)
                codes = ids[:, spots[:, 0]]
                for at in spots.T[1:]:
                    codes = codes * self.base + ids[:, at]
                yield part, codes, weights

    def norms(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The square root of each string's kernel with itself."""
        order = np.argsort(codes, axis=1, kind="stable")
        sorted_codes = np.take_along_axis(codes, order, 1)
        new = np.ones(codes.shape, bool)
        new[:, 1:] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
        starts = np.flatnonzero(new.ravel())
        sums = np.add.reduceat(weights[order].ravel(), starts)
        return np.sqrt(np.bincount(starts // codes.shape[1], weights=sums**2, minlength=len(codes)))

    def score(self, words: list[str], values: np.ndarray) -> np.ndarray:
        """For each word the sum of its subsequences' values over its norm."""
        out = np.zeros(len(words))
        for rows, codes, weights in self.subsequences(words):
            out[rows] = (values[codes] @ weights) / self.norms(codes, weights)
        return out

    def with_landmarks(self, words: list[str], marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kernel values (words x landmarks), the codes of the landmarks and their weights (codes x landmarks)."""
        blocks = list(self.subsequences(marks))
        used = np.unique(np.concatenate([codes.ravel() for _, codes, _ in blocks]))
        slot = np.full(self.base**4, len(used), np.int32)
        slot[used] = np.arange(len(used))
        small = np.zeros((len(used) + 1, len(marks)), np.float32)  # the last row is for subsequences of no landmark
        for rows, codes, weights in blocks:
            w = weights / self.norms(codes, weights)[:, None]
            np.add.at(small, (slot[codes], np.broadcast_to(rows[:, None], codes.shape)), w)
        out = np.zeros((len(words), len(marks)), np.float32)
        for rows, codes, weights in self.subsequences(words):
            w = np.broadcast_to(weights, codes.shape) / self.norms(codes, weights)[:, None]
            for s in range(0, len(rows), 500):
                part = slot[codes[s : s + 500]]
                dense = np.bincount(
                    (np.arange(len(part))[:, None] * len(small) + part).ravel(), weights=w[s : s + 500].ravel(), minlength=len(part) * len(small)
                )
                out[rows[s : s + 500]] = dense.reshape(len(part), -1).astype(np.float32) @ small
        return out, used, small[:-1]


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and offset of a squared-hinge linear machine, by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb, t = w, b, 1.0
    share = weight / weight.sum()
    rate = 1.0 / (2 * float((share * ((x**2).sum(1) + 1)).sum()) + l2)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * share * y
        nw, nb = vw + rate * (2 * x.T @ slack - l2 * vw), vb + rate * 2 * slack.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with softened targets, by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, p = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        h = design.T @ (design * (q * (1 - q))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (goal - q) - 1e-6 * p)
        p = p + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(max(p[0], 1e-6)), float(p[1])


@dataclass
class Model:
    kernel: Kernel
    values: np.ndarray
    offset: float
    slope: float
    level: float
    lowest: float

    def string_scores(self, words: list[str]) -> np.ndarray:
        return self.kernel.score(words, self.values) + self.offset

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.level, -30, 30)))


def hints(vocabulary: list[str], rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """For every string the signed deviance of its most telling run of four to eight characters, and that run.

    A run counts once for a text. This is where the choice of landmarks and of the first toxic strings starts.
    """
    runs: dict[str, int] = {}
    of = []
    for w in vocabulary:
        marked = f"^{w}$"
        parts = {marked[i : i + k] for k in (4, 5, 6, 7, 8) for i in range(max(1, len(marked) - k + 1))}
        of.append(np.array([runs.setdefault(x, len(runs)) for x in sorted(parts)]))
    seen = np.zeros((2, len(runs)))
    for r, y in zip(rows, toxic):
        if len(r):
            seen[y, np.unique(np.concatenate([of[i] for i in r]))] += 1
    n = np.array([[(toxic == 0).sum()], [(toxic == 1).sum()]], float)
    expected = seen.sum(0) * n / n.sum()
    deviance = 2 * (np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0)).sum(0)
    # a run that clean texts have as well says little, however often it occurs
    signed = np.where(seen[1] > 10 * seen[0] * n[1, 0] / n[0, 0], deviance, -1.0 - seen[0])
    names = list(runs)
    best = [o[np.argmax(signed[o])] for o in of]
    return signed[best], [names[i] for i in best]


def fit(bags: list[list[str]], toxic: np.ndarray) -> Model | None:
    """The model from the distinct strings of labelled texts; every fourth text only sets the curve."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    vocabulary = sorted({w for b in bags for w in b})
    number = {w: i for i, w in enumerate(vocabulary)}
    rows = [np.array([number[w] for w in b], np.int64) for b in bags]
    train = np.arange(len(bags)) % 4 != 3
    seen = np.zeros((2, len(vocabulary)))
    for r, y, t in zip(rows, toxic, train):
        if t:
            seen[y, r] += 1
    n0, n1 = max(1, (train & (toxic == 0)).sum()), max(1, (train & (toxic == 1)).sum())
    hint, run = hints(vocabulary, [r for r, t in zip(rows, train) if t], toxic[train])
    rare = seen[1] / n1 > 20 * seen[0] / n0
    share, taken, marks = LANDMARKS // 2, {}, []
    for i in np.lexsort((-seen[1], -hint)):  # several strings for each telling run
        if len(marks) < share and hint[i] > 0 and rare[i] and taken.setdefault(run[i], 0) < 4:
            taken[run[i]] += 1
            marks.append(vocabulary[i])
    common = [vocabulary[i] for i in np.argsort(-seen[0], kind="stable")[: LANDMARKS // 4]]
    marks += [w for w in common if w not in marks]
    score, worst = hint, {}
    for phase in range(PHASES):
        if phase:  # the clean strings that look most toxic become landmarks as well
            hard = [vocabulary[i] for i in np.lexsort((-seen[0], -score)) if seen[0, i] and not rare[i]]
            marks += [w for w in hard[: LANDMARKS // 4 // (PHASES - 1)] if w not in marks]
        often = Counter(c for w in marks for c in w)
        letters = sorted(sorted(often, key=lambda c: (-often[c], c))[:LETTERS])
        kernel = Kernel({c: i + 1 for i, c in enumerate(["^", "$", *letters])})
        gram, used_codes, profile = kernel.with_landmarks(marks, marks)
        size, turn = np.linalg.eigh(gram.astype(np.float64))
        root = turn / np.sqrt(np.maximum(size, 1e-6)) * (size > 1e-5)
        offset, values = 0.0, np.zeros(kernel.base**4, np.float32)
        for _ in range(ROUNDS):
            label = dict(worst)  # strings of clean texts that ever scored high stay
            for r, y, t in zip(rows, toxic, train):
                if t and len(r):
                    for i in r[np.argsort(-score[r], kind="stable")[: 1 if y else 3]]:
                        label[i] = int(y and rare[i])
                        if not y:
                            worst[i] = 0
                    if y:  # a toxic text may hold several toxic strings
                        sure = (hint[r] > SURE) if score is hint else (hint[r] > SURE) | (score[r] > 0)
                        label.update((i, 1) for i in r[rare[r] & sure])
            used = sorted(label)
            y = np.array([1.0 if label[i] else -1.0 for i in used])
            if y.min() == y.max():
                break
            k, _, _ = kernel.with_landmarks([vocabulary[i] for i in used], marks)
            weight = np.where(y > 0, seen[1, used], seen[0, used]) + 0.5
            weight = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
            w, offset = fit_linear(k @ root, y, weight)
            values[used_codes] = profile @ (root @ w)
            score = kernel.score(vocabulary, values) + offset
    lowest = float(score.min()) if len(score) else 0.0
    best = np.array([score[r].max() if len(r) else lowest for r in rows])
    slope, level = fit_curve(best[~train], toxic[~train].astype(float))
    return Model(kernel, values, float(offset), slope, level, lowest)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS) -> Model | None:
    """Fit on at most ``texts`` labelled texts of each class that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    chosen = part(0).unionAll(part(1))  # 2 * texts rows at most

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"bag": [" ".join(sorted(set(strings(t)))) for t in b["text"]], "toxic": b["toxic"], "doc_id": b["doc_id"].astype(str)})

    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.mapInPandas(bags, "bag string, toxic int, doc_id string").toPandas()
    got = got.drop_duplicates().sort_values(["doc_id", "bag"])
    return fit([b.split() for b in got["bag"]], got["toxic"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, float] = {}
        for b in batches:
            bags = [set(strings(t)) for t in b["text"]]
            if model is None:
                yield pd.DataFrame({"id": b["id"], "score": np.zeros(len(b))})
                continue
            if len(memory) > REMEMBERED:
                memory = {}
            new = sorted(set().union(*bags).difference(memory))
            memory.update(zip(new, model.string_scores(new).tolist()))
            best = np.array([max(map(memory.__getitem__, x), default=model.lowest) for x in bags])
            yield pd.DataFrame({"id": b["id"], "score": model.probability(best)})

    d = docs.select(F.col("doc_id").cast("string").alias("id"), whole(F.col("text")).alias("text"))
    d = d.mapInPandas(run, "id string, score double").select(F.col("id").cast(kind).alias("doc_id"), "score")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query()
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
