"""Toxic documents by a subsequence string kernel, Nyström landmarks and a linear support vector machine over sentences.

A text is cut into sentences (after ``.``, ``!`` or ``?`` before a space, and at line breaks). The kernel compares two character windows of sentences by
their common subsequences of four characters: each is
weighed by ``decay`` for every character skipped, so ``id.i.ot``, ``id iot`` and ``stuupid`` stay near ``idiot``
and ``stupid``. A window is a token with marks for its ends, or two adjacent short tokens with the gap between them; long tokens are cut into overlapping
windows, and letters set apart by spaces are joined into one. Sentences carry their document's label;
as most sentences of a toxic document, and most windows of a toxic sentence, are harmless, the machine is trained as multiple-instance
learning: its positives are the windows that best explain each toxic document's two worst sentences, its negatives are the
windows of the other documents' sentences. ``landmarks`` windows span the kernel space (Nyström): the decision is a weighted
sum of kernels with landmarks, and as the kernel is a dot product of subsequence counts, the sum folds
into one weight for each subsequence. That makes scoring a window exact and cheap.
A sentence is as toxic as its worst window; a document's score is logistic in its three worst sentences (those with
the same worst window count once).

Training takes ``most`` labelled documents of each class at most, with all windows of their whole texts, on the driver
(half a kilobyte a distinct window); scoring covers every row and whole texts.

Defined results: null and empty texts have no windows and get the score of a clean document; with
labels of one class only, or none, every score is 0.5; where no toxic document has a window, every score is the share of toxic labels.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_rows

ORDER, REACH, LONG = 4, 7, 12  # a subsequence of ORDER characters lies within REACH kept ones; windows have LONG at most
END, OTHERS = 27, 19  # codes: a-z from 1, the end mark, then letters beyond ASCII
BASE = END + 1 + OTHERS
#: Fixed: characters that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SHORT = 3  # letters of a token that may be a part of a word
_APART = re.compile(r"(?<!\w)(?:\w[\s.\-_*]+){3,}\w(?!\w)")
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Codes(dict):
    """Code of a character, 0 for one that is skipped."""

    def __missing__(self, c: str) -> int:
        own = STAND_INS.get(c, c).lower()
        if "a" <= own <= "z":
            x = ord(own) - 96
        else:
            x = END + 1 + ord(c) % OTHERS if c.isalpha() else 0
        self[c] = x
        return x


def sentences(text: str) -> list[str]:
    return [x for x in _SENTENCE.split(text) if x and not x.isspace()]


def pieces(sentence: str) -> list[str]:
    """What a sentence is looked up by: its tokens in lower case, pairs of adjacent short ones, and letters set apart, joined."""
    tokens = sentence.lower().split()
    short = [len(t) <= SHORT for t in tokens]
    found = tokens + [f"{a} {b}" for a, b, x, y in zip(tokens, tokens[1:], short, short[1:], strict=False) if x and y]
    if sum(len(t) == 1 for t in tokens) > 2:
        found += ["".join(m.split()) for m in _APART.findall(sentence.lower())]
    return found


def cut(piece: str) -> list[str]:
    """The windows of a piece: without marks at its ends, a long one in overlapping parts."""
    t = piece.strip(_STRIP)
    if len(t) <= LONG:
        return [t] if t else []
    return [t[i : i + LONG] for i in range(0, len(t) - LONG // 2, LONG // 2)]


def windows(text: str) -> set[str]:
    """Distinct windows of a text's sentences."""
    return {w for s in sentences(text) for p in pieces(s) for w in cut(p)}


#: Places of the subsequences in windows of so many symbols (both end marks included).
_COMBOS = {n: np.array([c for c in combinations(range(n), ORDER) if c[-1] - c[0] < REACH], np.int64).reshape(-1, ORDER) for n in range(LONG + 4)}


def subsequences(tokens: list[str], decay: float, codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, subsequence, weight) of the distinct subsequences of each token, by token; the weights of a token have norm 1."""
    by_width: dict[int, tuple[list, list, list]] = {}
    get = codes.__getitem__
    for i, t in enumerate(tokens):
        kept = [(x, p) for p, x in enumerate(map(get, t), 1) if x]
        own, symbols, places = by_width.setdefault(len(kept) + 2, ([], [], []))
        own.append(i)
        symbols.append([END, *(x for x, _ in kept), END])
        places.append([0, *(p for _, p in kept), len(t) + 1])
    keys, weights = [], []
    for width, (own, symbols, places) in by_width.items():
        combos = _COMBOS[width].T
        if not combos.size:
            continue
        symbol, place = np.array(symbols, np.int64), np.array(places, np.int64)
        number = symbol[:, combos[0]]
        for c in combos[1:]:
            number = number * BASE + symbol[:, c]
        skipped = place[:, combos[-1]] - place[:, combos[0]] - (ORDER - 1)
        keys.append((np.array(own, np.int64)[:, None] * BASE**ORDER + number).ravel())
        weights.append((decay ** np.arange(2 * LONG + 3.0))[skipped].ravel())
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    weight = np.add.reduceat(weight, first)
    row, number = np.divmod(key[first], BASE**ORDER)
    norm = np.sqrt(np.bincount(row, weight**2, minlength=len(tokens)))
    return row, number, weight / norm[row]


class Machine:
    """``weights`` holds the folded decision: one weight a subsequence; ``head`` the logistic over the three worst windows."""

    def __init__(self, weights: np.ndarray, bias: float, decay: float, head: np.ndarray):
        self.weights, self.bias, self.decay, self.head = weights, bias, decay, head
        self.known: dict[str, float] = {}
        self.codes = _Codes()

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "decay": self.decay, "head": self.head}

    def __setstate__(self, x):
        self.__init__(**x)

    def decide(self, tokens: list[str]) -> np.ndarray:
        out = np.full(len(tokens), self.bias)
        for at in range(0, len(tokens), 4000):
            part = tokens[at : at + 4000]
            row, number, weight = subsequences(part, self.decay, self.codes)
            out[at : at + len(part)] += np.bincount(row, weight * self.weights[number], minlength=len(part))
        return out

    def worst(self, texts: list[str], most_known: int = 400_000) -> tuple[np.ndarray, list[str | None]]:
        """The decisions of each text's three worst sentences, as far as there are, and the worst sentence."""
        if len(self.known) > most_known:  # only what has been scored once; nothing depends on it
            self.known.clear()
        split = [sentences(t) for t in texts]
        found = [[pieces(s) for s in x] for x in split]
        known = self.known
        if new := {p for x in found for s in x for p in s if p not in known}:
            parts = {p: cut(p) for p in new}
            own = sorted({w for x in parts.values() for w in x})
            value = dict(zip(own, self.decide(own).tolist(), strict=True))
            known.update((p, max(((value[w], w) for w in x), default=(-1.5, ""))) for p, x in parts.items())
        out, where = np.full((len(texts), 3), -1.5), []
        for i, x in enumerate(found):
            by_window: dict[str, tuple[float, int]] = {}
            for k, s in enumerate(x):
                v, w = max(map(known.__getitem__, s))
                if w not in by_window:
                    by_window[w] = (v, k)
            top = sorted(by_window.values(), key=lambda y: (-y[0], y[1]))[:3]
            out[i, : len(top)] = [v for v, _ in top]
            where.append(split[i][top[0][1]] if top else None)
        return np.clip(out, -1.5, 1), where

    def score(self, texts: list[str]) -> np.ndarray:
        return self.judge(texts)[0]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """(score, decision of the worst sentence, that sentence) of each text."""
        worst, where = self.worst(texts)
        z = (evidence(worst) * self.head).sum(axis=1)  # row by row: the same in any batch
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), worst[:, 0], where


def evidence(worst: np.ndarray) -> np.ndarray:
    """What the head sees of the three worst sentences: the worst one, and the others as far as they speak for toxicity."""
    return np.column_stack([np.ones(len(worst)), worst[:, 0], np.maximum(worst[:, 1:], 0)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted linear machine on squared hinge loss, by Newton steps on the rows within the margin, a block of rows at a time."""
    w = np.zeros(z.shape[1])
    for _ in range(25):
        grad, hess = ridge * w, ridge * np.eye(len(w))
        for at in range(0, len(z), 8192):
            block, sign, own = z[at : at + 8192].astype(np.float32), y[at : at + 8192], weight[at : at + 8192]
            margin = 1 - sign * (block @ w.astype(np.float32))
            on = margin > 0
            a = block[on]
            grad -= (own[on] * sign[on] * margin[on]) @ a
            hess += (a * own[on][:, None].astype(np.float32)).T @ a
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(texts: list[str], y: np.ndarray, toxic_share: float, landmarks: int = 128, decay: float = 0.5, ridge: float = 0.06, rounds: int = 3, share_of_variants: float = 0.1, seed: int = 11) -> Machine | None:
    if len(y) == 0 or y.min() == y.max():
        return None
    bags = [[sorted({w for p in pieces(s) for w in cut(p)}) for s in sentences(t)] for t in texts]
    sets = [{w for s in b for w in s} for b in bags]
    n1, n0 = int(y.sum()), int((1 - y).sum())
    prior = np.log(max(toxic_share, 1e-6) / max(1 - toxic_share, 1e-6))
    if not any(s for s, label in zip(sets, y, strict=True) if label == 1):
        return Machine(np.zeros(BASE**ORDER, np.float32), -1.5, decay, np.array([prior, 0.0, 0.0, 0.0]))
    count = [Counter(), Counter()]
    for s, label in zip(sets, y, strict=True):
        count[label].update(s)
    both = Counter(count[0])
    both.update(count[1])
    vocabulary = sorted(both, key=lambda w: (-both[w], w))
    number = {w: i for i, w in enumerate(vocabulary)}
    pos, neg = (np.array([count[k][w] for w in vocabulary], float) for k in (1, 0))
    odds = np.log((pos + 0.3) / (n1 + 0.6)) - np.log((neg + 0.3) / (n0 + 0.6))
    # landmarks: the windows that speak most for and against, and others at random
    rng = np.random.default_rng(seed)
    order = np.argsort(-odds * np.sqrt(pos), kind="stable")
    half = min(landmarks // 2, len(vocabulary))
    rest = order[half:]
    picked = np.concatenate([order[:half], rng.choice(rest, min(landmarks - half, len(rest)), replace=False)])
    codes = _Codes()
    marks, m_feature, m_weight = subsequences([vocabulary[i] for i in picked], decay, codes)
    used = np.unique(m_feature)
    table = np.zeros((len(used) + 1, len(picked)), np.float32)
    table[np.searchsorted(used, m_feature), marks] = m_weight

    def kernels(tokens: list[str]) -> np.ndarray:
        """Kernel values of the tokens with the landmarks."""
        row, feature, weight = subsequences(tokens, decay, codes)
        at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
        hit = used[at] == feature
        row, at, weight = row[hit], at[hit], weight[hit].astype(np.float32)
        out = np.zeros((len(tokens), len(picked)), np.float32)
        for begin in range(0, len(row), 20_000):
            part = slice(begin, begin + 20_000)
            r, first = np.unique(row[part], return_index=True)
            out[r] += np.add.reduceat(table[at[part]] * weight[part, None], first, axis=0)
        return out

    inside = kernels([vocabulary[i] for i in picked]).astype(float)
    values, vectors = np.linalg.eigh((inside + inside.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])

    def spanned(tokens: list[str]) -> np.ndarray:
        """Coordinates of the tokens in the landmarks' space, half a kilobyte each; the last one is the bias."""
        out = np.ones((len(tokens), root.shape[1] + 1), np.float16)
        for at in range(0, len(tokens), 4000):
            out[at : at + 4000, :-1] = kernels(tokens[at : at + 4000]) @ root.astype(np.float32)
        return out

    z = spanned(vocabulary)
    toxic = []  # of each toxic document: its windows, sentence by sentence, and where sentences start
    for b, label in zip(bags, y, strict=True):
        if label == 1 and (b := [s for s in b if s]):
            toxic.append((np.array([number[w] for s in b for w in s]), np.cumsum([0, *map(len, b[:-1])])))
    score = odds * np.minimum(1, pos / 2)
    negative = neg / n0
    w = np.zeros(z.shape[1])
    for turn in range(rounds):
        positive = np.zeros(len(vocabulary))
        for own, starts in toxic:
            worst = np.maximum.reduceat(score[own], starts)
            top = []
            for k in np.argsort(-worst, kind="stable"):  # the windows that make the two worst sentences so
                at = own[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(own)]
                best = int(at[np.argmax(score[at])])
                if best not in top:
                    top.append(best)
                if len(top) == 2:
                    break
            if len(starts) == 1:  # of a single sentence, its two worst windows
                top = own[np.argsort(-score[own], kind="stable")[:2]]
            if turn == 0 or score[top[0]] > -0.5 or not positive.any():  # labels without any window that speaks for them are noise
                positive[top] += 1
        yes, no = np.flatnonzero(positive), np.flatnonzero(negative)
        rows = np.concatenate([yes, no])
        share = np.concatenate([positive[yes] / positive.sum(), negative[no] / negative.sum() if len(no) else negative[no]])
        labels = np.concatenate([np.ones(len(yes)), -np.ones(len(no))])
        w = _svm(z[rows], labels, share, ridge * 1e-2)
        score = np.concatenate([z[at : at + 8192].astype(np.float32) @ w for at in range(0, len(z), 8192)])
    # the windows that came out as insults, with a character let in, doubled or masked, are insults too
    strong = yes[score[yes] > 0.3]
    if len(strong):
        variants, weights = [], []
        for i in strong:
            t = vocabulary[i]
            k = 1 + int(rng.integers(max(1, len(t) - 1)))
            made = {t[:k] + "." + t[k:], t[:k] + t[k - 1] + t[k:], t[: k - 1] + "*" + t[k:] if len(t) > 4 else ".".join(t)}
            variants += sorted(made)
            weights += [positive[i] / len(made)] * len(made)
        share = np.concatenate([share, np.array(weights) / sum(weights) * positive[strong].sum() / positive.sum() * share_of_variants])
        w = _svm(np.concatenate([z[rows], spanned(variants)]), np.concatenate([labels, np.ones(len(variants))]), share, ridge * 1e-2)
    beta = root @ w[:-1]
    folded = np.zeros(BASE**ORDER, np.float32)
    np.add.at(folded, m_feature, m_weight * beta[marks])
    machine = Machine(folded, float(w[-1]), decay, np.zeros(4))
    worst, _ = machine.worst(texts)
    alone = worst[(y == 1) & (worst[:, 0] > 0.7)] * [1, 0, 0] + [0, -1.5, -1.5]  # one insult is enough: each toxic document also by its worst window alone
    machine.head = _logistic(np.concatenate([evidence(worst), evidence(alone)]), np.concatenate([y, np.ones(len(alone))]).astype(float), 1e-5)
    n1 += len(alone)
    # the classes were sampled apart: the intercept makes up for it
    machine.head[0] += prior - np.log(n1 / n0)
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 700, id_col: str = "doc_id", **options) -> Machine | None:
    from .labelled import class_counts

    got = training_rows(docs, labels, label, most, id_col).collect()  # 2 x most documents at most
    got.sort(key=lambda r: (str(r["__id"]), r["text"]))
    zeros, ones = class_counts(labels, label, id_col)
    return fit([r["text"] for r in got], np.array([r["__label"] for r in got], int), ones / max(1, ones + zeros), **options)


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 700, cut: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` (1 if the score is at least ``cut``), ``worst`` (decision of the worst sentence) and ``sentence`` (that sentence; null without words or model)."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, most, id_col))  # one float a subsequence
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))

    def run(batches):
        machine = held.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                n = len(texts)
                s, worst, where = (np.full(n, 0.5), np.full(n, -1.5), [None] * n) if machine is None else machine.judge(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(worst, pa.float64()), pa.array(where, pa.string())], ["__id", "score", "worst", "sentence"])

    kind = rows.schema["__id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"__id {kind}, score double, worst double, sentence string").withColumnRenamed("__id", id_col)
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "worst", "sentence")
