"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each labeller votes good (1), bad (-1) or nothing (0) on a text; the labellers overlap and err.  The numbers of all
documents by pattern of votes are a sufficient statistic; there are at most 3 ** labellers patterns whatever the corpus.
EM estimates from them how often each labeller votes which way on good and on bad texts, and so the posterior of every
pattern.  A linear model of hashed words and of bucketed shape features learns these posteriors on a sample of at most
``TRAIN_ROWS`` different documents and scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, in_arrow, uniform
from .hashed import Design, Scorer, fit, sigmoid

TRAIN_ROWS, SEED, KEEP = 6_000, 6, 0.5
#: Texts of fewer words are judged as if they had so many, by their shape more than by their words.
SHORT = 50
_SYMBOLS = re.compile(r"[#*$%&|<>]+")
#: Frequent words of the languages of the corpus.
_STOP = frozenset(
    "the and of to in is that it was for on are with as be at by this from "
    "der die das und ist nicht ein eine zu den von mit sich auf für im dem "
    "le la les de des et en un une du est que qui dans pour pas sur au "
    "el los las del y por con una se al lo como más".split()
)
LABELLERS = ("symbols", "capitals", "variety", "runs", "line_ends", "line_copies", "stop_words", "word_length")


def shape(text: str | None, words: list[str], counts: Counter) -> dict[str, float]:
    """Figures that labellers and shape features read."""
    text = text or ""
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words)) or 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    return {
        "n": n,
        "symbols": sum(map(len, _SYMBOLS.findall(text))) / letters,
        "shouts": text.count("!") / max(1, n),
        "capitals": sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / max(1, n),
        "variety": len(counts) / max(1, n) ** 0.75,
        "runs": same / max(1, n - 1),
        "ends": sum(x.rstrip()[-1] in ".!?…:;\"'»”" for x in lines) / max(1, len(lines)),
        "copies": 1 - len(set(lines)) / max(1, len(lines)),
        "bars": text.count("|") / max(1, n),
        "stop": sum(c for w, c in counts.items() if w.lower().strip(".,") in _STOP) / max(1, n),
        "length": letters / max(1, n),
    }


def votes(s: dict[str, float]) -> list[int]:
    """Votes of :data:`LABELLERS` on a text's figures; a text without words gets bad votes only."""
    if not s["n"]:
        return [-1] * len(LABELLERS)
    few = s["n"] < 20
    return [
        -1 if s["symbols"] > 0.05 else 1 if s["symbols"] < 0.01 else 0,
        -1 if s["capitals"] > 0.3 or s["shouts"] > 0.3 else 1 if s["capitals"] < 0.1 and s["shouts"] < 0.1 else 0,
        0 if few else -1 if s["variety"] < 0.35 else 1 if s["variety"] > 0.9 else 0,
        0 if few else -1 if s["runs"] > 0.1 else 1 if s["runs"] < 0.03 else 0,
        -1 if s["ends"] < 0.3 and s["bars"] > 0.1 else 1 if s["ends"] > 0.7 else 0,
        -1 if s["copies"] > 0.4 else 1 if s["copies"] < 0.1 else 0,
        0 if few else -1 if s["stop"] < 0.01 else 1 if s["stop"] > 0.05 else 0,
        -1 if s["length"] > 15 or s["length"] < 2 else 1 if 3 <= s["length"] <= 10 else 0,
    ]


def _shape_words(s: dict[str, float]) -> list[str]:
    """Shape figures as words that no text has (they hold a space)."""
    out = [f"{k} {int(min(9, 10 * s[k]))}" for k in ("capitals", "runs", "ends", "copies")]
    out += [f"{k} {int(min(9, 20 * s[k]))}" for k in ("symbols", "shouts", "bars", "stop")]
    return [*out, f"size {min(12, int(s['n']).bit_length())}", f"variety {int(min(9, 4 * s['variety']))}", f"length {int(min(16, s['length']))}"]


def _read(text: str | None) -> tuple[Counter, dict[str, float]]:
    words = (text or "").split()
    counts = Counter(words)
    return counts, shape(text, words, counts)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: the posterior of good for each, and each labeller's accuracy where it votes.

    Labellers are taken as independent given the class, and where one votes as saying nothing about it.  It starts from the mean vote, which says which class is good.
    """
    if not len(patterns):
        return np.zeros(0), np.zeros(0)
    total = counts.sum()
    post = np.clip(0.5 + 0.5 * patterns.mean(1), 0.05, 0.95)
    onehot = np.stack([patterns == v for v in (-1, 1)], 2).astype(float)  # pattern, labeller, vote
    for _ in range(rounds):
        prior = np.clip((counts * post).sum() / total, 0.01, 0.99)
        rate = []
        for p in (1 - post, post):
            m = np.einsum("p,plv->lv", counts * p, onehot) + 0.5
            rate.append(m / m.sum(1, keepdims=True))
        bad, good = (np.einsum("plv,lv->p", onehot, np.log(r)) for r in rate)
        new = sigmoid(np.log(prior / (1 - prior)) + good - bad)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    right = np.einsum("p,pl->l", counts * post, onehot[:, :, 1]) + np.einsum("p,pl->l", counts * (1 - post), onehot[:, :, 0])
    voted = np.einsum("p,pl->l", counts, onehot[:, :, 0] + onehot[:, :, 1])
    return post, right / np.maximum(1, voted)


@dataclass
class QualityModel:
    places: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    #: Posterior of good by code of votes.
    posteriors: dict[int, float]

    def labellers(self) -> dict[str, float]:
        """Each labeller's estimated accuracy where it votes."""
        return dict(zip(LABELLERS, self.accuracies.tolist()))


def _code(v: list[int]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def _pattern(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(len(LABELLERS))]


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Votes are counted over all of ``docs`` (doc_id, text); the scorer learns from the ``rows`` different (doc_id, text)
    that come first in a seeded order, each once however often it is repeated.  An empty table gives a model that scores
    0.5."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vote(batches):
        for b in batches:
            yield {"code": [_code(votes(_read(t)[1])) for t in b["text"].to_pylist()]}

    found = in_arrow(slim.select("text"), vote, "code int").groupBy("code").count().orderBy("code").collect()  # <= 3**8 rows
    codes = np.array([r[0] for r in found], np.int64)
    counts = np.array([r[1] for r in found], float)
    post, accuracies = estimate(np.array([_pattern(c) for c in codes]).reshape(-1, len(LABELLERS)), counts)
    if not len(codes):
        return QualityModel(np.zeros(0, np.int64), np.zeros(0), 0.0, accuracies, {})
    of = dict(zip(codes.tolist(), post.tolist()))
    place = F.struct(uniform(F.col("doc_id"), F.length("text"), seed=SEED).alias("at"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie")).alias("place")
    # a share of the keys that leaves somewhat more than enough, or all where many rows share a key
    share = min(1.0, 1.5 * rows / counts.sum() + 1e-3)
    first = None
    for most in (int(share * 2**60), 2**60):
        if first is None or first.count() < rows:
            keys = slim.select(place).where(F.col("place.at") <= most).distinct()
            first = checkpointed(keys.orderBy("place").limit(rows))  # bounded, so it may be broadcast
    placed = slim.select(place, "text").join(F.broadcast(first), "place")
    picked = placed.groupBy("place").agg(F.first("text").alias("text"))  # rows alike in their place have the same text

    def read(batches):
        for b in batches:
            got = [_read(t) for t in b["text"].to_pylist()]
            yield {"at": b["at"], "tie": b["tie"], "target": [of.get(_code(votes(s)), 0.5) for _, s in got], "words": [[*c, *_shape_words(s)] for c, s in got], "counts": [[*c.values(), *[0] * 11] for c, _ in got]}

    sample = in_arrow(picked.select("place.at", "place.tie", "text"), read, "at long, tie string, target double, words array<string>, counts array<int>")
    got = sample.orderBy("at", "tie").toArrow().combine_chunks()  # at most ``rows``
    lists = got["words"].combine_chunks()
    names = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy()
    doc = np.repeat(np.arange(len(lists)), sizes)
    n = got["counts"].combine_chunks().flatten().to_numpy().astype(float)
    whole = np.bincount(doc, n, len(lists))
    value = np.where(n > 0, 4 * n / np.maximum(SHORT, whole)[doc], 1.0)
    target = got["target"].to_numpy()
    design = Design(names.dictionary.to_pylist(), doc, names.indices.to_numpy(), value, len(lists))
    design.select(target, 10)

    def loss(score, extra):
        g = sigmoid(score + extra[0]) - target
        return g, np.array([g.sum()])

    share_good = np.clip(target.mean(), 0.01, 0.99)
    w, extra = fit(design, loss, np.array([np.log(share_good / (1 - share_good))]))
    return QualityModel(design.used[w != 0], w[w != 0], float(extra[0]), accuracies, of)


def _rater(model: QualityModel):
    scorer = Scorer(model.places, model.weights)

    def rate(texts: list[str | None]) -> tuple[list[float], list[float]]:
        out, weak = [], []
        word = scorer.word
        for t in texts:
            counts, s = _read(t)
            total = sum([n * x for w, n in counts.items() if (x := word(w))]) * 4 / max(SHORT, s["n"])
            out.append(float(sigmoid(model.bias + total + sum(map(word, _shape_words(s))))))
            weak.append(model.posteriors.get(_code(votes(s)), 0.5))
        return out, weak

    return rate


def scored(docs: DataFrame, model: QualityModel, keep: float = KEEP) -> DataFrame:
    """(doc_id, weak_label, quality, kept) for each row of ``docs`` (doc_id, text; others are ignored): the posterior of
    its votes (0.5 for votes that the fit has not met) and the scorer's probability of a good text, which decides.  Null
    and empty texts are scored by their shape alone; repeated rows one by one."""

    def run(batches):
        rate = _rater(model)
        for b in batches:
            got, weak = rate(b["text"].to_pylist())
            yield {"doc_id": b["doc_id"], "weak_label": weak, "quality": got, "kept": [x >= keep for x in got]}

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, weak_label double, quality double, kept boolean")


def kept_documents(docs: DataFrame, model: QualityModel, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`scored` keeps."""
    import pyarrow as pa

    def run(batches):
        rate = _rater(model)
        for b in batches:
            got, _ = rate(b.column(b.schema.get_field_index("text")).cast(pa.string()).to_pylist())
            yield b.filter(pa.array([x >= keep for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
