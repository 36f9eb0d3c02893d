"""Toxicity by weak supervision.

Voters are lexicons (words, and stems that stand for all words beginning with them) and patterns. A small general lexicon is
given; further words and stems are proposed from a bounded sample of labelled rows, as those much more frequent in toxic texts.
A generative label model then estimates, from the votes alone, how often each voter fires on toxic and on clean texts and the pairwise correlations of voters within a class, by expectation maximisation; the labels are no vote and no start of it.
Its posteriors, not the labels, train a linear classifier on the votes, which scores every text in one pass over its words. Labels
come in for choosing voters and for calibration: the share of toxic texts, and a last shift of the classifier's bias to where it agrees best with the sample.

Bounds: the sample is ``SAMPLE`` labelled rows and ``SAMPLE_CHARS`` code points at most, chosen by hash of their ids, and is fitted on
the driver; voters are at most ``VOTERS``. Everything else covers all rows. Inputs of a score are the text only.

Cases: a null text counts as empty and scores the classifier's bias; without enough labels of both kinds (or any: empty tables) the
given lexicon is used with fixed weights; labels of null ids or null label are not used; an id that is labelled repeatedly has
its greatest label; of documents that share an id one is learnt from (the least by hash of the text), and each has its own
score; a text longer than what is left of ``SAMPLE_CHARS`` is not learnt from but scored whole; ties among proposals go by
spelling; an empty table gives no rows; extra columns stay, but a column named as the score is an error.
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

from relweave.llm.common import new_column, written

SAMPLE, SAMPLE_CHARS, VOTERS = 6_000, 64_000_000, 64
#: Given lexicons, fixed values: several families a language, each a voter.
LEXICONS = {
    "stupidity": ["idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumb"],
    "contempt": ["loser", "losers", "clown", "pathetic", "worthless"],
    "filth": ["scum", "trash", "garbage", "disgusting", "vermin", "filth"],
    "hostility": ["hate", "hateful", "despise", "loathe", "kill", "die", "destroy"],
    "stupidity, German": ["dumm", "dummkopf", "trottel"],
    "contempt, German": ["abschaum", "widerlich", "wertlos", "arschloch"],
    "stupidity, French": ["imbécile", "stupide", "crétin"],
    "contempt, French": ["connard", "ordure", "pathétique", "dégoûtant"],
    "stupidity, Spanish": ["idiota", "imbécil", "estúpido"],
    "contempt, Spanish": ["basura", "escoria", "patético", "asqueroso", "inútil"],
}
PATTERNS = {"shouting": r"\b[A-Z]{4,}(?: [A-Z]{4,}){2,}", "exclamation": r"!{2,}", "second person": r"(?i)\byou(?:'re| are) (?:an? |so |such )"}
TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
_CACHE = 300_000


def features(text: str) -> set[str]:
    """Words, and stems marked with an asterisk."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


@dataclass
class Model:
    """Voters (words, stems, lexicon names by word; patterns) and the classifier's weights, bias last."""

    by_feature: dict[str, int]
    patterns: list[str]
    n: int
    weights: np.ndarray

    def votes(self, texts: list[str]) -> np.ndarray:
        """Row per text: for each voter whether it fires, and how many lexicon voters do (logarithm)."""
        if not hasattr(self, "cache"):
            self.cache, self.compiled = {}, [re.compile(p) for p in self.patterns]
        cache, known = self.cache, self.by_feature
        out = np.zeros((len(texts), self.n + 1), np.float64)
        lexical = self.n - len(self.patterns)
        for i, text in enumerate(texts):
            if not text:
                continue
            for w in set(TOKEN.findall(text.lower())):
                hit = cache.get(w)
                if hit is None:
                    if len(cache) > _CACHE:
                        cache.clear()
                    hit = cache[w] = tuple({known[f] for f in (w, *(w[:n] + "*" for n in STEMS if len(w) >= n)) if f in known})
                if hit:
                    out[i, list(hit)] = 1
            for j, p in enumerate(self.compiled, lexical):
                out[i, j] = p.search(text) is not None
            out[i, self.n] = np.log1p(out[i, :lexical].sum())
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.votes(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "compiled")}


def propose(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words and stems much more frequent in toxic texts, the strongest first; none begins another. Copies count once."""
    texts, toxic = list(dict(zip(texts, toxic, strict=True))), np.array(list(dict(zip(texts, toxic, strict=True)).values()), dtype=bool)
    bad, good = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        (bad if y else good).update(features(t))
    nb, ng = int(toxic.sum()), int((~toxic).sum())
    lift = {f: np.log((c + 0.5) / (nb + 1)) - np.log((good[f] + 0.5) / (ng + 1)) for f, c in bad.items() if c >= max(5, 0.015 * nb)}
    found: list[str] = []
    for f in sorted((f for f, x in lift.items() if x >= 2.5), key=lambda f: (-bad[f] * lift[f], f)):
        if not any(f.startswith(g.rstrip("*")) or g.startswith(f.rstrip("*")) for g in found):
            found.append(f)
        if len(found) == VOTERS:
            break
    return found


@dataclass
class LabelModel:
    """Rates of firing on the positive class and on the other, correlations within classes, the positive share, and posteriors."""

    fires: np.ndarray
    false: np.ndarray
    corr: np.ndarray
    prior: float
    posterior: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """How often each voter is right."""
        return self.prior * self.fires + (1 - self.prior) * (1 - self.false)


def label_model(votes: np.ndarray, balance: float, rounds: int = 50) -> LabelModel:
    """Fits the generative model to votes (0 or 1 per voter; voting means positive), without labels but for the class balance.

    Rates by class are re-estimated in turn with posteriors. Pairwise correlations within classes are those of what the rates leave
    over, where they stand out from chance; evidence is weighed by the inverse of their matrix, by which voters that say the same
    thing, or know the same language, count less. What they share is told apart from the class only in part, as classes follow it too. It
    begins with the texts for which two voters fire.
    """
    (n, m), prior = votes.shape, float(np.clip(balance, 0.001, 0.999))
    p = 1 / (1 + np.exp(-2.0 * (votes.sum(axis=1) - 1.5)))
    corr = np.eye(m)
    for _ in range(rounds):
        fires, false = (p @ votes + 0.5) / (p.sum() + 1), ((1 - p) @ votes + 0.5) / ((1 - p).sum() + 1)
        rest = votes - np.outer(p, fires) - np.outer(1 - p, false)
        cov = rest.T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), -1, 1)
        corr = np.where(np.abs(corr) > 4 / np.sqrt(n), corr, 0.0)
        np.fill_diagonal(corr, 1.0)
        share = np.clip(np.linalg.solve(corr + 0.1 * np.eye(m), np.full(m, 1.1)), 0.05, 1.0)
        evidence = (votes * np.log(fires / false) + (1 - votes) * np.log((1 - fires) / (1 - false))) @ share
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-6:
            break
    return LabelModel(fires, false, corr, prior, p)


def linear(x: np.ndarray, p: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; bias last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, l2), 1e-3)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (p - q) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    given = {w: i for i, ws in reversed(list(enumerate(LEXICONS.values()))) for w in ws}
    enough = toxic.sum() >= 10 and (~toxic).sum() >= 10
    found = propose(texts, toxic) if enough else []
    by_feature = given | {f: i for i, f in enumerate(found, len(LEXICONS))}
    model = Model(by_feature, list(PATTERNS.values()), len(LEXICONS) + len(found) + len(PATTERNS), np.zeros(0))
    if not enough:
        model.weights = np.append(np.zeros(model.n), [5.0, -3.0])
        return model
    x = model.votes(texts)
    model.weights = linear(x, label_model(x[:, :-1], toxic.mean()).posterior)
    model.weights[-1] += shift(x @ model.weights[:-1] + model.weights[-1], toxic)
    return model


def shift(scores: np.ndarray, toxic: np.ndarray) -> float:
    """What to add to the scores so that their sign agrees with the most labels; nothing, if that is as good."""
    order = np.argsort(-scores)
    s, y = scores[order], toxic[order]
    right = np.concatenate([[0], np.cumsum(np.where(y, 1, -1))])  # with the first so many called toxic, beside a constant
    cut = np.concatenate([[s[0] + 1], (s[:-1] + s[1:]) / 2, [s[-1] - 1]])
    right[1:-1][s[:-1] == s[1:]] = -len(s)
    best = np.flatnonzero(right == right.max())
    if right[np.searchsorted(-s, 0.0)] == right.max():
        return 0.0
    return float(-cut[best[np.argmin(np.abs(cut[best]))]])


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fits on at most ``sample`` labelled rows that aren't held out, of ``chars`` code points together at most."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = usable.groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col(label_col) == 1).alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(sample)
    # At most ``sample`` narrow rows, so a broadcast of bounded size.
    found = docs.select(F.col(id_col).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), F.col("did") == F.col("lid"))
    found = written(found.groupBy("lid", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")), "toxicity-sample")
    sizes = found.select("lid", F.length("t").alias("n")).orderBy(F.xxhash64("lid"), "lid").toPandas()
    inside = sizes[sizes["n"].cumsum() <= chars]["lid"].tolist()
    rows = found.where(F.col("lid").isin(inside)).orderBy("lid").toPandas()
    return fit(rows["t"].tolist(), rows["y"].to_numpy(dtype=bool))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """The rows of docs with a column ``into`` from 0 to 1."""
    new_column(docs, into)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(list(texts)), dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(into, F.pandas_udf(run, "double").asNondeterministic()(F.col(text_col)))
