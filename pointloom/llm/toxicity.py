"""Toxicity by weak supervision.

Many weak voters each say "toxic" or nothing: lexicon voters (a short list of
insults; words and word beginnings, once or twice in a text, that labelled
training documents bring up; word beginnings of which many different words
occur in toxic documents and few in others, in whatever language) and pattern
voters (shouting, repeated marks, direct address). A generative label model
over all their votes estimates, by expectation maximisation, how often each
voter fires on toxic and on other documents (its accuracy), and from the
residuals how strongly voters correlate. Voters that correlate are one family:
the model holds how many of a family fire on each class, so that a family
speaks once, however many voters repeat each other. The posterior labels then
train a linear classifier over terms of the text, which alone scores.

Training takes at most ``max_docs`` labelled documents, chosen by hash of
their id; scoring covers all documents and whole texts.

Defined cases: null and empty texts have no terms and get the classifier's
lowest evidence, its bias; labels that are null or on missing documents are
ignored; several labels of one id count as the largest; without two classes
to learn from, every score is the smoothed share of label 1; repeated rows get
equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import BoundedCache, documents
from .labelled import score_documents, training_rows

#: Plain insults, fixed values.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "hate", "kill", "shut", "ugly", "liar")
#: What each pattern voter looks for.
PATTERNS = (
    r"!{2,}",
    r"\?{2,}",
    r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}",
    r"(?i)\byou(?:'re| are)\b",
    r"(?i)\b(?:shut up|get lost|go away)\b",
    r"[#*$%&]{3,}",
    r"(\w)\1{3,}",
)


#: Marks a term that a text has at least twice.
TWICE = "2*"


@dataclass(frozen=True)
class ToxicitySettings:
    max_docs: int = 4000
    shortest: int = 3
    longest: int = 8
    least_documents: int = 4
    precision: float = 0.5
    margin: float = 3.0
    nested_margin: float = 0.0
    lexicon_voters: int = 80
    related: float = 0.2
    rounds: int = 40
    terms: int = 400
    penalty: float = 0.1
    steps: int = 250


def bare_word(word: str) -> str:
    return word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def terms_of_word(word: str, s: ToxicitySettings) -> tuple[str, ...]:
    """A word without marks around it in lower case, and its beginnings (marked by a dash)."""
    bare = bare_word(word)
    if not bare:
        return ()
    return (bare, *[f"{bare[:n]}-" for n in range(s.shortest, min(s.longest, len(bare) - 1) + 1)])


def terms_of(text: str, words: BoundedCache) -> set[str]:
    """The text's terms, and those it has at least twice once more with a mark."""
    once: set[str] = set()
    twice: set[str] = set()
    for word, n in Counter(text.split()).items():
        found = words[word]
        if n > 1:
            twice.update(found)
        else:
            twice.update(once.intersection(found))
        once.update(found)
    return once | {TWICE + t for t in twice}


def evidence_for(toxic: float, other: float, share: float) -> float:
    """Log-likelihood ratio of a term's documents being toxic at their own rate against at the general ``share``; 0 if theirs is lower."""
    own = (toxic + 0.5) / (toxic + other + 1)
    if own <= share:
        return 0.0
    return toxic * math.log(own / share) + other * math.log((1 - own) / (1 - share))


def telling_beginnings(texts: list[str], labels: np.ndarray, s: ToxicitySettings) -> dict[str, float]:
    """Word beginnings with the evidence of how many different words with them toxic and other documents have.

    Copies of a document add no words, and a few documents can show many, so
    this finds vocabularies of languages with few labelled documents.
    """
    words: tuple[set[str], set[str]] = (set(), set())
    for text, y in zip(texts, labels, strict=True):
        words[int(y)].update(w for w in map(bare_word, text.split()) if len(w) > s.shortest)
    counts = [Counter(t for w in side for t in terms_of_word(w, s)[1:]) for side in words]
    share = (len(words[1]) + 1) / (len(words[0]) + len(words[1]) + 2)
    least = math.log(len(counts[1]) + 1) + s.nested_margin  # beginnings nest, so these are far fewer trials than beginnings
    found = {t: evidence_for(n, counts[0][t], share) for t, n in counts[1].items() if n >= s.least_documents and n > counts[0][t]}
    return {t: e for t, e in found.items() if e >= least}


def mine_lexicon(terms: list[set[str]], labels: np.ndarray, beginnings: dict[str, float], s: ToxicitySettings) -> list[str]:
    """Terms that training documents bring up as toxic, the strongest first; of nested terms one.

    A term must show more than the best of so many tried would show by
    chance, by its documents or by its words (``beginnings``).
    """
    common = set().union(*terms)
    toxic = Counter(t for found, y in zip(terms, labels, strict=True) if y for t in found)
    other = Counter(t for found, y in zip(terms, labels, strict=True) if not y for t in found if t in toxic)
    share, least = float(np.mean(labels)), math.log(len(toxic) + 1) + s.margin
    strength = {t: evidence_for(n, other[t], share) for t, n in toxic.items() if n >= s.least_documents and (n + 0.5) / (n + other[t] + 1) >= s.precision}
    strength = {t: e for t, e in strength.items() if e >= least}
    for t, e in [*beginnings.items(), *[(t.removeprefix(TWICE), e) for t, e in strength.items()]]:
        for term in (t, TWICE + t):
            if term in common:
                strength[term] = max(e, strength.get(term, 0.0))
    return strongest(list(strength), strength)[: s.lexicon_voters]


def _nested(a: str, b: str) -> bool:
    """Whether one of two terms, as often asked for, is a beginning of the other."""
    if a.startswith(TWICE) != b.startswith(TWICE):
        return False
    return a.endswith("-") and b.startswith(a[:-1]) or b.endswith("-") and a.startswith(b[:-1])


def strongest(terms: list[str], strength: dict[str, float]) -> list[str]:
    """The terms by strength, of nested ones only the strongest (of equals the longest)."""
    kept: list[str] = []
    for term in sorted(terms, key=lambda t: (-round(strength[t], 6), -len(t.removesuffix("-")), t)):
        if not any(_nested(term, other) for other in kept):
            kept.append(term)
    return kept


#: How many voters of a family fire: none, one, two, three or more.
LEVELS = 4
#: Least log-odds of class 1 where two voters of a lexicon family fire.
AGREED = 1.0


@dataclass
class LabelModel:
    """Per class the chance of each voter to fire (2 x voters); what each level of each family says (families x LEVELS) as log-odds; log-odds of class 1.

    ``families`` numbers each voter's family. Families are independent given
    the class; within one, only the number of firing voters counts. A silent
    family abstains: its voters speak one language, so silence says nothing.
    """

    fires: np.ndarray
    families: np.ndarray
    says: np.ndarray
    prior: float
    correlations: np.ndarray

    @staticmethod
    def counted(votes: np.ndarray, families: np.ndarray) -> np.ndarray:
        """Level of each family on each document."""
        member = np.zeros((len(families), families.max(initial=-1) + 1))
        member[np.arange(len(families)), families] = 1
        return np.minimum(votes @ member, LEVELS - 1).astype(np.int64)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        level = self.counted(votes, self.families)
        return _chance(self.prior + self.says[np.arange(level.shape[1]), level].sum(1))

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, share: float, expected: np.ndarray, strength: np.ndarray, rounds: int, related: float = 0.2) -> LabelModel:
        """Expectation maximisation from the soft labels ``start``; no label is used after that but the ``share`` of class 1.

        ``expected`` (2 x voters) are rates that each voter is expected to
        fire at, worth ``strength`` documents: they keep the classes from
        turning into whatever else splits the documents. How many voters of
        a family fire on class 1 is left open where they are expected to
        tell the classes apart.
        """
        belief, model = start, None
        told = (expected[0] == expected[1]) & (expected[0] > 0)  # voters of which nothing is expected
        for _ in range(rounds):
            split = np.stack([1 - belief, belief])
            fires = np.clip((split @ votes + strength * expected) / (split.sum(1, keepdims=True) + strength), 1e-6, 1 - 1e-6)
            residual = votes - split.T @ fires
            scale = np.sqrt((residual**2).mean(0)) + 1e-9
            correlations = (residual.T @ residual) / len(votes) / np.outer(scale, scale)
            np.fill_diagonal(correlations, 0)
            families = _groups(correlations > related)
            level = cls.counted(votes, families)
            says = np.zeros((level.shape[1], LEVELS))
            for f in range(level.shape[1]):
                own = np.flatnonzero(families == f)
                seen = np.stack([np.bincount(level[:, f], weights, LEVELS) for weights in split])
                some = 1 - np.prod(1 - np.clip(expected[:, own], 0, 0.9), axis=1)  # independent voters would give this
                guess = np.stack([1 - some, *[some * part for part in (0.5, 0.3, 0.2)]], axis=1)
                guess[1] = guess[1] if told[own].all() else 1 / LEVELS
                worth = np.array([strength[own].mean(), strength[own].mean() if told[own].all() else 2.0])[:, None]
                chance = (seen + worth * guess + 1e-3) / (split.sum(1)[:, None] + worth + LEVELS * 1e-3)
                says[f, 1:] = np.log(chance[1, 1:] / chance[0, 1:])
                if not told[own].all():  # lexicon voters are no worse than chance, and two of them right more often than wrong
                    says[f, 1:] = np.maximum(says[f, 1:], [0.0, *[AGREED - math.log(share / (1 - share))] * (LEVELS - 2)])
            model = cls(fires, families, says, 0.0, correlations)
            low, high = -60.0, 60.0  # the log-odds that meet the share
            for _ in range(50):
                model.prior = (low + high) / 2
                low, high = (model.prior, high) if model.posterior(votes).mean() < share else (low, model.prior)
            belief = model.posterior(votes)
        return model


def _groups(linked: np.ndarray) -> np.ndarray:
    """Number of each row's connected group, from 0."""
    group = np.arange(len(linked))
    while True:
        low = np.where(linked, group[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(group, low)
        new = new[new]
        if (new == group).all():
            return np.unique(group, return_inverse=True)[1]
        group = new


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def agreements(found: set[str], families: dict[str, int]) -> list[tuple[int, int]]:
    """(family, n) for each n up to how many of the family's terms a text has, at most LEVELS - 1."""
    counts = Counter(families[t] for t in found if t in families)
    return [(f, k) for f, n in counts.items() for k in range(1, min(n, LEVELS - 1) + 1)]


class ToxicityModel:
    """A linear classifier over terms, and over how many terms of a lexicon family agree, trained on the label model's posterior."""

    def __init__(self, settings: ToxicitySettings, weights: dict, bias: float, families: dict[str, int] | None = None):
        self.settings, self.weights, self.bias, self.families = settings, weights, bias, families or {}
        self._words = BoundedCache(self._known)

    def __getstate__(self):
        return {"settings": self.settings, "weights": self.weights, "bias": self.bias, "families": self.families}

    def __setstate__(self, state):
        self.__init__(**state)

    def _known(self, word: str) -> tuple[str, ...]:
        used = lambda t: t in self.weights or t in self.families
        return tuple(t for t in terms_of_word(word, self.settings) if used(t) or used(TWICE + t))

    def score(self, text: str) -> float:
        found = terms_of(text, self._words)
        logit = self.bias + sum(self.weights.get(t, 0.0) for t in [*found, *agreements(found, self.families)])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))

    def score_many(self, texts: list[str]) -> list[float]:
        return [self.score(t) for t in texts]

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
        y = np.array(labels, np.float64)
        if len(set(labels)) < 2:
            share = (y.sum() + 1) / (len(y) + 2)
            return cls(settings, {}, float(np.log(share / (1 - share))))
        words = BoundedCache(lambda w: terms_of_word(w, settings), 50_000)
        documents_with: Counter = Counter()
        for text in texts:
            documents_with.update(terms_of(text, words))
        beginnings = telling_beginnings(texts, y, settings)
        common = {t: t for t, n in documents_with.items() if n >= settings.least_documents or t in INSULTS or t.removeprefix(TWICE) in beginnings}
        del documents_with  # most terms occur once
        terms = [{common[t] for t in terms_of(text, words) if t in common} for text in texts]
        lexicon = list(dict.fromkeys([*mine_lexicon(terms, y, beginnings, settings), *INSULTS]))
        patterns = [re.compile(p) for p in PATTERNS]
        votes = np.array([[*(t in found for t in lexicon), *(p.search(text) is not None for p in patterns)] for text, found in zip(texts, terms, strict=True)], np.float64)
        # lexicon hits are the first guess; labels only chose the lexicon and set the share
        hits = votes[:, : len(lexicon)].any(1)
        rate, many = votes.mean(0), len(votes)
        # a lexicon voter is expected to fire on one other document in a thousand at most; of a pattern nothing is expected
        own = np.arange(votes.shape[1]) < len(lexicon)
        expected = np.stack([np.where(own, np.minimum(rate * 0.02, 1e-3), rate), np.where(own, np.maximum(rate / max(y.mean(), 1e-3), 0.01).clip(0, 0.9), rate)])
        strength = np.where(own, 0.05 * many, 0.5 * many)
        labeller = LabelModel.fit(votes, np.where(hits, 0.9, 0.1 * y.mean()), float(y.mean()), expected, strength, settings.rounds, settings.related)
        families = {t: int(f) for t, f in zip(lexicon, labeller.families, strict=False)}
        return cls._linear(terms, labeller.posterior(votes), families, settings)

    @classmethod
    def _linear(cls, terms: list[set[str]], belief: np.ndarray, families: dict[str, int], s: ToxicitySettings) -> ToxicityModel:
        """Logistic regression on presence, soft labels, by accelerated gradient steps with an L2 penalty."""
        weight: Counter = Counter()
        seen: Counter = Counter()
        for found, b in zip(terms, belief, strict=True):
            seen.update(found)
            for t in found:
                weight[t] += b
        mean = belief.mean()
        lift = {t: evidence_for(weight[t], n - weight[t], mean) for t, n in seen.items() if n >= s.least_documents and weight[t] >= 0.5 * n}
        best = [t for t in lift if lift[t] >= math.log(len(seen) + 1) + s.margin]
        chosen = strongest([*best, *(t for t in families if seen[t] and t not in best)], Counter(lift))[: s.terms]
        agreed = [agreements(found, families) for found in terms]
        chosen += sorted(set().union(*agreed))
        column = {t: k for k, t in enumerate(chosen)}
        x = np.zeros((len(terms), len(chosen) + 1))
        x[:, -1] = 1
        for row, (found, levels) in enumerate(zip(terms, agreed, strict=True)):
            x[row, [column[t] for t in [*found, *levels] if t in column]] = 1
        solution = np.zeros(x.shape[1])
        solution[-1] = math.log(mean / (1 - mean))
        ridge = np.full(x.shape[1], s.penalty)
        ridge[-1] = 0
        # gradient steps of the size that the curvature bound allows, with momentum
        size = np.sqrt((x**2).sum(1)).mean() ** 2 * len(x) / 4 + s.penalty
        ahead, speed = solution.copy(), 1.0
        for _ in range(s.steps):
            new = ahead + (x.T @ (belief - _chance(x @ ahead)) - ridge * ahead) / size
            next_speed = (1 + math.sqrt(1 + 4 * speed**2)) / 2
            ahead = new + (speed - 1) / next_speed * (new - solution)
            solution, speed = new, next_speed
        return cls(s, {t: float(v) for t, v in zip(chosen, solution, strict=False)}, float(solution[-1]), families)


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ToxicitySettings()
    docs = documents(spark, sf_dir)
    rows = training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 4, 2, settings.max_docs)
    model = ToxicityModel.fit([t for t, _ in rows], [y for _, y in rows], settings)
    return score_documents(docs, model, 4, 2)
