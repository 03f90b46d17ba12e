"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults, patterns, and words and word
beginnings that the labelled rows show to be telling. A generative model of the
votes estimates how often each voter speaks on toxic and on
clean texts and which voters speak together, given a prior belief from the
labelled rows; its posterior labels then train a linear classifier, which scores
every text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold, in_batches, settle, text_bytes

FOLDS = 5
# Bounds: labelled rows of each class that are learned from, voters found there.
SAMPLE = 4000
FOUND_VOTERS = 300
# Log-likelihood ratio from which a word is a voter: about one in a million by chance.
LEAST_RATIO = 25.0
# Texts that independence of a voter from its parent counts for, beside those seen.
INDEPENDENT = 20.0
# Share of a text's words from which a term is looked at.
LEAST_SHARE = 0.005
BEGINNINGS = range(3, 8)
LONGEST = 40

# Everyday insults, by what they aim at. Words that also stand in clean texts of one of
# the languages ("die", "rat", "joke") are left to what the labelled rows show.
LEXICONS = {
    "mind": "idiot idiots moron morons stupid dumb imbecile cretin halfwit dimwit brainless",
    "worth": "loser losers worthless pathetic",
    "filth": "scum filthy vermin disgusting disgrace",
    "mockery": "crybaby wimp",
    "hate": "despise exterminate",
    "de": "idiot dummkopf blöd trottel abschaum widerlich erbärmlich wertlos",
    "fr": "idiot imbécile stupide crétin débile minable ordure dégoûtant pathétique",
    "es": "idiota imbécil estúpido estúpida escoria asqueroso patético payaso",
}
PATTERNS = ("shouting", "exclaiming", "you_insult", "silence")
SHOUT = re.compile(rb"[A-Z]{3,}")
LETTERS = re.compile(r"[^\W\d_]+")
YOU = {b"you", b"your", b"du", b"ihr", b"tu", b"vous", b"eres", b"usted"}


@dataclass
class Voters:
    """Which voters speak on a word. Voter numbers: lexicons, patterns, then terms."""

    terms: list[str]
    of_word: dict[str, tuple[int, ...]] = field(default_factory=dict)
    of_beginning: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        at: dict[str, list[int]] = {}
        for i, words in enumerate(LEXICONS.values()):
            for word in words.split():
                at.setdefault(word, []).append(i)
        first = len(LEXICONS) + len(PATTERNS)
        for i, term in enumerate(self.terms, first):
            if term.endswith("*"):
                self.of_beginning[term[:-1]] = i
            else:
                at.setdefault(term, []).append(i)
        self.of_word = {w: tuple(v) for w, v in at.items()}
        self.size = first + len(self.terms)


class WordVotes(dict):
    """Voters of each word as it stands in a text; a bounded memory."""

    def __init__(self, voters: Voters, limit: int = 400_000):
        super().__init__()
        self.voters, self.limit = voters, limit

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        found: list[int] = []
        for word in LETTERS.findall(token.decode("utf-8", "replace").lower()):
            found += self.voters.of_word.get(word, ())
            for n in BEGINNINGS:
                voter = self.voters.of_beginning.get(word[:n]) if len(word) >= n else None
                if voter is not None:
                    found.append(voter)
        if len(self) >= self.limit:
            self.clear()
        votes = tuple(found)
        if len(token) < 100:
            self[token] = votes
        return votes


def count_votes(text: bytes, votes: WordVotes) -> dict[int, float]:
    """How many of a hundred words of a text each voter names; patterns: 100 or none.

    The first word with a telling beginning does not count: it may stand there by chance.
    """
    tokens = text.lower().split()
    spoken = list(map(votes.__getitem__, tokens))
    counts = Counter(v for own in filter(None, spoken) for v in own)
    first = len(LEXICONS)
    words = max(1, len(tokens))
    if len(SHOUT.findall(text)) > 0.5 * words:
        counts[first] = words
    if text.count(b"!") > 0.3 * words:
        counts[first + 1] = words
    insulted = sum(
        1
        for i, own in enumerate(spoken)
        if own and own[0] < first and any(t in YOU for t in tokens[max(0, i - 4) : i])
    )
    if insulted:
        counts[first + 2] = insulted
    for voter in votes.voters.of_beginning.values():
        if voter in counts:
            counts[voter] -= 1
    return {v: 100 * n / words for v, n in counts.items() if n}


SILENCE = len(LEXICONS) + PATTERNS.index("silence")


# Words in a hundred from which a voter may speak; each voter's is learned.
SHARES = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5)


def with_silence(counts: dict[int, float], least: dict[int, float]) -> dict[int, float]:
    """The votes of telling voters that reach their share, or that of silence where
    none of them does."""
    return {v: n for v, n in counts.items() if v in least and n >= least[v]} or {SILENCE: 1.0}


def log_ratio(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Twice the log-likelihood ratio of what ``bad`` toxic and ``good`` clean texts show
    against one rate on both."""
    total = 0
    for seen, n in ((bad, n_bad), (good, n_good)):
        for part, rate in ((seen, (bad + good) / (n_bad + n_good)), (n - seen, 1 - (bad + good) / (n_bad + n_good))):
            with np.errstate(divide="ignore", invalid="ignore"):
                total = total + np.where(part > 0, part * np.log(part / (n * rate)), 0.0)
    return 2 * total


def learned_shares(counts: np.ndarray, toxic: np.ndarray) -> dict[int, float]:
    """The share from which each telling voter speaks: where it tells the labelled texts
    apart best. A voter whose texts are not likelier toxic than others has none."""
    bad, good = counts[toxic == 1], counts[toxic == 0]
    least: dict[int, float] = {}
    best = np.zeros(counts.shape[1])
    for share in SHARES:
        spoke = [(own > 0) & (own >= share) for own in (bad, good)]
        sums = [own.sum(axis=0) for own in spoke]
        ratio = log_ratio(*sums, len(bad), len(good))
        more = sums[0] * len(good) > sums[1] * len(bad)
        for voter in np.flatnonzero(more & (ratio > best)).tolist():
            least[voter], best[voter] = share, ratio[voter]
    return least


@dataclass
class LabelModel:
    """P(toxic), and how often each voter speaks on clean and on toxic texts.

    Voters depend on one another along a tree, given the class: each speaks at one
    rate where its parent speaks and at another where it is silent. So two voters that
    always speak together count once, and one that is seldom heard beside another
    says more when it is. A voter that does not speak abstains; silence of all is a
    vote of its own.
    """

    prior: float
    speaks: np.ndarray  # (2, voters)
    parent: np.ndarray  # of each voter, -1 without
    given: np.ndarray  # (2, 2, voters): by class, and whether the parent speaks

    def posterior(self, spoken: np.ndarray) -> np.ndarray:
        ratio = np.log(self.given[1]) - np.log(self.given[0])
        beside = np.where(self.parent >= 0, spoken[:, self.parent], 0)
        odds = (spoken * np.where(beside > 0, ratio[1], ratio[0])).sum(axis=1)
        odds += np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def accuracy(self) -> np.ndarray:
        """How probable toxic is where the voter speaks."""
        toxic = self.prior * self.speaks[1]
        return toxic / (toxic + (1 - self.prior) * self.speaks[0])


def pair_counts(spoken: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """(2, voters, voters): texts of each class on which both voters speak; a voter with
    itself: on which it speaks."""
    return np.stack([spoken.T @ (spoken * mass[:, None]) for mass in (1 - guess, guess)])


def dependence(both: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Information that two voters share given the class, positive or negative
    correlation alike; (voters, voters)."""
    total = np.zeros(both.shape[1:])
    for own, n in zip(both, texts):
        p = np.clip(np.diag(own) / n, 1e-9, 1 - 1e-9)
        for a, pa_ in ((1, p), (0, 1 - p)):
            for b, pb in ((1, p), (0, 1 - p)):
                seen = own / n
                if not a:
                    seen = pb[None, :] - seen if b else 1 - p[:, None] - p[None, :] + seen
                elif not b:
                    seen = p[:, None] - seen
                seen = np.clip(seen, 0, 1)
                expected = pa_[:, None] * pb[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    total += n * np.where(seen > 0, seen * np.log(seen / expected), 0)
    np.fill_diagonal(total, 0)
    return total


def tree_of(weight: np.ndarray, least: float) -> np.ndarray:
    """Parents in the spanning tree of the largest weights; links below ``least`` are cut."""
    m = len(weight)
    parent, best, reach = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1)
    left = np.ones(m, bool)
    at = 0
    for _ in range(m):
        left[at] = False
        closer = left & (weight[at] > best)
        best[closer], reach[closer] = weight[at][closer], at
        if not left.any():
            break
        at = int(np.argmax(np.where(left, best, -np.inf)))
        parent[at] = reach[at] if best[at] >= least else -1
    return parent


# Information, in texts times nats, below which two voters are held to be independent.
LEAST_DEPENDENCE = 10.0


def fit_label_model(
    spoken: np.ndarray,
    told: np.ndarray,
    prior: float,
    rounds: int = 4,
    belief: float = 1.0,
    silence: int | None = None,
) -> LabelModel:
    """Expectation maximization over the votes, without the labels of their texts.

    ``spoken`` is 0/1 by text and voter. ``told`` is the prior belief in the
    rates at which each voter speaks on clean and on toxic texts; it counts as
    ``belief`` times the texts and so keeps the two classes in their places. In each
    round the tree of dependences is found anew, and with it the rate of each
    voter beside its parent and without it, drawn towards independence by
    INDEPENDENT texts. ``silence`` is the vote that follows from all others; it
    has no place in the tree.
    """
    n, m = spoken.shape
    share = np.array([1 - prior, prior])[:, None] * n * belief
    speaks = np.clip(told, 1e-4, 1 - 1e-4)
    model = LabelModel(prior, speaks, np.full(m, -1), np.stack([speaks, speaks], axis=1))
    for _ in range(rounds):
        for _ in range(3):
            guess = model.posterior(spoken)
            mass = np.stack([1 - guess, guess])
            texts = mass.sum(axis=1, keepdims=True)
            speaks = np.clip((mass @ spoken + told * share) / (texts + share), 1e-4, 1 - 1e-4)
            both = pair_counts(spoken, guess)
            linkage = dependence(both, texts[:, 0])
            if silence is not None:
                linkage[silence] = linkage[:, silence] = 0
            parent = tree_of(linkage, LEAST_DEPENDENCE)
            linked, up = np.flatnonzero(parent >= 0), parent[parent >= 0]
            given = np.stack([speaks, speaks], axis=1)
            for y in (0, 1):
                alone, beside = np.diag(both[y]), both[y][linked, up]
                for state, seen, of in (
                    (1, beside, alone[up]),
                    (0, alone[linked] - beside, texts[y, 0] - alone[up]),
                ):
                    rate = (seen + INDEPENDENT * speaks[y, linked]) / (of + INDEPENDENT)
                    given[y, state, linked] = np.clip(rate, 1e-4, 1 - 1e-4)
            model = LabelModel(prior, speaks, parent, given)
    return model


def told_rates(spoken: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How often each voter speaks on labelled clean and toxic texts, smoothed
    towards its rate on all of them."""
    rate = (spoken.sum(axis=0) + 0.5) / (len(spoken) + 1)
    return np.stack(
        [(spoken[toxic == y].sum(axis=0) + rate) / ((toxic == y).sum() + 1) for y in (0, 1)]
    )


@dataclass
class Scorer:
    voters: Voters
    weights: np.ndarray
    offset: float
    least: dict[int, float]  # of the telling voters

    def score(self, counts: dict[int, float]) -> float:
        votes = with_silence(counts, self.least)
        odds = self.offset + sum(self.weights[v] * np.log1p(n) for v, n in votes.items())
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def fit_classifier(features: np.ndarray, wanted: np.ndarray, decay: float = 1e-5) -> tuple:
    """Logistic regression on posterior labels, both classes of equal weight; Newton steps."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    toxic = wanted.sum()
    balance = wanted / max(toxic, 1e-9) + (1 - wanted) / max(len(wanted) - toxic, 1e-9)
    balance /= balance.sum()
    decays = np.full(x.shape[1], decay)
    decays[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (p - wanted)) + decays * w
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + np.diag(decays)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def terms_of(text: str) -> set[str]:
    """The words of a text, and their beginnings marked with a star, that are at
    least LEAST_SHARE of its words."""
    words = [w for w in LETTERS.findall(text.lower()) if 2 < len(w) <= LONGEST]
    counts = Counter(words)
    for word, n in list(counts.items()):
        for size in BEGINNINGS:
            if len(word) >= size:
                counts[f"{word[:size]}*"] += n
    return {term for term, n in counts.items() if n >= LEAST_SHARE * len(words)}


def labelled_sample(docs: DataFrame, labels: DataFrame, learned: Column, sample: int) -> DataFrame:
    """Texts and labels of at most ``sample`` rows a class, chosen by a hash of the id."""
    known = (
        labels.where(learned & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    some = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)
    ]
    # At most 2 * sample ids of 12 bytes.
    chosen = F.broadcast(some[0].union(some[1]))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    met = texts.join(chosen, F.col("doc_id") == F.col("_id"))
    # A text that is there many times tells no more than once.
    once = met.select("doc_id", "text", "toxic").where("text is not null")
    return settle(once.dropDuplicates(["text", "toxic"]), "labelled")


def telling_terms(sample: DataFrame, least_ratio: float, most: int) -> list[str]:
    """Words and beginnings that stand in more of the toxic texts than chance allows."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            seen[toxic].update(terms_of(text))
        rows = [(t, seen[1][t], seen[0][t]) for t in seen[1]] + [
            (t, 0, n) for t, n in seen[0].items() if t not in seen[1]
        ]
        columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([])] * 3
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [c.cast(k) for c, k in zip(columns, kinds)], names=["term", "bad", "good"]
        )

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return []
    counts = (
        sample.mapInArrow(in_batches(count), "term string, bad long, good long")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    all_of = F.col("bad") + F.col("good")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    share = n_bad / (n_bad + n_good)
    ratio = 2 * (part(F.col("bad"), all_of * share) + part(F.col("good"), all_of * (1 - share)))
    more = F.col("bad") * n_good > 3 * F.col("good") * n_bad
    best = counts.select("term", ratio.alias("ratio")).where(more & (F.col("ratio") >= least_ratio))
    order = [F.desc("ratio"), F.desc(F.length("term")), F.col("term")]
    found = [r["term"] for r in best.orderBy(*order).limit(20 * most).collect()]
    return without_relatives(found)[:most]


def without_relatives(terms: list[str]) -> list[str]:
    """The terms, best first, but none that begins a better one or is begun by it."""
    kept: list[str] = []
    for term in terms:
        stem = term.rstrip("*")
        if not any(stem.startswith(k) or k.startswith(stem) for k in (t.rstrip("*") for t in kept)):
            kept.append(term)
    return kept


def fit(docs: DataFrame, labels: DataFrame, learned: Column, sample: int = SAMPLE) -> Scorer:
    """Voters, label model and classifier from the sample of labelled rows."""
    rows = labelled_sample(docs, labels, learned, sample)
    voters = Voters(telling_terms(rows, LEAST_RATIO, FOUND_VOTERS))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes = WordVotes(voters)
        found = [count_votes(t, votes) for t in text_bytes(batch.column(1))]
        pairs = pa.array([list(c.items()) for c in found], pa.map_(pa.int32(), pa.float64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pairs], names=["doc_id", "toxic", "votes"]
        )

    schema = "doc_id long, toxic int, votes map<int,double>"
    found = rows.mapInArrow(in_batches(vote), schema).collect()
    found.sort(key=lambda r: (r["doc_id"], r["toxic"], sorted(r["votes"].items())))
    counts = np.zeros((len(found), voters.size))
    for i, row in enumerate(found):
        for voter, n in row["votes"].items():
            counts[i, voter] = n
    toxic = np.array([r["toxic"] for r in found])
    if not len(found) or not counts.any() or toxic.min() == toxic.max():
        weights = np.zeros(voters.size)
        weights[: len(LEXICONS)] = 2
        return Scorer(voters, weights, -2.0, dict.fromkeys(range(voters.size), 0.0))
    prior = min(0.95, max(0.05, toxic.mean()))
    least = learned_shares(counts, toxic)
    kept = np.zeros_like(counts)
    for voter, share in least.items():
        kept[:, voter] = np.where(counts[:, voter] >= share, counts[:, voter], 0)
    kept[~kept.any(axis=1), SILENCE] = 1
    spoken = (kept > 0).astype(float)
    model = fit_label_model(spoken, told_rates(spoken, toxic), prior, silence=SILENCE)
    weights, offset = fit_classifier(np.log1p(kept), model.posterior(spoken))
    return Scorer(voters, weights, offset, least)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE
) -> DataFrame:
    """Toxicity of each row's whole text: doc_id, held_out, score, predicted, n_votes.

    Learns from labels of ids whose fold is not 0. A null text counts as empty, and
    an empty one gets the score of a text on which no voter speaks. Labels that
    are null or not 0 or 1 are left out, the larger of several of one id counts; a
    null id counts as '' for the fold; repeated rows are scored each; an empty table
    gives no rows. Without labels the lexicons and patterns alone vote.
    """
    scorer = fit(docs, labels, fold("doc_id", folds) != 0, sample)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes = WordVotes(scorer.voters)
        found = [count_votes(t, votes) for t in text_bytes(batch.column(2))]
        scores = np.array([scorer.score(c) for c in found])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(scores),
                pa.array((scores >= 0.5).astype(np.int32)),
                pa.array([sum(v in scorer.least and n >= scorer.least[v] for v, n in c.items()) for c in found], pa.int64()),
            ],
            names=["doc_id", "held_out", "score", "predicted", "n_votes"],
        )

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", folds) == 0).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, held_out boolean, score double, predicted int, n_votes long"
    return plain.mapInArrow(in_batches(score), schema)
