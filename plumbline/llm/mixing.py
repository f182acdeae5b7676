"""Mixing documents to target weights by soft membership, in SQL functions.

A naive Bayes classifier learned from a labelled table gives each document a posterior for every
domain: from words that tell domains apart and from binned shares of symbols, capitals and repeats.
Each document has a rate of at least 0, how often it is taken on average. The rates r minimise
sum_k (S_k(r) - t_k)^2, where S_k is the sum of rate times tokens times posterior of domain k, by
projected gradient descent from r = 1: steps are scaled by the tokens of a document and the inverse of
the domains' Gram matrix over the rows that still have a rate, and the projection is put off to the end
(dual averaging), so that the sum of all steps is one number for each domain,
rate = max(0, 1 + sum_k p_k lambda_k), and an iteration is one aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ROW, staged, with_row_key

#: Bounds of what is learned: labelled rows, and words that serve as features.
LABELLED_ROWS = 20_000
#: Shortest step of the descent, as a share of a whole one.
LEAST_STEP = 1 / 64
VOCABULARY = 200
LEAST_COUNT = 8
#: Words whose presence is less surely tied to a domain (chi-square) are no features.
LEAST_CHI = 20.0
#: Nor are words that are in no domain so many times as frequent as in the others: those of a language, say.
LEAST_RATIO = 8.0
BINS = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
SYMBOLS = "*#$%&!|"
PUNCTUATION = ".,;:?\"'()\n\t\r" + SYMBOLS
SHARES = ("symbols", "capitals", "repeats")


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    """Adds mix_words (array), mix_n (words) and one bin for each of SHARES."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.split(F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION)), " ")
    size = F.greatest(F.length(text), F.lit(1))
    bins = lambda share: sum((F.when(share > b, 1).otherwise(0) for b in BINS), F.lit(0))
    return (
        df.withColumn("mix_words", F.array_remove(words, ""))
        .withColumn("mix_distinct", F.array_distinct("mix_words"))
        .withColumn("mix_n", F.size("mix_words").cast("bigint"))
        .withColumn("mix_symbols", bins(1 - F.length(F.translate(text, SYMBOLS, "")) / size))
        .withColumn("mix_capitals", bins(1 - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")) / size))
        .withColumn("mix_repeats", bins(1 - F.size("mix_distinct") / F.greatest("mix_n", F.lit(1))))
        .drop("mix_words")
    )


FEATURES = ("mix_distinct", "mix_n", *(f"mix_{s}" for s in SHARES))


def total_of(places: str, weights: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda total, place: total + F.element_at(weights, place))


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    words: tuple[str, ...]
    start: tuple[float, ...]  # log prior and all words absent, by domain
    present: tuple[tuple[float, ...], ...]  # change if a word is present, by domain and word
    shares: tuple[tuple[tuple[float, ...], ...], ...]  # by share, domain and bin

    def posteriors(self, df: DataFrame) -> DataFrame:
        """``df`` (with features) with p_<domain> columns that add up to 1."""
        vocabulary = F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")
        df = df.withColumn("mix_hits", F.transform(
            F.array_intersect("mix_distinct", vocabulary), lambda w: F.array_position(vocabulary, w).cast("int")
        ))
        scores = []
        for k in range(len(self.domains)):
            score = F.lit(self.start[k])
            if self.words:
                weights = F.array(*map(F.lit, self.present[k]))
                score = score + total_of("mix_hits", weights)
            for share, table in zip(SHARES, self.shares, strict=True):
                score = score + F.element_at(F.array(*map(F.lit, table[k])), F.col(f"mix_{share}") + 1)
            scores.append(score)
        # As arrays, each step refers to the one before once: the plan stays small.
        df = df.withColumn("mix_scores", F.array(*scores))
        df = df.withColumn("mix_scores", F.transform("mix_scores", lambda s: F.exp(s - F.array_max("mix_scores"))))
        df = df.withColumn("mix_total", F.aggregate("mix_scores", F.lit(0.0), lambda total, s: total + s))
        found = {f"p_{d}": F.col("mix_scores")[k] / F.col("mix_total") for k, d in enumerate(self.domains)}
        return df.withColumns(found).drop("mix_hits", "mix_scores", "mix_total")


def learn(
    labelled: DataFrame,
    domains: tuple[str, ...],
    text_col: str = "text",
    vocabulary: int = VOCABULARY,
) -> Classifier:
    """From rows with a text and a ``domain``. Only counts of domains, words and bins reach the driver.

    Without labelled rows every posterior is 1 / number of domains.
    """
    rows = staged(
        with_features(labelled.select(F.col(f"`{text_col}`").alias("text"), "domain"), "text").drop("text"), "labelled"
    ).filter(F.col("domain").isin(*domains))
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    n = [sizes.get(d, 0) for d in domains]
    total = max(sum(n), 1)
    binned = [
        {(r["domain"], r[1]): r["count"] for r in rows.groupBy("domain", f"mix_{s}").count().collect()} for s in SHARES
    ]
    words = rows.select("domain", F.explode("mix_distinct").alias("word"))
    counted = words.groupBy("word").agg(
        *(F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{k}") for k, d in enumerate(domains)), F.count(F.lit(1)).alias("n")
    )
    # Chi-square of presence against domain.
    chi = F.lit(0.0)
    for k in range(len(domains)):
        expected = F.col("n") * (n[k] / total)
        chi = chi + F.when(expected > 0, (F.col(f"n_{k}") - expected) ** 2 / expected).otherwise(0.0)
    share = lambda count, of: (count + 0.5) / (of + 1.0)
    ratios = [share(F.col(f"n_{k}"), n[k]) / share(F.col("n") - F.col(f"n_{k}"), total - n[k]) for k in range(len(domains))]
    telling = (
        counted.filter((F.col("n") >= LEAST_COUNT) & (F.greatest(F.lit(0.0), *ratios) >= LEAST_RATIO))
        .withColumn("chi", chi)
        .filter(F.col("chi") >= LEAST_CHI)
    )
    best = telling.orderBy(F.desc("chi"), "word").limit(vocabulary).collect()
    best.sort(key=lambda r: r["word"])
    start, present = [], []
    for k in range(len(domains)):
        parts = [share(r[f"n_{k}"], n[k]) for r in best]
        start.append(math.log((n[k] + 1) / (total + len(domains))) + sum(math.log(1 - p) for p in parts))
        present.append(tuple(math.log(p / (1 - p)) for p in parts))
    places = range(len(BINS) + 1)
    shares = tuple(
        tuple(
            tuple(math.log((found.get((d, b), 0) + 0.5) / (n[k] + 0.5 * len(places))) for b in places)
            for k, d in enumerate(domains)
        )
        for found in binned
    )
    return Classifier(tuple(domains), tuple(r["word"] for r in best), tuple(start), tuple(present), shares)


def rate(domains: tuple[str, ...], steps: tuple[float, ...]) -> Column:
    return F.greatest(F.lit(0.0), 1.0 + sum((F.col(f"p_{d}") * F.lit(s) for d, s in zip(domains, steps, strict=True)), F.lit(0.0)))


def fit_rates(
    members: DataFrame,
    targets: dict[str, float],
    anchor: str | None = None,
    rounds: int = 60,
    tolerance: float = 1e-4,
) -> tuple[tuple[float, ...], dict[str, float]]:
    """Sum of gradient steps of each domain, from a stored table of mix_n and p_<domain>, and what each total still
    lacks of its target, as a share of all wanted tokens.

    ``targets`` are relative weights. The total is that of all tokens; with ``anchor`` it is chosen so
    that this domain keeps its own. Stops when all totals are within ``tolerance`` of all tokens, or after
    ``rounds``, then with a greater residual: targets may be out of reach for nonnegative rates. An
    empty table or one without tokens gives 0 for each. A domain without mass can't be moved.
    """
    domains = tuple(targets)
    weight = sum(targets.values())
    k = len(domains)
    def told(steps: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Totals by domain, and the Gram matrix of the rows whose rate is above 0."""
        own = rate(domains, steps)
        sums = [F.sum(own * F.col("mix_n") * F.col(f"p_{d}")) for d in domains]
        grams = [F.sum(F.when(own > 0, F.col("mix_n") * F.col(f"p_{a}") * F.col(f"p_{b}"))) for a in domains for b in domains]
        found = np.array([x or 0.0 for x in members.agg(*sums, *grams).first()])
        return found[:k], found[k:].reshape(k, k)

    steps = (0.0,) * k
    mass, gram = told(steps)
    total = float(mass.sum())
    if not total:
        return steps, dict.fromkeys(domains, 0.0)
    if anchor is not None:
        total = float(mass[domains.index(anchor)]) * weight / targets[anchor] or total
    wanted = np.array([total * targets[d] / weight for d in domains])
    away, whole, share = wanted - mass, gram, 1.0
    for _ in range(rounds):
        if np.abs(away).max() <= tolerance * total or share < LEAST_STEP:
            break
        # A step that doesn't bring the totals nearer is made shorter, first by the matrix of all rows.
        step = np.linalg.pinv(gram, rcond=1e-9) @ away if share == 1.0 else 2 * share * (np.linalg.pinv(whole, rcond=1e-9) @ away)
        tried = tuple(float(s) for s in np.array(steps) + step)
        mass, active = told(tried)
        if np.linalg.norm(wanted - mass) < np.linalg.norm(away):
            steps, away, gram, share = tried, wanted - mass, active, 1.0
        else:
            share /= 2
    return steps, {d: float(a) / total for d, a in zip(domains, away, strict=True)}


def copies(rates: Column, key: Column) -> Column:
    """Whole number of copies whose mean is the rate: its floor, one more for a share of the keys."""
    uniform = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1_000_003)) / 1_000_003.0
    return F.floor(rates + uniform).cast("int")


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks; of conflicting marks the worse holds."""
    worst = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return worst.select("doc_id", domain.alias("domain")).filter("doc_id is not null and domain is not null")


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(text, domain) of the ``rows`` labelled documents of least identifier hash, at most."""
    picked = domain_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").alias("own_id"), F.col("text"))
    return own.join(F.broadcast(picked), F.col("own_id") == F.col("doc_id")).select("text", "domain")


@dataclass(frozen=True)
class Mixture:
    classifier: Classifier
    steps: tuple[float, ...]
    #: What each domain's total lacks of its target, as a share of all wanted tokens.
    residual: dict[str, float]

    def rated(self, members: DataFrame) -> DataFrame:
        """``members`` (with p_<domain>) and the rate of each."""
        return members.withColumn("rate", rate(self.classifier.domains, self.steps))


def fit(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str | None = None, carry: tuple[str, ...] = ()
) -> tuple[Mixture, DataFrame]:
    """The mixture and (doc_id, mix_n, p_<domain>, and the columns of ``carry``) of every row, stored.

    A row with a null or empty text has no tokens; its posteriors are those of an empty text.
    """
    classifier = learn(labelled_rows(docs, labels), tuple(targets))
    own = docs.select(F.col("doc_id"), F.col("text"), *carry)
    members = staged(
        classifier.posteriors(with_features(own, "text")).select("doc_id", "mix_n", *(f"p_{d}" for d in targets), *carry), "members"
    )
    return Mixture(classifier, *fit_rates(members, targets, anchor)), members


def taken(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str | None = None) -> DataFrame:
    """The rows, with all their columns, as often as their rates say (``copies`` by doc_id).

    Each row has a rate of its own, so rows that repeat an identifier with other texts are told apart; rows
    without identifier are taken once, and so are null and empty texts as often as the rate of an empty one says.
    """
    keyed = with_row_key(docs)
    mixture, members = fit(keyed, labels, targets, anchor, carry=(ROW,))
    often = mixture.rated(members).filter("doc_id is not null").select(ROW, copies(F.col("rate"), F.col("doc_id")).alias("__copies"))
    changed = staged(often.filter("__copies <> 1"), "copies")
    # Each row moves once, by a key that no two share; the join is the same however few change.
    dealt = keyed.join(changed.hint("shuffle_hash"), ROW, "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    again = dealt.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))
