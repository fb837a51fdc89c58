"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A naive Bayes classifier over sets of words, fitted on a bounded sample of a labelled table, gives every document
posteriors p over domains. Rates r >= 0 minimise the squared misfit of the expected totals
S_k = sum_i r_i t_i p_ik to the targets T_k, weighted by one over the total before mixing, by projected
gradient: r_i <- max(0, r_i - step * p_i . e), with e the weighted residuals. A step needs the documents
for K sums only, so the driver holds one residual vector per step and every task folds those vectors
over its posteriors (with Nesterov's momentum); rates are never collected, joined or rewritten. Equal posteriors share a rate and
are added up before the first step.

Everything runs in DataFrame functions. Bounds: ``ROWS_PER_DOMAIN`` labelled rows per domain,
``MOST_DOMAINS`` domains, ``FEATURES`` words.

A token is a run of characters without blanks. Null or empty texts have no tokens and the prior as
posterior. Repeated rows are documents of their own. Labels without an id or domain are ignored; several
labels of one document all count. Without labels, or without tokens, all rates are 1. Copies of a row:
the rate, rounded up with the probability of its fraction, drawn from a hash of id and text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import written

ROWS_PER_DOMAIN = 2_000
MOST_DOMAINS = 16
FEATURES = 128
LEAST_DOCS = 5  # labelled documents that must hold a feature word
MOST_SHARE = 0.1  # and the share of them that may
STEPS = 60
CLOSE = 1e-3  # relative misfit at which the fit ends


def words(text: Column) -> Column:
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\n\t\r", "   ")
    return F.array_remove(F.split(flat, " "), "")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    base: list[float]  # log prior
    weights: dict[str, list[float]]  # log of the word's share in a domain against its share in all
    bare: list[float] = field(default_factory=list)  # share of a domain's documents without any of the words

    def posterior(self, tokens: Column) -> Column:
        """array<double> over ``domains``; words are added in one fixed order, so equal sets agree exactly."""
        k = range(len(self.domains))
        logits = F.array(*[F.lit(b) for b in self.base])
        if self.weights:
            start = F.array(*[F.lit(b + math.log(1 - q)) for b, q in zip(self.base, self.bare)])
            none = F.array(*[F.lit(b + math.log(q)) for b, q in zip(self.base, self.bare)])
            names = F.lit(list(self.weights))
            table = F.map_from_arrays(names, F.array(*[F.array(*map(F.lit, w)) for w in self.weights.values()]))
            add = lambda acc, w: F.zip_with(acc, table[w], lambda a, b: a + b)
            found = F.array_intersect(names, tokens)
            logits = once(found, lambda hits: F.when(F.size(hits) == 0, none).otherwise(F.aggregate(hits, start, add)))
        grown = once(logits, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
        return once(grown, lambda g: F.transform(g, lambda x: x / sum((g[i] for i in k), F.lit(0.0))))


def fit_classifier(docs: DataFrame, labelled: DataFrame, id: str = "doc_id", text: str = "text", domain: str = "domain", rows_per_domain: int = ROWS_PER_DOMAIN, features: int = FEATURES) -> Classifier:
    labels = labelled.select(F.col(id).alias("id"), F.col(domain).alias("domain")).dropna().distinct()
    counts = labels.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MOST_DOMAINS).collect()
    domains = sorted(r["domain"] for r in counts)
    if not domains:
        return Classifier([], [], {})
    size = {r["domain"]: r["count"] for r in counts}
    order = Window.partitionBy("domain").orderBy(F.xxhash64("id"), "id")
    sample = labels.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows_per_domain).drop("n")
    sample = sample.filter(F.col("domain").isin(domains))
    # at most rows_per_domain * MOST_DOMAINS narrow rows
    text_of = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    bags = text_of.select("domain", F.array_distinct(words(F.col("text"))).alias("bag"))
    is_in = [F.col("domain") == d for d in domains]
    k = range(len(domains))
    of = [F.sum(F.when(c, F.size("bag"))).alias(f"w{i}") for i, c in enumerate(is_in)]
    seen = bags.agg(F.count("*").alias("docs"), *of).first()
    bag = [seen[f"w{i}"] or 0 for i in k]  # distinct words, summed over the documents of a domain
    held = bags.select("domain", F.explode("bag").alias("word")).groupBy("word")
    held = held.agg(F.count("*").alias("all"), *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(is_in)])
    # words that most documents hold tell the length of a document, not its domain
    held = held.filter((F.col("all") >= LEAST_DOCS) & (F.col("all") <= MOST_SHARE * seen["docs"]))

    def ratio(n, all, i):
        return ((n + 0.5) / (bag[i] + 1)) / ((all + 0.5) / (sum(bag) + 1))

    gain = sum((F.col(f"n{i}") * F.log(ratio(F.col(f"n{i}"), F.col("all"), i)) for i in k), F.lit(0.0))
    best = held.withColumn("gain", F.round(gain, 9)).orderBy(F.desc("gain"), "word").limit(features).collect()
    labels_all = sum(size.values())
    prior = [math.log(size[d] / labels_all) for d in domains]
    weights = {r["word"]: [math.log(ratio(r[f"n{i}"], r["all"], i)) for i in k] for r in best}
    if not weights:
        return Classifier(domains, prior, weights)
    lacks = ~F.arrays_overlap("bag", F.lit(list(weights)))
    row = bags.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(is_in)], *[F.count_if(c & lacks).alias(f"z{i}") for i, c in enumerate(is_in)]).first()
    bare = [(row[f"z{i}"] + 0.5) / (row[f"n{i}"] + 1) for i in k]
    return Classifier(domains, prior, weights, bare)


@dataclass
class Rates:
    """The rate as a function of the posterior: start at 1 and follow the residuals of all steps."""

    classifier: Classifier
    scale: list[float] = field(default_factory=list)
    step: float = 0.0
    residuals: list[list[float]] = field(default_factory=list)  # and the momentum of each step
    totals: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)

    def column(self, p: Column) -> Column:
        if not self.residuals:
            return F.lit(1.0)
        moves = F.array(*[F.array(*map(F.lit, e)) for e in self.residuals])
        k = range(len(self.scale))

        def move(state, e):
            ahead = state["r"] + e[len(self.scale)] * (state["r"] - state["last"])
            new = F.greatest(F.lit(0.0), ahead - sum((p[i] * e[i] for i in k), F.lit(0.0)))
            return F.struct(new.alias("r"), state["r"].alias("last"))

        return F.aggregate(moves, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("last")), move, lambda state: state["r"])


def fit_rates(posteriors: DataFrame, classifier: Classifier, weights: dict[str, float], budget: float = 1.0) -> Rates:
    """Rates for ``posteriors`` (tokens, p): domain totals in proportion to ``weights``, ``budget`` times
    the tokens there are. Domains without a weight have the target 0."""
    k = range(len(classifier.domains))
    rates = Rates(classifier)
    whole = sum(weights.get(d, 0.0) for d in classifier.domains)
    if not classifier.domains or whole <= 0:
        return rates
    alike = written(posteriors.filter("tokens > 0").groupBy("p").agg(F.sum("tokens").alias("tokens")), "posteriors")
    p = F.col("p")

    def sums(weight: Column, *more: Column) -> list[float]:
        row = alike.agg(*[F.sum(weight * p[i]).alias(f"s{i}") for i in k], *more).first()
        return [float(v or 0.0) for v in row]

    products = [F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in k for j in k]
    got = sums(F.col("tokens"), *products)
    before, m = got[: len(k)], got[len(k) :]
    total = sum(before)
    if total <= 0:
        return rates
    rates.targets = [budget * total * weights.get(d, 0.0) / whole for d in classifier.domains]
    rates.scale = [max(b, total * 1e-9) for b in before]
    # with residuals weighted by 1 / total the products are near a unit matrix; its largest eigenvalue is
    # bounded by the largest row sum
    rates.step = 1 / max(sum(m[i * len(k) + j] / math.sqrt(rates.scale[i] * rates.scale[j]) for j in k) for i in k)
    now, last, pace = before, before, 1.0
    for _ in range(STEPS):
        if max(abs(s - t) / max(t, total * CLOSE) for s, t in zip(now, rates.targets)) <= CLOSE:
            break
        if rates.residuals and max(abs(a - b) for a, b in zip(now, last)) < 1e-6 * total:
            break  # the targets are out of reach, and this is the nearest point
        # totals are linear in the rates, so those of the point ahead need no pass of their own
        next_pace = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        push, pace = (pace - 1) / next_pace, next_pace
        ahead = [s + push * (s - o) for s, o in zip(now, last)]
        gaps = [rates.step * (s - t) / b for s, t, b in zip(ahead, rates.targets, rates.scale)]
        rates.residuals.append([*gaps, push])
        last, now = now, sums(F.col("tokens") * rates.column(p))
    rates.totals = now
    return rates


def copies(rate: Column, draw: Column) -> Column:
    """The rate, rounded up with the probability of its fraction; ``draw`` is a hash of the row."""
    share = (F.pmod(draw, F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return (F.floor(rate) + F.when(share < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def posteriors(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with __tokens and __p."""
    tokens = words(F.col(text))
    return docs.withColumn("__words", tokens).select(
        *docs.columns, F.size("__words").cast("long").alias("__tokens"), classifier.posterior(F.col("__words")).alias("__p")
    )


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0) -> DataFrame:
    """``docs`` with every row repeated (or left out) by its rate, all columns unchanged."""
    classifier = fit_classifier(docs, labelled)
    if not classifier.domains:
        return docs
    marked = posteriors(docs, classifier)
    rates = fit_rates(marked.select(F.col("__tokens").alias("tokens"), F.col("__p").alias("p")), classifier, weights, budget)
    times = copies(rates.column(F.col("__p")), F.xxhash64("doc_id", "text"))
    return marked.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def rates_table(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, posteriors (map), rate and copies of every row."""
    classifier = fit_classifier(docs, labelled)
    slim = posteriors(docs.select("doc_id", "text"), classifier).select("doc_id", "__tokens", "__p", F.xxhash64("doc_id", "text").alias("draw"))
    slim = written(slim, "memberships")
    rates = fit_rates(slim.select(F.col("__tokens").alias("tokens"), F.col("__p").alias("p")), classifier, weights, budget)
    rate = rates.column(F.col("__p"))
    each = [F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(classifier.domains)]
    return slim.withColumn("rate", rate).select(
        "doc_id", F.col("__tokens").alias("n_tokens"), *each, "rate", copies(F.col("rate"), F.col("draw")).alias("copies")
    )


def quality_domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the corpus: toxic, poor or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
