"""Mixing sources to target weights by iterative proportional fitting (raking).

The tokens of each cell (source, language, topic) are scaled until every
source, language and topic has its target share of tokens; a document is kept
with the probability that its cell's scaling asks for. Probabilities are held
at 1 within the raking, so the kept tokens have the target shares. A value that
has fewer tokens than its share of the budget is kept whole, and the others
keep their proportions. Documents are read twice: once for the cells' totals,
once to be sampled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, unit_hash
from .components import join_facts

MARGINS = ("source", "lang", "topic")
#: A target share is the observed share to this power (1: as it is, 0: all equal), unless shares are given.
TEMPER = 0.5
#: Expected share of all tokens that is kept.
BUDGET = 0.5
ITERATIONS = 200
#: Cells fitted in one process; more are fitted by the same rules as a distributed job.
MAX_LOCAL_CELLS = 100_000
SEED = "mix"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Topics by what a text contains, the first that holds; the patterns work alike in Java and RE2.
TOPICS = [
    ("legal", r"(?i)licen[sc]e|copyright|rights reserved"),
    ("contact", r"@[A-Za-z0-9.-]+\.[a-z]+"),
    ("tabular", r" \| "),
    ("numeric", r"[0-9]{3,}"),
    ("prose", r"[.!?]"),
]
OTHER_TOPIC = "other"


def _cell() -> dict[str, Column]:
    """Source, language and topic of a row of documents; nulls count as the empty string."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    topic = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        topic = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(topic)
    return {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": topic}


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words) of each row; null text is empty."""
    count = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select("doc_id", *[c.alias(m) for m, c in _cell().items()], count.alias("n_tokens"))


def _shares(total: np.ndarray, given: dict[str, float] | None, names: list[str], temper: float) -> np.ndarray:
    raw = np.array([given.get(n, 0.0) for n in names]) if given is not None else total / max(total.sum(), 1e-300)
    raw = np.where(total > 0, raw if given is not None else np.power(raw, temper), 0)
    return raw / raw.sum() if raw.sum() else raw


def probabilities(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * weight) with s such that the expected share of tokens is `budget` (all of it if the weights can't fill it)."""
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order], weight[order]
    whole = np.concatenate([[0.0], np.cumsum(t)[:-1]])
    rest = np.cumsum((t * w)[::-1])[::-1]
    s = np.divide(budget * tokens.sum() - whole, rest, out=np.full(len(w), np.inf), where=rest > 0)
    with np.errstate(invalid="ignore"):  # cells of weight 0
        fits = np.flatnonzero(s * w <= 1)
    if not len(fits):
        return (weight > 0).astype(float)
    return np.minimum(1, s[fits[0]] * weight)


def attainable(totals: list[np.ndarray], wanted: list[np.ndarray], budget: float) -> list[np.ndarray]:
    """Tokens to keep of each value of each margin: in proportion to wanted, at most all; margins have equal sums, the budget if they can."""
    ratio = [np.divide(w, t, out=np.zeros(len(t)), where=t > 0) for t, w in zip(totals, wanted, strict=True)]
    budget = min([budget, *((t * (r > 0)).sum() / max(t.sum(), 1e-300) for t, r in zip(totals, ratio, strict=True))])
    return [t * probabilities(t, r, budget) for t, r in zip(totals, ratio, strict=True)]


def rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], budget: float, iterations: int = ITERATIONS) -> np.ndarray:
    """Probabilities of cells: tokens * probability has the goal in each value of each margin, as far as cells allow it."""
    weight = np.full(len(tokens), budget)
    for _ in range(iterations):
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, tokens * np.minimum(1, weight), len(goal))
            weight = weight * np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[code]
    return np.minimum(1, weight)


def fit_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, iterations: int = ITERATIONS, max_local: int = MAX_LOCAL_CELLS) -> DataFrame:
    """source, lang, topic, probability of each cell, from their tokens.

    A value that is missing from given targets has target 0, so its documents
    go; targets of values that do not occur are spread over the others.
    """
    spark, targets = cells.sparkSession, targets or {}
    if cells.count() > max_local:
        return _fit_distributed(cells, targets, temper, budget, iterations)
    rows = cells.orderBy(*MARGINS).collect()
    tokens = np.array([float(r["tokens"]) for r in rows])
    codes, totals, wanted = [], [], []
    for m in MARGINS:
        names = sorted({r[m] for r in rows})
        at = {n: i for i, n in enumerate(names)}
        codes.append(np.array([at[r[m]] for r in rows], np.int64))
        totals.append(np.bincount(codes[-1], tokens, len(names)))
        wanted.append(_shares(totals[-1], targets.get(m), names, temper) * tokens.sum())
    p = rake(tokens, codes, attainable(totals, wanted, budget), budget, iterations) if len(rows) else np.empty(0)
    return spark.createDataFrame([(*(r[m] for m in MARGINS), float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, probability double")


def _scale(frame: DataFrame, have: Column, want: Column, total: float) -> float:
    """The s at which the sum of least(have, s * want) is `total`, or beyond which it no longer grows."""
    low, high = 0.0, 1.0
    kept = lambda s: frame.agg(F.sum(F.least(have, F.lit(s) * want))).first()[0] or 0.0
    while kept(high) < total and high < 1e18:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if kept(middle) < total else (low, middle)
    return high


def _fit_distributed(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float, budget: float, iterations: int) -> DataFrame:
    """The same fit with cells and margins in frames: sums by value, joined back; lineage cut after every round."""
    spark = cells.sparkSession
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total, wanted = float(total or 0), budget * float(total or 0)
    values = {}
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("own"), F.count(F.lit(1)).alias("n"))
        if m in targets:
            own = own.join(spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} string, raw double"), m, "left").withColumn("t", F.when(F.col("own") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0)).drop("raw")
        else:
            own = own.withColumn("t", F.when(F.col("own") > 0, F.pow(F.col("own") / F.lit(total), F.lit(temper))).otherwise(0.0))
        values[m] = materialize(own, "margin")
        wanted = min(wanted, values[m].filter("t > 0").agg(F.sum("own")).first()[0] or 0.0)
    for m in MARGINS:
        s = _scale(values[m], F.col("own"), F.col("t"), wanted)
        values[m] = values[m].select(m, "n", F.least(F.col("own"), F.lit(s) * F.col("t")).alias("goal"))
    frame, held = materialize(cells.withColumn("weight", F.lit(float(budget))), "rake"), F.least(F.lit(1.0), F.col("weight"))
    for _ in range(iterations):
        for m in MARGINS:
            now = frame.groupBy(m).agg(F.sum(F.col("tokens") * held).alias("now"))
            factor = now.join(values[m], m).select(m, "n", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            frame = join_facts(frame, factor, m, n).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        frame = materialize(frame, "rake")
    return frame.select(*MARGINS, held.alias("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, iterations: int = ITERATIONS, max_local: int = MAX_LOCAL_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept of every row.

    `kept` compares the probability with a number that depends on doc_id alone,
    so repeated rows share a fate and a new run keeps the same documents.
    A source, language or topic none of whose texts has a word has probability 0.
    """
    seen = materialize(features(docs), "mixing")  # some bytes a document
    cells = seen.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = fit_cells(cells, targets, temper, budget, iterations, max_local)
    return seen.join(fitted, list(MARGINS)).withColumn("kept", unit_hash(F.lit(SEED), F.col("doc_id")) < F.col("probability"))


def report(mixed: DataFrame) -> DataFrame:
    """margin, value, tokens, expected (tokens that are kept on average), share (of all expected) of each value of each margin of what mix returned."""
    cells = mixed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"))
    total = cells.agg(F.sum("expected")).first()[0] or 0.0
    each = cells.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS])).alias("v"), "tokens", "expected")
    return each.groupBy("v.margin", "v.value").agg(F.sum("tokens").alias("tokens"), F.sum("expected").alias("expected")).withColumn("share", F.col("expected") / F.nullif(F.lit(total), F.lit(0.0)))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of docs with all their columns."""
    seen = features(docs).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = fit_cells(materialize(seen, "cells"), **options)
    cell = {m: fresh(docs, f"cell_{m}") for m in MARGINS}
    probability = fresh(docs, "probability")
    fitted = fitted.withColumnsRenamed(cell | {"probability": probability})
    keyed = docs.withColumns({cell[m]: c for m, c in _cell().items()})
    joined = keyed.join(fitted, list(cell.values()))
    return joined.filter(unit_hash(F.lit(SEED), F.col("doc_id")) < F.col(probability)).select(*[docs[c] for c in docs.columns])


def duckdb_sql(temper: float = TEMPER, budget: float = BUDGET, iterations: int = ITERATIONS) -> str:
    """The same as SQL: a recursion that scales one margin after another."""
    when = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps = [
        f"f AS MATERIALIZED (SELECT doc_id, source, lang, CASE {when} ELSE '{OTHER_TOPIC}' END AS topic, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_tokens FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents))",
        "k AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM f GROUP BY ALL)",
        "n AS (SELECT sum(tokens) AS total FROM k)",
    ]
    for m in MARGINS:
        steps += [
            f"v_{m} AS MATERIALIZED (SELECT {m}, t, total, CASE WHEN t > 0 THEN total * r / sum(r) OVER () / t ELSE 0 END AS w FROM (SELECT {m}, total, sum(tokens) AS t, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens) / total, {temper}::DOUBLE) ELSE 0 END AS r FROM k, n GROUP BY {m}, total))",
            f"s_{m} AS (SELECT max(s) FILTER (s * w <= 1) AS s FROM (SELECT w, ({budget}::DOUBLE * total - coalesce(sum(t) OVER (ORDER BY w DESC, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(t * w) OVER (ORDER BY w DESC, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS s FROM v_{m}))",
            f"g_{m} AS MATERIALIZED (SELECT {m}, t * CASE WHEN s IS NULL THEN (w > 0)::INT::DOUBLE ELSE least(1.0, s * w) END AS goal_{m} FROM v_{m}, s_{m})",
        ]
    goal = "CASE i % 3 " + " ".join(f"WHEN {j} THEN goal_{m}" for j, m in enumerate(MARGINS)) + " END"
    value = "CASE i % 3 " + " ".join(f"WHEN {j} THEN {m}" for j, m in enumerate(MARGINS)) + " END"
    joins = " ".join(f"JOIN g_{m} USING ({m})" for m in MARGINS)
    steps += [
        f"it AS (SELECT 0 AS i, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, {budget}::DOUBLE AS w FROM k {joins} "
        f"UNION ALL SELECT i + 1, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, CASE WHEN now > 0 THEN w * ({goal} / now) ELSE 0 END FROM (SELECT *, sum(tokens * least(1.0, w)) OVER (PARTITION BY {value}) AS now FROM it WHERE i < {3 * iterations}))",
        f"p AS (SELECT source, lang, topic, least(1.0, w) AS probability FROM it WHERE i = {3 * iterations})",
    ]
    return "WITH RECURSIVE " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(probability, 9) AS probability, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS kept FROM f JOIN p USING (source, lang, topic)"
