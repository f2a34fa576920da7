"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to the marginals of each of the three in turn until
all fit. A document is then kept with the calibrated probability of its cell, by a hash of its id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plotweave.plans.durable import Scratch

TEMPERATURE = 0.9  # targets follow the corpus shares to this power
WHOLE = 0.02  # share of tokens in the cells that are wanted most and kept whole, as sampling can't repeat documents
ROUNDS = 50
TOLERANCE = 1e-9
MAX_CELLS = 200_000  # cells that are raked on the driver, where they take about 20 MB; more are raked by Spark
MARGINS = ("source", "lang", "topic")
SEED = 42


def topic(text: Column) -> Column:
    """A coarse kind of text: licence notice, contact data, table or prose."""
    low = F.lower(text)
    return F.when(low.contains("license"), "notice").when(low.contains("@"), "contact").when(low.contains("|"), "table").otherwise("prose")


def tokens(text: Column) -> Column:
    """Token weight of a text: its blanks and line breaks, and one."""
    return (F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("double")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens; nulls become empty strings, which are a class of their own.

    ``topic_col`` and ``tokens_col``: columns with the topic and the token weight (null: 0) of a document; without
    them both come from the text by the rules above.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    kind = topic(text) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit(""))
    weight = tokens(text) if tokens_col is None else F.greatest(F.coalesce(F.col(tokens_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *named, kind.alias("topic"), weight.alias("tokens"))


def tempered(share: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
    """Shares to a power, normalised."""
    out = share**temperature
    return out / out.sum()


def _checked(given: dict[str, float]) -> None:
    if any(not 0 <= w < np.inf for w in given.values()) or sum(given.values()) > 1 + 1e-9:
        raise ValueError("target shares must not be negative nor sum to more than one")


def wanted(names: list[str], share: np.ndarray, given: dict[str, float] | None, temperature: float = TEMPERATURE) -> np.ndarray:
    """The target share of each value of a margin.

    ``given``: shares of all tokens by value; the other values divide the rest by their tempered shares. Given values
    that the corpus lacks are left out. Shares that don't sum to one, with nothing to take the rest, are normalised.
    """
    own = tempered(share, temperature)
    if not given:
        return own
    _checked(given)
    named = np.array([n in given for n in names], bool)
    out = np.array([given.get(n, 0.0) for n in names], np.float64)
    if own[~named].sum() > 0:
        out[~named] = own[~named] / own[~named].sum() * max(0.0, 1.0 - out[named].sum())
    return out / out.sum() if out.sum() > 0 else own


def rake(codes: np.ndarray, weight: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fitted weights of cells: codes (cells, margins) index into the targets of each margin."""
    fitted = weight / weight.sum()
    for _ in range(rounds):
        worst = 0.0
        for k, target in enumerate(targets):
            now = np.bincount(codes[:, k], fitted, len(target))
            worst = max(worst, float(np.abs(now - target).max()))
            fitted = fitted * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[codes[:, k]]
        if worst < tolerance:
            break
    return fitted


Targets = dict[str, dict[str, float]]


def _rake_here(cells: DataFrame, margins: tuple[str, ...], temperature: float, targets: Targets | None = None) -> DataFrame:
    """Fitted weights of at most MAX_CELLS cells, which are collected."""
    given = targets or {}
    own = cells.toPandas().sort_values(list(margins)).reset_index(drop=True)
    codes, shares = np.zeros((len(own), len(margins)), np.int64), []
    weight = own["weight"].to_numpy(np.float64)
    for k, m in enumerate(margins):
        names, codes[:, k] = np.unique(own[m].to_numpy(str), return_inverse=True)
        shares.append(wanted(names.tolist(), np.bincount(codes[:, k], weight, len(names)) / weight.sum(), given.get(m), temperature))
    own["fitted"] = rake(codes, weight, shares)
    return cells.sparkSession.createDataFrame(own, T.StructType([*cells.schema.fields, T.StructField("fitted", T.DoubleType())]))


def target_shares(cells: DataFrame, margin: str, temperature: float = TEMPERATURE, given: dict[str, float] | None = None) -> DataFrame:
    """value, share, target of a margin of ``cells`` (weight), by the rules of ``wanted``."""
    by = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("weight").alias("share"))
    total = by.agg(F.sum("share")).first()[0] or 1.0
    by = by.withColumn("share", F.col("share") / F.lit(total)).withColumn("own", F.pow("share", F.lit(temperature)))
    if not given:
        return by.select("value", "share", (F.col("own") / F.lit(by.agg(F.sum("own")).first()[0] or 1.0)).alias("target"))
    _checked(given)
    fixed = F.lit(None).cast("double")
    for name, w in sorted(given.items()):
        fixed = F.when(F.col("value") == name, F.lit(float(w))).otherwise(fixed)
    by = by.withColumn("given", fixed)
    sums = by.agg(F.coalesce(F.sum("given"), F.lit(0.0)).alias("given"), F.coalesce(F.sum(F.when(F.col("given").isNull(), F.col("own"))), F.lit(0.0)).alias("rest")).first()
    left = max(0.0, 1.0 - sums["given"]) if sums["rest"] > 0 else 0.0
    target = F.coalesce("given", F.col("own") / F.lit(sums["rest"] or 1.0) * F.lit(left))
    return by.select("value", "share", (target / F.lit((sums["given"] + left) or 1.0)).alias("target"))


def _rake_spark(cells: DataFrame, margins: tuple[str, ...], temperature: float, targets: Targets | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The same with any number of cells: each margin is an aggregate that comes back by a join."""
    scratch = Scratch(cells.sparkSession, "raking")
    total = cells.agg(F.sum("weight")).first()[0]
    shares = {m: scratch.write(target_shares(cells, m, temperature, (targets or {}).get(m)).select(F.col("value").alias(m), "target"), f"target-{m}") for m in margins}
    now = scratch.write(cells.withColumn("fitted", F.col("weight") / total), "fit")
    for _ in range(rounds):
        for m in margins:
            factor = now.groupBy(m).agg(F.sum("fitted").alias("now")).join(shares[m], m).select(m, F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(F.lit(0.0)).alias("factor"), F.abs(F.col("target") - F.col("now")).alias("off"))
            now = now.join(factor, m).select(*cells.columns, (F.col("fitted") * F.col("factor")).alias("fitted"), *([F.greatest("off", "worst").alias("worst")] if "worst" in now.columns else [F.col("off").alias("worst")]))
        now = scratch.write(now, "fit")
        if now.agg(F.max("worst")).first()[0] < TOLERANCE:
            break
        now = now.drop("worst")
    return now.select(*cells.columns, "fitted")


def calibrated(described_docs: DataFrame, margins: tuple[str, ...] = MARGINS, temperature: float = TEMPERATURE, targets: Targets | None = None) -> DataFrame:
    """margins, weight, fitted, probability of each cell.

    Probabilities are in proportion to fitted over actual weight. The cells with the largest ratios, which hold
    WHOLE of all tokens, have probability 1, so they may fall short of their targets: ``marginals`` tells by how much.
    """
    scratch = Scratch(described_docs.sparkSession, "mixing")
    cells = scratch.write(described_docs.groupBy(*margins).agg(F.sum("tokens").alias("weight")), "cells")
    n, total = cells.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if not total:  # no rows, or none that weighs anything: all are kept
        return cells.withColumn("fitted", F.lit(0.0)).withColumn("probability", F.lit(1.0))
    fitted = (_rake_here if n <= MAX_CELLS else _rake_spark)(cells, margins, temperature, targets)
    ratio = F.when(F.col("weight") > 0, F.col("fitted") / F.col("weight")).otherwise(F.lit(0.0))
    top = fitted.agg(F.percentile(ratio, 1 - WHOLE, F.ceil("weight").cast("long"))).first()[0]
    if not top:  # targets name a single rare value: its cells are kept whole
        top = fitted.agg(F.min(F.when(ratio > 0, ratio))).first()[0]
    return scratch.write(fitted.withColumn("probability", F.least(ratio / F.lit(top), F.lit(1.0))), "probabilities")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that the id decides."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins: tuple[str, ...] = MARGINS, temperature: float = TEMPERATURE, seed: int = SEED,
        targets: Targets | None = None, topic_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, sampled of every row of ``docs``.

    ``targets``: shares of tokens by margin and value, as ``{"lang": {"en": 0.5}}``; what they don't name follows the
    corpus shares to the power ``temperature``. Null sources and languages are classes of their own; a null text has
    one token. Rows of one id are sampled together where their cells are the same. Other columns are not read; an
    empty table gives an empty result.
    """
    rows = described(docs, id_col, text_col, topic_col, tokens_col)
    cells = calibrated(rows, margins, temperature, targets).select(*margins, "probability")
    mixed = rows.join(cells, list(margins))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "probability", (uniform(F.coalesce("doc_id", F.lit(0).cast("long")), seed) < F.col("probability")).alias("sampled"))


def marginals(mixed: DataFrame, margins: tuple[str, ...] = MARGINS, temperature: float = TEMPERATURE, targets: Targets | None = None) -> DataFrame:
    """margin, value, share, target, expected, achieved of each value of each margin of a result of ``mix``.

    Shares of tokens: in the corpus, as wanted, by the probabilities, and in the sample drawn. Values that the sample
    lacks have 0. One row a value, so the sums are over aggregates and not over documents.
    """
    cells = mixed.groupBy(*margins).agg(F.sum("tokens").alias("weight"), F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("tokens")).otherwise(F.lit(0.0))).alias("a"))
    cells = Scratch(mixed.sparkSession, "marginals").write(cells, "cells")
    e, a = (x or 1.0 for x in cells.agg(F.sum("e"), F.sum("a")).first())
    parts = []
    for m in margins:
        sums = cells.groupBy(F.col(m).alias("value")).agg((F.sum("e") / F.lit(e)).alias("expected"), (F.sum("a") / F.lit(a)).alias("achieved"))
        parts.append(target_shares(cells, m, temperature, (targets or {}).get(m)).join(sums, "value").select(F.lit(m).alias("margin"), "value", "share", "target", "expected", "achieved"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: Targets | None = None) -> DataFrame:
    """The rows of ``docs`` that mixing samples, with their columns, whatever these are called.

    A document's cell probability is found in its own row: the cells are joined to all columns only if they pass
    the bound of cells that may be collected, beyond which the join is by the cell. Nulls, repeated ids and empty
    tables are treated as by ``mix``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cells = calibrated(described(docs, id_col, text_col), targets=targets).select(*MARGINS, F.col("probability").alias("p"))
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    keyed = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic(text).alias("topic"), id_.alias("id"), F.struct(*docs.columns).alias("row"))
    small = cells.count() <= MAX_CELLS
    joined = keyed.join(F.broadcast(cells) if small else cells, list(MARGINS))
    return joined.where(uniform(F.col("id")) < F.col("p")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
