"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Raking scales the cells' token weights until the totals of
each source, each language and each topic have their target shares, with no probability above 1: cells at 1 stay there and the others are
raked around them. A document is then kept with its cell's calibrated probability, by a hash of its id. Cells are aggregated over all documents; the raking itself works on the cells only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernels import mix, word_hashes
from ._runtime import cut, slices

TOPICS = 8
#: Cells that are raked on the driver; more are summed by Spark, with the same steps, rounds and tolerance.
DRIVER_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
#: Rounds and relative error at which raking ends, and halvings in the search for the largest share.
ROUNDS, TOLERANCE, HALVINGS = 200, 1e-6, 10
#: Rounds in which the error must fall by a tenth.
STALLED = 20
Sums = Callable[[list[np.ndarray], int, float], "tuple[np.ndarray, np.ndarray] | float"]


def topics_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its topic: the vocabulary (of TOPICS hashed ones) that most of its words belong to; -1 without words."""
    (words,), offsets = word_hashes(column, 1)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc * TOPICS + (mix(words, 71) % np.uint64(TOPICS)).astype(np.int64), minlength=n * TOPICS).reshape(n, TOPICS)
    return sizes, np.where(sizes > 0, counts.argmax(axis=1), -1)


def hashed_topic(text: Column) -> Column:
    """topics_of as a column; the stand-in for a topic where the table has none."""

    @F.pandas_udf("string")
    def topic(texts: pd.Series) -> pd.Series:
        return pd.Series([f"t{t}" if t >= 0 else "" for t in topics_of(pa.array(texts, pa.large_string(), from_pandas=True))[1]])

    return topic(text)


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("(null)"))


def describe(documents: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None = None) -> DataFrame:
    """(id, source, lang, topic, tokens) of each row; a null source, language or topic is a value of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, topic = topics_of(batch.column("text"))
            topics = batch.column("topic") if topic_col else pa.array([f"t{t}" if t >= 0 else "" for t in topic], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("lang"), topics, pa.array(sizes)], names=["id", "source", "lang", "topic", "tokens"])

    topic = _value(topic_col) if topic_col else F.lit("")
    docs = documents.select(F.col(id_col).alias("id"), _value(source_col).alias("source"), _value(lang_col).alias("lang"), topic.alias("topic"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"id {documents.schema[id_col].dataType.simpleString()}, source string, lang string, topic string, tokens long")


def tempered(totals: dict[str, float], exponent: float) -> dict[str, float]:
    """Target shares: the shares of tokens to a power; 1 keeps them, 0 makes them equal."""
    raised = {k: v**exponent for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def _ratio(free: np.ndarray, capped: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """What brings each value's free + capped weight to its goal while the capped part stays: a Newton step, kept above zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(free + capped > 0, goal / (free + capped), 1.0)
        return np.where(free > 0, np.maximum((goal - capped) / free, plain / 2), plain)


def _fit(sums: Sums, factors: list[np.ndarray], goals: list[np.ndarray], cap: float, rounds: int, tolerance: float) -> bool:
    """Scale the values' factors in place until the weights tokens * min(cap, product of factors) have the goals as totals.

    A cell at the cap stays there and the others are raked around it, so capped cells cost no value its goal. True if each
    total is within tolerance of its goal, relative to the goal. Goals that can't be had are given up when the error stays.
    """
    before = np.inf
    for turn in range(rounds):
        worst = 0.0
        for n, goal in enumerate(goals):
            free, capped = sums(factors, n, cap)
            asked = (goal > 0) & (free + capped > 0)
            worst = max(worst, float(np.max(np.abs(free + capped - goal)[asked] / goal[asked], initial=0.0)))
            factors[n] = factors[n] * _ratio(free, capped, goal)
        if worst < tolerance:
            return True
        if turn % STALLED == STALLED - 1:
            if worst > 0.9 * before:
                return False
            before = worst
    return False


def _array_sums(cells: np.ndarray, codes: list[np.ndarray], sizes: list[int]) -> Sums:
    """sums(factors, n, cap): free and capped weight of each value of dimension n; n = -1: the largest product of factors."""

    def sums(factors: list[np.ndarray], n: int, cap: float):
        p = np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0)
        if n < 0:
            return float(p.max())
        free = p < cap
        return np.bincount(codes[n], np.where(free, cells * p, 0.0), sizes[n]), np.bincount(codes[n], np.where(free, 0.0, cells * cap if cap < np.inf else 0.0), sizes[n])

    return sums


def _frame_sums(cells: DataFrame, sizes: list[int]) -> Sums:
    """_array_sums over a frame (c0, c1, ..., tokens): tasks add up their cells, and only the values' sums reach the driver."""
    spark = cells.sparkSession

    def sums(factors: list[np.ndarray], n: int, cap: float):
        sent = spark.sparkContext.broadcast(factors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = [batch.column(f"c{k}").to_numpy() for k in range(len(sent.value))]
                part = _array_sums(batch.column("tokens").to_numpy().astype(float), codes, sizes)(sent.value, n, cap)
                if n < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([part]), pa.array([0.0])], names=["code", "free", "capped"])
                else:
                    some = np.unique(codes[n])
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(part[0][some]), pa.array(part[1][some])], names=["code", "free", "capped"])

        add = F.max if n < 0 else F.sum
        rows = cells.mapInArrow(run, "code long, free double, capped double").groupBy("code").agg(add("free").alias("free"), add("capped").alias("capped")).collect()
        sent.destroy()
        if n < 0:
            return rows[0].free
        free, capped = np.zeros(sizes[n]), np.zeros(sizes[n])
        for r in rows:
            free[r.code], capped[r.code] = r.free, r.capped
        return free, capped

    return sums


def _raked(sums: Sums, whole: float, targets: list[np.ndarray], rounds: int, tolerance: float) -> list[np.ndarray]:
    factors = [np.ones(len(t)) for t in targets]
    _fit(sums, factors, [t * whole for t in targets], np.inf, rounds, tolerance)
    return factors


def _product(factors: list[np.ndarray], codes: list[np.ndarray]) -> np.ndarray:
    return np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0)


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Factor of each cell so that, in each dimension, the share of factor * tokens of each value is its target."""
    cells = cells.astype(float)
    return _product(_raked(_array_sums(cells, codes, [len(t) for t in targets]), cells.sum(), targets, rounds, tolerance), codes)


def _coded(cells: DataFrame, values: list[tuple[str, list]]) -> DataFrame:
    """cells with the number of each value in its dimension's list, as c0, c1, ..."""
    spark = cells.sparkSession
    for n, (name, listed) in enumerate(values):
        codes = spark.createDataFrame([(v, k) for k, v in enumerate(listed)], f"`{name}` string, c{n} int")
        cells = cells.join(codes, name)
    return cut(cells)


def _with_product(cells: DataFrame, values: list[tuple[str, list]], factors: list[np.ndarray], name: str) -> DataFrame:
    out = cells
    for n, (_, listed) in enumerate(values):
        out = out.join(cells.sparkSession.createDataFrame([(k, float(factors[n][k])) for k in range(len(listed))], f"c{n} int, f{n} double"), f"c{n}")
    product = F.lit(1.0)
    for n in range(len(values)):
        product = product * F.col(f"f{n}")
    return out.withColumn(name, product).drop(*(f"{x}{n}" for x in "cf" for n in range(len(values))))


def rake_frames(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """rake() for more cells than a driver should hold: cells (dimensions, tokens) -> with factor. targets: (value, share) by dimension."""
    listed = {name: sorted((r.value, r.share) for r in t.collect()) for name, t in targets.items()}
    values = [(name, [v for v, _ in rows]) for name, rows in listed.items()]
    shares = [np.array([x for _, x in rows], dtype=float) for rows in listed.values()]
    coded = _coded(cells, values)
    whole = float(coded.agg(F.sum("tokens")).first()[0])
    factors = _raked(_frame_sums(coded, [len(x) for x in shares]), whole, shares, rounds, tolerance)
    return _with_product(coded, values, factors, "factor")


def scale_for(tokens: np.ndarray, factors: np.ndarray, share: float) -> float:
    """The scale with which capped probabilities min(1, scale * factor) keep the given share of the tokens; caps then cost values their targets."""
    low, high = 0.0, 1.0 / max(float(factors.min()), 1e-12)
    goal = share * tokens.sum()
    for _ in range(100):
        middle = (low + high) / 2
        if (tokens * np.minimum(1, middle * factors)).sum() < goal:
            low = middle
        else:
            high = middle
    return high


def fit_share(sums: Sums, totals: list[np.ndarray], targets: list[np.ndarray], share: float, rounds: int, tolerance: float) -> list[np.ndarray]:
    """Factors whose products, capped at 1, keep tokens in the target shares, and the given share of all or the largest one possible.

    A value cannot give more tokens than it has, which bounds the share; where cells in common bound it further, the largest
    share is searched for. Targets that no weights of the cells reach stay as near as raking without caps comes to them.
    """
    whole = float(totals[0].sum())
    base = _raked(sums, whole, targets, rounds, tolerance)
    peak = sums(base, -1, np.inf)
    high = min([share, *(float((t[g > 0] / whole / g[g > 0]).min()) for t, g in zip(totals, targets, strict=True))])

    def at(wanted: float) -> tuple[list[np.ndarray], bool]:
        factors = [base[0] * wanted, *base[1:]]
        if wanted * peak <= 1:
            return factors, True
        return factors, _fit(sums, factors, [t * whole * wanted for t in targets], 1.0, rounds, tolerance)

    best, ok = at(high)
    if ok:
        return best
    low = min(high, 1 / peak)
    best, _ = at(low)
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        factors, ok = at(middle)
        if ok:
            low, best = middle, factors
        else:
            high = middle
    return best


def wanted(found: dict[str, float], given: dict[str, float] | None, exponent: float) -> dict[str, float]:
    """Target shares of the values found: the given weights (none: 0) to a sum of 1, or else the tempered shares."""
    if given is None:
        return tempered(found, exponent)
    weights = {k: float(given.get(k, 0.0)) for k in found}
    whole = sum(weights.values())
    if whole <= 0 or min(weights.values()) < 0:
        raise ValueError("targets must be non-negative and name a value that has tokens")
    return {k: v / whole for k, v in weights.items()}


def calibrated(cells: DataFrame, exponents: dict[str, float], share: float, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells (dimensions, tokens) with probability."""
    spark = cells.sparkSession
    cells = cut(cells)
    some = cells.where("tokens > 0")
    schema = "source string, lang string, topic string, probability double"
    totals, targets, values = [], [], []
    for name in DIMENSIONS:
        found = dict(sorted((r[0], float(r[1])) for r in some.groupBy(name).agg(F.sum("tokens")).collect()))
        goal = wanted(found, (given or {}).get(name), exponents.get(name, 1.0)) if found else {}
        values.append((name, list(found)))
        totals.append(np.array(list(found.values())))
        targets.append(np.array([goal[x] for x in found]))
    if not len(totals[0]):
        return spark.createDataFrame([], schema)
    sizes = [len(t) for t in totals]
    if some.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS:
        rows = sorted((r.source, r.lang, r.topic, r.tokens) for r in some.collect())
        codes = []
        for n, (_, listed) in enumerate(values):
            number = {v: k for k, v in enumerate(listed)}
            codes.append(np.array([number[r[n]] for r in rows]))
        factors = fit_share(_array_sums(np.array([r[3] for r in rows], dtype=float), codes, sizes), totals, targets, share, ROUNDS, TOLERANCE)
        p = np.minimum(1.0, _product(factors, codes))
        return spark.createDataFrame([(*r[:3], float(q)) for r, q in zip(rows, p, strict=True)], schema)
    coded = _coded(some, values)
    factors = fit_share(_frame_sums(coded, sizes), totals, targets, share, ROUNDS, TOLERANCE)
    return _with_product(coded, values, factors, "product").select(*DIMENSIONS, F.least(F.lit(1.0), F.col("product")).alias("probability"))


#: Shares of sources are flattened most, languages less; topics keep their shares.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
SHARE = 0.5


def _uniform(seed: int, key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def mix_sources(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None, exponents: dict[str, float] | None = None, share: float = SHARE, seed: int = 11,
) -> DataFrame:
    """Inclusion of each document in a sample with target shares of source, language and topic; one row for each input row.

    Returns id_col, source, lang, topic, n_tokens, probability and kept. targets has weights of values by dimension ("source",
    "lang", "topic"; a value that a named dimension leaves out gets 0). The targets of a dimension without them are its token shares to the power
    in exponents. The sample has its targets in expectation. It has the given share of all tokens, or the largest smaller one at which
    no probability exceeds 1 (a value cannot give more tokens than it has); mix_report tells what is reached. A document is kept if a uniform hash of its id and
    the seed is below its probability, so repeated rows stay or go together, and results do not depend on partitions. Null sources,
    languages and topics are values of their own, named (null). Without topic_col the topic is a stand-in (topics_of). Documents
    without words have probability 1. Null ids hash like any value. An empty table gives an empty table.
    """
    rows = cut(describe(documents, id_col, text_col, source_col, lang_col, topic_col))
    p = _probabilities(rows, targets, exponents, share)
    out = rows.join(p, list(DIMENSIONS), "left").withColumn("probability", F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(1.0))).otherwise(1.0))
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "probability", (_uniform(seed, F.col("id")) < F.col("probability")).alias("kept"))


def _probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None, exponents: dict[str, float] | None, share: float) -> DataFrame:
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    return calibrated(cells, EXPONENTS if exponents is None else exponents, share, targets)


def mix_report(result: DataFrame, exponents: dict[str, float] | None = None) -> DataFrame:
    """(dimension, value, target, achieved, available): shares of tokens in the targets, in mix_sources' result as expected, and in the input."""
    exponents = EXPONENTS if exponents is None else exponents
    parts = []
    for name in DIMENSIONS:
        sums = result.where("n_tokens > 0").groupBy(F.col(name).alias("value")).agg(F.sum("n_tokens").cast("double").alias("all"), F.sum(F.col("n_tokens") * F.col("probability")).alias("kept"))
        raised = F.pow("all", F.lit(float(exponents.get(name, 1.0))))
        whole = sums.agg(F.sum(raised).alias("r"), F.sum("kept").alias("k"), F.sum("all").alias("a"))
        parts.append(sums.crossJoin(F.broadcast(whole)).select(F.lit(name).alias("dimension"), "value", (raised / F.col("r")).alias("target"), (F.col("kept") / F.col("k")).alias("achieved"), (F.col("all") / F.col("a")).alias("available")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def keep_sample(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None, exponents: dict[str, float] | None = None, share: float = SHARE, seed: int = 11,
) -> DataFrame:
    """The rows that mix_sources keeps, with all their columns.

    Each row is decided where it is read, by its cell's probability and the hash of its id; rows are not shuffled. More than DRIVER_CELLS
    cells are joined instead.
    """
    p = cut(_probabilities(describe(documents, id_col, text_col, source_col, lang_col, topic_col), targets, exponents, share))
    names = [f"_lumenlog_{n}" for n in range(6)]
    while set(names) & set(documents.columns):
        names = [f"_{n}" for n in names]
    text = F.col(text_col).cast("string")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    if p.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS:
        table = documents.sparkSession.sparkContext.broadcast({(r.source, r.lang, r.topic): r.probability for r in p.collect()})  # DRIVER_CELLS entries at most
        keys = documents.select(*columns, text.alias(names[0]), _value(source_col).alias(names[1]), _value(lang_col).alias(names[2]), (_value(topic_col) if topic_col else F.lit(None).cast("string")).alias(names[3]), _uniform(seed, F.col(id_col)).alias(names[4]))
        width = len(documents.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, names[0]):
                own = [batch.column(width + n) for n in range(5)]
                sizes, topic = topics_of(own[0])
                topics = own[3].to_pylist() if topic_col else [f"t{t}" if t >= 0 else "" for t in topic]
                chance = np.array([table.value.get(key, 1.0) for key in zip(own[1].to_pylist(), own[2].to_pylist(), topics, strict=True)])
                keep = own[4].to_numpy() < np.where(sizes > 0, chance, 1.0)
                yield batch.select(list(range(width))).filter(pa.array(keep))

        return keys.mapInArrow(run, documents.schema)
    p = p.select(*(F.col(c).alias(n) for c, n in zip((*DIMENSIONS, "probability"), names[:4], strict=True)))
    rows = documents.withColumn(names[4], _value(topic_col) if topic_col else hashed_topic(text))
    same = (_value(source_col) == F.col(names[0])) & (_value(lang_col) == F.col(names[1])) & (F.col(names[4]) == F.col(names[2]))
    chance = F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.coalesce(F.col(names[3]), F.lit(1.0))).otherwise(1.0)
    return rows.join(p, same, "left").where(_uniform(seed, F.col(id_col)) < chance).select(*columns)
