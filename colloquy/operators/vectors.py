"""Vectors: hash embedding, nearest centres, margins, seeded k-means and the choice of k."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dot

WORD = re.compile("[a-z][a-z0-9]{1,}")
ROUNDS, SEED = 25, 12345


def hash_vector(text: str, dims: int = 384) -> np.ndarray:
    """A unit bag-of-words vector: a word adds 1 to one place and 0.5 to another, by its FNV-1a hash."""
    v = np.zeros(dims, dtype=np.float32)
    for word in WORD.findall(text.lower()):
        h = 2166136261
        for c in word.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        signed = h - (1 << 32) if h >= 1 << 31 else h
        v[abs(signed) % dims] += 1
        v[abs(signed >> 8) % dims] += 0.5
    norm = np.float32(np.sqrt(np.sum(v.astype(np.float64) ** 2))) or np.float32(1)
    return v / norm


Embedder = Callable[[pd.Series], pd.Series]


def embed(texts: DataFrame, text: str, name: str = "embedding", embedder: Embedder | None = None) -> DataFrame:
    """texts with a vector column, from any function of a series of texts; the hash embedding by default."""
    function = embedder or (lambda s: s.map(lambda t: hash_vector(t).tolist()))

    def batch(s: pd.Series) -> pd.Series:
        return function(s)

    return texts.withColumn(name, F.pandas_udf(batch, "array<float>")(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 512)))


def similarities(vectors: DataFrame, centres: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every vector with every centre (idx, centre). Centres are a frozen model of a few dozen rows, and are broadcast."""
    return vectors.crossJoin(F.broadcast(centres)).withColumn("sim", dot(F.col(vector), F.col("centre")))


def nearest_centre(vectors: DataFrame, centres: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The centre of the greatest dot product; the lowest index in a tie. The maximum merges before the shuffle."""
    best = F.max(F.struct("sim", (-F.col("idx")).alias("at")))
    out = similarities(vectors, centres, vector).groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, (-F.col("b.at")).alias("idx"), F.col("b.sim").alias("sim"))


def top_two(vectors: DataFrame, centres: DataFrame, keys: list[str], least: float, margin: float, vector: str = "embedding") -> DataFrame:
    """The best centre, by how much it beats the next, and whether both suffice."""
    sims = similarities(vectors, centres, vector)
    best = F.slice(F.sort_array(F.collect_list(F.struct("sim", (-F.col("idx")).alias("at"))), asc=False), 1, 2)
    out = sims.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.get("b", F.lit(0))["at"]).alias("idx"), F.get("b", F.lit(0))["sim"].alias("sim"), F.get("b", F.lit(1))["sim"].alias("second"))
    return out.withColumn("anchored", (F.col("sim") >= least) & (F.col("sim") - F.coalesce("second", F.lit(-1.0)) >= margin))


def covers(items: DataFrame, installed: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The installed description (name, centre) nearest to each item, if near enough; the first name in a tie."""
    sims = items.crossJoin(F.broadcast(installed)).withColumn("sim", dot(F.col("embedding"), F.col("centre"))).where(F.col("sim") >= least)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sim"), "name"))
    return sims.withColumn("rank", rank).where("rank = 1").select(*keys, "name", "sim")


def random_numbers(seed: int = SEED):
    """The generator that seeding relies on; its products round in doubles, as they must."""
    s = float(seed)
    while True:
        s = float(int(s * 1103515245.0 + 12345.0) % 2**32 & 0x7FFFFFFF)
        yield s / 0x7FFFFFFF


def seeded(x: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """k of the unit vectors, drawn by their distances to those before with the seeded generator, in the order of rows."""
    n, draw = len(x), random_numbers(seed)
    wide = x.astype(np.float64)
    centres = [x[int(np.floor(next(draw) * n))]]
    best = wide @ centres[0].astype(np.float64)
    while len(centres) < k:
        far = 1 - best
        i = min(int(np.searchsorted(np.cumsum(far), next(draw) * float(np.sum(far)), side="left")), n - 1)
        centres.append(x[i])
        best = np.maximum(best, wide @ x[i].astype(np.float64))
    return np.stack(centres).astype(np.float32)


def kmeans(x: np.ndarray, k: int, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Assignment and unit centres of unit vectors; the assignment is that before the last move of the centres."""
    wide, c = x.astype(np.float64), (seeded(x, k) if seeds is None else seeds[:k]).copy()
    for _ in range(ROUNDS):
        assign = np.argmax(wide @ c.T.astype(np.float64), axis=1)
        for j in range(k):
            if (mine := assign == j).any():
                c[j] = _unit(wide[mine].sum(axis=0))
    return assign, c


def silhouette(x: np.ndarray, assign: np.ndarray, centres: np.ndarray) -> float:
    """Mean simplified silhouette: the own centre against the next."""
    sims = x.astype(np.float64) @ centres.T.astype(np.float64)
    rows = np.arange(len(x))
    own = sims[rows, assign].copy()
    sims[rows, assign] = -2
    a, b = 1 - own, 1 - sims.max(axis=1)
    return float(np.mean((b - a) / np.maximum(np.maximum(a, b), 1e-9)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column).astype(np.float32)


def _ordered(vectors: DataFrame, order: list[str]) -> DataFrame:
    """record, part, embedding: the vectors in order, in parts that are ranges of it, so that they can be summed up part by part."""
    own = vectors.repartitionByRange("record", *order).sortWithinPartitions("record", *order)
    return own.select("record", "embedding", F.spark_partition_id().alias("part"))


def _farness(x: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    """What a draw weighs vectors by: one less the nearest of the centres; the same for all before there are any."""
    return np.ones(len(x)) if centres is None else 1 - (x.astype(np.float64) @ centres.T.astype(np.float64)).max(axis=1)


def _part_sums(own: DataFrame, centres: dict[str, np.ndarray]) -> dict[str, list[tuple[int, float]]]:
    """The weight of each part of each record, in order: as many numbers as there are tasks."""

    def add(batches):
        totals: dict[tuple[str, int], float] = {}
        for batch in batches:
            for at, rows in batch.groupby(["record", "part"]):
                totals[at] = totals.get(at, 0.0) + float(_farness(_matrix(rows["embedding"]), centres.get(at[0])).sum())
        if totals:
            yield pd.DataFrame([(*at, v) for at, v in totals.items()], columns=["record", "part", "total"])

    found: dict[str, list[tuple[int, float]]] = {}
    # A number for each task: they are sorted here, rather than by three more jobs for each draw.
    for row in sorted(own.mapInPandas(add, "record string, part int, total double").collect(), key=lambda row: (row["record"], row["part"])):
        found.setdefault(row["record"], []).append((row["part"], row["total"]))
    return found


def _within_parts(own: DataFrame, centres: dict[str, np.ndarray], wanted: dict[str, tuple[int, float]]) -> dict[str, np.ndarray]:
    """The vector at which the weights of a part, from its first on, add up to what is wanted of each record (part, weight)."""

    def pick(batches):
        state = {r: [rest, None, False] for r, (_, rest) in wanted.items()}
        for batch in batches:
            for r, rows in batch.groupby("record"):
                if not state[r][2]:
                    x = _matrix(rows["embedding"])
                    upto = np.cumsum(_farness(x, centres.get(r)))
                    i = int(np.searchsorted(upto, state[r][0], side="left"))
                    state[r] = [state[r][0] - upto[-1], x[min(i, len(x) - 1)], i < len(x)]
        found = [(r, x.tolist()) for r, (_, x, _) in state.items() if x is not None]
        if found:
            yield pd.DataFrame(found, columns=["record", "x"])

    here = [(F.col("record") == r) & (F.col("part") == part) for r, (part, _) in wanted.items()]
    test = here[0]
    for h in here[1:]:
        test = test | h
    return {row["record"]: np.array(row["x"], dtype=np.float32) for row in own.where(test).mapInPandas(pick, "record string, x array<float>").collect()}


def _seeds(own: DataFrame, sizes: dict[str, int], most: int) -> dict[str, np.ndarray]:
    """The first `most` centres of each record as `seeded` draws them, those of any smaller k first.

    A draw is a place in the prefix sums of weights over the vectors in order. Sums of parts tell in which
    part it is, and only there weights are added up one by one.
    """
    draws, found = {r: random_numbers() for r in sizes}, {r: [] for r in sizes}
    for turn in range(min(most, max(sizes.values(), default=0))):
        centres, wanted = {r: np.stack(c) for r, c in found.items() if c}, {}
        for r, parts in _part_sums(own, centres).items():
            if turn < sizes[r]:
                upto = np.cumsum([total for _, total in parts])
                # The first is a row number from 0, those after it places in the weights.
                rest = np.floor(next(draws[r]) * sizes[r]) + 1 if turn == 0 else next(draws[r]) * upto[-1]
                at = min(int(np.searchsorted(upto, rest, side="left")), len(parts) - 1)
                wanted[r] = (parts[at][0], float(rest - (upto[at - 1] if at else 0)))
        for r, x in _within_parts(own, centres, wanted).items() if wanted else ():
            found[r].append(x)
    return {r: np.stack(c) for r, c in found.items()}


def _unit(total: np.ndarray) -> np.ndarray:
    mean = total.astype(np.float32)
    return (mean / (np.sqrt(np.sum(mean.astype(np.float64) ** 2)) or 1)).astype(np.float32)


def cluster(vectors: DataFrame, ks: list[int], key: str = "vec_id", order: list[str] | None = None) -> DataFrame:
    """(record, k, silhouette, centres, before) for each k: seeded k-means over all vectors of each record.

    order: columns by which vectors are seeded, the key by default. before: the centres that the last
    assignment was made by, from which `centres` were moved once. A round is one pass over the vectors for
    all k together: each task sums up its vectors by centre, and the sums are added. Only the centres, k of
    each k and record, go to the driver and back. A k above the number of a record's vectors is left out.
    """
    spark = vectors.sparkSession
    own = _ordered(vectors, order or [key]).persist()
    try:
        sizes = {r["record"]: r["n"] for r in own.groupBy("record").agg(F.count(F.lit(1)).alias("n")).collect()}
        seeds = _seeds(own, sizes, max(ks))
        model = {(r, k): seeds[r][:k].copy() for r, n in sizes.items() for k in ks if k <= n}
        before, moving = model, set(model)
        for _ in range(ROUNDS):  # or fewer, once no centre moves
            before, sums = model, _sums(own, {at: model[at] for at in moving})
            model = {at: np.stack([_unit(sums[(*at, c)]) if (*at, c) in sums else x for c, x in enumerate(centres)]) for at, centres in model.items()}
            # A number of clusters whose centres stay is done: only the others need another pass.
            moving = {at for at in moving if not np.array_equal(before[at], model[at])}
            if not moving:
                break
        scores = _silhouettes(own, before, model)
    finally:
        own.unpersist()
    rows = [(r, k, float(scores[r, k] / sizes[r]) if k > 1 else 0.0, model[r, k].tolist(), before[r, k].tolist()) for r, k in model]
    return spark.createDataFrame(rows, "record string, k int, silhouette double, centres array<array<float>>, before array<array<float>>")


def _sums(own: DataFrame, model: dict[tuple[str, int], np.ndarray]) -> dict[tuple[str, int, int], np.ndarray]:
    """The sum of the vectors nearest to each centre, by (record, k, centre)."""

    def add(batches):
        totals: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for r, part in batch.groupby("record"):
                x = _matrix(part["embedding"]).astype(np.float64)
                for (of, k), centres in model.items():
                    if of == r:
                        assign = np.argmax(x @ centres.T.astype(np.float64), axis=1)
                        for c in np.unique(assign).tolist():
                            totals[r, k, c] = totals.get((r, k, c), 0) + x[assign == c].sum(axis=0)
        if totals:
            yield pd.DataFrame([(*at, v.tolist()) for at, v in totals.items()], columns=["record", "k", "c", "total"])

    parts = own.select("record", "embedding").mapInPandas(add, "record string, k int, c int, total array<double>")
    # A row for each centre and task: lists are as long as there are tasks.
    sums = parts.groupBy("record", "k", "c").agg(F.collect_list("total").alias("all"))
    sums = sums.select("record", "k", "c", F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda u, v: u + v)).alias("total"))
    return {(row["record"], row["k"], row["c"]): np.array(row["total"]) for row in sums.collect()}


def _silhouettes(own: DataFrame, before: dict[tuple[str, int], np.ndarray], model: dict[tuple[str, int], np.ndarray]) -> dict[tuple[str, int], float]:
    """Sums of the simplified silhouette, of the assignment before the last move of the centres."""

    def score(batches):
        totals: dict[tuple[str, int], float] = {}
        for batch in batches:
            for r, part in batch.groupby("record"):
                x = _matrix(part["embedding"])
                for (of, k), centres in model.items():
                    if of == r and k > 1:
                        assign = np.argmax(x.astype(np.float64) @ before[r, k].T.astype(np.float64), axis=1)
                        totals[r, k] = totals.get((r, k), 0.0) + silhouette(x, assign, centres) * len(x)
        if totals:
            yield pd.DataFrame([(*at, v) for at, v in totals.items()], columns=["record", "k", "total"])

    found = own.select("record", "embedding").mapInPandas(score, "record string, k int, total double").groupBy("record", "k").agg(F.sum("total").alias("total"))
    return {(row["record"], row["k"]): row["total"] for row in found.collect()}


def derive_k(fits: DataFrame, eps: float = 0.01) -> DataFrame:
    """The largest k whose silhouette is within eps of the best."""
    best = fits.withColumn("peak", F.max("silhouette").over(Window.partitionBy("record")))  # a row for each k
    return best.where(F.col("silhouette") >= F.col("peak") - eps).groupBy("record").agg(F.max_by(F.struct("k", "silhouette", "centres", "before"), "k").alias("b")).select("record", "b.*")


def centres_of(chosen: DataFrame, which: str = "centres") -> DataFrame:
    """record, idx, centre of each; which: "before" for those that members were assigned by."""
    return chosen.select("record", F.posexplode(which).alias("idx", "centre"))
