"""Operator 9, quality rules: robust multivariate outliers by minimum covariance determinant.

Every document becomes a short vector of transformed statistics. For each language and source the
half of the documents whose covariance has the smallest determinant is searched: from three
deterministic starts (coordinate-wise medians and quartiles, spatial signs, coordinates squeezed by
the hyperbolic tangent), two concentration steps each, and from the start of least determinant then
on, until no cell's determinant falls any more. A document is rejected if its Mahalanobis distance
from the reweighted estimate of that half is too large.

A squared distance of 45 is the cut-off: of normal vectors of six dimensions 5 in 10^8 lie beyond,
so even a large corpus of clean documents loses none to chance, where the usual quantile of 0.975
would take one in forty.

All steps are DataFrame operations. What is estimated per cell are sums, counts and percentiles of
integers, which merge before the shuffle and don't depend on the order of rows, so a hot source is
no hot task and reruns agree to the last digit.

Defined results: a null or empty text has no words and fails the base rules; a null language or
source is a cell of its own; a source with fewer than `min_cell` documents is judged by all
documents of its language, and a language with fewer by all documents; if these are fewer than
`min_cell` as well, their estimate still holds, with the spread floored; with no document that
passes the base rules nothing is estimated. Repeated rows count as often as they occur. Columns of
the input with the names of result columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

#: Resolution of the vectors: integers of 1/4096.
UNIT = 4096
#: Median and 0.975 quantile of the chi-square distribution with six degrees of freedom.
CHI2_MEDIAN, CHI2_975 = 5.348, 14.449
DIMS = 6
X = [f"__x{i}" for i in range(DIMS)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Documents that a cell must have for an estimate of its own.
    min_cell: int = 200
    #: Concentration steps of each start, and the fall of the logarithm of a determinant that calls for another.
    steps: int = 2
    tolerance: float = 1e-3
    #: Least spread of a coordinate: word length, symbols, capitals, marks, repeated lines, repeated words.
    floors: tuple[float, ...] = (0.04, 0.03, 0.03, 0.05, 0.15, 0.15)
    #: Squared distance from which on a document is rejected.
    cutoff: float = 45.0


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the base counts, base_failed, and the transformed vector."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumn("__w", words(F.col("text")))
    own = own.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # Windows of three words, sorted by hash, so that equal ones are neighbours.
    grams = F.transform(
        F.sequence(F.lit(0), F.size("__w") - 3),
        lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("p")),
    )
    own = own.withColumn("__grams", F.when(F.size("__w") >= 4, F.sort_array(grams)))
    twice = F.filter("__grams", lambda g, k: (F.get("__grams", k - 1)["h"] == g["h"]) | (F.get("__grams", k + 1)["h"] == g["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda g: F.array(g["p"], g["p"] + 1, g["p"] + 2))))
    chars = _without(text, " \t\n\x0b\x0c\r")
    own = own.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": chars.cast("long"),
            "n_symbols": (F.length(text) - _without(text, "#*$%&|<>")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.col("__grams").isNotNull(), F.size(covered)), F.lit(0)).cast("long"),
            "__capitals": F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "__marks": F.length(text) - _without(text, "!?"),
            "__n_lines": F.size("__lines"),
        }
    ).drop("__w", "__lines", "__grams")
    n = F.col("n_words")
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)

    def share(part: str, of: str, prior: int) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / (F.col(of) + prior))))

    vector = [
        F.log((F.col("word_chars") + 500) / (n + 100)),
        share("n_symbols", "word_chars", 100),
        share("__capitals", "word_chars", 100),
        share("__marks", "word_chars", 100),
        share("n_dup_lines", "__n_lines", 5),
        share("n_repeat_words", "n_words", 100),
    ]
    own = own.withColumns({"base_failed": failed} | {x: F.round(v * UNIT).cast("long") for x, v in zip(X, vector)})
    return own.drop("__capitals", "__marks", "__n_lines")


def _cells(passed: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(language, source) to the cell that judges it, and to all cells in use that it is part of."""
    groups = materialize(passed.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n")), "mcd-groups")
    by_lang = groups.groupBy("__lang").agg(F.sum("n").alias("__of_lang"))
    cell = (
        F.when(F.col("n") >= rules.min_cell, F.concat_ws("\x01", F.lit("2"), "__lang", "__source"))
        .when(F.col("__of_lang") >= rules.min_cell, F.concat_ws("\x01", F.lit("1"), "__lang"))
        .otherwise(F.lit("0"))
    )
    judged = groups.join(by_lang, "__lang").select("__lang", "__source", cell.alias("__cell"))
    judged = materialize(judged, "mcd-judged")
    used = judged.select(F.col("__cell").alias("__used")).distinct()
    part = groups.select(
        "__lang", "__source",
        F.explode(F.array(F.concat_ws("\x01", F.lit("2"), "__lang", "__source"), F.concat_ws("\x01", F.lit("1"), "__lang"), F.lit("0"))).alias("__cell"),
    )
    return judged, materialize(part.join(used, part["__cell"] == used["__used"], "left_semi"), "mcd-parts")


KEYS = ["__cell", "__start"]
M = [f"__m{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
P = [f"__p{i}{j}" for i, j in PAIRS]


def _moments(subset: DataFrame) -> DataFrame:
    """Sums and sums of products of the integers X by cell and start."""
    return subset.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(x).alias(f"__s{i}") for i, x in enumerate(X)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"__q{i}{j}") for i, j in PAIRS],
    )


def _estimate(sums: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """By cell and start the mean, the inverse of the Cholesky factor of the floored covariance, and the log of its determinant."""
    est = sums.withColumns({m: F.col(f"__s{i}") / F.col("__n") for i, m in enumerate(M)})
    for j in range(DIMS):  # a column of the factor at a time, its diagonal first
        for rows in ([j], range(j + 1, DIMS)):
            column = {}
            for i in rows:
                rest = F.col(f"__q{i}{j}") / F.col("__n") - F.col(f"__m{i}") * F.col(f"__m{j}")
                for k in range(j):
                    rest = rest - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
                if i == j:
                    rest = F.sqrt(F.greatest(rest + (floors[i] * UNIT) ** 2, F.lit((floors[i] * UNIT / 10) ** 2)))
                column[f"__l{i}{j}"] = rest if i == j else rest / F.col(f"__l{j}{j}")
            est = est.withColumns(column) if column else est
    for off in range(DIMS):  # a diagonal of the inverse at a time
        diagonal = {}
        for j in range(DIMS - off):
            total = F.lit(0.0 if off else 1.0)
            for k in range(j, j + off):
                total = total - F.col(f"__l{j + off}{k}") * F.col(f"__p{k}{j}")
            diagonal[f"__p{j + off}{j}"] = total / F.col(f"__l{j + off}{j + off}")
        est = est.withColumns(diagonal)
    determinant = sum((2 * F.log(F.col(f"__l{i}{i}")) for i in range(DIMS)), F.lit(0.0))
    return est.select(*KEYS, *M, *P, determinant.alias("__det"))


def _starts(members: DataFrame, rules: Rules) -> DataFrame:
    """The three starting estimates of each cell."""
    quartiles = members.groupBy("__cell").agg(*[F.percentile(x, [0.25, 0.5, 0.75]).alias(f"c{i}") for i, x in enumerate(X)])
    spread = [F.greatest((F.get(f"c{i}", F.lit(2)) - F.get(f"c{i}", F.lit(0))) / 1.349, F.lit(rules.floors[i] * UNIT)) for i in range(DIMS)]
    middle = quartiles.select("__cell", *[F.get(f"c{i}", F.lit(1)).alias(f"__c{i}") for i in range(DIMS)], *[x.alias(f"__d{i}") for i, x in enumerate(spread)])
    middle = materialize(middle, "mcd-middle")
    z = [(F.col(x) - F.col(f"__c{i}")) / F.col(f"__d{i}") for i, x in enumerate(X)]
    length = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-9))
    whole = lambda values: [F.round(v * UNIT).cast("long").alias(x) for x, v in zip(X, values)]
    kinds = F.array(F.struct(F.lit(1).alias("__start"), *whole([v / length for v in z])), F.struct(F.lit(2).alias("__start"), *whole([F.tanh(v) for v in z])))
    shapes = _estimate(_moments(members.join(middle, "__cell").select("__cell", F.explode(kinds).alias("__k")).select("__cell", "__k.*")), (0.05,) * DIMS)
    # Shapes are of coordinates in spreads around the medians.
    scaled = [(F.col(f"__p{i}{j}") * UNIT / F.col(f"__d{j}")).alias(f"__p{i}{j}") for i, j in PAIRS]
    centre = [F.col(f"__c{i}").cast("double").alias(m) for i, m in enumerate(M)]
    found = shapes.drop(*M, "__det").join(middle, "__cell").select(*KEYS, *centre, *scaled)
    plain = [(1 / F.col(f"__d{j}") if i == j else F.lit(0.0)).alias(f"__p{i}{j}") for i, j in PAIRS]
    return materialize(found.unionByName(middle.select("__cell", F.lit(0).alias("__start"), *centre, *plain)), "mcd-starts")


def _concentrated(members: DataFrame, estimate: DataFrame, rules: Rules, name: str) -> DataFrame:
    """The estimate from the half of each cell that is nearest to the given one."""
    far = members.join(estimate.drop("__det"), "__cell").select(*KEYS, *X, _bin(_distance()).alias("__bin"))
    half = materialize(far.groupBy(*KEYS).agg(F.floor(F.percentile("__bin", 0.5)).alias("__half")), f"mcd-half-{name}")
    return materialize(_estimate(_moments(far.join(half, KEYS).where(F.col("__bin") <= F.col("__half"))), rules.floors), f"mcd-{name}")


def least_determinant(members: DataFrame, rules: Rules) -> DataFrame:
    """The minimum covariance determinant estimate of each cell of members (__cell, X)."""
    estimate = _starts(members, rules)
    for step in range(rules.steps):
        estimate = _concentrated(members, estimate, rules, f"start{step}")
    least = estimate.groupBy("__cell").agg(F.min(F.struct("__det", "__start")).alias("x")).select("__cell", "x.__start")
    best = materialize(estimate.join(least, KEYS, "left_semi"), "mcd-best")
    falls = True
    while falls:  # it ends: each round lowers a determinant by the tolerance, and the floors bound them
        now = _concentrated(members, best, rules, "next").drop("__start").withColumnsRenamed({c: f"{c}_" for c in [*M, *P, "__det"]})
        fell = F.col("__det_") < F.col("__det") - rules.tolerance
        both = best.join(now, "__cell").select(*KEYS, *[F.when(fell, F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in [*M, *P, "__det"]], fell.alias("__fell"))
        both = materialize(both, "mcd-best")
        falls = not both.where("__fell").isEmpty()
        best = both.drop("__fell")
    return best


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns of an estimate."""
    total = F.lit(0.0)
    for i in range(DIMS):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"__p{i}{j}") * (F.col(X[j]) - F.col(f"__m{j}"))
        total = total + y * y
    return total


def _bin(squared: Column) -> Column:
    """Distances as integers, 64 to a doubling, of which exact percentiles merge in bounded memory."""
    return F.floor(F.log2(squared + 1) * 64).cast("int")


def reject_outliers(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """stats (from with_statistics, with lang and source) with distance and kept."""
    given = [c for c in stats.columns if c not in X]
    own = stats.withColumns({"__lang": F.coalesce("lang", F.lit("\x00")), "__source": F.coalesce("source", F.lit("\x00"))})
    own = materialize(own, "mcd-stats")
    passed = own.where(~F.col("base_failed")).select("__lang", "__source", *X)
    judged, parts = _cells(passed, rules)
    members = passed.join(parts, ["__lang", "__source"]).select("__cell", *X)
    estimate = least_determinant(members, rules)
    # Reweighting: scale to the chi-square median, and estimate anew from all that lie inside.
    far = members.join(estimate, "__cell").select(*KEYS, *X, _distance().alias("__d"))
    scale = far.groupBy("__cell").agg((F.pow(F.lit(2.0), F.percentile(_bin(F.col("__d")), 0.5) / 64) / CHI2_MEDIAN).alias("__scale"))
    scale = materialize(scale, "mcd-scale")
    inside = far.join(scale, "__cell").where(F.col("__d") <= CHI2_975 * F.greatest(F.col("__scale"), F.lit(0.1)))
    final = _estimate(_moments(inside), rules.floors)
    verdicts = materialize(judged.join(final, "__cell").drop(*KEYS, "__det"), "mcd-verdicts")
    scored = own.join(verdicts, ["__lang", "__source"], "left")
    kept = ~F.col("base_failed") & F.coalesce(_distance() <= rules.cutoff, F.lit(True))
    scored = scored.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_distance()))).withColumn("kept", kept)
    return scored.select(*[c for c in given if c not in ("distance", "kept")], "distance", "kept")


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs, every row and column, with the base counts, base_failed, distance and kept."""
    return reject_outliers(with_statistics(docs, rules), rules)
