"""Quality rules: base rules on a text's own statistics, then robust multivariate outliers per language and source.

The statistics of a document become a vector of five transformed features, in whole thousandths. For each (lang, source), each language
and the whole table, location and scatter are minimum covariance determinant estimates over the documents that pass the base rules:

* ``STARTS`` starts of up to ``SEEDS`` points each, drawn by md5 order, so every run draws the same ones;
* concentration steps of all starts at once: the half of the rows with the smallest distances gives the next mean and covariance. A
  start stands still when its determinant falls no more, and the least determinant wins. Rows at the edge of the half, a narrow
  band of distances, share what is left of it equally, so copies and ties are treated alike;
* reweighting: mean and covariance of all rows within the 0.975 quantile.

Covariances are scaled to be consistent at the normal distribution. Features that are zero in most documents, or a group of copies, make
them singular, so the determinants are those of the regularised estimator: the squares of ``LEAST_SPREAD`` are added on the
diagonal in starts, steps and results alike, under which a step never raises the determinant.
The estimate of a group of n documents is shrunk towards that of its language by n / (n + ``PRIOR``), that of a language
likewise towards the whole table's, which leans in the same way on the smallest spreads alone. So no size is a special case.
A document is rejected when its squared Mahalanobis distance exceeds ``CUTOFF``.

Every pass is one aggregate over a stored table of distinct points, combined map-side into sums per start and band of
distances, so a group with a third of all rows costs no more than any other; the half is cut on these few bands. All sums are of whole
numbers, so the result does not depend on the partitioning. Nothing is sampled but the starts; texts are read once and never shuffled.

Defined cases: a null or empty text has no words and fails; null languages and sources are values of their own; a table
without rows gives none, and ``distance`` is null only where no document at all passes the base rules; repeated rows count and are
judged each. Only ``doc_id, text, lang, source`` are read by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.llm.tables import body, small
from sparkrules.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS, REPEAT_SHARE, REPEAT_RUN = 50, 50, 3
#: What makes the covariance of the nearest half consistent in five dimensions: 0.5 / P(chi2_7 <= chi2_5 quantile of 0.5).
HALF_CONSISTENCY = 1.9122
#: The 0.975 quantile of chi-square with five degrees of freedom, and the same factor for it.
REWEIGHT, REWEIGHT_CONSISTENCY = 12.8325, 1.0555
STARTS, SEEDS, STILL = 4, 6, 1e-3
#: Bands of distances per doubling; documents that an estimate borrows from the next wider one.
BANDS, PRIOR = 32, 30
#: About the 1 - 1e-9 quantile of chi-square with five degrees of freedom.
CUTOFF = 51.0
#: Features in thousandths: log words, log characters per word, and the roots of the shares of symbols, copied lines, repeats.
SCALE, LEAST_SPREAD = 1000, (1000, 60, 50, 120, 120)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
P = range(len(LEAST_SPREAD))
PAIRS = [(i, j) for i in P for j in range(i + 1)]
POINT = [f"x{i}" for i in P]
MOMENTS = ["s", *[f"s{i}" for i in P], *[f"s{i}{j}" for i, j in PAIRS]]
FACTORS = [*[f"m{i}" for i in P], *[f"l{i}{j}" for i, j in PAIRS]]


def measured(docs: DataFrame, *carry: Column) -> DataFrame:
    """``carry`` and, per document, the statistics (long), ``base_failed``, the group key and the features ``x0..x4``."""
    df = docs.select(*carry, F.to_json(F.struct("lang", "source")).alias("_group"), F.to_json(F.struct("lang")).alias("_wide"), body().alias("_text"))
    keep = [c for c in df.columns if c != "_text"]
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    df = df.select(*keep, F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_w"), lines.alias("_l"), F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    keep.append("n_symbols")
    # every run of three words as (hash, place), sorted: equal runs become neighbours
    places = F.when(F.size("_w") >= REPEAT_RUN, F.sequence(F.lit(0), F.size("_w") - REPEAT_RUN)).otherwise(F.expr("cast(array() as array<int>)"))
    runs = F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get("_w", i + k) for k in range(REPEAT_RUN)]).alias("h"), i.alias("i")))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(runs).alias("_r"),
    )
    keep += ["n_words", "word_chars", "_lines", "n_dup_lines"]
    pairs = F.zip_with("_r", F.slice("_r", 2, F.size("_r") + 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    found = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    df = df.select(*keep, found.alias("_at"))
    steps = F.zip_with("_at", F.slice("_at", 2, F.size("_at") + 1), lambda a, b: F.least(b - a, F.lit(REPEAT_RUN)))
    df = df.select(*keep, F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x).alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    features = (
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return df.select(*[c for c in keep if c != "_lines"], "n_repeat_words", failed.alias("base_failed"), *[F.floor(SCALE * x + 0.5).alias(f"x{i}") for i, x in enumerate(features)])


def _moments(weight: Column) -> list[Column]:
    """Sums of whole numbers: rows, features, products of features."""
    x = [F.col(name) for name in POINT]
    sums = [weight, *[weight * x[i] for i in P], *[weight * x[i] * x[j] for i, j in PAIRS]]
    return [F.sum(value).alias(name) for name, value in zip(MOMENTS, sums)]


def _scatter(df: DataFrame, consistency: float, *keys: str) -> DataFrame:
    """Means ``m*`` and scaled covariances ``c*`` of the moments."""
    n = F.col("s").cast("double")
    mean = [F.col(f"s{i}") / n for i in P]
    spread = [(consistency * (F.col(f"s{i}{j}") / n - mean[i] * mean[j])).alias(f"c{i}{j}") for i, j in PAIRS]
    return df.select(*keys, *[mean[i].alias(f"m{i}") for i in P], *spread)


def _factored(groups: DataFrame, *keys: str) -> DataFrame:
    """Means and covariances to means, the lower Cholesky factor ``l*`` of the regularised covariance, and ``logdet``."""
    df = groups
    for j in P:
        for i in range(j, len(P)):
            rest = F.col(f"c{i}{j}") + (float(LEAST_SPREAD[i] ** 2) if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return df.select(*keys, *FACTORS, (2 * sum((F.ln(f"l{i}{i}") for i in P[1:]), F.ln("l00"))).alias("logdet"))


def _distance() -> Column:
    solved: list[Column] = []
    for i in P:
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _starts(points: DataFrame) -> DataFrame:
    """``key, start`` and the factors of each start; ``logdet`` is infinite, since so few points aren't a half."""
    drawn = Window.partitionBy("key").orderBy(F.md5(F.concat_ws(" ", "key", *POINT)), *POINT)
    seeds = points.withColumn("_r", F.row_number().over(drawn)).filter(F.col("_r") <= STARTS * SEEDS)
    sums = seeds.groupBy("key", (F.col("_r") % STARTS).alias("start")).agg(*_moments(F.lit(1)))
    return _factored(_scatter(sums, 1.0, "key", "start"), "key", "start").withColumn("logdet", F.lit(math.inf))


def _concentrated(points: DataFrame, starts: DataFrame) -> DataFrame:
    """One step of every start that still moves: the factors of its nearest half, if they have a smaller determinant."""
    moving = starts.filter("moving")
    band = F.floor(BANDS * F.log2(F.greatest(_distance(), F.lit(1e-9)))).alias("band")
    bands = points.join(small(moving), "key").select("key", "start", "w", *POINT, band).groupBy("key", "start", "band").agg(*_moments(F.col("w")))
    by, exact = Window.partitionBy("key", "start"), "decimal(38,0)"
    before = F.coalesce(F.sum("s").over(by.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = bands.withColumn("_n", F.sum("s").over(by)).withColumn("_before", before)
    # one more than half; the usual share for the dimension isn't needed, since the matrix is regular with fewer rows too
    cut = cut.withColumn("_h", F.floor(F.col("_n") / 2) + 1).filter("_before < _h")
    whole = F.col("_before") + F.col("s") <= F.col("_h")
    sums = [F.sum(F.when(whole, F.col(name).cast("decimal(28,0)"))).cast(exact).alias(f"a_{name}") for name in MOMENTS]
    edge = [F.max(F.when(~whole, F.col(name))).alias(f"b_{name}") for name in MOMENTS]  # one band at most
    half = cut.groupBy("key", "start").agg(*sums, *edge, F.max(F.when(~whole, (F.col("_h") - F.col("_before")) / F.col("s"))).alias("share"))
    value = lambda name: F.coalesce(F.col(f"a_{name}").cast("double"), F.lit(0.0)) + F.coalesce(F.col("share") * F.col(f"b_{name}"), F.lit(0.0))
    new = _factored(_scatter(half.select("key", "start", *[value(name).alias(name) for name in MOMENTS]), HALF_CONSISTENCY, "key", "start"), "key", "start")
    old = moving.select("key", "start", F.struct(*FACTORS, "logdet").alias("old"))
    both = new.select("key", "start", F.struct(*FACTORS, "logdet").alias("new")).join(old, ["key", "start"])
    falls = F.col("new.logdet") < F.col("old.logdet") - STILL
    better = both.select("key", "start", falls.alias("moving"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("f")).select("key", "start", "f.*", "moving")
    return better.unionByName(starts.filter("not moving"))


def estimated(points: DataFrame) -> DataFrame:
    """``key``, its number of rows ``n``, means ``m*`` and covariances ``c*`` from a stored table ``key, w, x*`` of distinct points."""
    starts = stored(_starts(points).withColumn("moving", F.lit(True)))
    while not starts.filter("moving").isEmpty():  # determinants fall by a least step and are bounded from below, so it ends
        starts = stored(_concentrated(points, starts))
    best = stored(starts.groupBy("key").agg(F.min(F.struct("logdet", "start", *FACTORS)).alias("f")).select("key", *[f"f.{name}" for name in FACTORS]))
    near = points.join(small(best), "key").filter(_distance() <= REWEIGHT).groupBy("key").agg(*_moments(F.col("w")))
    return _scatter(near, REWEIGHT_CONSISTENCY, "key").join(points.groupBy("key").agg(F.sum("w").alias("n")), "key")


def _shrunk(own: DataFrame, wide: DataFrame, by: str, *keys: str) -> DataFrame:
    """``own(by, *keys, n, m*, c*)`` drawn towards ``wide(by, m*, c*)``, whose values alone hold where ``n`` is null."""
    values = [*[f"m{i}" for i in P], *[f"c{i}{j}" for i, j in PAIRS]]
    share = F.coalesce(F.col("n"), F.lit(0)) / (F.coalesce(F.col("n"), F.lit(0)) + PRIOR)
    wide = wide.select(by, *[F.col(name).alias(f"w_{name}") for name in values])
    mixed = [(share * F.coalesce(F.col(name), F.lit(0.0)) + (1 - share) * F.col(f"w_{name}")).alias(name) for name in values]
    return own.join(small(wide), by).select(by, *keys, *mixed)


def judged(rows: DataFrame) -> DataFrame:
    """Rows of ``measured`` (a stored table) with ``distance`` and ``kept``."""
    levels = [F.concat(F.lit("group "), "_group"), F.concat(F.lit("lang "), "_wide"), F.lit("all")]
    distinct = rows.filter(~F.col("base_failed")).groupBy("_group", "_wide", *POINT).agg(F.count(F.lit(1)).alias("w"))
    points = stored(distinct.select(F.explode(F.array(*levels)).alias("key"), "w", *POINT))
    found = stored(estimated(points))
    keys = stored(rows.select("_group", "_wide").distinct().select(levels[0].alias("g"), levels[1].alias("l"), levels[2].alias("a"), "_group"))
    none = [F.lit(0.0).alias(f"c{i}{j}") for i, j in PAIRS]  # the smallest spreads alone
    spreads = stored(found.filter("key = 'all'").select(F.col("key").alias("a"), *[f"m{i}" for i in P], *none))
    of = lambda name, *more: keys.select(name, *more).distinct().join(found.withColumnRenamed("key", name), name, "left")
    table = stored(_shrunk(of("a"), spreads, "a"))
    langs = stored(_shrunk(of("l", "a"), table, "a", "l"))
    groups = stored(_factored(_shrunk(of("g", "l", "_group"), langs, "l", "_group"), "_group"))
    out = rows.join(small(groups), "_group", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return out.withColumn("kept", kept).select(*[c for c in rows.columns if not c.startswith(("_", "x"))], "distance", "kept")


def report(docs: DataFrame) -> DataFrame:
    """Every document with its statistics, ``base_failed``, ``distance`` and ``kept``."""
    return judged(stored(measured(docs, F.col("doc_id")))).select("doc_id", *STATISTICS, "base_failed", "distance", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Rows are stored beside their features, so no join can mix rows up."""
    return judged(stored(measured(docs, F.struct("*").alias("row")))).filter("kept").select("row.*")
