"""Quality rules: base statistics of every text, then multivariate outliers by regularised minimum-covariance-determinant
estimates per language and source. DataFrame and SQL functions only.

Each group takes several deterministic starts (STARTS, norms of the coordinates scaled by median and quartile range). A
concentration step keeps the share H of rows with the smallest distances and re-estimates centre and covariance from
them, which never raises the determinant. After two steps from each start, the one of the smallest determinant goes on until
no group's determinant changes, or for STEPS steps. Quantiles are read from histograms of counts per group, so groups are never gathered:
every pass is a partial aggregation. A fixed ridge (the squared FLOOR of each statistic) belongs to every covariance whose determinant
is compared; it keeps small or constant groups invertible and ordinary variation inside the ellipse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialize, scratch

#: Base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group's rows behind its estimates, most steps after the choice of a start, and the tail probability beyond which a row goes.
H, STEPS, TAIL = 0.75, 8, 1e-3
#: First distances: sum of squares, largest and sum of the scaled coordinates.
STARTS = ("squares", "largest", "sum")
#: Sources with fewer rows in a language are estimated together, and languages that are still smaller than this together.
MIN_GROUP, POOL = 50, "\0"
#: Smallest spread taken for each transformed statistic.
FLOORS = {"log_words": 1.0, "log_word_chars": 0.25, "root_symbols": 0.05, "root_dup_lines": 0.15, "root_repeats": 0.15}
_WHITE = "\t\n\x0b\x0c\r"
_GROUP, _KEY = ["g_lang", "g_source"], ["e_lang", "e_source"]
_X = list(FLOORS)


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Base columns of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Also g_lang and g_source, the group (null as the empty string). carry adds row, the whole row as a struct.
    Null and empty texts have 0 everywhere.
    """
    text = F.coalesce("text", F.lit(""))
    head = docs.select(
        "doc_id",
        *([F.struct("*").alias("row")] if carry else []),
        F.coalesce("lang", F.lit("")).alias("g_lang"),
        F.coalesce("source", F.lit("")).alias("g_source"),
        F.length(F.translate(text, " " + _WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.array_remove(F.split(F.translate(text, _WHITE, " " * 5), " "), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + _WHITE, "") != "").alias("_lines"),
    )
    keep = ["doc_id", *(["row"] if carry else []), *_GROUP, "word_chars", "n_symbols"]
    grams = head.select(
        *keep,
        F.size("_w").cast("bigint").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_w) > 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END").alias("_h"),
    )
    # Most texts repeat no window; only those that do are sorted by it.
    keep += ["n_words", "n_dup_lines"]
    grams = grams.select(*keep, F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS g, i AS p))) END").alias("_g"))
    # Positions of windows found twice or more, in order; each adds the words that the one before doesn't cover.
    found = grams.select(*keep, F.expr("sort_array(transform(filter(_g, (x, i) -> (i > 0 AND _g[i - 1].g = x.g) OR (i < size(_g) - 1 AND _g[i + 1].g = x.g)), x -> x.p))").alias("_p"))
    repeats = F.expr("coalesce(aggregate(_p, named_struct('last', -3, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n), 0L)")
    done = found.select(*keep, repeats.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return done.withColumn("base_failed", failed)


def transformed(stats: DataFrame) -> list[Column]:
    """The statistic vector behind the estimates."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(words).alias(_X[0]),
        F.log(chars / words).alias(_X[1]),
        F.sqrt(F.col("n_symbols") / chars).alias(_X[2]),
        F.sqrt(F.col("n_dup_lines") / words).alias(_X[3]),
        F.sqrt(F.col("n_repeat_words") / words).alias(_X[4]),
    ]


def chi_square_cdf(x: float, k: int) -> float:
    """Distribution function of the chi-square with k degrees of freedom."""
    term = total = 1.0 / math.gamma(k / 2 + 1)
    n = 0
    while term > total * 1e-17 and n < 10_000:
        n += 1
        term *= (x / 2) / (k / 2 + n)
        total += term
    return min(1.0, total * math.exp(-x / 2) * (x / 2) ** (k / 2)) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return low


def _quantiles(df: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Smallest integer of column value at or above each share of its group's rows, from counts per integer."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    on = ", ".join(key)
    run = counts.select(*key, value, F.expr(f"sum(n) OVER (PARTITION BY {on} ORDER BY {value})").alias("_c"), F.expr(f"sum(n) OVER (PARTITION BY {on})").alias("_n"))
    return run.groupBy(*key).agg(*[F.min(F.when(F.col("_c") >= F.ceil(F.col("_n") * s), F.col(value))).alias(name) for name, s in shares.items()])


def _distance() -> Column:
    """Squared Mahalanobis distance from the estimate beside the row."""
    z = [f"({x} - m_{x})" for x in _X]
    return F.expr(" + ".join(f"{1 if i == j else 2} * p_{i}_{j} * {z[i]} * {z[j]}" for i in range(len(_X)) for j in range(i + 1)))


def _first_distance() -> Column:
    """The distance of the row's start from medians scaled by spreads."""
    z = [f"abs(({x} - m_{x}) / s_{x})" for x in _X]
    forms = {"squares": " + ".join(f"{d} * {d}" for d in z), "largest": f"greatest({', '.join(z)})", "sum": " + ".join(z)}
    return F.expr("CASE start " + " ".join(f"WHEN {i} THEN {forms[name]}" for i, name in enumerate(STARTS)) + " END")


def _medians(v: DataFrame) -> DataFrame:
    """Medians and spreads per group, with one row for each start."""
    grid = 1024
    long = v.select(*_KEY, F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.round(F.col(x) * grid).cast("int").alias("b")) for x in _X])).alias("e")).select(*_KEY, "e.x", "e.b")
    q = _quantiles(long, [*_KEY, "x"], "b", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    cells = [F.max(F.when(F.col("x") == x, F.col("mid") / grid)).alias(f"m_{x}") for x in _X]
    cells += [F.max(F.when(F.col("x") == x, F.greatest((F.col("hi") - F.col("lo")) / (1.349 * grid), F.lit(FLOORS[x])))).alias(f"s_{x}") for x in _X]
    return q.groupBy(*_KEY).agg(*cells).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(STARTS) - 1))).alias("start"))


def _step(v: DataFrame, current: DataFrame, first: bool = False) -> DataFrame:
    """One concentration step of each group and start: centre, inverse covariance, determinant and the one before (null at first)."""
    key = [*_KEY, "start"]
    before = F.lit(None).cast("double") if first else F.col("det")
    distance = _first_distance() if first else _distance()
    d = v.join(current, _KEY).select(*key, *_X, before.alias("_det"), F.round(F.log(distance + 1e-6) * 256).cast("int").alias("_b"))
    # Written first, so that its size is known: while the groups are few, rows aren't shuffled by group at all.
    cut = materialize(_quantiles(d, key, "_b", {"_cut": H}), "cuts")
    near = d.join(cut, key).where("_b <= _cut")
    k = len(_X)
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = near.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.first("_det").alias("before"),
        *[F.expr(f"sum({x}) AS s{i}") for i, x in enumerate(_X)],
        *[F.expr(f"sum({_X[i]} * {_X[j]}) AS c_{i}_{j}") for i, j in cells],
    )
    # Of the H nearest normal rows the covariance is too small by this factor. Text keeps the many small expressions cheap to build.
    factor = H / chi_square_cdf(chi_square_quantile(H, k), k + 2)
    c = lambda i, j: f"p_{max(i, j)}_{min(i, j)}"
    a = sums.selectExpr(
        *key,
        "before",
        "1D AS det",
        *[f"s{i} / n AS m_{x}" for i, x in enumerate(_X)],
        *[f"(c_{i}_{j} / n - s{i} / n * s{j} / n) * {factor!r}D + {FLOORS[_X[i]] ** 2 if i == j else 0.0!r}D AS p_{i}_{j}" for i, j in cells],
    )
    means = [f"m_{x}" for x in _X]
    for p in range(k):  # the sweep of every pivot turns the matrix into its negative inverse; the pivots' product is the determinant
        a = a.selectExpr(*key, "before", f"det * {c(p, p)} AS det", *means, *[(f"-1 / {c(p, p)}" if i == j == p else f"{c(i, j)} / {c(p, p)}" if p in (i, j) else f"{c(i, j)} - {c(i, p)} * {c(j, p)} / {c(p, p)}") + f" AS p_{i}_{j}" for i, j in cells])
    return materialize(a.selectExpr(*key, "before", "det", *means, *[f"-p_{i}_{j} AS p_{i}_{j}" for i, j in cells]), "estimates")


def _estimates(v: DataFrame) -> DataFrame:
    """The estimate of each group that reached the smallest determinant."""
    tried = _step(v, _step(v, materialize(_medians(v), "medians"), first=True))
    best = tried.groupBy(*_KEY).agg(F.min(F.struct("det", "start")).alias("low")).select(*_KEY, F.col("low.start").alias("start"))
    current = materialize(tried.join(best, [*_KEY, "start"]), "estimates")
    for _ in range(STEPS):
        current = _step(v, current)
        if not current.where("abs(det - before) > 1e-12 * before").limit(1).count():
            break
    return current


def _assigned(v: DataFrame) -> DataFrame:
    """The group (e_lang, e_source) that estimates each language and source."""
    sizes = v.groupBy(*_GROUP).agg(F.count("*").alias("n"))
    pools = sizes.where(F.col("n") < MIN_GROUP).groupBy("g_lang").agg(F.sum("n").alias("pool"))
    own, pooled = F.col("n") >= MIN_GROUP, F.col("pool") >= MIN_GROUP
    return sizes.join(pools, "g_lang", "left").select(
        *_GROUP,
        F.when(own | pooled, F.col("g_lang")).otherwise(POOL).alias("e_lang"),
        F.when(own, F.col("g_source")).otherwise(POOL).alias("e_source"),
    )


def judged(docs: DataFrame, carry: bool = False, tail: float = TAIL) -> DataFrame:
    """statistics() with distance (squared Mahalanobis distance) and kept.

    Estimates come from all rows that pass the base rule, per language and source (pooled below MIN_GROUP rows); a row
    that fails it isn't kept, and has no distance where its group has no estimate. A group of any size works: with few
    rows, or none that differ, the ridge alone decides. Rows with null language or source form groups of their own.
    Repeated rows each come back; an empty table gives no rows.
    """
    with scratch() as own:
        stats = materialize(statistics(docs, carry), "statistics")
        passed = stats.where("NOT base_failed").select(*_GROUP, *transformed(stats))
        assigned = materialize(_assigned(passed), "groups")
        v = materialize(passed.join(assigned, _GROUP).select(*_KEY, *_X), "vectors")
        estimate = _estimates(v)
        own.keep(stats, assigned, estimate)
    estimate = estimate.drop("start", "before", "det")
    limit = chi_square_quantile(1 - tail, len(_X))
    joined = stats.select("*", *transformed(stats)).join(assigned.join(estimate, _KEY).drop(*_KEY), _GROUP, "left").withColumn("distance", _distance())
    return joined.select(*stats.columns, "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of docs, columns as given."""
    return judged(docs, carry=True, **options).where("kept").select("row.*")
