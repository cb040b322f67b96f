"""Quality rules: robust multivariate outliers within each language and source.

Every document becomes a vector of transformed text statistics.  For each (language, source) the
minimum-covariance-determinant estimate of centre and scatter is searched by concentration steps from three
deterministic starts: medians with median absolute deviations, the half of the rows nearest to these, and the
mean and covariance of all rows.  A step keeps the ``support`` share of rows nearest to the centre and estimates again
from those; in the end the start with the smallest determinant wins (the first of equal ones).  The scatter is multiplied by the
consistency factor of the support, and a document is rejected when its squared Mahalanobis distance exceeds the ``sure``
quantile of the chi-squared distribution.

Two things make this behave alike at every size, without a switch:

* A group's estimate counts with its rows beside ``prior`` rows that look like its language, and the language's beside
  ``prior`` rows that look like all documents; so small groups lean on what is around them.
* A statistic of a short text is noisy.  Its deviation is divided by sqrt(1 + noise / (n * variance)), n the words, characters or
  lines that it was counted over.

Only DataFrame functions are used.  Rows never move by group: each step is an
aggregate with map-side combine (exact percentiles over a bounded number of values, moments) and a join of the rows with one row per group.
Statistics are rounded to multiples of 1/4096, so sums of products are exact in
doubles and do not depend on the order in which Spark adds them.  Distances are counted in 256 bins for each doubling; rows in the
last bin are ties and are all kept, so a step's subset is at least the support's share.

Defined results: null or blank text has no words and fails the base rule; null
language or source is a group like any other; repeated rows are judged alike, each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import GAP, let, words
from millrace.plans.staging import cut, discard

SYMBOLS = r"[^#*$%&|<>]+"

#: name, smallest standard deviation that counts (keeps a statistic that is zero in most documents from rejecting all others), sampling noise of one
#: unit (a share's square root has 1/4 if units are independent; here neighbours are alike, so 1), and the unit: words, characters or lines.
FEATURES = (("word_length", 0.05, 0.25, "words"), ("symbols", 0.04, 1.0, "chars"), ("repeats", 0.06, 1.0, "words"), ("dup_lines", 0.10, 0.5, "lines"), ("capitals", 0.04, 1.0, "chars"))
D = len(FEATURES)
#: Bins of the squared distance for each doubling; distances below 2^LOWEST are one bin.
BINS_PER_OCTAVE, LOWEST = 256, -20


def chi_squared(x: float, df: int) -> float:
    """The distribution function of chi-squared with an odd number of degrees of freedom."""
    out = math.erf(math.sqrt(x / 2))
    for k in range(1, df, 2):
        out -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return out


def chi_squared_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, df) < p else (low, mid)
    return low


def consistency(support: float) -> float:
    """What the covariance of the nearest ``support`` share of normal rows is multiplied by to be that of all."""
    return support / chi_squared(chi_squared_quantile(support, D), D + 2)


def _repeat_words(w: Column, window: int) -> Column:
    """Words inside ``window``-word windows that occur twice or more in the text."""

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        """s: (hash, start) in order of hash."""
        same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
        marked = F.transform(s, lambda e, k: F.when(same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1)), e["p"]))
        return let(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), covered)

    def of_windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.cast("int").alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    def of_words(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return let(F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(window)))), of_windows)

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) > window, let(hashes, of_words)).otherwise(F.lit(0))


def text_stats(text: Column, window: int = 5) -> Column:
    """Struct of the whole text's counts, all bigint."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        def of_chars(s: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(s).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(s, SYMBOLS, "")).cast("long").alias("n_symbols"),
                F.length(F.regexp_replace(s, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
                _repeat_words(w, window).cast("long").alias("n_repeat_words"),
            )

        return let(F.array_join(w, ""), of_chars)

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(words(t), of_words).alias("w"),
        let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("l"),
    )


def _vector(s: Column) -> Column:
    """The transformed statistics, as multiples of 1/4096."""
    share = lambda a, b: F.sqrt(a / F.greatest(b, F.lit(1)))
    x = [
        F.log(F.greatest(s["w"]["word_chars"], F.lit(1)) / F.greatest(s["w"]["n_words"], F.lit(1))),
        share(s["w"]["n_symbols"], s["w"]["word_chars"]),
        share(s["w"]["n_repeat_words"], s["w"]["n_words"]),
        share(s["l"]["n_dup_lines"], s["l"]["n_lines"]),
        share(s["w"]["n_capitals"], s["w"]["word_chars"]),
    ]
    return F.array(*(F.round(v * 4096) / 4096 for v in x))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """Count n, sums s and products p of the vectors ``x``."""
    x = [F.col("x")[i] for i in range(D)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*map(F.sum, x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i in range(D) for j in range(i + 1))).alias("p"))


def _cholesky(groups: DataFrame, factor: float = 1.0) -> DataFrame:
    """Adds, from moments: centre m, the lower triangle c of the scatter's factor, half its log-determinant z."""
    m = [F.col("s")[i] / F.col("n") for i in range(D)]
    cell = lambda i, j: F.col(f"l{i}{j}")

    def rest(i: int, j: int) -> Column:
        own = factor * (F.col("p")[i * (i + 1) // 2 + j] / F.col("n") - m[i] * m[j])
        own = F.greatest(own, F.lit(0.0)) + FEATURES[i][1] ** 2 if i == j else own
        for t in range(j):
            own = own - cell(i, t) * cell(j, t)
        return F.sqrt(F.greatest(own, F.lit(FEATURES[i][1] ** 2))) if i == j else own / cell(j, j)

    out = groups
    for j in range(D):
        out = out.withColumn(f"l{j}{j}", rest(j, j))
        if j + 1 < D:
            out = out.withColumns({f"l{i}{j}": rest(i, j) for i in range(j + 1, D)})
    triangle = F.array(*(F.array(*(cell(i, j) for j in range(i + 1))) for i in range(D)))
    return out.select(*groups.columns, F.array(*m).alias("m"), triangle.alias("c"), sum((F.log(cell(i, i)) for i in range(1, D)), F.log(cell(0, 0))).alias("z"))


def _distance(rows: DataFrame, shrink: list[Column] | None = None) -> DataFrame:
    """d, the squared Mahalanobis distance of ``x`` by forward substitution, in the place of m and c."""
    out = rows
    for i in range(D):
        own = (F.col("x")[i] - F.col("m")[i]) * (shrink[i] if shrink else F.lit(1.0))
        for j in range(i):
            own = own - F.col("c")[i][j] * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", own / F.col("c")[i][i])
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, D)), F.col("y0") * F.col("y0"))
    return out.withColumn("d", total).drop("m", "c", *(f"y{i}" for i in range(D)))


def _binned(rows: DataFrame) -> DataFrame:
    return _distance(rows).withColumn("b", F.floor(BINS_PER_OCTAVE * F.greatest(F.log2(F.col("d") + 1e-12), F.lit(LOWEST))).cast("int"))


def _share(value: str, share: float) -> Column:
    """The smallest value with at least ``share`` of the group's rows at or below it."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def estimates(rows: DataFrame, support: float = 0.75, steps: int = 3) -> DataFrame:
    """Moments n, s, p of the subset of least determinant for each group ``g`` of the vectors ``x``."""
    wide = rows.select("g", *(F.col("x")[i].alias(f"x{i}") for i in range(D)))
    middle = cut(wide.groupBy("g").agg(F.array(*(_share(f"x{i}", 0.5) for i in range(D))).alias("m")))
    off = rows.join(middle, "g").select("g", "m", *(F.abs(F.col("x")[i] - F.col("m")[i]).alias(f"x{i}") for i in range(D)))
    scale = lambda i: F.sqrt(F.pow(_share(f"x{i}", 0.5) * 1.4826, 2) + FEATURES[i][1] ** 2)
    spread = off.groupBy("g").agg(F.first("m").alias("m"), F.array(*(scale(i) for i in range(D))).alias("sd"))
    diagonal = F.array(*(F.array(*(F.col("sd")[i] if i == j else F.lit(0.0) for j in range(i + 1))) for i in range(D)))
    first = cut(spread.select("g", "m", diagonal.alias("c")))
    near = _binned(rows.join(first, "g")).select("g", "x", "b")
    half = cut(near.groupBy("g").agg(_share("b", 0.5).alias("last")))
    begun = near.join(half, "g").select("g", "x", F.explode(F.when(F.col("b") <= F.col("last"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("k"))
    groups = _cholesky(cut(_moments(begun, "g", "k"))).select("g", "k", "m", "c").unionByName(first.withColumn("k", F.lit(0)))
    for _ in range(steps):
        bins = cut(_binned(rows.join(cut(groups), "g")).select("g", "k", "x", "b"))
        last = cut(bins.groupBy("g", "k").agg(_share("b", support).alias("last")))
        found = _cholesky(cut(_moments(bins.join(last, ["g", "k"]).where("b <= last"), "g", "k")))
        groups = found.select("g", "k", "m", "c")
        discard(bins)
    best = F.min(F.struct(F.round("z", 9).alias("z"), "k", "n", "s", "p")).alias("b")
    return found.groupBy("g").agg(best).select("g", "b.n", "b.s", "b.p")


def _added(table: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the moments."""
    parts = [("s", D), ("p", D * (D + 1) // 2)]
    return table.groupBy(*by).agg(F.sum("n").alias("n"), *(F.array(*(F.sum(F.col(c)[i]) for i in range(size))).alias(c) for c, size in parts))


def _leaning(own: DataFrame, around: DataFrame, by: list[str], prior: float) -> DataFrame:
    """The moments with ``prior`` more rows that look like ``around``."""
    a = around.select(*by, *(F.col(c).alias(f"{c}a") for c in "nsp"))
    joined = own.join(a, by) if by else own.crossJoin(a)  # without ``by``, around is one row
    more = lambda c: F.transform(F.arrays_zip(F.col(c).alias("u"), F.col(f"{c}a").alias("v")), lambda e: e["u"] + prior * e["v"] / F.col("na"))
    return joined.select(*(c for c in own.columns if c not in "nsp"), (F.col("n") + prior).alias("n"), more("s").alias("s"), more("p").alias("p"))


def judge(docs: DataFrame, keep: list[str] | None = None, lang: str = "lang", source: str = "source", text: str = "text", support: float = 0.75, steps: int = 3, prior: float = 50.0, sure: float = 0.9999) -> DataFrame:
    """row, a struct of the columns ``keep`` (all by default), and judged, a struct of the counts, distance, base_failed and kept, of every document."""
    l, s = F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), text_stats(F.col(text)).alias("stats"), F.to_json(F.struct(l)).alias("l"), F.to_json(F.struct(l, s)).alias("g"))
    n = F.col("stats")["w"]["n_words"]
    failed = (n < 10) | (100 * F.col("stats")["w"]["n_repeat_words"] > 20 * n)
    rows = cut(rows.select("*", _vector(F.col("stats")).alias("x"), failed.alias("failed")))
    groups = cut(estimates(rows.where(~F.col("failed")).select("g", "x"), support, steps).join(rows.select("l", "g").distinct(), "g"))
    languages = _added(groups, ["l"])
    found = _leaning(groups, _leaning(languages, _added(groups, []), [], prior), ["l"], prior)
    variance = F.transform("c", lambda r: F.aggregate(r, F.lit(0.0), lambda a, e: a + e * e))
    found = cut(_cholesky(found, consistency(support)).select("g", "m", "c", variance.alias("v")))
    units = {"words": n, "chars": F.col("stats")["w"]["word_chars"], "lines": F.col("stats")["l"]["n_lines"]}
    noisy = [1 / F.sqrt(1 + F.lit(noise) / (F.greatest(units[unit], F.lit(1)) * F.col("v")[i])) for i, (_, _, noise, unit) in enumerate(FEATURES)]
    shrink = [F.col("shrink")[i] for i in range(D)]
    scored = _distance(rows.join(found, "g", "left").withColumn("shrink", F.array(*noisy)), shrink).select("row", "stats", "failed", F.when(~F.col("failed"), F.col("d")).alias("d"))
    return scored.select("row", F.struct(
        n.alias("n_words"), *(F.col("stats")["w"][c].alias(c) for c in ("word_chars", "n_symbols", "n_repeat_words")), F.col("stats")["l"]["n_dup_lines"].alias("n_dup_lines"),
        F.col("d").alias("distance"), F.col("failed").alias("base_failed"), (~F.col("failed") & F.coalesce(F.col("d") <= chi_squared_quantile(sure, D), F.lit(True))).alias("kept"),
    ).alias("judged"))


def quality_rows(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the distance of every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return judge(docs, ["doc_id"]).select("row.doc_id", *(F.col(f"judged.{c}") for c in names))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept."""
    return judge(docs).where("judged.kept").select("row.*")
