"""Evaluation of predictions as grouped aggregates and windows."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(hit: Column) -> Column:
    return F.coalesce(F.avg(hit.cast("int")), F.lit(0.0))


def by_depth(df: DataFrame, depth: str, hit: str, deepest: int) -> DataFrame:
    """Accuracy of depths 1 to ``deepest``; depths without rows stay, with a null accuracy."""
    got = df.groupBy(F.col(depth).cast("bigint").alias("depth")).agg(F.count("*").alias("n"), F.avg(F.col(hit).cast("int")).alias("accuracy"))
    every = df.sparkSession.range(1, deepest + 1).withColumnRenamed("id", "depth")
    return every.join(got, "depth", "left").select("depth", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "accuracy")


def confusion(df: DataFrame, true: str, pred: str, classes: int | None = None) -> DataFrame:
    """Counts in long form, with each row's share. With ``classes``, rows with a class of that number or more go, and negative
    ones count from the end, as indexes of an array do."""
    if classes is not None:
        df = df.where((F.col(true) < classes) & (F.col(pred) < classes))
        at = lambda c: F.when(F.col(c) < 0, F.col(c) + classes).otherwise(F.col(c))
        df = df.withColumns({true: at(true), pred: at(pred)})
    c = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(true)))


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    both = df.select(F.explode(F.array(F.struct(F.col(true).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"),
                     (F.col(true) == F.col(pred)).cast("int").alias("hit")).select("x.*", "hit")
    g = both.groupBy(F.col("c").alias("class")).agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum(F.col("hit") * F.col("t")).alias("tp"))
    part = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(0.0)
    g = g.withColumn("precision", part("predicted")).withColumn("recall", part("support"))
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def top_k(scores: str, k: int) -> Column:
    """The ids, from 0, of the k largest scores of an array; ties go to the lower id."""
    pairs = F.transform(F.col(scores), lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: x["i"])


def class_weights(df: DataFrame, label: str, classes: int, smooth: float = 1.0, most: float = 50.0, scheme: str = "inverse_sqrt_freq") -> DataFrame:
    """1 / sqrt(count + smooth), or 1 / (count + smooth) with ``inverse_freq``, at most ``most``, divided by the count-weighted
    mean; classes without rows count too. Labels out of range are left out; without any other the job fails."""
    if scheme not in ("inverse_sqrt_freq", "inverse_freq"):
        raise ValueError(f"unknown scheme: {scheme}")
    got = df.where(F.col(label).between(0, classes - 1)).groupBy(F.col(label).cast("bigint").alias("class")).agg(F.count("*").alias("n"))
    w = df.sparkSession.range(classes).withColumnRenamed("id", "class").join(got, "class", "left").fillna(0, ["n"])
    size = F.col("n") + smooth
    w = w.withColumn("raw", F.least(1 / (F.sqrt(size) if scheme == "inverse_sqrt_freq" else size), F.lit(most)))
    total = F.sum("n")
    mean = w.agg(F.when(total > 0, F.sum(F.col("raw") * F.col("n")) / total).otherwise(F.raise_error(F.lit("no valid label")).cast("double")).alias("__mean"))
    return w.crossJoin(F.broadcast(mean)).select("class", "n", (F.col("raw") / F.col("__mean")).alias("weight"))


def contingency(df: DataFrame, stratum: str, a: str, b: str) -> DataFrame:
    """2 x 2 counts of paired hits, by stratum and, with a null stratum, of all."""
    cell = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    return df.rollup(stratum).agg(cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"))


def mcnemar(counts: DataFrame) -> DataFrame:
    """The statistic and p of the discordant pairs: exact binomial below 25 of them, else chi-squared with Yates' correction;
    neither if there are none."""
    d, k = F.col("n01") + F.col("n10"), F.least("n01", "n10")
    # the sum over i up to k of C(d, i) / 2^d, term by term
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.struct(F.lit(0.0).alias("sum"), F.pow(F.lit(2.0), -d).alias("term")),
                       lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (d - i) / (i + 1)).alias("term")), lambda acc: acc["sum"])
    exact = (d > 0) & (d < 25)
    out = counts.withColumn("discordant", d).withColumn("chi2", F.when(d >= 25, F.pow(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(2.0)) / d))
    out = out.withColumn("method", F.when(d == 0, "undefined").when(exact, "exact").otherwise("chi2"))
    return out.withColumn("p", F.when(exact, F.least(F.lit(1.0), 2 * tail)).when(d >= 25, chi2_tail(F.col("chi2"))))


def _falling(scale: Column, ratio, steps: int = 200) -> Column:
    """ln of 1 / (1 + k1 scale / (1 + k2 scale / (1 + ...))) with k from ``ratio``: all terms are positive, so the fixed number of
    steps, taken from the last, loses no digits."""
    return -F.ln(F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), F.lit(1.0), lambda rest, n: 1 + ratio(n.cast("double")) * scale / rest))


def _rising(y: Column, ratio, steps: int = 120) -> Column:
    """1 + r1 y + r1 r2 y^2 + ..."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
                       lambda acc, n: F.struct((acc["sum"] + acc["term"] * ratio(n.cast("double")) * y).alias("sum"), (acc["term"] * ratio(n.cast("double")) * y).alias("term")), lambda acc: acc["sum"])


def _log_half_step(a: Column, shift: int = 16) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)), by its asymptotic series after ``shift`` steps up, so that no large logarithms cancel."""
    z = a + shift
    back = sum((F.ln((a + i) / (a + i + 0.5)) for i in range(shift)), F.lit(0.0))
    return back + F.ln(z) / 2 - 1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7)


def log_t_tails(t: Column, df: Column) -> Column:
    """ln of both tails of Student's t: the regularised incomplete beta function I_x(df / 2, 1 / 2), x = df / (df + t^2).

    From t^2 = 2 on it is computed as a tail, by the continued fraction of its hypergeometric function in -df / t^2, which
    needs as many steps for 10^9 degrees of freedom as for few; nearer to 0, where it is large, from the series of the rest.
    Null degrees of freedom mean infinitely many, the normal distribution. 0 for t = 0; null for t null or no number."""
    t2, v = (t * t).cast("double"), df.cast("double")
    half = v / 2
    density = F.coalesce(_log_half_step(half) - F.ln(v * pi) / 2 - (v + 1) / 2 * F.log1p(t2 / v), -F.ln(F.lit(2 * pi)) / 2 - t2 / 2)
    # the tail is density * (df + t^2) / (df t) * F(1/2, 1; df/2 + 1; -df / t^2)
    limit = F.coalesce(F.log1p(t2 / v), F.lit(0.0))
    ratio = lambda n: F.coalesce(n / 2 * (half + (n - 1) / 2) / ((half + n - 1) * (half + n)) * v, n)
    tail = F.ln(F.lit(2.0)) + density + limit - F.ln(t2) / 2 + _falling(1 / t2, ratio)
    y = F.coalesce(t2 / (v + t2), t2)
    near = 2 * F.exp(density) * F.sqrt(t2) * _rising(y, lambda n: F.coalesce((half + n - 0.5) / (n + 0.5), 1 / (2 * n + 1)))
    return F.when(t2 >= 2, tail).when(t2 > 0, F.log1p(-near)).when(t2 == 0, F.lit(0.0))


def t_tails(t: Column, df: Column) -> Column:
    return F.exp(log_t_tails(t, df))


def chi2_tail(x: Column) -> Column:
    """The upper tail of chi-squared with one degree of freedom: both tails of a normal sqrt(x)."""
    return F.exp(log_t_tails(F.sqrt(x), F.lit(None)))


def pairwise_t(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Student's t (pooled), its p and log10 of that, which doesn't end at 1e-308, Cohen's d and stars (one for p < alpha / 2, two for
    p < alpha / 4) of each pair of groups of two rows or more, from one row of moments for each group. Work for a pair is
    the same however many rows its groups have."""
    m = df.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).where("n > 1")
    a, b = (m.select(*[F.col(c).alias(f"{c}_{s}") for c in m.columns]) for s in "ab")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    d = (F.col("mean_a") - F.col("mean_b")) / pooled
    out = a.join(b, F.col("g_a") < F.col("g_b")).select("g_a", "g_b", "n_a", "n_b", d.alias("cohens_d"), (d / F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))).alias("t"))
    out = out.withColumn("log10_p", log_t_tails(F.col("t"), F.col("n_a") + F.col("n_b") - 2) / log(10)).withColumn("p", F.pow(F.lit(10.0), "log10_p"))
    return out.withColumn("stars", F.when(F.col("p") < alpha / 4, "**").when(F.col("p") < alpha / 2, "*").otherwise(""))


def most_significant(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The starred pairs: more stars first, then smaller p and larger d, as they are written: p with three decimals of its
    exponent form, d with two decimals. p is taken from its logarithm, so that the smallest are told apart too."""
    power = F.floor("log10_p")
    digits = F.round(F.pow(F.lit(10.0), F.col("log10_p") - power), 3)
    written = pairs.where("stars <> ''").withColumn("__p", F.struct(F.when(digits >= 10, power + 1).otherwise(power).alias("power"), F.when(digits >= 10, 1.0).otherwise(digits).alias("digits")))
    written = written.withColumn("__d", F.round("cohens_d", 2))
    return written.orderBy(F.desc(F.length("stars")), "__p", F.desc("__d"), "g_a", "g_b").limit(most).drop("__p", "__d")


def correlations(df: DataFrame, kind: str, a: str, b: str, top: int = 3, least: int = 10) -> DataFrame:
    """Pearson's r of all rows, with a null kind, and of the ``top`` commonest kinds that have more than ``least`` rows."""
    g = df.groupBy(kind).agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).orderBy(F.desc("n"), kind).limit(top).where(F.col("n") > least)
    whole = df.agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).select(F.lit(None).cast(df.schema[kind].dataType).alias(kind), "n", "r")
    return whole.unionByName(g)


def legal_top_k(scores: str, legal: str, target: str, k: int) -> Column:
    """Whether the target is among the k legal ids with the largest scores; ties go to the lower id."""
    pairs = F.transform(F.array_sort(F.col(legal)), lambda i: F.struct((-F.get(F.col(scores), i.cast("int"))).alias("s"), i.alias("i")))
    return F.array_contains(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: x["i"]), F.col(target))


def with_alternatives(df: DataFrame, true: str, pred: str, legal: str, mate: str, after: str) -> DataFrame:
    """Accuracy, strict and with credit for another legal move after which the opponent (``after``, from their side) is
    mated in one move less."""
    hit = F.col(true) == F.col(pred)
    other = F.coalesce(F.col(legal) & (F.col(after) == 1 - F.col(mate)), F.lit(False))
    return df.agg(F.count("*").alias("n"), accuracy(hit).alias("strict"), accuracy(hit | other).alias("with_alternatives"))
