"""Fitted preparation of event logs: encoders and scalers are learned from one log and applied to others."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plystream.operators import quantiles, sequence

#: What each mode puts into a graph, beside labels and features.
MODES = {"basic": ("edge_times", "node_times"), "time_decay": ("node_times",), "status": ("edge_times", "edge_types"), "time_decay_status": ("edge_times", "edge_types", "node_times")}
UNKNOWN, MISSING = "UNK", "<NO_DESC>"


@dataclass(frozen=True)
class LogConfig:
    """Columns of an event log. ``order`` is the order of its rows; ``case_*`` columns are constant in a case."""

    case: str = "case_id"
    event: str = "event"
    time: str = "time"
    order: str = "ord"
    status: str | None = None
    categories: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    case_categories: tuple[str, ...] = ()
    case_numbers: tuple[str, ...] = ()
    mask: bool = True
    mode: str = "basic"
    #: The most tokens of a vocabulary; more than that is no set of categories, and fails.
    most: int = 10_000


def resolve(config: LogConfig | None = None, **changes) -> LogConfig:
    """A configuration with some values changed; unknown names are an error."""
    config = config or LogConfig()
    unknown = sorted(set(changes) - set(LogConfig.__dataclass_fields__))
    if unknown:
        raise ValueError(f"unknown configuration: {', '.join(unknown)}")
    return replace(config, **changes)


@dataclass
class LogTransformer:
    """``fit`` learns from a log, ``transform`` gives one row for each case of any log.

    Vocabularies are sorted by code point, with the end token and the unknown transition among the others. Indicators of an
    unknown category are all 0 and, with ``mask``, those of a missing one all -1. Numbers are scaled by minimum and maximum;
    with ``mask`` the missing, -1 and null, stay out of the fit and are -1, otherwise they become the median.

    Modes decide what else a case has: ``basic`` times of edges and nodes, ``time_decay`` of nodes, ``status`` times of edges
    and types of transitions, ``time_decay_status`` all three.
    """

    config: LogConfig
    events: list[str] = field(default_factory=list)
    transitions: list[str] = field(default_factory=list)
    categories: dict[str, list[str]] = field(default_factory=dict)
    fits: dict[str, Row | dict] = field(default_factory=dict)
    fitted: bool = False

    def __post_init__(self):
        if self.config.mode not in MODES:
            raise ValueError(f"unknown mode: {self.config.mode}")
        if "edge_types" in MODES[self.config.mode] and not self.config.status:
            raise ValueError(f"mode {self.config.mode} needs a status column")

    def _tokens(self, c: DataFrame) -> list[str]:
        found = sorted(r[0] for r in c.where(F.col(c.columns[0]).isNotNull()).distinct().limit(self.config.most + 1).collect())
        if len(found) > self.config.most:
            raise ValueError(f"{c.columns[0]} has more than {self.config.most} values")
        return found

    def _cases(self, df: DataFrame) -> DataFrame:
        c = self.config
        columns = (*c.case_categories, *c.case_numbers)
        return sequence.case_first(df, c.case, c.order, *columns) if columns else df.select(c.case).distinct()

    def fit(self, df: DataFrame) -> LogTransformer:
        """Collects vocabularies, of ``most`` tokens at most, and one row of bounds for each table."""
        c = self.config
        self.events = sorted([*self._tokens(df.select(F.col(c.event).cast("string"))), sequence.EOS])
        if c.status:
            steps = sequence.transitions(df.select(c.case, c.order, F.col(c.status).cast("string").alias(c.status)), c.case, c.order, c.status)
            self.transitions = sorted([*self._tokens(steps.select("transition")), UNKNOWN])
        valid = lambda n: F.when(F.col(n) != -1, F.col(n).cast("double"))
        fits = lambda names: [f(valid(n)).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]
        cases = self._cases(df)
        for rows, categories, numbers in ((df, c.categories, c.numbers), (cases, c.case_categories, c.case_numbers)):
            self.categories |= {n: self._tokens(rows.select(F.col(n).cast("string"))) for n in categories}
            if numbers:
                self.fits |= {n: r.asDict() for r in [rows.agg(*fits(numbers)).first()] for n in numbers}
                if not c.mask:  # only then do medians stand in for what is missing
                    for n in numbers:
                        self.fits[n] |= {f"mid_{n}": quantiles.median(rows.select(valid(n).alias("v")), "v")}
        times = sequence.time_deltas(df, c.case, c.order, c.time).agg(F.min("delta_s").alias("lo_delta"), F.max("delta_s").alias("hi_delta"))
        self.fits["delta"] = times.first()
        self.fitted = True
        return self

    def _scaled(self, value: Column, name: str) -> Column:
        lo, hi = self.fits[name][f"lo_{name}"], self.fits[name][f"hi_{name}"]
        if lo is None or hi is None:
            return F.when(value.isNotNull(), 0.0)
        return (value - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0)

    def _features(self, categories: tuple[str, ...], numbers: tuple[str, ...]) -> Column:
        """One array: the indicators of each vocabulary, then the numbers. A vocabulary is one constant array, not a column for each token."""
        none = F.array().cast("array<double>")
        out = [none]
        for n in categories:
            v = F.coalesce(F.col(n).cast("string"), F.lit(MISSING))
            tokens = [t for t in self.categories[n] if not (self.config.mask and t == MISSING)]
            on = self._indicators(v, tokens) if tokens else none
            out.append(F.when(v == MISSING, F.array_repeat(F.lit(-1.0), len(tokens))).otherwise(on) if self.config.mask else on)
        for n in numbers:
            v = F.when(F.col(n) != -1, F.col(n).cast("double"))
            if self.config.mask:
                out.append(F.array(F.coalesce(self._scaled(v, n), F.lit(-1.0))))
            else:
                out.append(F.array(self._scaled(F.coalesce(v, F.lit(self.fits[n][f"mid_{n}"])), n)))
        return F.concat(*out)

    @staticmethod
    def _indicators(value: Column, tokens: list[str]) -> Column:
        return F.transform(F.array(*map(F.lit, tokens)), lambda t: (value == t).cast("double"))

    @staticmethod
    def _looked_up(df: DataFrame, tokens: list[str], key: Column, out: str) -> DataFrame:
        """Adds the place of a token in a fitted list, null for others; the list, of ``most`` tokens at most, is broadcast."""
        table = df.sparkSession.createDataFrame(list(enumerate(tokens)), f"{out} int, {out}_token string")
        return df.withColumn(f"{out}_key", key).join(F.broadcast(table), F.col(f"{out}_key") == F.col(f"{out}_token"), "left").drop(f"{out}_key", f"{out}_token")

    def transform(self, df: DataFrame) -> DataFrame:
        """One row for each case: event_ids and labels (the event that follows, at last the end token) in row order,
        features (an array for each event: its own, then its case's), and what the mode adds. Times and differences are
        in the order of time. An event that was not in the fitted log is an error. A case has to fit in a row."""
        if not self.fitted:
            raise RuntimeError("fit first")
        c = self.config
        w = Window.partitionBy(c.case).orderBy(c.order)
        d = self._looked_up(df, self.events, F.col(c.event).cast("string"), "__id")
        unknown = F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce(F.col(c.event).cast("string"), F.lit("null")))).cast("int")
        d = d.withColumn("__id", F.coalesce("__id", unknown)).withColumn("__features", self._features(c.categories, c.numbers))
        kept = [c.case, c.order, c.time, "__id", "__features", F.lead("__id", 1, self.events.index(sequence.EOS)).over(w).alias("__next")]
        if c.status:
            step = F.concat(F.col(c.status).cast("string"), F.lit("→"), F.lead(F.col(c.status).cast("string")).over(w))
            d = d.select("*", F.lead(c.order).over(w).isNotNull().alias("__more"), step.alias("__named"))
            d = self._looked_up(d, self.transitions, F.col("__named"), "__code")
            kept.append(F.when(F.col("__more"), F.coalesce("__code", F.lit(self.transitions.index(UNKNOWN)))).alias("__step"))
        else:
            kept.append(F.lit(None).cast("int").alias("__step"))
        rows = F.sort_array(F.collect_list(F.struct(c.order, "__id", "__next", "__features", "__step")))
        times = F.sort_array(F.collect_list(F.struct(c.time, F.col(c.order).alias("__o"))))
        g = d.select(*kept).groupBy(c.case).agg(rows.alias("r"), F.transform(times, lambda t: F.unix_micros(t[c.time].cast("timestamp"))).alias("t"))
        if c.case_categories or c.case_numbers:
            own = self._features(c.case_categories, c.case_numbers)
            g = g.join(self._cases(df).select(c.case, own.alias("__own")), c.case)
        else:
            g = g.withColumn("__own", F.array().cast("array<double>"))
        of = lambda name: F.transform("r", lambda x: x[name])
        edges = F.when(F.size("t") > 1, F.sequence(F.lit(0), F.size("t") - 2)).otherwise(F.array().cast("array<int>"))
        at = lambda i: F.get(F.col("t"), i)
        left = lambda i: (F.floor(F.element_at("t", -1) / 1_000_000) - F.floor(at(i) / 1_000_000)).cast("double")
        out = {
            "edge_times": F.transform(edges, lambda i: self._scaled((at(i + 1) - at(i)) / 1e6, "delta")),
            "edge_types": F.filter(of("__step"), lambda x: x.isNotNull()),
            "node_times": F.transform(edges, lambda i: left(i) / (left(F.lit(0)) + 1e-8)),
        }
        return g.select(c.case, of("__id").alias("event_ids"), of("__next").alias("labels"),
                        F.transform("r", lambda x: F.concat(x["__features"], F.col("__own"))).alias("features"), *[out[n].alias(n) for n in MODES[c.mode]])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    @property
    def sizes(self) -> dict[str, int]:
        """Numbers of event ids, with the end token, and of transitions, with the unknown one."""
        return {"events": len(self.events), "transitions": len(self.transitions)}
