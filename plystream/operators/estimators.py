"""Estimators and models of ``pyspark.ml`` over event logs: they fit, transform, save, load and stand in pipelines. What a model has
learned is tables; nothing of it is collected."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plystream.operators import sequence
from plystream.streaming import ingest


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession, self.cls.__module__ + "." + self.cls.__name__)
        model = self.cls({name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in self.cls.TABLES})
        model._resetUid(said["uid"])
        DefaultParamsReader.getAndSetParams(model, said)
        return model


class _Tables(Model, MLWritable, MLReadable):
    """A model that is tables, named in ``TABLES``."""

    TABLES: tuple[str, ...] = ()

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = tables or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _LogParams(Params):
    caseCol = Param(Params._dummy(), "caseCol", "the case of an event", TypeConverters.toString)
    eventCol = Param(Params._dummy(), "eventCol", "its type", TypeConverters.toString)
    orderCol = Param(Params._dummy(), "orderCol", "the order of events", TypeConverters.toString)
    history = Param(Params._dummy(), "history", "how many events up to and with its own a prediction looks at; 0: none", TypeConverters.toInt)

    def _context(self, df: DataFrame) -> Column:
        """The last ``history`` events of the case as an array; with fewer, those that there are."""
        n = self.getOrDefault("history")
        if n == 0:
            return F.array().cast("array<string>")
        w = Window.partitionBy(self.getOrDefault("caseCol")).orderBy(self.getOrDefault("orderCol")).rowsBetween(1 - n, 0)
        return F.collect_list(F.col(self.getOrDefault("eventCol")).cast("string")).over(w)


class NextEvent(Estimator, _LogParams, DefaultParamsWritable, DefaultParamsReadable):
    """Counts which event follows each context: the event itself, the last few of its case, or, with a history of 0, nothing."""

    @keyword_only
    def __init__(self, *, caseCol: str = "case_id", eventCol: str = "event", orderCol: str = "ord", history: int = 1):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(caseCol="case_id", eventCol="event", orderCol="ord", history=1)

    def _fit(self, df: DataFrame) -> NextEventModel:
        get = self.getOrDefault
        rows = sequence.next_event(df, get("caseCol"), get("orderCol"), get("eventCol"))
        rows = rows.select(self._context(df).alias("context"), F.col("next_event").cast("string").alias("next"))
        counts = rows.groupBy("context", "next").agg(F.count("*").alias("n"))
        every = counts.groupBy("next").agg(F.sum("n").alias("n")).withColumn("context", F.lit(None).cast("array<string>"))
        both = counts.unionByName(every).groupBy("context").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "next"))).alias("ranked"), F.sum("n").alias("seen"))
        model = NextEventModel({"contexts": both.select("context", F.transform("ranked", lambda r: F.struct(r["next"].alias("next"), (-r["less"]).alias("n"))).alias("ranked"), "seen")})
        return self._copyValues(model)


class NextEventModel(_Tables, _LogParams):
    """Adds prediction, the most frequent event after the context (ties go to the smaller token), and probabilities, a map of what came
    after it. A context that was not seen counts as any."""

    TABLES = ("contexts",)

    def _transform(self, df: DataFrame) -> DataFrame:
        known = self.tables["contexts"]
        whole = known.where("context is null").select(F.struct("ranked", "seen").alias("__all"))
        own = known.where("context is not null").select(F.col("context").alias("__context"), F.struct("ranked", "seen").alias("__own"))
        at = df.withColumn("__at", self._context(df))
        # the table of all contexts has one row; contexts are joined by equality
        out = at.join(own, F.col("__at") == F.col("__context"), "left").join(F.broadcast(whole), F.lit(True), "left").withColumn("__own", F.coalesce("__own", "__all"))
        return out.select(*df.columns, F.get("__own.ranked", F.lit(0))["next"].alias("prediction"),
                          F.map_from_entries(F.transform("__own.ranked", lambda r: F.struct(r["next"], r["n"] / F.col("__own.seen")))).alias("probabilities"))

    def classes(self) -> DataFrame:
        """What can be predicted, sorted."""
        return self.tables["contexts"].where("context is null").select(F.explode("ranked").alias("r")).select(F.col("r.next").alias("class")).orderBy("class")

    def predict_proba(self, df: DataFrame, classes: list[str]) -> DataFrame:
        """Adds probability, an array with the probabilities of these classes in their order."""
        wanted = F.array(*map(F.lit, classes))
        return self.transform(df).withColumn("probability", F.transform(wanted, lambda c: F.coalesce(F.try_element_at("probabilities", c), F.lit(0.0))))


def vocabulary(spark: SparkSession, tokens: DataFrame) -> DataFrame:
    """(column, token, id) of distinct (column, token): ids count from 0 in the order of columns and tokens, so that each column has a range
    of ids. Any number of tokens: they are dealt by range and numbered where they are, from the small table of parts."""
    at = ingest.folder(spark, "vocabulary")
    dealt = tokens.where("token is not null").distinct().repartitionByRange("column", "token").sortWithinPartitions("column", "token")
    dealt.select("column", "token", F.spark_partition_id().alias("part")).write.parquet(at)
    found = spark.read.schema("column string, token string, part int").parquet(at)
    parts = found.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    numbered = found.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("column", "token")))
    return numbered.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("column", "token", (F.col("before") + F.col("r") - 1).alias("id"))


class _FeatureParams(Params):
    categories = Param(Params._dummy(), "categories", "columns of tokens", TypeConverters.toListString)
    numbers = Param(Params._dummy(), "numbers", "columns of numbers", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "the struct that is added", TypeConverters.toString)


class SparseEncoder(Estimator, _FeatureParams, DefaultParamsWritable, DefaultParamsReadable):
    """Learns the vocabularies of columns of tokens, of any size and all in one pass, and the bounds of columns of numbers."""

    @keyword_only
    def __init__(self, *, categories: list[str] = (), numbers: list[str] = (), outputCol: str = "features"):
        super().__init__()
        self._setDefault(categories=[], numbers=[], outputCol="features")
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> SparseEncoderModel:
        categories, numbers = self.getOrDefault("categories"), self.getOrDefault("numbers")
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("token")) for c in categories]) if categories else F.array().cast("array<struct<column:string,token:string>>")
        tokens = vocabulary(df.sparkSession, df.select(F.explode(pairs).alias("x")).select("x.*"))
        valid = lambda n: F.when(F.col(n) != -1, F.col(n).cast("double"))
        bounds = [F.struct(F.lit(n).alias("column"), F.min(valid(n)).alias("lo"), F.max(valid(n)).alias("hi")) for n in numbers]
        fit = df.agg(F.array(*bounds).alias("b")) if bounds else df.sparkSession.createDataFrame([], "b array<struct<column:string,lo:double,hi:double>>")
        return self._copyValues(SparseEncoderModel({"tokens": tokens, "bounds": fit.select(F.explode("b").alias("b")).select("b.*")}))


class SparseEncoderModel(_Tables, _FeatureParams):
    """Adds a struct of indices and values: the numbers come first, scaled by minimum and maximum, -1 where missing (null or -1); then a 1 at
    the id of each token. Tokens that were not in the fit have no index. Vocabularies are joined, by broadcast where Spark finds
    them small enough."""

    TABLES = ("tokens", "bounds")

    def _transform(self, df: DataFrame) -> DataFrame:
        categories, numbers = self.getOrDefault("categories"), self.getOrDefault("numbers")
        known = {r["column"]: r for r in self.tables["bounds"].collect()}  # a row for each column of numbers
        out = df
        for k, c in enumerate(categories):
            mine = self.tables["tokens"].where(F.col("column") == c).select(F.col("token").alias(f"__t{k}"), (F.col("id") + len(numbers)).alias(f"__i{k}"))
            out = out.join(mine, F.col(c).cast("string") == F.col(f"__t{k}"), "left").drop(f"__t{k}")
        pairs = []
        for k, n in enumerate(numbers):
            lo, hi, v = known[n]["lo"], known[n]["hi"], F.when(F.col(n) != -1, F.col(n).cast("double"))
            scaled = F.lit(0.0) if lo is None or hi == lo else (v - lo) / (hi - lo)
            pairs.append(F.struct(F.lit(k).cast("bigint").alias("i"), F.when(v.isNull(), -1.0).otherwise(scaled).alias("v")))
        pairs += [F.struct(F.col(f"__i{k}").alias("i"), F.lit(1.0).alias("v")) for k in range(len(categories))]
        found = F.filter(F.array(*pairs), lambda p: p["i"].isNotNull()) if pairs else F.array().cast("array<struct<i:bigint,v:double>>")
        sparse = F.struct(F.transform(found, lambda p: p["i"]).alias("indices"), F.transform(found, lambda p: p["v"]).alias("values"))
        return out.select(*df.columns, sparse.alias(self.getOrDefault("outputCol")))

    def size(self) -> int:
        """How long the vectors are."""
        return len(self.getOrDefault("numbers")) + self.tables["tokens"].count()
