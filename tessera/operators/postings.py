"""An inverted index of symbols on a file system: written once a generation, read by the partitions of a search's terms.

A row is a term of a symbol with its places: the field (name, path, content) in the high bits, the position in it in the
low ones, so that places in a row are in one field. Rows are partitioned by a hash of the term and sorted by it, so a search
reads a few files and, by their statistics, a few row groups of these. Numbers of the whole are one row beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import LEAST_IDF, B, K1, index_tokens, once, search_documents

#: Partitions of the terms, and the place of a field's number.
BUCKETS, FIELD = 64, 20
FIELDS = ("spelling", "relative_path", "content")
KEY = ("relative_path", "symbol_id", "spelling")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def posted(symbols: DataFrame) -> DataFrame:
    """(bucket, term, KEY, length, places) of all terms. Symbols are dealt, then a symbol's terms are gathered in its row."""
    docs = search_documents(symbols)

    def placed(number: int, name: str) -> Column:
        return F.transform(index_tokens(F.col(name)), lambda t, i: F.struct(t.alias("t"), (i + F.lit(number << FIELD)).alias("p")))

    fields = [placed(n, c) for n, c in enumerate(FIELDS)]
    rows = once(docs.select(*KEY, *[c for c in FIELDS if c not in KEY]), all=F.concat(*fields)).select(*KEY, "all")
    rows = rows.select(*KEY, F.size("all").alias("length"), "all", F.explode(F.array_distinct(F.transform("all", lambda x: x["t"]))).alias("term"))
    places = F.transform(F.filter("all", lambda x: x["t"] == F.col("term")), lambda x: x["p"])
    return rows.select(bucket(F.col("term")).alias("bucket"), "term", *KEY, "length", places.alias("places"))


def write(symbols: DataFrame, folder: str) -> None:
    """Writes the index of a generation: terms, and one row of its numbers."""
    rows = posted(symbols)
    spread = F.pmod(F.xxhash64(*KEY), F.lit(4))  # a very frequent term is shared out
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    written = symbols.sparkSession.read.schema(rows.schema).parquet(f"{folder}/terms")  # every word of a text is a place of one term
    length = written.agg(F.coalesce(F.sum(F.size("places").cast("long")), F.lit(0)).cast("long").alias("length"))
    numbers = symbols.agg(F.count(F.lit(1)).alias("rows")).crossJoin(length)  # of one row each
    numbers.write.mode("overwrite").parquet(f"{folder}/numbers")


class Postings:
    """The written index of one generation."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def terms(self, terms: list[str]) -> DataFrame:
        """The rows of some terms: only their partitions are read."""
        wanted = list(dict.fromkeys(terms))
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket(F.col("t"))).distinct().collect()]
        return self.spark.read.parquet(f"{self.folder}/terms").filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))

    def _score(self, times: Column, n: Column) -> Column:
        numbers = self.spark.read.parquet(f"{self.folder}/numbers").first()
        mean = (numbers["length"] or 0) / max(numbers["rows"], 1) or 1.0
        idf = F.greatest(F.log((F.lit(numbers["rows"]) - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        return idf * times * (K1 + 1) / (times + K1 * (1 - B + B * F.col("length") / F.lit(mean)))

    def every(self, terms: list[str]) -> DataFrame:
        """(KEY, score) of symbols that hold every term; lower is better."""
        wanted = list(dict.fromkeys(terms))
        rows = self.terms(wanted)
        counts = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = F.lit(0)
        for t, c in counts.items():
            n = F.when(F.col("term") == t, F.lit(c)).otherwise(n)
        scored = rows.select(*KEY, self._score(F.size("places"), n).alias("part"))
        return scored.groupBy(*KEY).agg(F.count(F.lit(1)).alias("held"), (-F.sum("part")).alias("score")).filter(F.col("held") == len(wanted)).drop("held")

    def phrase(self, terms: list[str]) -> DataFrame:
        """(KEY, score) of symbols that hold the terms in a row in one field."""
        if not terms:
            return self.spark.createDataFrame([], "relative_path string, symbol_id string, spelling string, score double")
        rows = self.terms(terms).groupBy(*KEY, "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))
        def begun(i: int, term: str) -> Column:
            return F.transform(F.coalesce(F.col("m")[term], F.array().cast("array<int>")), lambda p: p - i)

        starts = [begun(i, t) for i, t in enumerate(terms)]
        met = rows.withColumn("times", F.size(reduce(F.array_intersect, starts))).filter("times > 0")
        n = met.count()
        return met.select(*KEY, (-self._score(F.col("times"), F.lit(n))).alias("score"))
