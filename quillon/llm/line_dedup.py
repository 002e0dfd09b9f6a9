"""Line deduplication by levelled sorted runs of line hashes (operator 4), in DataFrame functions only.

Documents are taken in batches of ascending doc_id. A batch's line hashes, each with the smallest
doc_id that holds it, are merge-anti-joined with the runs written before; what is new becomes a run
of its own, bucketed and sorted by hash, so that later joins need not shuffle it. Whenever FANOUT
runs stand on a level they are compacted to one run of the next level, unless no batch is to come. In
the end every hash stands in one run with its owner, the smallest doc_id that holds the line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, new_path, part_count, quantiles, remove_path, unused, written

MIN_KEY = 10
BATCHES = 4
FANOUT = 2
#: What Spark allows by default.
MOST_BUCKETS = 100_000
# What is stripped at both ends of a line.
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def document_key(doc_id: Column) -> Column:
    """Rows without an id are one document that stands before all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def long_lines(docs: DataFrame) -> DataFrame:
    """doc, body (hash of the whole text), pos and two hashes of each line whose key counts."""
    lines = docs.select(document_key(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("body"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= MIN_KEY)
    return keys.select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Runs of (h1, h2, owner), at most FANOUT - 1 on each level but after the last batch. They are deleted on exit."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, min(buckets, MOST_BUCKETS)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_: object) -> None:
        for name in list(self.paths):
            self._drop(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"quillon_line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "run")
        dealt = rows.repartition(self.buckets, "h1")
        dealt.write.bucketBy(self.buckets, "h1").sortBy("h1").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.paths.pop(name))

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """batch: doc, h1, h2; no doc of it is smaller than any of the batches before. After the last, runs are read as they are."""
        fresh = batch.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
        for run in self.tables():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(fresh))
        if not last:
            self._compact()

    def _compact(self) -> None:
        """Merge the runs of each full level into one of the next."""
        for level, names in enumerate(self.levels):
            if len(names) < FANOUT:
                return
            merged = self.spark.table(names[0])
            for other in names[1:]:
                merged = merged.unionByName(self.spark.table(other))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            for old in names:
                self._drop(old)
            self.levels[level] = []

    def owners(self) -> DataFrame:
        first, *rest = self.tables()
        for run in rest:
            first = first.unionByName(run)
        return first


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc, body and the ascending positions (array) of the lines that go, where any goes."""
    spark = docs.sparkSession
    lines = long_lines(docs)
    bounds = quantiles(docs.select(document_key(F.col("doc_id")).alias("doc")), "doc", batches)
    number = F.lit(0)
    for bound in bounds:
        number = number + F.when(F.col("doc") > bound, 1).otherwise(0)
    with Scratch(spark) as scratch:
        stored = scratch.written(lines.withColumn("batch", number), "lines")
        with LineRuns(spark, part_count(stored)) as runs:
            for i in range(len(bounds) + 1):
                runs.add(stored.where(F.col("batch") == i).select("doc", "h1", "h2"), last=i == len(bounds))
            gone = stored.join(runs.owners(), ["h1", "h2"]).where("owner < doc")
            return written(gone.groupBy("doc", "body").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")


def without(lines: Column, gone: Column) -> Column:
    """lines less those at the ascending positions gone, in linear time."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.size(gone) - 1))
    flags = F.flatten(F.zip_with(gone, before, lambda at, last: F.concat(F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True)))))
    return F.filter(lines, lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False)))


def added(docs: DataFrame) -> list[str]:
    """What deduplicated() calls its three columns: qn_lines, qn_dropped, qn_kept, with underscores where docs has such."""
    return unused(docs.columns, "qn_lines", "qn_dropped", "qn_kept")


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with three columns more, see added(): lines before, lines dropped, and the text that stays.

    Lines whose key (stripped, A-Z lower-cased) has at least MIN_KEY code points and stands in two
    documents or more go, but for those in the document of smallest id that holds the key; there all
    stay. Null text is one empty line. Rows of equal doc_id are one document; each keeps its own
    text. Rows without doc_id are one document before all others. Extra columns stay.
    """
    n_lines, n_dropped, kept, doc, body, places = unused(docs.columns, *added(docs), "qn_doc", "qn_body", "qn_gone")
    gone = dropped_lines(docs, batches).select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("gone").alias(places))
    match = (document_key(docs["doc_id"]) == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(body))
    lines = split_lines(docs["text"])
    whole = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # A merge join at every size: what goes grows with the corpus, so that no broadcast of it is bounded.
    return docs.join(gone.hint("merge"), match, "left").select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(places).isNull(), whole).otherwise(F.concat_ws("\n", without(lines, F.col(places)))).alias(kept),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256. See deduplicated()."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("qn_lines").alias("n_lines"), F.col("qn_dropped").alias("n_dropped"), F.sha2("qn_kept", 256).alias("kept_sha256"))


def rewritten(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with text (and n_chars, where there is one) replaced by what stays. Null text stays null."""
    out, kept = deduplicated(docs, batches), added(docs)[2]
    new = {"text": F.when(F.col("text").isNotNull(), F.col(kept)), "n_chars": F.char_length(kept).cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])
