"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. A batch's lines become (hash, number of documents) pairs; those are merge-anti-joined
against the runs kept so far, and what no run holds is written as a sorted run of level 0; the counts of lines that are
known go aside. When a level holds ``FAN_IN`` runs they are compacted into one run of the next level, so a line is
rewritten a logarithmic number of times. A line's documents are those of its one entry in the runs and those aside.
Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, UPPER, dropped, written

FAN_IN = 3
BATCHES = 4
LEAST_DOCS = 10
LEAST_CHARS = 1


def key_of(line: Column) -> Column:
    """A line's key: A-Z lower-cased, white space stripped at both ends."""
    return F.btrim(F.translate(line, UPPER, UPPER.lower()), F.lit(SPACE_CHARS))


class LineRuns:
    """Levels of sorted runs (a, b, docs): hash of a line, and the documents of the batch that brought it.

    A batch is merge-anti-joined against all runs; only lines that none of them holds enter, as a run of level 0, so a
    line is in one run. Documents of later batches with a line that is known are counted in ``more``. A run is written
    sorted; a merge join deals it out again, 20 bytes for each distinct line.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in, self.levels, self.more = spark, fan_in, [[]], []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """One row per line over all batches."""
        parts = [*self.runs, *self.more]
        return reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.sum("docs").alias("docs")) if parts else None

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (with a and b) that no run holds: a merge anti-join against each run."""
        for run in self.runs:
            lines = lines.join(run.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (a, b), one row for each document and distinct line."""
        batch = self._run(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")), "lines-batch")
        if not self.runs:
            self._put(batch, 0)
            return
        new = self._run(self.unseen(batch), "lines-level0")
        self.more.append(self._run(batch.join(new.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "lines-more"))
        self._put(new, 0)
        dropped(batch)
        self._compact()

    def clear(self) -> None:
        """Removes all tables."""
        for table in [*self.runs, *self.more]:
            dropped(table)
        self.levels, self.more = [[]], []

    def _run(self, lines: DataFrame, name: str) -> DataFrame:
        return written(lines.select("a", "b", "docs").sortWithinPartitions("a", "b"), name)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                old, self.levels[level] = self.levels[level], []
                self._put(self._run(reduce(DataFrame.unionByName, old), f"lines-level{level + 1}"), level + 1)
                for run in old:
                    dropped(run)
            level += 1


def frequent_lines(lines: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """(a, b) of lines in at least ``least_docs`` documents. ``lines``: a, b, _doc and _batch, a row for each line of each document; a document is in one batch."""
    runs = LineRuns(lines.sparkSession)
    for batch in range(batches):
        runs.add(lines.where(F.col("_batch") == batch).select("a", "b", "_doc").distinct())
    found = written(runs.merged().where(F.col("docs") >= least_docs).select("a", "b"), "lines-frequent")
    runs.clear()
    return found


def drop_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the columns kept_text, n_lines and n_dropped (these names win over columns of the input).

    A line goes if its key has at least ``least_chars`` code points and is in at least ``least_docs`` documents; every
    row counts as a document, and a line repeated inside one counts once. Null or empty text is one empty line and
    stays as it is (kept_text is then empty); nulls in other columns pass through; an empty table gives no rows.
    """
    own = ("kept_text", "n_lines", "n_dropped")
    names = [c for c in docs.columns if c not in own]
    out = marked_lines(docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].alias("text")), least_docs, least_chars, batches)
    return out.select("row.*", *own)


def marked_lines(rows: DataFrame, least_docs: int, least_chars: int, batches: int = BATCHES) -> DataFrame:
    """row, kept_text, n_lines and n_dropped for (row, text).

    Lines are rows while they are counted. The places of those to drop reach a text by its hash, so copies of a text
    share them and no doc_id is needed. A very frequent line meets partial counts and skew joins only, and the work on
    one text is linear in its lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    told = rows.select(text.alias("text"), F.xxhash64(text).alias("t"), F.hash(text).alias("u"), F.monotonically_increasing_id().alias("_doc"))
    split = told.select("t", "u", "_doc", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).withColumn("line", key_of(F.col("line"))).where(F.length("line") >= least_chars)
    batch = F.pmod(F.xxhash64("t"), F.lit(batches)).cast("int").alias("_batch")
    # written once: the numbers of documents hold inside this table only
    lines = written(split.select("t", "u", "_doc", "place", F.xxhash64("line").alias("a"), F.hash("line").alias("b"), batch), "lines", partition_by="_batch")
    frequent = frequent_lines(lines.select("a", "b", "_doc", "_batch"), least_docs, batches)
    hit = lines.join(frequent, ["a", "b"]).groupBy(F.col("t").alias("_dt"), F.col("u").alias("_du"))
    # written, so that the join below deals both of its sides itself and very common texts can be split
    drop = written(hit.agg(F.collect_set("place").alias("_drop")), "lines-to-drop")
    dropped(lines)
    dropped(frequent)
    whole = rows.select("row", text.alias("text")).withColumn("t", F.xxhash64("text")).withColumn("u", F.hash("text"))
    # a merge join at every size: the places grow with the input, so a small input's broadcast would only hide that texts are dealt
    met = whole.join(drop.hint("merge"), (F.col("t") == F.col("_dt")) & (F.col("u") == F.col("_du")), "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    told = met.select("row", "text", n_lines.cast("long").alias("n_lines"), "_drop")
    places = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("_drop"))
    # the array around it has one element: it binds the split text, which an expression inside the lambda would split again for each line
    bound = F.array(F.struct(F.split("text", "\n", -1).alias("lines"), places.alias("places")))
    kept = F.transform(bound, lambda x: F.array_join(F.transform(x["places"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    some = F.col("_drop").isNotNull()
    return told.select("row", F.when(some, kept).otherwise(F.col("text")).alias("kept_text"), "n_lines", F.when(some, F.size("_drop")).otherwise(F.lit(0)).cast("long").alias("n_dropped"))


def documents_without_repeats(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with text and, where there is such a column, n_chars after the repeated lines are gone.

    Null text stays null and keeps its n_chars; a text whose lines all go is empty. Rows that repeat a text or an id are
    documents each. All other columns stay, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    out = marked_lines(rows, least_docs, LEAST_CHARS)
    row, has = F.col("row"), F.col("row")["text"].isNotNull()
    new = {"text": F.when(has, F.col("kept_text")), "n_chars": F.when(has, F.length("kept_text").cast("long")).otherwise(row["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else row[c]).alias(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line,
         translate(trim(l[i], E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents))),
frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(*) FILTER (WHERE f.k IS NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id
"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE = {"op10_line_dedup": SQL}
