"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums of
token counts, and a cut at each source's exact budget, with repeated epochs. DataFrame functions only.

Scale: texts are read once for their sizes, and by `mix_documents` once more, without a shuffle. Each source is dealt over ranges of its random key (uniform, so even a
source with a third of all rows gives equal ranges); prefix sums of the ranges' totals are taken over that table of
ranges, and rows only meet the rows of their own range.

Defined results: null text has size 0; a null source is a source of its own, after all others; repeated rows are
separate documents, ordered by (key, doc_id, size); documents of size 0 take 0; an empty table gives no rows; a null
doc_id is an id like any other. Other columns are ignored by `mix_plan` and kept by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm._common import materialize, scratch

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents of all sources together for each range of keys: a source with a share of the rows has that share of them
#: in each of its ranges, so no task holds more than a few ranges whatever the source.
RANGE_ROWS = 512
#: Bound of ranges of a source, a power of 2, and of the sources whose cuts are broadcast.
MAX_RANGES = 1 << 16
MAX_BROADCAST = 10_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text: the ends of words, counted."""
    t = F.coalesce(text, F.lit(""))
    squeezed = F.regexp_replace(t, r"[^\x20\x09-\x0D]+", "w")
    return (F.length(squeezed) - F.length(F.translate(squeezed, "w", ""))).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 random bits of the id."""
    h = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary"))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source.

    Water filling in closed form: sources in order of size/weight; those whose cap lies below their share of what
    the ones before left over are capped, the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_epochs
    t = sizes.withColumn("w", weight).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("capped", F.col("cap") * F.col("w_left") < F.col("w") * (F.col("total") - F.col("before")))
        .withColumn("all_caps", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("free_w", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    )
    share = F.col("w") * (F.col("total") - F.col("all_caps")) / F.col("free_w")
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def mix_sizes(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, ...) to the same rows with key, source_size, target, epochs (whole passes) and part (words of the last pass).

    `sized` is read several times: give it materialized.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n = sized.count()
    ranges = 1
    while ranges < MAX_RANGES and ranges * range_rows < n:
        ranges *= 2
    bits = 60 - (ranges.bit_length() - 1)
    keyed = sized.withColumn("key", random_key(F.col("doc_id"), seed)).withColumn("bin", F.shiftright("key", bits))
    targets = source_targets(per_source.select("source", "source_size"), weights, max_epochs)
    # prefix sums of the ranges: a table of sources x ranges rows
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    over = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(over), F.lit(0)))
    bins = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "bin_start")
    targets = targets.withColumnRenamed("source", "t_source")
    bins = bins.join(targets, F.col("s").eqNullSafe(F.col("t_source"))).drop("t_source")
    # rows of one range, in key order
    inner = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("inner_start", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b", "bin")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", whole)
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(rest - (F.col("bin_start") + F.col("inner_start")), F.lit(0)), F.col("size"))
    return rows.withColumn("part", part.cast("long")).drop("inner_start", "bin_start")


def mix_plan(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix")
    out = mix_sizes(sized, **kw)
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def source_cuts(docs: DataFrame, **kw) -> DataFrame:
    """One row for each source: `epochs`, and `cut`, the last place in key order that the last pass reaches.

    A place is (key, doc_id, size); the cut also has how many rows share it and how many words they give in all. Null
    where the last pass takes nothing.
    """
    rows = mix_sizes(materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix"), **kw).where("size > 0")
    places = rows.groupBy("source", "key", "doc_id", "size").agg(F.max("epochs").alias("epochs"), F.sum("part").alias("words"), F.count(F.lit(1)).alias("n"))
    reached = F.when(F.col("words") > 0, F.struct("key", "doc_id", "size", "words", "n"))
    return places.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(reached).alias("cut"))


def mix_documents(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """The mix itself: each document once for every whole pass, and once more where the last pass takes it.

    The document in which a source's budget ends is cut at that word, so that every source has its exact budget;
    n_chars, if there, follows the text. Columns are those of docs. In key order the last pass takes the rows before
    its source's cut whole and none after it, so each row is decided by the row of its source alone and texts aren't
    shuffled. Where several rows stand at the cut (equal ids and sizes), the first by a hash of the row are taken.
    """
    cuts = materialize(source_cuts(docs, seed=seed, **kw), "cuts")
    s, e, cut, own, part, key, take = (scratch(x) for x in ("source", "epochs", "cut", "size", "part", "key", "take"))
    cuts = cuts.select(F.col("source").alias(s), F.col("epochs").alias(e), F.col("cut").alias(cut))
    small = cuts.count() <= MAX_BROADCAST
    rows = docs.withColumns({own: word_count(F.col("text")), key: random_key(F.col("doc_id"), seed)})
    rows = rows.join(F.broadcast(cuts) if small else cuts, F.col("source").eqNullSafe(F.col(s)))  # at most MAX_BROADCAST rows
    place = F.struct(F.col(key).alias("key"), F.col("doc_id").alias("doc_id"), F.col(own).alias("size"))
    last = F.struct(F.col(cut)["key"].alias("key"), F.col(cut)["doc_id"].alias("doc_id"), F.col(cut)["size"].alias("size"))
    at_cut, words = F.col(cut).isNotNull() & (place == last), F.col(cut)["words"]
    rows = rows.withColumn(part, F.when(at_cut, words).when(F.col(cut).isNotNull() & (place < last), F.col(own)).otherwise(0))
    if not cuts.where(F.col(cut)["n"] > 1).isEmpty():
        tied = at_cut & (F.col(cut)["n"] > 1)
        row = F.xxhash64(*[k for k, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
        turn = F.row_number().over(Window.partitionBy(s).orderBy(row)) - 1  # of the rows at one source's cut
        left = F.least(F.greatest(words - turn * F.col(own), F.lit(0)), F.col(own))
        rows = rows.where(~tied).unionByName(rows.where(tied).withColumn(part, left))
    # full copies, then the last pass: size words if it takes the document whole, else part
    copies = F.concat(F.array_repeat(F.col(own), F.col(e).cast("int")), F.when(F.col(part) > 0, F.array(F.col(part))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.where(F.col(own) > 0).withColumn(take, F.explode(copies))
    # each word with the white space after it; white space at the start is an item of its own
    items = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.rlike(F.col("text"), F.lit(r"^[\x20\x09-\x0D]")).cast("long")
    head = F.array_join(F.slice(items, F.lit(1), (F.col(take) + lead).cast("int")), "")
    text = F.when(F.col(take) >= F.col(own), F.col("text")).otherwise(head)
    kinds = dict(docs.dtypes)
    out = {c: (text if c == "text" else F.length(text).cast(kinds[c]) if c == "n_chars" else F.col(c)) for c in docs.columns}
    return rows.select(*[v.alias(k) for k, v in out.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'))
         - length(replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), 'w', '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix-1'), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(source_size AS DOUBLE) * 3 AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w
      FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
      FROM w),
g AS (SELECT *, cap * w_left < w * (total - before_) AS capped FROM f),
h AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS all_caps, sum(CASE WHEN NOT capped THEN w END) OVER () AS free_w FROM g),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * (total - all_caps) / free_w END AS target FROM h),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
        CASE WHEN t.source_size > 0 THEN CAST(round(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - start, 0), size) AS BIGINT) AS taken
FROM r
"""
