"""Mix sources to target weights with distributed prefix sums. DataFrame functions only.

Every document gets a hash-random key; the keys cut each source into
``SLICES`` ranges of equal probability. Sizes are summed per (source, slice),
the running sums over a source's slices (a small table) give each slice its
offset, and a window inside (source, slice) finishes the prefix sum: a source
of any size is spread over its slices. The prefix is cut at the source's
budget, at the document border nearest to it; a budget above the source's
size first takes whole epochs of it.

Defined cases: a null text has size 0 and is taken 0 words; the null source is
a source of its own, last in order; rows that share an id share a key and
follow each other in the order of source text; equal rows are interchangeable;
sources without words have target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MAX_EPOCHS = 150, 2
SLICE_BITS, KEY_BITS = 10, 60
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """The first 60 bits of md5(seed:id); a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (nosrc, src, source_size): the target. One row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and
    share ``share_percent`` of all words; a target stops at ``max_epochs``
    times its source and the excess goes to the others by weight. In the
    order of cap / weight the capped sources come first, so one running sum
    finds them: a source is capped if its cap is below its share of what the
    sources before it leave.
    """
    order = Window.orderBy("nosrc", F.col("src").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    every = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(every) * share_percent / 100).withColumn("all_weight", F.sum("weight").over(every))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "nosrc", F.col("src").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(rank), F.lit(0)))
         .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(rank), F.lit(0))))
    t = t.withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    return t.select("nosrc", "src", "source_size", F.when(F.col("capped"), F.col("cap").cast("double"))
                    .otherwise(rest * F.col("weight") / F.when(free > 0, free)).alias("target"))


def mix_plan(rows: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add source_size, target and copies to rows of (nosrc, src, slice, key, size, ...); copies: how often a row is taken."""
    slices = stage(rows.groupBy("nosrc", "src", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices")
    goal = targets(slices.groupBy("nosrc", "src").agg(F.sum("slice_size").alias("source_size")), weights, share_percent, max_epochs)
    earlier = Window.partitionBy("nosrc", "src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
               .join(goal, ["nosrc", "src"]).drop("slice_size"))
    inside = Window.partitionBy("nosrc", "src", "slice").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["nosrc", "src", "slice"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.col("target") - epochs * F.col("source_size")
    start = F.col("before") + F.col("inner")
    extra = F.when(2 * (budget - start) > F.col("size"), 1).otherwise(0)  # more than half of the row lies below the budget
    return placed.withColumn("copies", F.when(F.col("size") > 0, epochs + extra).otherwise(F.lit(0)).cast("long"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """nosrc, src, slice, key, size and tie (for rows that share an id) of every row, beside its own columns."""
    key = random_key(F.col(id_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("nosrc"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
                       F.shiftright(key, KEY_BITS - SLICE_BITS).alias("slice"), key.alias("key"),
                       word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))


def mix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    plan = mix_plan(stage(keyed(docs, id_col, text_col, source_col), "mix-keys"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as it is taken, whole, with its own columns only.

    A source takes its rows in key order up to its budget, so its last row
    decides for all others: rows before it are taken once more, rows behind it
    are not, and no text is shuffled. Only rows that equal the last one in id
    and text are dealt one by one, where the budget ends among them. Rows
    without words are in no source's budget; they stay once.
    """
    plan = mix_plan(stage(keyed(docs, id_col, text_col, source_col), "mix-keys"))
    place = F.struct("key", "doc_id", "tie")
    rows = stage(plan.where("size > 0").select("nosrc", "src", "source_size", "target", place.alias("place"), "copies"), "mix-copies")
    epochs = F.floor(F.col("target") / F.col("source_size")).cast("long")
    cut = rows.groupBy("nosrc", "src").agg(F.max(epochs).alias("epochs"), F.max(F.when(F.col("copies") > epochs, F.col("place"))).alias("last"))
    cut = stage(cut, "mix-cut")
    last = (rows.join(cut, ["nosrc", "src"]).where(F.col("place").eqNullSafe(F.col("last"))).groupBy("nosrc", "src")
            .agg(F.sum((F.col("copies") > F.col("epochs")).cast("long")).alias("_once"), F.count("*").alias("_equal")))
    cuts = stage(cut.join(last, ["nosrc", "src"], "left").select(F.col("nosrc").alias("_nosrc"), F.col("src").alias("_src"), F.col("epochs").alias("_epochs"),
                                                                 F.col("last").alias("_last"), "_once", "_equal"), "mix-cuts")
    key = F.struct(random_key(F.col(id_col)).alias("key"), F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))
    own = docs.withColumns({"_at": key, "_s": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_n": F.col(source_col).isNull(), "_size": word_count(F.col(text_col))})
    own = own.join(cuts, (F.col("_s") == F.col("_src")) & (F.col("_n") == F.col("_nosrc")), "left")
    dealt = (F.col("_size") > 0) & F.col("_last").isNotNull() & F.col("_at").eqNullSafe(F.col("_last")) & (F.col("_once") < F.col("_equal"))
    before = F.col("_last").isNotNull() & (F.col("_at") <= F.col("_last"))
    times = F.when(F.col("_size") > 0, F.col("_epochs") + before.cast("int")).otherwise(F.lit(1)).cast("int")
    out = own.where(~F.coalesce(dealt, F.lit(False))).withColumn("_times", times)
    if not cuts.where("_once < _equal").isEmpty():
        rank = F.row_number().over(Window.partitionBy("_n", "_s").orderBy(F.lit(0)))
        out = out.unionByName(own.where(dealt).withColumn("_times", (F.col("_epochs") + (rank <= F.col("_once")).cast("int")).cast("int")))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(*docs.columns)


def mix_sql(documents: str = "documents") -> str:
    """The same mix as DuckDB SQL."""
    return f"""
WITH rows AS (
  SELECT doc_id, source IS NULL AS nosrc, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {KEY_BITS // 4}))::BIGINT AS key,
         md5(coalesce(text, '')) AS tie
  FROM {documents}),
s AS (SELECT nosrc, src, sum(size)::BIGINT AS source_size FROM rows GROUP BY nosrc, src),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY nosrc, encode(src))) - 1) % {len(WEIGHTS)} + 1] AS weight,
             source_size * {MAX_EPOCHS} AS cap FROM s),
x AS (SELECT *, sum(source_size) OVER () * {SHARE_PERCENT} / 100.0 AS total, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, total - coalesce(sum(cap) OVER o, 0) AS lft, all_weight - coalesce(sum(weight) OVER o, 0) AS left_weight FROM x
      WINDOW o AS (ORDER BY cap::DOUBLE / weight, nosrc, encode(src) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * left_weight <= lft * weight AS capped FROM l),
g AS (SELECT nosrc, src, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight
         / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0))::DOUBLE END AS target FROM c),
p AS (SELECT r.doc_id, r.size, g.source_size, g.target,
             coalesce(sum(r.size) OVER (PARTITION BY r.nosrc, r.src ORDER BY r.key, r.doc_id, r.tie
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
      FROM rows r JOIN g ON r.nosrc = g.nosrc AND r.src = g.src)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN size > 0 THEN (epochs + CASE WHEN 2 * (target - epochs * source_size - start) > size THEN 1 ELSE 0 END) * size
        ELSE 0 END)::BIGINT AS taken
FROM p"""
