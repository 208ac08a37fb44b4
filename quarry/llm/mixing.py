"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed position in its source: the first 60 bits of the MD5 of its id. A source
with budget b takes the documents at the lowest positions that fill b. Where that threshold lies is
found without sorting: words are summed by source and 12-bit bucket, the bucket in which the budget
runs out is split by the next 12 bits, and so on; only the rows of that one boundary bucket are read
again. Thresholds nest: a larger budget takes a superset, and budgets above the source's size take
all of it once more for each whole multiple.

Defined cases: a null text has size 0; a null source is one source, last in order; a document of size 0
takes no words and stands in the mix as often as the others at its position, at most ``cap`` times; a source
without any words has target 0 and stands in the mix not at all; an empty table gives no rows; rows with equal ids share a position and are taken or
left together; columns beside id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.columns import named
from quarry.plans.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
DIGITS, STEP = 15, 3  #: hex digits of a position; digits by which a bucket is refined


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(src, source_size) -> plus weight, target.

    Budget ``share`` * all sizes, dealt by weight; no source gets over ``cap`` times its size, and what
    it can't take is dealt again by weight. Ordered by cap * size / weight the sources at their cap are
    a prefix, so one pass over the sources settles all rounds. The windows run over one row a source.
    """
    order = Window.orderBy("src")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    whole = Window.partitionBy(F.lit(1))
    before = whole.orderBy((F.lit(cap) * F.col("source_size")) / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(float(cap)) * F.col("source_size")
    rest = F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rated = ranked.withColumn("all_size", F.sum("source_size").over(whole).cast("double")).withColumn("rest", rest).withColumn("left", left).withColumn("room", room)
    full = F.col("room") * F.col("left") <= F.col("rest") * F.col("weight")
    rated = rated.withColumn("full", full)
    first_open = F.max_by(F.struct("rest", "left"), F.when(~F.col("full"), F.col("left"))).over(whole)
    rated = rated.withColumn("open", first_open)
    dealt = F.col("open.rest") * F.col("weight") / F.col("open.left")
    return rated.select("src", "source_size", "weight", F.when(F.col("full"), F.col("room")).otherwise(dealt).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(src, pos, size) and (src, budget over 0) -> (src, cut, take_cut).

    Rows below ``cut`` are within the budget; the rows at it are taken if that comes nearer to it.
    """
    rest, found = rows, None
    for digits in range(STEP, DIGITS + 1, STEP):
        by = rest.join(budgets, "src").groupBy("src", "budget", F.substring("pos", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        upto = Window.partitionBy("src").orderBy("bucket")  # 4,096 rows a source at most
        by = by.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
        edge = materialize(by.where("before <= budget and upto > budget").select("src", "bucket", (F.col("budget") - F.col("before")).alias("budget"), "words", "first", (F.col("first") == F.col("last")).alias("single")), "mix-edge")
        last = edge.where("single").select("src", F.col("first").alias("cut"), (F.col("words") - F.col("budget") <= F.col("budget")).alias("take_cut"))
        found = last if found is None else found.unionByName(last)
        at = edge.where("not single")
        if at.isEmpty():
            break
        at_bucket = at.select("src", F.col("bucket").alias("at"))
        rest = materialize(rest.withColumn("at", F.substring("pos", 1, digits)).join(at_bucket, ["src", "at"], "left_semi").drop("at"), "mix-rest")
        budgets = at.select("src", "budget")
    return found


def positions(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with __src (a key for its source, null last), __size and __pos."""
    src = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    pos = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    return docs.withColumns({"__src": src, "__size": word_count(F.col(text_col)), "__pos": pos})


def plan(slim: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(src, size, pos) -> a row a source: source_size, target, whole, cut, take_cut."""
    sizes = slim.groupBy("src").agg(F.sum("size").alias("source_size"))
    goal = materialize(targets(sizes, weights, share, cap), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole)
    budgets = goal.select("src", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = thresholds(slim, budgets.where("budget > 0"))  # others take every row ``whole`` times
    return materialize(goal.join(cuts, "src", "left"), "mix-plan")


def times(prefix: str = ""):
    """How often the mix takes a row at ``pos``, from its source's plan."""
    pos, cut, whole, take_cut = (F.col(prefix + c) for c in ("pos", "cut", "whole", "take_cut"))
    extra = (pos < cut) | ((pos == cut) & take_cut)
    return whole + F.when(cut.isNotNull() & extra, 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per document: id, size, source_size, target, times, taken (= size * times)."""
    rows = positions(docs.select(id_col, text_col, source_col), id_col, text_col, source_col)
    slim = materialize(rows.select(F.col(id_col).alias("id"), F.col("__src").alias("src"), F.col("__size").alias("size"), F.col("__pos").alias("pos")), "mix-rows")
    by_source = plan(slim.drop("id"), weights, share, cap)
    taken = slim.join(by_source, "src").withColumn("times", times())
    return taken.select(F.col("id").alias(id_col), "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: the rows and columns of docs, each row as often as it is taken."""
    rows = positions(docs, id_col, text_col, source_col)
    slim = materialize(rows.select(F.col("__src").alias("src"), F.col("__size").alias("size"), F.col("__pos").alias("pos")), "mix-rows")
    by_source = plan(slim, weights, share, cap).select(F.col("src").alias("__src"), "whole", "cut", "take_cut")
    by_source = by_source.select("__src", *[F.col(c).alias(f"__{c}") for c in ("whole", "cut", "take_cut")])
    return rows.join(by_source, "__src").withColumn("__n", F.explode(F.array_repeat(F.lit(1), times("__").cast("int")))).select(*map(named, docs.columns))
