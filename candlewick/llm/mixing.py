"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Sources, by code point with null last, weigh 5, 2, 1, repeating, and share all words; a target stops at
MOST times its source's size and the excess goes to the others by weight (the fixed point is found directly,
from the sources in order of size over weight). A source is to be taken target / size times: every document
gets the whole copies, which are certain. For the rest, documents are ranked by random odds over inclusion
odds, and the ranks are taken until the rest's words are reached, to the nearest document. Inclusion odds are
f / (1 - f), f the missing share, times (size / mean size) ** TILT: longer documents are somewhat likelier. The rank
where the words are reached is found by two histograms of CELLS cells and one small window over distinct documents,
so no task holds a source. Equal rows have one rank; where the words are reached among them, so many of them are
taken as fit, counted by the partitions they were written in.

Defined cases: null and wordless texts have size 0 and are taken 0 times; a null source is a source of its own; whole
texts count, however long; random numbers follow from doc_id, source and text, so reruns agree, and which of several
equal rows is taken does not show; columns of docs may have any names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_of, written

WEIGHTS = (5, 2, 1)
MOST, TILT, CELLS = 3, 0.5, 1024


def sized(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, size (words), u (uniform in (0, 1)) and the columns of more for every row."""
    text = F.coalesce("text", F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bits = F.shiftrightunsigned(F.xxhash64(id_, F.coalesce("source", F.lit("")), text, F.lit(5)), 12)
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), ((bits + 0.5) / float(1 << 52)).alias("u"), *more)


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, n, target for every source; one small row a source."""
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("most", (MOST * F.col("source_size")).cast("double"))
    fill = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), fill.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    src = src.withColumn("share", share)
    # the share at the first source that stays below its stop holds for all after it
    below = F.when(F.col("most") > F.col("share") * F.col("w"), F.col("share"))
    level = F.first(below, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    src = src.withColumn("level", level)
    return src.withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("w")), "most")).select("source", "source_size", "n", "target")


def mix(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs (doc_id, text, source).

    With whole_rows also `row`, a struct of all columns of docs, which keeps clashing names apart.
    """
    rows = written(sized(docs), "sizes")
    plan = targets(rows)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = written(plan.withColumn("f", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), ratio - F.col("whole")))), "plan")
    same = F.col("p.source").eqNullSafe(F.col("r.source"))
    odds = F.col("f") / (1 - F.col("f")) * F.pow(F.col("size") * F.col("n") / F.col("source_size"), F.lit(TILT))
    q = F.when(F.col("size") > 0, F.col("u") / (1 - F.col("u")) / odds)
    x = F.col("q") / (1 + F.col("q"))  # ascending with q, below 1

    def rank(of: DataFrame, *more: str) -> DataFrame:
        out = of.alias("r").join(plan.alias("p"), same).select("doc_id", "r.source", "size", "u", "source_size", "target", "whole", "rest", q.alias("q"), *more)
        return out.withColumn("c1", F.floor(x * CELLS).cast("int")).withColumn("c2", F.floor((x * CELLS - F.col("c1")) * CELLS).cast("int"))

    ranked = rank(rows)
    live = ranked.where((F.col("size") > 0) & (F.col("rest") > 0))

    def reached(cells: DataFrame, cell: str, keys: list[str]) -> DataFrame:
        """Of each key, the cell in which the words get to the rest, and the words before it."""
        w = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        run = cells.withColumn("run", F.col("base") + F.sum("words").over(w))
        hit = run.where(F.col("run") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct(*keys, (F.col("run") - F.col("words")).alias("base")), cell).alias("s"))
        return hit.select("source", "s.*")

    one = live.groupBy("source", "rest", "c1").agg(F.sum("size").alias("words")).withColumn("base", F.lit(0))
    first = written(reached(one, "c1", ["c1"]).withColumnsRenamed({"source": "s1", "c1": "k1"}), "cells")
    inside = live.join(first, F.col("source").eqNullSafe(F.col("s1")) & (F.col("c1") == F.col("k1")))
    two = inside.groupBy("source", "rest", "base", "c1", "c2").agg(F.sum("size").alias("words"))
    second = written(reached(two, "c2", ["c1", "c2"]).withColumnsRenamed({"source": "s2", "c1": "k1", "c2": "k2", "base": "base2"}), "cells")
    last = live.join(second, F.col("source").eqNullSafe(F.col("s2")) & (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")))
    me, edges = F.struct("q", "size", "doc_id"), ["source", "rest", "base2"]
    w = Window.partitionBy("source").orderBy("q", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = last.groupBy(*edges, "q", "size", "doc_id").agg(F.count("*").alias("m")).withColumn("run", F.col("base2") + F.sum(F.col("size") * F.col("m")).over(w))
    room = F.col("rest") - F.col("run") + F.col("size") * F.col("m")
    hit = run.where(F.col("run") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct(me.alias("border"), F.floor(room / F.col("size") + 0.5).alias("k")), me).alias("s"))
    edge = written(second.join(hit, F.col("s2").eqNullSafe(F.col("source")), "left").select("s2", "k1", "k2", "s.border", "s.k"), "edge")
    cell, at_cell = F.struct("c1", "c2"), F.struct(F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    inside = F.when(F.col("k1").isNull(), True).when(cell < at_cell, True).when(cell > at_cell, False).otherwise(F.coalesce(me < F.col("border"), F.lit(True)))
    live_row = (F.col("rest") > 0) & (F.col("size") > 0)
    whole = F.when(F.col("size") > 0, F.col("whole")).otherwise(0)
    columns = ["doc_id", "source", "size", "source_size", "target", *["row"] * whole_rows]

    def placed(of: DataFrame) -> DataFrame:
        out = rank(of, *["row"] * whole_rows).join(edge, F.col("source").eqNullSafe(F.col("s2")), "left")
        return out.withColumn("equal", F.coalesce(live_row & (cell == at_cell) & me.eqNullSafe(F.col("border")), F.lit(False)))

    row = row_of(docs)
    every = sized(docs, row) if whole_rows else rows
    out = placed(every).where("not equal").select(*columns, (whole + F.when(live_row & inside, 1).otherwise(0)).cast("long").alias("copies"))
    # rows at the border: equal to one another, one kind a source; k of them are taken, by the order they were written in
    kind = edge.where("k is not null").select("s2", F.col("border.doc_id").alias("id2"))
    near = docs.join(kind, docs["source"].eqNullSafe(kind["s2"]) & docs["doc_id"].eqNullSafe(kind["id2"]), "left_semi")
    border = written(placed(sized(near, row) if whole_rows else rows).where("equal").select(*columns, "whole", "k", F.monotonically_increasing_id().alias("slot")), "border")
    part = F.shiftright("slot", 33).alias("part")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = border.groupBy("source", part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({"source": "s4", "part": "p4"})
    own = Window.partitionBy("source", "part").orderBy("slot")
    numbered = border.withColumn("part", part).withColumn("number", F.row_number().over(own)).join(parts, F.col("source").eqNullSafe(F.col("s4")) & (F.col("part") == F.col("p4")))
    return out.unionByName(numbered.select(*columns, (whole + F.when(F.col("before") + F.col("number") <= F.col("k"), 1).otherwise(0)).cast("long").alias("copies")))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it."""
    out = mix(docs, whole_rows=True).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn")).select("row.*")


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every row."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
