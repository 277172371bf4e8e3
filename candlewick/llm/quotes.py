"""Quotation linking in conversations; DataFrame functions only.

A line's level is the number of its leading `>` marks. Lines of one level in a row form a passage; an
attribution line ("... wrote:", "... schrieb:", "... a écrit :", "... escribió:") right before a quote goes with
it. Passages are normalised (lower case, runs of white space as one space, trimmed) and hashed. Every message offers the
same hashes of its own, unquoted text: whole, each run of it between quotes, by paragraph and by line. A quoted
passage links to the latest earlier message of its conversation that offers its hash; one that no message offers
whole (a trimmed quote) links to the latest that offers each of its paragraphs, or else each of its lines. A
message's parent is the latest one that its level-1 passages link to. Ancestors are found by pointer doubling, and each conversation comes in reply order:
by the thread's first turn, then depth, then turn.

Rows of a conversation are dealt by ranges of their order and counted by part, and the latest offer of a hash is
looked for in cells of turns first, so no task holds a whole conversation or a whole hash. n_quotes and n_linked count
distinct passages (level and text).

Defined cases: null texts have no quotes and an empty own text; whole texts count, however long; empty passages link
with nothing; null turns come last and are never quoted, null conversations keep their messages apart from links;
repeated rows share their results (positions among ties are arbitrary but distinct); extra columns do not matter; an
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: How common mail programs introduce a quote, at a line's end.
ATTRIBUTION = r"(?i)(?:wrote|writes|schrieb|a écrit|escribió)\s?:\s*$"
CHUNK = 10  # bits of a turn within a cell


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def digest(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.md5(text))


def leveled(line: Column) -> Column:
    """level and body of a line: its `>` marks, each with at most one blank before it, and what follows them.

    Plain character classes only: a repeated group would recurse for every mark of a long line.
    """
    head = F.get(F.split(F.regexp_extract(line, r"^[ \t>]*", 0), r"[ \t]{2}", 2), F.lit(0))
    level = F.length(head) - F.length(F.replace(head, F.lit(">"), F.lit("")))
    rest = F.substring(line, F.length(F.rtrim(head, F.lit(" \t"))) + 1, F.length(line))
    return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(rest, r"^[ \t]", "")).otherwise(line).alias("body"))


def passages(messages: DataFrame) -> DataFrame:
    """Adds lines (level, body), starts (first line of each passage) and runs (level, body, in order)."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), leveled)
    out = messages.withColumn("lines", lines)
    # an attribution takes the level of the quote that follows it
    lead = F.transform("lines", lambda x, i: F.struct(F.when((F.get("lines", i + 1)["level"] > x["level"]) & F.regexp_like(x["body"], F.lit(ATTRIBUTION)), F.lit(-1)).otherwise(x["level"]).alias("level"), x["body"].alias("body")))
    out = out.withColumn("lines", lead)
    out = out.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"])))
    run = lambda i, k: F.struct(F.get("lines", i)["level"].alias("level"), F.array_join(F.transform(F.slice("lines", i + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - i), lambda x: x["body"]), "\n").alias("body"))
    return out.withColumn("runs", F.transform("starts", run))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, key, own_text, own_runs and quoted (level, hash, parts) of every message.

    parts: the hashes of a passage whole, of its paragraphs and of its lines, each a set.

    key stands for (conv_id, turn, role, text), so repeated rows share it.
    """
    key = F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}))
    rows = passages(messages.select("conv_id", "turn", "role", "text")).withColumn("key", key)
    own_runs = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"])
    own = F.trim(F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"]), "\n"))
    cut = lambda body, at: F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(body, at), lambda x: digest(normal(x))))))
    parts = lambda body: F.array(F.array_compact(F.array(digest(normal(body)))), cut(body, r"\n\s*\n"), cut(body, r"\n"))
    quoted = F.transform(F.filter("runs", lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), digest(normal(r["body"])).alias("hash"), parts(r["body"]).alias("parts")))
    return rows.select("conv_id", "turn", "role", "key", own.alias("own_text"), own_runs.alias("own_runs"), quoted.alias("quoted"))


def found(offer: DataFrame, ask: DataFrame) -> DataFrame:
    """conv_id, turn, key, level, hash, to_turn of the passages that link: whole, or by paragraphs, or by lines.

    A passage's parts agree on the latest earlier turn that offers all of them: the latest turn of each part is a
    bound, and while the parts' bounds differ, each part is asked again for the latest turn up to the least one.
    """
    passage = ["conv_id", "turn", "key", "level", "hash"]
    wanted = ask.select(*passage, F.posexplode("parts").alias("way", "hashes")).where("size(hashes) > 0")
    wanted = wanted.withColumns({"n": F.size("hashes"), "upto": F.col("turn")})
    left, done = written(wanted.select(*passage, "way", "n", "upto", F.explode("hashes").alias("part")), "asked"), None
    while True:
        # the latest earlier offer: both sides in one ordered run a hash, so a hash that all messages share makes no pairs
        cells = F.struct(*passage, "way", "n").alias("ask")
        want = left.select("conv_id", F.col("part"), F.col("upto").alias("at"), F.lit(0).alias("side"), cells)
        give = offer.join(left.select("conv_id", F.col("part").alias("hash")).distinct(), ["conv_id", "hash"], "left_semi")
        run = want.unionByName(give.select("conv_id", F.col("hash").alias("part"), F.col("from_turn").alias("at"), F.lit(1).alias("side")), allowMissingColumns=True)
        run = run.withColumn("cell", F.shiftright(F.col("at").cast("long"), CHUNK))
        offered = F.max(F.when(F.col("side") == 1, F.col("at")))
        cells = run.groupBy("conv_id", "part", "cell").agg(offered.alias("top"), F.min("side").alias("least"))
        before = F.max("top").over(Window.partitionBy("conv_id", "part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.withColumn("before", before).where("least = 0").select("conv_id", "part", "cell", "before")
        w = Window.partitionBy("conv_id", "part", "cell").orderBy(F.struct("at", "side")).rowsBetween(Window.unboundedPreceding, -1)
        met = run.withColumn("inner", offered.over(w)).where("side = 0").join(cells, ["conv_id", "part", "cell"])
        met = met.withColumn("last", F.coalesce("inner", "before")).where("last is not null").select("ask.*", "part", "last")
        met = written(met, "met")
        each = met.groupBy(*passage, "way", "n").agg(F.count("*").alias("m"), F.min("last").alias("lo"), F.max("last").alias("hi")).where("m = n")
        each = written(each, "bounds")
        linked_now = each.where("lo = hi").select(*passage, "way", F.col("lo").alias("to_turn"))
        done = linked_now if done is None else done.unionByName(linked_now)
        again = each.where("lo < hi").select(*passage, "way", (F.col("lo") + 1).alias("upto"))
        if not again.limit(1).count():
            break
        left = written(met.join(again, [*passage, "way"]).select(*passage, "way", "n", "upto", "part"), "asked")
    best = done.groupBy(*passage).agg(F.min_by("to_turn", "way").alias("to_turn"))
    return best


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_turn, root_turn, depth, position."""
    rows = written(linked(messages), "messages")
    cut = F.flatten(F.transform("own_runs", lambda r: F.split(r, r"\n\s*\n")))
    units = F.array_distinct(F.concat(F.array(F.col("own_text")), F.col("own_runs"), F.split("own_text", r"\n\s*\n"), cut, F.split("own_text", r"\n")))
    offer = rows.where("conv_id is not null and turn is not null and own_text <> ''").select("conv_id", F.col("turn").alias("from_turn"), F.explode(F.transform(units, lambda u: digest(normal(u)))).alias("hash")).where("hash is not null").distinct()
    ask = rows.where("conv_id is not null and turn is not null and size(quoted) > 0").select("conv_id", "turn", "key", F.explode("quoted").alias("q")).select("conv_id", "turn", "key", "q.level", "q.hash", "q.parts").where("hash is not null").distinct()
    hit = found(offer, ask)
    parent = hit.groupBy("key").agg(F.max(F.when(F.col("level") == 1, F.col("to_turn"))).alias("parent_turn"), F.count("*").alias("n_linked"))
    nodes = written(rows.join(parent, "key", "left").select("conv_id", "turn", "role", "key", "own_text", F.size(F.array_distinct(F.filter(F.transform("quoted", lambda q: F.struct(q["level"], q["hash"])), lambda q: q["hash"].isNotNull()))).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn"), "nodes")
    # a turn's parent, root and depth; several messages of a turn count as the one with the latest parent
    up = nodes.where("conv_id is not null and parent_turn is not null").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up"))
    up = written(up.withColumn("steps", F.lit(1)), "up")
    while True:
        far = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        moved = up.join(far, ["conv_id", "up"], "left")
        if not moved.where("next is not null").limit(1).count():
            break
        up = written(moved.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "up")
    placed = nodes.join(up, ["conv_id", "turn"], "left").withColumns({"root_turn": F.coalesce("up", "turn"), "depth": F.coalesce("steps", F.lit(0))})
    # positions: dealt by ranges of the order, counted by part, then within a part
    order = ["conv_id", F.col("root_turn").asc_nulls_last(), "depth", F.col("turn").asc_nulls_last(), "key", "tie"]
    dealt = placed.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    slots = written(dealt.drop("tie").withColumn("slot", F.monotonically_increasing_id()), "slots")
    part = F.shiftright("slot", 33).alias("part")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = slots.groupBy("conv_id", part).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = Window.partitionBy("conv_id", "part").orderBy("slot")
    both = slots.withColumn("part", part).withColumn("rank", F.row_number().over(inner)).join(base.select(F.col("conv_id").alias("c2"), F.col("part").alias("p2"), "base"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")))
    return both.select("conv_id", "turn", "role", F.col("own_text").alias("text"), "n_quotes", "n_linked", "parent_turn", "root_turn", "depth", (F.col("base") + F.col("rank")).cast("long").alias("position"))
