"""Mixing sources to target weights by pivotal dependent rounding; column functions only.

The sources, by code point and null last, share the size of the whole corpus by the weights 1, 2, 3, 1, ... A target stops at
``MOST_COPIES`` times the size of its source, and the excess is shared again by weight among the others. A document of a
source is wanted ``target / source size`` times on average: the whole part is taken for sure, the fraction is a probability.

Probabilities are rounded in pairs. Of a pair one hands over mass (probability times size) to the other until one of them
is 0 or 1; which direction is drawn so that no probability changes on average. So the words taken from a source keep their
sum at every step. What is left of a pair meets the next document.

Documents of a source are split into classes of size by powers of eight, and the largest go first. Groups of about
``GROUP`` members of a class are folded, each leaving one residual, and residuals are grouped and folded again until a source
has at most ``TOP`` of them, which one last fold reduces to one: a tree whose leaves are dealt by hash, so that a source with
a third of all rows is many tasks. The one document left over is rounded on its own, and what that adds or takes is shared
by all smaller documents of the source, whose common probability moves a little (by nothing on average). So in the end the
words taken miss the target by less than the size of one of the smallest documents, unless the smaller ones are too few to
make up for a larger one.

Draws are hashes of the documents and the level of the tree, so reruns agree. Equal rows (id, source, size) are counted
first and told apart by their number.

Defined cases: a null text has size 0 and is never taken; a null source is one source, the last; null ids and repeated rows
are documents of their own; extra columns are ignored; an empty table has no result. Results have one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumetrics.llm.common import prepare
from albumetrics.sources.workspace import Scratch

MOST_COPIES = 3
WEIGHTS = 3
GROUP = 48
TOP = 64
#: Fractions nearer to a whole number than this are whole.
WHOLE = 1e-9
SEED = 20

_SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """Number of runs of other than white space; null has none."""
    trimmed = F.ltrim(text, F.lit(" \t\n\x0b\x0c\r"))
    # Every word and the space after it become one letter: no list of words is made.
    marks = F.regexp_replace(trimmed, f"[^{_SPACE}]++[{_SPACE}]*+", "w")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Add the number ``_n`` of each source within its range ``_part``; no window goes over all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Ranks are counted per range of sources and moved by the number of sources before the range. Sources at their stop are
    found in rounds; only two sums come to the driver.
    """
    numbered = scratch.table(ranked_sources(sizes), "sources")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_c"))
    # One row per partition of the range exchange.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_n") - 1
    weighed = numbered.join(offsets, "_part").select(
        "source", "source_size", (rank % WEIGHTS + 1).cast("double").alias("weight"),
        (F.col("source_size") * MOST_COPIES).cast("double").alias("stop"))
    weighed = scratch.table(weighed, "weights")
    whole = weighed.agg(F.sum("source_size")).first()[0]
    if not whole:
        return weighed.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    level, stopped = 0.0, -1
    while True:
        above = F.col("stop") < F.col("weight") * level
        found = weighed.agg(
            F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("stop")).otherwise(0.0)).alias("at_stop"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if found["n"] == stopped or not found["open"]:
            break
        stopped = found["n"]
        level = (whole - found["at_stop"]) / found["open"]
    return weighed.select(
        "source", "source_size", "weight", F.least(F.col("stop"), F.col("weight") * F.lit(level)).alias("target"))


#: A document in the tree: its identity, its size, the probability so far, and whether it is taken once more.
_ITEM = "struct<doc_id:bigint,copy:bigint,size:bigint,p:double>"
_STATE = f"struct<held:{_ITEM},settled:array<{_ITEM}>>"


def _draw(a: Column, b: Column, level: int) -> Column:
    key = F.xxhash64(a["doc_id"], a["copy"], a["size"], b["doc_id"], b["copy"], b["size"], F.lit(level), F.lit(SEED))
    return F.pmod(key, F.lit(1 << 52)) / F.lit(float(1 << 52))


def _with_p(item: Column, p: Column) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["copy"].alias("copy"), item["size"].alias("size"), p.alias("p"))


def _pivot(state: Column, item: Column, level: int) -> Column:
    """One step of the fold: mass moves between the held document and the next until one of the two is settled."""
    held = state["held"]
    up = F.least((1 - held["p"]) * held["size"], item["p"] * item["size"])
    down = F.least(held["p"] * held["size"], (1 - item["p"]) * item["size"])
    rises = _draw(held, item, level) * (up + down) < down
    fills = (1 - held["p"]) * held["size"] <= item["p"] * item["size"]
    drains = held["p"] * held["size"] <= (1 - item["p"]) * item["size"]
    # Of either direction: is the held document settled, and what is left to the other one?
    settles = F.when(rises, fills).otherwise(drains)
    outcome = F.when(rises, F.lit(1.0)).otherwise(0.0)
    item_p = F.when(rises, item["p"] - up / item["size"]).otherwise(item["p"] + down / item["size"])
    held_p = F.when(rises, held["p"] + up / held["size"]).otherwise(held["p"] - down / held["size"])
    inside = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    next_held = F.when(settles, _with_p(item, inside(item_p))).otherwise(_with_p(held, inside(held_p)))
    settled = F.when(settles, _with_p(held, outcome)).otherwise(_with_p(item, 1 - outcome))
    return F.struct(next_held.alias("held"), F.concat(state["settled"], F.array(settled)).alias("settled"))


def _folded(groups: DataFrame, level: int) -> DataFrame:
    """Per group of items its residual ``held`` and the ``settled`` rest; largest documents come first."""
    ordered = F.array_sort(F.col("items"), lambda a, b: (
        F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1))
        .when(F.xxhash64(a["doc_id"], a["copy"]) != F.xxhash64(b["doc_id"], b["copy"]),
              F.when(F.xxhash64(a["doc_id"], a["copy"]) < F.xxhash64(b["doc_id"], b["copy"]), -1).otherwise(1))
        .otherwise(0)))
    start = F.struct(F.element_at("items", 1).alias("held"), F.expr(f"CAST(array() AS array<{_ITEM}>)").alias("settled"))
    rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))
    return groups.withColumn("items", ordered).select(
        "source", F.aggregate(rest, start.cast(_STATE), lambda s, i: _pivot(s, i, level).cast(_STATE)).alias("_s")
    ).select("source", "_s.held", "_s.settled")


def _as_item() -> Column:
    return F.struct("doc_id", "copy", "size", "p").cast(_ITEM)


def _rounded_class(items: DataFrame, number: int, scratch: Scratch) -> DataFrame:
    """The items of one class with ``p`` 0 or 1: a tree of folds per source, whose last residual is rounded alone."""
    left = scratch.table(items.select("source", _as_item().alias("item")), f"class-{number}")
    settled, level = [], 0
    while True:
        counts = left.groupBy("source").agg(F.count("*").alias("_c"))
        if (counts.agg(F.max("_c")).first()[0] or 0) <= TOP:
            break
        wide = counts.filter(F.col("_c") > TOP).select(F.col("source").alias("_source"), F.ceil(F.col("_c") / GROUP).alias("_groups"))
        dealt = left.join(wide, F.col("source").eqNullSafe(F.col("_source")), "left")
        place = F.pmod(F.xxhash64("item.doc_id", "item.copy", "item.size", F.lit(level), F.lit(SEED + 1)), F.col("_groups"))
        grouped = (
            dealt.filter("_groups IS NOT NULL").withColumn("_place", place)
            .groupBy("source", "_place").agg(F.collect_list("item").alias("items")))
        folded = scratch.table(_folded(grouped, level), f"class-{number}-level-{level}")
        settled.append(folded.select("source", F.explode("settled").alias("item")))
        small = dealt.filter("_groups IS NULL").select("source", "item")
        left = small.unionByName(folded.select("source", F.col("held").alias("item")))
        level += 1
    # At most TOP residuals of a source.
    folded = _folded(left.groupBy("source").agg(F.collect_list("item").alias("items")), -1)
    alone = F.when(_draw(F.col("held"), F.col("held"), -2) < F.col("held.p"), 1.0).otherwise(0.0)
    whole = F.concat("settled", F.array(_with_p(F.col("held"), alone).cast(_ITEM)))
    out = folded.select("source", F.explode(whole).alias("item"))
    for part in settled:
        out = out.unionByName(part)
    return scratch.table(out.select("source", "item.*"), f"class-{number}-rounded")


def round_dependently(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, doc_id, copy, size, extra) with ``extra`` 0 or 1 from (source, doc_id, copy, size, p).

    Sizes are above 0, and all documents of a source have one probability.
    """
    items = scratch.table(items.withColumn("class", F.floor(F.log2("size") / 3).cast("int")), "open")
    state = scratch.table(
        items.groupBy("source").agg(F.sum(F.col("p") * F.col("size")).alias("mass"), F.sum("size").alias("room")), "open-sources")
    # A class per power of eight.
    classes = sorted((r[0] for r in items.select("class").distinct().collect()), reverse=True)
    done = None
    for number in classes:
        shared = state.select(F.col("source").alias("_source"), F.least(F.greatest(
            F.col("mass") / F.col("room"), F.lit(0.0)), F.lit(1.0)).alias("p"))
        members = items.filter(F.col("class") == number).drop("p")
        members = members.join(shared, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        rounded = _rounded_class(members, number, scratch)
        spent = rounded.groupBy(F.col("source").alias("_source")).agg(
            F.sum(F.col("p") * F.col("size")).alias("_mass"), F.sum("size").alias("_room"))
        state = scratch.table(
            state.join(spent, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                "source", (F.col("mass") - F.coalesce("_mass", F.lit(0.0))).alias("mass"),
                (F.col("room") - F.coalesce("_room", F.lit(0))).alias("room")).filter("room > 0"), f"open-sources-{number}")
        done = rounded if done is None else done.unionByName(rounded)
    if done is None:
        return items.select("source", "doc_id", "copy", "size", F.lit(0).cast("long").alias("extra"))
    return done.select("source", "doc_id", "copy", "size", F.when(F.col("p") > 0.5, 1).otherwise(0).cast("long").alias("extra"))


def mix(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document (doc_id, source, size, source_size, target, copies, taken): how often the mix takes it, and its words."""
    prepare(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"))
    # Equal rows are counted before they travel.
    kinds = scratch.table(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_rows")), "sizes")
    by_source = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"))
    goals = scratch.table(targets(by_source, scratch), "targets").select(
        F.col("source").alias("_source"), "source_size", "target")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + WHOLE)
    joined = kinds.join(goals, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("copy"), "source_size", "target",
        whole.cast("long").alias("whole"), F.greatest(wanted - whole, F.lit(0.0)).alias("p"))
    rows = scratch.table(joined, "documents")
    open_rows = (F.col("p") > WHOLE) & (F.col("size") > 0)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long")
    out = ["doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    rounded = round_dependently(rows.filter(open_rows), scratch)
    of_source = goals.withColumn("whole", F.floor(wanted + WHOLE))
    rounded = rounded.join(of_source, F.col("source").eqNullSafe(F.col("_source")))
    return rows.filter(~open_rows).withColumn("extra", F.lit(0)).select(*out).unionByName(rounded.select(*out))
