"""Mixing sources to target weights, with DataFrame functions only.

Hash-threshold histograms: the words of a source are summed by bucket of a document hash, the
bucket in which a budget ends is refined by further hash bits until one document is left, and
documents are kept by comparing their hash with that threshold. Nothing is sorted but the
histograms, whose size depends on sources and bits, not on rows.

Where the document at the threshold doesn't fit into the budget, the rest is offered to the
documents that aren't larger than it, again by hash (ROUNDS times). Last, the one document whose size
is closest to what is then left is taken too, if that comes closer to the target. So the error is at most
half the size of a document, and mostly far below that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import WORD, checkpointed, lookup, packed

#: Weights go to the sources by code point of the name, null last, again and again.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MOST_REPEATS = 3
#: Bits of the hash that a histogram adds to those before.
BITS = 8
HASH_BITS = 60
ROUNDS = 4
SEED = 20_240_901


def size_of(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 64 - HASH_BITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """Columns source, source_size -> also weight and target.

    The budget is `share` of all sizes, dealt by weight; no target exceeds `most` times its
    source's size, and the excess is dealt again by weight. That has a closed form: with sources
    by their cap per weight, those below the water level get their cap, all others level x weight.
    """
    by_name, by_cap, all_rows = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("__cap_per", "__rank"), W.partitionBy()
    rank = F.row_number().over(by_name)
    ranked = sizes.withColumn("__rank", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1)
    )
    ranked = ranked.withColumn("__cap", F.col("source_size") * float(most)).withColumn("__cap_per", F.col("__cap") / F.col("weight"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, W.unboundedFollowing)
    leveled = ranked.withColumn(
        "__level",
        (F.sum("source_size").over(all_rows) * float(share) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    level = F.min(F.when(F.col("__level") <= F.col("__cap_per"), F.struct("__cap_per", "__rank", "__level"))).over(all_rows)["__level"]
    return leveled.withColumn("target", F.least("__cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select(
        "source", "source_size", "weight", "target"
    )


def _threshold(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """For each source of `state` (source, __need): __t, the hash below which rows fit into
    __need, and __left, what they leave of it. `rows`: source, __size, __u of candidates."""
    rows = lookup(rows, state, ["source"], F.col("__u"), n).filter((F.col("__need") > 0) & (F.col("__size") > 0))
    found, bits = None, 0
    while True:
        now = min(bits + BITS, HASH_BITS)
        if found is None:
            part = rows.withColumn("__from", F.lit(0.0))
        else:
            part = lookup(rows, found.select("source", "__prefix", "__from"), ["source"], F.col("__u"), n).filter(
                F.shiftright("__u", HASH_BITS - bits) == F.col("__prefix")
            )
        histogram = part.groupBy("source", F.shiftright("__u", HASH_BITS - now).alias("__bucket")).agg(
            F.sum("__size").alias("__sum"), F.first("__need").alias("__need"), F.first("__from").alias("__from"), F.countDistinct("__u").alias("__n")
        )
        upto = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)
        edge = (
            histogram.withColumn("__upto", F.col("__from") + F.sum("__sum").over(upto))
            .filter(F.col("__upto") > F.col("__need"))
            .groupBy("source")
            .agg(F.min(F.struct("__bucket", "__upto", "__sum", "__n")).alias("e"))
            .select("source", F.col("e.__bucket").alias("__prefix"), (F.col("e.__upto") - F.col("e.__sum")).alias("__from"), F.col("e.__n").alias("__n"))
        )
        # A source whose bucket already held one document stays as it is: the later bits only lengthen its prefix.
        found, bits = checkpointed(edge), now
        if bits == HASH_BITS or not found.filter("__n > 1").limit(1).count():
            break
    below = F.shiftleft(F.col("__prefix"), HASH_BITS - bits)
    total = rows.groupBy("source").agg(F.sum("__size").alias("__total"))
    cut = found.withColumn("__t", below).select("source", "__t", "__from")
    out = state.join(total.withColumnRenamed("source", "__s1"), F.col("source").eqNullSafe(F.col("__s1")), "left").drop("__s1")
    out = out.join(cut.withColumnRenamed("source", "__s2"), F.col("source").eqNullSafe(F.col("__s2")), "left").drop("__s2")
    return out.select(
        "source",
        F.coalesce("__t", F.when(F.col("__need") > 0, F.lit(1 << HASH_BITS)), F.lit(0)).cast("long").alias("__t"),
        (F.col("__need") - F.when(F.col("__t").isNotNull(), F.col("__from")).otherwise(F.coalesce("__total", F.lit(0)))).alias("__left"),
    )


def plan(slim: DataFrame, rounds: int = ROUNDS, **kw) -> tuple[DataFrame, int]:
    """A row per source: source_size, target, __whole (times that all of it is taken),
    __cuts (largest size and threshold of each round) and __pick (hash of the last document). `slim`: source, __size, __u. Also their number."""
    sizes = checkpointed(targets(slim.groupBy("source").agg(F.sum("__size").alias("source_size")), **kw))
    n = sizes.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = sizes.withColumn("__whole", whole).withColumn("__need", F.col("target") - F.col("__whole") * F.col("source_size"))
    state = state.withColumn("__cuts", F.expr("cast(array() as array<struct<most:double,t:long>>)"))
    for _ in range(rounds):
        rest = lookup(slim, state.select("source", "__cuts", F.col("__need").alias("__room")), ["source"], F.col("__u"), n).filter(~_cut("__cuts"))
        rest = rest.filter(F.col("__size") <= F.col("__room")) if state.columns.count("__seen") else rest
        cut = _threshold(rest.select("source", "__size", "__u"), state.select("source", "__need"), n).withColumnRenamed("source", "__s")
        state = state.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left")
        limit = F.col("__need") if "__seen" in state.columns else F.lit(float("inf"))
        state = checkpointed(
            state.select(
                "source", "source_size", "target", "__whole", F.greatest("__left", F.lit(0.0)).alias("__need"),
                F.concat("__cuts", F.array(F.struct(limit.alias("most"), F.col("__t").alias("t")))).alias("__cuts"), F.lit(True).alias("__seen"),
            )
        )
    rest = lookup(slim, state.select("source", "__cuts", F.col("__need").alias("__room")), ["source"], F.col("__u"), n).filter(~_cut("__cuts"))
    off = F.abs(F.col("__size") - F.col("__room"))
    pick = rest.filter((F.col("__size") > 0) & (off < F.col("__room"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "__u"))["__u"].alias("__pick"))
    state = state.join(pick.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    return checkpointed(state.select("source", "source_size", "target", "__whole", "__cuts", "__pick")), n


def _cut(cuts: str) -> Column:
    return F.exists(cuts, lambda c: (F.col("__size") <= c["most"]) & (F.col("__u") < c["t"]))


def _times() -> Column:
    """How often a document is taken, next to its source's row of the plan."""
    return F.col("__whole") + (_cut("__cuts") | F.coalesce(F.col("__u") == F.col("__pick"), F.lit(False))).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """A row per document: its id, source, size, source_size, target, taken and times.

    `taken` is `size` times the number of times that the mix takes the document (0 to 3).
    Null texts and empty texts have size 0; a null source is a source. Rows with the same id and text
    have the same hash, so they are taken or left together; reruns agree. Empty tables give none.
    Extra columns aren't read.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("__size"), _hash(F.col(id_col), F.col(text_col)).alias("__u")
    )
    slim = checkpointed(slim)
    table, n = plan(slim, **kw)
    taken = lookup(slim, table, ["source"], F.col("__u"), n)
    times = _times()
    return taken.select(
        "doc_id", "source", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * times).alias("taken"), times.alias("times")
    )


def apply_mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with the columns of `docs`. Null and empty texts have size 0 and go with the first
    pass over their source; a null source is a source; null ids are ids like others; repeated rows are taken or left together; an
    empty table gives an empty result. Extra columns stay."""
    keyed = packed(docs, source=docs[source_col], __size=size_of(docs[text_col]), __u=_hash(docs[id_col], docs[text_col]))
    table, n = plan(checkpointed(keyed.select("source", "__size", "__u")), **kw)
    taken = lookup(keyed, table.select("source", "__whole", "__cuts", "__pick"), ["source"], F.col("__u"), n)
    return taken.withColumn("time", F.explode(F.array_repeat(F.lit(0), _times()))).select("row.*")
