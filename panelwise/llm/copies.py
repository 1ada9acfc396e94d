"""Links within large groups of sets that are alike, without listing the pairs of a group.

A group's members are described by what sets them apart from the group's reference, the elements that more than half of them
hold. With D(X) the symmetric difference of X and the reference, |X xor Y| = |D(X)| + |D(Y)| - 2 |D(X) and D(Y)|, so

* slack(X) = (den - num) |X| - (num + den) |D(X)|, and X and Y are linked if and only if
  slack(X) + slack(Y) + 2 (num + den) |D(X) and D(Y)| >= 0;
* members whose slack and the group's largest make up 0 are linked with that member, which connects all pairs that are alike
  without a common difference;
* any other pair has a side left over and shares at least s differences, known from the slacks, so both hold one of them among
  their rarest |D| - s + 1. These lists hold half of the group at most, since a difference is never in the majority. In a
  list one common difference is sure, so most members are again linked with the one of largest slack; a few left over
  become candidate pairs with the list's members; lists with many left over are the groups of the next round. There, members
  are described by the differences of this round that another member has too and by the number of all others, as
  X xor Y = D(X) xor D(Y); so a set is looked through once, and what a member brings along shrinks from round to round.

So work grows with the members and their differences, not with pairs, and no link that connects components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from panelwise.llm.common import stored, trimmed
from panelwise.llm.shingles import shingle_sets

# Lists up to this size give their pairs; larger ones are groups. As many members of a list may be left over.
FEW = 16
# A group's reference row counts the elements that one member in RARE holds; rarer ones come first in any order.
RARE = 16
SALTS = 16
# Bits by which a group tells elements that one member alone holds from most others, before any is looked up.
BITS = 1 << 15
# Times that members without a possible partner in a list are left out of it.
TRIMS = 3
# Rounds in which labels travel between lists and their members before lists of one label are taken as one group.
HOPS = 2


def hashed_sets(texts: DataFrame, k: int) -> DataFrame:
    """(cls, items array<bigint>) of (cls, text): the sorted hashes of k-word shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [np.sort(s.view(np.int64)) for s in shingle_sets(pc.cast(batch.column("text"), pa.binary()).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.list_(pa.int64()))], ["cls", "items"])

    return texts.select("cls", "text").mapInArrow(trimmed(run), "cls bigint, items array<bigint>")


def few_pairs(lists: DataFrame, fits: Column | None = None) -> DataFrame:
    """(a, b), a > b: all pairs of the lists (column m: array of structs with cls); ``fits`` builds a test of x and y.

    Lists with equal pairs, as copies have many, are one before they are unfolded.
    """
    def of(x: Column) -> Column:
        later = F.filter("m", lambda y: (y["cls"] < x["cls"]) & (F.lit(True) if fits is None else fits(x, y)))
        return F.transform(later, lambda y: F.struct(x["cls"].alias("a"), y["cls"].alias("b")))

    pairs = lists.select(F.array_sort(F.flatten(F.transform("m", of))).alias("p")).where(F.size("p") > 0).distinct()
    return pairs.select(F.inline("p")).distinct()


def merged(lists: DataFrame, hops: int = HOPS) -> DataFrame:
    """(g, cls) of (l, cls): lists that share members become one group, so that a class stands in few of them.

    A list takes the smallest label among its members, a member the smallest among its lists. Any number of hops is right, as
    a list's members stay together.
    """
    label = lists.groupBy("l").agg(F.min(F.xxhash64("cls")).alias("g"))
    for _ in range(hops):
        member = lists.join(label, "l").groupBy("cls").agg(F.min("g").alias("g"))
        label = lists.join(member, "cls").groupBy("l").agg(F.min("g").alias("g"))
    return lists.join(label, "l").select("g", "cls").distinct()


def _described(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, cls, n, items, more): size of each member, the elements that describe it and how many more it alone has.

    At first these are its elements (sets: cls, items), later its differences in the group ``top`` from which its own one came.
    """
    if "top" in sets.columns:
        return members.join(sets, ["top", "cls"]).select("g", "cls", "n", "items", "more")
    return members.join(sets, "cls").select("g", "cls", F.size("items").cast("long").alias("n"), "items", F.lit(0).cast("long").alias("more"))


def _shared(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (g, m, e, c, bits): size of each group, the elements that not too few of its members hold, sorted, with their
    counts, and a bitmap of the rarer elements that two members hold at least; and (g, e) of these."""
    size = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    rows = _described(members, sets).select("g", F.explode("items").alias("e"))
    counts = stored(rows.groupBy("g", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1").join(size, "g"))
    known = F.col("c") * RARE >= F.col("m")
    kept = counts.where(known).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("e", "c"))).alias("r"))
    rarer = counts.where(~known).select("g", "e")
    bits = rarer.groupBy("g").agg(F.bitmap_construct_agg(F.pmod("e", F.lit(BITS))).alias("bits"))
    none = F.array().cast("array<bigint>")
    refs = size.join(kept, "g", "left").join(bits, "g", "left").select(
        "g", "m", F.coalesce("r.e", none).alias("e"), F.coalesce("r.c", none).alias("c"), "bits")
    return refs, rarer


def maybe_shared(items: np.ndarray, bits: bytes | None) -> np.ndarray:
    """The items whose bit is set; all that are set in truth are among them."""
    if bits is None:
        return items[:0]
    at = items & (BITS - 1)
    return items[(np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7)) & 1 == 1]


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, cls, n, d, diff): differences of each member against its group's reference: how many, and those that another member
    has too, rarest first. All others come before them in the order of rarity and are in no other set.

    Only elements that the reference row leaves out and whose bit another member's element may have set are looked up one by one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                total, rare, diff = [], [], []
                for row in range(batch.num_rows):
                    items, e, c = (batch.column(x)[row].values.to_numpy() for x in ("items", "e", "c"))
                    m, bits, more = (batch.column(x)[row].as_py() for x in ("m", "bits", "more"))
                    common = 2 * c > m
                    place = np.minimum(np.searchsorted(e, items), max(len(e) - 1, 0))
                    known = e[place] == items if len(e) else np.zeros(len(items), bool)
                    extra = place[known][~common[place[known]]]
                    lacking = common.copy()
                    lacking[place[known]] = False
                    total.append(len(items) - known.sum() + len(extra) + lacking.sum() + more)
                    rare.append(maybe_shared(items[~known], bits))
                    # What this member alone lacks is in no other member's differences.
                    lacking &= m - c > 1
                    d = np.concatenate((e[extra], e[lacking]))
                    diff.append(d[np.lexsort((d, np.concatenate((c[extra], m - c[lacking]))))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("g"), batch.column("cls"), batch.column("n"), pa.array(total, pa.int64()),
                     pa.array(rare, pa.list_(pa.int64())), pa.array(diff, pa.list_(pa.int64()))], ["g", "cls", "n", "d", "rare", "diff"])

    refs, rarer = _shared(members, sets)
    # A large group lies in several tasks, each with its own copy of the reference.
    salted = _described(members, sets).withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)))
    spread = refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    out = stored(salted.join(spread, ["g", "salt"]).select(
        "g", "cls", "n", "items", "more", "m", "e", "c", "bits").mapInArrow(
        trimmed(run), "g bigint, cls bigint, n bigint, d bigint, rare array<bigint>, diff array<bigint>"))
    if rarer.isEmpty():
        return out.drop("rare")
    held = out.select("g", "cls", F.explode("rare").alias("e")).join(rarer, ["g", "e"]).groupBy("g", "cls").agg(
        F.array_sort(F.collect_list("e")).alias("held"))
    return out.join(held, ["g", "cls"], "left").select(
        "g", "cls", "n", "d", F.concat(F.coalesce("held", F.array().cast("array<bigint>")), "diff").alias("diff"))


def _ceil_half(x: Column, unit: int) -> Column:
    """The least s with 2 s unit >= x, for x of any sign."""
    return F.ceil(x / F.lit(2 * unit))


def _heads(rows: DataFrame) -> DataFrame:
    """(g, z): the member of largest slack of each list in which a member left over meets another one."""
    lists = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("slack", "cls")).alias("z"),
                                  F.count(F.when(F.col("over"), F.lit(1))).alias("u"))
    return lists.where("m > 1 AND u > 0").drop("m", "u")


def _trimmed(rows: DataFrame, unit: int) -> DataFrame:
    """The rows of lists whose member has enough differences from its place on to be linked with the list's largest slack.

    A pair's first common difference stands in a list that keeps both, as no partner there needs fewer.
    """
    met = rows.join(_heads(rows), "g")
    return met.where(F.col("pos") + _ceil_half(-(F.col("slack") + F.col("z.slack")), unit) <= F.col("d")).drop("z")


def links(members: DataFrame, sets: DataFrame, num: int, den: int, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(links, candidates), both (a, b), of groups (g, cls) of sets (cls, items) that are linked from J >= num / den on.

    Links are sure. Sure links and the candidates that prove to be links connect whatever all links within a group connect.
    """
    spark, unit = members.sparkSession, num + den
    sure, asked = [], []
    members = stored(members.distinct())
    while not members.isEmpty():
        d = stored(_differences(members, sets).withColumn("slack", (den - num) * F.col("n") - unit * F.col("d")))
        best = d.groupBy("g").agg(F.max(F.struct("slack", "cls")).alias("z"))
        met = d.join(best, "g").withColumn("over", F.col("slack") + F.col("z.slack") < 0)
        sure.append(met.where(~F.col("over")).select("cls", "z.cls"))
        # The largest slack of members left over; groups without any are done.
        left = met.where("over").groupBy("g").agg(F.max("slack").alias("left"))
        least = _ceil_half(-(F.col("slack") + F.when(F.col("over"), F.col("z.slack")).otherwise(F.col("left"))), unit)
        # Differences of one member alone hold the first places and are listed by no other.
        alone = F.col("d") - F.size("diff")
        listed = F.greatest(F.col("d") - least + 1 - alone, F.lit(0)).cast("int")
        rows = met.join(left, "g").select(
            "g", "cls", "slack", "over", "d", alone.alias("alone"), F.posexplode(F.slice("diff", F.lit(1), listed)).alias("pos", "e"))
        rows = rows.withColumn("pos", F.col("pos") + F.col("alone")).drop("alone")
        rows = stored(rows.withColumn("top", F.col("g")).withColumn("g", F.xxhash64("g", "e")).drop("e"))
        for _ in range(TRIMS):
            rows = stored(_trimmed(rows, unit))
        # One difference in common is known here.
        rows = stored(rows.join(_heads(rows), "g").withColumn("rest", F.col("slack") + F.col("z.slack") + 2 * unit < 0))
        sure.append(rows.where(~F.col("rest") & F.col("over")).select("cls", "z.cls"))
        rest = rows.where("rest").groupBy("g").agg(F.count(F.lit(1)).alias("k"))
        x = rows.where("rest").join(rest.where(F.col("k") <= few), "g").select(
            "g", F.col("cls").alias("cls2"), F.col("slack").alias("slack2"), F.col("pos").alias("pos2"), F.col("d").alias("d2"))
        need = _ceil_half(-(F.col("slack") + F.col("slack2")), unit)
        asked.append(x.join(rows, "g").where((F.col("cls") != F.col("cls2")) & (F.col("pos") + need <= F.col("d"))
                                             & (F.col("pos2") + need <= F.col("d2"))).select("cls", "cls2"))
        members = stored(rows.join(rest.where(F.col("k") > few), "g").select("g", "top", "cls").distinct())
        sets = d.select(F.col("g").alias("top"), "cls", "n", F.col("diff").alias("items"), (F.col("d") - F.size("diff")).alias("more"))

    def united(parts: list[DataFrame]) -> DataFrame:
        out = spark.createDataFrame([], "a bigint, b bigint")
        for p in parts:
            out = out.union(p)
        return stored(out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    return united(sure), united(asked)
