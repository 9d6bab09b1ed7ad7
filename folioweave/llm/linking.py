"""Components of a similarity graph whose candidate pairs are those that share a bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.components import connected_components
from folioweave.llm.tables import scoped, scrambled, small_side, written

#: Orders in which a bucket's centre is chosen, one a round, before what is still apart is compared in full.
CENTRE_ROUNDS = 2

#: Ids with a near sketch that an id of an open bucket may have on average, by JURORS of the bucket's ids, for the bucket to be compared
#: in full where the ids' differences from a centre can be told. Other buckets are joined by these differences, as their pairs
#: would grow with the square of their ids. Either way is exact, so the estimate decides on the cost alone.
COMPARED_IN_FULL, JURORS = 32, 5

#: Values of a signature kept in a sketch, three bits each, and how many may differ in a pair that is looked at. Of two sets
#: at a similarity of 0.8, 17.5 % of the three-bit values differ, 3.7 of 21 on average, more than this many with a probability
#: of 0.0002; unlike sets that met in a bucket by a few common values differ in some 14.
SKETCHED, MOST_DIFFERENT = 21, 10

#: The same for two finer sketches of 30 values in all, four bits each: of sets at 0.8, 5.6 of 30 differ on average, more than
#: this many with a probability of 0.0001; of unlike sets that met in a bucket of three values a hundredth as many pass.
FINE_SKETCHED, MOST_FINE_DIFFERENT = 15, 14


def _pair(one: str, other: str):
    return F.least(one, other).alias("a"), F.greatest(one, other).alias("b")


def _may_be_similar(ratio: float):
    """An exact bound for pairs that share no rare element: they can only share what is not rare in either.

    With n elements of which o are rare, the intersection is at most min(n - o), the union is what is left of the sum.
    """
    common = F.least(F.col("size") - F.col("own"), F.col("c_size") - F.col("c_own"))
    return common * (1 + ratio) >= ratio * (F.col("size") + F.col("c_size")) - 1e-6


def _packed(values: list[Column], bits: int) -> Column:
    """The low ``bits`` of a hash of each value, side by side in a long."""
    out = F.lit(0).cast("long")
    for i, m in enumerate(values):
        out = out.bitwiseOR(F.shiftleft(F.pmod(F.xxhash64(m), F.lit(1 << bits)), bits * i))
    return out


def sketch(least: list[Column]) -> Column:
    """Three bits of each of SKETCHED MinHash values, side by side in a long."""
    return _packed(least[:SKETCHED], 3)


def fine_sketches(least: list[Column]) -> list[Column]:
    """``sketch`` and ``sketch2``: four bits of each of twice FINE_SKETCHED MinHash values."""
    n = FINE_SKETCHED
    return [_packed(least[:n], 4).alias("sketch"), _packed(least[n : 2 * n], 4).alias("sketch2")]


def _differing(one: str, other: str, values: int, bits: int) -> Column:
    differ = F.col(one).bitwiseXOR(F.col(other))
    folded = differ
    for i in range(1, bits):
        folded = folded.bitwiseOR(F.shiftrightunsigned(differ, i))
    return F.bit_count(folded.bitwiseAND(F.lit(sum(1 << bits * i for i in range(values)))))


def _sketches_agree(one: str, other: str, fine: bool = False) -> Column:
    """Whether the sketches in the columns called ``one`` and ``other`` (and, if ``fine``, those with a 2 behind) are near."""
    if not fine:
        return _differing(one, other, SKETCHED, 3) <= MOST_DIFFERENT
    return _differing(one, other, FINE_SKETCHED, 4) + _differing(f"{one}2", f"{other}2", FINE_SKETCHED, 4) <= MOST_FINE_DIFFERENT


def rare_elements(sets: DataFrame) -> DataFrame:
    """(ids, n): the lists of ids that hold the same rare elements of ``sets`` (id, elements), and of how many.

    An element is rare if at most three even and three odd ids (after scrambling) hold it: so many can be told from their
    number, least, greatest and exclusive or, which combine before the shuffle, however frequent other elements are.
    """
    each = sets.select("id", F.explode(F.array_distinct("elements")).alias("element"))
    even = F.pmod(scrambled(F.col("id")), F.lit(2)) == 0
    halves = [(f(F.when(side, F.col("id"))).alias(f"{name}_{half}"))
              for half, side in (("even", even), ("odd", ~even)) for name, f in (("n", F.count), ("low", F.min), ("high", F.max), ("xor", F.bit_xor))]
    sums = each.groupBy("element").agg(*halves).where("n_even <= 3 and n_odd <= 3")

    def ids(half: str) -> Column:
        n, low, high, xor = (F.col(f"{c}_{half}") for c in ("n", "low", "high", "xor"))
        third = xor.bitwiseXOR(low).bitwiseXOR(high)
        return F.when(n == 0, F.array().cast("array<long>")).when(n == 1, F.array(low)).when(n == 2, F.array(low, high)).otherwise(F.array(low, third, high))

    return sums.select(F.array_sort(F.array_distinct(F.concat(ids("even"), ids("odd")))).alias("ids")).groupBy("ids").agg(F.count(F.lit(1)).alias("n"))


@scoped("several")
def _several(members: DataFrame) -> DataFrame:
    """The buckets of several ids; a job of its own, so that its shuffle is gone when the members are joined."""
    return members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")


@scoped("shared-buckets")
def shared_buckets(members: DataFrame, repeated: bool = True) -> DataFrame:
    """The rows of (bucket, id, ...), each once, whose bucket holds several ids."""
    members = members.where("bucket is not null and id is not null").distinct() if repeated else members
    shared = written(members.join(small_side(_several(members), 16), "bucket"), "shared")
    # Of the many buckets of two, those whose sketches differ are done.
    sketches = [c for c in ("sketch", "sketch2") if c in members.columns]
    found = [f(c, "id").alias(f"{name}_{c}") for c in sketches for f, name in ((F.min_by, "s"), (F.max_by, "t"))]
    ends = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *found)
    likely = written(ends.where((F.col("n") > 2) | _sketches_agree("s_sketch", "t_sketch", len(sketches) > 1)).select("bucket"), "likely")
    return shared.join(small_side(likely, 16), "bucket")


def _rare_pairs(rare: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of different parts that share a rare element."""
    later = lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = rare.where(F.size("ids") > 1).select(F.explode(F.flatten(F.transform("ids", later))).alias("p")).select("p.a", "p.b").distinct()
    one, other = (parts.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}")) for c in "ab")
    return pairs.join(one, "a").join(other, "b").where("part_a != part_b").select("a", "b")


def _with_far(open_: DataFrame) -> DataFrame:
    """``open_`` with how an id's fine sketches agree with those of JURORS ids of its bucket, if that has more than COMPARED_IN_FULL ids.

    ``far``: in how many values they differ in all, ``near``: with how many of the JURORS the sketches are near; else both are 0.
    """
    order = [scrambled(F.col("id"), 100 + j) for j in range(JURORS)]
    drawn = [F.min_by(c, order[j]).alias(f"j{j}_{c}") for j in range(JURORS) for c in ("sketch", "sketch2")]
    jurors = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *drawn).where(F.col("n") > COMPARED_IN_FULL).drop("n")
    jurors = written(jurors, "jurors")
    differ = [_differing(c, f"j{j}_{c}", FINE_SKETCHED, 4) for j in range(JURORS) for c in ("sketch", "sketch2")]
    agree = [(one + two <= MOST_FINE_DIFFERENT).cast("long") for one, two in zip(differ[::2], differ[1::2], strict=True)]
    told = {name: F.coalesce(reduce(Column.__add__, each), F.lit(0)).cast("long") for name, each in (("far", differ), ("near", agree))}
    return open_.join(small_side(jurors, 16 * JURORS + 8), "bucket", "left").withColumns(told).drop(*(c for c in jurors.columns if c != "bucket"))


@scoped("differing-pairs")
def _differing_pairs(members: DataFrame, ratio: float) -> DataFrame:
    """Pairs (a, b) of different parts that may be similar, among the ``members`` of each centre ``c``.

    A member has (c, c_part, id, part, size, new, missing, and its sketches): the elements its set has beyond the centre's, and
    the number of those it lacks. Sets of sizes x and y with a Jaccard of ``ratio`` differ in at most (1 - ratio) / (1 + ratio) of
    x + y elements. Two members differ in all new elements but the common ones, and in at least as many of the centre's as the
    numbers of missing ones differ; so they must share a least number of new elements, known from the sizes alone.

    Where that is none, the one that is not in the centre's part lies only just beyond the centre's reach and the other lacks
    more than it has new. Else the common elements cannot all be among the last of either, in order of how many members have
    them: the pair is met at a common element that comes early enough in both. What is common to many comes last, so members
    that share frequent elements only do not meet. No pair that may be similar is left out.
    """
    most = (1 - ratio) / (1 + ratio)
    members = members.withColumn("n", F.size("new"))
    plain = members.drop("new").withColumn("outside", F.col("part") != F.col("c_part"))
    other = lambda df, on: df.select(*on, *(F.col(c).alias(f"o_{c}") for c in df.columns if c not in (*on, "c_part")))
    share = (F.col("n") + F.col("o_n") + F.abs(F.col("missing") - F.col("o_missing")) - most * (F.col("size") + F.col("o_size"))) / 2
    once = F.when(F.col("o_outside"), F.col("part") < F.col("o_part")).otherwise(F.col("part") != F.col("o_part"))
    near = _sketches_agree("sketch", "o_sketch", True)

    # Pairs that may share no new element. ``beyond`` of the one is at most ``spare`` of the other, by the same sums.
    beyond = F.col("n") + F.col("missing") - most * (2 * F.col("size") - F.col("n") + F.col("missing"))
    spare = (1 - most) * (F.col("missing") - F.col("n"))
    reach = plain.groupBy("c").agg(F.max(spare).alias("most_spare"))
    few = written(plain.where("outside").join(reach, "c").where(beyond <= F.col("most_spare") + 1e-6).drop("most_spare"), "just-beyond")
    least = few.groupBy("c").agg(F.min(beyond).alias("least_beyond"))
    lack = written(plain.join(least, "c").where(spare >= F.col("least_beyond") - 1e-6).drop("least_beyond"), "lacking")
    # Either may be the one outside, so both orders are looked at.
    apart = few.join(other(lack, ["c"]), "c").where((F.col("part") != F.col("o_part")) & (share <= 1e-6) & near)

    # Pairs that share a new element: those that cannot be shared, of one member or of the centre's part only, come first.
    each = members.select("c", "id", (F.col("part") != F.col("c_part")).alias("outside"), F.explode("new").alias("element"))
    held = each.groupBy("c", "element").agg(F.count(F.lit(1)).alias("holders"), F.bool_or("outside").alias("met")).where("holders > 1 and met")
    held, each = written(held.drop("met"), "held"), each.drop("outside")
    ordered = each.join(held, ["c", "element"]).groupBy("c", "id").agg(F.array_sort(F.collect_list(F.struct("holders", "element"))).alias("common"))
    placed = plain.join(ordered, ["c", "id"]).select(*plain.columns, (F.col("n") - F.size("common")).alias("alone"), F.posexplode("common").alias("at", "of"))
    placed = placed.select(*plain.columns, F.col("of.element").alias("element"), (F.col("alone") + F.col("at") + 1).alias("place"))
    # The other member has at least the shared elements as new ones, so one alone knows how many they are at least.
    own = (F.col("n") - most * (2 * F.col("size") - F.col("n"))) / (1 + most)
    placed = written(placed.where(F.col("place") <= F.col("n") - F.greatest(F.ceil(own - 1e-6), F.lit(1)) + 1), "placed")
    early = lambda side: F.col(f"{side}place") <= F.col(f"{side}n") - F.ceil(share - 1e-6) + 1
    met = placed.where("outside").join(other(placed, ["c", "element"]), ["c", "element"]).where(once & (share > 1e-6) & early("") & early("o_") & near)
    return apart.select(*_pair("id", "o_id")).union(met.select(*_pair("id", "o_id"))).distinct()


@scoped("linked")
def linked_components(
    buckets: DataFrame, sets: DataFrame | None, ratio: float, verify: Callable[[DataFrame], DataFrame],
    differences: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(components, edges) over ``buckets`` (bucket, id, size, sketch) under ``verify``, which keeps pairs (a, b) with a Jaccard of ``ratio``.

    Components (id, component) are those of the graph of all similar pairs that share a bucket; ``sets`` (id, elements) are
    the ids' whole sets. No pair inside a known component is needed: first every id is compared with its bucket's centre;
    then, where ids are still in several components, with another one, the set with the least share of rare elements,
    which is the likeliest to be similar to the rest; what is then still apart is compared across the components of its
    bucket, but for pairs that share no rare element and that a bound rules out (without ``sets``, the sizes alone). Pairs that
    met in a bucket by a few common values are not verified: more than MOST_DIFFERENT values of their sketches differ, or
    MOST_FINE_DIFFERENT where ``buckets`` has the two fine ones.

    With ``differences``, which tells for pairs (c, id) how the set of id differs from that of c (``size``, ``new`` elements, the number
    ``missing``), and fine sketches, the second centre is one near the middle of its bucket, and of buckets with more than
    COMPARED_IN_FULL near ids for an id only those pairs are compared that may be similar by their differences from it. ``edges`` are the pairs found to be similar that way, a spanning
    part of all similar pairs.
    """
    spark = buckets.sparkSession
    fine = "sketch2" in buckets.columns
    told = fine and differences is not None
    columns = ["bucket", "id", "size", "sketch", *["sketch2"] * fine]
    buckets = buckets.select(*columns)  # of tables that ``shared_buckets`` has written
    columns += ["own"]
    tried = edges = None
    components = spark.range(0).select("id", F.col("id").alias("component"))
    for turn in range(CENTRE_ROUNDS + 1):
        if turn == 0:
            open_ = buckets.withColumn("own", F.lit(0)).withColumn("part", F.col("id"))
        else:
            named = buckets.join(components, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
            apart = named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket")
            open_ = named.join(written(apart, "apart"), "bucket")
            if sets is None:
                open_ = written(open_.withColumn("own", F.lit(0)), "open")
            else:
                open_ = written(open_, "open")
                ids = written(open_.select("id", "part").distinct(), "open-ids")
                rare = written(rare_elements(sets.join(small_side(ids, 24), "id", "left_semi")), "rare-elements")
                own = written(rare.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("own")), "own-elements")
                open_ = written(open_.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))), "open")
            if open_.isEmpty():
                break
        likely = _may_be_similar(ratio) & _sketches_agree("sketch", "c_sketch", fine)
        if turn < CENTRE_ROUNDS:
            chance = F.shiftrightunsigned(scrambled(F.col("id"), turn), 24)
            order = F.shiftleft((F.col("own") * 1_000_000 / F.col("size")).cast("long"), 40) + chance
            drawn, near = open_, F.lit(0)
            if told and turn == CENTRE_ROUNDS - 1:
                drawn, near, order = _with_far(open_), F.sum("near"), F.shiftleft("far", 40) + chance
            centres = drawn.groupBy("bucket").agg(*(F.min_by(c, order).alias(f"c_{c}") for c in [*columns[1:], "part"]), near.alias("near"))
            centres = written(centres, "centres")  # a side of its own, so that Spark can split a hot bucket of the join
            met = open_.join(centres, "bucket").where((F.col("part") != F.col("c_part")) & likely)
        else:
            full = open_
            if told:
                large = written(centres.where(F.col("near") > COMPARED_IN_FULL * JURORS).select("bucket", F.col("c_id").alias("c")), "large")
                full = open_.join(small_side(large.select("bucket"), 16), "bucket", "left_anti")
            other = full.select("bucket", *(F.col(c).alias(f"c_{c}") for c in [*columns[1:], "part"]))
            met = full.join(other, "bucket").where((F.col("part") < F.col("c_part")) & likely)
        pairs = met.select(*_pair("id", "c_id"))
        if turn == CENTRE_ROUNDS and told:
            # A centre serves several buckets; its members are told from it once.
            members = open_.join(small_side(large, 24), "bucket").select("c", "id", "part", "sketch", "sketch2").distinct()
            named = components.select(F.col("id").alias("c"), F.col("component").alias("c_part"))
            members = written(members.join(named, "c", "left").withColumn("c_part", F.coalesce("c_part", "c")), "members")
            members = written(members.join(differences(members.select("c", "id")), ["c", "id"]), "members-told")
            pairs = pairs.union(_differing_pairs(members, ratio))
        if turn == CENTRE_ROUNDS and sets is not None:
            pairs = pairs.union(_rare_pairs(rare, ids))
        pairs = pairs.distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        if pairs.isEmpty():
            continue
        found = written(verify(pairs).select("a", "b"), "links")
        edges = found if edges is None else edges.union(found)
        if not found.isEmpty():
            components = connected_components(edges)
    return components, edges if edges is not None else spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
