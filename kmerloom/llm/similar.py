"""Problem 5: all pairs of sets above a Jaccard similarity, by an extended-prefix join.

Members are put in one order, the rare ones first. Two sets that overlap enough
share, for every l, at least l members among the first (size - least overlap + l)
of each, and so their first l common members. How many members a key combines is
chosen for each first member by what it costs: a rare one stands alone, a more
frequent one is combined with a second or third as long as the keys that this adds
are fewer than the candidates it saves. Both sets of a pair make the same choice,
as it rests on the member alone.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.session import numbered, stored

#: A first member in at most so many sets is never combined.
COMMON = 100
#: Cost of writing a key, in candidates.
KEY_COST = 4
#: Sets with one key, and copies of one set, that a task joins with all others.
PART = 20_000


def _ceil_part(n: Column, part: Fraction) -> Column:
    return F.floor((n * part.numerator + (part.denominator - 1)) / part.denominator).cast("int")


def _signature(high: bool) -> Column:
    """64 bits, a member setting one; half of the members are in each of the two signatures."""
    side = 1 if high else 0
    return F.expr(f"aggregate(filter(members, x -> (x >> 6 & 1) = {side}), 0L, (s, x) -> s | shiftleft(1L, cast(x & 63 as int)))")


def _level(levels: int, n_sets: int) -> Column:
    """Members that a key combines, from the sets `f` with its first member and the longest prefix `r` of these."""
    f, r = F.col("f").cast("double"), F.col("r").cast("double")
    cost = [KEY_COST + f, r * (KEY_COST + f * f / n_sets), r * r / 2 * (KEY_COST + f * f / n_sets * f / n_sets)]
    level = F.lit(1)
    for n in range(2, levels + 1):
        level = F.when(cost[n - 1] < F.least(*cost[: n - 1]) if n > 2 else cost[1] < cost[0], n).otherwise(level)
    return F.when(f <= COMMON, 1).otherwise(level)


def _postings(sets: DataFrame, levels: int) -> DataFrame:
    """(key, level, place of the last combined member, parts, id, n, s1, s2) of the extended prefixes."""
    # reach is n - least + 1, the prefix of one member; it is at most n - levels + 1
    firsts = sets.select("id", "n", "s1", "s2", "reach", "members", F.explode(F.expr("transform(sequence(0, reach - 1), i -> struct(i, members[i] as m, parts[i] as parts, level[i] as level))")).alias("p"))
    level = f"least({levels}, p.level)"
    one = "array(struct(xxhash64(p.m) as key, p.i as place))"
    two = "transform(sequence(p.i + 1, reach), j -> struct(xxhash64(p.m, members[j]) as key, j as place))"
    three = "flatten(transform(sequence(p.i + 1, reach), j -> transform(sequence(j + 1, reach + 1), k -> struct(xxhash64(p.m, members[j], members[k]) as key, k as place))))"
    keys = firsts.select("id", "n", "s1", "s2", F.expr(level).alias("level"), "p.parts", F.explode(F.expr(f"case {level} when 1 then {one} when 2 then {two} else {three} end")).alias("k"))
    return keys.select("k.key", "level", "k.place", "parts", "id", "n", "s1", "s2")


def _candidates(a: DataFrame, b: DataFrame, p: int, q: int) -> DataFrame:
    """(id_a, id_b) of different sets with a common key that sizes, places and signatures don't rule out; keys in many sets are dealt to several tasks."""
    left = a.withColumn("part", F.pmod(F.hash("id"), "parts"))
    right = b.select("key", "level", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("place", "id", "n", "s1", "s2")])
    both = F.col("n") + F.col("n_b")
    least_ahead = F.col("level") + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) - 1
    differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("s2_b")))
    return (
        left.join(right, ["key", "level", "part"])
        .filter((F.least("n", "n_b") * q >= F.greatest("n", "n_b") * p) & (least_ahead * (p + q) >= both * p) & ((both - differ) * (p + q) >= both * (2 * p)))
        .select(F.least("id", "id_b").alias("id_a"), F.greatest("id", "id_b").alias("id_b"))
        .filter("id_a < id_b")
        .distinct()
    )


def similar_sets(df: DataFrame, key: str, members: str, threshold: float, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies): pairs(id_a, id_b, common, n_a, n_b) of different sets and copies(id, key, n_copies) of equal sets.

    An id is the least key among equal sets; `copies` has a row for each member of
    the classes of two or more. The rows' keys are distinct bigints. Null members are
    none, repeated members count once, sets of fewer than min_size members are left
    out; an empty table gives no rows. common / (n_a + n_b - common) >= threshold,
    id_a < id_b. Members are compared by dense numbers, sets by a 128-bit hash of
    all their members.
    """
    part = Fraction(str(threshold))
    p, q = part.numerator, part.denominator
    kind = df.schema[members].dataType.elementType.simpleString()
    own = F.array_distinct(F.filter(F.coalesce(members, F.array().cast(f"array<{kind}>")), lambda x: x.isNotNull()))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.array_sort(own).alias("members")).filter(F.size("members") >= max(1, min_size))
    rows = rows.withColumns({"h1": F.xxhash64("members"), "h2": F.xxhash64(F.reverse("members"), F.lit(1))})
    classes = rows.groupBy("h1", "h2").agg(F.min("key").alias("id"), F.min_by("members", "key").alias("members"), F.count("*").alias("n_copies"))
    classes = stored(classes)
    copies = stored(rows.select("key", "h1", "h2").join(classes.filter("n_copies > 1").select("h1", "h2", "id", "n_copies"), ["h1", "h2"]).select("id", "key", "n_copies"))

    n_sets = max(1, classes.count())
    reach = F.size("members") - _ceil_part(F.size("members"), part) + 1
    each = classes.select("id", reach.alias("reach"), F.explode("members").alias("m"))
    counts = each.groupBy("m").agg(F.count("*").alias("f"), F.max("reach").alias("r"))
    small = -(-q // p) if q % p else q // p + 1  # the least size that makes two members be shared
    levels = min(3, -(-max(min_size, small) * p // q))
    numbers = numbered(counts.select("m", "f", _level(levels, n_sets).alias("level"), F.ceil(F.col("f") / PART).cast("int").alias("parts")), "member")
    ordered = each.join(numbers, "m").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "member", "level", "parts"))).alias("x"))
    n = F.size("members")
    sets = stored(
        ordered.select("id", F.col("x.member").alias("members"), F.col("x.level").alias("level"), F.col("x.parts").alias("parts"))
        .withColumn("n", n)
        .withColumns({"s1": _signature(False), "s2": _signature(True), "reach": F.col("n") - _ceil_part(F.col("n"), part) + 1})
    )
    large = _postings(sets.filter(F.col("n") >= small), levels)
    candidates = _candidates(large, large, p, q)
    if min_size < small:  # sets of so few members that one may be all they share, with sets of a size that allows it
        few = _postings(sets.filter(F.col("n") < small), 1)
        near = _postings(sets.filter(F.col("n") * p <= (small - 1) * q), 1)
        candidates = candidates.unionByName(_candidates(few, near, p, q))
    left = sets.select(F.col("id").alias("id_a"), F.col("members").alias("left"))
    right = sets.select(F.col("id").alias("id_b"), F.col("members").alias("right"))
    sized = candidates.join(left, "id_a").join(right, "id_b").select(
        "id_a", "id_b", F.size(F.array_intersect("left", "right")).alias("common"), F.size("left").alias("n_a"), F.size("right").alias("n_b")
    )
    return sized.filter(F.col("common") * (p + q) >= (F.col("n_a") + F.col("n_b")) * p), copies


def all_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of the classes spread over their copies, and the copies among themselves.

    The copies of a class are dealt to tasks by PART, so that none holds all pairs of a large class.
    """
    parts = F.ceil(F.col("n_copies") / PART).cast("int")
    dealt = copies.select("id", "key", F.pmod(F.hash("key"), parts).alias("part"))
    heads = copies.groupBy("id").agg(F.first(parts).alias("parts"))
    found = pairs.select("id_a", "id_b")
    for x in ("id_a", "id_b"):
        several = found.join(heads.withColumnRenamed("id", x), x, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        found = several.join(dealt.withColumnRenamed("id", x), [x, "part"], "left").select(F.coalesce("key", x).alias(x), *[c for c in found.columns if c != x])
    every = copies.select("id", F.col("key").alias("id_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    among = dealt.withColumnRenamed("key", "id_a").join(every, ["id", "part"]).filter("id_a < id_b").select("id_a", "id_b")
    both = found.select("id_a", "id_b").unionByName(among)
    return both.select(F.least("id_a", "id_b").alias("key_a"), F.greatest("id_a", "id_b").alias("key_b"))
