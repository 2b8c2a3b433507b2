"""Extending reads of one anchor through the k-mer graph.

K-mers are numbers, two bits a base, so their overlaps are shifts and masks.  The
next step of a walk depends on the current k-mer only, so the graph is a table
of successors.  It is doubled to jumps of 32 steps, whose bases are one number
too: a jump of 2n steps is one of n steps followed by that of its end.  Walks are
then made of a few jumps, from the k-mers that reads end in only, with no driver
loop over reads and no table on one machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.functions.dna import FILLED, first_bases, last_bases, once, packed, ratio_ok, unpacked
from clonespark.functions.motif import Motif
from clonespark.operators.search import find_cdr3
from clonespark.staging import cut, drop

#: Bases beside k that reads give to the pool; the longest read after extension.
BESIDE, MAX_LENGTH = 10, 150
#: Steps of a jump; the bases of as many are one number.  The longest k-mer that is one.
JUMP, LONGEST_K = 32, 32


def kmer_pool(reads: DataFrame, k: int, homopolymers: str = "ACGT") -> DataFrame:
    """(sample_id, kmer, n): of the last k + 10 bases of V reads and the first
    of J reads; runs of one of ``homopolymers`` and k-mers with other letters are
    left out.  ``kmer`` is packed; k is 32 at most."""
    if not 0 < k <= LONGEST_K:
        raise ValueError(f"k must be 1 to {LONGEST_K}")
    end = F.when(F.col("part") == "J", first_bases("seq", k + BESIDE)).otherwise(last_bases("seq", k + BESIDE))
    # reads of one clone share their ends: each end is cut into k-mers once, and its reads are counted
    ends = reads.groupBy("sample_id", end.alias("end")).agg(F.count("*").alias("times"))
    n, w = F.length("end"), F.least(F.length("end"), F.lit(LONGEST_K))
    told = ends.where(n >= k).select("*", n.alias("len"), w.alias("w"), packed(F.left("end", w)).alias("first"), packed(F.right("end", w)).alias("last"))
    words = told.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("i"))
    # the numbers of an end's first and last bases hold those of its k-mers; where there are other letters, each k-mer is read
    inside = lambda code, behind: F.call_function("shiftrightunsigned", F.col(code), 2 * behind).bitwiseAND(F.lit(_signed((1 << 2 * k) - 1)))
    kmer = (
        F.when(F.col("first").isNotNull() & (F.col("i") + k <= F.col("w")), inside("first", F.col("w") - k - F.col("i")))
        .when(F.col("last").isNotNull() & (F.col("i") >= F.col("len") - F.col("w")), inside("last", F.col("len") - k - F.col("i")))
        .otherwise(packed(F.substring("end", F.col("i") + 1, F.lit(k))))
    )
    runs = [_signed(int(str("ACGT".index(b)) * k, 4)) for b in homopolymers]
    return words.select("sample_id", "times", kmer.alias("kmer")).where(F.col("kmer").isNotNull() & ~F.col("kmer").isin(runs)).groupBy("kmer", "sample_id").agg(F.sum("times").alias("n")).select("sample_id", "kmer", "n")


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def _dealt(df: DataFrame) -> DataFrame:
    """``df``, never sent whole to the driver and every task: a table of k-mers grows with
    the reads, and the size of its stored files, by which Spark judges, is a small part of its rows'.  Joins name the k-mer
    first: rows are sorted by it as a number, and names are compared for equal ones only."""
    return df.hint("merge")


def _neighbours(pool: DataFrame, k: int) -> DataFrame:
    """(sample_id, right, kmer, next, base) of both directions: k-mers that share k - 1 bases are one group, of four
    that end in them and four that begin with them at most, so that none is joined."""
    shared = F.lit((1 << 2 * (k - 1)) - 1)
    first, last = F.shiftrightunsigned("kmer", 2 * (k - 1)).bitwiseAND(F.lit(3)), F.col("kmer").bitwiseAND(F.lit(3))
    ending = F.struct(F.col("kmer").bitwiseAND(shared).alias("overlap"), first.alias("which"))
    beginning = F.struct(F.shiftrightunsigned("kmer", 2).bitwiseAND(shared).alias("overlap"), (last + 4).alias("which"))
    sides = pool.select("sample_id", "n", F.inline(F.array(ending, beginning)))
    groups = sides.groupBy("overlap", "sample_id").agg(*[F.sum(F.when(F.col("which") == i, F.col("n"))).alias(f"n{i}") for i in range(8)])
    # each k-mer of a group with the counts of the four on its other side
    counts = [F.when(F.col("i") < 4, F.col(f"n{4 + j}")).otherwise(F.col(f"n{j}")).alias(f"c{j}") for j in range(4)]
    each = groups.select("*", F.posexplode(F.array(*[f"n{i}" for i in range(8)])).alias("i", "n")).where("n IS NOT NULL")
    each = each.select("sample_id", "overlap", "n", (F.col("i") < 4).alias("right"), F.col("i").bitwiseAND(F.lit(3)).cast("long").alias("own"), once(**{f"c{j}": c for j, c in enumerate(counts)}))
    longer = lambda base: F.shiftleft("overlap", 2).bitwiseOR(base)
    led = lambda base: F.shiftleft(base, 2 * (k - 1)).bitwiseOR(F.col("overlap"))
    # the most frequent one, the first base of several, as one number; a run of one base is its own neighbour
    fit = [F.when(ratio_ok(F.col(f"c{j}"), F.col("n")) & ~((F.col("own") == j) & (led(F.col("own")) == longer(F.col("own")))), F.col(f"c{j}") * 4 + (3 - j)) for j in range(4)]
    found = each.select("sample_id", "overlap", "right", "own", once(best=F.greatest(*[F.when(F.col(f"c{j}").isNotNull(), x) for j, x in enumerate(fit)]))).where("best IS NOT NULL")
    found = found.select("sample_id", "overlap", "right", "own", (3 - F.col("best").bitwiseAND(F.lit(3))).alias("base"))
    kmer, near = F.when(F.col("right"), led(F.col("own"))).otherwise(longer(F.col("own"))), F.when(F.col("right"), longer(F.col("base"))).otherwise(led(F.col("base")))
    return found.select("sample_id", "right", kmer.alias("kmer"), near.alias("next"), "base")


def successors(pool: DataFrame, k: int, right: bool = True) -> DataFrame:
    """(sample_id, kmer, next, base): the most frequent neighbour within ten
    times the k-mer's own count, other than itself; ties by base, A first.
    ``base``: 0 to 3 for A, C, G and T."""
    return _neighbours(pool, k).where(F.col("right") == right).select("sample_id", "kmer", "next", "base")


def jumps(succ: DataFrame) -> DataFrame:
    """(sample_id, kmer, next, code, len): each k-mer's next JUMP steps as one number; ``next`` is null where the walk has ended."""
    now = cut(succ.select("sample_id", "kmer", "next", F.col("base").cast("long").alias("code"), F.lit(1).alias("len")), "jumps")
    for _ in range(JUMP.bit_length() - 1):
        going = now.where("next IS NOT NULL")
        if going.isEmpty():
            break
        on = now.select("sample_id", F.col("kmer").alias("next"), F.col("next").alias("next2"), F.col("code").alias("code2"), F.col("len").alias("len2"))
        n = F.coalesce("len2", F.lit(0))
        code = F.call_function("shiftleft", F.col("code"), 2 * n).bitwiseOR(F.coalesce("code2", F.lit(0).cast("long")))
        # walks that have ended are only carried on
        longer = going.join(_dealt(on), ["next", "sample_id"], "left").select("sample_id", "kmer", F.col("next2").alias("next"), code.alias("code"), (F.col("len") + n).alias("len"))
        # each round reads the last one twice; without the cut the plan would double as well
        last, now = now, cut(longer.unionByName(now.where("next IS NULL")), "jumps")
        drop(last)
    return now


def paths(succ: DataFrame, steps: int = MAX_LENGTH, starts: DataFrame | None = None) -> DataFrame:
    """(sample_id, kmer, path): the bases of walks from ``starts`` (sample_id, kmer;
    distinct), or from every k-mer that has a successor, ``steps`` at most; cycles go round."""
    table = jumps(succ)
    on = _dealt(table.select("sample_id", F.col("kmer").alias("at"), "next", "code", "len"))
    # the same side in every join, so it is shuffled once
    now = (table if starts is None else starts).select("sample_id", "kmer", F.col("kmer").alias("at"), F.lit("").alias("path"))
    for _ in range(-(-steps // JUMP)):
        more = F.coalesce(unpacked("code", F.col("len")), F.lit(""))
        now = now.join(on, ["at", "sample_id"], "left").select("sample_id", "kmer", F.col("next").alias("at"), F.concat("path", more).alias("path"))
    return now.select("sample_id", "kmer", F.left("path", F.lit(steps)).alias("path"))


def _grown(room: Column) -> Column:
    return F.left(F.coalesce("path", F.lit("")), F.greatest(room, F.lit(0)))


def extend(reads: DataFrame, pool: DataFrame, k: int, max_length: int = MAX_LENGTH) -> DataFrame:
    """V reads grow at their right end, J reads at their left, up to ``max_length``."""
    room = F.lit(max_length) - F.length("seq")
    # both directions are doubled together, as samples of their own
    def of(side: bool) -> Column:
        return F.struct("sample_id", F.lit(side).alias("right"))

    steps = _neighbours(pool, k).select(F.struct("sample_id", "right").alias("sample_id"), "kmer", "next", "base")
    right = F.col("part") != "J"
    end = F.when(F.length("seq") >= k, packed(F.when(right, last_bases("seq", k)).otherwise(first_bases("seq", k))))
    starts = reads.where(room > 0).select(F.when(right, of(True)).otherwise(of(False)).alias("sample_id"), end.alias("kmer")).where("kmer IS NOT NULL").distinct()
    walks = cut(paths(steps, max_length, starts), "walks")

    def side(part: DataFrame, right: bool) -> DataFrame:
        walk = walks.where(F.col("sample_id.right") == right).select(F.col("sample_id.sample_id").alias("sample_id"), "kmer", "path")
        out = part.withColumn("kmer", end).join(_dealt(walk), ["kmer", "sample_id"], "left").withColumn("more", _grown(room))
        new, filler = (F.col("more"), F.repeat(F.lit(FILLED), F.length("more"))) if right else (F.reverse("more"), F.repeat(F.lit(FILLED), F.length("more")))
        seq = F.concat("seq", new) if right else F.concat(new, "seq")
        padded = F.rpad(F.col("qual"), F.length("seq"), FILLED)
        qual = F.concat(padded, filler) if right else F.concat(filler, padded)
        return out.withColumn("grown", seq).withColumn("qual", qual).drop("seq", "kmer", "path", "more").withColumnRenamed("grown", "seq").select(*part.columns)

    return side(reads.where("part <> 'J'"), True).unionByName(side(reads.where("part = 'J'"), False))


def rescue(reads: DataFrame, motif: Motif, k: int, compat: bool = False, max_length: int = MAX_LENGTH) -> DataFrame:
    """All reads with a CDR3: those of the first pass, and those that have one
    after extension, by the chain's own inner anchors."""
    missing = reads.where("cdr3 IS NULL")
    # stored, as both directions read it on both sides of a join
    pool = cut(kmer_pool(reads.where("part <> 'VJ'"), k, "G" if compat else "ACGT"), "pool")
    again = extend(missing, pool, k, max_length).select("*", once(m=find_cdr3("seq", "qual", motif)))
    found = again.withColumn("cdr3", F.col("m.cdr3")).withColumn("cdr3_qual", F.col("m.qual")).drop("m")
    return reads.where("cdr3 IS NOT NULL").unionByName(found.where("cdr3 IS NOT NULL"))


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key that has several; ties to the smaller."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.count("*").alias("kinds"), F.min(F.struct((-F.col("n")).alias("n"), value)).alias("b"))
    return best.where("kinds > 1").select(key, F.col(f"b.{value}").alias(value), (-F.col("b.n")).alias("n"))


def leaders(reads: DataFrame, k: int) -> DataFrame:
    """(sample_id, part, kmer, region): the segment that most reads have which
    begin with a k-mer (V) or end with it (J), of k-mers with several segments."""
    ends = F.when(F.col("part") == "J", F.struct(last_bases("seq", k).alias("kmer"), F.col("j").alias("region"))).otherwise(F.struct(first_bases("seq", k).alias("kmer"), F.col("v").alias("region")))
    told = reads.where("part <> 'VJ'").select(F.struct("sample_id", "part", ends["kmer"].alias("kmer")).alias("key"), ends["region"].alias("region"))
    return mode_of(told, "key", "region").select("key.*", "region")


def impute(reads: DataFrame, known: DataFrame, k: int, reach: int = 6) -> DataFrame:
    """``reads`` (with v and j) whose missing segment is the leading k-mers' own:
    a V read's J by the k-mers up to ``reach`` bases before its end, a J read's V
    by those after its start; the nearest to the end decides."""
    missing = F.when(F.col("part") == "V", F.lit("J")).when(F.col("part") == "J", F.lit("V"))
    start = lambda i: F.when(F.col("part") == "V", F.length("seq") - k - i + 1).otherwise(i + 1)
    words = F.transform(F.sequence(F.lit(0), F.least(F.length("seq") - k, F.lit(reach))), lambda i: F.struct(i.alias("i"), F.substring(F.col("seq"), start(i), F.lit(k)).alias("kmer")))
    end = F.when(F.col("part") == "V", F.right("seq", F.lit(k + reach))).otherwise(F.left("seq", F.lit(k + reach)))
    # equal ends are looked up once
    ends = reads.where((F.length("seq") >= k) & missing.isNotNull()).select("sample_id", missing.alias("other"), end.alias("end"), words.alias("words")).dropDuplicates(["sample_id", "other", "end"])
    named = known.withColumnRenamed("part", "other")
    told = ends.select("sample_id", "other", "end", F.inline("words")).join(_dealt(named), ["sample_id", "other", "kmer"]).groupBy("sample_id", "other", "end").agg(F.min(F.struct("i", "region"))["region"].alias("region"))
    told = told.select("sample_id", F.when(F.col("other") == "J", "V").otherwise("J").alias("part"), "end", "region")
    out = reads.withColumn("end", end).join(_dealt(told), ["sample_id", "part", "end"], "left")
    j, v = F.when(F.col("part") == "V", F.coalesce("j", "region")).otherwise(F.col("j")), F.when(F.col("part") == "J", F.coalesce("v", "region")).otherwise(F.col("v"))
    return out.select(*[x.alias(c) if (x := {"v": v, "j": j}.get(c)) is not None else F.col(c) for c in reads.columns])
