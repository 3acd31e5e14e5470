"""Names within a folder: collisions get ` (n)`, the rest keep what they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import paths
from doclens.operators.lineage import cut


def number_names(rows: DataFrame, folder: str, title: str, ext: str, id_: str) -> DataFrame:
    """Built-in path: `name` per row, exact where no title already ends in ` (n)` and nothing is kept.

    The n-th row of a case-folded name, by id, takes ` (n)`, the first none.
    """
    plain = paths.file_name(F.col(title), F.col(ext))
    turn = F.row_number().over(Window.partitionBy(folder, F.lower(plain)).orderBy(id_))
    numbered = F.when(turn == 1, plain).otherwise(paths.file_name(F.col(title), F.concat(F.lit(" ("), turn.cast("string"), F.lit(")"), F.col(ext))))
    return rows.withColumn("name", numbered)


def nth_name(title: Column, ext: Column, n: Column) -> Column:
    """The n-th name that a title may take: itself, then with ` (n)` before the extension."""
    return F.when(n == 1, paths.file_name(title, ext)).otherwise(paths.file_name(title, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"), ext)))


def family(stem: Column, ext: Column) -> Column:
    """What rows share that want the same names, letter case aside."""
    return F.concat(F.lower(stem), F.lit("\0"), F.lower(ext))


#: Bytes up to which a title's names are never cut; a longer title is a family of its own spelling.
UNCUT = 120


def assign_names(rows: DataFrame) -> DataFrame:
    """folder, ord, id, title, ext, kept (a previous name or null) -> folder, id, name.

    A kept name that its title still gives stays, of equal ones (letter case aside) the first by ord. The others take, in
    the order of their ids (as UTF-16), the first of their names that neither a kept name nor an earlier id has.

    Rows of one folder, title and extension are a family: they want the same names in the same order, so that the r-th by
    id has the r-th number that is free. Numbers of a family that others hold are its blocks: with whom they are held,
    they are closed to all later ids. Names that two families want go to the smaller id; the other family gets a block
    and numbers its rows anew, until no block is new. As blocks only ever close numbers, what comes out does not depend
    on the order of these rounds, and is what naming one by one gives. No step needs a folder, or more of a family than
    its foreign blocks, in one place; windows are per family and spill.

    Null titles count as empty, null extensions too; null ids come before others; equal ids go by ord.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    # a null folder is one like others: inside a struct nulls are equal
    plain = rows.select(F.struct("folder").alias("folder"), "ord", "id", text("title"), text("ext"), "kept").withColumn("uid", F.struct(F.encode("id", "UTF-16BE").alias("id"), F.col("ord").cast("long").alias("ord")))
    short = F.octet_length("title") + F.octet_length("ext") <= UNCUT
    fam = F.when(short, family(paths.file_name(F.col("title"), F.lit("")), F.col("ext"))).otherwise(F.concat(F.lit("\0"), "title", F.lit("\0"), F.lower("ext")))
    # the number with which the title gives the kept name, if any does
    said = F.regexp_extract(F.when(F.endswith("kept", F.col("ext")), F.left("kept", F.length("kept") - F.length("ext"))), r" \(([0-9]+)\)$", 1)
    number = F.when(F.col("kept") == nth_name(F.col("title"), F.col("ext"), F.lit(1)), F.lit(1).cast("long"))
    later = F.expr("try_cast(_said as bigint)")
    named = plain.withColumn("fam", fam).withColumn("_said", said).withColumn("n", F.coalesce(number, F.when((later != 1) & (F.col("kept") == nth_name(F.col("title"), F.col("ext"), later)), later))).drop("_said")
    turn = F.row_number().over(Window.partitionBy("folder", F.lower("kept"), F.col("n").isNull()).orderBy("ord", "uid"))
    named = cut(named.withColumn("stays", F.col("n").isNotNull() & (turn == 1)))
    of = Window.partitionBy("folder", "fam")
    kept = named.where("stays").select("folder", "id", "fam", "n", "ext", F.col("kept").alias("name"))
    members = cut(named.where("not stays").withColumn("r", F.row_number().over(of.orderBy("uid")).cast("long")).select("folder", "id", "uid", "fam", "title", "ext", "r"))
    families = members.select("folder", "fam").distinct()
    # blocks: folder, fam, n, w (the id that holds the number; null for a kept name)
    none = F.lit(None).cast(members.schema["uid"].dataType)
    held = kept.select("folder", "fam", "name", "ext", none.alias("w"))
    blocks = cut(least_holder(kept.where("n >= 1").select("folder", "fam", "n", none.alias("w")).unionByName(wanted_elsewhere(held)).join(families, ["folder", "fam"], "left_semi")))
    while True:
        names = cut(numbered(members, blocks).withColumn("name", nth_name(F.col("title"), F.col("ext"), F.col("n"))))
        holder = F.min("uid").over(Window.partitionBy("folder", F.lower("name")))
        lost = names.withColumn("w", holder).where("uid > w").select("folder", "fam", "n", "w")
        low = F.lower("name").alias("_low")
        taken = names.select("folder", "fam", "n", low).join(kept.select("folder", low), ["folder", "_low"], "left_semi").select("folder", "fam", "n", none.alias("w"))
        ahead = wanted_elsewhere(names.select("folder", "fam", "name", "ext", F.col("uid").alias("w"))).join(families, ["folder", "fam"], "left_semi")
        before = blocks
        blocks = cut(least_holder(before.unionByName(lost).unionByName(taken).unionByName(ahead)))
        same = (F.col("a.folder") == F.col("b.folder")) & (F.col("a.fam") == F.col("b.fam")) & (F.col("a.n") == F.col("b.n")) & F.col("a.w").eqNullSafe(F.col("b.w"))
        if blocks.alias("a").join(before.alias("b"), same, "left_anti").isEmpty():
            return kept.select("folder.folder", "id", "name").unionByName(names.select("folder.folder", "id", "name"))


def least_holder(blocks: DataFrame) -> DataFrame:
    """One row per number: a kept name before any id, then the smallest id."""
    w = F.when(F.count_if(F.col("w").isNull()) == 0, F.min("w"))
    return blocks.groupBy("folder", "fam", "n").agg(w.alias("w"))


def wanted_elsewhere(held: DataFrame) -> DataFrame:
    """Numbers that names (folder, fam, name, ext, w) are in other families: of the title that they spell out, and of the
    title without their number."""
    core = F.left(F.col("name"), F.length("name") - F.length("ext"))
    stem, number = (F.regexp_extract(core, r"(?s)^(.*) \(([0-9]+)\)$", k) for k in (1, 2))
    spelt = F.struct(family(core, F.col("ext")).alias("fam"), F.lit(1).cast("long").alias("n"))
    cut_off = F.struct(family(stem, F.col("ext")).alias("fam"), F.expr("if(try_cast(_n as bigint) > 1, try_cast(_n as bigint), null)").alias("n"))
    each = held.withColumn("_n", number).select("folder", F.col("fam").alias("_own"), "w", F.explode(F.array(spelt, cut_off)).alias("x"))
    return each.where("x.fam <> _own and x.n is not null").select("folder", "x.fam", "x.n", "w")


def numbered(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """members (folder, fam, uid, r, ...) with n: the r-th number that no block closes to it."""
    of = Window.partitionBy("folder", "fam")
    kept = F.count_if(F.col("w").isNull()).over(of.orderBy("n")) - F.col("w").isNull().cast("int")
    counted = blocks.withColumn("_kept", kept)
    # members before the holder: its number is closed to whom it comes to only if these do not use it up
    foreign = counted.where("w is not null")
    rows = members.join(foreign.select("folder", "fam").distinct(), ["folder", "fam"], "left_semi")
    line = rows.select("folder", "fam", "uid", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("_kept")).unionByName(foreign.select("folder", "fam", F.col("w").alias("uid"), "n", "_kept"))
    placed = line.withColumn("c", F.count_if(F.col("n").isNull()).over(of.orderBy("uid"))).where("n is not null")
    listed = placed.groupBy("folder", "fam").agg(F.sort_array(F.collect_list(F.struct("n", (F.col("c") + F.col("_kept")).alias("c")))).alias("x"))
    closes = lambda acc, x: F.when(x["c"] + F.size(acc) < x["n"], F.concat(acc, F.array(x["n"]))).otherwise(acc)
    closed = listed.select("folder", "fam", F.explode(F.aggregate("x", F.array().cast("array<bigint>"), closes)).alias("n"))
    closed = closed.unionByName(blocks.where("w is null").select("folder", "fam", "n"))
    # from the rank on at which it is passed over, a closed number moves every later rank up by one
    passed = closed.select("folder", "fam", (F.col("n") - F.row_number().over(of.orderBy("n")) + 1).alias("r"))
    both = members.select("folder", "fam", "r", F.struct("id", "uid", "title", "ext").alias("m")).unionByName(passed.withColumn("m", F.lit(None).cast(_member_type(members))))
    up = F.count_if(F.col("m").isNull()).over(of.orderBy("r").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("n", F.col("r") + up).where("m is not null").select("folder", "fam", "r", "n", "m.*")


def _member_type(members: DataFrame):
    return members.select(F.struct("id", "uid", "title", "ext").alias("m")).schema["m"].dataType
