"""Merkle manifest of a table of documents, with leaf places from bitmap ranks.

Every row is a leaf; leaves of a language stand in the order of their ids. That order is never sorted for: ids are
merged into bitmaps of 64 per language (only words with a bit are kept), a directory of population counts
gives the number of leaves before each word, and a leaf's place is that number plus the bits below its own. The
directory is summed over a tree of 2^15 children a node, so no language's words meet in one task, however its
ids are spread. Words that hold an id twice, and rows without an id, are placed by a second index of the same
kind over the leading bits of their leaves.

Places key the slots of blocks of ``FAN ** LEVELS`` nodes, which reduce ``LEVELS`` levels at a time; a round's blocks
are 1 / 64 of the one before. Paths go back down from the root with one join of small rows a round, and every
leaf's proof is computed inside its block.

Defined cases: nulls in any column are ``-`` in the leaf, a null language is a group of its own and comes first; rows
without an id come before all others of their language; rows of one id stand in the order of their leaves (hex);
equal rows each are a leaf; an empty table gives an empty result; extra columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.session import checkpointed

FAN = 8
LEVELS = 2
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: bits of a key that one directory node spreads over its children, and how often a word's 58 bits take that
DIRECTORY_BITS = 15
DIRECTORY_LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digests(hashes: Column) -> Column:
    return F.sha2(F.concat_ws("", hashes).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """``g, doc_id, leaf, changed``: a row for each of ``docs``.

    ``g`` is the language as a key that is never null and sorts as languages do. ``changed`` is the leaf that
    the row would have if the letters A-Z of its text were lower case, where ``tampered`` is true of a row, and null elsewhere.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        *[_framed(F.col(c)).alias(f"f{n}") for n, c in enumerate(columns)],
        _framed(F.translate("text", UPPER, LOWER)).alias("low"),
        (F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)).alias("tampered"),
    )
    framed = [F.col(f"f{n}") for n in range(len(columns))]
    lower = [F.col("low") if c == "text" else f for c, f in zip(columns, framed, strict=True)]
    return rows.select("g", "doc_id", digest(*framed).alias("leaf"), F.when(F.col("tampered"), digest(*lower)).alias("changed"))


def directory(rows: DataFrame, group: Sequence[str], key: str, weight: str) -> DataFrame:
    """``group, word, bits, n, before``: bitmaps of 64 keys with the weight of all smaller keys of the group.

    ``key`` is a long or null; rows of null keys come before all others and have no word of their own.
    """
    group = list(group)
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    words = checkpointed(
        rows.groupBy(*group, F.shiftright(key, 6).alias("word")).agg(F.bit_or(F.when(F.col(key).isNotNull(), bit)).alias("bits"), F.sum(weight).alias("n"))
    )
    levels = [words.filter(F.col("word").isNotNull()).select(*group, F.col("word").alias("k"), "n")]
    for _ in range(DIRECTORY_LEVELS):
        levels.append(levels[-1].groupBy(*group, F.shiftright("k", DIRECTORY_BITS).alias("k")).agg(F.sum("n").alias("n")))
    levels[-1] = levels[-1].unionAll(words.filter(F.col("word").isNull()).select(*group, F.lit(-(2**62)).cast("long").alias("k"), "n"))
    before = None
    for level in reversed(levels):
        top = before is None
        order = Window.partitionBy(*group, *([] if top else ["up"])).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("up", F.shiftright("k", DIRECTORY_BITS))
        level = level.select(*group, "k", "up", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("own"))
        if not top:
            level = level.join(before, [*group, "up"]).withColumn("own", F.col("own") + F.col("above"))
        before = level.select(*group, F.col("k").alias("up"), F.col("own").alias("above"))
    before = before.select(*group, F.col("up").alias("word"), F.col("above").alias("before"))
    return words.filter(F.col("word").isNotNull()).join(before, [*group, "word"])


def places(rows: DataFrame) -> DataFrame:
    """``g, i, doc_id, leaf, changed``: the rows of ``leaves()`` with their places in their language, from 0."""
    rows = rows.withColumn("one", F.lit(1).cast("long")).withColumn("word", F.shiftright("doc_id", 6))
    index = checkpointed(directory(rows, ["g"], "doc_id", "one"))
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(doc_id & 63 as int)))")
    found = rows.filter(F.col("doc_id").isNotNull()).join(index, ["g", "word"])
    once = F.col("n") == F.bit_count("bits")
    single = found.filter(once).select("g", (F.col("before") + below).alias("i"), "doc_id", "leaf", "changed")
    crowded = index.filter(~once).select("g", "word", "before")
    ties = rows.join(crowded, ["g", "word"]).unionByName(
        rows.filter(F.col("doc_id").isNull()).withColumn("before", F.lit(0).cast("long"))
    )
    ties = checkpointed(ties.groupBy("g", "word", "before", "doc_id", "leaf", "changed").agg(F.sum("one").alias("c")))
    if ties.isEmpty():
        return single
    # first the ids of a word, then the leaves of an id by their leading 60 bits, then leaves that share those
    ids = ties.groupBy("g", "word", "before", "doc_id").agg(F.sum("c").alias("c"))
    in_word = Window.partitionBy("g", "word").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.select(
        F.col("g").alias("ig"), F.col("doc_id").alias("id"), (F.col("before") + F.coalesce(F.sum("c").over(in_word), F.lit(0))).alias("first")
    )
    keyed = checkpointed(
        ties.withColumn("lead", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
        .join(ids, (F.col("g") == F.col("ig")) & F.col("doc_id").eqNullSafe(F.col("id")))
        .withColumn("has", F.col("doc_id").isNotNull())
        .select("g", "has", F.coalesce("doc_id", F.lit(0)).alias("d"), "doc_id", "leaf", "changed", "c", "first", "lead", F.shiftright("lead", 6).alias("word"))
    )
    inner = directory(keyed, ["g", "has", "d"], "lead", "c")
    cells = keyed.join(inner.select("g", "has", "d", "word", "before"), ["g", "has", "d", "word"])
    in_cell = Window.partitionBy("g", "has", "d", "word").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.col("before") + F.coalesce(F.sum("c").over(in_cell), F.lit(0))
    several = cells.withColumn("start", start).select(
        "g", F.explode(F.expr("sequence(start, start + c - 1)")).alias("i"), "doc_id", "leaf", "changed"
    )
    return single.unionByName(several)


def _reduced(hashes: Column) -> Column:
    """The next level of an array of nodes: every ``FAN`` consecutive ones become their digest."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FAN).cast("int")), lambda j: _digests(F.slice(hashes, j * FAN + 1, F.lit(FAN)))
    )


def _blocks(nodes: DataFrame, round_: int, carried: Sequence[str]) -> DataFrame:
    """``g, b, entries, depth, h0 ... , top`` of ``nodes(g, i, depth, h, carried)``: one row for each block of slots."""
    fields = [F.expr(f"cast(i % {BLOCK} as int)").alias("slot"), "h", *carried]
    rows = nodes.groupBy("g", F.expr(f"i div {BLOCK}").alias("b")).agg(
        F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct(*fields))).alias("entries")
    )
    rows = rows.withColumn("h0", F.col("entries.h"))
    for n in range(LEVELS):
        more = F.col("depth") > round_ * LEVELS + n
        rows = rows.withColumn(f"h{n + 1}", F.when(more, _reduced(F.col(f"h{n}"))).otherwise(F.col(f"h{n}")))
    return rows.withColumn("top", F.col(f"h{LEVELS}")[0]).drop(f"h{LEVELS}")


def _own_path(slot: Column, round_: int) -> Column:
    """Siblings left and right of a slot's ancestors inside its block, one entry a level that is there."""
    steps = []
    for n in range(LEVELS):
        at = F.floor(slot / FAN**n).cast("int")
        place = at % FAN
        left = F.concat_ws("", F.slice(F.col(f"h{n}"), at - place + 1, place))
        right = F.concat_ws("", F.slice(F.col(f"h{n}"), at + 2, F.lit(FAN - 1) - place))
        entry = F.array(F.struct(left.alias("l"), right.alias("r")))
        steps.append(F.when(F.col("depth") > round_ * LEVELS + n, entry).otherwise(F.slice(entry, 1, 0)))
    return F.concat(*steps)


def _with_depth(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``nodes(g, i, ...)`` with the number of levels above the leaves of their group, and its maximum."""
    totals = checkpointed(nodes.groupBy("g").agg(F.count(F.lit(1)).alias("total")))
    depth = F.lit(0)
    for n in range(21):  # 8 ** 21 is the range of a long
        depth = depth + (F.col("total") > F.lit(FAN**n).cast("long")).cast("int")
    totals = totals.select("g", depth.alias("depth"))
    deepest = totals.agg(F.max("depth")).first()[0]
    return nodes.join(totals, "g"), deepest or 0


def _raise_tree(nodes: DataFrame, carried: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, lowest first, and ``g, h``: the top of each group."""
    nodes, deepest = _with_depth(nodes)
    rounds: list[DataFrame] = []
    for n in range(max(1, -(-deepest // LEVELS))):
        rounds.append(checkpointed(_blocks(nodes, n, carried if n == 0 else [])))
        nodes = rounds[-1].select("g", F.col("b").alias("i"), F.col("top").alias("h"), "depth")
    return rounds, nodes.select("g", "h")


def _lowered(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The lowest round's blocks with ``path``, their way to the top, given ``paths(g, path)`` of the tops of groups."""
    paths = paths.withColumn("b", F.lit(0).cast("long"))
    for n in reversed(range(1, len(rounds))):
        blocks = rounds[n].drop("top").join(paths, ["g", "b"])
        ways = F.transform("entries", lambda e: F.struct(e["slot"].alias("slot"), F.concat(_own_path(e["slot"], n), F.col("path")).alias("path")))
        blocks = blocks.select("g", "b", F.explode(ways).alias("w"))
        paths = blocks.select("g", (F.col("b") * BLOCK + F.col("w.slot")).alias("b"), F.col("w.path").alias("path"))
    return rounds[0].drop("top").join(paths, ["g", "b"])


def _numbered(groups: DataFrame) -> DataFrame:
    """``groups(g, h)`` as nodes of one tree in the order of ``g``, numbered over a range partitioning."""
    ranged = checkpointed(groups.repartitionByRange("g").withColumn("p", F.spark_partition_id()))
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition
    starts = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("g")) - 1
    return ranged.withColumn("r", rank).join(starts, "p").select(F.lit("").alias("g"), (F.col("s") + F.col("r")).alias("i"), "h", F.col("g").alias("group"))


def manifest(docs: DataFrame, tampered: Column | None = None, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One row for each of ``docs(doc_id, source, lang, n_chars, text)``:
    ``doc_id, lang, place, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``place`` is the leaf's number in its language, ``subroot`` the top of the language's tree, ``root`` the top of all.
    ``proof_sha256`` is the digest of all siblings on the way to the root. ``folded_root`` is computed from the leaf and
    those siblings, with the leaf of the tampered row where ``tampered`` holds, and ``verified`` compares it with the root.
    """
    placed = places(checkpointed(leaves(docs, tampered, columns)))
    rounds, tops = _raise_tree(placed.select("g", "i", F.col("leaf").alias("h"), "doc_id", "changed"), ["doc_id", "changed"])
    group_rounds, root = _raise_tree(_numbered(tops), ["group"])
    no_path = F.expr("cast(array() as array<struct<l: string, r: string>>)")
    top = _lowered(group_rounds, root.select("g", no_path.alias("path"))).crossJoin(F.broadcast(root.select(F.col("h").alias("root"))))  # one row
    ways = F.transform(
        "entries",
        lambda e: F.struct(e["group"].alias("g"), e["h"].alias("subroot"), F.concat(_own_path(e["slot"], 0), F.col("path")).alias("path")),
    )
    group_paths = checkpointed(top.select(F.explode(ways).alias("w"), "root").select("w.g", "w.subroot", "w.path", "root"))
    blocks = _lowered(rounds, group_paths.select("g", "path")).join(group_paths.select("g", "subroot", "root"), "g")

    def proved(e: Column) -> Column:
        way = F.concat(_own_path(e["slot"], 0), F.col("path"))
        fold = F.aggregate(way, F.coalesce(e["changed"], e["h"]), lambda acc, p: digest(p["l"], acc, p["r"]))
        return F.struct(
            e["slot"].alias("slot"), e["doc_id"].alias("doc_id"), e["h"].alias("leaf"),
            _digests(F.transform(way, lambda p: F.concat(p["l"], p["r"]))).alias("proof"), fold.alias("fold"),
        )

    rows = blocks.select("g", "b", "subroot", "root", F.explode(F.transform("entries", proved)).alias("e"))
    return rows.select(
        F.col("e.doc_id").alias("doc_id"), F.expr("if(g = '', null, substring(g, 2))").alias("lang"),
        (F.col("b") * BLOCK + F.col("e.slot")).alias("place"), F.col("e.leaf").alias("leaf"), "subroot", "root",
        F.col("e.proof").alias("proof_sha256"), F.col("e.fold").alias("folded_root"), (F.col("e.fold") == F.col("root")).alias("verified"),
    )
