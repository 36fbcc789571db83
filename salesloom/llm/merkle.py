"""Merkle manifest of a documents table: leaves, roots per language, one root, and proofs for every row.

Levels are kept as strings. A block of ``BLOCK`` neighbouring leaves holds a level as the
concatenation of its digests (64 hex characters each): the digests of the next level are hashes of
its substrings of 128 characters, the sibling of a node is the substring beside it, and the last
substring of a level may be half as long, a run of one. Eight levels up a block is one digest;
these are the leaves of the next round, until a language is one block. The languages' roots form
one more such tree. On the way down a block hands each child its own proof, with what is above the
block behind it, so only one row a block is ever joined, never a row a document.

Positions come from a range partitioning of the leaves: a row's number in its partition plus the
sizes of the partitions before it, so no language is numbered, sorted or hashed in one task.

Defined results: a null field counts as ``-``; a null lang is a group of its own, the first; null
ids come first, equal ids in the order of their leaves, and each repeated row is a leaf; an empty
table has no rows and no root; other columns are not looked at. A single leaf is its own subroot,
and a single subroot is the root. Proofs are as long as a tree is deep (64 characters a level).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import if_small, store

LEVELS = 8
BLOCK = 1 << LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KEYS = ["_some", "_lang"]  # a lang and whether there is one; they sort as lang does, null first


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value, or ``-``."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded), 256)


def numbered(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_at``, their place from 0 inside their group, and ``_total``, the size of the group."""
    ranged = nodes.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = store(ranged.withColumn("_id", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftrightunsigned("_id", 33).alias("_part")  # the upper bits name the partition
    runs = placed.groupBy(*keys, part).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_total"))
    joined = placed.withColumn("_part", part).join(if_small(store(offsets, "merkle-offsets")), [*keys, "_part"])
    return joined.withColumn("_at", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def _blocks(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: its rows in order, with all that they carry."""
    carried = [c for c in nodes.columns if c not in (*keys, "_at", "_total")]
    block = F.shiftright("_at", LEVELS).alias("_block")
    rows = F.array_sort(F.collect_list(F.struct("_at", *carried))).alias("_rows")
    return nodes.groupBy(*keys, "_total", block).agg(rows)


def _parents(level: Column) -> Column:
    """The next level: the hashes of the substrings of two digests, the last of one where the number is odd."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (2 * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (2 * HEX) + 1, F.lit(2 * HEX)), 256)), "")


def _with_levels(blocks: DataFrame) -> DataFrame:
    """The levels of each block as strings ``_l0`` to ``_l8``; a group of one block stops at its root."""
    blocks = blocks.withColumn("_l0", F.array_join(F.transform("_rows", lambda r: r["node"]), ""))
    for j in range(LEVELS):
        level, size = F.col(f"_l{j}"), F.octet_length(f"_l{j}")
        blocks = blocks.withColumn(f"_l{j + 1}", F.when((F.col("_total") <= BLOCK) & (size <= HEX), level).otherwise(_parents(level)))
    return blocks


def _children(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """The rows of the blocks, each with ``_up``: its siblings in the block from below, then what is above the block."""

    def proof(row: Column) -> Column:
        parts = []
        for j in range(LEVELS):  # the place beside the node; past the end of the level it is empty
            beside = F.shiftright(row["_at"].bitwiseAND(F.lit(BLOCK - 1)), j).bitwiseXOR(F.lit(1)).cast("int")
            parts.append(F.substring(F.col(f"_l{j}"), beside * HEX + 1, F.lit(HEX)))
        return F.concat(*parts, F.col("_up"))

    with_proof = F.transform("_rows", lambda r: F.struct(r.alias("row"), proof(r).alias("proof")))
    rows = _with_levels(blocks).select(*keep, F.explode(with_proof).alias("_child"))
    return rows.select(*keep, "_child.row.*", F.col("_child.proof").alias("_up"))


def build(nodes: DataFrame, keys: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and each group's root: keys, ``_size`` (leaves), ``node``.

    ``nodes`` has the keys, ``_at``, ``_total``, ``node`` and what else its rows carry.
    """
    rounds, roots = [], None
    nodes = nodes.withColumn("_size", F.col("_total"))
    while True:
        blocks = store(_blocks(nodes, [*keys, "_size"]), f"merkle-{len(rounds)}")
        rounds.append(blocks)
        tops = store(_with_levels(blocks).select(*keys, "_size", "_total", "_block", F.col(f"_l{LEVELS}").alias("node")), "merkle-tops")
        done = tops.where(F.col("_total") <= BLOCK).select(*keys, "_size", "node")
        roots = done if roots is None else roots.unionByName(done)
        rest = tops.where(F.col("_total") > BLOCK)
        if rest.isEmpty():
            return rounds, roots
        total = F.ceil(F.col("_total") / BLOCK).cast("long")
        nodes = rest.select(*keys, "_size", total.alias("_total"), F.col("_block").alias("_at"), "node")


def proofs(rounds: list[DataFrame], keys: list[str], above: DataFrame) -> DataFrame:
    """Every leaf's row with ``_up``, its proof. ``above`` has each group's ``_up`` and what else its rows need."""
    extra = [c for c in above.columns if c not in keys]
    handed = None
    for r in reversed(range(len(rounds))):
        # groups that are one block in this round; larger ones get theirs from the round above
        one, more = F.col("_total") <= BLOCK, F.col("_total") > BLOCK
        blocks = rounds[r].where(one).join(if_small(above), keys)
        if handed is not None:
            blocks = blocks.unionByName(rounds[r].where(more).join(if_small(handed), [*keys, "_block"]))
        rows = _children(blocks, [*keys, "_size", *[c for c in extra if c != "_up"]])
        if r == 0:
            return rows
        handed = store(rows.select(*keys, F.col("_at").alias("_block"), *extra), f"merkle-handed-{r}")


def fold(node: Column, proof: Column, read: Column, at: Column, size: Column) -> Column:
    """A struct of the root that ``node`` at place ``at`` of ``size`` gives with the siblings from character ``read`` on, and the next character."""
    depth = F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))
    levels = F.when(depth == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), depth - 1))

    def up(state: Column, j: Column) -> Column:
        place, last = F.call_function("shiftright", at, j), F.call_function("shiftright", size - 1, j)
        beside = F.substring(proof, state["read"], F.lit(HEX))
        is_left = place.bitwiseAND(F.lit(1)) == 0
        alone = is_left & (place == last)
        run = F.when(alone, state["node"]).when(is_left, F.concat(state["node"], beside)).otherwise(F.concat(beside, state["node"]))
        return F.struct(F.sha2(run, 256).alias("node"), (state["read"] + F.when(alone, 0).otherwise(HEX)).alias("read"))

    return F.aggregate(levels, F.struct(node.alias("node"), read.cast("int").alias("read")), up)


def merkle_proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, lang, leaf, place and size in its language, subroot, root, proof, folded_root, verified.

    ``folded_root`` is worked out from the leaf and its proof alone. Where ``tampered`` (on the
    columns of the documents) holds, the leaf is one of a document whose n_chars is greater by one.
    """
    fields = [F.col(f) for f in FIELDS]
    other = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    changed = F.when(tampered, leaf_hash(other)) if tampered is not None else F.lit(None).cast("string")
    lang = F.col("lang").cast("string")
    leaves = docs.select(lang.isNotNull().alias("_some"), F.coalesce(lang, F.lit("")).alias("_lang"), "doc_id", leaf_hash(fields).alias("node"), changed.alias("_other"))
    rounds, subroots = build(numbered(leaves, KEYS, ["doc_id", "node"]), KEYS)

    subroots = subroots.withColumn("_all", F.lit(True)).withColumnRenamed("_size", "_leaves")
    top_rounds, top = build(numbered(subroots, ["_all"], KEYS), ["_all"])
    root = top.select("node").scalar()
    langs = proofs(top_rounds, ["_all"], top.select("_all", F.lit("").alias("_up")))
    langs = langs.select(*KEYS, F.col("node").alias("subroot"), F.col("_at").alias("_lang_at"), F.col("_size").alias("_langs"), "_up")
    rows = proofs(rounds, KEYS, store(langs, "merkle-langs"))

    first = fold(F.coalesce("_other", "node"), F.col("_up"), F.lit(1), F.col("_at"), F.col("_size"))
    rows = rows.withColumn("_first", first)
    second = fold(F.col("_first.node"), F.col("_up"), F.col("_first.read"), F.col("_lang_at"), F.col("_langs"))
    rows = rows.withColumn("folded_root", second["node"]).withColumn("root", root)
    return rows.select(
        "doc_id", F.when(F.col("_some"), F.col("_lang")).alias("lang"), F.col("node").alias("leaf"), F.col("_at").alias("place"), F.col("_size").alias("leaves"),
        "subroot", "root", F.col("_up").alias("proof"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """One row per language: lang, leaves, subroot, and the root over all languages."""
    return merkle_proofs(docs).where("place = 0").select("lang", "leaves", "subroot", "root")


def seventh(ident: Column) -> Column:
    """Whether 7 divides the CRC-32 of the id as decimal text."""
    return F.coalesce(F.crc32(ident.cast("string")) % 7 == 0, F.lit(False))
