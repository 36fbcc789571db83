"""Parents with their children as arrays, one record per key at any size.

Keys with up to ``block_size`` children are grouped at once. A bigger key's children are numbered
along their own order by a range partitioning, cut into blocks of ``block_size`` neighbours, which are
collected and sorted each on its own, and put together in order at the end; that last step moves
arrays and sorts nothing. What a record needs to fit is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.text import strip_html
from salesloom.operators.ordered import numbered
from salesloom.session import materialize

BLOCK_SIZE = 10_000
ORDER = "_order"  # of a child table: sorts the children and is not shown


def collected(rows: DataFrame, key: str, lists: Sequence[str], block_size: int = BLOCK_SIZE, parents: DataFrame | None = None) -> DataFrame:
    """``key, _parents, <lists>``: per key the sorted structs of each list column (null where a row is of another list).

    ``parents`` (``key, _parent``) travel with the rows of ordinary keys in one shuffle.
    """
    big = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_size).select(key), "big")
    one = rows if parents is None else rows.unionByName(parents, allowMissingColumns=True)
    one = one if "_parent" in one.columns else one.withColumn("_parent", F.lit(None).cast("string"))
    some = not big.isEmpty()
    ordinary = one.join(big, key, "left_anti") if some else one
    grouped = ordinary.groupBy(key).agg(F.collect_list("_parent").alias("_parents"), *[F.sort_array(F.collect_list(n)).alias(n) for n in lists])
    if not some:
        return grouped
    placed = numbered(rows.join(big, key, "left_semi").select(key, *lists), [key], list(lists))
    block = F.floor(F.col("row_index") / block_size).alias("_block")
    blocks = placed.groupBy(key, block).agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in lists])

    def joined(name: str) -> Column:
        in_order = F.sort_array(F.collect_list(F.struct("_block", name)))
        return F.flatten(F.transform(in_order, lambda b: b[name])).alias(name)

    whole = blocks.groupBy(key).agg(*[joined(n) for n in lists])
    if parents is None:
        whole = whole.withColumn("_parents", F.array().cast("array<string>"))
    else:
        whole = whole.join(parents.groupBy(key).agg(F.collect_list("_parent").alias("_parents")), key)
    return grouped.unionByName(whole.select(key, "_parents", *lists))


def nest(parents: DataFrame, children: Mapping[str, DataFrame], key: str, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``key, parent, <child lists>, n_<child>``; one shuffle nests every family.

    ``children`` maps a list name to a frame of ``key`` + fields; a list is sorted by the column
    ``_order`` where the frame has one, then by the fields in order. Children without a parent stay out, parents
    without children get empty lists, and a duplicated parent row gives a duplicated record.
    """
    tagged = None
    for name, frame in children.items():
        fields = [c for c in frame.columns if c not in (key, ORDER)]
        first = F.col(ORDER) if ORDER in frame.columns else F.lit(0)
        rows = frame.select(key, F.struct(first.alias(ORDER), F.struct(*fields).alias("row")).alias(name))
        tagged = rows if tagged is None else tagged.unionByName(rows, allowMissingColumns=True)
    records = parents.select(key, F.struct(*parents.columns).alias("_parent"))
    lists = {n: F.col(n)["row"].alias(n) for n in children}
    return collected(tagged, key, list(children), block_size, records).select(
        key, F.explode("_parents").alias("parent"), *lists.values(), *[F.size(n).cast("bigint").alias(f"n_{n}") for n in children]
    )


def opportunity_enrich(
    deals: DataFrame, connections: DataFrame, reviews: DataFrame, closes: DataFrame, block_size: int = BLOCK_SIZE
) -> DataFrame:
    """Deals with their connections, reviews and close rows."""
    return nest(deals, {"connections": connections, "reviews": reviews, "close": closes}, "deal_id", block_size)


def enriched_deals(enriched: DataFrame) -> DataFrame:
    """The deals of ``opportunity_enrich`` as children of an account: their own fields, then their lists."""
    kept = [f for f in enriched.schema["parent"].dataType.names]
    return enriched.select(*[F.col(f"parent.{f}").alias(f) for f in kept], "connections", "reviews", "close")


def clean_texts(deals: DataFrame) -> DataFrame:
    """Deals with the mark-up of their free texts removed."""
    texts = [c for c in ("description", "detail_reasons") if c in deals.columns]
    return deals.withColumns({c: strip_html(F.col(c)) for c in texts}) if texts else deals


def keyed(accounts: DataFrame) -> DataFrame:
    """Accounts without a blank key."""
    return accounts.where(F.trim(F.col("account_id").cast("string")) != "")


def account_nest(
    accounts: DataFrame,
    contacts: DataFrame,
    deals: DataFrame,
    activities: DataFrame,
    notes: DataFrame,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """One record per account with contacts, deals, activities and notes; blank keys are left out.

    Deals may carry lists of their own (``enriched_deals``).
    """
    return nest(
        keyed(accounts),
        {"contacts": contacts, "deals": clean_texts(deals), "activities": activities, "notes": notes},
        "account_id",
        block_size,
    )


def text_blocks(rows: DataFrame, by: str, order: Sequence[Column], line: Column, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``by, at, text``: the lines of each group along ``order`` (equal ones by their text), in blocks of at most ``block_size``.

    The rows are range-partitioned and sorted, so a group of any size lies in many tasks and each block in one;
    ``at`` ascends with the blocks of a group.
    """
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    sorting = [by, *[f"_o{i}" for i in range(len(named))]]
    ranged = rows.select(by, *named, line.alias("_line")).repartitionByRange(*sorting).sortWithinPartitions(*sorting, "_line")
    placed = ranged.select(by, F.monotonically_increasing_id().alias("_id"), "_line")
    at = (F.col("_id") - F.col("_id") % block_size).alias("at")
    in_order = F.sort_array(F.collect_list(F.struct("_id", "_line")))
    return placed.groupBy(by, at).agg(F.array_join(in_order["_line"], "").alias("text"))


def grouped_items(rows: DataFrame, by: str, item_key: str, item: Column, stats: Sequence[Column], block_size: int) -> DataFrame:
    """Per group its items in the order of their keys, and the ``stats`` over the whole group."""
    totals = rows.groupBy(by).agg(*stats)
    lists = collected(rows.select(by, F.struct(F.col(item_key).alias("_id"), item.alias("_item")).alias("items")), by, ["items"], block_size)
    return totals.join(lists.select(by, F.transform("items", lambda x: x["_item"]).alias("items")), by)
