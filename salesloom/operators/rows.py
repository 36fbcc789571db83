"""Row-level operators of the ingest step: projection, dedup, snapshots, unions, links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.session import materialize


def entity_project(df: DataFrame, mapping: Mapping[str, str], where: Column | None = None) -> DataFrame:
    """``{wanted name: source column}``, order kept; an absent source column becomes ``""``."""
    source = df if where is None else df.where(where)
    return source.select(
        *[(F.col(f"`{src}`") if src in df.columns else F.lit("")).alias(name) for name, src in mapping.items()]
    )


def dedup_keep_last(df: DataFrame, pk: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """One row per key: the last in ``order_by`` (a total order).

    Spark plans ``row_number() = 1`` with a group limit below the shuffle, so a key that
    holds a third of the rows still sends one row per partition.
    """
    newest_first = Window.partitionBy(*pk).orderBy(*[c.desc() for c in order_by])
    return df.withColumn("_rn", F.row_number().over(newest_first)).where("_rn = 1").drop("_rn")


def latest_snapshot(df: DataFrame, part: str, snap: str) -> DataFrame:
    """All rows of the newest snapshot of each part.

    The maximum is a partial aggregation with one row per part, written down so that Spark
    knows its size before it plans the semi join; a short list is broadcast and the rows stay
    where they are, so a part holding most rows is never gathered.
    """
    newest = materialize(df.groupBy(part).agg(F.max(snap).alias(snap)), "newest")
    return df.join(newest, [part, snap], "left_semi")


def union_parts(*frames: DataFrame) -> DataFrame:
    """Concatenate parts by column name; a column a part lacks becomes null."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def derive_account_link(
    child: DataFrame, deals: DataFrame, out_col: str = "account_id", order_by: Sequence[Column] | None = None
) -> DataFrame:
    """child -> deal -> account key as text, ``""`` where the deal is unknown.

    ``order_by`` says which of several rows of one deal is the last; without it ``deals``
    must hold each deal once. The lookup must not multiply child rows.
    """
    lookup = deals.select("deal_id", F.col("account_id").alias("_link"), *[c.alias(f"_o{i}") for i, c in enumerate(order_by or [])])
    if order_by:
        lookup = dedup_keep_last(lookup, ["deal_id"], [F.col(f"_o{i}") for i in range(len(order_by))])
    lookup = lookup.select("deal_id", "_link")
    linked = child.join(lookup, "deal_id", "left")
    return linked.withColumn(out_col, F.coalesce(F.col("_link").cast("string"), F.lit(""))).drop("_link")


def resolve_name(ids: DataFrame, key: str, dim: DataFrame, primary: DataFrame, heuristic: DataFrame) -> DataFrame:
    """id -> name through three lookups in turn, with the source that answered.

    Each lookup is ``(id, name)``; keys match without regard to case, blank names do not count.
    The lookups become one table first (best source wins), so the ids are joined once.
    """
    ranked = [
        lookup.select(F.upper(F.col("id").cast("string")).alias("_key"), "name", F.lit(rank).alias("_rank"), F.lit(label).alias("source"))
        for rank, (label, lookup) in enumerate((("dim", dim), ("primary", primary), ("heuristic", heuristic)))
    ]
    chain = (
        union_parts(*ranked)
        .where(F.coalesce(F.col("name"), F.lit("")) != "")
        .groupBy("_key")
        .agg(F.min(F.struct("_rank", "name", "source")).alias("_hit"))
    )
    return (
        ids.withColumn("_key", F.upper(F.col(key).cast("string")))
        .join(chain, "_key", "left")
        .select(*[F.col(c) for c in ids.columns], F.col("_hit.name").alias("name"), F.col("_hit.source").alias("source"))
    )


def resolve_or_id(resolved: DataFrame, key: str) -> DataFrame:
    return resolved.withColumn("name", F.coalesce("name", F.coalesce(F.col(key).cast("string"), F.lit(""))))


def id_filter(df: DataFrame, key: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose key is listed; a ``.md`` at the end does not matter on either side."""
    from salesloom.functions.values import strip_suffix

    wanted = ids.select(strip_suffix(F.col(id_col).cast("string")).alias("_id")).distinct()
    return df.withColumn("_id", strip_suffix(F.col(key).cast("string"))).join(wanted, "_id", "left_semi").drop("_id")
