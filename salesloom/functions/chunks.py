"""Section-aware chunking with overlap, closed form, without a shuffle.

The rule is a fold: every chunk starts with the last ``overlap`` tokens before it, and a
section whose text is then longer than ``size`` is cut into windows. When ``size`` is at
least twice ``overlap`` the carried tokens are always the document's own tokens just before
the section, so section *i* over tokens ``[s, e)`` has the text ``[max(0, s - overlap), e)``.
One document is one row; all arrays below stay inside that row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.text import collapse_edges, content_hash, let


def split_tokens(col: Column) -> Column:
    """White-space tokens that keep the space behind them, so joining gives the text back."""
    return F.regexp_extract_all(col, F.lit(r"\S+\s*"), F.lit(0))


def count_tokens(col: Column) -> Column:
    return F.size(split_tokens(F.coalesce(col, F.lit(""))))


def split_sections(col: Column) -> Column:
    """Split before each second-level heading; trimmed, empty parts dropped, whole text if none is left."""
    parts = F.filter(F.transform(F.split(col, r"(?m)^(?=##\s)"), collapse_edges), lambda p: p != "")
    return let(parts, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(col)))


def window_spans(length: Column, size: int, overlap: int) -> Column:
    """``(start, length)`` of each window over ``length`` tokens; the last one ends at the end."""
    step = size - overlap if size > overlap else size
    back = overlap if size > overlap else 0
    starts = F.sequence(F.lit(0), F.greatest(length - back - 1, F.lit(0)), F.lit(step))
    return F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size), length - s).alias("length"))
    )


def chunk_document(
    docs: DataFrame,
    key: str,
    text: str,
    size: int = 800,
    overlap: int = 100,
    tokenizer: Callable[[Column], Column] = split_tokens,
) -> DataFrame:
    """``key, chunk_seq, content, md_hash`` for every document."""
    if size < 2 * overlap:
        raise ValueError("size must be at least twice the overlap")

    def cut(sections: Column) -> Column:
        # the tokens of the whole document, each with the number of its section
        tagged = F.flatten(
            F.transform(sections, lambda s, i: F.transform(tokenizer(F.concat(s, F.lit("\n"))), lambda t: F.struct(i.alias("section"), t.alias("token"))))
        )
        return let(tagged, lambda words: let(_starts(words), lambda starts: let(words["token"], lambda tokens: _texts(tokens, _spans(starts, F.size(tokens))))))

    def _starts(words: Column) -> Column:
        """Where each section begins: the places at which the number of the section changes."""
        first = F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1)["section"] != w["section"]), i))
        return F.filter(first, lambda i: i.isNotNull())

    def _spans(starts: Column, size_of_all: Column) -> Column:
        """(section start - overlap, section end) in tokens of the document, one per section; one empty span without any token."""
        spans = F.transform(
            starts, lambda s, k: F.struct(F.greatest(s - overlap, F.lit(0)).alias("low"), F.coalesce(F.get(starts, k + 1), size_of_all).alias("high"))
        )
        return F.when(F.size(starts) > 0, spans).otherwise(F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))))

    def _texts(words: Column, spans: Column) -> Column:
        windows = F.flatten(
            F.transform(
                spans,
                lambda s: F.transform(
                    window_spans(s["high"] - s["low"], size, overlap),
                    lambda w: F.struct((s["low"] + w["start"]).alias("start"), w["length"].alias("length")),
                ),
            )
        )
        return F.transform(windows, lambda w: _text(words, w["start"], w["length"]))

    return docs.select(
        key, F.posexplode(let(split_sections(F.coalesce(F.col(text), F.lit(""))), cut)).alias("chunk_seq", "content")
    ).withColumn("md_hash", content_hash(F.col("content")))


def _text(words: Column, start: Column, length: Column) -> Column:
    return collapse_edges(F.array_join(F.slice(words, start + 1, length), ""))


def sliding_windows(docs: DataFrame, key: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Plain windows over the whole text, without sections: ``key, window_seq, first_token, n_tokens, content``."""

    def windows(words: Column) -> Column:
        return F.transform(
            window_spans(F.size(words), size, overlap),
            lambda w: F.struct(
                w["start"].alias("first_token"),
                w["length"].alias("n_tokens"),
                _text(words, w["start"], w["length"]).alias("content"),
            ),
        )

    rows = docs.where(F.col(text).rlike(r"\S"))
    return rows.select(key, F.posexplode(let(split_tokens(F.col(text)), windows)).alias("window_seq", "_w")).select(
        key, "window_seq", "_w.*"
    )
