"""Markdown documents rendered from nested records with column expressions.

One nested record gives one document. The time of rendering is not part of the body, so an unchanged
record keeps its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from salesloom.functions.text import content_hash, slugify, strip_html
from salesloom.functions.values import join_nonempty
from salesloom.operators.lenses import industry_rows, salesperson_rows, seller_activities, solution_rows
from salesloom.operators.nest import BLOCK_SIZE, ORDER, clean_texts, keyed, nest, text_blocks

# The layout of the documents.
DASH = "—"
NONE = "_(none)_\n"


def _fields(df: DataFrame, name: str) -> set[str]:
    kind = df.schema[name].dataType
    if isinstance(kind, ArrayType):
        kind = kind.elementType
    return set(kind.names) if isinstance(kind, StructType) else set()


def _get(row: Column, known: set[str], name: str, default: str = "") -> Column:
    """A field as text; ``default`` only where the record has no such field or no value."""
    return F.coalesce(row[name].cast("string"), F.lit(default)) if name in known else F.lit(default)


def _say(before: str, value: Column, after: str = "") -> Column:
    """The phrase around a value, nothing around an empty one."""
    return F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "")


def _section(title: str, total: Column, lines: Column) -> Column:
    """Heading with the count, then the entries."""
    body = F.when(total > 0, lines).otherwise(NONE)
    return _text("## ", title, " (", total.cast("string"), ")\n", body)


def _finish(df: DataFrame, key: Column, folder: str, body: Column) -> DataFrame:
    return (
        df.withColumn("_body", body)
        .select(key.cast("string").alias("doc_key"), F.concat(F.lit(f"{folder}/"), key.cast("string"), F.lit(".md")).alias("path"), F.col("_body").alias("body"))
        .withColumn("md_hash", content_hash(F.col("body"), 16))
    )


def _contact_line(c: Column, known: set[str]) -> Column:
    extras = F.filter(F.array(_get(c, known, "email"), _get(c, known, "mobile")), lambda x: x != "")
    tail = F.when(F.size(extras) > 0, F.concat(F.lit(" | "), F.array_join(extras, " | "))).otherwise("")
    return _text("- **", _get(c, known, "contact_name"), "** — ", _get(c, known, "job_title"), tail, "\n")


def _deal_line(o: Column, known: set[str]) -> Column:
    def at(field: str, default: str = "") -> Column:
        return _get(o, known, field, default)

    roles = F.lit("")
    if "connections" in known:
        names = F.filter(F.transform(o["connections"], lambda c: c["role"]), lambda r: r != "")
        roles = F.when(F.size(o["connections"]) > 0, _text("  Stakeholders: ", F.array_join(names, ", "), "\n")).otherwise("")
    closed = F.lit("")
    if "close" in known:
        first = F.get(o["close"], F.lit(0))
        closed = F.when(
            F.coalesce(first["reason"], F.lit("")) != "",
            _text("  Closed: ", first["reason"], " | Date: ", F.coalesce(first["close_date"].cast("string"), F.lit(DASH)), "\n"),
        ).otherwise("")
    return _text(
        "- **", at("deal_name"), "** — ", at("status"), " | Possibility: ", at("possibility", DASH), "%\n",
        "  Est. Close: ", at("est_close", DASH), " | SO Plan: ", at("plan_amount", DASH),
        _say(" | Solution: ", at("solution")), _say(" | Sales: ", at("person")), "\n",
        _say("  Description: ", at("description"), "\n"), _say("  Reason: ", at("detail_reasons"), "\n"),
        roles, closed,
    )


def _activity_line(a: Column, known: set[str]) -> Column:
    return _text(
        "- **", _get(a, known, "activity_date"), "** — ", _get(a, known, "subject"),
        " (", _get(a, known, "activity_type"), ") — ", _get(a, known, "state"), "\n",
    )


def _note_line(n: Column, known: set[str]) -> Column:
    return _text("**", _get(n, known, "title"), "** (", _get(n, known, "note_date"), ")\n", _get(n, known, "body"), "\n\n")


ACCOUNT_LINES = {"contacts": _contact_line, "deals": _deal_line, "activities": _activity_line, "notes": _note_line}


def render_account_doc(records: DataFrame) -> DataFrame:
    """``account/{id}.md`` from ``account_nest`` rows."""

    def lines(name: str) -> Column:
        known = _fields(records, name)
        return _lines(F.col(name), lambda x: ACCOUNT_LINES[name](x, known))

    return _account_doc(records, {name: lines(name) for name in ACCOUNT_LINES})


def account_docs(
    accounts: DataFrame, contacts: DataFrame, deals: DataFrame, activities: DataFrame, notes: DataFrame, block_size: int = BLOCK_SIZE
) -> DataFrame:
    """The documents of ``render_account_doc`` from the frames of ``account_nest``: every child is made a line before it travels.

    The lines of a list are in the order of ``_order`` where its frame has one, then of the first field, then of their text.
    """
    frames = {"contacts": contacts, "deals": clean_texts(deals), "activities": activities, "notes": notes}
    lined = {}
    for name, frame in frames.items():
        fields = [c for c in frame.columns if c not in ("account_id", ORDER)]
        line = ACCOUNT_LINES[name](F.struct(*fields), set(fields)).alias("_line")
        lined[name] = frame.select(*[c for c in ("account_id", ORDER) if c in frame.columns], F.col(fields[0]).alias("_id"), line)
    records = nest(keyed(accounts), lined, "account_id", block_size)
    return _account_doc(records, {n: F.array_join(F.col(n)["_line"], "") for n in lined})


def _account_doc(records: DataFrame, lines: dict[str, Column]) -> DataFrame:
    has = _fields(records, "parent")
    parent = F.col("parent")

    def of(name: str, default: str = "") -> Column:
        return _get(parent, has, name, default)

    ident, name = of("account_id"), of("account_name")
    labels = [
        ("Customer Code", "customer_code"),
        ("Industry", "industry"),
        ("Customer Type", "customer_type"),
        ("Account Status", "account_status"),
        ("Annual Revenue", "annual_revenue"),
        ("No. of Employees", "employees"),
    ]
    facts = [_text(f"**{label}:** ", of(field, DASH), "\n") for label, field in labels]
    place = join_nonempty([of("city"), of("province"), of("country")], ", ", DASH)
    head = _text(
        "---\nentity: account\naccount_id: ", ident, "\nname: ", name, "\nindustry: ", of("industry"),
        "\nstatus: ", of("account_status"), "\n---\n\n# ", of("account_name", "(no name)"), "\n\n",
        *facts, "**Location:** ", place, "\n**Website:** ", of("website", DASH), "\n\n",
    )
    notes = F.when(F.col("n_notes") > 0, _text("\n## Notes (", F.col("n_notes").cast("string"), ")\n", lines["notes"])).otherwise("")
    body = _text(
        head,
        _section("Contacts", F.col("n_contacts"), lines["contacts"]), "\n",
        _section("Opportunities", F.col("n_deals"), lines["deals"]), "\n",
        _section("Recent Activities", F.col("n_activities"), lines["activities"]),
        notes,
    )
    return _finish(records, ident, "account", body)


def _lens_head(kind: str, value: Column) -> Column:
    return _text(f"---\nentity: {kind}\n{kind}: ", value, f"\n---\n\n# {kind.capitalize()}: ", value, "\n\n")


def _assembled(sections: list[DataFrame], by: str, folder: str) -> DataFrame:
    """Documents from the pieces of their sections (``by, at, text``), joined section by section along ``at``."""
    whole = None
    for i, section in enumerate(sections):
        pieces = section.select(by, F.lit(i).alias("section"), "at", "text")
        whole = pieces if whole is None else whole.unionByName(pieces)
    in_order = F.sort_array(F.collect_list(F.struct("section", "at", "text")))
    bodies = whole.groupBy(by).agg(F.array_join(in_order["text"], "").alias("_joined"))
    return _finish(bodies, slugify(F.col(by)), folder, F.col("_joined"))


def _shown(rows: DataFrame, item: Column) -> set[str]:
    return _fields(rows.select(item.alias("item")), "item")


def _piece(rows: DataFrame, by: str, text: Column) -> DataFrame:
    """A section of one piece."""
    return rows.select(by, F.lit(0).cast("bigint").alias("at"), text.alias("text"))


def _solution_head() -> Column:
    return _text(
        _lens_head("solution", F.col("solution")),
        "**Deals:** ", F.col("deal_count").cast("string"), " across ", F.col("account_count").cast("string"), " accounts\n\n",
    )


def _solution_line(d: Column, known: set[str]) -> Column:
    return _text(
        "- **", _get(d, known, "account_name"), "** — ", _get(d, known, "deal_name"), " (", _get(d, known, "status"),
        ") | Possibility: ", _get(d, known, "possibility", DASH), "%", _say(" | Sales: ", _get(d, known, "person")), "\n",
        _say("  ", _get(d, known, "description"), "\n"), _say("  Reason: ", _get(d, known, "detail_reasons"), "\n"),
    )


def render_solution_doc(lens: DataFrame) -> DataFrame:
    known = _fields(lens, "deals")
    body = _text(_solution_head(), _lines(F.col("deals"), lambda d: _solution_line(d, known)))
    return _finish(lens, F.col("key"), "solution", body)


def solution_docs(deals: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The documents of ``render_solution_doc`` from the rows of ``lens_solution``, gathered as text in blocks."""
    rows, item, stats = solution_rows(deals)
    heads = _piece(rows.groupBy("solution").agg(*stats), "solution", _solution_head())
    lines = text_blocks(rows, "solution", [F.col("deal_id")], _solution_line(item, _shown(rows, item)), block_size)
    return _assembled([heads, lines], "solution", "solution")


def _salesperson_head() -> Column:
    return _text(
        _lens_head("salesperson", F.col("person")),
        "**Accounts:** ", F.col("account_count").cast("string"), " | **Deals:** ", F.col("deal_count").cast("string"), "\n\n",
        "## Deals\n",
    )


def _salesperson_line(d: Column, known: set[str]) -> Column:
    return _text(
        "- **", _get(d, known, "account_name"), "** — ", _get(d, known, "deal_name"), " (", _get(d, known, "status"), ")",
        _say(" | ", _get(d, known, "solution")), " | Est. Close: ", _get(d, known, "est_close", DASH), "\n",
        _say("  ", _get(d, known, "description"), "\n"),
    )


def render_salesperson_doc(lens: DataFrame) -> DataFrame:
    known, acts = _fields(lens, "deals"), _fields(lens, "activities")
    count = F.size("activities").cast("bigint")
    body = _text(
        _salesperson_head(), _lines(F.col("deals"), lambda d: _salesperson_line(d, known)), "\n",
        _section("Recent Activities", count, _lines(F.col("activities"), lambda a: _activity_line(a, acts))),
    )
    return _finish(lens, F.col("key"), "salesperson", body)


def salesperson_docs(deals: DataFrame, activities: DataFrame, recent: int | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The documents of ``render_salesperson_doc`` from the rows of ``lens_salesperson``, gathered as text in blocks."""
    rows, item, stats = salesperson_rows(deals)
    totals = rows.groupBy("person").agg(*stats)
    lines = text_blocks(rows, "person", [F.col("deal_id")], _salesperson_line(item, _shown(rows, item)), block_size)
    shown, order, row = seller_activities(rows, activities, recent)
    entry = _activity_line(row, _shown(shown, row))
    count, few = F.count(F.lit(1)).alias("_n"), recent is not None and recent <= block_size
    entries = F.array_join(F.sort_array(F.collect_list(F.struct(*order, entry.alias("_line"))))["_line"], "") if few else F.lit("")
    counts = totals.join(shown.groupBy("person").agg(count, entries.alias("_entries")), "person", "left")
    titles = _piece(counts, "person", _text("\n", _section("Recent Activities", F.coalesce("_n", F.lit(0)), F.col("_entries"))))
    more = [] if few else [text_blocks(shown, "person", order, entry, block_size)]
    return _assembled([_piece(totals, "person", _salesperson_head()), lines, titles, *more], "person", "salesperson")


def _industry_head() -> Column:
    return _text(_lens_head("industry", F.col("industry")), "**Accounts:** ", F.col("account_count").cast("string"), "\n\n")


def _industry_line(a: Column, known: set[str]) -> Column:
    return _text(
        "- **", _get(a, known, "account_name"), "**", _say(" (", _get(a, known, "customer_type"), ")"),
        _say(" — ", _get(a, known, "location")), " | Opps: ", _get(a, known, "opp_count"),
        _say(" | Solutions: ", F.array_join(a["solutions"], ", ")), "\n",
    )


def render_industry_doc(lens: DataFrame) -> DataFrame:
    known = _fields(lens, "accounts")
    body = _text(_industry_head(), _lines(F.col("accounts"), lambda a: _industry_line(a, known)))
    return _finish(lens, F.col("key"), "industry", body)


def industry_docs(accounts: DataFrame, deals: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The documents of ``render_industry_doc`` from the rows of ``lens_industry``, gathered as text in blocks."""
    rows, item, stats = industry_rows(accounts, deals)
    heads = _piece(rows.groupBy("industry").agg(*stats), "industry", _industry_head())
    lines = text_blocks(rows, "industry", [F.col("account_id")], _industry_line(item, _shown(rows, item)), block_size)
    return _assembled([heads, lines], "industry", "industry")


def clean_notes(notes: DataFrame, closed_only: bool = False) -> DataFrame:
    """Notes without blank bodies, mark-up removed (``closed_only``: see ``strip_html``)."""
    return notes.where(F.trim("body") != "").withColumn("body", strip_html(F.col("body"), closed_only))


def doc_path(folder: str, name: Column) -> Column:
    """``{folder}/{slug}.md``."""
    return F.concat(F.lit(f"{folder}/"), slugify(name), F.lit(".md"))


def corpus_union(**kinds: DataFrame) -> DataFrame:
    """All rendered documents as one index with their type."""
    whole = None
    for kind, docs in kinds.items():
        rows = docs.withColumn("doc_type", F.lit(kind))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole
