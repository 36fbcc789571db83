"""Audits of results, questions and logged query texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.operators import audit
from salesloom.plans.registry import query
from salesloom.plans.shapes import sql_rate, whole

# The questions of these tables are invented prose, so frequent words of theirs stand in for
# the cue lists; the lists themselves are tested on hand-made questions.
QUANT, QUAL = ("the", "con"), ("les", "und")
NOUNS, CUES = ("that", "que"), ("with", "para")


def user_turns(r):
    return r.table("conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")


def _any_like(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query(
    "audit_empty",
    """
SELECT 'cancelled' AS result, NOT coalesce(bool_or(deal_id IS NOT NULL), false) AS is_empty FROM deal_core WHERE status = 'Cancelled'
UNION ALL SELECT 'blank', NOT coalesce(bool_or(coalesce(website, '') <> ''), false) FROM (SELECT '' AS website FROM customer)
UNION ALL SELECT 'zero', NOT coalesce(bool_or(z IS NOT NULL), false) FROM (SELECT 0 AS z FROM customer)
UNION ALL SELECT 'deals', NOT coalesce(bool_or(deal_id IS NOT NULL), false) FROM deal_core""",
)
def _(r):
    customers = r.table("customer")
    cases = {
        "cancelled": r.deal_core.where(F.col("status") == "Cancelled"),
        "blank": customers.select(F.lit("").alias("website"), F.lit(None).cast("double").alias("revenue")),
        "zero": customers.select(F.lit(0).alias("z")),
        "deals": r.deal_core,
    }
    whole_list = None
    for name, result in cases.items():
        row = audit.audit_empty(result).select(F.lit(name).alias("result"), "is_empty")
        whole_list = row if whole_list is None else whole_list.unionByName(row)
    return whole_list


@query(
    "audit_plausible",
    f"""
SELECT * FROM (
  SELECT 'won_ratio' AS "column", {sql_rate('max(w)', 'highest')}, 'over 1' AS finding FROM rates HAVING max(w) > 1
  UNION ALL SELECT 'margin_percent', round(CAST(max(m) AS DOUBLE), 6), 'over 100 percent' FROM rates HAVING max(m) > 100
  UNION ALL SELECT 'win_rate', round(CAST(max(r) AS DOUBLE), 6), 'over 1' FROM rates HAVING max(r) > 1)""",
    rates="""
  SELECT account_id, count(*) FILTER (status = 'Won') / nullif(count(*) FILTER (status = 'Lost'), 0) AS w,
         count(*) FILTER (status = 'Won') / count(*) AS r, 100.0 * max(possibility) / min(possibility) AS m
  FROM deal_core GROUP BY 1""",
)
def _(r):
    won, lost, total = F.count_if(F.col("status") == "Won"), F.count_if(F.col("status") == "Lost"), F.count(F.lit(1))
    rates = r.deal_core.groupBy("account_id").agg(
        F.round(F.try_divide(won, lost), 6).alias("won_ratio"),
        F.try_divide(won, total).alias("win_rate"),
        F.round(F.try_divide(100.0 * F.max("possibility"), F.min("possibility")), 6).alias("margin_percent"),
    )
    return audit.audit_plausible(rates)


@query(
    "audit_flag_mismatch",
    "SELECT status, count(*) AS rows FROM deal_core WHERE possibility = 90 AND status <> 'Won' GROUP BY 1",
)
def _(r):
    return audit.audit_flag_mismatch(r.deal_core, F.col("possibility") == 90)


@query(
    "tag_intent",
    f"""
SELECT conv_id, turn, CASE WHEN turn = 2 THEN 'quant' WHEN trim(text) = '' THEN 'qual' WHEN {_any_like(QUANT)} AND NOT {_any_like(QUAL)} THEN 'quant'
       WHEN {_any_like(QUAL)} AND NOT {_any_like(QUANT)} THEN 'qual' ELSE 'hybrid' END AS intent
FROM conversations WHERE role = 'user'""",
)
def _(r):
    forced = F.when(F.col("turn") == 2, "quant").when(F.col("turn") == 3, "nonsense")
    return user_turns(r).select("conv_id", "turn", audit.tag_intent(F.col("text"), forced, QUANT, QUAL).alias("intent"))


@query(
    "tag_ambiguous",
    """
SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(the|que)([^\\p{L}\\p{N}_]|$)') AS ambiguous FROM conversations WHERE role = 'user'""",
)
def _(r):
    return user_turns(r).select("conv_id", "turn", audit.tag_ambiguous(F.col("text"), ("the", "que")).alias("ambiguous"))


@query(
    "tag_state_over_time",
    f"""
SELECT conv_id, turn, ({_any_like(NOUNS)} AND {_any_like(CUES)}) OR regexp_matches(text, '(?i)(on|de)\\s+(the|la)\\s') AS flagged
FROM conversations WHERE role = 'user'""",
)
def _(r):
    flagged = audit.tag_state_over_time(F.col("text"), NOUNS, CUES, r"(?i)(on|de)\s+(the|la)\s")
    return user_turns(r).select("conv_id", "turn", flagged.alias("flagged"))


@query(
    "tag_subject",
    """
SELECT conv_id, turn, coalesce(regexp_replace(regexp_replace(
         list_filter(regexp_split_to_array(text, '\\s+'), lambda t: contains(lower(t), hint))[1], '^[.,?!:;''"]+', ''), '[.,?!:;''"]+$', ''), hint) AS subject
FROM (SELECT *, CASE WHEN contains(lower(text), 'tion') THEN 'tion' WHEN contains(lower(text), 'ment') THEN 'ment' WHEN contains(lower(text), 'der') THEN 'der' END AS hint
      FROM conversations WHERE role = 'user')""",
)
def _(r):
    subject = audit.tag_subject(F.col("text"), ("tion", "ment", "der"))
    return user_turns(r).select("conv_id", "turn", subject.alias("subject"))


# One logged query text per deal, each with what its deal is about.
LOG_SQL = """
  SELECT deal_id, CASE deal_id % 4
    WHEN 0 THEN 'EVALUATE FILTER(Fact_Opportunity, Fact_Opportunity[Status] = "' || status || '" && YEAR(Fact_Opportunity[Created]) = ' || year(created) || ')'
    WHEN 1 THEN 'EVALUATE ROW("a", CALCULATE([Total SO Plan Amount (P)], Fact_Opportunity[Possibility] >= ' || possibility || '))'
    WHEN 2 THEN 'EVALUATE Fact_Opportunity'
    ELSE 'EVALUATE SUMMARIZECOLUMNS(Dim_Region[Name], Fact_Project_Expenses[IsWon] = TRUE)' END AS text
  FROM deal_core"""


def query_log(r):
    status, year, possibility = F.col("status"), F.year("created").cast("string"), F.col("possibility").cast("string")
    kind = F.col("deal_id") % 4
    text = (
        F.when(
            kind == 0,
            F.concat(
                F.lit('EVALUATE FILTER(Fact_Opportunity, Fact_Opportunity[Status] = "'), status,
                F.lit('" && YEAR(Fact_Opportunity[Created]) = '), year, F.lit(")"),
            ),
        )
        .when(
            kind == 1,
            F.concat(F.lit('EVALUATE ROW("a", CALCULATE([Total SO Plan Amount (P)], Fact_Opportunity[Possibility] >= '), possibility, F.lit("))")),
        )
        .when(kind == 2, "EVALUATE Fact_Opportunity")
        .otherwise("EVALUATE SUMMARIZECOLUMNS(Dim_Region[Name], Fact_Project_Expenses[IsWon] = TRUE)")
    )
    return r.deal_core.select("deal_id", text.alias("text"))


@query(
    "audit_query_log",
    """
SELECT deal_id, 'filter' AS kind, 'Status = ' || regexp_extract(text, 'Status\\] = "(\\w+)"', 1) AS finding FROM log WHERE deal_id % 4 = 0
UNION ALL SELECT deal_id, 'filter', 'Year = ' || regexp_extract(text, '(\\d{4})', 1) FROM log WHERE deal_id % 4 = 0
UNION ALL SELECT deal_id, 'filter', 'Possibility >= ' || regexp_extract(text, '>= (\\d+)', 1) FROM log WHERE deal_id % 4 = 1
UNION ALL SELECT deal_id, 'concept', unnest(['Total SO Plan Amount', 'Possibility']) FROM log WHERE deal_id % 4 = 1
UNION ALL SELECT deal_id, 'issue', 'bare dump of Fact_Opportunity' FROM log WHERE deal_id % 4 = 2
UNION ALL SELECT deal_id, 'issue', unnest(['table Fact_Project_Expenses is not in the model', 'flag compared to TRUE/FALSE', 'unknown table(s): Dim_Region'])
          FROM log WHERE deal_id % 4 = 3""",
    log=LOG_SQL,
)
def _(r):
    return audit.audit_query_log(query_log(r), "deal_id", "text")


# Questions and texts of twenty more forms, by the deal: what a question adds to a text's findings.
FORMS = (
    # question, query text, filters, concepts, issues, then whether: raw sum, state over time, ambiguous word
    ("pipeline week over week", 'EVALUATE ROW("p", [Card_Pipeline])', [], ["Card_Pipeline"], [], "-s-"),
    ("sales of Kim", 'EVALUATE CALCULATETABLE(Fact_Opportunity, SEARCH("Kim", Fact_Opportunity[Sale Person Name], 1, 0) > 0)', ['Sale Person ~ "Kim"'], [], [], "--a"),
    ("revenue this year", "EVALUATE ROW(\"r\", SUM(Fact_Opportunity[SO Actual Amount]))", [], ["SO Actual Amount"], [], "r-a"),
    ("revenue target", 'EVALUATE ROW("t", [Total Target Amount])', [], ["Total Target Amount"], [], "--a"),
    ("how many deals", "DEFINE MEASURE Fact_Opportunity[x] = 1", [], [], ["DEFINE block"], "---"),
    ("deals from Open to Lost", "EVALUATE Dim_Account", [], [], ["bare dump of Dim_Account"], "-s-"),
    ("list", "DROP TABLE Fact_Opportunity", [], [], ["data-changing keyword"], "---"),
    ("hot deals", "EVALUATE FILTER(Fact_Opportunity, Fact_Opportunity[Possibility] < 90)", ["Possibility < 90"], ["Possibility"], [], "---"),
    ("turnover by month", "EVALUATE FILTER(Dim_Date, MONTH(Dim_Date[Date]) = 5 || MONTH(Dim_Date[Date]) = 6)", ["Month = 5, 6"], [], [], "--a"),
    ("ยอดขายเดือนนี้", 'EVALUATE ROW("a", [Total SO Actual Amount (P) by Person])', [], ["Total SO Actual Amount (P) by Person"], [], "--a"),
    ("win rate", 'EVALUATE ROW("w", [Card_WinRate])', [], ["Card_WinRate"], [], "---"),
    ("won or lost", 'EVALUATE FILTER(Fact_Opportunity, Fact_Opportunity[Status] IN {"Won", "Lost"})', ["Status = Won, Lost"], [], [], "---"),
    ("won", "EVALUATE FILTER(Fact_Opportunity, Fact_Opportunity[IsWon] = 1)", ["Status = Won (IsWon=1)"], [], [], "---"),
    ("open", "EVALUATE FILTER(Fact_Opportunity, Fact_Opportunity[IsPipeline] = 1)", ["Status = Open (IsPipeline=1)"], [], [], "---"),
    ("by solution", 'EVALUATE FILTER(Dim_Solution, Dim_Solution[Solution Name] = "MES")', ["Solution = MES"], [], [], "---"),
    ("year", "EVALUATE FILTER(Dim_Date, Dim_Date[Year] = 2026)", ["Year = 2026"], [], [], "---"),
    ("allocation", "EVALUATE FILTER(Dim_Allocation, Dim_Allocation[x] > 1)", [], [], ["table Dim_Allocation is not in the model"], "---"),
    ("month", "EVALUATE VALUES(Dim_Date[YearMonth])", [], [], ["column [YearMonth] does not exist"], "---"),
    ("elsewhere", "EVALUATE VALUES(Dim_Made_Up[a])", [], [], ["unknown table(s): Dim_Made_Up"], "---"),
    ("target met", 'EVALUATE ROW("c", [Card_Achievement])', [], ["Card_Achievement"], [], "---"),
)


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list_sql(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"


FORM_SQL = "  SELECT * FROM (VALUES " + ",\n    ".join(
    f"({i}, {_q(q)}, {_q(t)}, {_list_sql(f)}, {_list_sql(c)}, {_list_sql(v)}, {'r' in k}, {'s' in k}, {'a' in k})" for i, (q, t, f, c, v, k) in enumerate(FORMS)
) + ") AS form(form, question, text, filters, concepts, issues, raw, state, doubt)"


def form_log(r):
    """One logged question and query text per deal, of all forms."""
    forms = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(t).alias("text")) for q, t, *_ in FORMS])
    return r.deal_core.select("deal_id", F.get(forms, (F.col("deal_id") % len(FORMS)).cast("int")).alias("_f")).select("deal_id", "_f.*")


@query(
    "audit_log_forms",
    f"""
SELECT deal_id, kind, finding FROM deal_core JOIN (
  SELECT form, 'filter' AS kind, unnest(filters) AS finding FROM form UNION ALL SELECT form, 'concept', unnest(concepts) FROM form UNION ALL SELECT form, 'issue', unnest(issues) FROM form)
ON form = deal_id % {len(FORMS)}""",
    form=FORM_SQL,
)
def _(r):
    """A log of twenty forms of texts, each with what must be found in it."""
    return audit.audit_query_log(form_log(r), "deal_id", "text")


RAW_SQL = "raw sum of SO Actual Amount; use [Total SO Actual Amount (P) by Person]"
STATE_SQL = "the question asks for a state over time; only the present state is kept"


@query(
    "advisory_text",
    f"""
SELECT deal_id, array_to_string(list_filter([
    array_to_string([{_q(audit.WARNING_MARK)} || w FOR w IN list_concat(issues, CASE WHEN raw THEN ['{RAW_SQL}'] ELSE [] END, CASE WHEN state THEN ['{STATE_SQL}'] ELSE [] END)], chr(10) || chr(10)),
    CASE WHEN len(concepts) + len(filters) > 0 THEN {_q(audit.SOURCE_MARK)} || array_to_string(list_filter([
      CASE WHEN len(concepts) > 0 THEN {_q(audit.CONCEPT_HEAD)} || array_to_string(concepts, '; ') ELSE '' END,
      CASE WHEN len(filters) > 0 THEN {_q(audit.FILTER_HEAD)} || array_to_string(filters, ', ') ELSE '' END], LAMBDA x: x <> ''), ' | ') ELSE '' END,
    CASE WHEN doubt AND len(concepts) > 0 AND len(others) > 0 THEN {_q(audit.MEANING_MARK)} || 'amount was taken as ' || concepts[1] || '; it could also be ' || array_to_string(others, '; ') ELSE '' END],
  LAMBDA x: x <> ''), chr(10) || chr(10)) AS advisory
FROM deal_core JOIN (
  SELECT *, [c FOR c IN {_list_sql(audit.MONEY_CONCEPTS)} IF NOT contains(concepts[1], string_split(c, ' (')[1])] AS others FROM form) ON form = deal_id % {len(FORMS)}""",
    form=FORM_SQL,
)
def _(r):
    """What to tell the asker beside an answer: warnings, the source of the number, what a word was taken to mean."""
    return audit.advisories(form_log(r), "deal_id", "question", "text")


@query("question_count", "SELECT count(*) AS questions FROM conversations WHERE role = 'user'")
def _(r):
    return user_turns(r).agg(whole(F.count(F.lit(1)), "questions"))
