"""Support-language fixture views derived from the driver tables.

The driver tables hold no support vocabulary, so each view prepends a phrase
picked by key arithmetic to real table text.  Every view is defined twice, as a
Spark DataFrame and as DuckDB SQL (a ``WITH`` prefix for the oracle), from the
same phrase list, so both engines see identical rows.

Keys: ``social_raw.id = (conv_id*100+turn)*2`` (even), ``tickets_raw.id =
event_id*2+1`` (odd), so ids stay unique after the two sources are unified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as TX
from ..operators import labels as LB
from ..operators import unify as UN

# Our own test phrases: they cover all 14 rules, a URL, an apostrophe, placeholders,
# texts of > 30 and > 80 words, keyword-only texts and a text with no match.
PHRASES: tuple[str, ...] = (
    "I was double charged for my order, please sort it out asap",
    "Overcharged again this month on the premium plan",
    "Please process a refund for the annual plan I never used",
    "The invoice total does not match the quote I got today",
    "Account locked after three attempts and I need help",
    "Forgot password and the recovery email never shows up",
    "I can't log in since the last update, this is urgent",
    "Cannot log in on the mobile app even after clearing the cache",
    "Please reset password for my colleague on the team plan",
    "Our ad campaign stopped spending yesterday without any change",
    "We see a sharp impression drop in every region since Monday",
    "App crash with {error_message} right after the splash screen",
    "Checkout is not working for {product_purchased} buyers in Canada",
    "Is there a service outage? Nothing loads on https://status.example.com/live right now",
    "How do I change the billing email on file for my company?",
    "What are your opening hours on weekends and public holidays?",
    "Since we moved our team to the new workspace the username field on the profile page keeps "
    "reverting to the old value, and the verification badge disappeared as well; we tried logging "
    "out, clearing cookies, switching browsers and waiting a day, yet nothing changed at all.",
    "Over the past two weeks our store has had a string of problems that we would like someone to "
    "look at together rather than one by one: orders placed from tablets sometimes hang at the "
    "payment step, the nightly export to our warehouse system finishes with missing rows, two staff "
    "members were logged out in the middle of their shifts, the reports page shows totals that do "
    "not agree with the exported files, and the support chat widget disappears on smaller screens, "
    "so our customers cannot reach us when they need to most.",
    "The 2fa code arrives late and the signin page shows an error",
    "Thanks, all good now!",
)
N_PHRASES = len(PHRASES)
# Every 5th key repeats one of at most 100 references and every 50th key the same one (duplicates
# and a hot text for dedup); all other keys have a reference of their own, so the views grow
# with the tables.
REF_MOD = 500
NULL_DESC_MOD = 97     # every 97th ticket has a null description

EVENT_TYPE_TO_TICKET_TYPE: tuple[tuple[str, str], ...] = (
    ("error", "Technical issue"),
    ("purchase", "Billing inquiry"),
    ("signup", " ACCOUNT ACCESS "),
    ("view", "Product inquiry"),
)
UNMAPPED_TICKET_TYPE = "Unknown kind"

REPLIES: tuple[str, ...] = (
    '{"issue_type": "ads", "urgency": "high", "complexity": "low"}',
    '```json\n{"issue_type": "login", "urgency": "medium"}\n```',
    "{}",
    "Sorry, I am unable to classify this ticket right now.",
    '{"issue_type": "technical"}',
)

RESOLUTIONS: tuple[str, ...] = (
    '{"suggested_path": "refund_review", "should_escalate": false, "reason": "policy allows a refund"}',
    'Here you go: {"suggested_path": "tier2_engineering", "should_escalate": true, "reason": "possible outage"}',
    "The model could not produce a resolution.",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ref(k):
    ref = F.when(k % 50 == 0, F.lit(0)).when(k % 5 == 0, k % REF_MOD).otherwise(k)
    return F.concat(F.lit(" ref "), ref.cast("long").cast("string"))


def sql_ref(k: str) -> str:
    return f"' ref ' || CAST(CASE WHEN {k} % 50 = 0 THEN 0 WHEN {k} % 5 = 0 THEN {k} % {REF_MOD} ELSE {k} END AS VARCHAR)"


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


# ----------------------------------------------------------------------------- Spark side

def social_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 100 + F.col("turn")
    phrase = _pick(PHRASES, k)
    text = F.when(k % 10 == 0, F.concat(phrase, _ref(k))) \
        .otherwise(F.concat(phrase, F.lit(" "), F.col("text")))
    inbound = F.when(F.col("role") == "user", F.lit(True)).when(F.col("role") == "assistant", F.lit(False))
    return conv.select((k * 2).alias("id"), text.alias("text"), inbound.alias("inbound"))


def tickets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    k = F.coalesce("event_id", "o_orderkey")
    phrase = _pick(PHRASES, k)
    ttype = None
    for et, tt in EVENT_TYPE_TO_TICKET_TYPE:
        ttype = F.when(F.col("event_type") == et, F.lit(tt)) if ttype is None \
            else ttype.when(F.col("event_type") == et, F.lit(tt))
    ttype = ttype.otherwise(F.lit(UNMAPPED_TICKET_TYPE))
    desc = F.when(k % NULL_DESC_MOD == 0, F.lit(None).cast("string")) \
        .otherwise(F.concat(phrase, _ref(k)))
    return (
        ev.join(od, ev.event_id == od.o_orderkey, "full")
        .select((k * 2 + 1).alias("id"), phrase.alias("subject"), desc.alias("description"),
                ttype.alias("type"), F.substring_index("o_orderpriority", "-", -1).alias("priority"))
    )


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UN.unify_sources(social_raw(spark, sf_dir), tickets_raw(spark, sf_dir), **UN.FIXTURE_TICKET_COLUMNS)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LB.add_weak_labels(unified(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labeled(spark, sf_dir)
    idc = F.col("id")
    prob = ((idc * 37) % 71 + 29).cast("double") / F.lit(100.0)
    return lab.select("id", "text", _pick(C.ISSUE_TYPES, idc).alias("label"), prob.alias("prob"),
                      _pick(C.URGENCY_LEVELS, idc).alias("urgency"))


def llm_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", _pick(REPLIES, F.col("id")).alias("reply"))


def llm_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and resolution replies for every scored row (the router uses the middle band)."""
    return scored(spark, sf_dir).select(
        "id", F.concat(F.lit("Summary for ticket "), F.col("id").cast("string")).alias("summary"),
        _pick(RESOLUTIONS, F.col("id")).alias("resolution"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per labeled row (a model label and the keyword baseline), emitted in one
    pass with ``inline`` so the labeled view is computed once, not once per model."""
    lab = labeled(spark, sf_dir)
    y = F.col("issue_type")
    rows = F.array(
        F.struct(F.lit("ml_tfidf_lr").alias("model"), y.alias("y"), _pick(C.ISSUE_TYPES, F.col("id")).alias("p")),
        F.struct(F.lit("keyword_baseline").alias("model"), y.alias("y"), TX.keyword_issue("text").alias("p")),
    )
    return lab.select("id", F.inline(rows))


# ----------------------------------------------------------------------------- SQL side

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_pick(values, idx_expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {sql_str(v)}" for i, v in enumerate(values))
    return f"(CASE ({idx_expr}) % {len(values)} {whens} END)"


def sql_contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"strpos({text}, {sql_str(w)}) > 0" for w in words) + ")"


def sql_keyword_issue(text: str, keyword_map=C.KEYWORD_MAP) -> str:
    whens = " ".join(f"WHEN {sql_contains_any(text, ws)} THEN {sql_str(lbl)}" for lbl, ws in keyword_map)
    return f"(CASE {whens} ELSE 'other' END)"


def sql_keyword_urgency(text: str) -> str:
    return (f"(CASE WHEN {sql_contains_any(text, C.URGENCY_HIGH_WORDS)} THEN 'high' "
            f"WHEN {sql_contains_any(text, C.URGENCY_MEDIUM_WORDS)} THEN 'medium' ELSE 'low' END)")


def sql_normalize(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), 'http\\S+', ' ', 'g'), "
            f"'[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_word_count(t: str) -> str:
    return f"(CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, ' ', '')) + 1 END)"


def sql_complexity(t: str) -> str:
    n = sql_word_count(t)
    return (f"(CASE WHEN {n} > {C.COMPLEXITY_HIGH_WORDS} THEN 'high' "
            f"WHEN {n} > {C.COMPLEXITY_MEDIUM_WORDS} THEN 'medium' ELSE 'low' END)")


def sql_map(x: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} END)"


def sql_rule(text: str, field: int) -> str:
    whens = " ".join(f"WHEN strpos({text}, {sql_str(r[0])}) > 0 THEN {sql_str(r[field])}"
                     for r in C.RULE_PATTERNS)
    return f"(CASE {whens} END)"


def sql_queue(label: str) -> str:
    return f"coalesce({sql_map(label, C.QUEUE_BY_ISSUE)}, {sql_str(C.DEFAULT_QUEUE)})"


def sql_suffix(route: str, urgency: str) -> str:
    return f"(CASE WHEN {urgency} IN ('high', 'critical') THEN {route} || '_priority' ELSE {route} END)"


def fixture_ctes() -> str:
    """``WITH`` prefix defining social_raw, tickets_raw, unified, labeled, scored,
    llm_replies and predictions over the pre-registered driver views."""
    ttype_whens = " ".join(f"WHEN {sql_str(a)} THEN {sql_str(b)}" for a, b in EVENT_TYPE_TO_TICKET_TYPE)
    k_s = "(conv_id * 100 + turn)"
    type_key = f"lower({sql_strip('type')})"
    prio_key = f"lower({sql_strip('priority')})"
    tax = list(C.ISSUE_TYPES)
    urg = list(C.URGENCY_LEVELS)
    return f"""
WITH social_raw AS (
  SELECT {k_s} * 2 AS id,
         CASE WHEN {k_s} % 10 = 0 THEN {sql_pick(PHRASES, k_s)} || {sql_ref(k_s)}
              ELSE {sql_pick(PHRASES, k_s)} || ' ' || text END AS text,
         CASE WHEN role = 'user' THEN TRUE WHEN role = 'assistant' THEN FALSE END AS inbound
  FROM conversations
),
tickets_raw AS (
  SELECT k * 2 + 1 AS id,
         {sql_pick(PHRASES, 'k')} AS subject,
         CASE WHEN k % {NULL_DESC_MOD} = 0 THEN NULL
              ELSE {sql_pick(PHRASES, 'k')} || {sql_ref('k')} END AS description,
         CASE event_type {ttype_whens} ELSE {sql_str(UNMAPPED_TICKET_TYPE)} END AS type,
         split_part(o_orderpriority, '-', 2) AS priority
  FROM (SELECT *, coalesce(event_id, o_orderkey) AS k FROM events FULL JOIN orders ON event_id = o_orderkey)
),
social_mapped AS (
  SELECT id, text AS subject, text AS description, 'customer_message' AS category, '' AS priority,
         'weak' AS label_source, 'twitter_support' AS source, 0 AS source_ord
  FROM social_raw WHERE inbound
),
tickets_mapped AS (
  SELECT id, subject, description,
         coalesce({sql_map(type_key, C.TICKET_TYPE_MAP)}, 'other') AS category,
         coalesce({sql_map(prio_key, C.TICKET_PRIORITY_MAP)}, '') AS priority,
         CASE WHEN {sql_map(type_key, C.TICKET_TYPE_MAP)} IS NOT NULL THEN 'real' ELSE 'weak' END AS label_source,
         'structured_tickets' AS source, 1 AS source_ord
  FROM tickets_raw
),
unified AS (
  SELECT id, subject, description, category, priority, label_source, source FROM (
    SELECT *, row_number() OVER (PARTITION BY description
             ORDER BY CASE label_source WHEN 'real' THEN 0 ELSE 1 END, source_ord, id) AS rn
    FROM (SELECT * FROM social_mapped UNION ALL SELECT * FROM tickets_mapped)
    WHERE description IS NOT NULL
  ) WHERE rn = 1
),
labeled_t AS (
  SELECT *, {sql_normalize("coalesce(subject, '') || ' ' || coalesce(description, '')")} AS text FROM unified
),
labeled AS (
  SELECT id, subject, description, category, priority, label_source, source, text,
         CASE WHEN label_source = 'real' AND category IN ({", ".join(map(sql_str, tax))}) THEN category
              ELSE {sql_keyword_issue('text')} END AS issue_type,
         CASE WHEN label_source = 'real' AND priority IN ({", ".join(map(sql_str, urg))}) THEN priority
              ELSE {sql_keyword_urgency('text')} END AS urgency,
         {sql_complexity('text')} AS complexity,
         coalesce(label_source, 'weak') AS label_quality
  FROM labeled_t
),
scored AS (
  SELECT id, text, {sql_pick(tax, 'id')} AS label,
         CAST((id * 37) % 71 + 29 AS DOUBLE) / 100.0 AS prob,
         {sql_pick(urg, 'id')} AS urgency
  FROM labeled
),
llm_replies AS (
  SELECT id, {sql_pick(REPLIES, 'id')} AS reply FROM scored
),
llm_enrichment AS (
  SELECT id, 'Summary for ticket ' || CAST(id AS VARCHAR) AS summary, {sql_pick(RESOLUTIONS, 'id')} AS resolution FROM scored
),
predictions AS (
  SELECT id, 'ml_tfidf_lr' AS model, issue_type AS y, {sql_pick(tax, 'id')} AS p FROM labeled
  UNION ALL
  SELECT id, 'keyword_baseline' AS model, issue_type AS y, {sql_keyword_issue('text')} AS p FROM labeled
)
"""
