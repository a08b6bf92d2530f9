"""Sampling on a skewed fixture (one class holds a third of the rows) against brute force."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ticketlens.operators import evalset as ES
from ticketlens.operators import sampling as SM


def _skewed(spark, n=3000):
    rows = []
    for i in range(n):
        lab = "hot" if i % 3 == 0 else f"c{i % 7}"
        rows.append((i, lab, f"text {i % 400}"))
    return spark.createDataFrame(rows, "id long, label string, text string"), rows


def _order(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_exact_rank_matches_row_number(spark):
    df, rows = _skewed(spark)
    got = {r["id"]: (r["_rank"], r["_group_n"]) for r in
           SM.exact_rank(SM.with_order_key(df, "id", 42), ["label"], SM.ORDER_COL, "id").collect()}
    by = defaultdict(list)
    for i, lab, _ in rows:
        by[lab].append((_order(42, i), i))
    for lab, items in by.items():
        for rank, (_, i) in enumerate(sorted(items), start=1):
            assert got[i] == (rank, len(items))


def test_stratified_split_sizes(spark):
    df, rows = _skewed(spark)
    out = SM.stratified_split(df, "label").collect()
    n = Counter(lab for _, lab, _ in rows)
    test = Counter(r["label"] for r in out if r["split"] == "test")
    assert len(out) == len(rows)
    for lab, c in n.items():
        assert test[lab] == (c + 4) // 5


def test_folds_disjoint_and_balanced(spark):
    df, rows = _skewed(spark)
    out = SM.kfold_assign(df, "label", k=5).collect()
    assert len({r["id"] for r in out}) == len(rows)
    per = defaultdict(Counter)
    for r in out:
        per[r["label"]][r["fold"]] += 1
    for lab, c in per.items():
        assert max(c.values()) - min(c.values()) <= 1


def test_per_class_sample_and_hash_sample(spark):
    df, rows = _skewed(spark)
    s = SM.per_class_sample(df, "label", 10).collect()
    assert Counter(r["label"] for r in s) == {lab: 10 for lab in {r[1] for r in rows}}
    hot = sorted((_order(42, i), i) for i, lab, _ in rows if lab == "hot")[:10]
    assert {r["id"] for r in s if r["label"] == "hot"} == {i for _, i in hot}
    h = SM.hash_sample(df, 25).collect()
    assert [r["id"] for r in h] == [i for _, i in sorted((_order(42, i), i) for i, _, _ in rows)[:25]]


def test_positional_split(spark):
    df, rows = _skewed(spark, 1001)
    out = SM.positional_split(df).collect()
    assert sum(r["split"] == "train" for r in out) == (1001 * 4) // 5


def test_dedup_keep_first(spark):
    df, rows = _skewed(spark, 1200)
    out = SM.dedup_keep_first(df, "text").collect()
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    assert sorted(r["id"] for r in out) == sorted(first.values())


def test_eval_set_pipeline(spark):
    long_desc = "The {product_purchased} keeps failing with {error_message} whenever I try to sync my data overnight from the office."
    tickets = spark.createDataFrame([
        (1, "Sync broken", long_desc, "Technical issue", "High"),
        (2, "Sync broken", long_desc, "Technical issue", "Low"),          # duplicate text → dropped
        (3, "Short", "too short", "Billing inquiry", "low"),              # < 100 chars → dropped
        (4, "Refund", long_desc + " Refund please.", "Mystery", "low"),   # unmapped type → dropped
        (5, "Card", long_desc + " Card declined.", "Payment issue", "urgent"),
    ], "id long, subject string, description string, type string, priority string")
    cand = ES.candidate_rows(tickets).collect()
    assert sorted(r["id"] for r in cand) == [1, 5]
    assert {r["id"]: r["urgency"] for r in cand} == {1: "high", 5: "medium"}
    first = next(r for r in cand if r["id"] == 1)
    assert "the product" in first["text"] and "{" not in first["text"]
    base = spark.createDataFrame([(100, first["text"].upper() + "!!", "technical", "high")],
                                 "id long, text string, issue_type string, urgency string")
    merged = ES.merge_eval_set(ES.tag_base(base), ES.candidate_rows(tickets))
    assert sorted(r["id"] for r in merged.collect()) == [5, 100]      # id 1 is already in the base
    summ = {(r["eval_label_source"], r["issue_type"]): r["count"] for r in ES.eval_summary(merged).collect()}
    assert summ == {("manually_written", "billing"): 0, ("manually_written", "technical"): 1,
                    ("metadata_ticket_type", "billing"): 1, ("metadata_ticket_type", "technical"): 0}
    assert ES.unmapped_count(tickets).first()["unmapped"] == 1
    _ = F


def test_eval_set_checks_hand_made(spark):
    from ticketlens.operators import evalset as ES

    rows = [
        (1, "Refund please!", "billing"),      # keyword rules give billing: easy row
        (2, "refund   please", "billing"),     # same normalised text: a duplicate
        (3, None, "billing"),                  # missing text
        (4, "   ", "login"),                   # blank text
        (5, "hello there", "weather"),         # label outside the taxonomy
        (6, "login fails", None),              # null label: outside too
    ]
    df = spark.createDataFrame(rows, "id long, text string, issue_type string")
    got = {r["check_name"]: r["value"] for r in ES.eval_set_checks(df, min_per_class=2).collect()}
    assert got["rows"] == 6 and got["missing_text"] == 2 and got["label_outside_taxonomy"] == 2
    assert got["duplicate_rows"] == 1 and abs(got["duplicate_rate"] - 1 / 5) < 1e-12
    assert got["keyword_recoverable"] == 2                 # rows 1 and 2
    assert got["classes_below_min"] == 5                   # only billing has >= 2 rows


def test_eval_set_checks_empty(spark):
    from ticketlens.operators import evalset as ES

    df = spark.createDataFrame([], "id long, text string, issue_type string")
    got = {r["check_name"]: r["value"] for r in ES.eval_set_checks(df).collect()}
    assert got["rows"] == 0 and got["duplicate_rate"] == 0 and got["classes_below_min"] == 6


def test_anti_join_with_a_hot_base_text(spark):
    """One normalised base text holds a third of the base rows: the result equals brute force,
    and the base keys are partially aggregated before their shuffle."""
    import re

    from ticketlens.operators import evalset as ES

    def norm(t):
        t = re.sub(r"http\S+", " ", t.lower())
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t)).strip()

    base_rows = [(i, "Refund, please!" if i % 3 == 0 else f"base text {i}", "billing", "low") for i in range(900)]
    cand_rows = [(10_000 + i, t, "billing", "low", "metadata_ticket_type", "", "")
                 for i, t in enumerate(["refund please", "REFUND   please", "base text 1", "base text 2",
                                        "fresh text", "another fresh one"])]
    base = ES.tag_base(spark.createDataFrame(base_rows, "id long, text string, issue_type string, urgency string"))
    cand = spark.createDataFrame(cand_rows, "id long, text string, issue_type string, urgency string, "
                                 "eval_label_source string, raw_ticket_type string, raw_priority string")
    out = ES.new_candidates(base, cand)
    seen = {norm(t) for _, t, _, _ in base_rows}
    assert sorted(r["id"] for r in out.collect()) == sorted(i for i, t, *_ in cand_rows if norm(t) not in seen)
    p = out._jdf.queryExecution().executedPlan().toString()
    assert p.count("HashAggregate") >= 2


def test_dedup_dropped_counts_what_keep_first_removes(spark):
    from ticketlens.operators import sampling as SM

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "a")], "id long, k string")
    kept = SM.dedup_keep_first(df, "k").count()
    assert SM.dedup_dropped(df, "k").first()["dropped"] == df.count() - kept == 3
