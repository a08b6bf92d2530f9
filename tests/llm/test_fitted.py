"""Fingerprints, learned operators and the pipeline: brute force, held-out accuracy and defined edge cases."""

import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ticketlens.llm import language_id, quality, queries, syncmers, toxicity
from ticketlens.llm.common import crc_mod, delete
from ticketlens.llm.queries import tokenizer_path
from ticketlens.session import named_folder
from tests.llm.conftest import prose
from tests.llm.test_exact import brute_classes, brute_fingerprint, brute_hits, brute_removed

# -- syncmers ----------------------------------------------------------------------------------------------------------


def spark_hash(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF"
WHITE = r" \t\n\x0b\f\r"


def brute_tokens(text):
    """Runs of at most 32 code points without an unspaced script, other runs code point by code point."""
    out = []
    for run in re.findall(f"[^{WHITE}]+", text or ""):
        out += [run] if len(run) <= 32 and not re.search(f"[{UNSPACED}]", run) else list(run)
    return out


def brute_anchors(text, k=6, s=2):
    h = [spark_hash(t) for t in brute_tokens(text)]
    if len(h) < k:
        return [(0, spark_hash(*h))] if h else []
    m = h
    for _ in range(s - 1):
        m = [spark_hash(a, b) for a, b in zip(m, m[1:], strict=False)]
    out = []
    for i in range(len(m) - (k - s)):
        window = m[i:i + k - s + 1]
        if min(window[0], window[-1]) <= min(window[1:-1], default=window[0]):
            out.append((i, spark_hash(*[m[j] for j in (i, *range(i + s, i + k - s, s), i + k - s)])))
    return out


def spark_int_hash(*values):
    """XXH64 of longs, the last one an int."""
    seed = 42
    for v, size in zip(values, (8, 8, 4), strict=True):
        seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed)
    return seed


def brute_neighbours(text):
    a = brute_anchors(text)
    return {h for _, h in a} if len(a) < 2 else {spark_int_hash(x[1], y[1], y[0] - x[0]) for x, y in zip(a, a[1:], strict=False)}


def alike(a, b):
    a, b = brute_neighbours(a), brute_neighbours(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_anchors(docs, texts):
    more = [(900, "x" * 32 + " " + "x" * 33), (901, "ab日本cd สวัสดี 한국어 텍스트 𠀀𠀁 é e\u0301 b"), (902, "\u00a0nbsp\u00a0 a\x0bb\x1cc")]
    own = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    for k, s in ((6, 2), (4, 2), (5, 1), (6, 3)):
        rows = own.select("doc_id", syncmers.anchors(F.col("text"), k, s).alias("a")).collect()
        got = sorted((r["doc_id"], [(x["place"], x["hash"]) for x in r["a"]]) for r in rows)
        assert got == sorted((i, brute_anchors(t, k, s)) for i, t in [*texts, *more])


def test_fingerprints_of_texts_and_edited_texts(docs, texts):
    rows = [r for r in texts if r[0] != 132]
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    after = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    spelt = lambda t: ",".join(f"{p:X}:{h & (1 << 64) - 1:016X}" for p, h in brute_anchors(t))
    got = {r["doc_id"]: r for r in syncmers.fingerprint_pairs(docs.where("doc_id <> 132")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t = t or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + after[i][:third]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == spelt(t) and r["edited_fingerprint"] == spelt(edited)
        assert abs(r["near_edited"] - alike(t, edited)) < 1e-12 and abs(r["near_next"] - alike(t, after[i])) < 1e-12


def test_near_copies_are_alike_in_any_script(spark):
    r = random.Random(7)
    chinese = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(400))
    thai = "".join(chr(r.randrange(0x0E01, 0x0E2F)) for _ in range(500))
    english = prose(300, 41)
    for base in (chinese, thai, english, "x" * 5 + "".join(r.choices("abcdef0123456789", k=600))):
        for edited in ("q" + base, "two words " + base, base + " end", base[:150] + "zz" + base[150:]):
            rows = syncmers.fingerprint_pairs(spark.createDataFrame([(2, edited), (1, base)], "doc_id long, text string")).collect()
            assert all(x["near_next"] > 0.9 for x in rows)
    apart = syncmers.fingerprint_pairs(spark.createDataFrame([(2, chinese), (1, english)], "doc_id long, text string")).collect()
    assert all(x["near_next"] == 0 for x in apart)


def test_a_long_text_keeps_all_its_anchors(spark):
    text = prose(30_000, 77)
    row = syncmers.fingerprint_pairs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row["fingerprint"].split(",")) == len(brute_anchors(text)) > 10_000


def test_buckets_follow_ids_nulls_and_repeated_ids(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 7, k, -k]), f"text {k % 170}") for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    least = -(1 << 63)
    order = sorted(rows, key=lambda x: (-(least if x[0] is None else x[0]), spark_hash(x[1])))
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for buckets in (1, 2, 7, 64, 2000):
        got = Counter(tuple(x) for x in syncmers.with_next(df, "doc_id", {"t": F.col("text")}, buckets).select("doc_id", "text", "next_t").collect())
        assert got == want


def test_next_row_with_repeated_and_null_ids(spark, no_docs):
    rows = [(5, "a"), (5, "b"), (None, "n"), (1 << 40, "z"), (-3, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["next_t"] for r in syncmers.with_next(df, "doc_id", {"t": F.col("text")}, 4).collect()}
    fives = sorted("ab", key=spark_hash)
    assert got == {(1 << 40, "z"): fives[0], (5, fives[0]): fives[1], (5, fives[1]): "m", (-3, "m"): "n", (None, "n"): "z"}
    assert syncmers.fingerprint_pairs(df.where("doc_id = -3")).first()["near_next"] == 1.0
    assert syncmers.fingerprint_pairs(no_docs).count() == 0


def test_fingerprint_plan_is_native_with_one_exchange_of_texts(docs):
    plan = syncmers.fingerprint_pairs(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


# -- toxicity ----------------------------------------------------------------------------------------------------------


def toxic_tables(spark, n=600):
    r = random.Random(2)
    bad = ["idiot", "m0ron", "trаsh"]      # the last with a Cyrillic letter
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = prose(r.randrange(5, 60), i).split()
        if toxic:
            words.insert(r.randrange(len(words)), r.choice([*bad, "grufflow" + r.choice(["er", "ing", "s", "ly"])]))
        elif i % 5 == 0:
            words.insert(0, "spring trash")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), int(i % 3 == 0)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def test_toxicity_learns_words_stems_and_exceptions(spark, docs, no_docs):
    texts, labels = toxic_tables(spark)
    held = crc_mod("doc_id", 5) == 0
    lexicon = toxicity.fit(texts, labels, held)
    assert {"idiot", "moron"} <= {e.rstrip("*") for e in lexicon.entries} | {"idiot"}
    assert any(e.startswith("gruff"[:len(e.rstrip("*"))]) for e in lexicon.entries)
    found = toxicity.score(texts, lexicon).join(labels, "doc_id").where(held).collect()
    right = [(r["toxic_score"] >= 0.5) == bool(r["toxic"]) for r in found]
    assert sum(right) / len(right) > 0.93
    odd = toxicity.score(docs.withColumn("toxic_score", F.lit("clash")), lexicon)
    assert odd.columns == [*docs.columns, "toxic_weight", "toxic_score"]
    assert all(0 <= r["toxic_score"] <= 1 for r in odd.collect())
    assert toxicity.score(no_docs, lexicon).count() == 0
    assert toxicity.fit(texts, labels.where("toxic = 0"), held).entries == {}


def test_matches_need_word_boundaries_and_respect_exceptions():
    find = toxicity.automaton(["moron", "gruf*"])
    hits = lambda t, e=frozenset(): [m[0] for m in toxicity.matches(find, t, e)]
    assert hits("MORON, m0r0n! oxymoron morons gruffy xgruffy МOЯ") == ["moron", "moron", "gruf*"]
    assert hits("mоrоn$$$ no") == ["moron"] or hits("mоrоn no") == ["moron"]
    assert hits("a moron here", frozenset({"a moron"})) == [] and hits("moron here", frozenset({"moron here"})) == []
    assert hits("") == [] and toxicity.matches(toxicity.automaton([]), "x") == []


def brute_matches(entries, text, exceptions):
    """Every entry is tried at every place of the folded text."""
    low = text.lower()
    fold = low.translate(toxicity._FOLD)
    is_word = lambda c: re.match(r"[\w@$]", c) is not None
    out = []
    for start in range(len(fold)):
        if start and low[start - 1].isalnum():
            continue
        fits = []
        for e in entries:
            w = e.rstrip("*")
            end = start + len(w)
            if fold.startswith(w, start) and (e[-1] == "*" or end == len(low) or not low[end].isalnum()):
                fits.append((-len(e), len(w), e))
        if fits:
            e = min(fits)[2]
            end = start
            while end < len(low) and is_word(low[end]):
                end += 1
            end = end if end > start else start + len(e)
            word = fold[start:end]
            before = re.findall(r"[\w@$]+", fold[:start])[-1:]
            after = re.findall(r"[\w@$]+", fold[end:])[:1]
            if not exceptions & {" ".join([*before, word]), " ".join([word, *after])}:
                out.append(e)
    return out


def test_scores_of_a_table_against_trying_every_entry(spark, docs, texts):
    r = random.Random(12)
    words = "river stone m0ron moron morons gruff gruffy trаsh trash $pring spring ab abc abcd x".split()
    entries = {e: (r.randrange(5, 40), r.randrange(3)) for e in ["moron", "moro*", "gruf*", "gruffy", "trash", "stone*", "abc", "ab*", "river"]}
    exceptions = frozenset({"spring trash", "river stone", "stone river", "x abc", f"{'long' * 30} trash"})
    lexicon = toxicity.Lexicon(entries, exceptions, 50, 900, (-2.0, 1.5, 0.7))
    own = [(k, " ".join(r.choices(words, k=r.randrange(0, 25))).translate({32: r.choice([" ", ", ", "\n", "  "])})) for k in range(120)]
    own += [(500, "long" * 30 + " trash"), (501, "ＴＲＡＳＨ trash!"), (502, None), (503, "xmoron moron"), *[(1000 + k, t) for k, (_, t) in enumerate(texts)]]
    found = toxicity.score(spark.createDataFrame(own, "doc_id long, text string"), lexicon).collect()
    for x in found:
        text = x["text"] or ""
        weight = sum(lexicon.weight(e) for e in brute_matches(entries, text, exceptions))
        n = text.count(" ") + 1
        line = -2.0 + 1.5 * np.log1p(weight) + 0.7 * 10 * weight / (n + 10)
        assert abs(x["toxic_weight"] - weight) < 1e-9 and abs(x["toxic_score"] - 1 / (1 + np.exp(-np.clip(line, -30, 30)))) < 1e-9
    assert sum(x["toxic_weight"] > 0 for x in found) > 60


def test_repeated_ids_do_not_enlarge_the_fitting_sample(spark):
    rows = [(1, f"text {k % 7}") for k in range(500)] + [(k, "other text") for k in range(2, 30)] + [(None, "no id")] * 50
    labels = [(1, 1)] * 3 + [(k, 0) for k in range(2, 30)] + [(None, 1), (99, None)]
    sample = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"),
                                      "toxic", F.lit(False), 100).collect()
    assert len(sample) == 29 and [r["text"] for r in sample if r["label"] == 1] == ["text 0"]


def test_only_rows_outside_the_held_out_part_are_learned(spark):
    texts, labels = toxic_tables(spark, 300)
    held = crc_mod("doc_id", 5) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(texts, labels, held) == toxicity.fit(texts, turned, held)
    x, y = quality.fit(texts, labels, held), quality.fit(texts, turned.withColumn("quality", F.when(held, 0).otherwise(F.col("quality"))), held)
    assert all(np.array_equal(a, b) for a, b in zip(x, y, strict=True))


# -- quality -----------------------------------------------------------------------------------------------------------


def test_statistics_do_not_depend_on_the_batch(texts):
    raw = [(t or "").encode() for _, t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0, *map(len, raw)])
    together = quality.statistics(buf, off)
    for k, b in enumerate(raw):
        alone = quality.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert np.allclose(together[k], alone[0])
    words = dict(zip(quality.STATISTICS, quality.statistics(np.frombuffer(b"To be, or to be!!", np.uint8), np.array([0, 17]))[0], strict=True))
    assert np.isclose(words["distinct_words"], 1.0) and np.isclose(words["capital_words"], 1 / 5)
    words = dict(zip(quality.STATISTICS, quality.statistics(np.frombuffer(b"ab ab cd", np.uint8), np.array([0, 8]))[0], strict=True))
    assert np.isclose(words["distinct_words"], 2 / 3) and np.isclose(words["most_common_word"], 2 / 3)


def plain_statistics(raw: bytes) -> dict:
    """One loop or expression per statistic."""
    n = len(raw)
    if not n:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    white = b" \t\r\x0b\x0c\n"
    words = [w for w in re.split(rb"[ \t\r\x0b\x0c\n]+", raw) if w]
    w = max(len(words), 1)
    is_sign = lambda c: c not in white and not (0x30 <= c < 0x3A or 0x41 <= c < 0x5B or 0x61 <= c < 0x7B or c >= 0x80 or c in b".!?,;:")
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    count = Counter(words)
    share = lambda chars: sum(c in chars for c in raw) / n
    upper = lambda x: sum(0x41 <= c < 0x5B for c in x)
    ends = sum(c in b".!?" for c in raw)
    return {
        "log_bytes": np.log1p(n), "log_words": np.log1p(len(words)), "word_bytes": mean,
        "word_bytes_sd": np.sqrt(max(0.0, sum(x * x for x in sizes) / w - mean ** 2)),
        "upper": upper(raw) / n, "lower": sum(0x61 <= c < 0x7B for c in raw) / n, "digit": sum(0x30 <= c < 0x3A for c in raw) / n,
        "space": share(b" \t\r\x0b\x0c"), "newline": share(b"\n"), "end_marks": ends / n, "commas": share(b",;:"),
        "other_signs": sum(map(is_sign, raw)) / n, "high": sum(c >= 0x80 for c in raw) / n,
        "bytes_per_line": np.log1p(n / (raw.count(b"\n") + 1)), "distinct_words": len(count) / w,
        "most_common_word": max(count.values(), default=0) / w, "short_words": sum(x <= 3 for x in sizes) / w,
        "long_words": sum(x >= 9 for x in sizes) / w, "capital_words": sum(0x41 <= x[0] < 0x5B for x in words) / w,
        "sign_words": sum(is_sign(x[-1]) for x in words) / w, "upper_words": sum(upper(x) >= 2 for x in words) / w,
        "words_per_end": np.log1p(len(words) / (ends + 1)), "longest_word": np.log1p(max(sizes, default=0)),
        "distinct_signs": len({c for c in raw if is_sign(c)}),
        "repeated_signs": sum(a == b and is_sign(a) for a, b in zip(raw, raw[1:], strict=False)) / n,
    }


def test_every_statistic_against_a_plain_one(texts):
    r = random.Random(3)
    more = ["".join(r.choices("aB 1.,!?;:#$%\n\té日", k=r.randrange(0, 200))) for _ in range(60)] + ["HELLO World!! ### ok, ok; ok."]
    raw = [(t or "").encode() for t in [*(t for _, t in texts), *more]]
    off = np.cumsum([0, *map(len, raw)])
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), off)
    for k, b in enumerate(raw):
        want = plain_statistics(b)
        assert np.allclose(got[k], [want[name] for name in quality.STATISTICS]), (b[:80], dict(zip(quality.STATISTICS, got[k], strict=True)), want)
        for most in (1, 7, 100, 1 << 20) if b and len(b) < 3000 else ():
            assert np.allclose(quality.long_statistics(np.frombuffer(b, np.uint8), most)[0], got[k])


def test_trees_learn_and_flattened_walk_equals_the_plain_one():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.train(x[:2000], y[:2000], trees=30)
    got = model.score(x[2000:])
    assert ((got >= 0.5) == y[2000:]).mean() > 0.95
    for row, p in zip(x[2000:2050], got, strict=False):
        line = model.base
        for t in range(30):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.cut[t, node])
            line += model.leaf[t, node - model.feature.shape[1]]
        assert abs(1 / (1 + np.exp(-line)) - p) < 1e-12
    assert (quality.train(x[:10], np.ones(10)).score(x) > 0.9).all()


def test_quality_edges(spark, docs, no_docs):
    model = quality.train(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert all(r["quality_score"] == 0.5 for r in quality.score(docs, model).collect())
    assert quality.score(no_docs, model).count() == 0


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, label, least in (("op3_toxicity", "toxic", 0.95), ("op4_quality", "quality", 0.98)):
        found = queries.QUERIES[name](spark, sf)
        both = found.where("held_out").join(labels, "doc_id")
        assert both.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] > least
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = queries.QUERIES["op7_language_id"](spark, sf).where("held_out").join(langs, "doc_id")
    assert both.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.99


# -- language ----------------------------------------------------------------------------------------------------------


def test_language_edges(spark, docs, no_docs):
    french = [(1000 + k, "le chat et la souris de la maison bleue " + str(k), "fr") for k in range(12)]
    english = [(2000 + k, "the cat and the mouse of that blue house " + str(k), "en") for k in range(30)]
    train = spark.createDataFrame([*french, *english, (3000, "no language", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train, F.lit(False))
    assert model.languages == ["en", "fr"]
    own = spark.createDataFrame([(1, "La souris et le chat"), (2, "THE MOUSE AND THE CAT"), (3, None), (4, "12 !!"), (5, "日本語"), (6, ""), (7, "😀 ½ 、。")],
                                "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(own, model).collect()}
    assert got[1][0] == "fr" and got[2][0] == "en" and got[1][1] > 0.5
    assert got[3] == got[4] == got[6] == got[7] == ("und", 0.0) and got[5] == ("en", 0.0)
    assert language_id.identify(docs, model).columns == [*docs.columns, "lang_pred", "lang_score", "lang_votes"]
    votes = {r["doc_id"]: r["lang_votes"] for r in language_id.identify(own, model).collect()}
    assert votes[1] > 0 and votes[2] > 0 and votes[5] == votes[3] == votes[4] == 0
    assert language_id.identify(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs, F.lit(False))
    assert {r["lang_pred"] for r in language_id.identify(own, nothing).collect()} == {"und"}


def grams(text):
    """The 4-grams of a text, all that is not a letter being a space, spaces at both ends."""
    t = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()}  ")
    return [t[k:k + 4] for k in range(len(t) - 3) if t[k:k + 4].strip()]


def learned_grams(rows, least=3):
    """{language: its n-grams}: in ``least`` documents or more, and no less than a quarter of the greatest share."""
    n, docs = defaultdict(Counter), Counter()
    for _, text, lang in {(i, lang): (i, t, lang) for i, t, lang in sorted(rows, key=lambda r: (str(r[0]), r[1] or ""), reverse=True)}.values():
        n[lang].update(set(grams(text)))
        docs[lang] += 1
    share = {lang: {g: k / docs[lang] for g, k in own.items() if k >= least} for lang, own in n.items()}
    top = defaultdict(float)
    for own in share.values():
        for g, x in own.items():
            top[g] = max(top[g], x)
    return {lang: {g for g, x in own.items() if 4 * x >= top[g]} for lang, own in share.items()}


def test_votes_and_choice_against_sets_of_grams(spark):
    r = random.Random(6)
    alphabets = {"l1": "abcdefg", "l2": "efghijk", "l3": "日本語文字の"}
    rows = []
    for k in range(90):
        lang = sorted(alphabets)[k % 3]
        rows.append((k, " ".join("".join(r.choices(alphabets[lang], k=r.randrange(2, 5))) for _ in range(r.randrange(1, 40))), lang))
    rows += [(200, None, "l1"), (201, "", "l2"), (7, "eeee ffff", "l1"), (202, "unlabelled gggg", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, crc_mod("doc_id", 4) == 2)
    sets = learned_grams([x for x in rows if x[2] and zlib.crc32(str(x[0]).encode()) % 4 != 2])
    assert model.languages == sorted(sets)
    for x in language_id.identify(df, model).collect():
        g = grams(x["text"])
        got = {lang: sum(y in own for y in g) for lang, own in sets.items()}
        best = sorted(got.values(), reverse=True)
        if not any(c.isalpha() for c in x["text"] or ""):
            assert (x["lang_pred"], x["lang_score"]) == ("und", 0.0)
        elif best[0] - best[1] > 0.02 * len(g):      # beyond what false positives can move
            assert x["lang_pred"] == max(got, key=got.get)
            assert abs(x["lang_votes"] - best[0]) <= 0.01 * len(g) + 1e-6
            assert abs(x["lang_score"] - best[0] / len(g) * (best[0] - best[1]) / best[0]) < 0.03


def test_votes_do_not_depend_on_the_parts_a_text_is_read_in(spark, monkeypatch):
    train = spark.createDataFrame([(k, prose(60, k) + " été straße", f"l{k % 2}") for k in range(20)], "doc_id long, text string, lang string")
    model = language_id.fit(train, F.lit(False), least_docs=1)
    text = prose(500, 9) + " ÉTÉ 12 !! Straße"
    whole = language_id.votes(model, [text])
    for part in (1, 3, 7, 100):
        monkeypatch.setattr(language_id, "PART", part)
        again = language_id.votes(model, [text])
        assert all(np.allclose(a, b) for a, b in zip(whole, again, strict=True))
        made = language_id.fit(train, F.lit(False), least_docs=1)
        assert np.array_equal(made.slots, model.slots)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    texts = [prose(60, k) for k in range(20)]
    train = spark.createDataFrame([(k, t, f"l{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(train, F.lit(False), least_docs=1)
    got, n, _ = language_id.votes(model, texts)
    assert (got.argmax(axis=1) == np.arange(20) % 2).mean() >= 0.5 and (got <= n[:, None] + 1e-9).all()
    strange, n, _ = language_id.votes(model, ["xqzv wjkp vvqx " * 30])
    assert (strange <= 0.02 * n[:, None]).all()


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_stages_against_brute_force(spark, docs, texts, tmp_path):
    items = [(1, " ".join(dict(texts)[20].split()[:15])), (2, "never seen words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    told = stage["language ID"](spark, base, str(tmp_path))
    assert told.columns == base.columns
    learned = learned_grams([(i, t, "en") for i, t in texts if zlib.crc32(str(i).encode()) % 4 != 2])
    with_letters = [(i, t) for i, t in texts if set(grams(t)) & learned["en"]]
    assert sorted((r["doc_id"], r["text"]) for r in told.collect()) == sorted(with_letters)
    assert {0, 29, 132} <= {i for i, _ in with_letters} and not {120, 121, 122, 133} & {i for i, _ in with_letters}
    classes = brute_classes([(i, brute_fingerprint(t)) for i, t in with_letters])
    single = stage["SimHash near-dedup"](spark, told, str(tmp_path))
    want = {(i, t) for i, t in with_letters if classes[i] == i}
    assert sorted((r["doc_id"], r["text"]) for r in single.collect()) == sorted(want)
    clean = stage["suffix-array dedup"](spark, base, str(tmp_path))
    assert clean.columns == base.columns
    brute = brute_removed(texts, 50)
    for r in clean.collect():
        if r["doc_id"] in (124, 125, 132):      # many-byte characters stay whole; a repeated id
            continue
        n, gone, _, kept = brute[r["doc_id"]][0]
        assert (r["text"] or "").encode() == kept and (gone == 0 or r["n_chars"] == len(r["text"]))
    lost = {i for i, v in brute.items() if v[0][0] and v[0][0] == v[0][1]}
    assert not lost & {r["doc_id"] for r in clean.collect()} and lost >= {102, 111}
    free = stage["benchmark decontamination"](spark, base, str(tmp_path))
    assert sorted(r["doc_id"] for r in free.collect()) == [r[0] for r in brute_hits(texts, items) if not r[-1]]
    packed = stage["best-fit packing"](spark, base, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {i for i, _ in texts}


def test_packed_stage_carries_the_ids_of_every_row(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    rows = [(None, "no id"), (None, "no id"), (None, "other"), (7, "again"), (7, "again"), (8, None), (9, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs, str(tmp_path)).collect()
    starts = sorted((str(r["doc_id"]), tuple(r["ids"])) for r in packed if r["doc_id"] != 9)
    assert starts == sorted((str(i), (*own.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows if i != 9)
    long = [x for r in sorted((r for r in packed if r["doc_id"] == 9), key=lambda r: r["piece"]) for x in r["ids"]]
    assert long == [*own.encode("word " * 5000, add_special_tokens=False).ids, 0]
    assert all(len(r["ids"]) == r["length"] for r in packed)
    places = {(r["sequence_id"], r["offset"] + k) for r in packed for k in range(r["length"])}
    assert len(places) == sum(r["length"] for r in packed)


def test_pipeline_runs_over_a_whole_table(spark):
    base = pathlib.Path(named_folder(spark)) / "llm"
    before = set(base.iterdir()) if base.exists() else set()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(base.iterdir()) - before
    assert [p.name.rsplit("-", 1)[0] for p in left] == ["best-fit-packing"]      # nothing else of the run is left behind
    with pytest.raises(ValueError, match="not a scratch folder"):
        delete(spark, str(base))
    by = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert by.where("n <> end or n > 2048").count() == 0 and by.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
