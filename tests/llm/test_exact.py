"""Operators with one right answer, against brute force on awkward small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, histogram_sort, induced_sort, packing, simhash, suffix_dedup, toxicity, url_filter
from ticketlens.llm.components import component_roots
from ticketlens.llm.queries import tokenizer_path

LOWER = {i: i + 32 for i in range(65, 91)}


# -- sharding ----------------------------------------------------------------------------------------------------------


def test_shards_hold_near_equal_bytes_and_gapless_slots(docs, texts):
    rows = histogram_sort.shard_by_bytes(docs, shards=4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(4))


def test_sharded_rows_keep_every_column(docs):
    rows = histogram_sort.shard_documents(docs, shards=4)
    assert rows.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(str, rows.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    places = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows.collect()}
    assert len({p[2:] for p in places}) == len(places) == docs.count()
    assert {(i, s, n) for i, _, s, n in places} == {
        (r["doc_id"], r["shard"], r["slot"]) for r in histogram_sort.shard_by_bytes(docs, shards=4).collect()}


def test_shards_of_even_rows_are_even(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 99, "x").alias("text"))
    sizes = [r["b"] for r in histogram_sort.shard_by_bytes(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 200


def test_shards_of_one_text_and_of_one_row_repeated_are_even(spark):
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
    rows = histogram_sort.shard_by_bytes(same).groupBy("shard").count().collect()
    assert {r["count"] for r in rows} == {125}
    again = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    rows = histogram_sort.shard_by_bytes(again.repartition(5)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 8 and all(abs(len(v) - 500) <= 1 and sorted(v) == list(range(len(v))) for v in by.values())


def test_no_operator_overwrites_a_column_of_the_caller(spark, docs):
    names = ["_h", "_id", "_cell", "_md5", "_scored", "_judged", "own_h", "own_id", "own_line", "own_cell", "own_md5", "of_id", "of_md5", "scored",
             "judged", "_rank", "_row", "_of", "h", "line"]
    own = {n: f"mine{k}" for k, n in enumerate(names)}
    wide = docs.select("doc_id", "text", *(F.lit(v).alias(n) for n, v in own.items()))
    lexicon = toxicity.Lexicon({"stone*": (9, 1)}, frozenset(), 10, 10, (0.0, 1.0, 1.0))
    items = spark.createDataFrame([(1, "river stone"), (2, "a b c d e")], "item_id long, text string")
    rules = spark.createDataFrame([("block", "net", "/")], "verdict string, host string, path string")
    for out in (histogram_sort.shard_documents(wide), simhash.one_of_each(wide), toxicity.score(wide, lexicon),
                url_filter.judge_urls(wide, url_filter.CONTRACT_RULES, url_col="text"), url_filter.judge_urls_by_table(wide, rules, url_col="text"),
                decontaminate.find_matches(wide, items), decontaminate.find_matches(wide, items, block_words=2)):
        rows = out.collect()
        assert rows and all(r[n] == v for r in rows for n, v in own.items())


# -- SimHash -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    """{id: least id reachable} of (id, fingerprint) rows."""
    label = {f: f for _, f in fps}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f

    values = sorted(label)
    for k, a in enumerate(values):
        for b in values[k + 1:]:
            if (a ^ b).bit_count() <= 4:
                label[find(a)] = find(b)
    least = {}
    for i, f in fps:
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: least[find(f)] for i, f in fps}


def test_simhash_classes(docs, texts):
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    classes = brute_classes(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", classes[i]) for i, f in fps}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _ in texts if classes[i] == i})


@pytest.mark.parametrize("most", [1, 5, 64, 1 << 21])
def test_a_fingerprint_does_not_depend_on_the_parts_a_text_is_read_in(texts, most):
    more = ["A b", "a b c d", "  x\x0by z\x0c w v\r", "w" * 300 + " " + "v " * 40]
    for t in [*(t for _, t in texts if len(t or "") < 3000), *more]:
        assert simhash.fingerprint((t or "").encode(), 4, most) == brute_fingerprint(t)


def test_one_of_each_with_null_and_repeated_ids(spark):
    from tests.llm.conftest import prose

    alone, all_null, mixed, low, other = (prose(40, 900 + k) for k in range(5))
    rows = [(None, alone), (None, all_null), (None, all_null), (None, mixed), (6, mixed), (5, mixed),
            (1, low), (7, low), (7, other), (7, other), (9, other), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(None, alone), (None, all_null), (5, mixed), (1, low), (7, other), (None, "")]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(i), t) for i, t in want)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base[r.integers(0, 60, 400)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << r.integers(0, 64, len(near)).astype(np.uint64))
    a = np.unique(np.r_[base, near[:200]])
    b = np.unique(near[200:])
    for x, y, same in ((a, a, True), (a, b, False)):
        want = {(i, j) for i in range(len(x)) for j in range(len(y)) if (not same or i < j) and int(x[i] ^ y[j]).bit_count() <= 4}
        one = simhash.Trie(x)
        got = list(simhash.close_pairs(one, one if same else simhash.Trie(y), 4, same))
        pairs = [(i, j) for u, v in got for i, j in zip(u.tolist(), v.tolist(), strict=True)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_blocks_ship_every_fingerprint_once_for_each_band(spark, monkeypatch):
    r = random.Random(11)
    values = sorted({r.getrandbits(64) for _ in range(6000)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    kept = []
    monkeypatch.setattr(simhash, "stored", lambda d, tag: (kept.append((tag, d)), d)[1])
    simhash.close_links(df, least_block=100, most_block=500, blocks=8).collect()
    blocks = next(d for tag, d in kept if tag == "blocks")
    assert sum(len(x["data"]) // 8 for x in blocks.select("data").collect()) == 5 * len(values)
    assert blocks.count() == blocks.select("block").distinct().count()


@pytest.mark.parametrize("budget", [0, 1, 4, 7])
def test_links_at_other_budgets(spark, budget):
    r = random.Random(budget)
    base = [r.getrandbits(64) for _ in range(60)]
    values = set(base)
    for v in base:
        for _ in range(4):
            w = v
            for _ in range(r.randrange(1, 9)):
                w ^= 1 << r.randrange(64)
            values.add(w)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {x["node"]: x["root"] for x in component_roots(simhash.close_links(df, budget=budget, least_block=20, most_block=20)).collect()}
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    order = sorted(values)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            if (a ^ b).bit_count() <= budget:
                label[find(a)] = find(b)
    want, got = defaultdict(set), defaultdict(set)
    for v in values:
        s = v - (1 << 64) if v >> 63 else v
        want[find(v)].add(s)
        got[roots.get(s, s)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_blocks_lose_no_link(spark):
    """Many small blocks, a hot prefix among them: the links still connect what brute force connects."""
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(150)} | {(7 << 48) | r.getrandbits(12) for _ in range(120)}
    values |= {v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in list(values)[:80]}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    links = simhash.close_links(df, least_block=10, most_block=10, blocks=1000)
    roots = {x["node"]: x["root"] for x in component_roots(links).collect()}
    groups = defaultdict(set)
    for (v,) in signed:
        groups[roots.get(v, v)].add(v)
    classes = brute_classes([(v, v & ((1 << 64) - 1)) for (v,) in signed])
    want = defaultdict(set)
    for v, c in classes.items():
        want[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_a_star_and_repeats(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (60, 59), (60, 59)]
    got = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{1000 + k: 1000 for k in range(1, 200)}}
    assert component_roots(spark.createDataFrame([], "u long, v long")).count() == 0


# -- decontamination ---------------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    find = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = defaultdict(set)
    for i, t in items:
        w = find((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, own = find((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    own |= x
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_decontamination_finds_every_window(spark, docs, texts, block_words):
    long = dict(texts)
    items = [(1, " ".join(long[20].split()[3:30]).upper()), (2, "river stone"), (3, long[5].split()[2]), (4, None), (5, "?!"),
             (6, " ".join(long[132].split()[500:509])), (6, " ".join(long[132].split()[500:511])), (7, "日本語テキスト" * 40),
             (8, " ".join(long[10].split()[:12]) + " other " + " ".join(long[11].split()[2:13])), (None, long[100][:200])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(docs, table, block_words=block_words)
    got = sorted(tuple(r) for r in decontaminate.digest(found).collect())
    assert got == brute_hits(texts, [("" if i is None else i, t) for i, t in items])
    kept = decontaminate.remove_contaminated(docs, table, block_words=block_words)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in got if not r[-1]]


def test_test_blocks_are_shipped_one_after_the_other(spark, docs, monkeypatch):
    alive, most = [], []
    ship = type(spark.sparkContext).broadcast

    def shipped(context, value):
        block = ship(context, value)
        end = block.destroy
        alive.append(block)
        most.append(len(alive))
        block.destroy = lambda *a: (alive.remove(block), end(*a))
        return block

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", shipped)
    items = spark.createDataFrame([(k, f"item {k} of some words") for k in range(4)], "item_id long, text string")
    found = decontaminate.find_matches(docs, items, block_words=5)
    assert len(most) == 4 and max(most) == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_words_whose_polynomial_hashes_collide_are_told_apart(spark):
    """Thue-Morse words over two letters and their complements collide under any polynomial hash modulo a power of two."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, f"x {word} y")], "doc_id long, text string")
    items = spark.createDataFrame([(9, other)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.digest(decontaminate.find_matches(docs, items)).collect()} == {1: 0, 2: 1, 3: 0}


def test_words_with_one_hash_are_compared_byte_by_byte(monkeypatch):
    test = decontaminate.TestBlock(["i"], ["one two three"], 10).ready()
    words = decontaminate.Words(np.frombuffer(b"one xyz three one two three", np.uint8), np.array([0, 27]))
    words.hash[1] = words.hash[4]      # "xyz" with the hash of "two"
    assert test.search(words)[0].tolist() == [3]


def test_repeated_items_are_one_window(spark):
    """A thousand equal items over ten thousand occurrences: the occurrences are found once, not once for each item."""
    text = " ".join(["red green blue"] * 10_000)
    docs = spark.createDataFrame([(1, text), (2, "red green"), (3, "blue red green blue")], "doc_id long, text string")
    rows = [(k, "red green blue") for k in range(1000)]
    found = decontaminate.digest(decontaminate.find_matches(docs, spark.createDataFrame(rows, "item_id long, text string"))).collect()
    names = hashlib.sha256(",".join(sorted(str(k) for k in range(1000))).encode()).hexdigest()
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"] == names) for r in found} == {
        1: (30_000, 1000, True), 2: (0, 0, False), 3: (3, 1000, True)}
    block = decontaminate.TestBlock([str(k) for k in range(1000)], ["red green blue"] * 1000, 10).ready()
    words = decontaminate.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    pos, length, window = block.search(words)
    assert len(pos) == 10_000 and set(block.longest(words, pos, window).tolist()) == {3}


def test_longest_match_over_several_items(spark):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[5:50]))], "doc_id long, text string")
    items = [(1, " ".join(words[:30])), (2, " ".join(words[:30])), (3, " ".join(words[20:45])), (4, " ".join([*words[5:17], "other"]))]
    (span,) = decontaminate.find_matches(docs, spark.createDataFrame(items, "item_id long, text string")).first()["hit_spans"]
    assert (span["begin"], span["end"], span["longest"]) == (0, 40, 25)


def test_longest_match_reaches_past_the_window(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[5:30]) + " c")], "doc_id long, text string")
    item = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    (span,) = decontaminate.find_matches(docs, item).first()["hit_spans"]
    assert (span["begin"], span["end"], span["longest"]) == (2, 27, 25)


def test_decontamination_without_items_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.digest(decontaminate.find_matches(docs, none)).collect())
    assert decontaminate.find_matches(no_docs, none).count() == 0


# -- URL rules of any size ---------------------------------------------------------------------------------------------


def test_rule_table_judges_as_the_trie_does(spark):
    r = random.Random(8)
    labels, paths = ["a", "b", "example", "co", "uk", "net", ""], ["/", "/x", "/x/", "/x/y", "/xy", "", "/é/", "/x/y/z"]
    rules = {(r.choice(["allow", "block"]), ".".join(r.choices(labels[:6], k=r.randrange(1, 4))), r.choice(paths)) for _ in range(120)}
    urls = [None, "", "no scheme", "http://", "x://?q", "http://A.Net/x\nrest/y", "a://b://c/x"]
    urls += [f"{r.choice(['http', ''])}://{'.'.join(r.choices(labels, k=r.randrange(0, 5))).upper()}{r.choice(paths)}{r.choice(['', 'z', '/q', '?a=/x', '#x'])}"
             for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls * 2)), "page_id long, url string")
    table = spark.createDataFrame(sorted(rules), "verdict string, host string, path string")
    a, b = url_filter.judge_urls(pages, sorted(rules)), url_filter.judge_urls_by_table(pages, table)
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    none = table.where("false")
    assert {x["verdict"] for x in url_filter.judge_urls_by_table(pages, none).collect()} == {"allow"}


# -- suffix dedup ------------------------------------------------------------------------------------------------------


def brute_removed(rows, width):
    """{id: [(n_bytes, n_removed, n_spans, kept)]}; None counts as greater than any id."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out, seen, k = defaultdict(list), set(), 0
    while k < len(order):
        same = [r for r in order[k:] if r[0] == order[k][0]]
        for i, t in same:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for p in range(len(b) - width + 1):
                if b[p:p + width] in seen:
                    gone[p:p + width] = b"\1" * width
            spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
            out[i].append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
        for _, t in same:
            b = (t or "").encode()
            seen.update(b[p:p + width] for p in range(len(b) - width + 1))
        k += len(same)
    return {i: sorted(v) for i, v in out.items()}


def removed(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    return {i: sorted(v) for i, v in got.items()}


@pytest.mark.parametrize(("width", "hot_runs"), [(24, 1 << 15), (50, 1 << 15), (50, 2), (50, 0), (128, 1 << 15)])
def test_repeats_removed(spark, docs, texts, width, hot_runs):
    got = suffix_dedup.remove_repeats(docs.repartition(5), width=width, hot_runs=hot_runs)
    assert [c for c in got.columns if c not in suffix_dedup.RESULT] == [c for c in docs.columns if c != "kept"]
    assert removed(got) == brute_removed(texts, width)


def test_repeats_with_null_ids_and_few_letters(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(12)]), "".join(r.choice("ab") for _ in range(r.randrange(400)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(suffix_dedup.remove_repeats(df)) == brute_removed(rows, 50)


def test_whole_characters_stay_whole(spark):
    passage = "äöü" * 40
    rows = [(1, "x" + passage), (2, "yy" + passage), (3, "ö" + passage + "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(df, whole_characters=True).collect():
        kept = bytes(r["kept"]).decode()
        assert len(kept.encode()) + r["n_removed"] == r["n_bytes"]


def test_repeats_of_no_documents(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize(("batch", "budget"), [(1 << 18, 1 << 28), (3, 64), (7, 1 << 28)])
def test_induced_sort_orders_suffixes_and_carries_prefixes(monkeypatch, batch, budget):
    monkeypatch.setattr(induced_sort, "_BATCH", batch)
    r = np.random.default_rng(batch)
    for _ in range(25):
        parts = [bytes(r.integers(97, 97 + r.integers(1, 5), r.integers(1, 60)).astype(np.uint8)) for _ in range(r.integers(1, 8))]
        parts += parts[:1] * 2
        depth = int(r.integers(3, 12))
        buf = np.frombuffer(b"".join(parts), np.uint8)
        got = list(induced_sort.sorted_suffixes(buf, np.cumsum([len(p) for p in parts]), depth, budget))
        suffix, common = (np.concatenate(x).tolist() for x in zip(*got, strict=True))
        marked = [x for p in parts for x in (*(b + 2 for b in p), 1)] + [0]
        heads = [marked[k:k + depth] for k in suffix]
        assert set(suffix) >= set(range(len(marked) - 1)) and heads == sorted(heads)
        for a, b, n in zip(heads, heads[1:], common[1:], strict=False):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(("batch", "queue"), [(1 << 18, 1 << 22), (1, 16), (3, 1 << 22), (16, 64)])
def test_least_ids_of_a_bucket_by_batches_and_queues_on_disk(monkeypatch, batch, queue):
    monkeypatch.setattr(induced_sort, "_BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "QUEUE_BYTES", queue)
    r = random.Random(batch)
    for _ in range(15):
        width = r.choice([3, 5, 8])
        parts = list({"".join(r.choices("ab" if r.random() < 0.5 else "abcd", k=r.randrange(width, 40))).encode() for _ in range(r.randrange(1, 9))})
        ids = [r.randrange(50) for _ in parts]
        least, at = suffix_dedup._bucket_suffixes(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), np.array(ids), width)
        best = defaultdict(lambda: 99)
        for p, i in zip(parts, ids, strict=True):
            for k in range(len(p) - width + 1):
                best[p[k:k + width]] = min(best[p[k:k + width]], i)
        for p, a in zip(parts, at.tolist(), strict=True):
            assert least[a: a + len(p) - width + 1].tolist() == [best[p[k:k + width]] for k in range(len(p) - width + 1)]


# -- packing -----------------------------------------------------------------------------------------------------------


def test_packing_is_an_exact_round_trip(docs, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), capacity=64, with_ids=True).collect()
    want = sorted((i, (*own.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in texts if i != 132)
    got, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert len(r["ids"]) == r["length"] <= 64 and (r["piece"] == 0 or r["length"] == 64)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] != 132:
            assert r["start"] == len(got[r["doc_id"]])
            got[r["doc_id"]] += r["ids"]
    assert sorted((i, tuple(x)) for i, x in got.items()) == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_rank_encoder_gives_the_tokenizer_ids(texts):
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(tokenizer_path()), packing._encoder(tokenizer_path())
    odd = ["a<|endoftext|>b", "  \n\n x\u00a0\u2003y \t", "I'm we'll 12³ ½ \u0301 \u200d👩‍👩‍👧 ٣٤ Ωß", "x" * 3000, " " * 3000, "\r\n \u3000\u2028z", "'S 'll’"]
    r = random.Random(1)
    odd += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1500), r.randrange(0x2000, 0x3100), 10, 32])) for _ in range(200))
            for _ in range(100)]
    for t in [*odd, *(t or "" for _, t in texts)]:
        assert list(encode(t)) == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_complete_and_few(seed):
    r = np.random.default_rng(seed)
    capacity = 100
    counts = np.bincount(r.integers(1, [30, 60, 101, 101, 15, 51][seed], 400), minlength=capacity + 1)
    made = packing.complete_bins(counts, capacity)
    used = np.zeros_like(counts)
    for items, times in made:
        assert sum(items) <= capacity
        np.add.at(used, list(items), times)
    assert (used == counts).all()
    bins = sum(n for _, n in made)
    assert bins <= sum(n for _, n in packing.best_fit(counts, capacity))
    over_half = int(counts[51:].sum())
    assert bins <= 1.02 * max(over_half, -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)) + 1


@pytest.mark.parametrize("n", [1, 7, 300])
def test_completion_returns_to_other_fillings(n):
    counts = np.zeros(2049, np.int64)
    counts[[916, 838, 816, 674, 636, 596, 570, 562, 536]] = n
    assert sum(k for _, k in packing.complete_bins(counts, 2048)) == 3 * n == packing.lower_bound(counts, 2048)


def fewest_bins(items, capacity):
    """By trying every place of every item, the largest first."""
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms) if room >= items[k]}.values():
            place(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1:]])
        place(k + 1, [*rooms, capacity - items[k]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


def test_completion_is_optimal_on_small_inputs():
    r = np.random.default_rng(0)
    for _ in range(300):
        capacity = int(r.integers(10, 60))
        items = r.integers(max(1, capacity // 8), capacity * 2 // 3 + 1, int(r.integers(3, 13))).tolist()
        counts = np.bincount(items, minlength=capacity + 1)
        made = packing.complete_bins(counts, capacity)
        assert sum(k for _, k in made) == fewest_bins(items, capacity) >= packing.lower_bound(counts, capacity)
        assert sorted(s for f, k in made for s in f * k) == sorted(items) and all(sum(f) <= capacity for f, _ in made)


def test_least_waste_beyond_the_node_limit(monkeypatch):
    counts = np.bincount([997, 601, 499, 303, 205, 107], minlength=2049)
    want = packing._filling(counts, 1500, np.flatnonzero(counts))
    monkeypatch.setattr(packing, "NODES", 1)
    assert sum(packing._filling(counts, 1500, np.flatnonzero(counts))) == sum(want) == 1496


def test_packing_no_documents(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


# -- url filter --------------------------------------------------------------------------------------------------------


def brute_verdict(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fit = [(h.count("."), len(p), v, h + p) for v, h, p in url_filter.CONTRACT_RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_judged(spark):
    urls = [None, "", "net/", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "x://Example.NET/en/1", "x://example.net/EN/1",
            "x://a.example.net/en/?q", "x://notexample.net/en/", "x://example.com/de/", "x://b.example.com/de", "x://org/fr/a#b",
            "x://w.org/fr", "x://w.org?/fr/", "x://é.org/fr/", "a://b://c.net/", "x://example.net./en/", "x://example.net:80/en/", "x:///net/"]
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_filter.judge_urls(df, url_filter.CONTRACT_RULES).collect()}
    assert got == {k: brute_verdict(u) for k, u in enumerate(urls)}
    assert url_filter.judge_urls(df.where("false"), url_filter.CONTRACT_RULES).count() == 0


def test_rule_paths_may_end_within_a_segment_and_block_wins_ties():
    trie = url_filter.build_trie([("allow", "a.b", "/x/ab"), ("block", "b", "/x"), ("allow", "b", "/x"), ("block", "a.b", "/x/abc")])
    assert url_filter.longest_match(trie, "z.a.b", "/x/abd/") == ("a.b/x/ab", "allow")
    assert url_filter.longest_match(trie, "z.a.b", "/x/abcd") == ("a.b/x/abc", "block")
    assert url_filter.longest_match(trie, "z.a.b", "/xyz") == ("b/x", "block")
    assert url_filter.longest_match(trie, "b.c", "/x") is None
