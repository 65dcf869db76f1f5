import bisect
import collections
import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import catalog, dedup, quality, sharding, urls
from cohortlens.llm.common import materialize

DATA = "/root/testdata/sf0.001"


def oracle(name):
    with duckdb.connect() as con:
        for t in ("documents", "labels", "pages", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        rel = con.sql(catalog.ORACLE[name])
        return rel.columns, rel.fetchall()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, name):
    columns, want = oracle(name)
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


# --- quality ---------------------------------------------------------------

def brute_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_measures_by_brute_force(spark, edge):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "\nx\nx\n"]) for _ in range(60)]
    frame = edge.select("text", "n_words").unionByName(spark.createDataFrame([(t, 1) for t in texts], "text string, n_words int"))
    rows = quality.measure(frame).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measure(r.text)


def cdf(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_exact_binomial_limit(spark):
    for n, p, level in [(0, .1, .05), (10, .1, .05), (28, .1, .06), (400, .02, .01), (1500, .004, .0025), (2000, .05, 1e-6)]:
        got = spark.range(1).select(F.lit(n).cast("long").alias("n")).select(
            quality._most(F.col("n"), p, F.lit(math.log(level))).alias("k")).first().k
        want = max((k for k in range(int(n * p) + 1) if cdf(k, n, p) <= level), default=-1)
        assert got == want, (n, p, level)


def test_cutoffs_hold_the_bound_and_spare_small_strata(spark):
    good, bad = "plain words " * 30, "plain # % " * 30
    rows = [(i, good if i % 6 else bad, "en", int(i % 6 != 0)) for i in range(6000)] + [(i, bad, "xx", 1) for i in range(6000, 6030)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, q int").withColumn(
        "text", F.concat("text", F.col("doc_id").cast("string")))  # no word window twice
    made = made.withColumn("text", F.array_join(F.transform(F.split("text", " "), lambda w, i: F.concat(w, i.cast("string"))), " "))
    measured = materialize(quality.measure(made), "t")
    cut = quality.thresholds(measured, made.select("doc_id", F.col("q").alias("quality")), quality.language())
    rules = cut.collect()
    assert {r.stratum for r in rules} == {"en"} and any(r.rule == "symbols" for r in rules)
    for r in rules:
        assert r.good_rejected == 0 and r.bad_rejected == 1000
    kept = {r.doc_id for r in quality.judge(measured, cut, quality.language()).where("kept").collect()}
    assert kept == {r[0] for r in rows if r[3]}


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (77, 1)], "doc_id long, quality int")
    for frame in (edge, nothing):
        m = quality.measure(frame)
        cut = quality.thresholds(m, labels, quality.language())
        assert quality.judge(m, cut, quality.language()).count() == frame.count()
    assert quality.judge(quality.measure(edge), quality.thresholds(quality.measure(edge), labels.limit(0), quality.language()),
                         quality.language()).where("kept").count() > 0


# --- sharding --------------------------------------------------------------

def best_capacity(sizes, shards):
    def need(c):
        n, used = 1, 0
        for s in sizes:
            if used + s > c:
                n, used = n + 1, 0
            used += s
        return n
    return next(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= shards)


@pytest.mark.parametrize("bits, refined", [(14, 1 << 16), (4, 1 << 14)])
def test_minimax_capacity_by_brute_force(spark, monkeypatch, bits, refined):
    monkeypatch.setattr(sharding, "RANGE_BITS", bits)
    monkeypatch.setattr(sharding, "REFINED", refined)
    rng = random.Random(9)
    for trial in range(2):
        rows = [(rng.choice([rng.getrandbits(64) - 2**63, trial, 5 << 40]), rng.randint(1, 60)) for _ in range(150)]
        groups = collections.Counter()
        for h, s in rows:
            groups[h] += s
        sizes = [groups[h] for h in sorted(groups)]
        frame = spark.createDataFrame(rows, "h long, size long")
        for shards in (3, 8):
            cuts, capacity = sharding.minimax_cuts(frame, shards)
            assert capacity == best_capacity(sizes, shards)
            loads = collections.Counter()
            for h, s in rows:
                loads[sum(h >= c for c in cuts)] += s
            assert max(loads.values()) <= capacity and len(cuts) < shards


def test_refining_rounds_read_a_group_once(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REFINED", 1 << 8)
    rng = random.Random(4)
    rows = [(7 << 40, 3)] * 3000 + [(rng.getrandbits(64) - 2**63, rng.randint(1, 60)) for _ in range(200)]
    within, read = sharding._within, []

    def counted(*args):
        frame = within(*args)
        read.append(frame.count())
        return frame

    monkeypatch.setattr(sharding, "_within", counted)
    cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(rows, "h long, size long"), 8)
    assert capacity == 9000
    assert read and max(read) <= 201


@pytest.mark.parametrize("hot", [0.1, 0.115, 0.124])
def test_a_group_of_less_than_a_share_opens_few_ranges(spark, monkeypatch, hot):
    rng = random.Random(11)
    groups = {rng.getrandbits(64) - 2**63: rng.randint(200, 2000) for _ in range(20_000)}
    groups[sorted(groups)[10_000]] = round(sum(groups.values()) * hot / (1 - hot))
    within, read = sharding._within, []

    def counted(*args):
        frame = within(*args)
        read.append(frame.count())
        return frame

    monkeypatch.setattr(sharding, "_within", counted)
    cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(list(groups.items()), "h long, size long"), 8)
    hashes = sorted(groups)
    at = [0, *itertools.accumulate(groups[h] for h in hashes)]

    def ends(limit):
        found = [0]
        while found[-1] < len(hashes):
            found.append(bisect.bisect_right(at, at[found[-1]] + limit) - 1)
        return found[1:]

    assert len(ends(capacity)) <= 8 < len(ends(capacity - 1))
    assert cuts == [hashes[i] for i in ends(capacity)[:-1]]
    assert len(read) <= 3 and sum(read) <= 1000


def test_shards_and_slots(spark, edge, nothing, small_docs):
    for frame in (edge, small_docs):
        rows = sharding.shard(frame, 8).collect()
        assert len(rows) == frame.count() and {r.law for r in rows} == {"bytes"}
        for _, part in itertools.groupby(sorted(rows, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
            assert [r.slot for r in part] == list(range(len([x for x in rows if x.shard == _])))
        text = {r.doc_id: r.text or "" for r in frame.collect() if r.doc_id is not None}
        home = {}
        for r in rows:
            if r.doc_id is not None:
                assert r["size"] == len(text[r.doc_id].encode()) + 1
                assert home.setdefault(text[r.doc_id], r.shard) == r.shard
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert set(loads) == set(range(8))
    assert sharding.shard(nothing, 8).collect() == []


@pytest.mark.parametrize("hot", [0, 1 / 3, 1 / 2, 1])
def test_capacity_with_a_hot_group(spark, hot):
    """Least capacity over at least 50,000 groups in hash order, a share of the rows being one text."""
    n, shards = 60_000, 8
    first = round(n * hot) if hot < 1 else n
    docs = spark.range(n).selectExpr("id AS doc_id", f"IF(id < {first}, 'the hot text', concat('text ', id, repeat('x', int(id % 50)))) AS text")
    if hot in (1 / 3, 1 / 2):  # enough other groups
        docs = docs.unionByName(spark.range(n, 2 * n).selectExpr("id AS doc_id", "concat('more ', id) AS text"))
    rows = sharding.shard(docs, shards).select("size", "text_crc32", "shard", "slot").collect()
    groups = docs.selectExpr("xxhash64(text) AS h", "octet_length(text) + 1 AS size").groupBy("h").sum("size").orderBy("h").collect()
    sizes = [g[1] for g in groups]

    def needed(capacity):
        used, room = 0, 0
        for x in sizes:
            if x > room:
                used, room = used + 1, capacity
            room -= x
        return used

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid + 1, high)
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(loads.values()) == low and set(loads) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- urls ------------------------------------------------------------------

def test_a_host_of_half_a_million_labels(spark):
    long = "http://" + "a." * 500_000 + "b.example.com/en/x"
    rows = [(1, long), (2, "http://www.example.com/en/"), (3, "http://" + "x" * 1_000_000 + "/"), (4, "http://net/es/" + "p" * 1_000_000)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(
        spark.createDataFrame(rows, "page_id long, url string"), urls.rules(spark, catalog.URL_RULES)).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: (None, "allow"), 4: ("net/es/", "block")}


def brute_url(url, entries):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in entries
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_urls_by_brute_force(spark):
    rng = random.Random(10)
    hosts = ["com", "example.com", "www.example.com", "Net", "a.b.net", "xexample.com", "", "é.com", "com.", "..com"]
    paths = ["", "/", "/en/", "/en", "/es/x?y#z", "/fr/", "?q", "#f", "/en/?://", "/%65n/\n"]
    made = [s + h + p for s in ("http://", "://", "x", "HTTPS://") for h in hosts for p in paths] + [None, "", "http://"]
    entries = catalog.URL_RULES + [(f"h{i}.com", "/p" * rng.randint(0, 3), rng.choice(["allow", "block"])) for i in range(300)]
    entries = list({(h, p): (h, p, v) for h, p, v in entries}.values())
    made += [f"http://x.h{i}.com/p/p/q" for i in range(320)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(made + made[:50])], "page_id long, url string, rule string")
    for given in (catalog.URL_RULES, entries):
        got = urls.judge(pages, urls.rules(spark, given)).collect()
        assert len(got) == len(made) + 50
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url, given), r.url
    empty = urls.rules(spark, entries).limit(0)
    assert {r.verdict for r in urls.judge(pages, empty, default="block").collect()} == {"block"}
    assert urls.judge(pages.limit(0), urls.rules(spark, entries)).collect() == []


def test_bloom_filter_has_no_false_negative(spark):
    listed = urls.rules(spark, [(f"h{i}.org", "/", "block") for i in range(500)])
    block, masks = urls._bits(F.col("host"), F.col("path"), F.lit(16).cast("long"))
    keys = listed.withColumns({"block": block, "m": masks}).join(urls.bloom_blocks(listed, 16), "block").collect()
    assert len(keys) == 500
    assert all(r[f"w{w}"] & r.m[w] == r.m[w] for r in keys for w in range(urls.WORDS))


# --- exact dedup -----------------------------------------------------------

def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r)
    ids = {t: max((r.doc_id for r in g if r.doc_id is not None), default=None) for t, g in groups.items()}
    return groups, ids


@pytest.mark.parametrize("digest", [dedup.sha256, lambda t: F.encode(F.left(t, F.lit(2)), "UTF-8")])
def test_dedup_by_brute_force(spark, edge, digest):
    rows = edge.collect()
    groups, ids = brute_dedup(rows)
    found = dedup.deduplicate(edge, digest=digest)
    got = found.decisions().collect()
    want = sorted(repr((r.doc_id, ids[r.text or ""], len(groups[r.text or ""]))) for r in rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = found.kept()
    assert kept.columns == edge.columns
    left = kept.collect()
    assert sorted((r.text or "") for r in left) == sorted(groups)
    assert all(r.doc_id == ids[r.text or ""] for r in left)
    assert all(r.digest == "d" and r.label == 7 for r in left)


def test_state_goes_on_with_more_rows(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "a"), (4, "c"), (0, "b")], "doc_id long, text string")
    state = str(tmp_path / "state")
    dedup.deduplicate(first, state_dir=state)
    got = dedup.deduplicate(first.unionByName(second), state_dir=str(tmp_path / "whole")).decisions().collect()
    later = dedup.deduplicate(second, state_dir=state).decisions().collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in later) == sorted(
        (r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)


def weak(text):
    return F.unhex(F.md5(F.substring(text, 1, 1).cast("binary")))


def test_bytes_are_compared_across_calls(spark, tmp_path):
    """A digest of the first letter: apple and axe meet in one digest, over two calls."""
    frames = [[(1, "apple"), (2, "bean"), (3, "apple")], [(4, "axe"), (5, "bean"), (6, "apple"), (7, "axe")]]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in frames]
    state = str(tmp_path / "state")
    dedup.deduplicate(frames[0], digest=weak, state_dir=state)
    got = dedup.deduplicate(frames[1], digest=weak, state_dir=state).decisions().collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {
        (1, 6, 3, False), (3, 6, 3, False), (6, 6, 3, True), (4, 7, 2, False), (7, 7, 2, True), (2, 5, 2, False), (5, 5, 2, True)}


def test_a_repeated_call_adds_nothing(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    dedup.deduplicate(docs.where("doc_id < 3"), state_dir=state)
    for _ in range(2):  # the rest of the file is new once
        got = dedup.deduplicate(docs, state_dir=state).decisions().collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]
    frame = spark.createDataFrame([(9, "b")], "doc_id long, text string")
    for _ in range(2):  # a frame that is in no file is known by its call's name
        got = dedup.deduplicate(frame, state_dir=state, call="later").decisions().collect()
        assert (2, 9, 2) in {(r.doc_id, r.keep_id, r.group_size) for r in got} and len(got) == 4


def test_any_column_names(spark):
    """Columns named like those used inside come out as they went in."""
    names = ["__file", "__row", "file", "row", "doc", "text2", "digest", "__w", "__t", "__doc", "__made", "__head", "__b", "__hit",
             "__bucket", "page", "rates", "by", "__stratum", "__cut", "keep", "n"]
    rows = [(1, "http://a.net/es/x", "http://a.net/es/x", *range(len(names))), (2, "other " * 30, None, *range(len(names)))]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, url string", *(f"{n} int" for n in names)]))
    frame = frame.withColumn("lang", F.lit("en"))
    want = {r.doc_id: tuple(r[n] for n in names) for r in frame.collect()}
    measured = quality.measure(frame)
    cutoffs = quality.thresholds(measured, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), quality.language())
    for out in (measured, quality.judge(measured, cutoffs, quality.language()), dedup.deduplicate(frame).kept(),
                urls.judge(frame, urls.rules(spark, catalog.URL_RULES))):
        assert {r.doc_id: tuple(r[n] for n in names) for r in out.collect()} == want


def test_dedup_of_nothing(nothing):
    found = dedup.deduplicate(nothing)
    assert found.decisions().collect() == [] and found.kept().collect() == []


# --- plans -----------------------------------------------------------------

@pytest.mark.parametrize("name", ["op3_quality", "op8_sharding", "op9_urls", "op10_exact_dedup"])
def test_native_queries_run_no_python_and_no_cross_join(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
