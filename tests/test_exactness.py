"""Cases in which a job and its SQL twin could agree and both be wrong."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyleaf.functions import dates as dt
from tallyleaf.operators import expiry, fields, monitoring, regions, services
from tallyleaf.operators import text as tops
from tallyleaf.operators.scale import literal_table
from tallyleaf.streaming import stateful

START = datetime(2024, 1, 1)


def test_defaults_hold_for_tenants_without_an_override(spark):
    layers = spark.createDataFrame([(None, "p", 0, 1, "d"), (1, "p", 1, 1, "o"), (None, "q", 0, 1, "x"), (None, "q", 0, 2, "y")],
                                   "tenant_id long, path string, level int, version int, value string")
    got = {tuple(r) for r in services.resolve_layers(layers).collect()}
    assert got == {(1, "p", "o", "override"), (None, "p", "d", "default"), (None, "q", "y", "default")}


def test_gaps_end_a_firing_run(spark):
    def points(seconds):
        return spark.createDataFrame([("r", START + timedelta(seconds=s), True) for s in seconds], "rule string, ts timestamp, hit boolean")

    assert monitoring.firing_spans(points([0, 7470]), ["rule"], "hit", 300, 30).count() == 0
    assert monitoring.firing_spans(points([*range(0, 331, 30), 7470]), ["rule"], "hit", 300, 30).collect()[0].held_seconds == 330


@pytest.mark.parametrize("turned", [False, True])
def test_top_level_value_wins_over_a_nested_one(spark, turned):
    truth = spark.createDataFrame([(1, "brand", "c", "Acme")], "doc_id long, field string, category string, value string")
    rows = [(1, "brand", "Acme"), (1, "category_info.brand", "Other")]
    predicted = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, field string, value string").coalesce(1)
    assert fields.compare_fields(truth, predicted).collect()[0].match_type == "exact"


def test_heaviest_reading_is_the_last_resort(spark):
    rows = [(1, "second", "some text", 0.3), (1, "first", "x", 0.35), (2, "second", "", 0.3), (3, "first", "seen", 0.1)]
    got = {r.doc_id: (r.source, r.text) for r in fields.engine_precedence(
        spark.createDataFrame(rows, "doc_id long, engine string, text string, confidence double"), ["doc_id"]).collect()}
    assert got == {1: ("second_fallback", "some text"), 2: ("none", ""), 3: ("first_fallback", "seen")}


def test_masks_and_leaks_walk_maps_and_nested_arrays(spark):
    df = spark.createDataFrame([({"note": "call 13800138000"}, [["mail me@x.org"]], 5)], "m map<string,string>, a array<array<string>>, n int")
    out = tops.mask_table(df).collect()[0]
    assert "13800138000" not in out.m["note"] and "me@x.org" not in out.a[0][0] and out.n == 5
    leaks = {r.path for r in tops.leak_paths(df).collect()}
    assert leaks == {"root.m.note", "root.a[0][0]"}
    assert tops.leak_paths(df.select("n")).count() == 0


def test_two_digit_years(spark):
    rows = spark.createDataFrame([("01/15/99",), ("1/5/24",), ("2/29/72",), ("12/31/68",)], "t string")
    got = {r.t: (r.l, str(r.d)) for r in rows.select("t", dt.layout_and_date(F.col("t"))["layout"].alias("l"), dt.parse_date(F.col("t")).alias("d")).collect()}
    assert got == {"01/15/99": ("us_short", "1999-01-15"), "1/5/24": ("us_short", "2024-01-05"), "2/29/72": ("us_short", "1972-02-29"), "12/31/68": ("us_short", "2068-12-31")}


def test_percentiles_with_null_keys_and_endless_values(spark):
    rows = [(None, 1.0), (None, 2.0), ("/a", math.inf), ("/a", 3.0), ("/a", -math.inf), ("/a", 0.0), ("/a", math.nan)]
    got = {r.endpoint: (r.p50, r["count"]) for r in monitoring.latency_percentiles(
        spark.createDataFrame(rows, "endpoint string, duration_ms double"), ["endpoint"]).collect()}
    assert got == {None: (2.0, 2), "/a": (3.0, 5)}


def test_regions_without_a_page_stay(spark):
    rows = spark.createDataFrame([(None, 1, 0.1), (None, 2, 0.05), (7, 3, 0.9)], "doc_id long, region_id long, confidence double")
    assert {r.region_id for r in regions.drop_weak(rows).collect()} == {1, 3}


@pytest.mark.parametrize("alpha", [0.3, 0.01])
def test_smoothing_over_all_events(spark, alpha):
    rows = [("busy", START + timedelta(seconds=30 * i), i, i % 3 != 0, float(i % 50)) for i in range(1000)] + [(None, START, 1, True, 5.0)]
    calls = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, success boolean, latency_ms double")
    ok, ms = 1.0, 0.0
    for _, _, _, s, x in rows[:1000]:
        ok, ms = alpha * s + (1 - alpha) * ok, alpha * x + (1 - alpha) * ms
    got = {r.tenant_id: r for r in stateful.smoothed(calls, "tenant_id", alpha).collect()}
    assert got["busy"].success_rate == pytest.approx(ok) and got["busy"].response_ms == pytest.approx(ms) and got[None].success_rate == pytest.approx(1.0)


def test_cycles_are_errors_and_long_chains_are_not(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node_id long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    got = {r.node_id: (r.root, r.depth) for r in services.roots_and_depth(nodes, chain).collect()}
    assert got == {i: (0, i) for i in range(40)}
    with pytest.raises(ValueError):
        services.roots_and_depth(nodes.where("node_id < 3"), spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"))


def test_healthy_response_starts_with_the_first_time_that_is_not_zero(spark):
    rows = [(1, 1, True, 0.0), (1, 2, True, 10.0), (1, 3, False, 900.0), (1, 4, True, 0.0), (1, 5, True, 20.0), (2, 6, True, 0.0), (None, 7, True, 4.0)]
    calls = literal_table(spark, rows, "tenant_id bigint; request_id bigint; success boolean; latency_ms double").withColumn("ts", F.timestamp_seconds("request_id"))
    got = {r.tenant_id: (r.calls, round(r.response_ms, 6)) for r in stateful.healthy_response(calls, "tenant_id").collect()}
    assert got == {1: (4, round((10 * .7 + 0 * .3) * .7 + 20 * .3, 6)), 2: (1, 0.0), None: (1, 4.0)}


def test_dates_in_texts(spark):
    rows = [(1, "made 2000-01-02 and 生产日期：1999-12-01 有效期至：2000/6/15"), (2, "only 20000501 here"), (3, "no date"), (4, "2001年1月5日 and 2001-01-05")]
    out = expiry.dates_in_texts(literal_table(spark, rows, "doc_id bigint; text string"), F.lit("2000-06-01").cast("date"))
    got = {r.doc_id: (str(r.production_date), str(r.expiry_date), r.status) for r in out.collect()}
    assert got == {1: ("1999-12-01", "2000-06-15", "near_expiry"), 2: ("None", "2000-05-01", "expired"), 3: ("None", "None", "unknown"), 4: ("None", "2001-01-05", "valid")}


def test_alert_points_of_all_rules(spark):
    requests = literal_table(spark, [(0, "/a", 500, 7.0), (10, "/a", 200, 7.0)], "s bigint; endpoint string; status_code int; seconds double").withColumn("ts", F.timestamp_seconds("s"))
    runs = literal_table(spark, [(0, True), (0, False)], "s bigint; fallback boolean").withColumn("ts", F.timestamp_seconds("s"))
    hits = spark.range(3001).select(F.timestamp_seconds(F.lit(0)).alias("ts"))
    points = monitoring.alert_points(requests, runs, hits).groupBy("rule").agg(F.count("*").alias("n"), F.min("breach").alias("all"), F.max("value").alias("v"))
    got = {r.rule: (r.n, r.all, round(r.v, 3)) for r in points.collect()}
    assert got == {"error_share": (10, True, .5), "hourly_error_share": (120, True, .5), "fallback_share": (20, True, .5),
                   "limiter_hits": (10, True, 10.003), "p95_latency": (10, True, 9.75)}


def test_exact_columns_are_the_best_cut(spark):
    import itertools
    import random

    from tallyleaf.operators.regions import exact_columns

    rnd, rows, want = random.Random(2), [], {}
    for page in range(40):
        groups = rnd.randint(1, 6)
        xs = [rnd.randint(0, 30) + 200 * rnd.randrange(groups) for _ in range(rnd.randint(1, 11))]
        rows += [(page, i, float(x), float(x + 10)) for i, x in enumerate(xs)]
        order = sorted((x + 5.0, i) for i, x in enumerate(xs))

        def scatter(run):
            mean = sum(x for x, _ in run) / len(run)
            return sum((x - mean) ** 2 for x, _ in run)

        best = None
        for k in range(2, 6):
            ways = [[order[a:b] for a, b in zip((0, *cut), (*cut, len(order)))] for cut in itertools.combinations(range(1, len(order)), k - 1)]
            least = min((sum(map(scatter, w)) for w in ways), default=None)
            if least is not None and least < 100 * len(order):
                best = k, least
                break
        want[page] = best, order
    got = {}
    for r in exact_columns(spark.createDataFrame(rows, "doc_id long, region_id long, x1 double, x2 double")).collect():
        got.setdefault(r.doc_id, {})[r.region_id] = (r.column_no, r.columns)
    for page, (best, order) in want.items():
        numbers = [got[page][i][0] for _, i in order]
        assert numbers == sorted(numbers) and {c for _, c in got[page].values()} == {best[0] if best else 1}
        if best:
            runs = [[o for o, n in zip(order, numbers) if n == k] for k in range(best[0])]
            assert abs(sum(map(scatter, runs)) - best[1]) < 1e-6


def test_embedding_clusters_gather_what_is_near(spark):
    import random

    from tallyleaf.operators.regions import vector_clusters

    rnd = random.Random(3)
    rows = [(i, [float(k == i % 4) * 5 + rnd.gauss(0, 0.2) for k in range(4)]) for i in range(200)] + [(900, None), (901, [None] * 4)]
    out = {r.vec_id: (r.cluster, r.distance) for r in vector_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4).collect()}
    assert len(out) == 200 and len({c for c, _ in out.values()}) == 4
    assert all(len({out[i][0] for i in range(200) if i % 4 == k}) == 1 for k in range(4)) and max(d for _, d in out.values()) < 0.5


def test_agreement_links_equal_all_pairs(spark):
    import random

    from tallyleaf.operators.fields import agreement_links

    rnd = random.Random(6)
    words = ["Alpha", "beta", "Gamma!", "ß", "é", "Zulu", "x1", "quick", "lazy", ",", "日本"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(150)] + [" ".join(rnd.choice(words[:6]) for _ in range(20)) for _ in range(150)]
    texts += ["", None, "a", "A", "aa", "b", "same text", "Same Text", " "]

    def agree(a, b):
        if not a or not b:
            return 0.0
        a, b = a.lower(), b.lower()
        return 1.0 if a == b else 0.6 * (len(set(a) & set(b)) / len(set(a) | set(b))) + 0.4 * (min(len(a), len(b)) / max(len(a), len(b)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for threshold in (0.8, 0.95, 1.0):
        got = {r.doc_id: (r.links, r.best and round(r.best, 9)) for r in agreement_links(docs, threshold, salts=3).collect()}
        for i, a in enumerate(texts):
            scores = [agree(a, b) for j, b in enumerate(texts) if j != i]
            near = [s for s in scores if s >= threshold]
            assert got[i] == (len(near), round(max(near), 9) if near else None)
    assert agreement_links(docs.limit(0)).count() == 0


def test_close_sets_equal_all_pairs(spark):
    import random

    from tallyleaf.operators.fields import close_sets

    rnd = random.Random(11)
    sets = set()
    for most in (3, 12, 25, 46, 150):
        base = rnd.sample([chr(c) for c in [*range(10, 11), *range(32, 127), *range(0x4E00, 0x4E00 + 600), 0x1F600, 0x1F601]], most)
        for _ in range(20):
            gone = set(rnd.sample(base, rnd.randint(0, max(1, most // 15))))
            sets.add("".join(sorted(set(base) - gone | set(rnd.sample("abcdefghij\n😀", rnd.randint(0, 1 + most // 40))))))
    sets = sorted(sets - {""})
    for share in (0.5 / 0.6, 0.55 / 0.6 - 1e-9, 1 - 1e-9):
        want = {(a, b): (len(set(a) & set(b)), len(set(a) | set(b))) for a in sets for b in sets if a != b and len(set(a) & set(b)) >= share * len(set(a) | set(b))}
        rows = close_sets(spark.createDataFrame([(s,) for s in sets], "set string"), share, 3).collect()
        assert {(r.set, r.set2): (r.shared, r.joint) for r in rows} == want and len(rows) == len(want)
        assert want or share > 0.99


def test_agreement_counts_lengths_without_pairs_of_them(spark):
    """3 000 lengths of one set of characters are 9 million pairs; each length's partners are an interval."""
    import bisect

    from tallyleaf.operators.fields import agreement_links

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") + 1000).cast("int")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(9000, "a" * 1000), (9001, "a" * 4), (9002, "ab" * 600)], "doc_id long, text string"))
    got = {r.doc_id: (r.links, r.best) for r in agreement_links(docs).collect()}
    lengths = sorted([i + 1000 for i in range(3000)] + [1000])
    for i in range(0, 3000, 7):
        n = i + 1000
        agree = lambda m: 0.6 + 0.4 * (min(n, m) / max(n, m)) >= 0.95
        low = bisect.bisect_left(range(n), True, key=agree)
        high = n + bisect.bisect_left(range(n, 2 * n), True, key=lambda m: not agree(m))
        links = bisect.bisect_left(lengths, high) - bisect.bisect_left(lengths, low) - 1
        assert got[i] == (links, 1.0 if i == 0 else 0.6 + 0.4 * max((n - 1) / n, n / (n + 1) if i < 2999 else 0))
    assert got[9000] == (got[0][0], 1.0) and got[9001] == (0, None) and got[9002] == (0, None)


def walked_columns(x):
    import numpy as np

    for k in range(2, 6):
        if len(x) < k:
            break
        centers = np.quantile(x, (np.arange(k) + 0.5) / k)
        for _ in range(100):
            near = np.abs(x[:, None] - centers).argmin(axis=1)
            moved = np.array([x[near == i].mean() if (near == i).any() else centers[i] for i in range(k)])
            if np.allclose(moved, centers, atol=1e-9):
                break
            centers = moved
        near = np.abs(x[:, None] - centers).argmin(axis=1)
        if ((x - centers[near]) ** 2).sum() < len(x) * 100:
            return centers.argsort(kind="stable").argsort(kind="stable")[near].tolist()
    return [0] * len(x)


def test_columns_of_pages_together_equal_page_by_page(spark):
    import numpy as np

    from tallyleaf.operators.regions import assign_columns

    rnd, pages = np.random.default_rng(5), []
    for i in range(400):
        n = int(rnd.integers(1, 60 if i % 9 else 5))
        pages.append((rnd.integers(0, 1 + i % 6, n) * 200 + rnd.integers(0, 1 + i % 70, n)) / 2 + (i % 3) * 1000)
    want = [walked_columns(x) for x in pages]
    assert {max(w) for w in want} == {0, 1, 2, 3, 4}
    rows = [(p if p else None, r, float(x), float(x)) for p, page in enumerate(pages) for r, x in enumerate(page.tolist())]
    df = spark.createDataFrame(rows, "doc_id long, region_id long, x1 double, x2 double").repartition(3)
    for at_once in (1, 50, 100_000):
        got = {(r.doc_id or 0, r.region_id): r.column_no for r in assign_columns(df, at_once=at_once).collect()}
        assert got == {(p, r): c for p, w in enumerate(want) for r, c in enumerate(w)}
    with pytest.raises(Exception, match="page 7 did not settle in 1 rounds"):
        assign_columns(spark.createDataFrame([(7, i, float(x), float(x)) for i, x in enumerate((0, 1, 50, 400, 3000))], "doc_id long, region_id long, x1 double, x2 double"), most_rounds=1).collect()


def walked_mask(text, kind):
    import hashlib
    import re

    from tallyleaf import fixed_values as fv
    from tallyleaf.functions.text import sensitive_pattern

    def partial(m):
        n = len(m)
        return "*" * n if n <= 2 else m[0] + "*" * (n - 2) + m[-1] if n <= 6 else m[:2] + "*" * (n - 4) + m[-2:]

    for name in fv.SENSITIVE_PATTERNS:
        change = partial if kind == "partial" else lambda m: f"***{hashlib.md5(m.encode()).hexdigest()[:8]}***"
        text = re.sub(sensitive_pattern(name), lambda m, change=change: change(m[0]), text, flags=re.ASCII)
    return text


def test_masking_queries_as_a_whole(spark):
    import hashlib
    import re

    from tallyleaf import fixed_values as fv
    from tallyleaf.functions.text import sensitive_pattern
    from tallyleaf.plans import all_queries

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    nested = {r.doc_id: tuple(r)[1:] for r in all_queries()["X15_nested_mask"](spark, folder).collect()}
    assert nested == {r.doc_id: (hashlib.md5(walked_mask(r.text, "hash").encode()).hexdigest(), walked_mask(r.lang, "hash"), walked_mask(r.source, "hash")) for r in rows}

    def holds(text):
        return any(re.search(sensitive_pattern(n), text, re.ASCII) for n in fv.SENSITIVE_PATTERNS)

    want = {}
    for r in rows:
        masked, counts = walked_mask(r.text, "partial"), want.setdefault(r.source, [0, 0, 0])
        for k, hit in enumerate((holds(r.text), holds(masked), masked != r.text)):
            counts[k] += hit
    got = {r.source: [r.before, r.after, r.changed] for r in all_queries()["X15_partial_mask"](spark, folder).collect()}
    assert got == want and sum(c[2] for c in want.values()) > 0


def test_rule_for_latin_names_is_tried_once_a_run():
    """The same first match as the plain rule, on texts of its own characters; a long text without marks costs no square."""
    import re
    import time

    from tallyleaf import fixed_values as fv
    from tallyleaf.operators.fields import LATIN_RUN, once_a_run

    rules = [p for ps in fv.FIELD_RULES.values() for p in ps if p.startswith(LATIN_RUN)]
    rnd, flags = random.Random(5), re.IGNORECASE | re.MULTILINE | re.ASCII
    parts = ["Co", ".", "Inc.", "Ltd.", "Company", "group", "a", "B", "7", " ", "\n", ",", "厂", "Corp.", "é", "-"]
    assert rules
    for p in rules:
        for _ in range(20000):
            text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
            a, b = re.search(p, text, flags), re.search(once_a_run(p), text, flags)
            assert (a and a.span(1)) == (b and b.span(1)), text
        start = time.time()
        assert re.search(once_a_run(p), "word " * 40000, flags) is None and time.time() - start < 5


def test_lines_without_han_keep_their_latin_ingredients():
    from tallyleaf import fixed_values as fv
    from tallyleaf.operators.free_form import without_han

    assert [without_han(p) for p in fv.FREE_INGREDIENTS][:2] == [None, "(?:VC|MIT|CMIT)"] and without_han(fv.FREE_INGREDIENTS[2]) == fv.FREE_INGREDIENTS[2]


def test_written_dates_are_read_once_a_row(spark):
    df = entry.queries()["X06_expiry_dates"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract") < 24


def test_characters_are_counted_by_runs(spark):
    from pyspark.sql import functions as F
    from tallyleaf.functions.text import char_count, strip

    rows = [("",), (None,), ("ab 1é中文😀x  ",), ("　 a b \n",), ("中" * 50,)]
    df = spark.createDataFrame(rows, "t string")
    for pattern in ("[a-z]", r"[a-zA-Z0-9\s]", "[一-鿿㐀-䶿]", "[À-ɏ]"):
        counted = char_count(F.col("t"), pattern)
        assert "regexp_count" not in str(counted)
        assert [r[0] for r in df.select(counted).collect()] == [r[0] for r in df.select(F.regexp_count("t", F.lit(pattern))).collect()]
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["", None, "ab 1é中文😀x", "a b", "中" * 50]
