"""Hand-worked cases: small inputs with results computed from the formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyleaf.functions import dates, text as tx
from tallyleaf.operators import expiry, fields, metering, monitoring, regions, services, text
from tallyleaf.operators.scale import literal_table


def one(spark, *exprs, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(*exprs).first()


def monthly(spark, tokens=0, calls=0, cny="0"):
    return literal_table(spark, [(1, "202401", tokens, calls, cny)],
                         "tenant_id bigint; period string; total_tokens bigint; call_count bigint; cost_cny decimal(20,4)")


@pytest.mark.parametrize("tier,mode,tokens,calls,discount,over,cost,total", [
    ("basic", "hybrid", 50000000, 1, 0, 49995000, 15.0, 114.0), ("basic", "package", 50000000, 1, 200, 49995000, 15.0, 0.0),
    ("basic", "by_call", 0, 37, 0, 0, 0.0, 3.7), ("x", "hybrid", 500, 1, 0, 0, 0.0, 0.0)])
def test_invoice(spark, tier, mode, tokens, calls, discount, over, cost, total):
    tenants = literal_table(spark, [(1, tier, mode, discount)], "tenant_id bigint; tier string; mode string; discount decimal(12,2)")
    inv = metering.invoices(monthly(spark, tokens, calls), tenants, metering.package_list(spark))
    r = inv.first()
    assert (r.overage_tokens, float(r.overage_cost), float(r.total_amount)) == (over, cost, total)
    if discount == 0:
        assert sum(x.amount for x in metering.invoice_lines(inv).collect()) == pytest.approx(total)


def test_percentiles(spark):
    df = spark.range(1, 21).select(F.lit("/a").alias("endpoint"), F.col("id").cast("double").alias("duration_ms"))
    r = monitoring.latency_percentiles(df, ["endpoint"]).first()
    assert (r.p50, r.p95, r.p99, r.avg) == (11, 20, 20, 10.5)


def test_percentiles_with_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("endpoint"),
                                  ((F.col("id") * 7919 % 1013) / 7.0 - 20).alias("duration_ms"))
    got = {r.endpoint: (r.p50, r.p95, r.p99) for r in monitoring.latency_percentiles(df, ["endpoint"]).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.endpoint, []).append(r.duration_ms)
    for k, vals in groups.items():
        vals.sort()
        n = len(vals)
        assert got[k] == tuple(vals[min(int(n * p), n - 1)] for p in (0.5, 0.95, 0.99))


def test_fusion(spark):
    schema = "doc_id bigint; field string; value string; conf double"
    o = literal_table(spark, [(1, "brand", "Acme", .9), (1, "specification", "500ml", .9), (1, "color", "red", .9), (1, "batch_number", "A1", .9)], schema)
    v = literal_table(spark, [(1, "brand", "ACME", .8), (1, "specification", "500 mL", .8), (1, "color", "blue", .8), (1, "batch_number", "ZZZZZZZZZZ", .8)], schema)
    fused = fields.fuse_fields(fields.align_channels(o, v))
    got = {r.field: (round(r.consistency, 4), r.chosen, r.decision) for r in fused.collect()}
    assert got["brand"] == (1.0, "ocr", "consensus_ocr") and got["color"][1:] == ("vl", "weighted_choice")
    assert got["specification"][0] == .8133 and got["batch_number"] == (.08, "ocr", "conflict_resolution")
    assert fields.fusion_by_document(fused).first().fused_confidence == .7412
    alone = fields.fuse_fields(fields.align_channels(o.where("field = 'brand'"), v.where("field = 'none'")))
    assert alone.first().decision == "ocr_only"


def test_dates(spark):
    want = dt.date(2025, 1, 15)
    for s, w in (("2025年1月15日", want), ("20250115", want), ("20251345", None), ("01/15/2025", want), ("2025-01-15", want)):
        assert one(spark, dates.parse_date(F.col("s")), s=s)[0] == w
    for p, life, w in (("2025-01-31", "2个月", "2025-03-28"), ("2024-02-29", "1年", "2025-02-28"), ("2025-01-10", "45天", "2025-02-24")):
        assert str(one(spark, dates.compute_expiry(F.col("p"), F.col("l")), p=p, l=life)[0]) == w
    asof = F.lit("2025-06-01").cast("date")
    for days, w in ((-1, "expired"), (30, "near_expiry"), (31, "valid")):
        assert one(spark, dates.expiry_status(F.date_add(asof, days), asof))[0] == w
    found = one(spark, dates.dates_in(F.col("s")), s="x 2024-05-01 生产日期：2024-01-15 有效期至:2025-01-15")[0]
    assert [str(x) for x in found] == ["2024-01-15", "2025-01-15", "2024-05-01"]


def test_codes(spark):
    for code, w in (("4006381333931", "valid"), ("4006381333932", "bad_check_digit"), ("12345", "bad_length"), ("12a", "not_digits")):
        assert one(spark, dates.barcode_check(F.col("c")), c=code)[0] == w
    for b, w in (("N/A", "empty"), ("a b", "format"), ("L20250115", "dated"), ("LOT-A", "valid")):
        assert one(spark, dates.batch_check(F.col("b")), b=b)[0] == w


def test_clean_and_normalise(spark):
    df = literal_table(spark, [(1, "生产曰期：2O25\n6901234567890\nab\nrepeat me\nrepeat me\nStorrge  here")], "doc_id bigint; text string")
    r = text.clean_corpus(df).first()
    assert r.clean_text == "生产日期：2025\nrepeat me\nStorage here" and r.lines_out == 3
    assert one(spark, tx.iso_dates(tx.half_width(F.col("s"))), s="２０２５/1/5")[0] == "2025-01-05"
    assert one(spark, tx.group_thousands(F.col("s")), s="1234567 on 2025-01-05 and 12")[0] == "1,234,567 on 2025-01-05 and 12"
    assert one(spark, tx.fix_terms(F.col("s")), s="有效期 效期 产品名称 产品名")[0] == "有效期 有效期 产品名称 产品名称"


def test_masking(spark):
    assert one(spark, tx.mask_text(F.col("s")), s="13800138000")[0] == "13*******00"
    assert one(spark, tx.mask_text(F.col("s")), s="test@example.com")[0] == "te************om"
    assert one(spark, tx.mask_text(F.col("s")), s="call 13800138000 or a@bcd.org")[0] == "call 13*******00 or a@*****rg"
    full = one(spark, tx.mask_text(F.col("s"), "full"), s="13800138000 x 10.0.0.1")[0]
    assert full == "***phone_cn已脱敏*** x ***ipv4已脱敏***"
    nested = spark.range(1).select(F.struct(F.lit("13800138000").alias("phone"), F.lit("ok").alias("note")).alias("u"), F.array(F.lit("a@bcd.org")).alias("mails"))
    r = text.mask_table(nested).first()
    assert r.u.phone == "13*******00" and r.u.note == "ok" and r.mails == ["a@*****rg"]


def test_partial_mask_against_python(spark):
    import re

    from tallyleaf import fixed_values as fv

    samples = ["id 110101199003078888 end", "6222020200112233445", "mail me: x.y@z.co, 192.168.1.10!", "api_key=ABCDEFGHIJKLMNOP1234", "+8613800138000 1380013800", "a1b2"]

    def py(s):
        for p in fv.SENSITIVE_PATTERNS.values():
            s = re.sub(p, lambda m: (lambda t: "*" * len(t) if len(t) <= 2 else t[0] + "*" * (len(t) - 2) + t[-1] if len(t) <= 6 else t[:2] + "*" * (len(t) - 4) + t[-2:])(m.group(0)), s, flags=re.I)
        return s

    df = literal_table(spark, [(i, s) for i, s in enumerate(samples)], "doc_id bigint; text string")
    assert [r.masked for r in text.mask_corpus(df).orderBy("doc_id").collect()] == [py(s) for s in samples]


def test_scenarios_and_types(spark):
    df = literal_table(spark, [(1, "甲方 乙方 签约"), (2, "身份证 出生 住址"), (3, "plain identity text")], "doc_id bigint; text string")
    assert [r.scenario for r in fields.scenarios(df).orderBy("doc_id").collect()] == ["contract", "id_card", "general_document"]
    df = literal_table(spark, [(1, "品牌：海天\n净含量：500ml\n生产日期：2025-01-05\n保质期：12个月\n制造商：某某厂\n品名：酱油\n")], "doc_id bigint; text string")
    r = fields.extract_fields(df, fields.all_rules()).first()
    assert (r.brand, r.specification, r.production_date, r.shelf_life, r.band) == ("海天", "500ml", "2025-01-05", "12个月", "high")
    r = fields.product_types(literal_table(spark, [(1, "纯牛奶", "小麦")], "doc_id bigint; text string; ingredients string")).first()
    assert (r.product_type, r.inferred_type) == ("乳制品", "食品")


def boxes(spark, rows):
    return literal_table(spark, rows, "doc_id bigint; region_id bigint; text string; x1 bigint; y1 bigint; x2 bigint; y2 bigint; confidence double")


def test_overlap(spark):
    r = boxes(spark, [(1, 1, "a", 0, 0, 10, 10, .9), (1, 2, "b", 1, 1, 11, 11, .8), (1, 3, "c", 20, 20, 30, 30, .7)])
    assert sorted(x.region_id for x in regions.suppress_overlaps(r, .5).collect()) == [1, 3]
    assert sorted(x.region_id for x in regions.suppress_overlaps(r, .5, same_text=True).collect()) == [1, 2, 3]
    areas = literal_table(spark, [(1, 9, 0, 0, 10, 10)], "doc_id bigint; area_id bigint; x1 bigint; y1 bigint; x2 bigint; y2 bigint")
    pts = boxes(spark, [(1, 1, "a", 5, 5, 5, 5, 1.0), (1, 2, "b", 10, 10, 10, 10, 1.0), (1, 3, "c", 11, 5, 11, 5, 1.0)])
    assert sorted(x.region_id for x in regions.center_inside(pts, areas).collect()) == [1, 2]


def test_suppression_leaves_no_overlap(spark):
    import random

    rng = random.Random(7)
    rows = []
    for i in range(300):
        x, y = rng.randrange(300), rng.randrange(600)
        rows.append((1, i, "t", x, y, x + rng.randrange(10, 60), y + rng.randrange(10, 40), rng.randrange(100) / 100))

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[1])):
        if all(iou(r, k) <= .3 for k in kept):
            kept.append(r)
    assert sorted(x.region_id for x in regions.suppress_overlaps(boxes(spark, rows), .3).collect()) == sorted(r[1] for r in kept)


def test_reading_order_and_weak(spark):
    r = boxes(spark, [(1, 1, "r1", 45, 0, 55, 20, .9), (1, 2, "r2", 5, 5, 15, 25, .1), (1, 3, "r3", 5, 30, 15, 50, .9),
                      (2, 1, "x", 0, 0, 1, 1, .1), (2, 2, "y", 0, 0, 1, 1, .05)])
    got = [(x.region_id, x.line_no) for x in regions.reading_order(r.where("doc_id = 1")).orderBy("position").collect()]
    assert got == [(2, 1), (1, 1), (3, 2)]
    assert sorted((x.doc_id, x.region_id) for x in regions.drop_weak(r).collect()) == [(1, 1), (1, 3), (2, 1)]
    assert one(spark, regions.merge_close_lines(F.array(*[F.lit(x) for x in (0, 3, 6, 9, 20)])))[0] == [0, 6, 20]


def test_columns(spark):
    rows = [(1, i, "t", x, i * 10, x + 10, i * 10 + 8, .9) for i, x in enumerate([0, 2, 1, 300, 301, 299])]
    got = {r.region_id: r.column_no for r in regions.assign_columns(boxes(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_transactions(spark):
    t = literal_table(spark, [(1, 60000, 7), (2, 10, 8), (3, 10, 8), (4, 10, 8)], "txn_id bigint; amount double; counterparty bigint")
    flagged = expiry.flag_transactions(t, literal_table(spark, [(7,), (7,)], "counterparty bigint"))
    r = expiry.auto_clear_rate(flagged.withColumn("all", F.lit(1)), ["all"]).first()
    assert (r.total, r.flagged, r.auto_clear_rate) == (4, 1, .75)


def test_degradation(spark):
    rows = [("doubao-seed-2-0-pro-260215", 96, 100, 0.0, 0), ("doubao-seed-2-0-pro-260215", 100, 100, 0.0, 0), ("doubao-seed-2-0-pro-260215", 100, 100, .1, 0),
            ("other", 10, 100, 0.0, 1001)]
    df = literal_table(spark, rows, "model string; tpm bigint; tpm_limit bigint; error_rate double; sessions bigint")
    got = [(r.level, r.target_model) for r in metering.degradation(df, metering.chain_list(spark)).collect()]
    assert sorted(got, key=str) == sorted([("mini", "doubao-seed-2-0-mini-260215"), ("reject", None), ("lite", "kimi-k2-5-260127"), ("cached", None)], key=str)


def test_experiment(spark):
    rows = spark.range(200).select(F.when(F.col("id") < 100, "a").otherwise("b").alias("variant"),
                                   F.when(F.col("id") < 100, F.col("id") < 30).otherwise(F.col("id") < 145).alias("success"))
    r = services.experiment_report(rows, "a").first()
    assert (round(r.z_score, 4), round(r.p_value, 4), r.significant, r.winner) == (2.1909, .0285, True, "b")
    few = services.experiment_report(rows.where("variant = 'b' OR id < 29"), "a")
    assert few.count() == 0
    assert one(spark, services.hash_bucket(F.lit("exp:1")))[0] == 5


def test_webhooks(spark):
    waits = services.retry_timetable(literal_table(spark, [(1,)], "delivery_id bigint")).orderBy("retry").collect()
    assert [r.wait for r in waits] == [1, 5, 25, 125, 600] and [r.instant for r in waits] == [1, 6, 31, 156, 756]
    rows = [(1, 1, i, False) for i in range(1, 7)] + [(2, 1, 1, False), (2, 1, 2, True)]
    att = literal_table(spark, rows, "delivery_id bigint; tenant_id bigint; attempt bigint; success boolean").withColumn("ts", F.timestamp_seconds("attempt")).withColumn("duration_ms", F.lit(1.0))
    assert {r.delivery_id: r.status for r in services.delivery_states(att).collect()} == {1: "dead_lettered", 2: "success"}


def test_firing(spark):
    def points(flags):
        return literal_table(spark, [("r", i * 30, f) for i, f in enumerate(flags)], "rule string; s bigint; hit boolean").withColumn("ts", F.timestamp_seconds("s"))

    flags = [True] * 10 + [False] + [True] * 3
    assert monitoring.firing_spans(points(flags), ["rule"], "hit", 300).count() == 0
    assert monitoring.firing_spans(points([True] * 11 + [False]), ["rule"], "hit", 300).count() == 1


def test_accuracy_and_json(spark):
    s = "doc_id bigint; field string; value string"
    truth = literal_table(spark, [(1, "a", "A "), (1, "b", None), (1, "c", "x")], s).withColumn("category", F.lit("k"))
    pred = literal_table(spark, [(1, "category_info.a", "a"), (1, "b", None), (1, "c", None)], s)
    got = fields.compare_fields(truth, pred)
    assert {r.field: r.match_type for r in got.collect()} == {"a": "exact", "b": "both_null", "c": "null_mismatch"}
    assert fields.accuracy_report(got).where("scope = 'all'").first().accuracy == 66.7
    df = literal_table(spark, [(1, "```json\n{\"a\": 1}\n```"), (2, "so {\"a\": 2} it is"), (3, "{ no")], "id bigint; text string")
    assert [r.failed for r in text.salvage_json(df).orderBy("id").select("failed").collect()] == [False, False, True]


def test_nutrition(spark):
    src = "head\nNutrition Facts\nProtein\nFat\nSodium\n12\n13\n14\nStorage: dry"
    df = literal_table(spark, [(1, src), (2, "Nutrition Facts\nProtein\nFat\nSodium\n12\nStorage")], "doc_id bigint; text string")
    a, b = text.rearrange_nutrition(df).orderBy("doc_id").collect()
    assert a.rearranged and a.table_text == "head\nNutrition Facts\nProtein: 12\nFat: 13\nSodium: 14\nStorage: dry"
    assert not b.rearranged and b.table_text.startswith("Nutrition Facts\nProtein")


def test_search_error(spark):
    with pytest.raises(ValueError):
        services.search_nodes(spark.range(1).withColumnRenamed("id", "node_id"), nope=1)


def test_running_totals_with_a_hot_and_a_null_key(spark):
    from tallyleaf.operators.scale import running_totals

    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id")
    got = {r.id: r.s for r in running_totals(df, ["k"], F.floor(F.col("id") / 40), ["id"], {"s": F.col("id")}).collect()}
    sums = {}
    for r in df.orderBy("id").collect():
        sums[r.k] = sums.get(r.k, 0) + r.id
        assert got[r.id] == sums[r.k]
