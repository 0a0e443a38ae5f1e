"""Labelled rules and rules without labels against a plain walk with Python's own engine over made texts."""

import random
import re

from tallyleaf import fixed_values as fv
from tallyleaf.operators import free_form
from tallyleaf.operators.fields import extract_fields

PIECES = ["NIVEA妮维雅", "妮维雅NIVEA 2", "Dafi 答菲", "温和沐浴露", "厨房湿巾", "妙洁", "雪饼好吃", "海天酱油", "水 甘油 芦荟", "Aqua, glycerin, Aloe Vera", "无酒精 无香料", "++ 长久保湿不油腻",
          "长久保湿不油腻配方", "+J 去污真方便", "r-j 噪声", "12345", "ABC def", "A-j 去污真方便呀", "每100克含水", "净含量：500ml", "净含量 5kg", "规格 80抽", "每100 g 50片", "1.9L", "草菇老抽酱油",
          "品牌：海天", "商标: Acme", "Brand: Acme7", "产品名称：草菇老抽\n规格：1.9L", "Product Name: Oat Milk", "生产日期：2025年3月4日", "三产日期 2025/1/2", "DATE 20250102", "2025-01-15", "2025-01-15克",
          "保质期：18个月", "保质期: 1000天", "Shelf Life: 12 months", "Shelf Life 3650 days", "有效期至：2026年5月", "制造商：广州食品厂 电话", "康师傅控股有限公司", "Foo Bar Inc.", "Made by: Foo Bar",
          "配料：水、盐、糖\n保质期：3天", "Ingredients: water, salt", "成分：小麦粉（含麸质）", "执行标准：GB/T 18186", "标准: Q/BBAH0005S-2020", "LOT No: AB12_9", "批号：X-9981", "SC10644011201234", "许可证：QS123456789012",
          "贮存条件：阴凉干燥处", "Storage: keep cool", "Olive Oil", "菜籽油好", "12 g 5 kg", "5 kg", "x5ml", "的是不了", "", "   ", "a word or two", "Zoë über alles", "　全角空格　"]


def texts(count=300, seed=9):
    rnd = random.Random(seed)
    out = ["\n".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 9))) for _ in range(count - 3)]
    return [*out, "", "\n".join(["NIVEA妮维雅"] * 50 + [f"长久保湿不油腻{i}" for i in range(200)]), "纯净水 " * 3000]


BLANK = " \t\n\x0b\x0c\r　\xa0"


def labelled(text):
    out = {}
    for field, rules in fv.FIELD_RULES.items():
        for rule in rules:
            hit = re.search(rule, text, re.IGNORECASE | re.MULTILINE)
            if hit and hit[1].strip(BLANK):
                out[field] = hit[1].strip(BLANK)
                break
    return out


def first_match(text, pattern):
    hit = re.search(pattern, text)
    return hit[1].strip(BLANK) if hit else None


def walked(text):
    lines = [x.strip(BLANK) for x in text.split("\n") if x.strip(BLANK)]
    out = {}
    for line in lines:
        for pattern in fv.MIXED_BRAND:
            if "brand" not in out and first_match(line, pattern):
                out["brand"] = first_match(line, pattern)
    for line in lines:
        bare = re.sub(fv.HAN_BRAND_CUT, "", line, flags=re.ASCII)
        if "brand" not in out and re.fullmatch("[一-龥]{2,6}", bare) and not re.search(fv.HAN_BRAND_BARRED, bare):
            out["brand"] = bare
    for line in lines[:3]:
        if "brand" not in out and re.search(fv.LATIN_BRAND, line):
            out["brand"] = line
    kind = next((name for words, name in fv.PRODUCT_TYPES if re.search(words, "".join(lines))), None)
    if kind:
        out["product_type"] = kind
        out["product_name"] = out.get("brand", "") + kind
        for words, _ in fv.PRODUCT_TYPES:
            hit = re.search(words, lines[0])
            if hit:
                if lines[0][: hit.start()].strip(BLANK):
                    out["product_name"] = lines[0][: hit.start()].strip(BLANK) + hit[0]
                break
    named = []
    for line in lines:
        if not line.startswith("无"):
            for pattern in fv.FREE_INGREDIENTS:
                named += [x for x in re.findall(pattern, line, re.IGNORECASE)]
    named = list(dict.fromkeys(named))
    if named:
        out["ingredients"] = "，".join(named[:8])
    said = []
    for line in lines:
        if any(re.match(p, line, re.IGNORECASE) for p in fv.FREE_NOISE_LINES):
            continue
        for head in fv.FREE_NOISE_HEADS:
            line = re.sub(head, "", line).strip(BLANK)
        names = [out[n] for n in ("brand", "product_name") if n in out]
        if len(line) >= 4 and re.search("[一-龥]", line) and not any(n in line or line in n for n in names) and not any(s in line or line in s for s in said):
            said.append(line)
    if said:
        out["features"] = "，".join(said[:8])
    for pattern in fv.FREE_SPECIFICATION:
        if "specification" not in out and first_match("".join(lines), pattern):
            out["specification"] = first_match("".join(lines), pattern)
    return out


def settled(text):
    own, free = labelled(text), walked(text)
    if len(own) <= 1:
        return {**own, **free}
    return {**{f: free[f] for f in fv.FILLED_FIELDS if f in free}, **own}


def frame(spark, made):
    return spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)


def test_all_labelled_rules(spark):
    made = texts()
    got = {r.doc_id: {f: r[f] for f in fv.FIELD_RULES if r[f] is not None} for r in extract_fields(frame(spark, made), fv.FIELD_RULES).collect()}
    assert got == {i: labelled(t) for i, t in enumerate(made)}
    hit = {f: {next(i for i, p in enumerate(fv.FIELD_RULES[f]) if re.search(p, t, re.I | re.M)) for t in made if f in labelled(t)} for f in fv.FIELD_RULES}
    assert sum(map(len, hit.values())) > 30


def test_rules_without_labels(spark):
    made = texts(seed=10)
    rows = free_form.free_form_fields(frame(spark, made)).collect()
    assert {r.doc_id: {f: r[f"free_{f}"] for f in free_form.FREE if r[f"free_{f}"] is not None} for r in rows} == {i: walked(t) for i, t in enumerate(made)}


def test_both_layers_settled(spark):
    made = texts(seed=11)
    rows = free_form.settled_fields(frame(spark, made)).collect()
    names = (*fv.FIELD_RULES, "features", "product_type")
    want = {i: settled(t) for i, t in enumerate(made)}
    assert {r.doc_id: {f: r[f] for f in names if r[f] is not None} for r in rows} == want
    assert {r.layer for r in rows} == {"free", "labels", "both", "none"}
    for r in rows:
        filled = sum(f in want[r.doc_id] for f in fv.KEY_FIELDS)
        assert r.filled_key == filled and r.band == ("high" if filled >= 5 else "medium" if filled >= 3 else "low" if filled else "failed")


def test_null_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = free_form.settled_fields(docs).first()
    assert row.layer == "none" and row.brand is None and row.band == "failed"
    assert free_form.settled_fields(docs.limit(0)).count() == 0
