import random

from cloakwork.operators import dedup as D
from cloakwork.operators import image, templates
from cloakwork.functions import boxes as B

SCHEMA = "doc_id string, page int, ord long, x int, y int, w int, h int, entity_type string, confidence double, source string, text_found string"


def boxes(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], SCHEMA)


def box(ord, x, y, w, h, conf=0.9, text="", page=0, kind="FACE"):
    return (page, ord, x, y, w, h, kind, conf, "s", text)


def over(a, b):
    w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    i = max(w, 0) * max(h, 0)
    return i / (a[4] * a[5] + b[4] * b[5] - i) if i else 0.0


def test_text_pass(spark):
    rows = [box(1, 0, 0, 9, 9, 0.6, "v", kind="PERSON"), box(2, 0, 0, 9, 9, 0.9, "v", kind="PERSON"), box(3, 0, 0, 9, 9, 0.7, "z", kind="US_SSN"), box(4, 0, 0, 9, 9, 0.9, "z", kind="PERSON"),
            box(5, 0, 0, 9, 9, 0.5, "John Michael Doe"), box(6, 0, 0, 9, 9, 0.5, "John Doe"), box(7, 0, 0, 9, 9, 0.5, "v", page=1), box(8, 50, 0, 9, 9, 0.5, "v", kind="PERSON")]
    assert sorted(r.ord for r in D.best_per_text(boxes(spark, rows)).collect()) == [2, 3, 5, 6, 7]
    assert sorted(r.ord for r in D.best_per_text(boxes(spark, rows), located=True).collect()) == [2, 3, 5, 6, 7, 8]


def test_suppression_equals_the_sequential_one(spark):
    rng = random.Random(4)
    rows = [box(k, rng.randrange(60), rng.randrange(60), rng.randrange(10, 60), rng.randrange(10, 60), rng.choice([0.5, 0.6, 0.7, rng.random()]), rng.choice(["", None]), k % 5) for k in range(120)]
    want = []
    for page in range(5):
        kept = []
        for b in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[7], r[1])):
            if all(over(b, k) <= 0.5 for k in kept):
                kept.append(b)
        want += [k[1] for k in kept]
    assert sorted(r.ord for r in D.apart(boxes(spark, rows)).collect()) == sorted(want)


def test_merging(spark):
    got = D.merged(boxes(spark, [box(1, 10, 10, 50, 30, 0.8, "a"), box(2, 40, 5, 60, 50, 0.9, "b", kind="ID"), box(3, 300, 300, 10, 10), box(4, 10, 10, 5, 5, page=1)]), 0).orderBy("page", "ord").collect()
    assert [(r.page, r.x, r.y, r.w, r.h, r.entity_type, r.text_found) for r in got] == [(0, 10, 5, 90, 50, "ID", ""), (0, 300, 300, 10, 10, "FACE", ""), (1, 10, 10, 5, 5, "FACE", "")]


def test_merged_rectangles_stand_apart_whatever_the_order(spark):
    rng = random.Random(7)
    rows = [box(k, rng.randrange(300), rng.randrange(300), rng.randrange(1, 40), rng.randrange(1, 40)) for k in range(60)]
    shapes = []
    for _ in range(2):
        rng.shuffle(rows)
        got = D.merged(boxes(spark, [(r[0], k, *r[2:]) for k, r in enumerate(rows)]), 2).collect()
        shapes.append(sorted((r.x, r.y, r.w, r.h) for r in got))
        for a in got:
            assert all(a is b or a.x > b.x + b.w or b.x > a.x + a.w or a.y > b.y + b.h or b.y > a.y + a.h for b in got)
    assert shapes[0] == shapes[1]


def test_empty_boxes(spark):
    empty = boxes(spark, [])
    assert D.deduplicated(empty).count() == 0 and D.merged(empty).count() == 0


def test_templates(spark):
    assert {t: sum(r[0] == t for r in templates.rows()) for t in templates.TEMPLATES} == {"CMS-1500": 37, "ACORD 125": 32}
    hashes = spark.createDataFrame([("a", 0b1111), ("b", -1)], "doc_id string, hash long")
    got = templates.nearest(hashes, {"t": 0b0111, "u": 0}).collect()
    assert [(r.doc_id, r.template, r.bits) for r in got] == [("a", "t", 1)]
    assert templates.nearest(hashes, {}).count() == 0


def test_fill_leaves_the_rest_alone(spark):
    data = bytes([255]) * (20 * 10 * 3)
    for b in [(2, 3, 4, 5), (-5, -5, 7, 7), (18, 8, 50, 50), (0, 0, 20, 10), (5, 5, 0, 4), (100, 100, 5, 5)]:
        df = spark.createDataFrame([("i", 10, 20, 3, data, [b])], "image_id string, height int, width int, channels int, data binary, boxes array<struct<x:int,y:int,w:int,h:int>>")
        out = image.filled(df).collect()[0].data
        for y in range(10):
            for x in range(20):
                inside = b[0] <= x < b[0] + b[2] and b[1] <= y < b[1] + b[3]
                at = (y * 20 + x) * 3
                assert out[at : at + 3] == (b"\0\0\0" if inside else b"\xff\xff\xff")


def test_padding(spark):
    from pyspark.sql import functions as F

    df = boxes(spark, [box(1, 1, 1, 10, 10)])
    assert df.select(*B.padded(4)).first() == (0, 0, 18, 18)
    assert df.select(*B.padded(4, F.lit(12), F.lit(100))).first() == (0, 0, 12, 15)
