"""Steps that several pages, options or methods share are done once, with the results of doing them for each."""

from pyspark.sql import functions as F

from docdelta.operators import layout, text, visual
from docdelta.plans import compare, queries
from docdelta.sources import fixtures
from docdelta.sources.fixtures import Entities

SF = "/root/testdata/sf0.001"


def picture(i):
    return [(i, x, y, (x * 16 + y * 3) // 2 + (i > 2) * 40 * ((x + y) % 23 == 0) + (i % 2) * 90) for x in range(16) for y in range(16)]


def test_pictures_are_scored_once_and_as_their_pixels_are(spark, monkeypatch):
    pictures = spark.createDataFrame([p for i in range(1, 5) for p in picture(i)], "image_id long, x int, y int, lum int")
    on = lambda side: spark.createDataFrame([(p, n, (p + n) % 2 + 1 + 2 * (side and p % 3 > 0)) for p in range(8) for n in range(1, 4 + p % 2 * side)], "pair_id long, page_no int, image_id long")
    base, compare_ = on(0), on(1)
    rows, plain = [], visual.page_score
    monkeypatch.setattr(visual, "page_score", lambda px, *a, **k: rows.append(px.count()) or plain(px, *a, **k))
    shown = visual.image_differences(visual.Shown(base, pictures), visual.Shown(compare_, pictures))
    assert rows and rows[0] <= 16 * 256
    monkeypatch.undo()
    pixels = lambda d: d.join(pictures, "image_id").drop("image_id")
    want = visual.image_differences(pixels(base), pixels(compare_))
    bag = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    assert bag(shown) == bag(want) and {r.change for r in shown.collect()} == {"added", "modified"}


def test_options_share_their_kinds(spark, monkeypatch):
    asked = []
    for kind, rows in compare.KINDS.items():
        monkeypatch.setitem(compare.KINDS, kind, lambda e, m, o, kind=kind, rows=rows: asked.append((kind, o.threshold)) or rows(e, m, o))
    queries.QUERIES["compare_options"](spark, SF)
    assert sorted(asked) == [("fonts", "normal"), ("images", "normal"), ("metadata", "normal"), ("styles", "normal"), ("text", "normal"), ("text", "strict")]


def test_methods_in_one_pass(spark):
    rows = [(1, "a b", "ab"), (1, "same", "same"), (1, "abcdefghij", "abcdefghiX"), (1, None, "x" * 60), (2, "short", None), (2, "abc", "xyz"), (3, "same", "same")]
    lines = spark.createDataFrame(rows, "pair_id long, base_text string, compare_text string")
    got = {tuple(r) for r in text.count_by_methods(lines).collect()}
    want = {(m, t, r.pair_id, r["count"]) for m in ("exact", "smart", "fuzzy") for t in ("strict", "normal", "relaxed") for r in text.compare_by(lines, m, t).groupBy("pair_id").count().collect()}
    assert got == want and ("fuzzy", "normal", 1, 2) in got and ("exact", "strict", 1, 3) in got
    assert queries.QUERIES["text_methods"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") <= 2


def test_changes_under_all_switches_in_one_pass(spark):
    plan = queries.QUERIES["suppress_cosmetic"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_a_long_paragraph_is_cut_in_one_pass(spark):
    para = "".join(chr(97 + i % 26) for i in range(100_003)) + " é😀"
    docs = spark.createDataFrame([(1, f"{para}\r\n\n{'x' * 160}\ry"), (2, ""), (3, None)], "doc_id long, text string")
    d = fixtures.lines_on_pages(fixtures.paragraphs(docs))
    got = [r.text for r in d.orderBy("page_no", "line_no").collect()]
    assert got == [*(para[i : i + 80] for i in range(0, len(para), 80)), "x" * 80, "x" * 80, "y"]
    assert "substring" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_lines_start_where_elements_leave_the_anchor(spark):
    ys = [100.0, 95.0, 89.0, 100.0, 80.0, 62.0]
    rows = [(1, 1, i, "w", float(i), y, 10.0, 10.0 if i != 2 else 1.0) for i, y in enumerate(ys)]
    d = layout.group_lines(spark.createDataFrame(rows, "doc_id long, page_no int, elem_no int, text string, x double, y double, width double, height double"))
    assert {r.elem_no: r.line_no for r in d.collect()} == {0: 1, 3: 1, 1: 1, 2: 2, 4: 3, 5: 4}


def test_both_writes_of_results_read_the_same_rows(spark, monkeypatch):
    made = []
    plain = queries.lineage.stored
    monkeypatch.setattr(queries.lineage, "stored", lambda d, label: made.append(label) or plain(d, label))
    e = Entities(spark, SF)
    got = queries.QUERIES["result_write"](spark, SF)
    even = e.differences.where("pair_id % 2 = 0 and change <> 'modified'").select("pair_id").distinct()
    assert made == ["written"] and got.count() == e.differences.join(even, "pair_id", "left_anti").count() + e.differences.where((F.col("pair_id") % 2 == 0) & (F.col("change") != "modified")).count()
