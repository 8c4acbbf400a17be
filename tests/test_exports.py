import os

from pyspark.sql import functions as F

from twinfold.operators import display
from twinfold.sinks import exports
from twinfold.sources import records

PAIR = "pair_id string, pair_seq int, src_text string, tgt_text string, src_sent_idx int, src_para_idx int, tgt_para_idx int"
PARA = "pair_id string, para_idx int, text string, image_ids array<string>"


def pairs_of(spark, rows):
    return spark.createDataFrame([("p", k, *r) for k, r in enumerate(rows)], PAIR)


def test_exported_shows_either_side_and_drops_what_is_empty(spark):
    pairs = pairs_of(spark, [("a", "A", 0, 0, 0), ("", "B", None, None, 1), (" ", " ", 0, 1, 2), ("c", "", 0, 3, None)])
    paras = spark.createDataFrame([("p", 0, "a", []), ("p", 1, "x", []), ("p", 2, "", ["s"]), ("p", 3, "c", None), ("p", 4, " ", [])], PARA)
    targets = spark.createDataFrame([("p", 1, "", ["t1"]), ("p", 5, "", ["t5"])], PARA)
    got = {m: [(r["display_idx"], r["para_idx"], r["images"], [x["tgt_text"] for x in r["pairs"]]) for r in display.exported(pairs, paras, targets, m).orderBy("display_idx").collect()] for m in ("both", "none")}
    # paragraph 1 has a blank pair only; an image that nothing cites goes to the last paragraph
    assert got["both"] == [(0, 0, ["t1"], ["A", "B"]), (1, 2, ["s"], []), (2, 3, ["t5"], [""])]
    assert got["none"] == [(0, 0, [], ["A", "B"]), (1, 3, [], [""])]
    assert display.exported(pairs.limit(0), paras.limit(0), targets).count() == 0


def test_orphans_go_with_the_next_paragraph(spark):
    pairs = pairs_of(spark, [("", "x", None, None, 0), ("a", "A", 0, 2, 0), ("", "y", None, None, 1), ("b", "B", 0, 5, 2), ("", "z", None, None, 3)])
    assert [r["src_para_idx"] for r in display.with_next_paragraph(pairs).orderBy("pair_seq").collect()] == [2, 2, 5, 5, 5]
    shown = display.displayed(pairs, either_side=True, orphan="next").orderBy("display_idx").collect()
    assert [(r["para_idx"], r["text"], len(r["pairs"])) for r in shown] == [(2, "a", 2), (5, "b", 3)]
    alone = pairs_of(spark, [("", "x", None, None, 0)])
    assert [r["para_idx"] for r in display.displayed(alone, either_side=True, orphan="next").collect()] == [0]
    assert display.displayed(alone).count() == 0


def test_legacy_images_are_claimed_once(spark):
    rows = [("p", 0, 0, 4, None), ("p", 1, 0, 3, ["x"]), ("p", 2, 0, 4, ["y"]), ("p", 3, 1, None, []), ("p", 4, 1, 9, None)]
    pairs = spark.createDataFrame(rows, "pair_id string, pair_seq int, src_para_idx int, tgt_para_idx int, src_images array<string>")
    targets = spark.createDataFrame([("p", 3, "", ["c"]), ("p", 4, "", ["a", "b"]), ("p", 7, "", ["never"])], PARA)
    assert [(r["para_idx"], r["images"]) for r in display.legacy_images(pairs, targets).orderBy("para_idx").collect()] == [(0, ["x", "a", "b", "c"]), (1, [])]
    assert display.legacy_images(pairs, targets, "source").where("para_idx = 0").first()["images"] == ["x"]


def test_a_pair_is_one_sorted_file(spark, tmp_path):
    lines = spark.createDataFrame([(f"b{p}", k, f"{p}:{k}") for k in range(400, -3, -1) for p in range(3)], "pair_id string, line_no int, line string").repartition(5)
    out = str(tmp_path / "tsv")
    exports.write_tsv(lines, out)
    for p in range(3):
        (file,) = [x for x in os.listdir(f"{out}/pair_id=b{p}") if x.startswith("part-")]
        assert open(f"{out}/pair_id=b{p}/{file}").read().splitlines() == [f"{p}:{k}" for k in range(-2, 401)]


def test_records_keep_both_sides_and_the_image_list(spark):
    pairs = pairs_of(spark, [("a", "A", 0, 0, 0)]).withColumn("alignment_type", F.lit("1:1"))
    langs = spark.createDataFrame([("p", "en", "fr")], "pair_id string, src_lang string, tgt_lang string")
    targets = spark.createDataFrame([("p", 1, "", ["t1"]), ("p", 0, "A", [])], PARA)
    images = spark.createDataFrame([("p", "t1", "image/png")], "pair_id string, id string, mime_type string")
    back = records.read(exports.record_json(pairs, langs, targets=targets, images=images))
    assert [(r["para_idx"], r["image_ids"]) for r in records.target_paragraphs(back, "pair_id").collect()] == [(0, []), (1, ["t1"])]
    assert [(r["id"], r["mime_type"]) for r in records.images(back, "pair_id").collect()] == [("t1", "image/png")]
    assert records.source_paragraphs(back, "pair_id").count() == 0


def test_scores_are_rounded_by_their_exact_value(spark):
    """A score just below a tie goes down (0.01875 is 0.018749999...), a tie goes up."""
    from decimal import ROUND_HALF_UP, Decimal

    values = [k / 160 for k in range(161)] + [k / 32 for k in range(33)] + [k / 1000 + 0.00005 for k in range(1000)] + [-0.03125, -0.5, 12345.03125, 2 / 3, 200.00005, 1e-9]
    df = spark.createDataFrame([(1, k, "a", "b", v) for k, v in enumerate(values)], "pair_id long, pair_seq int, src_text string, tgt_text string, confidence double")
    got = [r["line"].split("\t")[-1] for r in exports.tsv_lines(df).where("line_no >= 0").orderBy("line_no").collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values]
