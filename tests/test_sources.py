from pyspark.sql import functions as F

from twinfold.functions import text as tx
from twinfold.sources import markup, pair_tsv, records
from twinfold.sources import paragraphs as paras
from twinfold.sinks import exports


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_text_paragraphs(spark):
    df = spark.createDataFrame([(1, "First paragraph.\n\nSecond paragraph."), (2, "one hard\nwrapped line"), (3, "Line one.\r\n\r\nLine two.\r"), (4, "a\n\n  \n\n　b　"), (5, None), (6, "")], "book_id int, text string")
    got = rows(paras.text_paragraphs(df), "book_id", "para_idx")
    assert got == [(1, 0, "First paragraph."), (1, 1, "Second paragraph."), (2, 0, "one hard wrapped line"), (3, 0, "Line one."), (3, 1, "Line two."), (4, 0, "a"), (4, 1, "b")]


def test_item_paragraphs(spark):
    items = [
        (1, [("Hello ", 100, 12, False), ("world.", 100, 12, False)], ["Hello world."]),
        (2, [("Line one.", 100, 12, True), ("Line two.", 86, 12, False)], ["Line one. Line two."]),
        (3, [("First paragraph.", 100, 12, True), ("Second paragraph.", 60, 12, False)], ["First paragraph.", "Second paragraph."]),
        (4, [("Real text.", 100, 12, False), ("", 100, 12, False), ("  ", 100, 12, False)], ["Real text."]),
        (5, [("Para one line one.", 200, 12, True), ("Para one line two.", 188, 12, True), ("Para two.", 100, 12, False)], ["Para one line one. Para one line two.", "Para two."]),
        (6, [("First.", 200, 12, True), ("Second.", 100, 0, False)], ["First.", "Second."]),
    ]
    flat = [(b, 0, k, s, float(y), float(h), e) for b, its, _ in items for k, (s, y, h, e) in enumerate(its)]
    df = spark.createDataFrame(flat, "book_id int, page int, item_idx int, str string, y double, height double, has_eol boolean")
    got = {}
    for r in paras.item_paragraphs(df).orderBy("book_id", "para_idx").collect():
        got.setdefault(r["book_id"], []).append(r["text"])
    assert got == {b: want for b, _, want in items}


def test_renumbered_and_catalog(spark):
    df = spark.createDataFrame([(1, 4, "x", []), (1, 7, " ", ["i"]), (1, 9, "", None), (1, 12, "y", None)], "book_id int, para_idx int, text string, image_ids array<string>")
    assert [(r["para_idx"], r["text"]) for r in paras.renumbered(df).orderBy("para_idx").collect()] == [(0, "x"), (1, " "), (2, "y")]
    files = spark.createDataFrame([("A.epub", None, " Own "), ("b.PDF", None, "no"), ("c", "text/plain", None), ("d.doc", None, None), (".txt", None, None)], "n string, m string, t string")
    got = {r["n"]: (r["type"], r["title"]) for r in paras.file_catalog(files, F.col("n"), F.col("m"), F.col("t")).collect()}
    assert got == {"A.epub": ("epub", "Own"), "b.PDF": ("pdf", "b"), "c": ("txt", "c"), ".txt": ("txt", ".txt")}


def blocks(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    return [r["text"] for r in markup.blocks(df).orderBy("block_idx").collect()]


def test_blocks(spark):
    assert blocks(spark, "<html><body><p>One.</p><p> </p><p>Two\n  more.</p></body></html>") == ["One.", "Two more."]
    assert blocks(spark, "<body><p>彼<ruby>女<rt>じょ</rt></ruby>は言った。</p></body>") == ["彼女は言った。"]
    assert blocks(spark, "<body><div>first<br/>second<br>third</div></body>") == ["first", "second", "third"]
    assert blocks(spark, "<body><div class='bs1'>a</div><div class='x bs'>b</div>lost<div class='bs22'>c<div>d</div></div><p>no</p></body>") == ["a", "b", "cd"]
    assert blocks(spark, "<body><div class='calibre2'>a</div>x<div class='my-parag'>b</div></body>") == ["a", "b"]
    assert blocks(spark, "<body><p>open<br><p>next &amp; &lt;b&gt; &#233;&#x4e00;</p></body>") == ["open", "next & <b> é一"]
    assert blocks(spark, None) == [] and blocks(spark, "") == []


def test_nested_blocks_and_images(spark):
    page = """<body><div class="bs1">a<div>b<div class="bs">c<img src='../i/1.png'/></div>d</div>e</div>lost<div class="bs"><img src="../i/gone.png"></div>
    <div class="bs"><svg><image xlink:href="2.png"/></svg><img src="../i/1.png"><img src="../i/1.png"></div></div><p>no</p></body>"""
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    members = spark.createDataFrame([(1, "O/i/1.png"), (1, "O/t/2.png"), (2, "O/i/gone.png")], "page_id int, path string")
    want = [(1, 0, "abcde", ["O/i/1.png"]), (1, 1, "c", ["O/i/1.png"]), (1, 2, "", ["O/i/1.png", "O/t/2.png"])]
    assert rows(markup.blocks(df, path=F.lit("O/t/c.xhtml"), members=members, on=["page_id"]), "block_idx") == want
    lines = spark.createDataFrame([(1, "<body>x<img src='a.png'>y<br><rt>gone</rt>z<div class='parag'></div></body>"), (2, "<body>x<img src='a.png'>y<br>z</body>"), (3, "<body><p><img src='a.png'></p>lost</body>")], "page_id int, html string")
    assert rows(markup.blocks(lines), "page_id", "block_idx") == [(2, 0, "x", []), (2, 1, "", ["a.png"]), (2, 2, "y", []), (2, 3, "z", []), (3, 0, "", ["a.png"])]


def test_odd_pages_are_read_once(spark):
    many = 300_000
    odd = ["<!--" * many, "<a " * many, "<script" * many, "<rt>" * (many // 10) + "x", "<body " * many, "<div class='bs'>" * 3000 + "x", "&" * many + "&#65;", "<p>a</p>" * 20_000]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id int, html string").repartition(4)
    assert {r["page_id"]: r["n"] for r in markup.blocks(df).groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {5: 3000, 6: 1, 7: 20_000}


def test_entities_of_all_planes(spark):
    cases = {"&#65;&#x42;": "AB", "&#99999;": chr(99999), "&#128512;&#x1F600;": "😀😀", "&hellip;&eacute;&apos;": "…é'", "&#0;&#xD800;&#1114112;&#99999999999999999999;": "\ufffd" * 4, "&nope; & &amp;lt; &amp": "&nope; & &lt; &amp", "&#000065;": "A", "": ""}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert df.where(tx.decode_entities(F.col("t")) != F.col("want")).collect() == [] and df.count() == len(cases)


def test_images_paths_and_types(spark):
    df = spark.createDataFrame([(1, '<img src="../images/a.jpg"><image xlink:href="b.PNG"/><img src="../images/a.jpg"><image href="http://x/y.gif"/>')], "page_id int, html string")
    got = rows(markup.image_refs(df, F.lit("OEBPS/text/c.xhtml")), "image_idx")
    assert got == [(1, 0, "OEBPS/images/a.jpg", "image/jpeg"), (1, 1, "OEBPS/text/b.PNG", "image/png")]


def test_charsets(spark):
    data = [(1, "<meta charset=utf-8>é".encode()), (2, '<meta content="text/html; charset=Shift_JIS">日本'.encode("shift_jis")), (3, "日本".encode("shift_jis")), (4, b"<meta charset='nope'>"), (5, "charset=euc-jp 漢字".encode("euc_jp"))]
    got = {r["k"]: (r["charset"], r["text"], r["error"]) for r in markup.decoded(spark.createDataFrame(data, "k int, content binary")).collect()}
    assert got[1][0] == "utf-8" and got[1][1].endswith("é") and got[2][1].endswith("日本") and got[3] == ("shift_jis", "日本", None)
    assert got[4] == ("nope", None, "unsupported encoding: nope") and got[5][1].endswith("漢字")


def test_slices_and_mojibake(spark):
    df = spark.createDataFrame([("<a> x <b>", "縺 bad"), ("<b><c>", "fine")], "h string, t string")
    got = df.select(markup.between_markers(F.col("h"), "<a>", "<b>"), tx.has_mojibake(F.col("t")), tx.utf16_length(F.lit("😀a"))).collect()
    assert [tuple(r) for r in got] == [("x", True, 3), (None, False, 3)]
    head = spark.createDataFrame([(1, '<a id="m1">One</a><a id="m2">Two</a><meta name="author" content=" N ">')], "page_id int, html string")
    assert rows(markup.headings(head, r'<a id="([^"]*)">[^<]*</a>', r'<a id="[^"]*">([^<]*)</a>'), "heading_idx") == [(1, 0, "m1", "One"), (1, 1, "m2", "Two")]
    assert head.select(markup.meta_content(F.col("html"), "author")).first()[0] == "N"


TSV = {
    "plain": "source_text\ttarget_text\nHello\tこんにちは\nBye\tさようなら",
    "scored": "﻿# exported_by=twinfold\r\n# source_title=S\r\n# target_title=T\r\n# src_lang=en\r\n# tgt_lang=ja\r\nHello\tこんにちは\t0.92\r\nx\ty\t1.5\r\nz\tw\t0.9abc",
    "old": "# Book A ↔ Book B\n# src_lang=en\ttgt_lang=ja\na\tb",
    "gaps": "Hello\t\t\n\tこんにちは\n\t\t0.5\na\tb\tc\td",
    "comment": "# just a comment",
    "one": "one column only\na\tb",
    "empty": "",
}


def test_pair_tsv(spark):
    kinds = pair_tsv.classified(pair_tsv.lines(spark.createDataFrame(list(TSV.items()), "file string, content string")))
    found = pair_tsv.pairs(kinds)
    got = {}
    for r in found.orderBy("file", "pair_seq").collect():
        got.setdefault(r["file"], []).append((r["src_text"], r["tgt_text"], r["alignment_type"], r["confidence"]))
    assert got == {
        "plain": [("Hello", "こんにちは", "1:1", None), ("Bye", "さようなら", "1:1", None)],
        "scored": [("Hello", "こんにちは", "1:1", 0.92), ("x", "y", "1:1", None), ("z", "w", "1:1", 0.9)],
        "old": [("a", "b", "1:1", None)],
        "gaps": [("Hello", "", "1:0", None), ("", "こんにちは", "0:1", None)],
    }
    meta = {r["file"]: tuple(r)[1:] for r in pair_tsv.metadata(kinds).collect()}
    assert meta["scored"] == (True, "S", "T", "en", "ja") and meta["old"] == (False, "Book A", "Book B", "en", "ja") and meta["empty"] == (False, "", "", "", "")
    bad = {(r["file"], r["line_no"], r["level"], r["issue"]) for r in pair_tsv.issues(kinds, found).collect()}
    assert bad == {("scored", 7, "warning", "score"), ("gaps", 3, "warning", "empty"), ("gaps", 4, "warning", "width"), ("comment", None, "error", "no rows"), ("one", 1, "error", "fatal"), ("empty", None, "error", "no rows")}


PAIR = "pair_id string, pair_seq int, src_text string, tgt_text string, src_sent_idx int, src_para_idx int, src_global_idx int, tgt_sent_idx int, tgt_para_idx int, tgt_global_idx int, alignment_type string, confidence double"


def test_round_trips(spark):
    pairs = spark.createDataFrame([("p", 0, "#tag", "b\tc", 0, 0, 0, 0, 0, 0, "1:1", 0.92), ("p", 1, "x", "", 1, 0, 1, None, None, None, "1:0", None)], PAIR)
    lines = exports.tsv_lines(pairs)
    content = lines.groupBy(F.col("pair_id").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    back = pair_tsv.pairs(pair_tsv.classified(pair_tsv.lines(content)))
    assert [(r["src_text"], r["tgt_text"], r["confidence"]) for r in back.orderBy("pair_seq").collect()] == [("#tag", "b c", 0.92), ("x", "", None)]
    langs = spark.createDataFrame([("p", "en", "fr")], "pair_id string, src_lang string, tgt_lang string")
    sources = spark.createDataFrame([("p", 0, "#tag x", ["i"])], "pair_id string, para_idx int, text string, image_ids array<string>")
    read = records.read(exports.record_json(pairs, langs, sources))
    assert sorted(map(tuple, records.pairs(read, "pair_id").select(pairs.columns).collect())) == sorted(map(tuple, pairs.collect()))
    assert [(r["para_idx"], r["text"]) for r in records.source_paragraphs(read, "pair_id").collect()] == [(0, "#tag x")]
    foreign = spark.createDataFrame([("a", "{"), ("b", '{"exported_by":"other","version":1}'), ("c", '{"exported_by":"twinfold","version":2}'), ("d", None)], "k string, json string")
    assert records.read(foreign).where("record is not null").count() == 0
    books = spark.createDataFrame([("p",), ("q",)], "pair_id string")
    assert [r[0] for r in records.without_record(books, records.source_paragraphs(read, "pair_id"), "pair_id").collect()] == ["q"]


def test_written_tsv(spark, tmp_path):
    pairs = spark.createDataFrame([("p", 0, "a", "b", 0, 0, 0, 0, 0, 0, "1:1", 0.5), ("q", 0, "c", "d", 0, 0, 0, 0, 0, 0, "1:1", None)], PAIR)
    exports.write_tsv(exports.tsv_lines(pairs), str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out"), wholetext=True).where("pair_id = 'p'").first()["value"]
    assert text.splitlines()[-1] == "a\tb\t0.5000" and text.startswith("# exported_by")


def test_spine(spark):
    import io
    import zipfile

    from twinfold.sources import spine

    def book(files):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
        return data.getvalue()

    opf = '<opf:package xmlns:opf="x"><manifest><opf:item id="a" href="a.xhtml"/><item href="b.html" id="b"/><item id="n" href="toc.xhtml"/><item id="v" href="v.xhtml" properties="nav"/><item id="i" href="i.png"/><item id="m" href="missing.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="b"/><itemref idref="v"/><itemref idref="i"/><itemref idref="zz"/><itemref idref="m"/><itemref idref="a"/></spine></opf:package>'
    good = book({"META-INF/container.xml": '<container><rootfile full-path="c.opf"/></container>', "c.opf": opf, "a.xhtml": "<p>One.</p><p>Two.</p>", "b.html": "<p>First.</p>", "toc.xhtml": "x", "v.xhtml": "y", "i.png": "z"})
    df = spark.createDataFrame([(1, good), (2, b"not a zip"), (3, None), (4, book({"x": "y"}))], "book_id int, content binary")
    pages = spine.spine(spine.members(df))
    assert rows(pages.select("book_id", "spine_pos", "path"), "spine_pos") == [(1, 0, "b.html"), (1, 1, "a.xhtml")]
    assert rows(spine.book_paragraphs(pages), "para_idx") == [(1, 0, "First.", []), (1, 1, "One.", []), (1, 2, "Two.", [])]


def test_a_zip_is_opened_once(spark):
    """The spine reads each book's files one time, whatever it joins them with."""
    import io
    import zipfile

    from twinfold.sources import spine

    def book(k):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("META-INF/container.xml", '<rootfile full-path="o.opf"/>')
            z.writestr("o.opf", '<item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="c.xhtml"/><itemref idref="c"/><itemref idref="b"/><itemref idref="a"/>')
            z.writestr("a.xhtml", f"text {k}")
            z.writestr("b.xhtml", "")
        return data.getvalue()

    opened = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            opened.add(len(batch))
            yield batch

    books = spark.createDataFrame([(k, book(k)) for k in range(4)] + [(9, b"no zip"), (10, None)], "book_id long, content binary")
    found = spine.spine(spine.members(books).mapInArrow(counted, "book_id long, path string, data binary"))
    assert sorted(tuple(r) for r in found.collect()) == [(k, 0, "a.xhtml", f"text {k}") for k in range(4)]
    assert opened.value == 16
