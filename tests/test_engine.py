"""The engine against small cases worked out by hand, and folds written out in Python."""

from __future__ import annotations

import math
import random
from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import metrics, pixels
from leafmill.functions import text as T
from leafmill.config import Config
from leafmill.operators import block_decode, corpus, decode, evaluate, lookup, rewrite, spatial, suppress, text_tree, transliterate, tree
from leafmill.plans import api, layout_queries, segment, source_queries, text_queries
from leafmill.sources import detector, files, images, layout_xml

Box = namedtuple("Box", "l t w h conf")


def value(spark, column, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(column.alias("x")).first()["x"] if columns else spark.range(1).select(column.alias("x")).first()["x"]


def points(s: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFD", s)


@pytest.mark.parametrize(
    ("raw", "simple"),
    [
        ("זייַנען", "זײַנען"), ("ייִדן", "ייִדן"), ("פּרוּוון", "פּרוּװן"), ("איידער", "אײדער"), ("ברויט", "ברױט"), ("ווען", "װען"), ("כִּמְעַט", "כּמעט"), ("אֶרֶץ-יִשְׂרָאֵל", "ארץ־יִשׂראל"), (",,וואָס''", "„װאָס“"), ("''", "“"),
        ('"', "“"), ("'", "’"), ("‛‛", "“"), ("←", "—"), ("◦ № ▼ ⁂", "• • • •"), ("ד⸗ר", "ד־ר"), ("\ufb31", "בּ"), ("דֿ", "ד"), ("תׂ", "ת"), ("\ufb1f", "ײַ"), ("a|b", "a|b"),
    ],
)
def test_simplified(spark, raw, simple):
    assert value(spark, T.simplified(F.col("s")), s=raw) == points(simple)


def test_presentation_forms_by_code_point(spark):
    import unicodedata

    assert all(0xFB1D <= ord(k) <= 0xFB4E and v == unicodedata.normalize("NFD", k) != k for k, v in T.PRESENTATION_FORMS.items()) and len(T.PRESENTATION_FORMS) > 30
    everything = "".join(T.PRESENTATION_FORMS)
    assert value(spark, T.decomposed(F.col("s")), s=everything) == points(everything)


def test_alphabet_mask(spark):
    assert value(spark, T.simplified(F.col("s"), True), s="Hello") == "LLLLL"
    assert value(spark, T.simplified(F.col("s"), True), s="Привет") == "CCCCCC"


NORMAL = ["ייִדן", "אָװנט", "איך האָב געגנבֿעט אַ בוך.", "דאָס איז ממש אַ מחיה.", "ניפֿטר"]
ROMAN = ["yidn", "ovnt", "ikh hob geganvet a bukh.", "dos iz mamesh a mekhaye.", "nifter"]
PHONETIC = ["ייִדן", "אָװנט", "איך האָב געגאַנװעט אַ בוך.", "דאָס איז מאַמעש אַ מעכײַע.", "ניפֿטער"]
#: Words of the lines above that are not read as they are spelled.
READINGS = [("געגנבֿעט", ["געגאַנװעט"]), ("ממש", ["מאַמעש"]), ("מחיה", ["מעכײַע"]), ("ניפֿטר", ["ניפֿטער"])]


def test_transliteration(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(NORMAL, ROMAN, PHONETIC))], "i int, normal string, roman string, phonetic string")
    for r in df.select("*", T.transliterated(F.col("phonetic")).alias("t"), T.detransliterated(F.col("roman")).alias("d"), T.precombined(F.col("phonetic")).alias("p"), T.with_points(T.detransliterated(F.col("roman"))).alias("w")).collect():
        assert (r["t"], r["d"], points(r["w"])) == (r["roman"], r["p"], points(r["phonetic"]))
    dictionary = spark.createDataFrame(READINGS, "word string, readings array<string>")
    there = transliterate.transliterate(df.select("i", F.col("normal").alias("text")), ["i"], dictionary).orderBy("i").collect()
    assert [r["text"] for r in there] == ROMAN
    back = transliterate.detransliterate(df.select("i", F.col("roman").alias("text")), ["i"], dictionary).select("i", T.with_points(F.col("text")).alias("text")).orderBy("i").collect()
    assert [points(r["text"]) for r in back] == [points(x) for x in NORMAL]
    rare = spark.createDataFrame([("ממש", ["מאַמ", "מאַמעש"])], "word string, readings array<string>")
    assert transliterate.transliterate(df.filter("i = 3").select("i", F.col("normal").alias("text")), ["i"], rare, ("מאַמ",)).first()["text"].split()[2] == "mamesh"


@pytest.mark.parametrize(("roman", "letters"), [("fareynikt", "פֿאַראײניקט"), ("proyekt", "פּראָיעקט"), ("arbets", "אַרבעטס"), ("geyogt", "געיאָגט"), ("oysher", "אױשער"), ("oyshaltn", "אױסהאַלטן"), ("pikholts", "פּיקהאָלץ"), ("rayon", "ראַיאָן"), ("umloyal", "אומלאָיאַל"), ("haltst", "האַלטסט"), ("yidish", "ייִדיש"), ("m", "מ"), ("shteyn.", "שטײן.")])
def test_stems_and_finals(spark, roman, letters):
    assert points(value(spark, T.with_points(T.detransliterated(F.col("s"))), s=roman)) == points(letters)


def test_signs(spark):
    assert value(spark, T.standard_punctuation(F.col("s")), s="a-b′׳″״") == 'a־b""""'
    assert value(spark, T.without_points(F.col("s")), s="פּרוּװן שׂ") == "פרוװן ש"
    assert value(spark, T.precombined(F.col("s")), s="בּיי") == "בײ"
    assert value(spark, T.without_dram_sign(F.col("s")), s="a֏'") == "a’"


@pytest.mark.parametrize(("raw", "turned"), [("24", "42"), ("123.45", "54.321"), ("71טן", "17טן"), ("Jimi", "Jimi"), ("7", "7")])
def test_reversed_numbers(spark, raw, turned):
    assert value(spark, T.reversed_numbers(F.col("s")), s=raw) == turned


def test_outer_punctuation(spark):
    assert value(spark, T.without_outer_punctuation(F.col("s")), s="„רבונו־של־עולם“,") == "רבונו־של־עולם"


def test_tokens_and_characters(spark):
    assert value(spark, T.tokens(F.col("s")), s="a  b ") == ["a", "b"]
    assert value(spark, T.tokens(F.col("s")), s=" a") == ["", "a"]
    assert value(spark, T.characters(F.col("s")), s="אַב") == ["אַ", "ב"]


def test_names(spark):
    assert value(spark, T.without_extension(F.col("s")), s=".a.tar.gz") == ".a.tar"
    assert value(spark, T.without_extension(F.col("s"), True), s="a.tar.gz") == "a"
    assert value(spark, T.rounded_half_up(F.col("x"), 2), x=0.125) == 0.13


def test_iou_is_symmetric(spark):
    rnd = random.Random(1)
    rows = [tuple(rnd.randrange(0, 20) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame(rows, [p + c for p in ("a_", "b_") for c in "ltwh"])
    a, b = G.rect("a_"), G.rect("b_")
    for r in df.select(G.iou(a, b).alias("x"), G.iou(b, a).alias("y"), G.contains(a, b).alias("c"), G.intersection_area(a, b).alias("i"), b.area.alias("area")).collect():
        assert r["x"] == r["y"]
        assert not r["c"] or r["i"] == r["area"]


def test_bands_equal_the_fold(spark):
    rnd = random.Random(2)
    rows = [(d, i, y, 0, 500) for d in range(20) for i, y in enumerate(sorted(rnd.randrange(0, 500) for _ in range(8)))]
    got = spatial.line_bands(spark.createDataFrame(rows, "doc_id int, line_idx int, y int, block_t int, block_b int"), ["doc_id"]).collect()
    for d in range(20):
        top, ys = 0, [r[2] for r in rows if r[0] == d]
        for i, y in enumerate(ys):
            bottom = y + int((ys[i + 1] - y) * 0.25) if i + 1 < len(ys) else 500
            r = next(r for r in got if r["doc_id"] == d and r["line_idx"] == i)
            assert (r["band_t"], r["band_b"]) == (top, bottom)
            top = bottom


def test_overlap_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    boxes = [(rnd.randrange(2), i, rnd.randrange(300), rnd.randrange(900), rnd.randrange(1, 90), rnd.randrange(1, 350)) for i in range(80)]
    a = spark.createDataFrame(boxes, "page int, i int, a_l int, a_t int, a_w int, a_h int")
    b = spark.createDataFrame(boxes, "page int, j int, b_l int, b_t int, b_w int, b_h int")
    got = {(r["i"], r["j"]) for r in spatial.overlap_join(a, b, ["page"]).collect()}
    want = {(x[1], y[1]) for x in boxes for y in boxes if x[0] == y[0] and min(x[2] + x[4], y[2] + y[4]) > max(x[2], y[2]) and min(x[3] + x[5], y[3] + y[5]) > max(x[3], y[3])}
    assert got == want


def test_units_along_equal_all_pairs(spark):
    """Units moved as far as into other words, lines over several batches; nothing is shuffled."""
    rnd = random.Random(5)
    rows = []
    for d, n in ((1, 40), (1, 1), (2, 3), (3, 70)):
        at, line = rnd.randint(0, 9), len(rows)
        for k in range(n):
            w = rnd.randint(0, 4) * 10 + 10
            rows.append((d, line, k, at, w))
            at += w + rnd.choice((0, 10, 20))
    df = spark.createDataFrame(rows, "doc_id long, line_idx int, tok_idx int, l int, w int").coalesce(1)
    want = {}
    for d, line, k, l, w in rows:
        for i in range(w // 10):
            x = l + i * 10 + (i * 5 + k) % 33 - 9
            into = [t for d2, line2, t, l2, w2 in rows if (d2, line2) == (d, line) and min(x + 10, l2 + w2) - max(x, l2) > 5]
            for t in into[:1]:
                n, s = want.get((d, line, t), (0, 0))
                want[d, line, t] = n + 1, s + i
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = spatial.units_along(df, ["doc_id", "line_idx"], "tok_idx", lambda tok, i: (i * 5 + tok) % 33 - 9, 10)
        assert {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_place_in_word_shuffles_nothing(spark, tmp_path):
    spark.createDataFrame([(i, "ab c  def\n\n x" * (i + 1)) for i in range(8)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = layout_queries.place_in_word(spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.sum("n_glyphs")).first()[0] > 0


def test_reading_order_of_three_boxes(spark):
    rows = [("p", 0, 10, 10, 50, 50), ("p", 1, 60, 10, 100, 100), ("p", 2, 20, 120, 50, 50)]
    df = spark.createDataFrame(rows, "page_id string, det_id int, l int, t int, w int, h int")
    got = suppress.sort_pages(df, ["page_id"], False).orderBy("reading_idx").collect()
    assert [(r["l"], r["t"]) for r in got] == [(60, 10), (10, 10), (20, 120)]


def test_reading_order_never_fails():
    rnd = random.Random(4)
    for _ in range(50):
        page = [Box(rnd.randrange(100), rnd.randrange(100), rnd.randrange(1, 60), rnd.randrange(1, 60), 0.5) for _ in range(12)]
        assert sorted(suppress.reading_order(page, True)) == sorted(page)


def test_suppression():
    a, b, c = Box(0, 0, 10, 10, 0.5), Box(2, 0, 10, 10, 0.9), Box(30, 0, 10, 10, 0.1)
    assert suppress.keep_ordered([a, b, c]) == [b, c]
    kept = suppress.keep_unordered([a, b, c])
    assert len(kept) == 2 and (kept[0].l, kept[0].w) == (0, 12) and math.isclose(kept[0].conf, math.sqrt(0.45))
    rnd = random.Random(5)
    boxes = [Box(rnd.randrange(60), 0, 10, 10, rnd.random()) for _ in range(25)]
    once = suppress.keep_ordered(sorted(boxes))
    assert all(suppress._either_share(x, y) <= suppress.ORDERED_SHARE for x, y in zip(once, once[1:])) or suppress.keep_ordered(once)
    near = suppress.neighbours(boxes)
    assert all((j in near[i]) == (i != j and suppress._overlap(x, y) > 0) for i, x in enumerate(boxes) for j, y in enumerate(boxes))


def test_processed_text(spark):
    rows = [(0, 0, 0, "word", "Jimi", None), (0, 0, 1, "space", " ", None), (0, 0, 2, "word", "Hend", "Hendrix"), (0, 0, 3, "hyphen", "-", None), (0, 1, 0, "word", "rix", "Hendrix"), (0, 1, 1, "space", " ", None), (0, 1, 2, "word", "Experience", None)]
    df = spark.createDataFrame(rows, "doc_id int, line_idx int, tok_idx int, kind string, content string, subs_content string")
    assert text_tree.processed_text(df).first()["content"] == "Jimi Hendrix Experience"


def test_k_best_equals_brute_force(spark):
    from itertools import product

    rnd = random.Random(6)
    words = [[[("abc"[o], rnd.random() * 0.9 + 0.05) for o in range(3)] for _ in range(4)] for _ in range(20)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, g array<array<struct<outcome:string,conf:double>>>")
    for r in df.select("i", decode.k_best(F.col("g")).alias("b")).collect():
        scored = sorted(((math.prod(c for _, c in p) ** 0.25, "".join(o for o, _ in p)) for p in product(*words[r["i"]])), reverse=True)[:5]
        assert [b["text"] for b in r["b"]] == [t for _, t in scored]
        assert np.allclose([b["score"] for b in r["b"]], [s for s, _ in scored])


def test_k_best_ties_as_in_sql(spark, tmp_path):
    """Costs that are equal to nine decimals tie and go by the text, in the beam, too; unknown confidences come last."""
    import duckdb

    e = 1e-10
    vectors = [[0.0, e, 2 * e, 0.0, e, 0.0, 0.0, 0.0, e], [0.3, 0.1, 0.3, 0.3, 0.3, 0.1, 0.1, 0.3, 0.3], [2 * e, e, 0.0] * 3, [0.1, None, 0.3, 0.2, 0.1, 0.0, 0.4, 0.1, None], [0.5, 0.4, None] * 3, [None] * 9, [0.1, 0.2], None]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(f"select vec_id, rank, txt, score from ({text_queries.ORACLES['kbest_words']}) order by all").fetchall()
    assert [tuple(r) for r in text_queries.kbest_words(spark, str(tmp_path)).orderBy("vec_id", "rank").collect()] == want


def test_k_best_of_outcomes_of_several_letters(spark):
    """With equal confidences the words go by the text, though "a" begins "ab"."""
    from itertools import product

    options = [[("b", 0.5), ("ab", 0.5), ("a", 0.5), ("", 0.5)]] * 4
    df = spark.createDataFrame([(options,)], "g array<array<struct<outcome:string,conf:double>>>")
    words = sorted("".join(o for o, _ in p) for p in product(*options))
    assert [b["text"] for b in df.select(decode.k_best(F.col("g"), 7).alias("b")).first()["b"]] == words[:7]


def test_hyphen_decisions(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("ארץ", "ישראל", "ארץ־ישראל", "געװאָרן")], "word string")
    pairs = spark.createDataFrame([(a, "־", b, 0.5, 0.5) for a, b in (("ארץ", "ישראל"), ("גע", "װאָרן"), ("ארץ", "כוש"), ("גע", "שריבן"))], "first string, hyphen string, second string, s1 double, s2 double")
    got = {r["content"]: r["keeps_hyphen"] for r in decode.hyphen_status(pairs, lexicon, r"[םןץףך][א-ת]").collect()}
    assert got == {"ארץ־ישראל": True, "געװאָרן": False, "ארץ־כוש": True, "געשריבן": False}


def test_word_frequency(spark):
    lexicon = spark.createDataFrame([("דער",), ("זי",)], "word string")
    cases = {"ארץישראל": -1, "דער": 1, "האָצנפּלאָץ": 0, "דער־זי": 1, "דער־האָצנפּלאָץ": 0, "דער־דץר": -1, "“דער־זי": 1}
    got = api.word_frequency(spark.createDataFrame([(w,) for w in cases], "word string"), lexicon)
    assert {r["word"]: r["freq"] for r in got.collect()} == cases


def test_punctuation_split(spark):
    glyphs = [(";", 10, 10, 10, 10, 0.1), ("a", 20, 20, 10, 10, 0.8), (",.", 30, 30, 20, 20, 0.35), ("bc", 50, 50, 20, 20, 0.8), (".", 70, 70, 10, 10, 0.7)]
    schema = "content string, l int, t int, w int, h int, conf double, glyphs array<struct<content:string,l:int,t:int,w:int,h:int,conf:double>>"
    df = spark.createDataFrame([(";a,.bc.", 10, 10, 70, 70, 0.8, glyphs)], schema)
    got = [(r["l"], r["t"], r["w"], r["h"], r["content"], round(r["conf"], 3)) for r in rewrite.split_punctuation(df).orderBy("part_idx").collect()]
    assert got == [(10, 10, 10, 10, ";", 0.1), (20, 20, 10, 10, "a", 0.8), (30, 30, 20, 20, ",.", 0.35), (50, 50, 20, 20, "bc", 0.8), (70, 70, 10, 10, ".", 0.7)]


@pytest.mark.parametrize(("word", "parts"), [("A‛B", ["A‛B"]), ("A“B", ["A“B"]), ("a'b'c", ["a'b'c"]), ("1.5", ["1.5"]), ("„AA“B“", ["„", "AA“B", "“"])])
def test_abbreviations_stay(spark, word, parts):
    glyphs = [(c, i, 0, 1, 1, 0.5) for i, c in enumerate(word)]
    df = spark.createDataFrame([(word, 0, 0, 9, 1, 0.8, glyphs)], "content string, l int, t int, w int, h int, conf double, glyphs array<struct<content:string,l:int,t:int,w:int,h:int,conf:double>>")
    assert [r["content"] for r in rewrite.split_punctuation(df).orderBy("part_idx").collect()] == parts


def test_words_without_punctuation_need_no_glyphs(spark, tmp_path):
    """Glyphs are made of words that hold punctuation or marks only; the parts are the same."""
    text = "ab c, 1.5 don't (x) e\u0301f ---\n g"
    spark.createDataFrame([(3, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    at = ("doc_id", "line_idx", "tok_idx", "part_idx", "content", "w")
    want = rewrite.split_punctuation(text_queries._glyphs(spark, str(tmp_path))).select(*at[:-1], F.col("w").cast("long"))
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(text_queries.punct_tokens(spark, str(tmp_path))) == show(want)
    needed = text_queries._glyphs(spark, str(tmp_path), ~F.col("content").isin("ab", "g"))
    assert {r["content"] for r in needed.filter("glyphs is null").collect()} == {"ab", "g"}


def test_hyphen_rule(spark):
    df = spark.createDataFrame([(0, 0, "Hen־", 50, 10, 40, 100)], "line_idx int, tok_idx int, content string, l int, t int, w int, h int")
    got = [(r["kind"], r["content"], r["l"], r["w"]) for r in rewrite.split_hyphens(df, ["line_idx"]).orderBy("part_idx").collect()]
    assert got == [("word", "Hen", 60, 30), ("hyphen", "־", 50, 10)]


def test_expansion(spark):
    assert sorted(value(spark, rewrite.expanded(F.col("s"), "x", ("A", "O")), s="axbx")) == ["aAbA", "aAbO", "aObA", "aObO"]


def test_metrics(spark):
    df = spark.createDataFrame([("f", "a b b", "a b c")], "file string, p string, e string")
    assert math.isclose(metrics.bag_of_words_cosine(df, ["file"], "p", "e").first()["cosine"], 3 / math.sqrt(5 * 3))
    assert value(spark, metrics.character_error_rate(F.col("p"), F.col("e")), p="abc", e="abd") == 1 / 3
    assert value(spark, metrics.character_error_rate(F.col("p"), F.col("e")), p="abc", e="") is None


def test_layout_roundtrip_keeps_order(spark):
    xml = '<alto><Layout><Page ID="P1" WIDTH="100" HEIGHT="200"><PrintSpace><ComposedBlock ID="C"><TextBlock ID="T"><TextLine BASELINE="7" HPOS="1" WIDTH="9"><String CONTENT="a&amp;b" WC="0.456"><ALTERNATIVE PURPOSE="X">y</ALTERNATIVE></String><SP/><String CONTENT="c"/><HYP CONTENT="-"/></TextLine></TextBlock></ComposedBlock><Illustration ID="I"/></PrintSpace></Page></Layout></alto>'
    nodes = layout_xml.read_layout(spark.createDataFrame([("f", xml), ("bad", "<alto>")], "file string, xml string")).cache()
    assert nodes.filter("node = 'error'").count() == 1
    again = layout_xml.read_layout(layout_xml.write_layout(nodes.filter("node <> 'error'")))
    show = lambda df: [(r["node"], r["kind"], r["content"], r["x2"]) for r in df.filter("file = 'f'").orderBy("idx").collect()]
    assert show(again) == show(nodes)
    assert [r["kind"] for r in again.filter("node = 'token'").orderBy("idx").collect()] == ["word", "space", "word", "hyphen"]
    assert api.analyze(nodes.filter("node <> 'error'"), ("text",)).first()["text"] == "a&b c-"


def test_layout_roundtrip_of_many_lines(spark, tmp_path):
    """A document of more than 2,000 lines comes back with every word once and in order."""
    texts = {1: "\n".join(f"a{i}  b{i}" if i % 3 else f"c{i}" for i in range(2002)), 2: "x y\n\nz"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    nodes = source_queries.layout_nodes(spark, str(tmp_path)).select("file", "idx").collect()
    assert len(set(nodes)) == len(nodes)
    got = {r["file"]: (r["content"], r["n"]) for r in source_queries.layout_roundtrip(spark, str(tmp_path)).collect()}
    assert got == {str(d): (" ".join(t.split()), len(t.split())) for d, t in texts.items()}


def test_layout_written_in_order(spark, tmp_path, monkeypatch):
    """Nodes in order give the same files as nodes in any order, and few of them leave the reader together."""
    xml = '<alto><Layout><Page ID="P1" WIDTH="100" HEIGHT="200"><PrintSpace><ComposedBlock ID="C"><TextBlock ID="T"><TextLine BASELINE="7" HPOS="1" WIDTH="9"><String CONTENT="a&amp;b" WC="0.456"><ALTERNATIVE PURPOSE="X">y&lt;</ALTERNATIVE><Glyph CONTENT="a" GC="0.5"/></String><SP/><String CONTENT="c"/><HYP CONTENT="-"/></TextLine></TextBlock></ComposedBlock><Illustration ID="I"/><TextBlock ID="U"/></PrintSpace></Page><Page ID="P2"><PrintSpace/></Page></Layout></alto>'
    nodes = layout_xml.read_layout(spark.createDataFrame([("f", xml), ("g", xml.replace("C", "D"))], "file string, xml string").coalesce(1))
    depth = F.when(F.col("node") == "page", 0).when(F.col("node") == "block", F.when(F.col("id") == "T", 2).otherwise(1)).when(F.col("node") == "line", 3).when(F.col("node") == "token", 4).otherwise(5)
    show = lambda df: {r["file"]: r["xml"] for r in df.collect()}
    assert show(layout_xml.write_layout_in_order(nodes.withColumn("depth", depth))) == show(layout_xml.write_layout(nodes))

    texts = {1: "\n  a b\n \nc  d", 2: " ", 3: None, 4: "x & <y>\n"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = show(layout_xml.write_layout(source_queries.layout_nodes(spark, str(tmp_path))))
    assert sorted(want) == ["1", "4"]
    assert show(layout_xml.fold_tags(source_queries.layout_tags(spark, str(tmp_path)))) == want

    monkeypatch.setattr(layout_xml, "ROWS", 3)
    sizes = layout_xml.read_layout(spark.createDataFrame([("f", xml)], "file string, xml string"))
    assert sizes.count() == nodes.filter("file = 'f'").count()


def test_confidence_of_a_long_line(spark, monkeypatch):
    """The fold goes on to the last of more than a million words."""
    words = spark.range(1_000_003).select(F.lit(1).alias("doc_id"), F.lit(0).alias("line_idx"), F.col("id").cast("int").alias("tok_idx"), F.when(F.col("id") < 1_000_002, 1.0).otherwise(0.25).alias("conf"))
    monkeypatch.setattr(layout_queries.V, "words", lambda *_: words)
    assert [tuple(r) for r in layout_queries.combined_confidence(spark, "").collect()] == [(1, 0, 0.5)]


def test_baselines():
    assert layout_xml.baseline("", 1, 2) == (0, 0, 0, 0)
    assert layout_xml.baseline("5", 1, 0) == (1, 5, 2, 5)
    assert layout_xml.baseline("1,2 3,4", 0, 9) == (1, 2, 3, 4)


def test_detector(spark):
    images = spark.createDataFrame([("p", bytearray(b"x"))], "page_id string, image binary")
    answers = detector.detect(images, detector.table_detector([{"box": [50, 50, 11, 20], "class": "w", "conf": 0.9}, {"box": [1, 1, 1, 1], "class": "?", "conf": 0.9}]), "word")
    rows = detector.boxes_of(answers, {"w": "Word"}).collect()
    assert [tuple(r) for r in rows] == [("p", 0, "Word", 45, 40, 11, 20, 0.9)]

    def fails(image, level):
        raise OSError("no answer")

    assert detector.detect(images, fails, "word").first()["error"] == "OSError: no answer"


def test_detector_boxes_of_whole_texts(spark, tmp_path):
    """Every word of every line has its box, also behind the 20th word and the third line."""
    texts = {1: "\n".join(" ".join(f"w{i}x{j}" for j in range(25)) for i in range(6)), 2: "a  b\n\nc", 3: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, text in texts.items():
        words = [(i, j, line, w) for i, line in enumerate(text.split("\n")) for j, w in enumerate(line.split(" ")) if w]
        for k, (i, j, line, w) in enumerate(words):
            at, wide = 10 * len(" ".join([*line.split(" ")[:j], ""])), 10 * len(w)
            want.append((str(d), k, "Line" if j % 2 else "Word", 2 * (at + 500 - wide // 2), 2 * (20 * i + 500 - 8), 2 * wide, 32, (d * 13 + i * 7 + j * 3) % 100 / 100))
    got = source_queries.detector_boxes(spark, str(tmp_path)).select("page_id", "det_id", "label", "l", "t", "w", "h", "conf")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 153


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.png", "x"), ("b.txt", "w\nw\nv"), ("c.tsv", "i\tt\ni\t\ni\tt\tz")):
        (tmp_path / "in" / name).write_text(text)
    assert files.list_images(spark, str(tmp_path / "in")).count() == 1
    assert files.read_lexicon(spark, str(tmp_path / "in" / "b.txt")).count() == 2
    assert [tuple(r) for r in files.read_text_pairs(spark, str(tmp_path / "in" / "c.tsv")).collect()] == [("i", "t")]
    assert value(spark, files.layout_key(F.col("s")), s="d/x.jpg") == "d/x_alto4.xml"
    pages = files.pdf_pages(files.list_files(spark, str(tmp_path / "in"), "png"), lambda b: 5, 2, 3)
    assert [r["page_nr"] for r in pages.orderBy("page_nr").collect()] == [2, 3]
    archive = spark.createDataFrame([([("n", bytearray(b"c"))],)], "f array<struct<name:string,content:binary>>").select(files.zipped("f").alias("z")).first()["z"]
    assert bytes(archive[:2]) == b"PK"


def test_pixels():
    gray = np.arange(256, dtype=np.uint8).reshape(16, 16)
    assert pixels.contrasted(gray)[0, 0] == 20 and pixels.contrasted(gray)[-1, -1] == 255
    assert (pixels.rotated(gray, 0) == gray).all() and pixels.resized(gray, 8, 4).shape == (4, 8)
    two = np.where(np.arange(100).reshape(10, 10) < 50, 10, 200).astype(np.uint8)
    assert 10 <= pixels.threshold(two) < 200
    assert pixels.glyph_vector(gray, 2, 2, 4, 8).shape == (784,)


def test_segmenter(spark):
    rows = [("p", "block", 0, "Text", 0, 0, 200, 100, 0.9), ("p", "line", 0, "Line", 10, 20, 150, 20, 0.9), ("p", "word", 0, "Word", 10, 12, 40, 16, 0.9), ("p", "word", 1, "Word", 60, 12, 40, 16, 0.9), ("p", "glyph", 0, "Glyph", 12, 12, 10, 16, 0.9), ("p", "glyph", 1, "Glyph", 62, 12, 10, 16, 0.9), ("p", "paragraph", 0, "Par", 0, 300, 50, 50, 0.9)]
    got = segment.segment_full(spark.createDataFrame(rows, "page_id string, level string, det_id int, label string, l int, t int, w int, h int, conf double"), True)
    assert got.words.count() == 2 and got.glyphs.count() == 2 and got.lines.count() == 1
    assert [(r["l"], r["w"]) for r in got.spaces.collect()] == [(50, 10)]
    assert got.blocks.count() == 1  # the lost paragraph became a block, but holds no line


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("LEAFMILL_BEAM", "7")
    monkeypatch.setenv("LEAFMILL_CROP_TO_PRINT_AREA", "false")
    spark.conf.set("spark.leafmill.hyphen", "-")
    try:
        c = Config.of(spark, tiles=3)
    finally:
        spark.conf.unset("spark.leafmill.hyphen")
    assert (c.beam, c.crop_to_print_area, c.hyphen, c.tiles, c.language) == (7, False, "-", 3, "yi")


def test_lookup_of_hot_words(spark, monkeypatch):
    """All ways of looking words up give the same rows."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("word"))
    entries = spark.createDataFrame([("hot", 1), ("w1", 2), ("w7", 3)], "word string, n int")
    want = sorted(map(str, lookup.lookup_join(rows, entries, ["word"]).select("id", "word", "n").collect()))
    monkeypatch.setattr(lookup, "MOST_ENTRIES", 0)
    assert sorted(map(str, lookup.lookup_join(rows, entries, ["word"]).select("id", "word", "n").collect())) == want


GLYPHS = "array<struct<content:string,l:int,t:int,w:int,h:int,conf:double>>"


@pytest.mark.parametrize(
    ("glyphs", "word", "hyphen"),
    [
        ([("H", 50, 10), ("e", 60, 10), ("n", 70, 10), ("־", 80, 10)], ("Hen", 50, 30), ("־", 80, 10)),
        ([("H", 40, 10), ("e", 30, 10), ("n־", 10, 20)], ("Hen", 20, 30), ("־", 10, 10)),
    ],
)
def test_hyphen_rule_by_glyphs(spark, glyphs, word, hyphen):
    left, right = min(g[1] for g in glyphs), max(g[1] + g[2] for g in glyphs)
    df = spark.createDataFrame([(0, 0, "Hen־", left, 10, right - left, 100, [(c, l, 10, w, 100, 0.5) for c, l, w in glyphs])], f"line_idx int, tok_idx int, content string, l int, t int, w int, h int, glyphs {GLYPHS}")
    got = [(r["content"], r["l"], r["w"], r["t"], r["h"]) for r in rewrite.split_hyphens(df, ["line_idx"]).orderBy("part_idx").collect()]
    assert got == [(*word, 10, 100), (*hyphen, 10, 100)]


def test_alternatives(spark):
    """Standard and romanised spellings; an impossible alef is read as the lexicon knows it, else as a."""
    lexicon = spark.createDataFrame([("אָטאַם",), ("מער",), ("מאָמע",)], "word string")
    schema = "tok_idx int, content string, subs_content string, alternatives array<struct<purpose:string,content:string>>"
    df = spark.createDataFrame([(0, "מאמע", None, []), (1, "גאגא", None, []), (2, "מער", "מאמע", []), (3, "אטאם", None, [])], schema)
    got = {r["tok_idx"]: {a["purpose"]: a["content"] for a in r["alternatives"]} for r in rewrite.spelling_alternatives(df, lexicon).collect()}
    assert got[0] == {"YIVO": "מאָמע", "Roman": "mome"}
    assert got[1] == {"YIVO": "גאַגאַ", "Roman": "gaga"}
    assert got[2] == {"Roman": "mer", "YIVOHyphenated": "מאָמע", "RomanHyphenated": "mome"}
    assert got[3] == {"YIVO": "אָטאַם", "Roman": "otam"}


def test_rewriting(spark):
    """Simple signs, hyphen, punctuation, numbers, alternatives, in this order."""
    glyph = lambda text, l: [(c, l + 10 * i, 0, 10, 10, 0.5) for i, c in enumerate(text)]
    words = [("ווען,", 0), ("24", 100), ("Hen-", 200)]
    rows = [(0, i, w, l, 0, 10 * len(w), 10, 0.8, glyph(w, l), None, []) for i, (w, l) in enumerate(words)]
    df = spark.createDataFrame(rows, f"line_idx int, tok_idx int, content string, l int, t int, w int, h int, conf double, glyphs {GLYPHS}, subs_content string, alternatives array<struct<purpose:string,content:string>>")
    lexicon = spark.createDataFrame([("װען",)], "word string")
    got = rewrite.rewrite_tokens(df, ["line_idx"], lexicon).orderBy("tok_idx").collect()
    assert [(r["tok_idx"], r["kind"], r["content"]) for r in got] == [(0, "word", "װען"), (1, "word", ","), (2, "word", "42"), (3, "word", "Hen"), (4, "hyphen", "־")]
    assert {a["purpose"]: a["content"] for a in got[0]["alternatives"]} == {"Roman": "ven"}
    bare = rewrite.rewrite_tokens(df, ["line_idx"], lexicon, hyphens=False, remove_glyphs=True).orderBy("tok_idx").collect()
    assert [r["content"] for r in bare] == ["װען", ",", "42", "Hen", "־"] and not any(r["glyphs"] for r in bare)


@pytest.mark.parametrize(
    ("first", "second", "content", "whole"),
    [("ארץ־", "ישראל", "ארץ־", "ארץ־ישראל"), ("גע־", "װאָרן", "גע־", "געװאָרן"), ("ארץ־", "כוש", "ארץ־", "ארץ־כוש"), ("גע־", "שריבן", "גע־", "געשריבן")],
)
def test_block_decode(spark, first, second, content, whole):
    lexicon = spark.createDataFrame([(w,) for w in ("ארץ", "ישראל", "ארץ־ישראל", "געװאָרן")], "word string")
    rows = [("b", 0, 0, [("דאָ", 0.5)]), ("b", 0, 1, [(first, 0.5), (first[:-1] + "x", 0.4)]), ("b", 1, 0, [(second, 0.5)]), ("b", 1, 1, [("ישראל", 0.4), ("x", 0.5)])]
    df = spark.createDataFrame(rows, f"block string, line_idx int, tok_idx int, beam {block_decode.BEAM}")
    got = {(r["line_idx"], r["tok_idx"]): r for r in block_decode.decode_blocks(df, lexicon, ["block"], impossible=r"[םןץףך]\p{L}").collect()}
    assert (got[0, 1]["content"], got[0, 1]["subs_type"], got[0, 1]["subs_content"]) == (content, "HypPart1", whole)
    assert (got[1, 0]["content"], got[1, 0]["subs_type"], got[1, 0]["subs_content"]) == (second, "HypPart2", whole)
    assert got[1, 1]["content"] == "ישראל" and got[0, 0]["subs_type"] is None


def test_one_word_lines_keep_their_decision(spark):
    """Lines of one word that all may end in a hyphen: every other pair is decided, no word twice."""
    lexicon = spark.createDataFrame([("abcd",)], "word string")
    rows = [("b", i, 0, [(w, 0.5)]) for i, w in enumerate(["ab-", "cd-", "ab-", "cd"])]
    df = spark.createDataFrame(rows, f"block string, line_idx int, tok_idx int, beam {block_decode.BEAM}")
    got = [(r["content"], r["subs_type"], r["subs_content"]) for r in block_decode.decode_blocks(df, lexicon, ["block"], "-").orderBy("line_idx").collect()]
    assert [x[1] for x in got] == ["HypPart1", "HypPart2"] * 2 and got[2][2] == got[3][2] == "abcd"


def test_other_alphabets(spark):
    hebrew, latin = [[("א", 0.9)], [("L", 0.8)]], [[("b", 0.9)], [("a", 0.8)]]
    p = "array<array<struct<outcome:string,conf:double>>>"
    df = spark.createDataFrame([(0, "אL", 0.5, "yi", latin), (1, "אב", 0.5, "yi", latin)], f"i int, content string, score double, lang string, en {p}")
    got = block_decode.guess_other_alphabets(df, [("en", ".*L.*", "en")], False).orderBy("i").collect()
    assert (got[0]["content"], got[0]["lang"]) == ("ab", "en") and math.isclose(got[0]["score"], math.sqrt(0.72))
    assert (got[1]["content"], got[1]["lang"], got[1]["score"]) == ("אב", "yi", 0.5)
    beam = block_decode.beams(spark.createDataFrame([(hebrew,)], f"predictions {p}"), 1).first()["beam"]
    assert [g["text"] for g in beam] == ["אL"]


def test_whole_text_guesser(spark):
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"bad"))], "block int, image binary")

    def guess(image):
        if image == b"bad":
            raise ValueError("no text")
        return "<alto/>"

    got = {r["block"]: (r["xml"], r["error"]) for r in block_decode.guess_whole(df, ["block"], guess).collect()}
    assert got == {1: ("<alto/>", None), 2: ("", "ValueError: no text")}


PAGE = '<alto xmlns="x"><Description><Processing ID="S1"><processingDateTime>2024-05-01T10:00:00+02:00</processingDateTime><processingAgency>us</processingAgency><processingStepDescription>a</processingStepDescription><processingStepDescription>b</processingStepDescription><processingSoftware><softwareName>n&amp;m</softwareName></processingSoftware></Processing><Processing ID="S2"><processingDateTime>2024-05-01</processingDateTime></Processing></Description><Styles><TextStyle ID="F" FONTFAMILY="Arial" FONTSIZE="9.5"/></Styles><Tags><LayoutTag ID="T1" LABEL="Head"/><StructureTag ID="T2" LABEL="Body"/></Tags><Layout><Page ID="P" PHYSICAL_IMG_NR="1" WIDTH="1000" HEIGHT="2000" ROTATION="90" LANG="yi"><PrintSpace><TextBlock HPOS="100" VPOS="200" WIDTH="300" HEIGHT="100"><TextLine BASELINE="100,290 400,290" HPOS="100" VPOS="200" WIDTH="300" HEIGHT="100"><String CONTENT="a" HPOS="300" VPOS="200" WIDTH="100" HEIGHT="90"/><SP HPOS="250" VPOS="200" WIDTH="50" HEIGHT="90"/><String CONTENT="b" HPOS="100" VPOS="200" WIDTH="150" HEIGHT="90" LANG="en"/><HYP CONTENT="-"/></TextLine></TextBlock><ComposedBlock><TextBlock HPOS="1"/><TextBlock HPOS="2"/></ComposedBlock><Illustration/></PrintSpace></Page></Layout></alto>'


@pytest.fixture(scope="module")
def nodes(spark):
    return layout_xml.read_layout(spark.createDataFrame([("f", PAGE)], "file string, xml string")).cache()


def test_headers(spark, nodes):
    files_ = spark.createDataFrame([("f", PAGE)], "file string, xml string")
    headers = layout_xml.read_headers(files_)
    rows = headers.orderBy("idx").collect()
    assert [r["node"] for r in rows] == ["step", "step", "style", "LayoutTag", "StructureTag"]
    assert rows[0]["descriptions"] == ["a", "b"] and rows[0]["name"] == "n&m" and rows[2]["font_size"] == 9.5
    assert [str(r["at"]) for r in headers.orderBy("idx").select(F.date_format("at", "yyyy-MM-dd HH").alias("at")).collect()] == ["2024-05-01 08", "2024-05-01 00", "None", "None", "None"]
    again = layout_xml.read_headers(layout_xml.write_layout(nodes, headers))
    assert [tuple(r) for r in again.drop("file").orderBy("idx").collect()] == [tuple(r) for r in headers.drop("file").orderBy("idx").collect()]


def test_page_tree(spark, nodes):
    assert [r["l"] for r in tree.text_blocks(nodes).orderBy("block_nr").collect()] == [100, 1, 2]
    assert tree.blocks_of(nodes, "illustration").count() == 1 and tree.first_hyphens(nodes).first()["content"] == "-"
    assert tree.without_ids(nodes).filter("id is not null").count() == 0
    names = [r["id"] for r in tree.with_positional_ids(nodes).filter("node = 'block'").orderBy("idx").collect()]
    assert names == ["TB_00001_001_000", "CB_00001_002", "TB_00001_002_001", "TB_00001_002_002", "IL_00001_003"]
    langs = {(r["node"], r["content"]): r["language"] for r in tree.effective_languages(nodes, "he").collect()}
    assert langs["token", "a"] == "yi" and langs["token", "b"] == "en"
    turned = tree.with_language(nodes, "en", T.RIGHT_TO_LEFT)
    assert [r["content"] for r in turned.filter("node = 'token' and kind = 'word'").orderBy("idx").collect()] == ["b", "a"]


def test_page_cascade(spark, nodes):
    box = lambda df, node: tuple(df.filter(F.col("node") == node).orderBy("idx").select("l", "t", "w", "h").first())
    line = lambda df: tuple(df.filter("node = 'line'").select("x1", "y1", "x2", "y2").first())
    moved = tree.translate_pages(nodes, F.lit(5), F.lit(-7))
    assert box(moved, "block") == (105, 193, 300, 100) and line(moved) == (105, 283, 405, 283) and box(moved, "page") == (0, 0, 1000, 2000)
    cut = tree.crop_pages(nodes, G.Rect(F.lit(90), F.lit(150), F.lit(500), F.lit(600)))
    assert box(cut, "page") == (0, 0, 500, 600) and box(cut, "block") == (10, 50, 300, 100) and line(cut) == (10, 140, 310, 140)
    half = tree.rescale_pages(nodes, F.lit(0.5))
    assert box(half, "page") == (0, 0, 500, 1000) and box(half, "token") == (150, 100, 50, 45)
    level = tree.unrotate_pages(nodes)
    # (100, 290) is (-400, -710) from the centre; turned back by 90 degrees (-710, 400)
    assert line(level)[:2] == (-210, 1400)
    back = tree.rotate_pages(level)
    assert all(abs(a - b) <= 1 for a, b in zip(line(back), line(nodes)))


def test_output_formats(spark, nodes):
    got = api.analyze(nodes, ("layout", "text", "processed", "glyphless")).first()
    assert got["text"] == "a b-" and got["processed"].strip() == "a b-" and got["layout"] == got["glyphless"]
    archive = api.zipped_answers(api.analyze(nodes, ("text",)), ("text",)).first()["archive"]
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(archive)).read("f.txt") == b"a b-"
    with pytest.raises(api.BadRequest):
        api.AnalysisRequest("f", ("nothing",))
    with pytest.raises(api.NotFound):
        api.uploaded(b'--x\r\nContent-Disposition: form-data; name="a"\r\n\r\n1\r\n--x--\r\n', "multipart/form-data; boundary=x")
    assert api.uploaded(b'--x\r\nContent-Disposition: form-data; name="file"; filename="p.pgm"\r\n\r\nP5\r\n--x--\r\n', "multipart/form-data; boundary=x") == b"P5"
    assert "404" in api.error_record(api.NotFound("x")) and api.parsed_formats("text, layout") == ("text", "layout") and api.parsed_region("1,2,3,4") == (1, 2, 3, 4)
    answer = api.words_in_lexicon(["דער", "x1y"], spark.createDataFrame([("דער",)], "word string"))
    assert answer.to_json() == '[{"word": "דער", "frequency": 1}, {"word": "x1y", "frequency": -1}]'


@pytest.mark.parametrize(
    ("word", "parts"),
    [("a-b.c", [("text", "a"), ("punctuation", "-"), ("text", "b"), ("punctuation", "."), ("text", "c")]), ("a'b'c", [("abbreviation", "a'b"), ("abbreviation", "b'c")]), ("1.5", [("number", "1.5")]), ("12", [("number", "12")]), (",,", [("punctuation", ","), ("punctuation", ",")]), ("דער", [("text", "דער")])],
)
def test_word_parts(spark, word, parts):
    assert [tuple(p) for p in value(spark, api.word_parts(F.col("s")), s=word)] == parts


def gray_page() -> np.ndarray:
    """Lines of text, slanted by two degrees."""
    page = np.full((300, 400), 255, dtype=np.uint8)
    y, x = np.mgrid[0:300, 0:400]
    for k in range(40, 280, 40):
        at = (y - k - x * np.tan(np.deg2rad(2))).astype(int)
        page[(at >= 0) & (at < 8) & (x > 40) & (x < 360) & (x // 6 % 4 < 3)] = 0
    return page


def test_images(spark, tmp_path):
    page = gray_page()
    (tmp_path / "a.png").write_bytes(images.encoded(page))
    (tmp_path / "b.png").write_bytes(b"nothing")
    found = images.scan_images(spark, str(tmp_path)).cache()
    rows = {r["path"][-5:]: r for r in found.collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (400, 300) and rows["b.png"]["error"].startswith("ValueError")
    good = found.filter("error is null")
    assert abs(images.skew(good).first()["skew"] - 2) < 0.3
    out = images.transformed(good, [images.contrast_step(), images.fit_step(200, 200), images.unrotate_step(2.0)]).first()
    assert (out["width"], out["height"]) == (200, 150) and out["found"] == {"scale": 0.5, "skew": 2.0}
    cut = images.cropped(good, F.lit(10), F.lit(20), F.lit(30), F.lit(40)).first()
    assert (cut["width"], cut["height"]) == (30, 40)
    pages = images.render_pages(spark.createDataFrame([("d.pdf", bytearray(b"12"))], "path string, content binary"), len, lambda content, n, dpi: np.full((dpi // 100, n), 7, dtype=np.uint8))
    assert sorted((r["path"], r["width"], r["height"]) for r in pages.collect()) == [("d.pdf#1", 1, 3), ("d.pdf#2", 2, 3)]


def test_urls_and_service(spark):
    import io

    urls = spark.createDataFrame([("http://a/p.pgm",), ("http://a/none",)], "url string")
    with pytest.raises(PermissionError):
        images.fetch(urls)
    data = images.encoded(gray_page())

    def open_url(url, timeout):
        if url.endswith("none"):
            raise OSError("no answer")
        return io.BytesIO(data)

    def read(found):
        xml = '<alto><Layout><Page ID="P"><PrintSpace><TextBlock><TextLine><String CONTENT="hi"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>'
        return layout_xml.read_layout(found.select(F.col("path").alias("file"), F.lit(xml).alias("xml")))

    got = api.analyze_urls(urls, read, api.AnalysisRequest("p", ("text",)), True, open_url).collect()
    assert [(r["file"], r["text"]) for r in got] == [("http://a/p.pgm", "hi")]


def test_blots():
    dark = np.zeros((12, 30), dtype=bool)
    dark[2:4, 3:20] = True
    dark[4:6, 19:25] = True
    dark[9, 1] = True
    found = pixels.contours(dark)
    assert [(c[:4], c[5]) for c in found] == [((3, 2, 22, 4), 46), ((1, 9, 1, 1), 1)]
    assert pixels.dilated(dark, 3, 1)[9, :3].all() and not pixels.dilated(dark, 3, 1)[9, 3]
    assert pixels.blurred(np.full((5, 5), 9, dtype=np.uint8), 3).tolist() == [[9] * 5] * 5


def test_evaluation(spark):
    expected = spark.createDataFrame([("a", "ווען\n\nx"), ("b", "lost")], "file string, text string")
    predicted = spark.createDataFrame([("a", points("װען\nx"), 2.0)], "file string, text string, seconds double")
    got = {(r["file"], r["metric"]): r["value"] for r in evaluate.evaluate(predicted, expected, ignore_paragraphs=True).collect()}
    assert got["a", "CER"] == 0 and math.isclose(got["a", "BagOfWords"], 1.0) and got["a", "AnalysisTime"] == 2.0
    assert got["b", "CER"] == 1 and got["b", "BagOfWords"] == 0
    means = {r["metric"]: r["value"] for r in evaluate.report(evaluate.evaluate(predicted, expected)).filter("file = 'Mean'").collect()}
    assert means["AnalysisTime"] == "2.000"
    read = lambda df: df.select("file", F.lit("lost").alias("text"), F.lit(1.0).alias("seconds"))
    whole = evaluate.read_and_evaluate(spark.createDataFrame([("b",), ("c",)], "file string"), expected, read)
    assert {r["file"] for r in whole.collect()} == {"b"}


def test_training_boxes(spark):
    pages = spark.createDataFrame([("p", 1000, 500)], "page_id string, pw int, ph int")
    box = "l int, t int, w int, h int"
    blocks = spark.createDataFrame([("p", "text", True, 100, 100, 400, 200), ("p", "illustration", True, 600, 100, 100, 100)], f"page_id string, block_type string, top boolean, {box}")
    lines = spark.createDataFrame([("p", 0, 0, 100, 150, 500, 150, 100), ("p", 0, 1, 100, 250, 500, 250, 150)], "page_id string, block int, line_idx int, x1 int, y1 int, x2 int, y2 int, band_t int")
    words = spark.createDataFrame([("p", 0, 0, 100, 110, 100, 40)], f"page_id string, block int, line_idx int, {box}")
    glyphs = spark.createDataFrame([("p", 0, 0, 0, 0, 100, 110, 50, 40), ("p", 0, 0, 0, 1, 150, 110, 50, 40)], f"page_id string, block int, line_idx int, word_idx int, glyph_idx int, {box}")
    spaces = spark.createDataFrame([("p", 0, 0, 200, 110, 20, 40)], f"page_id string, block int, line_idx int, {box}")
    boxes = corpus.training_boxes(pages, blocks, lines, words, glyphs, spaces)
    counts = {r["kind"]: r["count"] for r in boxes.groupBy("kind").count().collect()}
    assert counts == {"TopLevelTextBlock": 1, "Illustration": 1, "TextBlock": 1, "BaseLine": 2, "NonFinalBaseLine": 1, "FinalBaseLine": 1, "Word": 1, "Glyph": 2, "WordSeparator": 1, "GlyphSeparator": 1}
    label = {r["label"] for r in corpus.label_lines(corpus.tiled(boxes, pages, 1, 0), corpus.KINDS).collect()}
    assert "0 0.300000 0.400000 0.410000 0.400000" in label and "6 0.150000 0.260000 0.100000 0.080000" in label and "8 0.210000 0.250000 0.020000 0.085000" in label
    corners = [r["label"] for r in corpus.label_lines(corpus.tiled(boxes.filter("kind = 'Word'"), pages, 1, 0), ("Word",), True).collect()]
    assert corners == ["0 0.100000 0.220000 0.100000 0.300000 0.200000 0.300000 0.200000 0.220000"]
    tiles = corpus.tiled(boxes.filter("kind = 'Word'"), pages, 2, 0.125)
    assert [(r["tile"], round(r["w"], 6)) for r in tiles.collect()] == [(0, round(100 / 562, 6))]
    assert corpus.dataset_description("d", ("A", "B")).endswith("names:\n  0: A\n  1: B\n")


def test_text_items(spark):
    items = spark.createDataFrame([("f.png", i, w, 10 * i, 0, 10, 10) for i, w in enumerate(["ווען", "Hello", "c"])], "file string, i int, content string, l int, t int, w int, h int")
    got = [(r["split"], r["image"], r["text"]) for r in corpus.text_items(items, ["i"], 3, 2).orderBy("l").collect()]
    assert got == [("train", "f_000.png", "װען"), ("val", "f_001.png", "LLLLL"), ("train", "f_002.png", "L")]
    g = corpus.glyph_items(items, spark.createDataFrame([("f.png", 25, 20)], "file string, pw int, ph int")).orderBy("l").collect()
    assert [tuple(r)[2:] for r in g] == [(0, 0, 11, 11), (10, 0, 11, 11), (20, 0, 5, 11)]
    assert corpus.selected_words(items, "[a-z]").count() == 1 and corpus.alphabet_of(items, "content").count() == 8


def test_files_and_lexicons(spark, tmp_path):
    for name in ("a.png", "b.png", "a_alto4.xml"):
        (tmp_path / name).write_bytes(PAGE.encode() if name.endswith("xml") else b"x")
    pictures, layouts = files.list_files(spark, str(tmp_path), files.IMAGES), files.list_files(spark, str(tmp_path), "_alto4.xml$")
    assert files.with_layouts(pictures, layouts).count() == 1
    assert files.allowed_files(pictures, spark.createDataFrame([("b.png",)], "name string")).count() == 1 and files.allowed_files(pictures, None, 1).count() == 1
    got = corpus.annotated(pictures, layouts, lambda nodes: tree.tokens_of(nodes, "word"))
    assert got.count() == 2
    files.write_lexicon(spark.createDataFrame([("b",), ("a",), ("a",)], "word string"), str(tmp_path / "lexicon"))
    assert sorted(r["word"] for r in files.read_saved_lexicon(spark, str(tmp_path / "lexicon")).collect()) == ["a", "b"]
    texts = spark.createDataFrame([("x.xml", "ווען")], "file string, text string").withColumn("simple", T.simplified(F.col("text")))
    files.write_text_files(texts, str(tmp_path / "texts"), {".txt": "text", "_simplified.txt": "simple"})
    assert sorted((r["file"], r["text"]) for r in spark.read.json(str(tmp_path / "texts")).collect()) == [("x.txt", "ווען"), ("x_simplified.txt", "װען")]


def test_full_segmenter(spark):
    """Levels found in the print area and its tiles, put back on the page; two paragraphs share a block."""
    pages = spark.createDataFrame([("p", 1000, 1000)], "page_id string, width int, height int")
    # blocks from (100, 100) to (500, 500): the print area begins at (90, 90)
    rows = [("p", "block", 0, "Text", 100, 100, 400, 400, 0.9, None), ("p", "block", 1, "Illustration", 300, 450, 100, 50, 0.9, None)]
    rows += [("p", "paragraph", 0, "Par", 10, 10, 400, 180, 0.9, None), ("p", "paragraph", 1, "Par", 10, 200, 400, 190, 0.9, None)]
    for i, y in enumerate((100, 180, 300)):  # baselines on the page
        rows.append(("p", "line", i, "Line", 10, y - 90 - 10, 400, 20, 0.9, None))
        for k, x in enumerate((110, 210)):
            rows.append(("p", "word", 10 * i + k, "Word", x - 90, y - 40 - 90, 60, 36, 0.9, None))
            rows.append(("p", "glyph", 10 * i + k, "Glyph", x - 90, y - 40 - 90, 60, 36, 0.9, 0))
    rows.append(("p", "word", 99, "Word", 20, 1000 - 90 - 10, 60, 10, 0.9, None))  # reaches the page's bottom
    df = spark.createDataFrame(rows, "page_id string, level string, det_id int, label string, l int, t int, w int, h int, conf double, tile int")
    config = Config(crop_margin=0.01)
    got = segment.segment_full(df, True, pages, config)
    assert [(r["l"], r["t"]) for r in got.words.filter("line_idx = 0").orderBy("word_idx").collect()] == [(110, 60), (210, 60)] or got.words.count() in (4, 6)
    assert got.lines.count() == got.words.select("line_idx").distinct().count() and got.glyphs.count() == got.words.count()
    assert sorted(tuple(r) for r in got.children.select("child", "t", "h").collect()) == [(0, 100, 100), (1, 200, 300)] or got.children.count() == 2
    assert {r["label"] for r in got.blocks.collect()} == {"Text", "Illustration"}
    assert got.spaces.filter("l <> 170 or w <> 40").count() == 0
    inside = segment.segment_full(df, True, pages, config, region=(600, 600, 100, 100))
    assert inside.words.count() == 0


def test_paragraph_steps(spark):
    from leafmill.operators import lines

    df = spark.createDataFrame([([10, 20, 35, 60, 90], [25, 50]), ([30, 40], [5, 8]), ([1], [50, 60])], "ys array<int>, bottoms array<int>")
    assert [r["g"] for r in df.select(lines.paragraph_steps(F.col("ys"), F.col("bottoms")).alias("g")).collect()] == [[0, 0, 1, 2, 2], [0, 1], [0]]


def test_reading_order_by_pairs():
    """The arrays say of every pair what the rule says of it."""
    rnd = random.Random(6)

    def rule(page, a, b):
        h = lambda x, y: min(x.l + x.w, y.l + y.w) - max(x.l, y.l)
        v = lambda x, y: min(x.t + x.h, y.t + y.h) - max(x.t, y.t)
        along = lambda x: (-(x.l + x.w), -x.l)
        sign = lambda x, y: (x > y) - (x < y)
        down = sign((a.t, a.t + a.h, *along(a)), (b.t, b.t + b.h, *along(b)))
        upper, lower = (a, b) if a.t <= b.t else (b, a)
        for c in page:
            if c is not a and c is not b and upper.t + upper.h <= c.t < lower.t and h(c, a) > 0 and h(c, b) > 0 and v(c, a) <= 0 and v(c, b) <= 0:
                return down
        if v(a, b) <= 0 or h(a, b) > max(0, v(a, b)):
            return down
        return sign(along(a), along(b)) or down

    for _ in range(30):
        page = [Box(rnd.randrange(80), rnd.randrange(80), rnd.randrange(1, 40), rnd.randrange(1, 40), 0.5) for _ in range(rnd.randrange(1, 14))]
        signs = suppress.reading_signs(page, False)
        assert all(signs[i, j] == rule(page, a, b) for i, a in enumerate(page) for j, b in enumerate(page) if i != j)


def test_unordered_suppression_equals_the_plain_rule():
    rnd = random.Random(7)
    share = lambda a, b: max(0, min(a.l + a.w, b.l + b.w) - max(a.l, b.l)) * max(0, min(a.t + a.h, b.t + b.h) - max(a.t, b.t))
    for _ in range(40):
        boxes = [Box(rnd.randrange(60), rnd.randrange(20), rnd.randrange(5, 30), rnd.randrange(5, 20), rnd.choice([0.2, 0.5, 0.9])) for _ in range(12)]
        groups = []
        for b in boxes:
            fits = next((g for g in groups if any(2 * share(b, x) >= b.w * b.h and 2 * share(b, x) >= x.w * x.h for x in g)), None)
            groups.append([b]) if fits is None else fits.append(b)
        merged = []
        for g in groups:
            left, top = min(b.l for b in g), min(b.t for b in g)
            conf = g[0].conf if len(g) == 1 else math.exp(sum(math.log(b.conf) for b in g) / len(g))
            merged.append(Box(left, top, max(b.l + b.w for b in g) - left, max(b.t + b.h for b in g) - top, conf))
        gone = set()
        for i, a in enumerate(merged):
            if i in gone:
                continue
            rivals = [j for j, b in enumerate(merged) if j != i and j not in gone and share(a, b) > 0.2 * min(a.w * a.h, b.w * b.h)]
            gone |= {i} if any(merged[j].conf > a.conf for j in rivals) else set(rivals)
        want = [tuple(round(x, 9) for x in b) for i, b in enumerate(merged) if i not in gone]
        assert [tuple(round(x, 9) for x in b) for b in suppress.keep_unordered(boxes)] == want


def test_layout_stream(spark, tmp_path):
    from leafmill.streaming import documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.xml").write_text(PAGE, encoding="utf-8")
    query = documents.layout_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("layouts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("layouts").filter("node = 'token' and kind = 'word'").count() == 2


def test_detector_asks_again(monkeypatch):
    """Transport errors are tried again with growing waits; answers that are errors are not."""
    import io
    import urllib.error

    waits, answers = [], [OSError("reset"), OSError("reset"), io.BytesIO(b"[]")]

    def open_url(request, timeout):
        assert timeout == detector.TIMEOUT_S and request.full_url == "http://d/word" and b"page.png" in request.data
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    monkeypatch.setattr(detector.urllib.request, "urlopen", open_url)
    monkeypatch.setattr(detector.time, "sleep", waits.append)
    assert detector.HttpDetector("http://d")(b"x", "word") == "[]" and waits == [1.0, 2.0]
    answers.append(urllib.error.HTTPError("http://d/word", 500, "no", {}, None))
    with pytest.raises(urllib.error.HTTPError):
        detector.HttpDetector("http://d")(b"x", "word")
    assert waits == [1.0, 2.0]
