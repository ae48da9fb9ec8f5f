"""Tables and text of laid-out pages on small pages written for these tests."""

from pyspark.sql import functions as F

from marlstone.operators import pdftables as T
from marlstone.operators import pdftext as X


def word(x, y, text, size=4.0):
    return (float(x), float(y), x + max(len(text), 1) * size, y + 7.0, text)


def ruled(xs, ys):
    return [T.Ruling("v", x, ys[0], ys[-1]) for x in xs] + [T.Ruling("h", y, xs[0], xs[-1]) for y in ys]


GRID = ((0, 50, 110), (0, 20, 40, 60))
GRID_WORDS = [word(5, 5, "Name"), word(60, 5, "Sum"), word(5, 25, "oak"), word(60, 25, "12"), word(5, 42, "red"), word(5, 51, "elm"), word(60, 46, "7")]


def test_grid_of_ruling_lines():
    rows = T.rows_from_rulings(GRID_WORDS, ruled(*GRID))
    assert rows == [["Name", "Sum"], ["oak", "12"], ["red / elm", "7"]]
    assert T.rows_from_rulings(GRID_WORDS, ruled(*GRID)[:3]) == [] and T.rows_from_rulings([], ruled(*GRID)) == []
    # outer edges come from the region where no line is drawn there
    inner = [r for r in ruled(*GRID) if r.at not in (0, 110) or r.way == "h"] + [T.Ruling("v", 50, 0, 60), T.Ruling("v", 90, 0, 10)]
    assert T.edges_of([r for r in inner if r.way == "v"], 0, 110) == [50, 90, 0, 110] or T.edges_of([r for r in inner if r.way == "v"], 0, 110) == [0, 50, 90, 110]
    # short lines cover too little
    assert not T.covers([T.Ruling("v", 50, 0, 30)], 51, 0, 60) and T.covers([T.Ruling("v", 50, 0, 30), T.Ruling("v", 52, 30, 40)], 51, 0, 60)


def test_close_edges_and_clusters():
    assert T.without_close([1.0, 2.0, 9.0]) == [1.5, 9.0]
    assert T.clusters([1.0, 2.5, 4.0, 9.0], 2.0) == [[1.0, 2.5], [4.0], [9.0]] or T.clusters([1.0, 2.5, 4.0, 9.0], 2.0) == [[1.0, 2.5, 4.0], [9.0]]


def test_rows_from_word_positions():
    words = [word(120, 100, "first"), word(200, 100, "second"), word(280, 100, "third"), word(120, 109, "run"), word(200, 109, "run"), word(280, 109, "run")]
    for n, (label, *cells) in enumerate([("base", "1.5", "200", "31%"), ("large", "2.5", "300", "12%"), ("", "3.5", "400", "9%")]):
        words += [word(20, 120 + 10 * n, label)] * bool(label) + [word(x, 120 + 10 * n, c) for x, c in zip((120, 200, 280), cells)]
    words.append(word(20, 146.5, "huge"))
    rows = T.rows_from_words(words)
    assert rows == [["", "first run", "second run", "third run"], ["base", "1.5", "200", "31%"], ["large", "2.5", "300", "12%"], ["huge", "3.5", "400", "9%"]]
    assert T.rows_from_words(words[:3]) == []


def test_numbers_and_names():
    assert all(map(T.is_number_cell, ("12", "$3.5", "~7%", "a 5", "1,000K"))) and not any(map(T.is_number_cell, ("GPT-4", "", "abc", "x")))


def test_forms_layouts_and_prose():
    form = [["Part 1", "Given name", "", "Family name", "", "Form 7"], ["", "Street", "", "", "Say here at length what the reader of this form is expected to fill into the field to the left of it.", ""], ["Part 2", "", "Second job", "", "", ""]]
    assert T.shows_as_form(form) and T.as_form(form + form).splitlines()[1] == "- Part 1 — Given name — Family name — Form 7" and len(T.as_form(form + form).splitlines()) == 4
    fallen = [["", "train N d model d ff h d k d v P drop ls steps", "PPL BLEU params"], ["a", "6 512 2048 8 64 64 0.1 0.1", "4.9 25 65"], ["b", "1 512 512 4 128 128 16 32 32 32 16 16", "5 24 5"]]
    assert T.shows_as_layout(fallen) and T.as_layout(fallen).splitlines()[2] == "```text" and not T.shows_as_form(fallen)
    sparse = [[str(i) if k % 5 == i % 5 else "" for k in range(16)] for i in range(5)]
    assert T.shows_as_layout(sparse)
    prose = [["The board has met with the members of this council and", ""], ["decided that those who were present from the start,", ""], ["together with their deputies, agree with the plan that", ""]]
    assert T.is_prose(prose) and not T.is_prose([["Name", "Sum"], ["a", "1"], ["b", "2"]])


def test_stacked_rows_and_headers():
    rows = [["Tree", "Place", "Height"], ["Oak\nElm", "hill\nvale", "21.5\n18"], ["Ash", "hill", "9"]]
    assert T.expanded(rows) == [["Tree", "Place", "Height"], ["Oak", "hill", "21.5"], ["Elm", "vale", "18"], ["Ash", "hill", "9"]]
    split = [["Upper", "", "", "", ""], ["", "$0 -\n9", "$10 -\n19", "$20 -\n29", "$30 -\n39"], ["$0 - 9\n$10 - 19", "1\n2", "3\n4", "5\n6", "7\n8"]]
    assert T.expanded(split) == [["Upper", "$0 - 9", "$10 - 19", "$20 - 29", "$30 - 39"], ["$0 - 9", "1", "3", "5", "7"], ["$10 - 19", "2", "4", "6", "8"]]
    assert T.lines_in_row(["a\nb", "c"]) == 1 and T.lines_in_row(["a\nb\nc\nd", "1\n2\n3\n4\n5"]) == 5
    assert T.mended_header(["x contaminated)", "", "(non-"]) == ["x (non-contaminated)", "", ""]
    assert T.moved_header(["a", "b", ""], [["1", "", "2"], ["3", "", "4"]]) == ["a", "", "b"]
    assert T.collapsed_spans([["a", "b", "", "c"], ["1", "2", "3", "4"], ["1", "", "3", ""]]) == [["a", "b", "c"], ["1", "2 / 3", "4"], ["1", "3", ""]]
    assert T.with_extracted_labels([["h", "i"], ["one", "1"], ["two", "2"]], [["", "a"], ["x", "1"], ["y", "2"], ["z", "3"]]) == [["", "a"], ["one", "1"], ["two", "2"], ["z", "3"]]


def test_choices_between_rows():
    ragged = [["a", "b"], ["1", "2"]]
    wide = [[f"c{k}" for k in range(6)], *[[str(k * r) for k in range(6)] for r in range(3)]]
    assert T.rebuilt_is_better(ragged, wide) and not T.rebuilt_is_better(wide, wide)
    assert T.grid_is_better(ragged, wide) and not T.grid_is_better(ragged, [["1/2/3"] * 3, ["4/5/6"] * 3])
    prose = [[w] * 12 for w in ("some", "words", "of", "text")]
    assert T.extracted_is_better([["Tree", "Place"], ["Oak\nElm", "hill\nvale"], ["Ash", "x"]], prose)
    assert T.reflowed([word(0, 0, "a"), word(40, 0, "b"), word(0, 10, "c")]) == [" a         b", " c"]
    assert T.adjacent((0, 0, 100, 10), (0, 12, 98, 40)) and not T.adjacent((0, 0, 100, 10), (0, 25, 98, 40)) and T.union((0, 0, 5, 5), (1, 1, 9, 9)) == (0, 0, 9, 9)


def test_tables_of_pages(spark):
    cells = [["Name", "Sum"], ["oak", "12"], ["red\nelm", "7"]]
    regions = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 110.0, 60.0, cells), ("d", 2, 0, 0.0, 0.0, 110.0, 60.0, [["only", None], []]), ("d", 3, 0, 0.0, 0.0, 9.0, 9.0, None)], "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>").withColumn("kind", F.lit("x"))
    words = spark.createDataFrame([("d", 1, *w) for w in GRID_WORDS] + [("d", 1, 0.0, 0.0, 1.0, 1.0, None), ("e", 1, *GRID_WORDS[0])], "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    lines = spark.createDataFrame([("d", 1, *map(float, (r.at, r.start, r.at, r.end) if r.way == "v" else (r.start, r.at, r.end, r.at))) for r in ruled(*GRID)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    got = T.page_tables(regions, words, lines).collect()
    assert [(r.doc, r.page, r.kind) for r in got] == [("d", 1, "grid")]
    assert got[0].markdown == "| Name | Sum |\n| --- | --- |\n| oak | 12 |\n| red / elm | 7 |"
    assert T.page_tables(regions.where("1 = 0"), words, lines).count() == 0


def test_a_header_waits_for_its_region():
    said = (("Kind", "Size", "Age"), ("oak", "12", "80"), ("elm", "9", "40"), ("ash", "7", "35"))
    words = [word(x, 10 * n, t) for n, row in enumerate(said) for x, t in zip((0, 60, 120), row)]
    got = T.tables_of_page([([["Kind", "Size", "Age"]], (0, 0, 150, 9)), ([["oak", "12", "80"], ["elm", "9", "40"], ["ash", "7", "35"]], (0, 10, 150, 40))], words, [])
    assert len(got) == 1 and got[0][2] == (0, 0, 150, 40) and got[0][1].startswith("| Kind | Size | Age |")


def test_spans_and_formulas():
    assert X.joined_spans([("a", 0, 5, 10), ("b", 5.5, 9, 10), ("c", 12, 15, 10), (" d", 30, 33, 10)]) == "ab c d"
    assert X.is_math_font("CMMI10") and not X.is_math_font("Times")
    assert X.is_formula_line("y = a + b (3)") and X.is_formula_line("(12a)") and not X.is_formula_line("where y is the sum of all")
    assert X.is_formula_block("E = m c", 0.5) and not X.is_formula_block("where E is the energy of the body", 0.9)
    assert X.is_formula_tail("f(x)") and X.is_formula_tail("+ b / c") and not X.is_formula_tail("for all x")


def test_lines():
    assert X.is_heading("1.1 Related Work") and X.is_heading("Abstract") and X.is_heading("FINDINGS HERE") and X.is_heading("第三章 方法")
    assert not any(map(X.is_heading, ("It ends here.", "a = b", "- item", "2019. A year", "ab")))
    assert X.is_numbered_title("3. Main Results") and not X.is_numbered_title("3. Wash the apples, then cut them")
    assert X.list_line("• one") == "- one" and X.list_line("2)  two") == "2) two" and X.is_list_line("a) x") and X.is_caption("Fig. 3: A tree")
    assert X.is_noise("arXiv:1706.03762v5 [cs.CL] 6 Dec 2017") and X.is_noise("12", 0, 50) and not X.is_noise("12", 20, 50)
    assert X.is_cover_line("Prepared by") and X.is_cover_line("John A. Smith") and not X.is_cover_line("A study of trees")
    block = X.Block("Results of the Trial", 2, font_size=14.0)
    assert X.is_layout_heading("Results of the Trial", block, 11.0) and not X.is_layout_heading("Results of the Trial.", block, 11.0)


def test_plain_text_lines_are_put_together():
    text = "1\nTHE FIRST PART\nA long line that was bro-\nken by the page and\ngoes on.\n1.1 Second Part\nmore text\n• an item\nend."
    assert X.plain_text(text) == "### THE FIRST PART\n\nA long line that was broken by the page and goes on.\n\n### 1.1 Second Part\n\nmore text\n\n• an item\n\nend."
    assert X.plain_text(None) == ""


def test_blocks_become_a_text(spark):
    size = {"font_size": 11.0}
    blocks = [
        ("A Study of Tall Trees", {"font_size": 20.0, "y0": 90.0}), ("Jane B. Doe", size), ("Abstract", size), ("Trees are tall and\nthey grow.", size), ("Main Results", {"font_size": 14.0}),
        ("Figure 1: A tree.", size), ("- oak\n- elm", size), ("y = a + b", {**size, "formula": True}), ("(1)", size), ("where a is the age of a tree.", size), ("| a |\n| --- |", {"block_table": True}), ("9", size), ("the last word is tor-", size),
    ]
    rows = [("d", 1, n, t, 0.0, o.get("y0", 100.0 + n), 100.0, 0.0, o.get("font_size"), None, o.get("formula"), None, o.get("block_table")) for n, (t, o) in enumerate(blocks)] + [("d", 2, 0, "tered at the end.", 0.0, 0.0, 0.0, 0.0, 11.0, None, None, None, None), ("e", 1, 0, None, *[0.0] * 5, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, formula boolean, image boolean, block_table boolean").withColumn("title", F.lit("x"))
    got = {r.doc: r for r in X.documents_text(df).collect()}
    assert got["d"].title == "A Study of Tall Trees" and (got["d"].pages, got["d"].formulas, got["d"].tables) == (2, 1, 1)
    want = ["## Page 1", "### Abstract", "Trees are tall and they grow.", "### Main Results", "> Figure 1: A tree.", "- oak", "- elm", "$$\ny = a + b (1)\n$$", "where a is the age of a tree.", "| a |\n| --- |", "the last word is tortered", "## Page 2", " at the end."]
    assert got["d"].body == "\n\n".join(want)
    assert got["e"].body == "" and X.documents_text(df.where("1 = 0")).count() == 0


def test_titles():
    title = X.Block("Deep Roots of Shallow Trees", font_size=20.0, box=(0, 90, 0, 0))
    assert X.inferred_title([X.Block("arXiv: 1", font_size=30.0), title, X.Block("Small words here", font_size=11.0)], "x", 11.0) == title.text
    assert X.replaces_title("paper1", "paper_1", "A Title") and not X.replaces_title("Good Title", "paper", "Other Title") and X.replaces_title("x.pdf", "paper", "A Title")
    assert X.without_title_lines("Deep Roots\nof Shallow Trees\nJane Doe\nAbstract\ntext", "Deep Roots of Shallow Trees") == "Abstract\ntext"
    assert X.without_title_lines("other", "Deep Roots") == "other"


def test_whole_texts_are_mended():
    assert X.mended_text("a hyphen- ated word, 3.Results here.Table 2. x") == "a hyphenated word, 3. Results here.\n\n> Table 2. x"
    assert X.merged_formulas("$$\na = b\n$$\n\n$$\n(2)\n$$\n\n$$\n(3)\n$$") == "$$\na = b\n(2)\n(3)\n$$"
    assert X.mended_pages("tor-\n\n## Page 2\n\ntered x") == "tortered\n\n## Page 2\n\n x"
