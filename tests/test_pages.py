from lodestar.operators.pages import normalised, remove_headers_and_footers


def cleaned(spark, *rows):
    out = remove_headers_and_footers(spark.createDataFrame(rows, "doc_id long, page int, text string")).collect()
    return {(r.doc_id, r.page): r.text for r in out}


def test_headers_and_footers(spark):
    long = [(1, i, f"Rules\n\nArticle {i}\nbody {i}\nmore {i}\nRules\n第 {i} 頁") for i in range(1, 5)]
    short = [(2, i, f"Head\nbody {i}") for i in (1, 2)]
    got = cleaned(spark, *long, *short, (3, 1, None), (None, 1, "x"))
    assert got == {
        **{(1, i): f"\nArticle {i}\nbody {i}\nmore {i}" for i in range(1, 5)},
        **{(2, i): f"Head\nbody {i}" for i in (1, 2)}, (3, 1): "",
    }


def test_half_of_the_pages(spark):
    got = cleaned(spark, *[(1, i, f"{'Top' if i < 3 else 'x' * i}\na{i}\nb{i}\nc{i}\nd{i}") for i in range(1, 6)])
    assert got[1, 1].startswith("Top")  # two of five are fewer than three
    assert cleaned(spark) == {}


def test_full_width_page_numbers_and_the_whole_normaliser(spark):
    rows = [(1, i, f"第{c}頁\r\nＡＢＣ－{c}\t \nbody {i} goes\non here {i}\n\n\n\nend {i}.") for i, c in enumerate("１２３", 1)]
    assert cleaned(spark, *rows)[1, 2] == "ABC-2\nbody 2 goes\non here 2\n\n\n\nend 2."
    layout = [(2, i, f"第{i}頁\n```\n a\t b\n\n\n\nＸ") for i in (1, 2, 3)]
    d = spark.createDataFrame([(*r, r[0] == 2) for r in [*rows, *layout, (None, 1, "x"), (3, 1, None)]], "doc_id long, page int, text string, preserves_layout boolean")
    got = {(r.doc_id, r.page): r.text for r in normalised(d, join_lines=True).collect()}
    assert got[1, 1] == "ABC-1 body 1 goes on here 1\n\nend 1."
    assert got[2, 3] == "第3頁\n```\n a\t b\n\nX" and got[3, 1] == "" and len(got) == 7
