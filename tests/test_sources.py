from millrace.sources import text_files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    assert rows(text_files.friend_lists(spark, put("f", "1\t2,3,1\n2\t\nbad\n"))) == [(1, 2), (1, 3)]
    assert [r[1] for r in rows(text_files.baskets(spark, put("b", "a b a\n\n  c\n")))] in (["a", "b", "c"], ["c", "a", "b"])
    assert rows(text_files.articles(spark, put("a", "t1 some text\nt2\n"))) == [("t1", "some text"), ("t2", "")]
    assert [r[0] for r in text_files.numeric_rows(spark, put("n", "1 2.5\n\n")).collect()] == [[1.0, 2.5]]
    assert rows(text_files.ratings(spark, put("r", "1,2,3.5,9\n"))) == [(1, 2, 3.5, 9)]
    edges = put("e", "# c\n1 2\n1 2 3\n4\n5\t6\n")
    assert rows(text_files.edge_list(spark, edges)) == [(1, 2), (5, 6)]
    assert rows(text_files.edge_list(spark, edges, exact=False)) == [(1, 2), (1, 2), (5, 6)]
    assert text_files.id_urls(spark, 5, 6).first()["url"] == "https://site5.gov.kr/page/5"
    text_files.write_report(text_files.ratings(spark, put("r2", "1,2,3.5,9\n")), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first()[0] == "1\t2\t3.5\t9"
