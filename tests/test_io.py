import os

from riskscope.sources import io as IO


def _w(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_reference_csvs_skip_files_without_label(spark, tmpdir_path):
    a = _w(os.path.join(tmpdir_path, "a.csv"), 'url,label,text_content\nx.com,1,"hello, ""world"""\ny.com,0,\n')
    b = _w(os.path.join(tmpdir_path, "b.csv"), "url,label\nz.com,1\n")
    c = _w(os.path.join(tmpdir_path, "c.csv"), "url,other\nq.com,1\n")
    df = IO.read_reference_csvs(spark, [a, b, c])
    rows = sorted((r["url"], r["label"], r["text_content"], os.path.basename(r["source_dataset"])) for r in df.collect())
    assert rows == [("x.com", "1", 'hello, "world"', "a.csv"), ("y.com", "0", "", "a.csv"), ("z.com", "1", "", "b.csv")]


def _reference_files(folder, n=60):
    """Two files with quoted line breaks, commas, quotes and blank lines in fields; their rows as the csv module reads them."""
    import csv

    want = {}
    for name, cols in (("a.csv", ["url", "label", "text_content"]), ("b.csv", ["text_content", "extra", "label", "url"])):
        rows = []
        for i in range(n):
            text = ["plain", f"one\ntwo {i}", 'say ""x"", "y"\n\n\nend,', "", "é\n" * (i % 7), '"', "\n"][i % 7]
            rows.append({"url": f"{name}{i}.com", "label": str(i % 2), "text_content": text, "extra": f"x,\n{i}"})
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
            w = csv.DictWriter(f, cols, extrasaction="ignore", lineterminator="\n")
            w.writeheader()
            w.writerows(rows)
        want[name] = [(r["url"], r["label"], r["text_content"]) for r in rows]
    return want


def test_quoted_line_breaks_across_splits(spark, tmpdir_path):
    want = _reference_files(tmpdir_path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
           if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        blocks = IO._ordered_lines(spark, tmpdir_path).groupBy("source_dataset").agg({"block": "max"}).collect()
        assert len(blocks) == 2 and all(r[1] > 97 * 5 for r in blocks)
        for paths in ([tmpdir_path], [os.path.join(tmpdir_path, f) for f in want]):
            got = {}
            rows = IO.read_reference_csvs(spark, paths).orderBy("source_dataset", "line").collect()
            for r in rows:
                got.setdefault(os.path.basename(r["source_dataset"]), []).append((r["url"], r["label"], r["text_content"]))
            assert got == want
            assert [r["line"] for r in rows if r["source_dataset"].endswith("a.csv")] == list(range(1, 61))
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k) if k not in old else spark.conf.set(k, old[k])


def test_duplicates_follow_the_order_of_the_files(spark, tmpdir_path):
    """X2 over S1: of equal URLs with text the first line of the first file stays."""
    from riskscope.operators import dataset as DS

    body = "".join(f'u{i % 5}.com,1,"t\n{i}"\n' for i in range(40))
    p = _w(os.path.join(tmpdir_path, "d.csv"), "url,label,text_content\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        got = DS.dedupe_reference(DS.valid_labeled_rows(IO.read_reference_csvs(spark, [p]))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["url"], r["line"], r["text_content"]) for r in got) == [(f"https://u{i}.com", i + 1, f"t\n{i}") for i in range(5)]


def test_odd_reference_files(spark, tmpdir_path):
    a = _w(os.path.join(tmpdir_path, "a.csv"), "\ufeffurl,label\r\nx.com,1\r\n\r\ny.com\r\n")
    b = _w(os.path.join(tmpdir_path, "b.csv"), "")
    c = _w(os.path.join(tmpdir_path, "c.csv"), 'url,label,text_content\nz.com,0,"never closed\nw.com,1,t\n')
    got = [(r["url"], r["label"], r["text_content"], r["line"]) for r in IO.read_reference_csvs(spark, [a, b, c]).orderBy("source_dataset", "line").collect()]
    assert got[:2] == [("x.com", "1", "", 1), ("y.com", None, "", 2)]
    assert len(got) == 3 and got[2][:2] == ("z.com", "0")


def test_url_lists_and_feeds(spark, tmpdir_path):
    t = _w(os.path.join(tmpdir_path, "u.txt"), "  example.com \n\nhttps://a.b/c\n")
    assert sorted(r["url"] for r in IO.read_url_list(spark, t).collect()) == ["https://a.b/c", "https://example.com"]
    c = _w(os.path.join(tmpdir_path, "u.csv"), "id,url\n1,x.org\n2,\n")
    assert [r["url"] for r in IO.read_url_list(spark, c).collect()] == ["https://x.org"]
    f = _w(os.path.join(tmpdir_path, "feed.csv"), "# comment\n1,2024,http://bad.example/x,y\n2,2024,ftp://no\n3,2024\n")
    assert [r["url"] for r in IO.read_feed_csv(spark, f).collect()] == ["http://bad.example/x"]


def test_public_suffix_loader(spark, tmpdir_path):
    p = _w(os.path.join(tmpdir_path, "psl.dat"),
           "// comment\ncom\nco.uk\n*.ck\n!www.ck\n// ===END ICANN DOMAINS===\nblogspot.com\n")
    assert IO.read_public_suffix_list(spark, p) == [("com", "exact"), ("co.uk", "exact"), ("ck", "wildcard"), ("www.ck", "exception")]


def test_markdown_report(spark, tmpdir_path):
    ev = spark.createDataFrame(
        [("https://a", 0, "LEGIT", "LEGIT", 0.9, 1), ("https://b", 1, "SCAM", "LEGIT", 0.75, 0)],
        "url string, expected_label int, expected_name string, predicted_name string, confidence double, correct int",
    )
    out = os.path.join(tmpdir_path, "report")
    IO.write_report_md(ev, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert "- Total: 1/2 correct" in text and "- Scam: 0/1 correct" in text
    assert "| SCAM | LEGIT | no | 75.00% | https://b |" in text


def test_csv_and_json_writers(spark, tmpdir_path):
    import json

    df = spark.createDataFrame([("https://a", 1), ("https://b", 0)], "url string, label int")
    out = os.path.join(tmpdir_path, "csv")
    IO.write_csv(df, out)
    back = spark.read.option("header", True).csv(out)
    assert sorted((r["url"], r["label"]) for r in back.collect()) == [("https://a", "1"), ("https://b", "0")]
    rep = os.path.join(tmpdir_path, "report")
    IO.write_report_json(spark, {"rows": 2, "best_model": "random_forest"}, rep)
    text = "\n".join(r["value"] for r in spark.read.text(rep).collect())
    assert json.loads(text) == {"rows": 2, "best_model": "random_forest"}
