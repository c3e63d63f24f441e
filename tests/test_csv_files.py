"""Many CSV files: one scan for each header, columns by name, odd headers one by one."""

from tidepost.sources import readers


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_files_of_one_header_are_one_scan(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"a{i}.csv").write_text(f'text,url\n"line\nbreak, {i}",u{i}\n')
    (tmp_path / "b.csv").write_text("url,text\nv,other order\n")
    (tmp_path / "c.csv").write_text("url,likes\nw,7\n")
    (tmp_path / "odd.csv").write_text("url,url\nx,y\n")
    (tmp_path / "bom.csv").write_bytes("\ufeffurl,text\nz,with a mark\n".encode())
    (tmp_path / "header.csv").write_text("text,url\n")
    spark.createDataFrame([("p", "q")], "text string, url string").write.option("header", True).csv(f"{tmp_path}/folder.csv")
    plain = [str(tmp_path / f"{n}.csv") for n in ("a0", "a1", "a2", "a3", "a4", "a5", "b", "c", "header", "folder")]
    found = readers.read_csv_files(spark, plain)
    rows = {(r.url, r.text, r.likes) for r in found.collect()}
    assert rows == {(f"u{i}", f"line\nbreak, {i}", None) for i in range(6)} | {("v", "other order", None), ("w", None, "7"), ("q", "p", None)}
    assert scans(found) == 3
    assert readers.csv_header(spark, str(tmp_path / "odd.csv")) is None
    marked = readers.read_posts(spark, [str(tmp_path / "bom.csv")])
    assert [(r.url, r.text) for r in marked.collect()] == [("z", "with a mark")]
    assert readers.read_posts(spark, plain).where("url = 'w'").first().likes == 7
