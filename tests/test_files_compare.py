"""files_compare writes few folders and scans each file once."""

import os

from docsift.operators import corpus as K


def test_a_file_per_path_in_few_folders(spark, tmp_path):
    rows = [(f"nc-2024-01-01__09-00-00/window01/tab{i}.txt", f"text {i}") for i in range(300)]
    rows += [(rows[0][0], "again"), ("odd %=.txt", None), (None, "no path")]
    K.write_text_files(spark.createDataFrame(rows, "path string, text string"), f"file:{tmp_path}/files")
    folders = os.listdir(tmp_path / "files")
    assert len(folders) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = {r.path.rsplit("/path=", 1)[1].replace("%2F", "/"): r.text for r in K.scan_text_corpus(spark, str(tmp_path / "files")).collect()}
    assert len(found) == 302
    assert sorted(found[rows[0][0]].split("\n")) == ["", "again", "text 0"]
    assert found[rows[7][0]] == "text 7\n" and found["odd %25%3D.txt"] == "\n" and found["__HIVE_DEFAULT_PARTITION__"] == "no path\n"


def test_files_are_scanned_once(spark, monkeypatch):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    df = E.queries()["files_compare"](spark, SF_SMALL)
    assert "binaryFile" not in df._jdf.queryExecution().optimizedPlan().toString()
    exact = E.queries()["compare_exact"](spark, SF_SMALL)
    assert sorted(map(str, df.collect())) == sorted(map(str, exact.collect()))
