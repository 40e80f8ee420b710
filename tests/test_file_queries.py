from opinio.plans.file_queries import _one_a_file


def test_each_value_is_a_file_of_one_flat_folder(spark, tmp_path):
    path = str(tmp_path / "files")
    _one_a_file(spark.createDataFrame([("k", '{\n "a": 1}'), ("k", '{\n "a": 2}'), ("l", '{\n "a": 3}')], "key string, value string"), path)
    # Spark may leave an empty file of a first partition without rows: readers find no document in it
    files = [f for f in (tmp_path / "files").rglob("*.txt") if f.stat().st_size]
    assert sorted(f.read_text() for f in files) == [f'{{\n "a": {n}}}\n' for n in (1, 2, 3)]
    assert {f.parent for f in files} == {tmp_path / "files"}
    assert sorted(r.a for r in spark.read.schema("a int").option("multiLine", True).json(path).collect()) == [1, 2, 3]
