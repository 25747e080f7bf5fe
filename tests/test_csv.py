import pytest
from conftest import rows

from plumbline import check_missing, read_csv
from plumbline.sources.csv import infer_types, read_csv_text

TEXT = """id,name,amount,flag,note,code,big,empty
1,Ann,10.5,true,"line one
line two",007,1e3,
2,"O""Neil",N/A,False,NULL,8,inf,NA
3, Bob ,-3,TRUE,nan,,5,null
,None,,n/a,x,9,#N/A,
"""


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "table.csv"
    file.write_text(TEXT)
    return str(file)


def test_types_and_missing_words(spark, path):
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "amount": "double", "flag": "boolean", "note": "string",
        "code": "bigint", "big": "double", "empty": "double",
    }
    assert rows(df, "id", "name", "amount", "flag") == sorted(
        [(1, "Ann", 10.5, True), (2, 'O"Neil', None, False), (3, " Bob ", -3.0, True), (None, None, None, None)],
        key=repr,
    )
    assert rows(df, "note") == sorted([("line one\nline two",), (None,), (None,), ("x",)], key=repr)
    assert rows(df, "code") == sorted([(7,), (8,), (None,), (9,)], key=repr)
    assert dict(rows(check_missing(df), "column_name", "null_count"))["empty"] == 4


def test_given_types_save_the_pass(spark, path):
    df = read_csv(spark, path, types={"id": "int", "amount": "decimal(10,2)"})
    assert dict(df.dtypes)["id"] == "int"
    assert dict(df.dtypes)["amount"] == "decimal(10,2)"
    assert dict(df.dtypes)["code"] == "string"
    with pytest.raises(ValueError):
        read_csv(spark, path, types={"nope": "int"})


def test_one_bad_value_makes_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,true\nx,maybe\n2,false\n")
    assert infer_types(read_csv_text(spark, str(tmp_path / "t.csv"))) == {"a": "string", "b": "string"}


def test_dates_stay_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("d\n2024-01-01\n")
    assert read_csv(spark, str(tmp_path / "t.csv")).dtypes == [("d", "string")]


def test_header_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert (df.dtypes, df.count()) == ([("a", "string"), ("b", "string")], 0)


def test_folder_of_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        (folder / f"p{i}.csv").write_text(f"a,b\n{i},x\n")
    assert read_csv(spark, str(folder)).count() == 3
    assert read_csv(spark, str(folder / "*.csv"), multi_line=False).count() == 3


def test_wrong_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "nope.csv"))
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "nope.txt"))
    (tmp_path / "t.txt").write_text("a\n1\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "t.txt"))
    (tmp_path / "t.CSV").write_text("a\n1\n")
    assert read_csv(spark, str(tmp_path / "t.CSV")).count() == 1


def test_only_files_with_line_breaks_in_values_are_read_whole(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    lines = "".join(f'{i},"plain ""{i}"""\n' for i in range(60_000))
    (folder / "large one.csv").write_text("n,t\n" + lines)
    (folder / "broken.csv").write_text('n,t\n-1,"two\nlines"\n-2,"a ""b\nc"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        text = read_csv_text(spark, str(folder))
        assert text.rdd.getNumPartitions() > 4
        df = read_csv(spark, str(folder))
        assert (df.count(), dict(df.dtypes)["n"]) == (60_002, "bigint")
        assert rows(df.filter("n < 0"), "n", "t") == [(-1, "two\nlines"), (-2, 'a "b\nc')]
        assert rows(df.filter("n = 7"), "t") == [('plain "7"',)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    """Blocks begin within values, some values span several, and odd quotes read as Spark reads them."""
    long = "\n".join(f'said ""{i}"", then' for i in range(2000))
    records = [f'{i},"two, ""{i}""\n\nlines {i}",x"y' for i in range(4000)] + [f'-1,"{long}"', '-2,"a"b,"', ',""']
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        for name, end in (("unix", "\n"), ("windows", "\r\n")):
            file = tmp_path / f"{name}.csv"
            file.write_bytes(("n,t,u" + end + end.join(records) + end + '"",z\n').encode())
            if name == "unix":  # no value is open at the end
                file.write_bytes(file.read_bytes().replace(b'-2,"a"b,"', b'-2,"a"b, "'))
            text = read_csv_text(spark, str(file))
            whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(file))
            assert rows(text) == rows(whole)
            if name == "unix":
                sizes = text.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
                assert (len(sizes) > 8, sum(sizes)) == (True, 4004) and max(sizes) < 1000
            given = read_csv(spark, str(file), multi_line=True)
            assert given.filter("n >= 0").count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_can_not_be_cut_are_read_whole(spark, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    (folder / "cut.csv").write_text('a,b\n1,"x\ny"\n')
    (folder / "returns.csv").write_bytes(b'a,b\r2,"x\ny"\r3,z')
    (folder / "open.csv").write_text('a,b\n4,"x\ny\n')
    (folder / "case.csv").write_text('A,"b"\n5,"x\ny"\n')
    whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(folder))
    assert rows(read_csv_text(spark, str(folder))) == rows(whole)
