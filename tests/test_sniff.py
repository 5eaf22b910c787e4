"""CSV dialects and types found out; quoted line feeds read by many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from blotter.sources.csv import OK, STATUS
from blotter.sources.multiline import read_csv_multiline, records
from blotter.sources.sniff import read_csv_auto, sniff


def write(tmp_path, name, *files):
    folder = tmp_path / name
    folder.mkdir()
    for i, text in enumerate(files):
        (folder / f"f{i}.csv").write_text(text, newline="")
    return str(folder)


@pytest.mark.parametrize("name,text,delimiter,quote,header,ddl,formats", [
    ("us", 'Id,Day,Price,Note\n1,01/25/2024,2.5,"a, ""b"""\n2,12/01/2023,,x\n', ",", '"', True,
     "Id bigint, Day date, Price double, Note string", {"Day": "MM/dd/yyyy"}),
    ("eu", "k;wann;wahr;'t;x'\n7;25.01.2024;true;'a;b'\n8;01.02.2024;FALSE;'it''s'\n", ";", "'", True,
     "k bigint, wann date, wahr boolean, `t;x` string", {"wann": "dd.MM.yyyy"}),
    ("tabs", "1\t2024-01-02 03:04:05\tx\n2\t2024-01-02 00:00:00\ty\n", "\t", '"', False,
     "c0 bigint, c1 timestamp_ntz, c2 string", {"c1": "yyyy-MM-dd HH:mm:ss"}),
    ("all text", "name|town\nann|ulm\nbob|bonn\n", "|", '"', True, "name string, town string", {}),
    ("no header", "ann|ulm\nbob|ulm\nann|bonn\n", "|", '"', False, "c0 string, c1 string", {}),
    ("day first", "d,n\n25/01/2024,1e3\n01/02/2024,-.5\n", ",", '"', True, "d date, n double", {"d": "dd/MM/yyyy"}),
])
def test_dialects(spark, tmp_path, name, text, delimiter, quote, header, ddl, formats):
    got = sniff(spark, write(tmp_path, name, text))
    assert (got.delimiter, got.quote, got.header, got.formats) == (delimiter, quote, header, formats)
    assert got.schema == spark.createDataFrame([], ddl).schema


def test_all_rows_decide_on_types(spark, tmp_path):
    """What comes after the sampled lines, in another file too, still counts."""
    many = "".join(f"{i},0{i % 9 + 1}/0{i % 9 + 1}/2024,{i}\n" for i in range(3000))
    path = write(tmp_path, "late", "a,b,c\n" + many, "a,b,c\n1,25/01/2024,n/a\n", "")
    got = sniff(spark, path, lines=50)
    assert got.schema.simpleString() == "struct<a:bigint,b:date,c:string>" and got.formats == {"b": "dd/MM/yyyy"}
    rows = read_csv_auto(spark, path)
    assert rows.count() == 3001 and rows.where("c = 'n/a' AND b = date'2024-01-25'").count() == 1


def test_a_header_alone_in_the_first_file(spark, tmp_path):
    """As Spark writes it for an empty first partition: the other files tell the quote, all rows the types."""
    path = write(tmp_path, "parts", "k;d;t\n", "k;d;t\n1;25.01.2024;'a; ''b'\n2;26.01.2024;c\n", "k;d;t\n3;;'d;e'\n")
    got = sniff(spark, path)
    assert (got.delimiter, got.quote, got.header, got.formats) == (";", "'", True, {"d": "dd.MM.yyyy"})
    assert got.schema.simpleString() == "struct<k:bigint,d:date,t:string>"
    assert sorted((r.k, str(r.d), r.t) for r in read_csv_auto(spark, path).collect()) == [
        (1, "2024-01-25", "a; 'b"), (2, "2024-01-26", "c"), (3, "None", "d;e")]


def test_headers_alone(spark, tmp_path):
    got = sniff(spark, write(tmp_path, "heads", "k,d\n", "k,d\n"))
    assert got.header and got.schema.simpleString() == "struct<k:string,d:string>"
    assert read_csv_auto(spark, write(tmp_path, "head", "k,d\n")).toDF("a", "b").collect() == []


def test_odd_files(spark, tmp_path):
    assert read_csv_auto(spark, write(tmp_path, "empty", "")).columns == []
    rows = read_csv_auto(spark, write(tmp_path, "wide", "a,b\n1,2\n1,2,3\n4\n5,\n , \n")).collect()
    assert [tuple(r) for r in rows] == [(1, 2), (5, None), (None, None)]  # other numbers of fields are left out
    big = read_csv_auto(spark, write(tmp_path, "big", "a,b\n99999999999999999999,1d\n1,2\n"))
    assert big.schema.simpleString() == "struct<a:double,b:string>"


def multi(rng, n):
    """A file with quoted line feeds, doubled quotes, blank lines, bad rows; and its good rows."""
    out, rows = ["id,text,tail"], []
    for i in range(n):
        words = [rng.choice(["x", "a,b", 'say "no"', "line\nfeed", "\n", "\n\n", "", "é"]) for _ in range(rng.randint(0, 9))]
        text = " ".join(words)
        plain = not any(c in text for c in ',"\n') and text.strip()
        cell = text if plain and rng.random() < 0.5 else '"' + text.replace('"', '""') + '"'
        if rng.random() < 0.05:
            out.append(f"{i},{cell}")  # a field is missing
        else:
            out.append(f"{i},{cell},t{i}")
            rows.append((str(i), text, f"t{i}"))
        if rng.random() < 0.05:
            out.append("")
    return "\n".join(out) + "\n", rows


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_quoted_line_feeds_by_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    (one, first), (two, second) = multi(rng, 150), multi(rng, 90)
    path = write(tmp_path, "multi", one, two)
    got = read_csv_multiline(spark, path)
    assert sorted((r.id, r.text or "", r.tail) for r in got.collect()) == sorted(first + second)
    assert records(spark, path).select("at.range").distinct().count() > 10  # many ranges of one file
    want = (spark.read.option("multiLine", True).option("header", True).option("escape", '"').option("mode", "DROPMALFORMED")
            .schema("id string, text string, tail string").csv(path))
    want = want.where(F.length(F.concat_ws("|", "id", "text", "tail")) >= 0)
    assert sorted((r.id, r.text or "", r.tail) for r in want.collect()) == sorted(first + second)


def test_a_record_longer_than_a_range(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}" for i in range(400))
    path = write(tmp_path, "long", f'id,text\n1,"{long}"\n2,"b"\n3,"{long}"\n')
    got = {r.id: r.text for r in read_csv_multiline(spark, path).collect()}
    assert got == {"1": long, "2": "b", "3": long}


def test_no_task_sorts_a_whole_range(spark, tmp_path):
    rng = random.Random(3)
    text, rows = multi(rng, 3000)
    path = write(tmp_path, "parts", text)
    assert records(spark, path).select("at.range").distinct().count() > 1  # one range by bytes
    assert sorted((r.id, r.text or "", r.tail) for r in read_csv_multiline(spark, path).collect()) == sorted(rows)


def test_no_task_writes_all_texts(spark, tmp_path):
    import glob

    from __spark_entry__ import queries
    from blotter.session import ensure_checkpoint_dir, local_path

    rows = [(i, "en", f'a "{i}",\n\r\nb' if i % 3 else "") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    files = lambda: set(glob.glob(f"{local_path(ensure_checkpoint_dir(spark))}/blotter/multiline/*/*.csv"))
    before = files()
    got = queries()["csv_multiline"](spark, str(tmp_path)).collect()
    assert len(files() - before) > 1
    assert sorted((r.doc_id, r.lang, r.chars) for r in got) == sorted((i, g, len(t.replace("\r", "")) or None) for i, g, t in rows)


def test_typed_and_tagged(spark, tmp_path):
    path = write(tmp_path, "tagged", 'a;b\r\n1;"x\ny"\r\nbad;z\r\n2\r\n')
    got = read_csv_multiline(spark, path, spark.createDataFrame([], "a int, b string").schema, delimiter=";", tagged=True)
    assert sorted((r.a, r.b) for r in got.where(F.col(STATUS) == OK).collect()) == [(1, "x\ny")]
    assert got.count() == 3
    assert read_csv_multiline(spark, write(tmp_path, "none", "a,b\n")).count() == 0
