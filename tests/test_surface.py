"""SQL functions, commands, office files, sinks, evaluation by group and by client."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace import commands, sql_functions
from millrace.functions import office
from millrace.operators import evaluate, qa, reports
from millrace.sources import files, sinks

DIRTY = "• a\r\n\n• b  \t<b>c</b> a.b@c.de 10.0.0.1 010-62345678 13912345678 QQ:12345 臺灣 '\\n\" $1 %s {x}"


def test_functions_are_the_rules(spark):
    names = sql_functions.register(spark)
    spark.createDataFrame([(DIRTY,), ("",), (None,), ("Page <title>T</title>",)], "x string").createOrReplaceTempView("dirty")
    for name, rule in sql_functions.RULES.items():
        got = spark.sql(f"select {name}(x) as y from dirty").collect()
        want = spark.table("dirty").select(rule(F.col("x")).alias("y")).collect()
        assert got == want and name in names
    assert spark.sql("select chunk from chunks_of('" + "x" * 700 + "', 500, 100)").count() == 2
    assert spark.sql("select header, body from sections_of('<h1>A</h1><p>b</p>')").first() == ("A", "b")
    plan = spark.sql("select full_clean(x) from dirty")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "PythonUDF" not in plan


def test_commands(spark, tmp_path, capsys):
    assert commands.main(["list-formats"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 38
    rows = [(1, "The quick brown fox jumps over the lazy dog and mails a@b.example."), (2, "x"), (3, "ab" * 40)]
    spark.createDataFrame(rows, "id int, text string").write.parquet(str(tmp_path / "in"))
    for mode, ids in (("full", {1}), ("filter", {1}), ("abnormal", {1, 2, 3}), ("privacy", {1, 2, 3}), ("no_html", {1, 2, 3})):
        assert commands.main(["clean", str(tmp_path / "in"), str(tmp_path / mode), "--mode", mode], spark) == 0
        got = {r.id: r.text for r in spark.read.parquet(str(tmp_path / mode)).collect()}
        assert set(got) == ids and ("<EMAIL>" in got[1]) is (mode in ("full", "privacy"))
    assert commands.main(["chunk", str(tmp_path / "in"), str(tmp_path / "c"), "--size", "40", "--overlap", "0"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "c")).count() == 5
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("hello")
    assert commands.main(["parse", str(tmp_path / "f"), str(tmp_path / "p")], spark) == 0
    assert spark.read.json(str(tmp_path / "p")).first().content == "hello"
    assert commands.main(["status"], spark) == 0 and "Spark" in capsys.readouterr().out
    with pytest.raises(ValueError):
        commands.cleaned(spark.range(1).withColumn("text", F.lit("x")), "other")


def zipped(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_office_files():
    sheet = '<x><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2"><v>1</v></c></row></x>'
    book = {"xl/sharedStrings.xml": "<x><si><t>head</t></si></x>", "xl/workbook.xml": '<x><sheet name="One"/><sheet name="Two"/></x>', "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": "<x/>"}
    assert files.xlsx_text(zipped(book)) == "## Worksheet: One\n\n| head | 2 |\n|---|---|\n| 1 |  |\n\n## Worksheet: Two\n\n*This worksheet is empty*"
    slides = {f"ppt/slides/slide{k}.xml": f"<x><p><r><t>s{k}</t></r></p></x>" for k in (1, 2, 10)}
    assert files.pptx_text(zipped(slides)) == "s1\ns2\ns10"
    pages = {"b.html": "<p>first</p>", "a.html": "<p>second　x</p>"}
    assert files.epub_text(zipped(pages)) == "second xfirst"
    opf = '<p><manifest><item id="1" href="b.html"/><item id="2" href="a.html"/></manifest><spine><itemref idref="1"/><itemref idref="2"/><itemref idref="9"/></spine></p>'
    assert files.epub_text(zipped(pages | {"META-INF/container.xml": '<c><rootfile full-path="c.opf"/></c>', "c.opf": opf})) == "firstsecond x"
    assert files.docx_text(zipped({"word/document.xml": "<d><p><r><t>Hi</t></r></p></d>", "word/part.mht": "<html><body><p>in=\nside</p></body></html>"})) == "Hi\ninside"
    assert office.mht_to_text(b"") == ""


def test_sinks(spark, tmp_path):
    pairs, calls = spark.createDataFrame([("q", "a")], "question string, answer string"), spark.createDataFrame([("q2", "s")], "question string, stage string")
    got = sinks.label_rows(pairs, calls)
    assert got.columns == ["question", "answer", "stage"] and got.count() == 2 and sinks.label_rows(pairs) is pairs
    sinks.save_jsonl(got, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("answer is null").first().stage == "s"
    report, kept = reports.evaluation(spark.createDataFrame([(1, 0.9), (2, 0.1), (3, None)], "id int, score double"))
    sinks.save_evaluation(report, kept, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/report")).first().passed == 1 and spark.read.json(str(tmp_path / "e/items")).first().id == 1
    docs = spark.createDataFrame([(2, "b", "s"), (1, "a", "s"), (3, None, None)], "doc_id int, text string, source string")
    sinks.save_merged(docs, str(tmp_path / "m"))
    assert [p.read_text() for p in sorted((tmp_path / "m/__by=s").glob("part-*"))] in (["a\n\nb\n\n"], ["a\n\n", "b\n\n"])
    stats = sinks.bucket_stats(files.scan(spark, str(tmp_path / "m"))).first()
    assert stats.objects >= 2 and stats.total_mb > 0
    assert sinks.bucket_stats(spark.createDataFrame([], "length long")).first().total_mb == 0


def test_evaluation_by_group(spark):
    rows = [(1, "a b c"), (1, "x y z"), (2, "a b"), (2, "a b"), (3, "one"), (3, None)]
    got = {r.g: r for r in evaluate.diversity_of(spark.createDataFrame(rows, "g int, t string"), "g", "t").collect()}
    assert got[1].diversity > got[2].diversity and (got[3].captions, got[3].diversity) == (1, 0.0)

    def client():
        def ask(prompt):
            if prompt == "bad":
                raise qa.CallError(503, retry_after=0.0)
            return prompt

        return ask

    scored = {r.p: r for r in evaluate.client_score(spark.createDataFrame([("0.7",), ("bad",), ("words",)], "p string"), "p", client).collect()}
    assert (scored["0.7"].score, scored["bad"].score, scored["words"].score) == (0.7, 0.0, 0.0) and "503" in scored["bad"].error
    assert evaluate.image_fidelity(spark.range(1)).first().status == "not_implemented"
    pairs = spark.createDataFrame([("a b c d", "a x c d"), ("", "a"), (None, None)], "c string, r string")
    assert [round(r.y, 6) for r in pairs.select(evaluate.rouge_l("c", "r").alias("y")).collect()] == [0.75, 0.0, 0.0]


def test_scratch_tables(spark):
    from millrace import session

    kept = session.settle(spark.range(3), "t")
    gone = session.settle(spark.range(3), "t")
    assert kept.count() == 3
    session.forget(gone, None, spark.range(1))
    assert session.clear_scratch(spark) >= 1 and session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(gone._settled_at).count()


def test_data_of_files_folders_and_lists(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.txt", "one"), ("sub/a.txt", "two"), ("b.log", "no"), ("c.md", "  "), ("d.pdf", "x")):
        (tmp_path / name).write_text(text)
    at = "2024-01-01 00:00:00"
    content = lambda source: sorted(r.content or "-" for r in files.get_data(spark, source, at).collect())
    assert content(str(tmp_path)) == ["-", "one", "two"]
    assert content([f"{tmp_path}/a.txt", f"{tmp_path}/b.log"]) == ["one"] and content(f"{tmp_path}/sub/a.txt") == ["two"]
    with pytest.raises(ValueError):
        files.get_data(spark, f"{tmp_path}/b.log", at)


def test_expiry(spark):
    from millrace.streaming import ingest

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:30:00"), (3, None)], "id int, t string")
    assert [r.id for r in ingest.fresh(rows, "t", "2024-01-01 01:10:00").collect()] == [2]
