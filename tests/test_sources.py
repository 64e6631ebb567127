"""Files in and out, PAGE documents, and the commands from end to end."""

import pytest

from linewright.plans import cli, commands, model
from linewright.plans.model import Config
from linewright.sources import lines, page_xml, sinks
from linewright.streaming import lines as streams


def test_pairs(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1\tab\tmore \n2\n1\tcd\n3\t x \n")
    good, bad = lines.read_pairs(spark, str(tmp_path / "p.tsv"))
    assert sorted((r.line_id, r.text) for r in good.collect()) == [("1", "ab"), ("1", "cd"), ("3", " x")]
    assert [r.value for r in bad.collect()] == ["2"]
    assert {r.line_id: r.text for r in lines.last_of_each(good).collect()} == {"1": "cd", "3": " x"}


def test_lists(spark, tmp_path):
    (tmp_path / "w").write_text("a\t1\nb\tx\nc\na\t+7\nd\t-3\te\n")
    assert {r.word: r.freq for r in lines.read_word_list(spark, str(tmp_path / "w")).collect()} == {"a": 7, "d": -3}
    (tmp_path / "n").write_text(" a\nb \n")
    assert [(r.ngram, r.id) for r in lines.read_ngrams(spark, str(tmp_path / "n")).orderBy("id").collect()] == [(" a", 0), ("b ", 1)]
    (tmp_path / "l").write_text("x \n\ny\n")
    assert [r.line for r in lines.read_lines(spark, str(tmp_path / "l")).collect()] == ["x", "", "y"]
    vocab = lines.read_ngrams(spark, str(tmp_path / "n"))
    sinks.write_ngrams(vocab, str(tmp_path / "out"))
    assert [(r.ngram, r.id) for r in lines.read_ngrams(spark, str(tmp_path / "out")).orderBy("id").collect()] == [(" a", 0), ("b ", 1)]
    probs = spark.createDataFrame([("", "s", 0.25)], "raw string, gt string, prob double")
    sinks.write_frequencies(probs, str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == ["□\ts\t0.25"]
    assert lines.read_frequencies(spark, str(tmp_path / "f")).collect() == probs.collect()


def test_directories(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "")], "line_id string, text string")
    assert sinks.write_directory(rows, str(tmp_path / "d"), "gt.txt") == 3
    assert (tmp_path / "d" / "a.gt.txt").read_text() == "x y"
    assert {r.line_id: r.text for r in lines.read_keyed(spark, directory=str(tmp_path / "d"), suffix="gt.txt").collect()} == {"a": "x y", "b": "z"}
    with pytest.raises(ValueError):
        lines.read_keyed(spark)
    assert lines.read_training_pairs(spark).count() == 0


PAGE = """<?xml version="1.0"?><PcGts pcGtsId="p1"><Page imageFilename="i"><ReadingOrder><OrderedGroup id="g"><RegionRefIndexed index="0" regionRef="r2"/><RegionRefIndexed index="1" regionRef="r1"/></OrderedGroup></ReadingOrder>
<TextRegion id="r1"><TextLine id="l1"><Word id="w1" language="de"><Coords points="1,1"/><TextEquiv conf="0.5"><Unicode>tbe</Unicode></TextEquiv></Word><Word id="w2" language="en"><TextEquiv><Unicode>cnd</Unicode></TextEquiv></Word><Word id="w3"/></TextLine></TextRegion>
<TextRegion id="r2"><TextLine id="l2"><Word id="w4"><TextEquiv><Unicode>the</Unicode></TextEquiv></Word></TextLine></TextRegion><TextRegion id="r3"/></Page></PcGts>"""


def test_page_documents(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAGE)
    pages = page_xml.read_pages(spark, str(tmp_path / "p.xml"))
    found = page_xml.text_lines(pages)
    assert [(r.line_no, r.line_id) for r in found.orderBy("line_no").collect()] == [(0, "l2"), (1, "l1")]
    assert {r.problem for r in page_xml.empty_parts(pages).collect()} == {"region without lines: r3", "word without text: w3"}
    from linewright.operators import page

    windows = page.word_windows(found).where("line_no = 1").orderBy("start", "len").collect()
    assert [(r.input, r.word["_id"], r.word["_language"]) for r in windows] == [("tbe", "w1", "de"), ("tbe cnd", "w1,w2", "de"), ("cnd", "w2", "en")]
    from pyspark.sql import functions as F

    words = found.where("line_no = 1").select("page_id", "line_id", F.lit(0).alias("place"), F.get("words", F.lit(0)).alias("word"))
    updated = page_xml.with_words(pages, words)
    texts = updated.select(F.expr("transform(Page.TextRegion, r -> r.TextEquiv[0].Unicode)").alias("t")).first().t
    assert texts == ["tbe", "", ""]
    page_xml.write_pages(updated, str(tmp_path / "out"))
    assert page_xml.read_pages(spark, str(tmp_path / "out")).count() == 1


GT = ["the end of the path", "then the bath ended", "this is the other end", "with the path there", "both of them then"]


def files(tmp_path):
    ocr = [x.replace("th", "tb") for x in GT]
    (tmp_path / "t.tsv").write_text("".join(f"{o}\t{g}\n" for o, g in zip(ocr, GT, strict=True)))
    for name, rows in (("ocr", ocr), ("gt", GT)):
        (tmp_path / f"{name}.tsv").write_text("".join(f"l{i}\t{x}\n" for i, x in enumerate(rows)))


@pytest.mark.parametrize("kind", ["simple", "st"])
def test_commands(spark, tmp_path, capsys, kind):
    files(tmp_path)
    at = lambda name: str(tmp_path / name)
    cli.main(["train", "-m", at("m"), "-t", at("t.tsv"), "-T", kind, "--what", "lexicon", "errors", "lm", "--max-context", "2"])
    cli.main(["process", "-m", at("m"), "-i", at("ocr.tsv"), "-o", at("cor.tsv"), "-T", kind])
    cli.main(["evaluate", "-i", at("ocr.tsv"), "-o", at("cor.tsv"), "-g", at("gt.tsv"), "-M", "Levenshtein"])
    said = dict(x.split(": ", 1) for x in capsys.readouterr().out.splitlines() if ": " in x)
    assert float(said["cer_cor"]) < float(said["cer_ocr"])
    if kind == "simple":
        assert float(said["cer_cor"]) == 0
        cli.main(["process", "-m", at("m"), "-i", at("ocr.tsv"), "-o", at("lm.tsv"), "--lm"])
        assert spark.read.text(at("lm.tsv")).count() == len(GT)
    else:
        start = model.load_transducer(spark, at("m"))
        assert start.probs.sum(1) == pytest.approx(1)


def test_unknown_choices(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "line string")
    with pytest.raises(NotImplementedError):
        commands.train_lexicon(one, str(tmp_path), Config(punctuation="lm"))
    with pytest.raises(ValueError):
        commands.measure(one, one, one, "none")


def test_stream(spark, tmp_path):
    files(tmp_path)
    cli.main(["train", "-m", str(tmp_path / "m"), "-t", str(tmp_path / "t.tsv")])
    spark.createDataFrame([("1", "tbe end")], "line_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id string, text string").parquet(str(tmp_path / "in"))
    rules, lexicon = model.load(spark, str(tmp_path / "m"), "rules"), model.load(spark, str(tmp_path / "m"), "lexicon")
    streams.correct(stream, rules, lexicon, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["the end"]
