"""Command line: python -m linewright.plans.cli train|process|evaluate|pages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linewright.operators import evaluate
from linewright.plans import commands
from linewright.plans.model import Config, load_transducer
from linewright.sources import lines, page_xml, sinks


def parser() -> argparse.ArgumentParser:
    d, p = Config(), argparse.ArgumentParser(prog="linewright")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, what):
        c = sub.add_parser(name, help=what)
        c.add_argument("-d", "--directory", help="folder of line files named <id>.<suffix>")
        return c

    t = command("train", "learn a lexicon, an error model and a language model")
    t.add_argument("-m", "--model", required=True, help="folder for the model's tables")
    t.add_argument("--what", nargs="+", choices=["lexicon", "errors", "lm"], default=["lexicon", "errors"])
    t.add_argument("-t", "--training-file", help="two columns: OCR, ground truth")
    t.add_argument("-i", "--input-file", help="two columns: id, OCR")
    t.add_argument("-g", "--gt-file", help="two columns: id, ground truth")
    t.add_argument("-I", "--input-suffix")
    t.add_argument("-G", "--gt-suffix")
    t.add_argument("-c", "--corpus-file", help="plain text lines for the lexicon")
    t.add_argument("-w", "--word-list", help="two columns: word, frequency")
    t.add_argument("-P", "--punctuation", choices=["bracket", "lm", "preserve"], default=d.punctuation)
    t.add_argument("--added-word-cost", type=float, default=d.added_word_cost)
    t.add_argument("--unweighted-lexicon", action="store_true")
    t.add_argument("-T", "--error-model", choices=["simple", "st"], default=d.error_model)
    t.add_argument("-p", "--preserve-punctuation", action="store_true")
    t.add_argument("--min-context", type=int, default=d.min_context)
    t.add_argument("-C", "--max-context", type=int, default=d.max_context)
    t.add_argument("-E", "--max-errors", type=int, default=d.max_errors)
    t.add_argument("-N", "--max-ngrams", type=int, default=d.max_ngrams)
    t.add_argument("-W", "--mapping-weight", type=float, default=d.mapping_weight)
    t.add_argument("--convergence", type=float, default=d.convergence)
    t.add_argument("--start-from", help="model folder whose stochastic transducer training goes on from")

    c = command("process", "correct lines")
    c.add_argument("-m", "--model", required=True)
    c.add_argument("-I", "--input-suffix")
    c.add_argument("-i", "--input-file")
    c.add_argument("-O", "--output-suffix", default="cor.txt")
    c.add_argument("-o", "--output-file")
    c.add_argument("-T", "--error-model", choices=["simple", "st", "none"], default=d.error_model)
    c.add_argument("--lm", action="store_true", help="choose by the language model")
    c.add_argument("-E", "--max-errors", type=int, default=d.max_errors)
    c.add_argument("-W", "--words-per-window", type=int, default=d.words_per_window)
    c.add_argument("-P", "--pruning-weight", type=float, default=d.pruning_weight)
    c.add_argument("-J", "--rejection-weight", type=float, default=d.rejection_weight)
    c.add_argument("-Q", "--processes", type=int, default=None, help="partitions of the input")

    e = command("evaluate", "measure corrected lines")
    e.add_argument("-I", "--input-suffix")
    e.add_argument("-i", "--input-file")
    e.add_argument("-O", "--output-suffix", default="cor.txt")
    e.add_argument("-o", "--output-file")
    e.add_argument("-G", "--gt-suffix", default="gt.txt")
    e.add_argument("-g", "--gt-file")
    e.add_argument("-M", "--metric", choices=list(evaluate.METRICS), default="combining-e-umlauts")
    e.add_argument("-S", "--silent", action="store_true", help="only sums")

    g = command("pages", "correct PAGE documents line by line")
    g.add_argument("-m", "--model", required=True)
    g.add_argument("-i", "--input-path", required=True)
    g.add_argument("-o", "--output-path", required=True)
    return p


def config_of(a: argparse.Namespace) -> Config:
    known = {k: v for k, v in vars(a).items() if k in Config.__dataclass_fields__ and v is not None}
    return Config(**(known | ({"error_model": "simple"} if known.get("error_model") == "none" else {})))


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    config = config_of(a)
    pairs = lines.read_training_pairs(spark, a.training_file, a.directory, a.input_suffix, a.gt_suffix, a.input_file, a.gt_file)
    corpus = lines.read_lines(spark, a.corpus_file) if a.corpus_file else None
    text = lines.lexicon_lines(pairs, corpus)
    if "lexicon" in a.what:
        commands.train_lexicon(text, a.model, config, lines.read_word_list(spark, a.word_list) if a.word_list else None)
    if "errors" in a.what:
        commands.train_errors(pairs, a.model, config, load_transducer(spark, a.start_from) if a.start_from else None)
    if "lm" in a.what:
        commands.train_language_model(text, a.model, config)


def process(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = lines.read_pairs(spark, a.input_file)[0] if a.input_file else lines.read_directory(spark, a.directory, a.input_suffix)
    if a.processes:
        rows = rows.repartition(a.processes)
    # ids may repeat: a row is told by its place
    placed = rows.select(F.to_json("at").alias("line_id"), F.col("line_id").alias("name"), "text", "at")
    done = commands.correct(placed.select("line_id", "text"), a.model, config_of(a), a.error_model != "none", a.lm)
    out = placed.select("line_id", "name", "at").join(done, "line_id").select(F.col("name").alias("line_id"), F.col("output").alias("text"), "at")
    if a.output_file:
        sinks.write_pairs(out, a.output_file, "at")
    else:
        sinks.write_directory(out, a.directory, a.output_suffix)


def evaluate_(spark: SparkSession, a: argparse.Namespace) -> None:
    ocr = lines.read_keyed(spark, a.input_file, a.directory, a.input_suffix)
    cor = lines.read_keyed(spark, a.output_file, a.directory, a.output_suffix)
    gt = lines.read_keyed(spark, a.gt_file, a.directory, a.gt_suffix)
    if not a.silent:
        triples = evaluate.join_triples(ocr, cor, gt)
        each = evaluate.line_outcomes(triples) if a.metric == "precision-recall" else evaluate.line_edits(triples, a.metric)
        for r in each.toLocalIterator():
            print(*(f"{k}: {v}" for k, v in r.asDict().items()), sep="\n", end="\n\n")
    for k, v in commands.measure(ocr, cor, gt, a.metric).first().asDict().items():
        print(f"{k}: {v}")


def pages(spark: SparkSession, a: argparse.Namespace) -> None:
    commands.correct_pages(page_xml.read_pages(spark, a.input_path), a.model, Config()).write.parquet(a.output_path)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"linewright-{a.command}").getOrCreate()
    {"train": train, "process": process, "evaluate": evaluate_, "pages": pages}[a.command](spark, a)


if __name__ == "__main__":
    main()
