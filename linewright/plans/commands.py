"""Training, correcting and evaluating as whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions.text import identifier_decade
from linewright.operators import em, errors, evaluate, lattice, lexicon, lm, ngrams, page, stochastic
from linewright.plans import model as models
from linewright.plans.model import Config
from linewright.sources import page_xml

SCORES = {"simple", "st"}


def train_lexicon(lines: DataFrame, model: str, config: Config = Config(), word_list: DataFrame | None = None) -> None:
    """The lexicon table from lines (line) and perhaps a word list (word, freq)."""
    if config.punctuation != "bracket":
        raise NotImplementedError(f"punctuation {config.punctuation!r}: only 'bracket' is there")
    counts = lexicon.build(lines, word_list)
    models.save(lexicon.weigh(counts, config.added_word_cost, config.unweighted_lexicon), model, "lexicon")


def train_errors(pairs: DataFrame, model: str, config: Config = Config(), start: em.Transducer | None = None) -> None:
    """The error model from pairs (ocr, gt): rules, or the stochastic transducer's tables and mappings."""
    if config.error_model not in SCORES:
        raise ValueError(f"no error model {config.error_model!r}")
    spark = pairs.sparkSession
    if config.error_model == "simple":
        rules = errors.train(pairs, config.min_context, config.max_context, config.preserve_punctuation, config.rule_weight)
        models.save(rules, model, "rules")
        return
    models.save(ngrams.vocabulary(pairs, config.max_context, config.max_ngrams), model, "vocabulary")
    vocab = models.load(spark, model, "vocabulary")
    grams = [r.ngram for r in vocab.orderBy("id").collect()]  # max_ngrams of them at most
    fitted = em.fit(pairs, grams, config.convergence, config.max_context, start)
    matrix, lengths = em.to_rows(spark, fitted)
    models.save(matrix, model, "matrix")
    models.save(lengths, model, "lengths")
    models.save(em.mappings(models.load(spark, model, "matrix"), vocab, config.mapping_weight), model, "mappings")


def train_language_model(lines: DataFrame, model: str, config: Config = Config()) -> None:
    models.save(lm.train(lines, config.lm_order, config.lm_ngrams), model, "language_model")


def hypotheses(inputs: DataFrame, spark: SparkSession, model: str, config: Config, with_errors: bool = True) -> DataFrame:
    """input, output, weight of all windows in inputs (input) under a model folder; without errors only the lexicon decides."""
    lex = models.load(spark, model, "lexicon")
    if not with_errors or config.error_model == "simple":
        rules = models.load(spark, model, "rules") if with_errors else spark.createDataFrame([], "raw string, gt string, weight double")
        return lattice.score(inputs, rules, lex, config.max_errors, config.words_per_window, config.pruning_weight, config.rejection_weight)
    lengths = [r.p for r in models.load(spark, model, "lengths").orderBy("n").collect()]
    own = inputs.select("input").distinct()
    rewritten = stochastic.rewrites(own, models.load(spark, model, "mappings"), lengths, config.max_errors, config.pruning_weight, config.max_context)
    found = lattice.prune(lattice.in_lexicon(rewritten, lex, config.words_per_window), config.pruning_weight)
    return found.unionByName(lattice.rejections(own, config.rejection_weight)).select("input", "output", lattice.as_weight(F.col("cost")).alias("weight"))


def correct(lines: DataFrame, model: str, config: Config = Config(), with_errors: bool = True, with_lm: bool = False) -> DataFrame:
    """line_id, output of lines (line_id, text); the best path by weight, or by the language model."""
    spark = lines.sparkSession
    own = lattice.windows(lines, config.max_window)
    found = hypotheses(own, spark, model, config, with_errors)
    if with_lm:
        heard = lm.CharacterModel.of(models.load(spark, model, "language_model"))
        best = lm.rescore(lattice.edges(own, found), heard, config.lm_weight, config.lm_beam)
    else:
        best = lattice.best_paths(own, found, config.max_window)
    return lines.select("line_id").join(best.select("line_id", "output"), "line_id", "left").select("line_id", F.coalesce("output", F.lit("")).alias("output"))


def correct_pages(pages: DataFrame, model: str, config: Config = Config()) -> DataFrame:
    """page_id, line_no, line_id, output of read_pages' rows, lines heard in reading order."""
    spark = pages.sparkSession
    lines = page_xml.text_lines(pages)
    own = page.word_windows(lines, config.max_window)
    found = hypotheses(own.select("input"), spark, model, config)
    key = F.struct("page_id", "line_no")
    edges = lm.lattices(lattice.edges(own.select(key.alias("line_id"), "n_tokens", "start", "len", "input"), found))
    heard = lm.CharacterModel.of(models.load(spark, model, "language_model"))
    keyed = lines.select("page_id", "line_no", "line_id").join(edges.select("line_id.page_id", "line_id.line_no", "edges"), ["page_id", "line_no"], "left")
    best = lm.rescore_pages(keyed, heard, config.page_lm_weight, config.page_lm_beam)
    return keyed.drop("edges").join(best, ["page_id", "line_no"], "left").select("page_id", "line_no", "line_id", "output")


def page_context(identifiers: DataFrame) -> DataFrame:
    """identifiers with context, the decade that a language model may be told."""
    return identifiers.withColumn("context", identifier_decade(F.col("identifier")))


def measure(ocr: DataFrame, cor: DataFrame, gt: DataFrame, metric: str = "combining-e-umlauts", strict: bool = True) -> DataFrame:
    """One row of error rates, or of precision and recall, over all lines (line_id, text) of the ground truth."""
    if metric not in evaluate.METRICS:
        raise ValueError(f"no metric {metric!r}")
    triples = evaluate.join_triples(ocr, cor, gt, strict)
    return evaluate.precision_recall(triples) if metric == "precision-recall" else evaluate.error_rates(triples, metric)
