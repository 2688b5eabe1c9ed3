"""Evidence table with Laplace smoothing and log-space posterior."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.features import with_evidence
from riskloom.functions.text import clean_steps


def with_scored_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Cleaned text, or the raw text where cleaning leaves nothing."""
    return clean_steps(df, text, out).withColumn(
        out, F.when(F.col(out) == "", F.col(text)).otherwise(F.col(out)))


def fit_evidence(df: DataFrame, label: str = "label", text: str = "message") -> DataFrame:
    """One row: class priors and P(evidence | class), from one aggregation."""
    return fit_cleaned(clean_steps(df.filter(F.col(text).isNotNull()), text, "_clean"), label, "_clean")


def fit_cleaned(df: DataFrame, label: str = "label", clean: str = "clean") -> DataFrame:
    """``fit_evidence`` on texts that are cleaned already."""
    flags = with_evidence(df.filter(F.col(label).isin(K.BINARY_LABELS)), clean)
    fraud = F.col(label) == K.FRAUDULENT
    n = F.count("*")
    sums = {"n": n, "n_fraud": F.sum(fraud.cast("bigint"))}
    for name in K.EVIDENCE:
        sums[f"f_{name}"] = F.sum(F.when(fraud, F.col(name)).otherwise(0))
        sums[f"l_{name}"] = F.sum(F.when(~fraud, F.col(name)).otherwise(0))
    totals = flags.agg(*[c.alias(k) for k, c in sums.items()])
    n_fraud, n_legit = F.col("n_fraud"), F.col("n") - F.col("n_fraud")
    return totals.select(
        "n", ((n_fraud + 1) / (F.col("n") + 2)).alias("prior_fraud"),
        ((n_legit + 1) / (F.col("n") + 2)).alias("prior_legit"),
        *[((F.col(f"f_{x}") + 1) / (n_fraud + 2)).alias(f"fraud_{x}") for x in K.EVIDENCE],
        *[((F.col(f"l_{x}") + 1) / (n_legit + 2)).alias(f"legit_{x}") for x in K.EVIDENCE])


def evidence_table(model: DataFrame) -> DataFrame:
    """The fitted row as ``(feature, p_fraud, p_legit)``."""
    rows = [F.struct(F.lit("prior").alias("feature"), F.col("prior_fraud").alias("p_fraud"),
                     F.col("prior_legit").alias("p_legit"))]
    rows += [F.struct(F.lit(x).alias("feature"), F.col(f"fraud_{x}").alias("p_fraud"),
                      F.col(f"legit_{x}").alias("p_legit")) for x in K.EVIDENCE]
    return model.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _log_posterior(side: str) -> Column:
    terms = [F.log(f"_m.prior_{side}")]
    for x in K.EVIDENCE:
        p = F.col(f"_m.{side}_{x}")
        terms.append(F.when(F.col(x) == 1, F.log(p)).otherwise(F.log(1 - p)))
    return reduce(add, terms)


def with_posterior(df: DataFrame, model: DataFrame, out: str = "bayes_score") -> DataFrame:
    """Add P(fraud | evidence) for rows that carry the evidence columns.

    The model is a single row; a scalar subquery hands it to every task.
    """
    columns = df.columns
    both = df.withColumn("_m", model.select(F.struct("*")).scalar()).select(
        *columns, _log_posterior("fraud").alias("_f"), _log_posterior("legit").alias("_l"))
    top = F.greatest("_f", "_l")
    posterior = F.exp(F.col("_f") - top) / (F.exp(F.col("_f") - top) + F.exp(F.col("_l") - top))
    return both.select(*columns, F.round(posterior, 4).alias(out))


def score_messages(df: DataFrame, model: DataFrame, text: str = "message",
                   out: str = "bayes_score") -> DataFrame:
    return score_cleaned(with_scored_text(df, text, "_scored"), model, "_scored", out).drop("_scored")


def score_cleaned(df: DataFrame, model: DataFrame, scored: str, out: str = "bayes_score") -> DataFrame:
    """``score_messages`` of rows with the text of ``with_scored_text``."""
    return with_posterior(with_evidence(df, scored), model, out).drop(*K.EVIDENCE)
