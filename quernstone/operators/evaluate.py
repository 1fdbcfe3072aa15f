"""Retrieval and refusal metrics over labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many values are named in an error.
NAMED = 20
METRICS = ("p_at_1", "p_at_5", "r_at_5", "r_at_10", "mrr", "ndcg_at_10")


class IndexTooSmall(ValueError):
    """The index is no larger than the ranking depth, so every ranking would look perfect."""


class DatasetError(ValueError):
    """The labelled questions don't hold together."""


def precision(hits: Column, k: int) -> Column:
    return hits / k if k > 0 else F.lit(0.0)


def ideal_gain(n: Column) -> Column:
    """The gain of n hits at the first n ranks."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))).otherwise(0.0)


def by_question(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """METRICS of each question (query_id, n_relevant) from hits (query_id, rank, hit 0 or 1); 0 where nothing is ranked or relevant."""
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    hits = ranked.groupBy("query_id").agg(
        upto(1).alias("h1"), upto(5).alias("h5"), upto(10).alias("h10"), F.max(F.col("hit") / F.col("rank")).alias("rr"),
        F.sum(F.when(F.col("rank") <= 10, F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
    )
    q = questions.select("query_id", "n_relevant").join(hits, "query_id", "left").na.fill(0)
    n = F.col("n_relevant")
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    ideal = ideal_gain(F.least(n, F.lit(10)).cast("int"))
    return q.select(
        "query_id", precision(F.col("h1"), 1).alias("p_at_1"), precision(F.col("h5"), 5).alias("p_at_5"), share(F.col("h5")).alias("r_at_5"), share(F.col("h10")).alias("r_at_10"),
        F.coalesce("rr", F.lit(0.0)).alias("mrr"), F.when(ideal > 0, F.col("gain") / ideal).otherwise(0.0).alias("ndcg_at_10"),
    )


def retrieval_scores(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Means over questions; zeros without any."""
    each = by_question(questions, ranked)
    return each.agg(F.count("*").alias("questions"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS))


def refusal_scores(answers: DataFrame) -> DataFrame:
    """From (answerable, escalated): the shares of unanswerable questions answered and of answerable ones refused."""
    share = lambda of, bad: F.coalesce(F.avg(F.when(of, bad.cast("double"))), F.lit(0.0))
    yes, up = F.col("answerable"), F.col("escalated")
    return answers.agg(
        F.coalesce(F.sum((~yes).cast("long")), F.lit(0)).alias("unanswerable"), F.coalesce(F.sum(yes.cast("long")), F.lit(0)).alias("answerable"),
        share(~yes, ~up).alias("false_answer_rate"), share(yes, up).alias("wrongly_refused_rate"),
    )


def refusal_sweep(answers: DataFrame, floors: list[float]) -> DataFrame:
    """From (answerable, score, refused) to (floor, unanswerable, answerable, false_answer_rate, wrongly_refused_rate), a row a floor, in one aggregation.

    A question is escalated at a floor if it is refused anyway, has no score or one under the floor.
    """
    yes = F.col("answerable")
    share = lambda of, bad: F.coalesce(F.avg(F.when(of, bad.cast("double"))), F.lit(0.0))
    rows = []
    for i, floor in enumerate(floors):
        up = F.col("refused") | F.col("score").isNull() | (F.col("score") < floor)
        rows += [share(~yes, ~up).alias(f"f{i}"), share(yes, up).alias(f"w{i}")]
    one = answers.agg(F.coalesce(F.sum((~yes).cast("long")), F.lit(0)).alias("no"), F.coalesce(F.sum(yes.cast("long")), F.lit(0)).alias("yes"), *rows)
    each = F.array(*(F.struct(F.lit(float(f)).alias("floor"), F.col("no").alias("unanswerable"), F.col("yes").alias("answerable"), F.col(f"f{i}").alias("false_answer_rate"), F.col(f"w{i}").alias("wrongly_refused_rate")) for i, f in enumerate(floors)))
    return one.select(F.inline(each))


def refusal_curve(answers: DataFrame, places: int = 4) -> DataFrame:
    """The same at every floor that makes a difference: every score that occurs, rounded to `places`.

    Scores are first counted by their rounded value.  The window then sums over one row a value, of which scores up to 1 have at most 10^places + 1.
    """
    yes, held = F.col("answerable"), ~F.col("refused") & F.col("score").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    at = F.when(held, F.round("score", places))
    by = answers.groupBy(at.alias("floor")).agg(count(yes).alias("y"), count(~yes).alias("n"))
    everything, under = Window.partitionBy(), Window.orderBy(F.col("floor").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    whole_y, whole_n = F.sum("y").over(everything), F.sum("n").over(everything)
    refused_y, refused_n = F.coalesce(F.sum("y").over(under), F.lit(0)), F.coalesce(F.sum("n").over(under), F.lit(0))
    return by.select("floor", whole_n.alias("unanswerable"), whole_y.alias("answerable"), share(whole_n - refused_n, whole_n).alias("false_answer_rate"), share(refused_y, whole_y).alias("wrongly_refused_rate")).where("floor is not null")


def best_floor(curve: DataFrame, false_answer: float = 1.0, wrong_refusal: float = 1.0) -> DataFrame:
    """The row of a curve with the least cost, where a false answer and a wrong refusal cost so much; the lowest floor of several."""
    cost = F.round(F.col("false_answer_rate") * false_answer + F.col("wrongly_refused_rate") * wrong_refusal, 12)
    return curve.withColumn("cost", cost).orderBy("cost", "floor").limit(1)


def guard_index_size(chunks: int, depth: int) -> None:
    if chunks <= depth:
        raise IndexTooSmall(f"an index of {chunks} chunks can't tell rankings of depth {depth} apart")


def missing_labels(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """Labels (query_id, label) that no section key has; questions (query_id, relevant), sections (key)."""
    wanted = questions.select("query_id", F.explode("relevant").alias("label"))
    return wanted.join(sections.select(F.col("key").alias("label")).distinct(), "label", "left_anti").select("query_id", "label")


def validate(questions: DataFrame, sections: DataFrame) -> None:
    bad = missing_labels(questions, sections).select("label").distinct()
    if n := bad.count():
        raise DatasetError(named(f"{n} labels without a section", bad.orderBy("label"), n))


def named(what: str, rows: DataFrame, n: int) -> str:
    """An error's text with the first NAMED of n values, and how many more there are."""
    first = [str(r[0]) for r in rows.limit(NAMED).collect()]
    return f"{what}: {', '.join(first)}" + (f" and {n - NAMED} more" if n > NAMED else "")


def as_row(name: str, scores: dict) -> str:
    """A line of a Markdown table, three decimals."""
    return "| " + " | ".join([name, *(f"{v:.3f}" if isinstance(v, float) else str(v) for v in scores.values())]) + " |"
