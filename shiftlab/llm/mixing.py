"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells by their values of a few dimensions. Raking scales the
cells' tokens to the target share of every value of one dimension after the other until
all marginals hold. A document is then drawn with a probability in proportion to its
cell's factor (target over observed tokens); the largest factor gets probability 1, so no
probability is clipped and the expected shares of the draw are the targets. Such a draw
without repeats holds 1 / largest factor of the tokens. Where that is less than the caller
wants, :func:`sample_documents` draws one epoch, as many tokens as the corpus has, in which
a document is repeated by its factor: the whole part always, the rest by its draw number.

DataFrame operations only. The text itself is never shuffled as long as the cell table
is small enough to be sent to every task, which is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm.common import fresh, saved

#: Cells that are broadcast at most (a few MB); more are joined by a shuffle.
MAX_BROADCAST_CELLS = 50_000
#: Largest relative error of a marginal when raking ends, and the rounds after which it
#: ends in any case (marginals that no table over the given cells can meet).
TOLERANCE, ROUNDS, SAVE_EVERY = 1e-9, 60, 3

#: Topics by literal phrases, in order; the rest is ``general``.
TOPICS = {"legal": ["Licensed under", "Copyright"], "contact": ["@"]}
#: Target share of a value: its observed share to this power, rescaled to sum to 1.
EXPONENTS = {"source": 0.7, "lang": 0.9, "topic": 1.0}


def token_estimate(text: Column) -> Column:
    """A token for every four bytes, one at least."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("long")


def topic_of(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """The first topic with a phrase in the text, else ``general``."""
    out = None
    for name, phrases in (topics or TOPICS).items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(text, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out.otherwise("general"), F.lit("general")) if out is not None else F.lit("general")


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame] | None = None,
         exponents: dict[str, float] | None = None) -> DataFrame:
    """``cells`` (``dims`` and ``tokens``) with ``factor``: target over observed tokens.

    Targets of a dimension are a DataFrame (value, share) or, without one, tempered by its
    exponent (1: as observed). Values that a given target does not name get its smallest
    share; shares are rescaled to sum to 1 over the values at hand. The last dimension's
    marginal is exact; the others' are within ``TOLERANCE`` unless the targets contradict
    each other on these cells, in which case raking ends after ``ROUNDS`` rounds.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    t = cells.withColumn("w", F.col("tokens") / F.lit(float(total or 1)))
    for d in dims:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("_sum"))
        if targets and d in targets:
            given = targets[d].toDF(d, "_given").withColumn(d, F.coalesce(F.col(d).cast("string"), F.lit("")))
            least = float(given.agg(F.min("_given")).first()[0])
            sums = (sums.join(given, d, "left")
                    .select(d, F.coalesce(F.col("_given").cast("double"), F.lit(least)).alias("_raw")))
        else:
            sums = sums.select(d, F.pow(F.col("_sum").cast("double"), F.lit(float((exponents or {}).get(d, 1.0))))
                               .alias("_raw"))
        whole = sums.agg(F.sum("_raw")).first()[0] or 1.0
        t = t.join(sums.select(d, (F.col("_raw") / F.lit(whole)).alias(f"_to_{d}")), d)
    t = saved(t, "cells")
    for k in range(0, ROUNDS, SAVE_EVERY):
        for _ in range(SAVE_EVERY):
            for d in dims:
                t = t.withColumn("w", F.col("w") * F.col(f"_to_{d}") / F.sum("w").over(Window.partitionBy(d)))
        t = saved(t, "cells")
        checked = t
        for d in dims:
            checked = checked.withColumn(f"_off_{d}", F.abs(F.sum("w").over(Window.partitionBy(d))
                                                            / F.col(f"_to_{d}") - 1))
        off = checked.agg(F.max(F.greatest(*[F.col(f"_off_{d}") for d in dims], F.lit(0.0)))).first()[0]
        if off is None or off < TOLERANCE:
            break
    return t.select(*dims, "tokens", (F.col("w") * F.lit(float(total or 1)) / F.col("tokens")).alias("factor"))


def _dimension(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def calibrated(docs: DataFrame, dims: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None = None,
               exponents: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, str], float]:
    """``docs`` with a column per dimension (null: '') and the row's tokens, factor and
    probability, the names these columns got, and the expected share of the tokens in a draw
    without repeats. An empty table stays empty."""
    names = list(dims)
    own = dict(zip([*names, "tokens", "factor", "probability"],
                   fresh(docs, *[f"_dim_{n}" for n in names], "_tokens", "_factor", "_probability")))
    rows = docs.select("*", *[_dimension(c).alias(own[n]) for n, c in dims.items()], tokens.alias(own["tokens"]))
    cells = saved(rows.groupBy(*[F.col(own[n]).alias(n) for n in names]).agg(F.sum(own["tokens"]).alias("tokens")),
                  "cells")
    raked = saved(rake(cells, names, targets, exponents), "factors")
    top, count = raked.agg(F.max("factor"), F.count("*")).first()
    raked = raked.select(*[F.col(n).alias(own[n]) for n in names], F.col("factor").alias(own["factor"]),
                         (F.col("factor") / F.lit(top)).alias(own["probability"]))
    if count <= MAX_BROADCAST_CELLS:
        raked = F.broadcast(raked)
    return rows.join(raked, [own[n] for n in names]), own, 1 / top if top else 1.0


def draw_number(id_col: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the id (null: as '') and the seed, the same on every run."""
    key = F.concat(_dimension(id_col), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  lang_col: str = "lang", topics: dict[str, list[str]] | None = None,
                  targets: dict[str, DataFrame] | None = None, exponents: dict[str, float] | None = None,
                  seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``factor``, ``probability``, ``selected``.

    Null sources and languages count as ''. A row is selected when its draw number lies
    below its probability; repeated rows of an id are drawn alike. Further columns are
    ignored.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(source_col).alias("source"),
                       F.col(lang_col).alias("lang"))
    out, own, _ = calibrated(rows, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"), topics)},
                     token_estimate(F.col("text")), targets, EXPONENTS if exponents is None else exponents)
    return out.select("doc_id", *[F.col(own[n]).alias(n) for n in ("source", "lang", "topic")],
                      F.col(own["tokens"]).alias("n_tokens"), F.col(own["factor"]).alias("factor"),
                      F.col(own["probability"]).alias("probability"),
                      (draw_number(F.col("doc_id"), seed) < F.col(own["probability"])).alias("selected"))


def sample_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     lang_col: str = "lang", topics: dict[str, list[str]] | None = None,
                     targets: dict[str, DataFrame] | None = None, exponents: dict[str, float] | None = None,
                     seed: int = 0, least: float = 0.0) -> DataFrame:
    """The selected rows of ``docs``, all columns as they are (see :func:`mix_documents`).

    If these are expected to hold less than the share ``least`` of all tokens, one epoch
    is drawn instead: each row ``floor(factor)`` times, and once more if its draw number
    lies below the rest, so that the draw holds as many tokens as ``docs``.
    """
    text = F.col(text_col)
    out, own, share = calibrated(docs, {"source": F.col(source_col), "lang": F.col(lang_col), "topic": topic_of(text, topics)},
                     token_estimate(text), targets, EXPONENTS if exponents is None else exponents)
    number = draw_number(F.col(id_col), seed)
    if share >= least:
        return out.where(number < F.col(own["probability"])).select(*docs.columns)
    factor = F.col(own["factor"])
    times = F.floor(factor) + (number < factor - F.floor(factor)).cast("long")
    repeat, = fresh(out, "_repeat")
    return (out.where(times > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(repeat))
            .select(*docs.columns))
