"""Removal of repeated multi-line passages, by content-defined chunks of lines.

A rolling hash over the hashes of the last lines decides after which line a
chunk ends, so a passage is cut alike wherever it stands.  Chunks of two lines
or more whose digest occurs again are compared byte for byte over the whole
corpus; the first stays and the others are cut out of their documents.

A passage whose ends do not meet a boundary is in no chunk of its own, so
:func:`remove_repeated_chunks` leaves parts of it in place.
:func:`remove_repeated_passages` seeds on every pair of adjacent lines instead
and takes the whole run out, in whatever surroundings it stands.

Column expressions and joins only.  Cutting is row-local; what is shuffled is
one digest per chunk or pair, the texts that hold a candidate, and the final join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.llm.common import store

#: A chunk ends after one line in so many.
ONE_IN = 4
#: Lines the rolling hash looks back on, itself included, and its base.
WINDOW, BASE = 2, 31
#: Lines of the shortest chunk that may be removed.
LEAST_LINES = 2


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def cut_lines(text: Column, window: int = WINDOW, one_in: int = ONE_IN) -> Column:
    """Array of (k, lines, content): the chunks of a text in order."""

    def rolling(hashes: Column, at: Column) -> Column:
        terms = [
            F.coalesce(F.get(hashes, at - back), F.lit(0).cast("long")) * (BASE**back) for back in range(window)
        ]
        return sum(terms[1:], terms[0])

    def ends(lines: Column) -> Column:
        last = F.size(lines) - 1
        return let(
            F.transform(lines, line_hash),
            lambda hashes: F.filter(
                F.sequence(F.lit(0), last), lambda at: (at == last) | (rolling(hashes, at) % one_in == 0)
            ),
        )

    def chunks(lines: Column) -> Column:
        def chunk(stops: Column, stop: Column, k: Column) -> Column:
            start = F.coalesce(F.get(stops, k - 1) + 1, F.lit(0))
            return F.struct(
                k.alias("k"),
                (stop - start + 1).alias("lines"),
                F.array_join(F.slice(lines, start + 1, stop - start + 1), "\n").alias("content"),
            )

        return let(ends(lines), lambda stops: F.transform(stops, lambda stop, k: chunk(stops, stop, k)))

    return let(F.split(text, "\n", -1), chunks)


def remove_repeated_chunks(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES
) -> DataFrame:
    """``df`` with its text cut, and with n_lines, n_chunks, removed_lines, removed_chunks.

    Of equal chunks of ``least_lines`` lines or more the one with the smallest
    id (null first), then the earliest in its text, stays.  The four counts and
    all other columns of ``df`` keep their names; a column of ``df`` that has the
    name of a count is replaced.  A null text stays null and has no lines; an
    empty one has one empty line.  Rows that agree in id and text are one
    document: each chunk of theirs stays or goes in all of them.
    """
    own = F.struct(
        F.col(id_col).cast("long").alias("id"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("md5"),
    )
    texts = df.filter(F.col(text_col).isNotNull()).select(own.alias("own"), F.col(text_col).alias("text"))
    cut = texts.select("own", F.explode(cut_lines(F.col("text"))).alias("c"))
    digests = store(
        cut.filter(F.col("c.lines") >= least_lines).select("own", F.col("c.k").alias("k"), F.md5("c.content").alias("digest")),
        "line-chunks",
    )
    again = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    candidates = digests.join(again, "digest").select("own", "k").distinct()
    wanted = candidates.groupBy("own").agg(F.collect_set("k").alias("ks"))
    held = store(
        texts.join(wanted, "own")
        .select("own", "ks", F.explode(cut_lines(F.col("text"))).alias("c"))
        .filter(F.array_contains("ks", F.col("c.k")))
        .select("own", F.col("c.k").alias("k"), F.col("c.content").alias("content"))
        .distinct(),
        "line-candidates",
    )
    kept = held.groupBy("content").agg(F.min(F.struct("own", "k")).alias("first"), F.count("*").alias("n"))
    surplus = (
        held.join(kept.filter("n > 1").select(F.col("content").alias("same"), "first"), F.col("content") == F.col("same"))
        .filter(F.struct("own", "k") != F.col("first"))
        .groupBy("own")
        .agg(F.collect_set("k").alias("gone"))
        .withColumnRenamed("own", "at")
    )
    counts = ("n_lines", "n_chunks", "removed_lines", "removed_chunks")
    rest = [F.col(c) for c in df.columns if c not in counts and c != text_col]
    total = lambda chunks: F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + c["lines"])

    def without(chunks: Column) -> Column:
        kept_ = F.filter(chunks, lambda c: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), c["k"]))
        return let(
            kept_,
            lambda stay: F.struct(
                F.array_join(F.transform(stay, lambda c: c["content"]), "\n").alias("text"),
                total(chunks).alias("n_lines"),
                F.size(chunks).cast("long").alias("n_chunks"),
                (total(chunks) - total(stay)).alias("removed_lines"),
                (F.size(chunks) - F.size(stay)).cast("long").alias("removed_chunks"),
            ),
        )

    joined = df.withColumn("__own", own).join(surplus, F.col("__own") == F.col("at"), "left")
    done = joined.withColumn("__cut", F.when(F.col(text_col).isNotNull(), let(cut_lines(F.col(text_col)), without)))
    return done.select(
        *[F.col("__cut.text").alias(c) if c == text_col else F.col(c) for c in df.columns if c not in counts],
        *[F.coalesce(F.col(f"__cut.{c}"), F.lit(0).cast("long")).alias(c) for c in counts],
    )


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without its repeated runs of two lines or more, and with n_lines, removed_lines, removed_runs.

    Every two adjacent lines are a seed, unless both are blank.  A seed that
    stands, byte for byte, in a document with a smaller id (null first) or
    earlier in its own without a common line is a repetition; repetitions that
    touch or overlap make up one run, which is cut out as a whole.  The first
    place of every line stays.  Ids, texts, counts and other columns are treated
    as in :func:`remove_repeated_chunks`.
    """
    own = F.struct(
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("md5"),
    )
    texts = df.filter(F.col(text_col).isNotNull()).select(own.alias("own"), F.col(text_col).alias("text"))
    split = lambda text: F.split(text, "\n", -1)
    seed = lambda lines, at: F.concat(F.get(lines, at), F.lit("\n"), F.get(lines, at + 1))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def seeds(lines: Column) -> Column:
        every = F.transform(numbers(F.size(lines) - 1), lambda at: F.struct(at.alias("at"), seed(lines, at).alias("content")))
        worded = F.filter(every, lambda s: s["content"].rlike(r"[^\x20\x09-\x0D]"))
        return F.transform(worded, lambda s: F.struct(s["at"].alias("at"), F.unhex(F.md5(s["content"])).alias("digest")))

    digests = store(
        texts.select("own", F.explode(let(split(F.col("text")), seeds)).alias("s")).select("own", "s.at", "s.digest"), "line-seeds"
    )
    again = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    wanted = digests.join(again, "digest").groupBy("own").agg(F.collect_set("at").alias("ats"))
    # rows that agree in id and text bring their places twice, which changes neither the first place nor the set of the others
    held = store(
        texts.join(wanted, "own").select(
            "own",
            F.explode(
                let(
                    split(F.col("text")),
                    lambda lines: F.transform("ats", lambda at: F.struct(at.alias("at"), seed(lines, at).alias("content"))),
                )
            ).alias("s"),
        ).select("own", "s.at", "s.content"),
        "seed-candidates",
    )
    first = held.groupBy("content").agg(F.min(F.struct("own", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    surplus = (
        held.join(first.withColumnRenamed("content", "same"), F.col("content") == F.col("same"))
        .filter((F.col("own") != F.col("first.own")) | (F.col("at") > F.col("first.at") + 1))
        .groupBy("own")
        .agg(F.collect_set("at").alias("gone"))
        .withColumnRenamed("own", "met")
    )
    counts = ("n_lines", "removed_lines", "removed_runs")

    def without(lines: Column) -> Column:
        gone = F.coalesce("gone", F.array().cast("array<int>"))
        cut = F.array_union(gone, F.transform(gone, lambda at: at + 1))
        return let(
            F.struct(lines.alias("lines"), cut.alias("cut")),
            lambda x: F.struct(
                F.array_join(
                    F.transform(F.array_except(numbers(F.size(x["lines"])), x["cut"]), lambda at: F.get(x["lines"], at)), "\n"
                ).alias("text"),
                F.size(x["lines"]).cast("long").alias("n_lines"),
                F.size(x["cut"]).cast("long").alias("removed_lines"),
                F.size(F.array_except(x["cut"], F.transform(x["cut"], lambda at: at + 1))).cast("long").alias("removed_runs"),
            ),
        )

    joined = df.withColumn("__own", own).join(surplus, F.col("__own") == F.col("met"), "left")
    done = joined.withColumn("__cut", F.when(F.col(text_col).isNotNull(), let(split(F.col(text_col)), without)))
    return done.select(
        *[F.col("__cut.text").alias(c) if c == text_col else F.col(c) for c in df.columns if c not in counts],
        *[F.coalesce(F.col(f"__cut.{c}"), F.lit(0).cast("long")).alias(c) for c in counts],
    )
