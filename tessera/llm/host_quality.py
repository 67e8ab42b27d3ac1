"""Quality rules with verdicts on hosts, in DataFrame functions only.

Documents are measured once; the measures, a few numbers a row, are written and used
twice: aggregated to failures by host, and joined with the hosts' verdicts.  A host's
failure rate is shrunk towards the rate of all hosts with a beta prior that is fitted to
the hosts themselves (by the moments of their rates), so a host with few documents is
not judged by them alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize

WINDOW = 8
#: Rows of host verdicts that are broadcast, at most; beyond, the join shuffles.
BROADCAST_HOSTS = 20_000

_BLANKS = r"[\x20\x09-\x0D]+"
_WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    """Bounds of the rules; percentages of words, of letters or of lines."""

    words: int = 20
    repeated_pct: int = 30
    symbols_pct: int = 10
    lines_pct: int = 30
    #: The shrunk failure rate over which a host is rejected.
    host_rate: float = 0.5


def host_of(source: Column) -> Column:
    """The host of a URL or bare name, lower-cased; a null source is the host without a name."""
    return F.lower(F.coalesce(F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def _repeated(frame: DataFrame) -> Column:
    """Words in windows found twice or more, of ``words`` and ``windows`` (their hashes).

    Equal windows have equal hashes, so a text whose hashes differ has none; the windows
    of others are compared themselves.  Sorted, equal ones are neighbours.
    """
    exact = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("k"), i.alias("p")),
    )
    return F.when((F.size("windows") > 0) & (F.size(F.array_distinct("windows")) < F.size("windows")), F.array_sort(exact))


def measures(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words): a row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (host_of(F.col("source").cast("string")) if host is None else host).alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(_WORDS))
    frame = frame.select(
        "doc_id",
        "host",
        F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)).alias("words"),
        F.char_length(F.regexp_replace("text", _BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    frame = frame.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    none = F.array().cast("array<bigint>")
    windows = F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    frame = frame.withColumn("windows", F.when(F.size("hashes") > WINDOW, windows).otherwise(none))
    frame = frame.withColumn("sorted", _repeated(frame))
    again = F.filter(
        "sorted",
        lambda x, i: F.coalesce(F.try_element_at("sorted", i + 2)["k"] == x["k"], F.lit(False))
        | F.coalesce(F.when(i > 0, F.try_element_at("sorted", i))["k"] == x["k"], F.lit(False)),
    )
    frame = frame.withColumn("starts", F.array_sort(F.transform(again, lambda x: x["p"])))
    # A window covers its words up to the next window's start, the last one all of them.
    steps = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)
    return frame.select(
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def failures(limits: Limits = Limits()) -> tuple[Column, Column]:
    """Of measures: whether a base rule fails, and whether any rule does."""
    base = (F.col("n_words") < limits.words) | (100 * F.col("n_repeat_words") > limits.repeated_pct * F.col("n_words"))
    more = (100 * F.col("n_symbols") > limits.symbols_pct * F.col("word_chars")) | (100 * F.col("n_dup_lines") > limits.lines_pct * F.col("n_lines"))
    return base, base | more


def host_verdicts(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept): failure rates shrunk with a beta prior.

    The prior has the mean of the hosts' rates and, by their variance, its weight in
    documents; hosts that all agree give the heaviest prior (1000), a single host the
    lightest (2).
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failures(limits)[1].cast("bigint")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    mean, spread, count = hosts.agg(F.avg(raw), F.var_samp(raw), F.count("*")).first()
    mean = min(max(mean or 0.0, 1e-6), 1 - 1e-6)
    room = mean * (1 - mean)
    weight = 2.0 if count < 2 else 1000.0 if not spread else min(1000.0, max(2.0, room / spread - 1))
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= limits.host_rate).alias("host_kept"))


def quality(docs: DataFrame, limits: Limits = Limits(), host: Column | None = None) -> DataFrame:
    """measures with base_failed, rate and kept: a row per document.

    kept: no base rule fails, and the host is kept.  A null or empty text has no words
    and fails.  Repeated rows count as often as they come; a null doc_id is kept as it
    is.  An empty table gives an empty one.
    """
    measured = materialize(measures(docs, host), "measures")
    verdicts = materialize(host_verdicts(measured, limits), "verdicts")
    # Broadcast up to a counted bound; else both sides are plain scans and a hot host's partition can be split.
    side = F.broadcast(verdicts) if verdicts.count() <= BROADCAST_HOSTS else verdicts
    base = failures(limits)[0]
    return measured.join(side.select("host", "rate", "host_kept"), "host").withColumn("base_failed", base).withColumn("kept", ~base & F.col("host_kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): a row per document."""
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
