"""Host-level quality rules.

Every document is measured once. Rule failures are summed by host, each host's
failure rate is shrunk towards the corpus with a beta prior that is itself fitted
to the hosts (method of moments), and the host's verdict is joined back:

* ``rejected`` host: the shrunk rate is above ``reject_rate``; none of its documents stay.
* ``suspect`` host: above ``suspect_rate``; its documents must meet the strict symbol limit.
* ``trusted`` host: its documents must meet the loose symbol limit.

A document that fails the base rule (too few words, or mostly repeated windows)
never stays. Defined results: a null or empty text has no words and fails; a null
host is one host of its own; repeated rows are measured and returned one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols per word: the limit for suspect and for trusted hosts, and for the host's own statistics.
STRICT_SYMBOLS, LOOSE_SYMBOLS = 0.1, 0.5
#: Share of lines that repeat an earlier line, and mean word length: limits for the host's statistics.
MAX_DUP_LINES, WORD_LENGTH = 0.3, (2.0, 15.0)
SUSPECT_RATE, REJECT_RATE = 0.4, 0.7

_DELETE_BUT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_CONTINUATION = bytes(range(128, 192))
_MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The six measures of one UTF-8 text, in the order of ``_MEASURES``."""
    words = text.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    # Continuation bytes stand in words only, so code points are bytes less those.
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUATION)))
    return n, chars, len(text.translate(None, _DELETE_BUT_SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def _columns(texts: pa.Array) -> tuple[list[pa.Array], list[str]]:
    """The measures of some texts, by column, and their names."""
    rows = [measure(x) for x in as_bytes(texts)]
    names = [x.split()[0] for x in _MEASURES.split(", ")]
    return [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(names))], names


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns, names = _columns(batch.column(0))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *names])


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, host and the measures, in one pass over the whole texts."""
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].alias("doc_id"), docs[host_col].alias("host"))
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[1:])
    return rows.mapInArrow(_measured, f"{schema}, {_MEASURES}")


def carried_measures(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., host and the measures. Only texts go to Python and only measures come back."""

    @F.arrow_udf(_MEASURES)
    def measures(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(*_columns(texts))

    carried = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    # Not deterministic as far as the plan goes: a filter moved below would measure again.
    rows = docs.select(docs[host_col].alias("host"), measures.asNondeterministic()(docs[text_col]).alias("m"), *carried)
    return rows.select("host", "m.*", *[f"c{i}" for i in range(len(carried))])


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed():
    """Whether a document counts as a failure in its host's statistics: any rule."""
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return (
        base_failed()
        | (F.col("n_symbols") > STRICT_SYMBOLS * F.col("n_words"))
        | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
        | ~length.between(*WORD_LENGTH)
    )


def host_verdicts(measures: DataFrame, suspect_rate: float = SUSPECT_RATE, reject_rate: float = REJECT_RATE) -> DataFrame:
    """Per host: n, failures, the shrunk rate and the verdict.

    The prior Beta(a, b) has the mean of the pooled rate m and the strength k = a + b
    that explains the variance v of the hosts' rates (weighted by documents):
    k = m(1-m)/v - 1, kept within 1 and 1e6, so one host or equal hosts shrink fully.
    """
    hosts = measures.groupBy("host").agg(F.count("*").alias("n"), F.sum(rule_failed().cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    pooled = hosts.agg(
        (F.sum("failures") / F.sum("n")).alias("m"),
        (F.sum(F.col("n") * rate * rate) / F.sum("n")).alias("square"),
    ).select("m", F.greatest(F.col("square") - F.col("m") * F.col("m"), F.lit(1e-12)).alias("v"))
    strength = F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.lit(1e6))
    shrunk = (F.col("failures") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k"))
    verdict = F.when(F.col("rate") > reject_rate, "rejected").when(F.col("rate") > suspect_rate, "suspect").otherwise("trusted")
    # The prior is one row by construction, so joining it on a constant is no cross product of data.
    return (
        hosts.join(F.broadcast(pooled.select("m", strength.alias("k"))), F.lit(True))
        .select("host", "n", "failures", shrunk.alias("rate"))
        .withColumn("verdict", verdict)
    )


def _judged(measures: DataFrame, hosts: DataFrame) -> DataFrame:
    # A shuffle on the host meets hot hosts; adaptive execution splits those partitions or
    # broadcasts the host table when its measured size is below Spark's threshold.
    hosts = hosts.select(F.col("host").alias("of_host"), F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    joined = measures.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    limit = F.when(F.col("host_verdict") == "trusted", LOOSE_SYMBOLS).otherwise(STRICT_SYMBOLS)
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("host_verdict") != "rejected") & (F.col("n_symbols") <= limit * F.col("n_words"))
    )


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rates: float) -> DataFrame:
    """Measures, base_failed, the host's rate and verdict, and kept, per row of ``docs``."""
    measures = materialize(document_measures(docs, id_col, text_col, host_col), "rules")
    return _judged(measures, host_verdicts(measures, **rates))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rates: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep. Texts are measured twice, once for the hosts and
    once for the decision, which costs less than a shuffle of the texts."""
    hosts = materialize(host_verdicts(document_measures(docs, id_col, text_col, host_col), **rates), "hosts")
    return _judged(carried_measures(docs, text_col, host_col), hosts).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
