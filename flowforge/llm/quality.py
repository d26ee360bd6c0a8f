"""Quality rules: word statistics of each text and cross-document line
frequency, in DataFrame expressions only.

Method
------
1. Every row gets its word statistics inside the scan projection (no shuffle).
   Repeated three-word windows are found by sorting one array of longs per row
   (window hash in the high bits, position in the low bits); rows of the array
   that share the high bits are candidates and are compared as text.
2. Lines are normalised (A-Z to lower case, white space collapsed), hashed and
   counted per host by *distinct documents*.  A line held by more documents of
   its host than the limit is removed from all but the host's first document
   (smallest id), so a text that was copied many times is not lost as a whole.
   A row's own lines are told apart by their place, so a row that stands twice has
   its words removed once.
3. A document is rejected when a base rule fails or when removal leaves less
   than ``min_kept_share`` of its words.

Only ``(host, document, line hash, words)`` rows are shuffled, pre-aggregated;
the table of frequent lines holds at most ``lines / limit`` rows, is counted, and
is broadcast up to ``broadcast_rows`` rows, else joined by shuffle.  The host sizes
meet the line counts by (host, salt), so the lines of a hot host are not one task's.

Defined results: a null or empty text has no words (base rule fails, not
kept); a null host is a host of its own; rows with the same id and text count
as one document and get the same verdict; rows of a null id are told apart by
their text; an empty table gives an empty result; extra columns pass through
unless they have the name of a result column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import materialize

SYMBOLS = "#*$%&|<>"
HOST_SALTS = 64
_SPLIT = r"[\\x20\\x09-\\x0D]+"
_TRIM = r"^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
          "removed_words", "clean_text", "kept"]


def _words(col: str) -> str:
    """SQL: words of ``col``; an empty array for null, empty or blank text."""
    return (f"filter(split(coalesce({col}, ''), '{_SPLIT}'), w -> w <> '')")


def _has_word(col: str) -> str:
    return f"{col} rlike '[^\\\\x20\\\\x09-\\\\x0D]'"


def _norm_line(col: str) -> str:
    """SQL: a line with A-Z lower-cased and its words joined by one space."""
    lower = (f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return (f"regexp_replace(regexp_replace({lower}, '{_TRIM}', ''), '{_SPLIT}', ' ')")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for the value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """SQL: words in three-word windows that occur twice or more in ``words``."""
    # low bits for the position, the rest for the hash of the window
    keys = ("sort_array(transform(if(size(w) < 3, cast(array() as array<bigint>), sequence(0L, size(w) - 3L)), i ->"
            " shiftleft(xxhash64(w[int(i)], w[int(i) + 1], w[int(i) + 2]), k) | i))")
    # neighbours with one hash are candidates ...
    cand = ("transform(filter(keys, (x, j) ->"
            " coalesce(shiftright(x, k) = shiftright(get(keys, j - 1), k), false)"
            " or coalesce(shiftright(x, k) = shiftright(get(keys, j + 1), k), false)),"
            " x -> x & (shiftleft(1L, k) - 1))")
    # ... and are compared as text
    same = ("sort_array(transform(cand, p -> struct(concat_ws(' ', w[int(p)],"
            " w[int(p) + 1], w[int(p) + 2]) as t, p as p)))")
    at = ("sort_array(transform(filter(same, (x, j) ->"
          " coalesce(x.t = get(same, j - 1).t, false)"
          " or coalesce(x.t = get(same, j + 1).t, false)), x -> x.p))")
    covered = (f"aggregate({at}, struct(-3L as at, 0L as n), (a, p) ->"
               " struct(p as at, a.n + least(3L, p - a.at) as n)).n")
    return _let("w", words, _let("k", "cast(length(bin(size(w))) as int)", _let(
        "keys", keys, _let("cand", cand, _let("same", same, covered)))))


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    d = (docs.withColumn("_qr_text", F.coalesce(F.col(text), F.lit("")))
         .withColumn("_qr_w", F.expr(_words("_qr_text")))
         .withColumn("_qr_lines", F.expr(
             f"filter(split(_qr_text, '\\n'), l -> {_has_word('l')})")))
    return (d.withColumn("n_words", F.size("_qr_w").cast("long"))
            .withColumn("word_chars", F.expr(
                r"cast(length(translate(_qr_text, ' \t\n\u000b\u000c\r', '')) as bigint)"))
            .withColumn("n_symbols", F.expr(
                f"cast(length(_qr_text) - length(translate(_qr_text, '{SYMBOLS}', '')) as bigint)"))
            .withColumn("n_dup_lines", F.expr(
                "cast(size(_qr_lines) - size(array_distinct(_qr_lines)) as bigint)"))
            .withColumn("n_repeat_words", F.expr(_repeat_words("_qr_w")))
            .drop("_qr_w", "_qr_lines", "_qr_text"))


def document_lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per line with a word: host, document key and id, row, place, line hash, words."""
    words = _words("line")
    return (docs.select("_qr_key", "_qr_row", F.col(doc_id).alias("_qr_id"), F.col(host).alias("_qr_host"),
                        F.posexplode(F.split(F.col(text), "\n")).alias("_qr_at", "line"))
            .filter(F.expr(_has_word("line")))
            .select("_qr_host", "_qr_key", "_qr_id", "_qr_row", "_qr_at", F.expr(f"xxhash64({_norm_line('line')})").alias("_qr_h"),
                    F.expr(f"size({words})").cast("long").alias("_qr_words")))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  min_line_docs: int = 50, line_share: float = 0.05,
                  min_kept_share: float = 0.3, min_words: int = 50,
                  max_repeat_share: int = 50, broadcast_rows: int = 500_000,
                  least_line_docs: int = 4) -> DataFrame:
    """``docs`` with the columns of ``RESULT``.

    A line is frequent on a host when more than ``min_line_docs`` documents hold
    it, or more than ``max(least_line_docs, line_share * documents of the host)``.
    """
    d = docs.drop(*[c for c in RESULT if c in docs.columns and c not in (doc_id, text, host)])
    d = d.withColumn("_qr_key", F.xxhash64(
        F.col(doc_id), F.when(F.col(doc_id).isNull(), F.col(text)), F.lit(1)))
    d = d.withColumn("_qr_row", F.xxhash64("_qr_key", F.col(text)))
    lines = document_lines(d, doc_id, text, host)
    counts = (lines.groupBy("_qr_host", "_qr_key", "_qr_h").agg(F.min("_qr_id").alias("_qr_id"))
              .groupBy("_qr_host", "_qr_h")
              .agg(F.count(F.lit(1)).alias("_qr_docs"), F.min("_qr_id").alias("_qr_first"))
              .filter(F.col("_qr_docs") > min(min_line_docs, least_line_docs))
              .withColumn("_qr_salt", F.pmod("_qr_h", F.lit(HOST_SALTS))))
    hosts = (d.groupBy(F.col(host).alias("_qr_host2"), "_qr_key").agg(F.lit(1).alias("one"))
             .groupBy("_qr_host2").agg(F.count(F.lit(1)).alias("_qr_all"))
             .withColumn("_qr_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOST_SALTS - 1).cast("long")))))
    share = F.greatest(F.lit(float(least_line_docs)), F.col("_qr_all") * F.lit(float(line_share)))
    frequent = (counts.join(hosts, F.col("_qr_host").eqNullSafe(F.col("_qr_host2"))
                            & (F.col("_qr_salt") == F.col("_qr_salt2")))
                .filter((F.col("_qr_docs") > min_line_docs) | (F.col("_qr_docs") > share))
                .select(F.col("_qr_host").alias("_qr_fhost"), F.col("_qr_h").alias("_qr_fh"), "_qr_first"))
    frequent = materialize(frequent)
    if frequent.count() <= broadcast_rows:  # then the lines need no shuffle to meet them
        frequent = F.broadcast(frequent)
    cut = (lines.join(frequent, F.col("_qr_host").eqNullSafe(F.col("_qr_fhost"))
                      & (F.col("_qr_h") == F.col("_qr_fh")))
           .filter(F.col("_qr_id").isNull() | F.col("_qr_first").isNull()
                   | (F.col("_qr_id") != F.col("_qr_first")))
           .groupBy(F.col("_qr_row").alias("_qr_crow"), F.col("_qr_host").alias("_qr_chost"))
           .agg(F.collect_set(F.struct("_qr_at", "_qr_words", "_qr_h")).alias("_qr_cut"))
           .select("_qr_crow", "_qr_chost", F.array_distinct("_qr_cut._qr_h").alias("_qr_bad"),
                   F.expr("aggregate(_qr_cut._qr_words, 0L, (a, n) -> a + n)").alias("removed_words")))
    out = (word_statistics(d, text)
           .withColumn("_qr_jhost", F.col(host))
           .join(cut, (F.col("_qr_row") == F.col("_qr_crow"))
                 & F.col("_qr_jhost").eqNullSafe(F.col("_qr_chost")), "left")
           .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
           .withColumn("base_failed", (F.col("n_words") < min_words)
                       | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_share)))
    out = out.withColumn("kept", ~F.col("base_failed") & (
        (F.col("n_words") - F.col("removed_words")) >= F.col("n_words") * F.lit(float(min_kept_share))))
    bad = f"array_contains(_qr_bad, xxhash64({_norm_line('l')}))"
    out = out.withColumn("clean_text", F.when(F.col("_qr_bad").isNull(), F.col(text)).otherwise(F.expr(
        f"array_join(filter(split({text}, '\\n'), l -> not ({_has_word('l')} and {bad})), '\\n')")))
    return out.drop("_qr_key", "_qr_row", "_qr_crow", "_qr_chost", "_qr_bad", "_qr_jhost")
