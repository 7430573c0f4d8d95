"""Quality rules as a ledger of failure bits.

``measure`` reads each text once and adds one column per measurement.
``ledger`` evaluates every rule once on these and stores a bit per failed rule.
Policies are versioned masks over the bits: ``apply_policy`` keeps or rejects
without another look at the text, ``ablation`` counts by bitwise aggregation
what each rule of a policy rejects, alone and together.

Defined cases: a null or empty text has no words (all measurements 0) and fails
``few_words``; texts are measured whole, however long; repeated rows and ties are judged row by row; extra columns pass
through, but for those with a name of a measurement or ``fail_bits``, which are
replaced; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataline.llm import _text as t
from strataline.llm._store import small_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "longest_word", "n_upper", "n_letters", "n_digits", "n_ascii")
WINDOW = 8
BYTES = np.arange(256)
SYMBOLS = np.isin(BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER, DIGITS, ASCII = (BYTES >= 65) & (BYTES <= 90), (BYTES >= 48) & (BYTES <= 57), BYTES < 128
#: A-Z, a-z, and the first byte of every character beyond ASCII.
LETTERS = UPPER | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 0xC0)

#: Bit, name, SQL condition of failure. A bit keeps its meaning for ever; new rules take new bits.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 20"),
    (1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    (2, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    (3, "symbols", "100 * n_symbols > 15 * word_chars"),
    (4, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 40 * n_words"),
    (6, "giant_word", "longest_word > 1000"),
    (7, "separators", "100 * n_symbols > 30 * n_words"),
    (8, "giant_share", "longest_word > 1000 AND 2 * longest_word > word_chars AND 2 * n_ascii > word_chars"),
    (9, "wide_words", "word_chars > 40 * n_words AND 2 * n_ascii > word_chars"),
    (10, "shouting", "2 * n_upper > n_letters"),
    (11, "few_letters", "100 * n_letters < 60 * word_chars"),
    (12, "digits", "2 * n_digits > word_chars"),
)
BITS = {name: 1 << bit for bit, name, _ in RULES}
#: (policy, version): mask of the bits that reject.
POLICIES: dict[tuple[str, int], int] = {
    ("base", 1): BITS["few_words"] | BITS["repeated_words"],
    ("corpus", 1): (1 << 7) - 1,
    ("corpus", 2): (1 << 8) - 1,
    # a long word, or long words in a script without spaces, no longer reject a text by themselves
    ("corpus", 3): sum(BITS.values()) - BITS["long_words"] - BITS["giant_word"],
}


def _measures(chunk: t.Chunk) -> list[np.ndarray]:
    w, rows = t.words(chunk), chunk.rows
    within = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[chunk.offs])
    prefix = t.prefix_hash(chunk.buf)
    newline = np.flatnonzero(chunk.buf == 10)
    at = np.searchsorted(chunk.offs, newline, "right") - 1
    begin = np.sort(np.concatenate((chunk.offs[:-1], newline + 1)), kind="stable")
    # a line begins at each row's begin and after each line feed; it ends before the next feed or at the row's end
    line_row = np.sort(np.concatenate((np.arange(rows), at)), kind="stable")
    nxt = np.searchsorted(newline, begin, "left")
    stop = np.where(nxt < len(newline), newline[np.minimum(nxt, max(len(newline) - 1, 0))] if len(newline) else 0, len(chunk.buf))
    stop = np.minimum(stop, chunk.offs[line_row + 1])
    full = np.searchsorted(w.start, begin, "left") < np.searchsorted(w.start, stop, "left")
    begin, stop, line_row = begin[full], stop[full], line_row[full]
    lines = np.bincount(line_row, minlength=rows)
    kinds, first = np.unique(t.keyed(t.span_hash(prefix, begin, stop), line_row), return_index=True)
    dup = lines - np.bincount(line_row[first], minlength=rows)
    grams, bounds = t.gram_starts(w.offs, WINDOW)
    covered = np.zeros(len(w.start) + 1, np.int64)
    if len(grams):
        h = t.keyed(t.gram_hash(t.span_hash(prefix, w.start, w.end), WINDOW)[grams], t.row_of(bounds))
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        again = grams[times[inverse] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    repeat = np.diff(np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))[w.offs])
    chars = np.concatenate(([0], np.cumsum((chunk.buf & 0xC0) != 0x80)))
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, t.row_of(w.offs), chars[w.end] - chars[w.start])
    return [w.counts, within(((chunk.buf & 0xC0) != 0x80) & w.inside), within(SYMBOLS[chunk.buf]), lines, dup, repeat, longest, *(within(x[chunk.buf]) for x in (UPPER, LETTERS, DIGITS)), within(ASCII[chunk.buf] & w.inside)]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (a clash with a measurement's name: replaced) and the measurements."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[m for m in MEASURES if m != text])
    names = docs.columns
    schema = StructType([*docs.schema.fields, *(StructField(m, LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.stack(_measures(c)) for c in t.chunks(b.column(names.index(text)))]
            got = np.concatenate(parts, axis=1) if parts else np.zeros((len(MEASURES), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in got)], names=[*names, *MEASURES])
        t.release()

    return docs.mapInArrow(run, schema)


def fail_bits(rules=RULES) -> Column:
    """The ledger's column: the sum of the bits of all failed rules."""
    bits = [F.when(F.expr(f"coalesce({cond}, false)"), F.lit(1 << bit)).otherwise(0).cast("long") for bit, _, cond in rules]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``fail_bits``; no document is dropped here."""
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, policy: str = "corpus", version: int = 3, name: str = "kept") -> DataFrame:
    """Add ``name``: whether no bit of the policy's mask is set."""
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy, version])) == 0)


def ablation(rows: DataFrame, policy: str = "corpus", version: int = 3) -> DataFrame:
    """Per rule of the policy: documents it fails, those that it alone rejects, those kept without it.

    One pass over the ledger: counts by distinct bit pattern first, then the few patterns by rule.
    """
    mask = POLICIES[policy, version]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, r, _ in RULES if mask >> b & 1])
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return (
        patterns.select("n", "bits", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
            F.bit_or("bits").alias("seen_bits"),
        )
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents and the verdict of policy corpus 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = apply_policy(apply_policy(ledger(docs)), "base", 1, "base_kept")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "n_lines", "longest_word", "fail_bits",
    )


_BITS = " + ".join(f"CASE WHEN {cond} THEN {1 << bit} ELSE 0 END" for bit, _, cond in RULES)
QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {
    "op6_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
        covered AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM again) GROUP BY r),
        m AS (
            SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
                len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters,
                length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(array_to_string(w, ''), '[^\x00-\x7F]', '', 'g')) AS n_ascii
            FROM w LEFT JOIN covered ON covered.r = w.r
        ), f AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {POLICIES["base", 1]} <> 0 AS base_failed, fail_bits & {POLICIES["corpus", 3]} = 0 AS kept, n_lines, longest_word, fail_bits FROM f
    """
}
