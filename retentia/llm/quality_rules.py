"""Operator 1: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements
and ``fail_bits`` (bit i set: rule i failed). Policies are versioned bit masks
over the ledger: applying another policy, or asking what a policy would keep
without one of its rules, is bit arithmetic on the stored column and never
reads the texts again.

Defined results: null text has no words (all measurements 0), so it fails
``few_words``; empty text likewise; repeated rows are measured each on their
own; an empty table gives an empty ledger. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import textarrays as ta
from retentia.llm.common import id_and_text, id_array, map_blocks, read_table, text_array, utf8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def rules() -> list[tuple[str, Column]]:
    """(name, failure condition over the measurements); bit positions are fixed by the order."""
    c = F.col
    return [
        ("few_words", c("n_words") < 20),
        ("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 30 * c("n_words")),
        ("duplicate_lines", 10 * c("n_dup_lines") > 7 * c("n_lines")),
    ]


#: Rule i is bit i. The order is part of the stored ledger: append, never reorder.
RULE_NAMES = ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "duplicate_lines")


def mask_of(*names: str) -> int:
    return sum(1 << RULE_NAMES.index(n) for n in names)


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": mask_of("few_words", "repeated_windows"),
    "v1": mask_of("few_words", "repeated_windows", "symbols", "short_words", "long_words"),
    "strict": mask_of(*RULE_NAMES),
}


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Mask of the entries that occur at least twice."""
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(keys, again) if len(again) else np.zeros(len(keys), bool)


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of a block of texts."""
    rows = len(offs) - 1
    starts, ends, first = ta.word_spans(buf, offs)
    row_sum = lambda per_byte: np.diff(np.append(0, np.cumsum(per_byte))[offs])
    out = {"n_words": np.diff(first),
           "word_chars": row_sum(ta.WORD[buf] & ((buf & 0xC0) != 0x80)),
           "n_symbols": row_sum(SYMBOL[buf])}
    # lines with a word: the \n-split pieces that hold at least one word start
    breaks = np.flatnonzero(buf == 0x0A)
    line_start = np.union1d(offs[:-1], breaks + 1)
    line_start = line_start[line_start < len(buf)]
    line_end = np.append(line_start[1:], len(buf))
    line_row = np.searchsorted(offs, line_start, "right") - 1
    line_end = line_end - ((line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 0x0A))
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    key = ta.pair_hash(ta.span_hashes(buf, line_start, line_end), line_row.astype(np.uint64))
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    again = _repeats(key)
    _, one_each = np.unique(key[again], return_index=True)
    out["n_dup_lines"] = (np.bincount(line_row[again], minlength=rows)
                          - np.bincount(line_row[again][one_each], minlength=rows))
    # words inside an 8-word window that the same text holds twice
    grams, at = ta.ngram_hashes(ta.span_hashes(buf, starts, ends), first, 8)
    row = ta.row_of(first, len(starts))
    hit = at[_repeats(ta.pair_hash(grams, row[at].astype(np.uint64)))]
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + 8, -1)
    covered = np.cumsum(step)[:-1] > 0
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    return out


def measurements(docs: DataFrame) -> DataFrame:
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(*utf8(text_array(batch)))
        return pa.RecordBatch.from_arrays(
            [id_array(batch), *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], names=["doc_id", *MEASURES])

    return map_blocks(id_and_text(docs), SCHEMA, block)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``."""
    bits = sum((F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, failed) in enumerate(rules())), F.lit(0))
    return measurements(docs).withColumn("fail_bits", bits.cast("long"))


def failed(policy: str | int) -> Column:
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0


def apply_policy(book: DataFrame, policy: str | int) -> DataFrame:
    """The ledger with ``kept`` under one policy version."""
    return book.withColumn("kept", ~failed(policy))


def ablations(book: DataFrame, policy: str | int) -> DataFrame:
    """For each rule of a policy: documents it fails, documents only it fails (kept without it), and documents kept.

    The ledger is first counted per distinct bit pattern (at most 2**rules
    groups, combined map-side), so the rules are compared over that small table.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = (book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits"))
                .agg(F.count(F.lit(1)).alias("n")))
    table = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                                for i, name in enumerate(RULE_NAMES) if mask >> i & 1]))
    r = patterns.select("bits", "n", table.alias("r")).select("bits", "n", "r.*")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return r.groupBy("rule").agg(pick(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
                                 pick(F.col("bits") == F.col("bit")).alias("n_only"),
                                 pick(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
                                 pick(F.col("bits") == 0).alias("n_kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(read_table(spark, sf_dir, "documents")), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed("base").alias("base_failed"), "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM pos),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM
        (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
       OR word_chars < 2 * n_words OR word_chars > 30 * n_words) AS kept
FROM m
"""
