"""Operator 9: benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is the set of its windows of ``WINDOW`` consecutive words (an item of
fewer words is one window). A document holds a window exactly or not at all, so
the necessary prefix of a window under any order of its words is one word; the
order is by rarity over all documents.

1. Count the benchmark's words in the documents. A window with a word that no
   document has cannot occur.
2. Each other window is represented by its rarest word. One pass over the texts
   keeps, at every position of such a word, the words around it.
3. These contexts are joined with the windows on that word, under the positional
   bound (the window must start inside the text) and the length bound (it must end
   inside it), and the window's words are compared exactly.

Benchmarks are read in blocks of at most ``BLOCK_WINDOWS`` windows, so the word
lists and the broadcast windows have a proven bound; more windows mean more passes,
over a table of the texts whose rows are numbered once.

Defined results: null and empty texts have 0 words, no hits, and the hash of the
empty string; null or wordless items, and items without an id, have no windows;
repeated documents are judged each on their own, repeated items count once; an
empty benchmark marks nothing; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import id_and_text, materialize, read_table

WINDOW = 10
BLOCK_WINDOWS = 20_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words of a text column: ASCII letters (lower-cased), digits and non-ASCII characters."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (w, an array of words) and the items that hold them."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words("text").alias("ws"))
    at = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    return (items.where(F.size("ws") > 0).select("item", "ws", F.explode(at).alias("i"))
            .select("item", F.slice("ws", F.col("i"), F.lit(size)).alias("w"))
            .groupBy("w").agg(F.collect_set("item").alias("items")))


def one_of(found: list[str], name: str) -> str:
    """SQL test of membership; words hold no quote or backslash, which are separators."""
    return f"{name} IN ({', '.join(repr_sql(w) for w in found)})" if found else "false"


def repr_sql(word: str) -> str:
    return f"'{word}'"


def prefix_words(texts: DataFrame, wins: DataFrame) -> DataFrame:
    """w, items, the rarest word of each window over all texts, and its place; windows that cannot occur are left out."""
    vocabulary = [r["word"] for r in wins.select(F.explode("w").alias("word")).distinct().collect()]  # at most WINDOW * BLOCK_WINDOWS
    known = F.expr(f"filter(ws, x -> {one_of(vocabulary, 'x')})")
    counts = texts.select(F.explode(known).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    placed = wins.select("w", "items", F.posexplode("w").alias("place", "word")).join(counts, "word", "left")
    return (placed.groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("r"), F.first("items").alias("items"))
            .where("r.n > 0").select("w", "items", F.col("r.word").alias("word"), F.col("r.place").alias("place")))


def contexts(texts: DataFrame, prefix: list[str], size: int) -> DataFrame:
    """Each text with the contexts of its prefix words: position, words from ``lead`` before it on."""
    near = size - 1
    return texts.withColumn("found", F.expr(f"""
        transform(filter(transform(ws, (x, i) -> if({one_of(prefix, 'x')}, i, -1)), i -> i >= 0),
                  i -> struct(i AS at, least(i, {near}) AS lead, ws[i] AS word, slice(ws, i - least(i, {near}) + 1, least(i, {near}) + {size}) AS context))"""))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id, n_words; hits: row, first, last, items), written in the shared folder."""
    wins = materialize(windows(benchmark, size).withColumn("h", F.xxhash64("w")), "windows")
    blocks = max(1, -(-wins.count() // BLOCK_WINDOWS))
    texts = id_and_text(docs).select("doc_id", words("text").alias("ws"))
    number = F.monotonically_increasing_id()
    if blocks > 1:
        # another scan of the input may number its rows otherwise
        texts, number = materialize(texts.withColumn("row", number), "texts"), F.col("row")
    rows, hits = None, None
    for k in range(blocks):
        chosen = materialize(prefix_words(texts, wins.where(F.pmod("h", F.lit(blocks)) == k)), "prefixes")
        prefix = [r["word"] for r in chosen.select("word").distinct().collect()]  # at most BLOCK_WINDOWS
        stored = materialize(contexts(texts, prefix, size).select(
            number.alias("row"), "doc_id", F.size("ws").cast("long").alias("n_words"), "found"), "contexts")
        c = stored.select("row", F.explode("found").alias("f")).select("row", "f.*")
        # at most BLOCK_WINDOWS windows of WINDOW words
        met = c.join(F.broadcast(chosen), "word").where(
            (F.col("place") <= F.col("lead")) & (F.col("lead") - F.col("place") + F.size("w") <= F.size("context")))
        met = met.where(F.slice("context", F.col("lead") - F.col("place") + 1, F.size("w")) == F.col("w"))
        met = met.select("row", (F.col("at") - F.col("place")).alias("first"), (F.col("at") - F.col("place") + F.size("w")).alias("last"), "items")
        rows = rows or stored.select("row", "doc_id", "n_words")
        hits = met if hits is None else hits.unionAll(met)
    return rows, hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every whole text."""
    rows, hits = occurrences(docs, benchmark, size)
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("""aggregate(spans, named_struct('n', 0L, 'to', 0), (a, s) -> named_struct(
        'n', a.n + greatest(0, s.last - greatest(s.first, a.to)), 'to', greatest(a.to, s.last)), a -> a.n)""")
    found = found.select("row", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("listed"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), '" + string.ascii_uppercase + "', '" + string.ascii_lowercase
          + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0 AND item_id IS NOT NULL)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
         FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, p, gram.n, item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
