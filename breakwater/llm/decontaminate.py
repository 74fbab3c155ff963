"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.llm.common import write_table

#: Tokens of a compared window, and the share of them that must be equal.
OVERLAP, SHARE = 16, 0.8
#: Fixed masks: a 0 ignores the token at its place. Whichever three of a window's 16 tokens are
#: substituted, one of the first masks fits between them; the second ones do the same for items of
#: SHORT to 15 tokens (up to three of 15, two of fewer). Shorter items must be there word for word.
MASKS = ("11001001011", "1011111", "1110111")
SHORT_MASKS = ("11110001", "1001100101", "1100010011")
SHORT = 12
#: Items are cut into pieces that start STEP tokens apart, so that no row holds a long item.
STEP = 48
#: Likewise documents, for which this bounds what each window's row copies.
DOC_STEP = 64
#: Rows of benchmark seeds (about 300 bytes each) that one broadcast holds; more go in several blocks.
BLOCK = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _places(mask: str) -> list[int]:
    return [i for i, bit in enumerate(mask) if bit == "1"]


def _seeds(masks: list[str], tokens: str, at: Column) -> Column:
    """Array of each mask's hash of the tokens at a position; null where the mask goes past the end."""
    size = F.size(tokens)
    return F.array(*[F.when(at + len(m) <= size, F.xxhash64(F.lit(m), *[F.get(tokens, at + p) for p in _places(m)])) for m in masks])


def benchmark_seeds(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``seed, around, off, wide, items`` for every window of every item, and the masks in use.

    ``around`` holds the item's tokens that any compared window over the seed can hold, the
    seed starts at ``off`` in it, and windows are ``wide`` tokens. Seeds that agree in all of
    these stand for the same comparison, so they are one row with the ids of all their items.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("all"))
    items = items.select("item_id", "all", F.size("all").alias("n")).where("n > 0")
    lengths = sorted(r[0] for r in items.select("n").where(f"n < {OVERLAP}").distinct().collect())
    masks = [*MASKS, *(SHORT_MASKS if any(n >= SHORT for n in lengths) else ()), *("1" * n for n in lengths if n < SHORT)]
    cut = items.withColumn("first", F.explode(F.expr(f"sequence(0, n - 1, {STEP})")))
    base = F.greatest(F.lit(0), F.col("first") - OVERLAP)
    pieces = cut.select("item_id", "n", "first", base.alias("base"), F.slice("all", base + 1, STEP + 3 * OVERLAP).alias("piece"))
    at = pieces.select("item_id", "n", "base", "piece", F.explode(F.expr(f"sequence(first, least(first + {STEP}, n) - 1)")).alias("q"))
    seeds = at.select("*", F.posexplode(_seeds(masks, "piece", F.col("q") - F.col("base"))).alias("mask", "seed")).where("seed is not null")
    span = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)
    spaced, short = F.col("mask") < len(MASKS), F.col("mask") < len(MASKS) + len(SHORT_MASKS)
    fits = F.when(F.col("n") >= OVERLAP, spaced).when(F.col("n") >= SHORT, ~spaced & short).otherwise(span == F.col("n"))
    if len(masks) == len(MASKS):
        fits = spaced
    wide = F.least(F.col("n"), F.lit(OVERLAP))
    low, high = F.greatest(F.lit(0), F.col("q") + span - wide), F.least(F.col("n"), F.col("q") + wide)
    rows = seeds.where(fits).select("seed", F.slice("piece", low - F.col("base") + 1, high - low).alias("around"), (F.col("q") - low).alias("off"), wide.alias("wide"), "item_id")
    return rows.groupBy("seed", "around", "off", "wide").agg(F.array_distinct(F.collect_list(F.struct("item_id"))).alias("items")), masks


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, compared, similarity`` of each document that holds benchmark text.

    A document holds an item if, on some alignment, some ``OVERLAP`` tokens of the item in a row
    (all of a shorter item) agree with the document's in a share of ``SHARE`` at least, items under
    ``SHORT`` tokens in all. ``compared`` is the size of such a window and ``matched`` the largest
    number of equal tokens. Test and training windows join on the hash of the tokens that a mask
    keeps, and every window over a hit is compared; the masks miss none. Documents are never
    shuffled: the benchmark's seeds are broadcast, at most ``BLOCK`` rows at a time; if they
    take several blocks, the tokens are written once and read for each.

    Null and empty texts, and items without a token, match nothing; repeated rows count
    once; a null doc_id or item_id is a group of its own; empty tables give an empty
    result; other columns are not read.
    """
    found, masks = benchmark_seeds(benchmark, item_col, item_text_col)
    seeds, _ = write_table(found, "seeds")
    blocks = max(1, -(-seeds.count() // BLOCK))
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("tokens"))
    if blocks > 1:
        tokens, _ = write_table(tokens, "tokens")
    # Rows carry a piece of the document, never the whole one, so work is linear in its length.
    cut = tokens.select("doc_id", "tokens", F.size("tokens").alias("n"), F.explode(F.expr(f"sequence(0, size(tokens), {DOC_STEP})")).alias("first")).where("first < n")
    base = F.greatest(F.lit(0), F.col("first") - OVERLAP)
    pieces = cut.select("doc_id", "n", "first", base.alias("base"), F.slice("tokens", base + 1, DOC_STEP + 2 * OVERLAP).alias("piece"))
    at = pieces.select("doc_id", "piece", "base", F.explode(F.expr(f"sequence(first - base, least(first + {DOC_STEP}, n) - 1 - base)")).alias("p"))
    windows = at.select("doc_id", "piece", "p", F.explode(_seeds(masks, "piece", F.col("p"))).alias("seed")).where("seed is not null")

    def search(block: DataFrame) -> DataFrame:
        hits = windows.join(F.broadcast(block), "seed")
        equal = F.transform("around", lambda x, k: F.coalesce(F.get("piece", F.col("p") - F.col("off") + k) == x, F.lit(False)).cast("int"))
        counts = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - F.col("wide")), lambda s: F.aggregate(F.slice(e, s + 1, F.col("wide")), F.lit(0), lambda n, x: n + x))
        most = F.array_max(F.flatten(F.transform(F.array(equal), counts)))  # the equal tokens computed once for all windows
        enough = F.when(F.col("compared") < SHORT, F.col("matched") == F.col("compared")).otherwise(F.col("matched") >= SHARE * F.col("compared"))
        return hits.select("doc_id", "items", F.col("wide").alias("compared"), most.alias("matched")).where(enough)

    block_of = F.pmod(F.xxhash64("seed", "around"), F.lit(blocks))
    every = reduce(DataFrame.union, [search(seeds.where(block_of == k)) for k in range(blocks)])
    best = every.select("doc_id", F.explode("items").alias("item"), "compared", "matched").select("doc_id", "item.item_id", "compared", "matched")
    return best.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared"), F.max(F.col("matched") / F.col("compared")).alias("similarity"))


#: Ids of contaminated documents that may be broadcast to drop them.
BROADCAST_IDS = 500_000


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` returns; a null doc_id stays."""
    bad, _ = write_table(contaminated(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def oracle_sql() -> str:
    """The same result in DuckDB's SQL, found without masks.

    Of 16 tokens with three substituted (12 to 14 with two) four in a row are left, of 15 with
    three, three; so alignments with such a run are compared in all their windows.
    """
    words_sql = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    run = "concat_ws(' ', {0}[i + 1], {0}[i + 2], {0}[i + 3]{1})"
    last = {4: ", {0}[i + 4]", 3: ""}
    key = lambda name, k: run.format(name, last[k].format(name))
    hits = " UNION ".join(
        f"SELECT DISTINCT r, t, x.i - y.i AS shift FROM (SELECT r, i, {key('w', k)} AS s FROM (SELECT r, w, unnest(range(len(w) - {k - 1})) AS i FROM d)) x JOIN (SELECT t, i, {key('w', k)} AS s FROM (SELECT t, w, unnest(range(len(w) - {k - 1})) AS i FROM b WHERE len(w) >= {SHORT} AND (len(w) = 15) = {k == 3})) y USING (s)"
        for k in (4, 3)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words_sql.format('text')} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS t, item_id, {words_sql.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
hits AS ({hits}),
e AS (SELECT doc_id, item_id, least(len(b.w), {OVERLAP}) AS c, list_transform(range(len(b.w)), lambda k: CASE WHEN k + shift >= 0 AND d.w[k + shift + 1] = b.w[k + 1] THEN 1 ELSE 0 END) AS e FROM hits JOIN d USING (r) JOIN b USING (t)),
v AS (SELECT doc_id, item_id, c, list_max(list_transform(range(len(e) - c + 1), lambda s: list_sum(e[s + 1 : s + c]))) AS m FROM e
  UNION ALL SELECT doc_id, item_id, len(b.w), len(b.w) FROM d, b WHERE len(b.w) BETWEEN 1 AND {SHORT - 1} AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
SELECT doc_id, item_id, CAST(max(m) AS BIGINT) AS matched, CAST(max(c) AS BIGINT) AS compared, max(m / c) AS similarity
FROM v WHERE m >= {SHARE} * c GROUP BY doc_id, item_id"""
