"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed in runs of ``GRAM``; of every ``WINDOW - GRAM + 1`` consecutive run hashes the least is the
fingerprint of the ``WINDOW`` words they span. Equal spans of ``WINDOW`` words have equal fingerprints, so a
document that shares any such span with an item shares a fingerprint: none is missed. Texts are split once,
into the distinct fingerprints of each, which are joined to the benchmark's. Only documents that share one
are looked at again: there each span is compared by the two run hashes that cover it (128 bits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import Scratch

WINDOW = 10
GRAM = 5
#: Rows of benchmark windows, or of keys of documents that share one, that are broadcast at most (some 100
#: bytes each); more are joined by shuffle, the benchmark's rows being copied to ``SALTS`` places, since one
#: passage may be in most documents.
BROADCAST_ROWS = 250_000
SALTS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none. Pure ASCII takes the cheaper lower()."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.filter(F.split(F.coalesce(low, F.lit("")), _BREAK), lambda w: w != "")


def _runs(words: Column, length: int) -> Column:
    """Hash of the ``length`` words from each position on; positions too near the end give garbage, cut by callers."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, length)]))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, w (words), n (their number). Keys are wrapped, so that null ones are equal to each other."""
    return _worded(df.select(F.struct(F.col(key).alias("v")).alias("key"), F.col(text).alias("text")))


def _worded(df: DataFrame) -> DataFrame:
    return df.select("key", words_of(F.col("text")).alias("w")).withColumn("n", F.size("w").cast("long"))


def _full(values: Column, length: int) -> Column:
    """The values at positions where ``length`` words begin. No filter on the number of words takes its place: one
    would move below joins, and all texts would be split for it."""
    return F.slice(values, F.lit(1), F.greatest(F.col("n").cast("int") - (length - 1), F.lit(0)))


def _short_print(w: Column, x: Column, i: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), x, *[F.get(w, i + k) for k in range(1, length)])


def _prints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, n, prints): the distinct fingerprints of a text, those of its short runs of these lengths included."""
    g, w = F.col("g"), F.col("w")
    least = F.transform(_full(g, WINDOW), lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, WINDOW - GRAM + 1)]))
    parts = [least]
    short = lambda n: F.transform(_full(w, n), lambda x, i: _short_print(w, x, i, n))
    parts += [short(n) for n in lengths]
    return rows.withColumn("g", _runs(w, GRAM)).select("key", "n", F.array_distinct(F.concat(*parts)).alias("prints"))


def _spans(rows: DataFrame) -> DataFrame:
    """(key, pos, len, fp, g1, g2): each full window's position, fingerprint and the two run hashes that cover it."""
    rows = rows.select("key", "n", _runs(F.col("w"), GRAM).alias("g"))
    g = F.col("g")
    span = F.transform(
        _full(g, WINDOW),
        lambda x, i: F.struct(F.least(x, *[F.get(g, i + k) for k in range(1, WINDOW - GRAM + 1)]).alias("fp"), x.alias("g1"), F.get(g, i + (WINDOW - GRAM)).alias("g2")),
    )
    exploded = rows.select("key", F.posexplode(span).alias("pos", "s"))
    return exploded.select("key", "pos", F.lit(WINDOW).alias("len"), "s.fp", "s.g1", "s.g2")


def _short(rows: DataFrame, length: int) -> DataFrame:
    """The same for each run of ``length`` words, for items that short. g1 and g2 are two hashes of it."""
    w = F.col("w")
    words = lambda x, i: [x, *[F.get(w, i + k) for k in range(1, length)]]
    runs = F.transform(
        _full(w, length),
        lambda x, i: F.struct(_short_print(w, x, i, length).alias("fp"), F.xxhash64(*words(x, i)).alias("g1"), F.hash(*words(x, i)).cast("long").alias("g2")),
    )
    return rows.select("key", F.posexplode(runs).alias("pos", "s")).select("key", "pos", F.lit(length).alias("len"), "s.fp", "s.g1", "s.g2")


def _all_spans(rows: DataFrame, lengths: list[int]) -> DataFrame:
    out = _spans(rows)
    for n in lengths:
        out = out.union(_short(rows, n))
    return out


def _matched(left: DataFrame, windows: DataFrame, on: list[str], small: bool, how: str = "inner") -> DataFrame:
    """Rows of documents joined to rows of the benchmark, which are broadcast or copied to salted places."""
    if small:
        return left.join(F.broadcast(windows), on, how)
    salted = left.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    copied = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copied, [*on, "salt"], how).drop("salt")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window, and the items these belong to.

    A window is 10 consecutive words of an item, or all of a shorter item. A null or empty text has no words;
    items without words or with a null id have no windows. Rows that repeat a key, null or not, share its
    hits, taken over all their texts (their words are counted row by row). An empty benchmark leaves all
    documents clean. Other columns are not read, whatever their names. Returns key, n_words, n_hit, n_items,
    items_sha256 (of the sorted, comma-joined item ids; of the empty string without any), contaminated.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = _keyed(benchmark.where(F.col(item).isNotNull()), item, item_text)
    lengths = sorted(int(r[0]) for r in items.where((F.col("n") > 0) & (F.col("n") < WINDOW)).select("n").distinct().collect())  # at most 9
    full = _spans(items)
    for n in lengths:
        full = full.union(_short(items.where(F.col("n") == n), n))
    full = scratch.put(full.select("len", "fp", "g1", "g2", F.col("key.v").alias("item")).distinct(), "item_windows")
    windows = scratch.put(full.select("len", "fp", "g1", "g2").distinct(), "windows")
    small = full.count() <= BROADCAST_ROWS

    rows = _keyed(docs, key, text)
    prints = scratch.put(_prints(rows, lengths), "prints")
    shared = _matched(prints.select("key", F.explode("prints").alias("fp")), windows.select("fp").distinct(), ["fp"], small, "left_semi")
    shared = scratch.put(shared.select("key").distinct(), "shared")
    few = shared.count() <= BROADCAST_ROWS
    texts = docs.select(F.struct(F.col(key).alias("v")).alias("key"), F.col(text).alias("text"))
    suspects = _worded(texts.join(F.broadcast(shared) if few else shared, "key", "left_semi"))  # split after the join
    hits = _matched(_all_spans(suspects, lengths), windows, ["len", "fp", "g1", "g2"], small).select("key", "pos", "len", "fp", "g1", "g2")
    hits = scratch.put(hits, "hits")

    # Words hit: positions covered by any hit, each counted once per document.
    covered = hits.select("key", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("at")).distinct()
    n_hit = scratch.put(covered.groupBy("key").agg(F.count("*").alias("n_hit")), "n_hit")
    by_item = _matched(hits.drop("pos").distinct(), full, ["len", "fp", "g1", "g2"], small)
    listed = by_item.select("key", F.col("item").cast("string").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    found = scratch.put(listed.join(n_hit, "key").select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256")), "found")

    out = prints.select("key", F.col("n").alias("n_words")).join(F.broadcast(found) if few else found, "key", "left").select(
        F.col("key.v").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
    result = scratch.put(out, "result")
    scratch.close("result")
    return result
