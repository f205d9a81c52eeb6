"""Benchmark passages in documents, by a prefix-filtered join with DataFrame functions only.

An item is cut into windows of consecutive words, and a window into shingles. All shingles of the items are ordered by how
often they occur in the documents. A document window that agrees with an item window in ``need`` of its ``m`` shingles
holds at least one of any ``m - need + 1`` of them, so only that many, the rarest, are joined (one, when the
whole window must occur). A match gives the place where the document window would start; it is left out where the document has no room
for the window before or behind it (position and length), and its words are compared one by one.

Documents are cut into chunks of a fixed number of words, each with the words that a window may need behind it, so a very long
text is many small rows. While the windows are few they go to every task and matches are confirmed where they are found: no text is
shuffled. Beyond that bound, matches are joined by shingle, salted, and confirmed against the chunks.
"""
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.llm.common import cut_lineage, fresh, whole_text

#: Words of an item window, of a shingle and of a document chunk.
WINDOW, SHINGLE, CHUNK = 10, 3, 256
#: Window shingles that go to every task (about 300 bytes each, 30 MB); with more the join shuffles.
MAX_SHIPPED = 100_000
#: Shares of a shingle in the shuffled join.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII other than digits and letters.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), PARTING), "")


def _exploded(df: DataFrame, keep: list, sizes: list[int]) -> DataFrame:
    """``keep`` with p and t: place and hash of each shingle of ``words``, for all asked sizes."""
    shifted = [F.col("words").alias("a")] + [F.slice("words", F.lit(j + 1), F.greatest(F.size("words"), F.lit(1))).alias("abc"[j]) for j in range(1, max(sizes, default=1))]
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("p", "z"))
    hashes = {k: F.xxhash64(*[F.col(f"z.{c}") for c in "abc"[:k]]) for k in sizes}
    if len(sizes) == 1:
        return rows.filter(F.col(f"z.{'abc'[sizes[0] - 1]}").isNotNull()).select(*keep, "p", hashes[sizes[0]].alias("t"))
    every = F.array(*[F.when(F.col(f"z.{'abc'[k - 1]}").isNotNull(), hashes[k]) for k in sizes]) if sizes else F.array().cast("array<bigint>")
    return rows.select(*keep, "p", F.explode(every).alias("t")).filter("t IS NOT NULL")


def _parsed(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """doc (the id), key (a hash of the text), words. Rows that agree in both have the same result."""
    text = whole_text()
    return docs.select(F.col(column).alias("doc"), F.xxhash64(text).alias("key"), words_of(text).alias("words"))


def _chunks(docs: DataFrame, reach: int) -> DataFrame:
    """doc, key, base (place of the first word), words: chunks with ``reach`` words of the next."""
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(CHUNK))
    cut = F.transform(starts, lambda b: F.struct(b.alias("base"), F.slice("words", b + 1, F.lit(CHUNK + reach)).alias("words")))
    return _parsed(docs).select("doc", "key", F.explode(F.when(F.size("words") > 0, cut)).alias("c")).select("doc", "key", "c.base", "c.words")


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (w, words, n, k: shingle size) and their members (w, item). A shorter item is one window, one without words none."""
    parsed = _parsed(items, "item_id").filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = parsed.select(F.col("doc").alias("item"), F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, F.lit(window)))).alias("words"))
    cut = cut_lineage(cut.distinct(), "item_windows")
    windows = cut.select("words").distinct().select(F.monotonically_increasing_id().alias("w"), "words", F.size("words").alias("n"),
                                                    F.least(F.size("words"), F.lit(SHINGLE)).alias("k"))
    windows = cut_lineage(windows, "windows")
    return windows, cut.join(windows.select("w", "words"), "words").select("w", "item")


def _prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int], share: float) -> DataFrame:
    """w, window, n, k, m, need and one of its rarest shingles with its offset: as many rows a window as its prefix takes."""
    own = [_exploded(windows.filter(F.col("k") == k), ["w"], [k]).withColumnRenamed("p", "o") for k in sizes]
    parts = cut_lineage(functools.reduce(DataFrame.unionByName, own), "window_shingles")
    counts = _exploded(_parsed(docs), [], sizes).join(parts.select("t").distinct(), "t").groupBy("t").agg(F.count("*").alias("c"))
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "o", "t")))
    ranked = (parts.join(counts, "t", "left").groupBy("w").agg(order.alias("order")).withColumn("m", F.size("order"))
              .withColumn("need", F.greatest(F.ceil(F.lit(float(share)) * F.col("m")), F.lit(1)).cast("int")))
    first = ranked.select("w", "m", "need", F.explode(F.slice("order", F.lit(1), F.col("m") - F.col("need") + 1)).alias("s"))
    return first.select("w", "m", "need", F.col("s.o").alias("o"), F.col("s.t").alias("t")).join(windows.withColumnRenamed("words", "window"), "w")


def _confirmed(share: float):
    """Does the window stand at ``start`` of the chunk ``words``?"""
    if share >= 1:
        return F.slice("words", F.col("start") + 1, F.col("n")) == F.col("window")
    same = F.filter(F.sequence(F.lit(0), F.col("m") - 1),
                    lambda i: F.slice("words", F.col("start") + i + 1, F.col("k")) == F.slice("window", i + 1, F.col("k")))
    return F.size(same) >= F.col("need")


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, share: float = 1.0, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """doc, key, at, n, w: windows that stand in a document from word ``at`` on. Rows may repeat."""
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect()) or [SHINGLE]          # of 1, 2, 3
    prefix = cut_lineage(_prefixes(docs, windows, sizes, share).withColumnRenamed("t", "rare"), "prefixes")
    chunks = _chunks(docs, window - 1).withColumn("room", F.size("words"))
    start = (F.col("p") - F.col("o")).alias("start")
    fits = (F.col("start") >= 0) & (F.col("start") < CHUNK) & (F.col("start") + F.col("n") <= F.col("room"))
    if prefix.count() <= max_shipped:
        met = _exploded(chunks, ["doc", "key", "base", "words", "room"], sizes).join(F.broadcast(prefix), F.col("t") == F.col("rare"))
        met = met.select("*", start).filter(fits).filter(_confirmed(share))
    else:
        salted = _exploded(chunks, ["doc", "key", "base", "room"], sizes).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
        spread = prefix.select("rare", "o", "w", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
        found = salted.join(spread, (F.col("t") == F.col("rare")) & (F.col("salt") == F.col("salt2"))).select("*", start).filter(fits)
        found = found.select(F.col("doc").alias("doc2"), F.col("key").alias("key2"), F.col("base").alias("base2"), "start", "w").distinct()
        found = found.join(prefix.select("w", "window", "n", "k", "m", "need").dropDuplicates(["w"]), "w")
        met = chunks.join(found, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("key") == F.col("key2")) & (F.col("base") == F.col("base2")))
        met = met.filter(_confirmed(share))
    return met.select("doc", "key", (F.col("base") + F.col("start")).alias("at"), "n", "w")


def _blocks(hits: DataFrame) -> DataFrame:
    """doc, key, block of 64 words, mask of its words that are hit, ws: windows that start or go on in it."""
    last = F.col("at") + F.col("n")
    pieces = hits.select("doc", "key", "w", "at", last.alias("end"), F.explode(F.sequence(F.floor(F.col("at") / 64), F.floor((last - 1) / 64))).alias("block"))
    low, high = F.greatest(F.col("at") - 64 * F.col("block"), F.lit(0)).cast("int"), F.least(F.col("end") - 64 * F.col("block"), F.lit(64)).cast("int")

    def below(n):                                                    # the n lowest bits
        return F.when(n >= 64, F.lit(-1).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n)))

    mask = below(high).bitwiseAND(F.bitwise_not(below(low)))
    return pieces.groupBy("doc", "key", "block").agg(F.bit_or(mask).alias("mask"), F.collect_set("w").alias("ws"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 1.0, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurring item window), items (their item_ids as strings, sorted), one row per row of ``docs``.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. With ``share`` below 1 a window occurs where so much of its
    shingles agrees place by place. A null or empty text has no words. Repeated rows and rows of one doc_id get the result of their own text, rows without a doc_id
    too. Rows of ``items`` that repeat an item_id are one item with the windows of all; a row without an item_id counts for n_hit and is not listed. Texts of any
    length are cut into chunks of 256 words. With empty tables nothing is hit. Equal (doc_id, text) are recognised by a 64-bit hash of the text.
    """
    windows, members = item_windows(items, window)
    blocks = cut_lineage(_blocks(occurrences(docs, windows, window, share, max_shipped)), "hits")
    words = blocks.groupBy("doc", "key").agg(F.sum(F.bit_count("mask")).cast("long").alias("n_hit"))
    listed = (blocks.select("doc", "key", F.explode("ws").alias("w")).distinct().join(members.filter("item IS NOT NULL"), "w")
              .groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items")))
    found = (words.join(listed.withColumnsRenamed({"doc": "doc3", "key": "key3"}), F.col("doc").eqNullSafe(F.col("doc3")) & (F.col("key") == F.col("key3")), "left")
             .select(F.col("doc").alias("doc2"), F.col("key").alias("key2"), "n_hit", "items"))
    rows = _parsed(docs).select("doc", "key", F.size("words").cast("long").alias("n_words"))
    return (rows.join(found, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("key") == F.col("key2")), "left")
            .select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 1.0) -> DataFrame:
    """``docs`` without the rows whose text holds an item window; all columns stay, rows without a doc_id are treated alike."""
    windows, _ = item_windows(items, window)
    gone, key = fresh(docs, "_doc"), fresh(docs, "_key")
    hit = occurrences(docs, windows, window, share).select(F.col("doc").alias(gone), F.col("key").alias(key)).distinct()
    hit = cut_lineage(hit, "contaminated")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[gone]) & (F.xxhash64(whole_text()) == hit[key]), "left_anti")
