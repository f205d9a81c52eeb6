"""Personal data and the terms that give it away, with DataFrame functions only.

Four patterns find the protected entities. The terms (letters only) of the whole texts that hold them are weighed by what
the corpus says: with n(e) texts holding an entity, n(t) a term and n(e, t) both, the pointwise mutual
information log2(n(e, t) N / (n(e) n(t))) says how much of the entity's information log2(N / n(e)) the term
reveals. Terms that reveal more than a share of it are generalised, those that identify the entity fully are removed.

Counts are of all documents, and every entity is weighed, also one of a single text. A pair that only a few distinct texts show is thin evidence, however many
copies they have: with m texts the conditional probability n(e, t) / n(t) is smoothed to m / (m + 1) of itself. Every occurrence of such a term in a text of the entity is a span.

Entities that stand in the same texts have equal counts and are one. Terms too common for any entity leave before they meet one, so pairs stay in
proportion to the rare words of the texts with entities; of the other texts only word counts are kept.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loadtide.llm.common import cut_lineage, fresh, whole_text

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns without retries: possessive, and started only where a run of their first characters starts or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text may hold a match.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
DIGIT_RUN = r"[0-9](?:[\x20-]?[0-9]){12}"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL = "[TERM]"
#: A term in more than this share of the documents, and too common for any entity, leaves by a short list.
COMMON = 0.001
#: Texts from which on a pair's counts stand as they are (with fewer they are smoothed), the share of the entity's information that is disclosure, and the share that identifies.
LEAST_TEXTS, DISCLOSED, IDENTIFIED = 3, 0.8, 0.999
OUTER = ".,;:!?\"'()[]{}<>"


def text_key() -> list[Column]:
    """Two hashes and the length of a whole text stand for it."""
    t = whole_text()
    return [F.xxhash64(t).alias("h"), F.crc32(t).alias("c"), F.length(t).alias("chars")]


KEY = ["h", "c", "chars"]


def _valid(kind, m) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) == 0, 0).when(F.length(p) <= 3, p.cast("int")).otherwise(999) <= 255))
    rev = F.reverse(digits)
    doubled = F.transform(F.split(rev, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    luhn = F.aggregate(F.filter(doubled, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn).otherwise(False))
            .when(kind == "phone", F.length(digits).between(9, 15)))


def _hint(kind: str, t: Column) -> Column:
    return t.rlike(DIGIT_RUN) if kind == "card" else t.rlike(r"[0-9]\.[0-9]++\.[0-9]") if kind == "ip" else t.contains(HINTS[kind])


def mentions(docs: DataFrame) -> DataFrame:
    """h, c, chars, kind, start, stop, value, copies: a row for each valid match in each distinct text.

    A pattern's matches and the gaps between them are cut out side by side; a running sum of their lengths gives the places.
    """
    t = F.col("text")
    found = []
    for kind, pattern in PATTERNS.items():
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("gap"))
        found.append(F.struct(F.lit(kind).alias("kind"), F.when(_hint(kind, t), pairs).alias("pairs")))
    keyed = docs.select(whole_text().alias("text"), *text_key())
    rows = (keyed.select(*KEY, F.inline(F.array(*found))).filter("pairs IS NOT NULL").select(*KEY, "kind", F.posexplode("pairs").alias("i", "p"))
            .select(*KEY, "kind", "i", F.col("p.m").alias("m"), F.length("p.gap").alias("gap"))
            .filter("m IS NOT NULL OR i > 0").groupBy(*KEY, "kind", "i", "m", "gap").agg(F.count("*").alias("copies")))
    w = W.partitionBy(*KEY, "kind").orderBy("i")
    stop = F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    placed = (rows.withColumn("stop", stop.cast("int")).filter("m IS NOT NULL").filter(_valid(F.col("kind"), F.col("m"))))
    value = F.when(F.col("kind") == "email", F.lower("m")).when(F.col("kind") == "ip", F.col("m")).otherwise(F.regexp_replace("m", "[^0-9]", ""))
    return placed.select(*KEY, "kind", (F.col("stop") - F.length("m")).alias("start"), "stop", F.concat_ws(":", "kind", value).alias("value"), "copies")


def _contexts(found: DataFrame) -> DataFrame:
    """h, c, chars, copies, value, n_e: the texts that hold each entity and how many documents do; of entities of the same texts the smallest stands for all."""
    held = found.select("value", "copies", *KEY).distinct()
    same = [F.count("*").alias("texts"), F.bit_xor(F.xxhash64(*KEY)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *KEY)).alias("y"), F.sum("copies").cast("double").alias("n_e")]
    classes = held.groupBy("value").agg(*same).groupBy("texts", "x", "y", "n_e").agg(F.min("value").alias("value"))
    return held.join(classes.select("value", "n_e"), "value")


def _word(token) -> Column:
    return F.lower(F.btrim(token, F.lit(OUTER)))


def _terms(text) -> Column:
    """The distinct terms of a text."""
    words = F.transform(F.array_distinct(F.split(text, r"\s+")), _word)
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{L}{3,}$")))


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """text, h, c, chars of the documents whose text is one of ``keys``; only texts that may hold a mention are looked up."""
    t = whole_text()
    hint = F.lit(False)
    for kind in PATTERNS:
        hint = hint | _hint(kind, t)
    return docs.filter(hint).select(t.alias("text"), *text_key()).join(keys.select(*KEY).distinct(), KEY, "left_semi")


def _pairs(docs: DataFrame, contexts: DataFrame, disclosed: float) -> tuple[DataFrame, float]:
    """h, c, chars, copies, value, n_e, term, n_t: entities and the terms of their texts that are rare enough to reach the share; and the number of documents.

    n(e, t) is n(e) at most, so no term in more than n(e) (N / n(e)) ^ (1 - share) documents reaches it.
    """
    total = float(docs.count())
    contexts = contexts.filter(F.col("n_e") < total).withColumn("most", F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - disclosed)) * (1 + 1e-9))
    most = contexts.agg(F.max("most")).first()[0] or 0.0
    counts = cut_lineage(docs.select(F.explode(_terms(whole_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    # At most 1 / COMMON times the mean number of a text's terms, so the list stays short.
    common = counts.filter(F.col("n_t") > max(most, COMMON * total)).select("term")
    rare = counts.filter(F.col("n_t") <= most)
    terms = _texts(docs, contexts).select(*KEY, F.explode(_terms(F.col("text"))).alias("term")).join(F.broadcast(common), "term", "left_anti").distinct()
    pairs = terms.join(rare, "term").join(contexts, KEY).filter("n_t <= most").drop("most")
    return cut_lineage(pairs, "pairs"), total


def _shares(pairs: DataFrame, total: float, least_texts: int, disclosed: float) -> DataFrame:
    joint = pairs.groupBy("value", "n_e", "term", "n_t").agg(F.count("*").alias("texts"), F.sum("copies").cast("double").alias("n_et"))
    thin = F.col("texts") < least_texts
    known = F.when(thin, F.col("texts") / (F.col("texts") + 1)).otherwise(1.0)
    share = F.log2(known * F.col("n_et") * F.lit(total) / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(total) / F.col("n_e"))
    return (joint.withColumn("share", share).filter(F.col("share") >= F.when(thin, max(disclosed, DISCLOSED)).otherwise(disclosed))
            .select("value", "term", "share"))


def disclosing_terms(docs: DataFrame, found: DataFrame, contexts: DataFrame, least_texts: int = LEAST_TEXTS, disclosed: float = DISCLOSED) -> DataFrame:
    """value, term, share: how much of the entity's information the term reveals, for those above the threshold.

    The smoothed share of a pair with under ``least_texts`` texts must reach DISCLOSED at least; it never identifies. Of an entity of one text that takes 32 documents.
    """
    return _shares(*_pairs(docs, contexts, disclosed), least_texts, disclosed)


def _places(texts: DataFrame) -> DataFrame:
    """h, c, chars, term, start, stop: every place of a term in each distinct text."""
    # Words with the blanks before them, in order; the running length gives each one's place.
    words = F.regexp_extract_all("text", F.lit(r"\s*+\S++"), F.lit(0))
    rows = texts.select(*KEY, F.posexplode(words).alias("i", "token")).distinct()
    stop = F.sum(F.length("token")).over(W.partitionBy(*KEY).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    token = F.regexp_replace("token", r"^\s+", "")
    lead = F.length(token) - F.length(F.ltrim(token, F.lit(OUTER)))
    start = (F.col("end") - F.length(token) + lead).cast("int")
    return (rows.withColumn("end", stop).withColumn("term", _word(token)).filter(F.col("term").rlike(r"^\p{L}{3,}$"))
            .select(*KEY, "term", start.alias("start"), (start + F.length(F.btrim(token, F.lit(OUTER)))).cast("int").alias("stop")))


def spans(docs: DataFrame, least_texts: int = LEAST_TEXTS, disclosed: float = DISCLOSED) -> DataFrame:
    """h, c, chars, kind, start, stop, mask: all spans of each distinct text (code points, stop exclusive)."""
    found = cut_lineage(mentions(docs), "mentions")
    pairs, total = _pairs(docs, cut_lineage(_contexts(found), "contexts"), disclosed)
    terms = _shares(pairs, total, least_texts, disclosed)
    # Back to the pairs of a text, not to all texts of the entity: their number stays that of the pairs.
    told = cut_lineage(pairs.join(terms, ["value", "term"]).groupBy(*KEY, "term").agg(F.max("share").alias("share")), "told")
    mask = F.when(F.col("share") >= IDENTIFIED, F.lit("")).otherwise(F.lit(GENERAL))
    term_spans = _places(_texts(docs, told)).join(told, [*KEY, "term"]).select(*KEY, F.lit("term").alias("kind"), "start", "stop", mask.alias("mask"))
    masks = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])
    base = found.select(*KEY, "kind", "start", "stop", masks[F.col("kind")].alias("mask"))
    return base.unionByName(term_spans)


def find_personal_data(docs: DataFrame, least_texts: int = LEAST_TEXTS, disclosed: float = DISCLOSED) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base (spans of the four patterns), spans (all), one row per row of ``docs``.

    Spans are ``kind:start:end``, by kind in the order of KINDS, then by start. ``docs`` needs doc_id and text; other columns are
    ignored. A null text is empty. Repeated rows get equal results; a null doc_id is kept.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(rank.alias("rank"), "start", "stop", "kind")
    per_text = (spans(docs, least_texts, disclosed).groupBy(*KEY)
                .agg(F.sort_array(F.collect_list(item)).alias("items")))
    per_text = cut_lineage(per_text, "spans")
    written = F.transform("items", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    base = F.filter(F.col("items"), lambda s: s["kind"] != "term")
    joined = docs.select("doc_id", *text_key()).join(per_text, KEY, "left")
    count = lambda k: F.coalesce(F.size(F.filter(F.col("items"), lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    counted = joined.withColumn("items", F.coalesce("items", F.array().cast(dict(per_text.dtypes)["items"])))
    return counted.select("doc_id", *[count(k) for k in KINDS],
                          F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("base"),
                          F.array_join(written, ",").alias("spans"))


def sanitize(docs: DataFrame, least_texts: int = LEAST_TEXTS, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and disclosing terms generalised or removed; rows, order of columns and other columns stay.

    Overlapping spans are masked as one run, by the mask of the first. A null text stays null.
    """
    w = W.partitionBy(*KEY).orderBy("start", F.desc("stop"), "kind")
    done = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = (spans(docs, least_texts, disclosed).withColumn("done", F.coalesce(done, F.lit(0))).filter(F.col("stop") > F.col("done"))
           .withColumn("shown", F.when(F.col("start") >= F.col("done"), F.col("mask")).otherwise(F.lit("")))
           .withColumn("start", F.greatest("start", "done"))
           .groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "done", "shown"))).alias("cuts")))
    names = {k: fresh(docs, f"_{k}") for k in [*KEY, "cuts"]}
    cut = cut_lineage(cut, "cuts").select(*[F.col(k).alias(v) for k, v in names.items()])
    keyed = docs.select("*", *[k.alias(names[n]) for k, n in zip(text_key(), KEY)])
    joined = keyed.join(cut, [names[k] for k in KEY], "left")
    cuts, t = F.col(names["cuts"]), F.col("text")
    head = F.array_join(F.transform(cuts, lambda s: F.concat(F.substring(t, s["done"] + 1, s["start"] - s["done"]), s["shown"])), "")
    tail = F.substring(t, F.element_at(cuts, -1)["stop"] + 1, F.length(t))
    return joined.withColumn("text", F.when(cuts.isNull() | t.isNull(), t).otherwise(F.concat(head, tail))).select(*docs.columns)
