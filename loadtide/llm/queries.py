"""Named queries of the text operators over the given tables, and the SQL that checks those SQL can express."""
import corpus_pipeline
from loadtide.llm.common import table

QUERIES: dict = {}
SQL: dict = {}


def query(key: str, sql: str | None = None):
    """Register fn(spark, folder) -> DataFrame."""
    def wrap(fn):
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn
    return wrap


@query("op5_minhash_near_dup")
def op5(spark, folder):
    """Near-duplicate classes of documents: three-word shingles, Jaccard similarity of 0.85 or more."""
    from loadtide.llm.near_dup import near_duplicates
    return near_duplicates(table(spark, folder, "documents"), percent=85, words=3)


@query("op3_word_bpe")
def op3(spark, folder):
    """Every document encoded and decoded with the public word-end vocabulary."""
    import public_tokenizers
    from loadtide.llm.word_bpe import digests
    return digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_packing")
def op9(spark, folder):
    """All documents packed into sequences of 1024 tokens."""
    from loadtide.llm.packing import pack, public_encoder
    return pack(table(spark, folder, "documents"), public_encoder())


@query("op8_toxicity")
def op8(spark, folder):
    """Toxicity of every document, restored by a noisy channel; labels of held-out rows are never used."""
    from loadtide.llm.toxicity import fit, score
    docs = table(spark, folder, "documents")
    return score(docs, fit(docs, table(spark, folder, "labels")))


@query("op1_line_dedup", """
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
split AS (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages),
keyed AS (SELECT DISTINCT source, text, trim(line, chr(32) || chr(9) || chr(13)) AS k FROM split WHERE trim(line, chr(32) || chr(9) || chr(13)) <> ''),
total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
bad AS (SELECT k.source, k.k FROM keyed k JOIN total t ON k.source = t.source GROUP BY k.source, k.k, t.pages
        HAVING count(*) >= 4 AND count(*) > 0.05 * t.pages),
numbered AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (SELECT r, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM numbered),
marked AS (SELECT l.r, l.i, l.line, b.k IS NOT NULL AS gone FROM lines l
           LEFT JOIN bad b ON l.source = b.source AND b.k = trim(l.line, chr(32) || chr(9) || chr(13))),
joined AS (SELECT r, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY r)
SELECT n.doc_id, n.source, coalesce(j.n_lines, 0) AS n_lines, CAST(coalesce(j.n_dropped, 0) AS BIGINT) AS n_dropped, j.text AS text
FROM numbered n LEFT JOIN joined j ON n.r = j.r""")
def op1(spark, folder):
    """Documents without the lines that are on over 5 % of their source's pages."""
    from loadtide.llm.line_dedup import drop_boilerplate
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, host="source", counted=True).select("doc_id", "source", "n_lines", "n_dropped", "text")


@query("op6_sanitize")
def op6(spark, folder):
    """Personal data in every document, and terms that give it away."""
    from pyspark.sql import functions as F
    from loadtide.llm.sanitize import find_personal_data
    found = find_personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


@query("pipeline")
def pipeline(spark, folder):
    """The stages of corpus_pipeline over documents."""
    return corpus_pipeline.run(spark, folder)


@query("op4_licenses")
def op4(spark, folder):
    """License notices and identifier expressions of every document."""
    from loadtide.llm.licenses import scan_licenses
    return scan_licenses(table(spark, folder, "documents"))


@query("op10_fingerprints")
def op10(spark, folder):
    """Winnowing fingerprints of every document and its edited text."""
    from loadtide.llm.winnow import compare_with_next
    return compare_with_next(table(spark, folder, "documents"))


@query("op7_multi_index")
def op7(spark, folder):
    """The 20 nearest of every twentieth vector."""
    from pyspark.sql import functions as F
    from loadtide.llm.multi_index import search
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_warc_derivatives")
def op2(spark, folder):
    """Metadata and conversion records of all pages."""
    from loadtide.llm.warc import derivatives, responses_from_pages
    return derivatives(responses_from_pages(table(spark, folder, "pages"), "2024-01-01T00:00:00Z"))


@query("op11_decontaminate", r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
items AS (SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
cut AS (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS s FROM cut),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, unnest(range(len(w))) AS i FROM docs),
met AS (SELECT p.r, p.i, z.n, array_to_string(p.w[p.i + 1:p.i + z.n], ' ') AS s FROM places p JOIN sizes z ON p.i + z.n <= len(p.w)),
hits AS (SELECT m.r, m.i, m.n, x.item_id FROM met m JOIN windows x ON m.n = x.n AND m.s = x.s),
hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, i + unnest(range(n)) AS place FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.r = h.r LEFT JOIN hit_items i ON d.r = i.r""")
def op11(spark, folder):
    """Words of every document that stand inside a passage of a benchmark item, and the items."""
    from pyspark.sql import functions as F
    from loadtide.llm.decontaminate import contamination
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op12_prefix_trie", r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, {'role': role, 'text': text} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM given),
own AS (SELECT conv_id, list(t ORDER BY i) AS path FROM turns GROUP BY conv_id),
bytes AS (SELECT conv_id, unnest(range(1, length(CAST(conv_id AS VARCHAR)) + 1)) AS i, CAST(conv_id AS VARCHAR) AS s FROM own),
listed AS (SELECT conv_id, [4294967295] || list(ascii(substr(s, i, 1)) ORDER BY i) AS codes FROM bytes GROUP BY conv_id),
crc AS (SELECT conv_id, xor(4294967295, list_reduce(codes, lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
        FROM listed),
convs AS (SELECT o.conv_id, coalesce(a.path, [])[1:c.h] || o.path[c.h + 1:] AS path FROM own o JOIN crc c ON o.conv_id = c.conv_id
          LEFT JOIN own a ON a.conv_id = o.conv_id - o.conv_id % 20),
steps AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM convs),
nodes AS (SELECT path[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = d), '')) AS ends_sha256,
          CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(coalesce(path[1:d][-1].text, ''), '[^\x20\x09-\x0D]+')) END AS words FROM steps GROUP BY path[1:d], d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY p[1:d - 1]),
known AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.p = k.p),
above AS (SELECT p, d, n_children, n_convs, words, unnest(range(d + 1)) AS a FROM known),
sums AS (SELECT p[1:a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM above GROUP BY p[1:a])
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  k.ends_sha256
FROM known k JOIN sums s ON k.p = s.p LEFT JOIN known u ON k.d > 0 AND u.d = k.d - 1 AND u.p = k.p[1:k.d - 1]""")
def op12(spark, folder):
    """The prefix trie of all rebuilt conversations."""
    from loadtide.llm.prefix_trie import trie_nodes
    return trie_nodes(table(spark, folder, "conversations"))


@query("op13_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3), (4)) s(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.*, unnest(range(1, k)) AS cut FROM cand c),
parts AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, (2000000 * CAST(c.a AS HUGEINT)) // (l.f + r.f) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM parts),
inside AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
inner_at AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM inside),
covering AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS f FROM inner_at GROUP BY ALL),
kept AS (SELECT p.* FROM worst p LEFT JOIN covering c ON c.lang = p.lang AND c.phrase = p.phrase WHERE p.o = 1 AND (c.f IS NULL OR 100 * CAST(c.f AS HUGEINT) < 80 * CAST(p.a AS HUGEINT))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT x.lang, x.rank, x.phrase, x.a, x.l, x.r, CAST(t.n AS BIGINT) AS n, CAST(x.score AS BIGINT) AS score FROM ranked x JOIN total t ON t.lang = x.lang WHERE x.rank <= 2000""")
def op13(spark, folder):
    """The best phrases of two to four words of every language."""
    from loadtide.llm.collocations import collocations
    return collocations(table(spark, folder, "documents"))
