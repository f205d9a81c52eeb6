"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

Pages are the distinct texts of a host, so a page crawled twice counts once. A line is boilerplate on a host when
the share of the host's pages that contain it exceeds a ratio. Lines travel as 64-bit hashes; what remains per host is
a short list (lines of a page divided by the ratio, at most), which goes to the documents.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.llm.common import cut_lineage, fresh

#: A line on more than this share of a host's pages is boilerplate, if it is on so many pages at least.
RATIO, LEAST_PAGES = 0.05, 4
#: Shares into which a host's documents are split for the join with its list.
SALTS = 32

BLANKS = " \t\r"


def host_of(url):
    """Lower-case host of a URL column, without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _line_key(line):
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, lines: the hashes of a host's boilerplate lines (hosts that have some)."""
    filled = F.filter(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    pages = (docs.filter(F.col(host).isNotNull() & F.col(text).isNotNull())
             .select(F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("page"), F.array_distinct(F.transform(filled, _line_key)).alias("keys"))
             .dropDuplicates(["host", "page"]))
    pages = cut_lineage(pages, "pages")
    counts = (pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
              .filter(F.col("n") >= least_pages))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    bad = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return bad.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
                     counted: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; with ``counted`` also n_lines and n_dropped.

    Every row and column stays, also a text that becomes empty. The other lines keep their order and form. Empty lines are never
    boilerplate. A row without a host is left as it is, and so is a null text (no lines). Repeated rows are one page. ``least_pages`` is the
    support that a line needs: on a host with fewer than ``least_pages / ratio`` distinct pages it, and not the ratio, decides; without it every line of a host of one page would go.
    """
    salt, bad_host, bad = fresh(docs, "_salt"), fresh(docs, "_host"), fresh(docs, "_bad")
    lists = cut_lineage(boilerplate(docs, host, text, ratio, least_pages), "boilerplate")
    lists = lists.select(F.col("host").alias(bad_host), F.col("lines").alias(bad), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    salted = docs.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
    joined = salted.join(lists, (salted[host].cast("string") == lists[bad_host]) & (salted[salt] == lists[salt]), "left").drop(lists[salt])
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col(bad), _line_key(x)) | (F.btrim(x, F.lit(BLANKS)) == ""))
    joined = joined.withColumn(bad_host, F.when(F.col(bad).isNotNull(), kept))
    if counted:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text))))
        joined = joined.withColumn("n_lines", n.cast("long")).withColumn("n_dropped", F.when(F.col(bad_host).isNull() | F.col(text).isNull(), 0)
                                                                         .otherwise(n - F.size(bad_host)).cast("long"))
    return joined.withColumn(text, F.coalesce(F.array_join(bad_host, "\n"), F.col(text))).drop(salt, bad_host, bad)
