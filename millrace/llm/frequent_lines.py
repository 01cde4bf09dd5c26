"""Problem 2: lines repeated across one site's documents.

Each line is brought to a key in which letter case, spacing, punctuation and signs, the value of numbers and look-alike
characters make no difference, and hashed. A row counts a line once. Lines of at least ``least_rows`` rows and ``share``
of the site's rows with content are frequent; they are taken out of the documents again.

Only (site hash, line hash, count) is shuffled, pre-aggregated per task. A site has at most 1 / share times the mean
number of lines of its rows as frequent lines, so they travel as one array per site: broadcast if their measured size
allows, otherwise joined with salted sites (operators/joins.lookup_join). Documents never move and are never regrouped.

Null content gives no row; a null or hostless URL belongs to no site, so nothing in it is frequent; '' stays ''. Lines
without a letter or digit are never frequent. Repeated rows count as rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.llm import looks
from millrace.operators.joins import lookup_join
from millrace.session import cut

LEAST_ROWS = 5
SHARE = 0.1


def line_keys(content: Column) -> Column:
    """Array with a hash for each line of the text, split at ``\\n``; null for lines without letter or digit."""
    # only texts with characters that may be disguised leave the JVM
    plain = F.coalesce(looks.plain_udf(F.when(content.rlike(looks.SUSPECT), content)), content)
    bare = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{M}\p{N}\n]+", ""), r"\p{N}+", "0")
    return F.transform(F.split(bare, "\n"), lambda line: F.when(line != "", F.xxhash64(line)))


def frequent_lines(keyed: DataFrame, least_rows: int = LEAST_ROWS, share: float = SHARE) -> DataFrame:
    """(site, frequent): for each site the hashes of its frequent lines. ``keyed`` has site (a hash) and keys, a row for each document."""
    own = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(F.array_compact("keys")))  # null counts the rows themselves
    counted = keyed.where("site is not null").select("site", F.explode(own).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    counted = cut(counted.where((F.col("n") >= least_rows) | F.col("line").isNull()))
    rows = counted.where("line is null").select("site", F.col("n").alias("rows"))
    # the share in millionths, so that no rounding decides
    enough = F.col("n") * 1_000_000 >= F.col("rows") * round(share * 1_000_000)
    return counted.where("line is not null").join(rows, "site").where(enough).groupBy("site").agg(F.collect_list("line").alias("frequent"))


def _keyed(contents: DataFrame) -> DataFrame:
    site = urls.site(F.col("url"))
    return contents.where("content is not null").withColumn("__site", F.when(site.isNotNull(), F.xxhash64(site))).withColumn("__keys", line_keys(F.col("content")))


def _keys(contents: DataFrame) -> DataFrame:
    return _keyed(contents.select("id", "url", "content")).select("id", F.col("__site").alias("site"), F.col("__keys").alias("keys"))


def frequent_positions(contents: DataFrame, least_rows: int = LEAST_ROWS, share: float = SHARE) -> DataFrame:
    """(id, line_no): the frequent lines of each document, counted from 1, blank lines included."""
    keyed = cut(_keys(contents))
    lines = lookup_join(keyed, frequent_lines(keyed, least_rows, share), ["site"], "inner")
    hit = lines.select("id", F.posexplode(F.transform("keys", lambda k: F.array_contains("frequent", k))).alias("at", "hit"))
    return hit.where("hit").select("id", (F.col("at") + 1).cast("int").alias("line_no")).distinct()


def without_frequent_lines(contents: DataFrame, least_rows: int = LEAST_ROWS, share: float = SHARE) -> DataFrame:
    """(id, url, content, lines_removed): the rows with content, without their site's frequent lines."""
    contents = contents.select("id", "url", "content")
    # keys are worked out twice, once to count and once beside the texts, which would cost more to write
    frequent = frequent_lines(_keys(contents), least_rows, share)
    rows = lookup_join(_keyed(contents).withColumnRenamed("__site", "__of"), frequent.select(F.col("site").alias("__of"), F.col("frequent").alias("__frequent")), ["__of"])
    lines = F.arrays_zip(F.split("content", "\n").alias("line"), F.col("__keys").alias("key"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("__frequent", x["key"]), F.lit(False)))
    rows = rows.withColumn("__kept", F.transform(kept, lambda x: x["line"]))
    removed = (F.size(F.split("content", "\n")) - F.size("__kept")).alias("lines_removed")
    return rows.select("id", "url", F.array_join("__kept", "\n").alias("content"), removed)
