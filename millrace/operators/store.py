"""The content store: validation, upsert, keyword and vector search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions import analysis

PAGE_SIZE = 5
TITLE_BOOST, CONTENT_BOOST = 3.0, 1.0


def _filled(name: str) -> Column:
    return F.coalesce(F.length(F.trim(name)) > 0, F.lit(False))


def validated(contents: DataFrame) -> DataFrame:
    """Contents with ``valid``: URL, title and content aren't blank."""
    return contents.withColumn("valid", _filled("url") & _filled("title") & _filled("content"))


def store_counters(contents: DataFrame) -> DataFrame:
    """(stored, failed): rows that are stored for the first time, and invalid rows. A URL in many rows is one pre-aggregated row a task."""
    v = validated(contents)
    first = v.where("valid").select("url").distinct().agg(F.count("*").alias("stored"))
    failed = v.agg(F.count_if(~F.col("valid")).alias("failed"))
    # one row each
    return first.join(F.broadcast(failed))


def upserted(stored: DataFrame | None, arriving: DataFrame, order: Column) -> DataFrame:
    """The store after the valid rows of ``arriving`` in ``order``, which is total: one row a URL with the id of its first row and all else of its last; ``is_insert`` tells URLs that weren't stored.

    First and last are found by aggregation, so a URL in a third of all rows meets no single task.
    """
    columns = [c for c in arriving.columns if c not in ("id", "url")]
    rows = validated(arriving).where("valid").drop("valid").withColumn("__at", order)
    new = rows.groupBy("url").agg(F.min_by("id", "__at").alias("id"), F.max_by(F.struct(*columns), "__at").alias("__last"))
    if stored is None:
        return new.select("id", "url", *[f"__last.{c}" for c in columns], F.lit(True).alias("is_insert"))
    old = stored.select("url", F.col("id").alias("__id"), F.struct(*columns).alias("__old"))
    j = old.join(new, "url", "full")
    kept = F.coalesce("__last", "__old")
    return j.select(F.coalesce("__id", "id").alias("id"), "url", *[kept[c].alias(c) for c in columns], F.col("__id").isNull().alias("is_insert"))


def _page(found: DataFrame, page: int, size: int, sort: str) -> DataFrame:
    order = [F.col("score").desc(), "url", "id"] if sort == "score" else [F.col("publish_at").desc_nulls_last(), F.col("url").asc(), F.col("id").asc()]
    return found.orderBy(*order).offset(page * size).limit(size)


def keyword_search(contents: DataFrame, phrase: str | None, page: int = 0, size: int = PAGE_SIZE, sort: str = "publish_at") -> DataFrame:
    """Page ``page`` of the contents whose title or content has the phrase, newest first, or by score (title 3, content 1). A blank phrase finds nothing. Reads all texts; for many searches see write_index()."""
    p = F.lit(phrase or "")
    in_title, in_content = analysis.has_phrase(F.col("title"), p), analysis.has_phrase(F.col("content"), p)
    score = F.when(in_title, TITLE_BOOST).otherwise(0.0) + F.when(in_content, CONTENT_BOOST).otherwise(0.0)
    return _page(contents.withColumn("score", score).where(F.col("score") > 0), page, size, sort)


def word_index(contents: DataFrame) -> DataFrame:
    """(word, id, field, places): where each word of the analysed title and content stands, for phrase search without reading texts."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.split(F.trim(analysis.analysed(F.col(f))), " ").alias("words")) for f in ("title", "content")])
    each = contents.where("id is not null").select("id", F.explode(fields).alias("f")).select("id", "f.field", F.posexplode("f.words").alias("place", "word"))
    return each.where("word <> ''").groupBy("word", "id", "field").agg(F.sort_array(F.collect_set("place")).alias("places"))


#: Folders of a written index.
INDEX_BUCKETS = 256


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(INDEX_BUCKETS)).cast("int")


def write_index(contents: DataFrame, folder: str) -> None:
    """Write word_index() once, in INDEX_BUCKETS folders by a hash of the word, sorted by word, so that a search reads the row groups of its words only. A frequent word is spread over several files of its folder."""
    spread = F.pmod(F.xxhash64("id"), F.lit(8))
    index = word_index(contents).withColumn("bucket", _bucket(F.col("word")))
    index.repartition("bucket", spread).sortWithinPartitions("bucket", "word", "id").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def indexed_search(index: DataFrame, contents: DataFrame, phrase: str | None, page: int = 0, size: int = PAGE_SIZE, sort: str = "publish_at") -> DataFrame:
    """keyword_search() over word_index(), or the table that write_index() wrote: the phrase's words are looked up, only hits are joined with ``contents``. Ids are unique there."""
    words = index.sparkSession.range(1).select(F.explode(F.split(F.trim(analysis.analysed(F.lit(phrase or ""))), " ")).alias("w")).select("w", _bucket(F.col("w")).alias("b")).where("w <> ''").collect()
    found = index.where(F.col("word").isin([r.w for r in words]))
    if "bucket" in index.columns:
        found = found.where(F.col("bucket").isin([r.b for r in words]))
    # the places at which the phrase would begin, by each of its words
    def starts_by(word: str, nth: int) -> Column:
        return F.transform(F.flatten(F.collect_list(F.when(F.col("word") == word, F.col("places")))), lambda p: p - nth)

    starts = [starts_by(r.w, k) for k, r in enumerate(words)]
    together = reduce(F.array_intersect, starts) if starts else F.array().cast("array<int>")
    hits = found.groupBy("id", "field").agg(F.size(together).alias("n")).where("n > 0")
    boost = F.when(F.col("field") == "title", TITLE_BOOST).otherwise(CONTENT_BOOST)
    return _page(contents.join(hits.groupBy("id").agg(F.sum(boost).alias("score")), "id"), page, size, sort)


def semantic_search(contents: DataFrame, query: Sequence[float], page: int = 0, size: int = PAGE_SIZE, vector: str = "content_embedding") -> DataFrame:
    """Page ``page`` of the contents with a vector, by cosine with ``query`` plus 1; exact. Vectors of another length, all zero or with values that aren't finite have no score."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf(DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        values = vectors.to_numpy()
        right = np.fromiter((v is not None and len(v) == len(q) for v in values), bool, len(values))
        out = np.full(len(values), np.nan)
        if right.any():
            m = np.stack(values[right]).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", m, m))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[right] = np.where(np.isfinite(norms) & (norms > 0), m @ q / norms + 1.0, np.nan)
        return pd.Series(out)

    found = contents.where(F.col(vector).isNotNull() & (F.size(vector) == len(q))).withColumn("score", score(F.col(vector)))
    return found.where("score is not null and not isnan(score)").orderBy(F.col("score").desc(), "id").offset(page * size).limit(size)


def semantic_total(contents: DataFrame, vector: str = "content_embedding") -> DataFrame:
    """(total): contents with a vector."""
    return contents.where(F.col(vector).isNotNull()).agg(F.count("*").alias("total"))


def reciprocal_rank(lists: Sequence[DataFrame], k: int = 60, n: int = PAGE_SIZE) -> DataFrame:
    """(id, score): the best of several bounded result lists (id, rank), merged by the sum of 1 / (k + rank)."""
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.col("score").desc(), "id").limit(n)


def with_rank(page: DataFrame, order: Sequence[Column]) -> DataFrame:
    """A result page with its ranks; pages are bounded."""
    return page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
