"""Registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import analysis, classify, dates, resolve, urls
from millrace.operators import domains, fetching, frontier, instants, metrics, pages, robots, store
from millrace.plans import crawl, fixtures, streams
from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
PHRASE = "mùa giải mới"


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    return frontier.admit(table(spark, d, "new_url_tasks"), table(spark, d, "domains"), robots.rules(fixtures.robots_bodies(spark)))


def _taken(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).where("verdict = 'admitted'")


def _back(spark: SparkSession, d: str) -> DataFrame:
    return frontier.back_order(frontier.front_order(_taken(spark, d)).select("url", "host", "visit"))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """The distinct found URLs."""
    return table(spark, d, "new_url_tasks").where("url is not null").select("url").distinct()


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return metrics.samples(e, F.col("event_type"), F.col("ts").cast("timestamp"))


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return metrics.cumulative(metrics.samples(e, F.col("event_type"), F.col("ts").cast("timestamp"), F.col("user_id").cast("string")))


def _stored_instants(spark: SparkSession, d: str) -> DataFrame:
    """Contents with publish_at read by the crawler's own formats."""
    c = table(spark, d, "contents")
    return c.withColumn("publish_at", dates.parse_date(F.col("publish_at"), fixtures.as_of()))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first document that has one."""
    return list(table(spark, d, "embeddings").orderBy("vec_id").first().embedding)


def _facts(wanted: Sequence[str], noise: str = pages.NOISE) -> Query:
    return lambda spark, d: pages.page_facts(table(spark, d, "url_metadata").where("status_code = 200"), wanted, noise)


def _each(fact: str) -> Query:
    """(id, url): the links that a fact lists, each once."""
    return lambda s, d: _facts((fact,))(s, d).select("id", F.explode(fact).alias("url")).distinct()


def _first_url(spark: SparkSession, d: str) -> str:
    """The URL of the smallest id, spelled otherwise."""
    return f" {table(spark, d, 'url_metadata').orderBy('id').first().url.upper()} "


def _merged(contents: DataFrame) -> DataFrame:
    """The store after the rows that came early in 2025 and before, and then the others."""
    c, order = contents.select("id", "url", "title", "content", "received_at"), F.struct("received_at", "id")
    early = F.coalesce(F.col("received_at") < F.to_timestamp(F.lit("2025-02-01")), F.lit(True))
    first = store.upserted(None, c.where(early), order).drop("is_insert")
    return store.upserted(first, c.where(~early), order).select("id", "url", "title", F.md5("content").alias("content_md5"), "is_insert")


def _front(columns: str = "url, host, priority, last_crawled, subqueue, queue_key, visit") -> list[str]:
    return columns.split(", ")


def queries() -> dict[str, Query]:
    def t(f: Callable[..., DataFrame], *tables: str) -> Query:
        return lambda spark, d: f(*[table(spark, d, name) for name in tables])

    return streams.queries() | {
        "p4_found": t(lambda c, s: instants.publish_instants(c, s).where("publish_us is not null").distinct(), "contents", "site_locales"),
        "p4_zones": t(instants.zone_report, "contents", "site_locales"),
        # frontier
        "admit_by_host": lambda s, d: _admitted(s, d).groupBy(F.lower("host").alias("host"), "verdict").agg(F.count("*").alias("urls"), F.sum("copies").alias("copies")),
        "admit_counters": lambda s, d: frontier.counters_by_host(_admitted(s, d)),
        "url_hash_id": lambda s, d: _urls(s, d).select("url", urls.url_id(F.col("url")).alias("id")),
        "java_bucket": t(lambda x: x.select("domain", urls.string_hash(F.col("domain")).alias("hash"), urls.bucket(F.col("domain"), 3).alias("of_3"), urls.bucket(F.col("domain"), 10).alias("of_10")), "domains"),
        "article_classify": lambda s, d: _urls(s, d).select("url", *[f(F.col("url")).alias(n) for n, f in (("excluded", classify.is_excluded), ("file", classify.is_file), ("article_like", classify.looks_like_article), ("article", classify.is_article))]),
        "link_valid": lambda s, d: _urls(s, d).select("url", classify.is_section_link(F.col("url")).alias("section"), classify.is_navigation_link(F.col("url")).alias("navigation"), F.coalesce(classify.is_home(F.col("url")), F.lit(False)).alias("home")),
        "front_queue_order": lambda s, d: frontier.front_order(_taken(s, d)).select(*_front()),
        "front_queue_cursor": lambda s, d: frontier.front_order(_taken(s, d), cursor=4).where("visit is not null").select("url", "visit"),
        "front_batch": lambda s, d: frontier.front_batch(_taken(s, d)).select("url", "priority", "visit"),
        "back_queue_order": lambda s, d: _back(s, d).select("url", "queue", "place", "turn"),
        "dispatch_batch": lambda s, d: frontier.dispatch_batch(_back(s, d)).select("url", "queue", "place"),
        "frontier_stats": lambda s, d: frontier.statistics(frontier.with_front_queue(_taken(s, d)), _back(s, d)),
        "frontier_empty": lambda s, d: frontier.is_empty(frontier.statistics(frontier.with_front_queue(_taken(s, d)), _back(s, d))),
        "frontier_tick": lambda s, d: crawl.tick(table(s, d, "new_url_tasks"), table(s, d, "domains"), robots.rules(fixtures.robots_bodies(s))),
        "retry_gate": t(lambda r: frontier.retry_gate(r, fixtures.as_of()).groupBy("url", "route").agg(F.count("*").alias("messages")), "retry_url_tasks"),
        "queues_cleared": lambda s, d: frontier.statistics(*frontier.cleared(frontier.with_front_queue(_taken(s, d)), _back(s, d))),
        "already_queued": lambda s, d: frontier.admit(table(s, d, "new_url_tasks"), table(s, d, "domains"), queued=table(s, d, "retry_url_tasks")).groupBy("verdict").agg(F.count("*").alias("urls"), F.sum("copies").alias("copies")),
        "frontier_totals": lambda s, d: frontier.totals(_admitted(s, d)),
        "retry_drain": t(lambda r: frontier.retry_drain(frontier.retry_gate(r, fixtures.as_of())), "retry_url_tasks"),
        "robots_verdict": lambda s, d: robots.with_verdict(_urls(s, d), robots.rules(fixtures.robots_bodies(s))).select("url", "robots", "crawl_delay"),
        "robots_strict": lambda s, d: robots.with_verdict(_urls(s, d), robots.rules(fixtures.robots_bodies(s)), strict=True).select("url", "robots", "crawl_delay"),
        "robots_parse": lambda s, d: robots.rules(fixtures.robots_bodies(s)),
        # domains
        "seeds_active": t(domains.seeds, "domains"),
        "domain_bootstrap": lambda s, d: domains.bootstrap(table(s, d, "domains"), domains.configured(s, fixtures.NEW_HOSTS), fixtures.as_of()),
        "domain_update": t(lambda x: domains.update(x, fixtures.domain_changes(x)), "domains"),
        "domain_update_strict": t(lambda x: domains.update(x, fixtures.domain_changes(x), strict=True).select("domain", "active"), "domains"),
        "domain_create": lambda s, d: domains.create(table(s, d, "domains"), domains.bootstrap(table(s, d, "domains"), domains.configured(s, fixtures.NEW_HOSTS), fixtures.as_of())).select("domain", "priority", "active"),
        "domain_delete": t(lambda x: domains.delete(x, x.where("not coalesce(active, false)")).select("domain"), "domains"),
        "recrawl_ticks": t(lambda x: domains.recrawl_ticks(x, fixtures.as_of(), fixtures.as_of() + F.expr("interval 2 hours")), "domains"),
        # fetches
        "fetch_outcome": t(lambda m: fetching.outcome(fixtures.typed_attempts(m)).groupBy("url", "outcome").agg(F.count("*").alias("attempts")), "url_metadata"),
        "fetch_counters": t(lambda m: fetching.fetch_counters(fetching.outcome(fixtures.typed_attempts(m))), "url_metadata"),
        "redirect_resolve": t(lambda r: fetching.resolve_redirects(r.select("url").distinct(), fixtures.redirects(r)), "retry_url_tasks"),
        "metadata_fold": t(lambda r, m: fetching.fold_metadata(fixtures.attempts(r, m)).select("id", "url", F.length("raw_html").alias("html_chars"), F.md5("raw_html").alias("html_md5"), "status_code", "retry_count", "last_attempt"), "retry_url_tasks", "url_metadata"),
        "url_allow": t(lambda n, m, r: fetching.may_fetch(n, m, fixtures.status_cache(r), fixtures.as_of()), "new_url_tasks", "url_metadata", "retry_url_tasks"),
        "url_allow_strict": t(lambda n, m, r: fetching.may_fetch(n, m, fixtures.status_cache(r), fixtures.as_of(), strict=True), "new_url_tasks", "url_metadata", "retry_url_tasks"),
        "metadata_lookup": lambda s, d: fetching.lookup(table(s, d, "url_metadata"), _first_url(s, d)).select("id", "url", "status_code"),
        "host_tracker": t(lambda n: fetching.host_flushes(n.select(urls.site(F.col("url")).alias("host"), "ts")), "new_url_tasks"),
        "limiter_window": t(lambda n: fetching.politeness_gap(n.where("domain is not null").select(F.col("domain").alias("key"), "ts")).groupBy("key").agg(F.max("in_window").alias("most_in_window"), F.count_if("held").alias("held")), "new_url_tasks"),
        # URLs and pages
        "url_canonical": lambda s, d: _urls(s, d).select("url", resolve.canonical_udf(F.col("url")).alias("canonical")),
        "url_parts": lambda s, d: resolve.with_parts(_urls(s, d)),
        "current_url": lambda s, d: _facts(("canonical",))(s, d).select("id", "canonical").distinct(),
        "page_links": _each("page_links"),
        "nav_links": _each("nav_links"),
        "header_links": _each("header_links"),
        "sitemap_seeds": lambda s, d: pages.sitemap(_facts(pages.SITEMAP_FACTS)(s, d)).select("id", F.explode("seeds").alias("url")).distinct(),
        "new_links": lambda s, d: pages.new_links(_facts(pages.LINK_FACTS)(s, d)).distinct(),
        "extracted_total": lambda s, d: pages.extracted_total(pages.new_links(_facts(pages.LINK_FACTS)(s, d)).distinct()),
        # a page that was saved again counts once, with the most of each link that a save of it has
        "link_frequency": lambda s, d: pages.link_frequency(_facts(("all_links",))(s, d).select("id", "all_links").distinct()).groupBy("id", "url").agg(F.max("n").alias("n")),
        "token_reduction": lambda s, d: pages.token_reduction(_facts(("html_chars", "kept_chars"))(s, d)).distinct(),
        "token_reduction_notebook": lambda s, d: pages.token_reduction(_facts(("html_chars", "kept_chars"), pages.MORE_NOISE)(s, d)).distinct(),
        "article_extract": t(lambda m, r: pages.articles(m, r).distinct(), "url_metadata", "content_css_selector"),
        "parse_counters": t(lambda m, r: pages.parse_counters(pages.articles(m, r)), "url_metadata", "content_css_selector"),
        "missing_selectors": t(pages.missing_selectors, "url_metadata", "content_css_selector"),
        "date_parse": t(lambda c: c.select("id", dates.parse_date(F.col("publish_at"), fixtures.as_of()).alias("publish_at")), "contents"),
        "crawl_closure": lambda s, d: crawl.closure(domains.seeds(table(s, d, "domains")).select("url"), table(s, d, "url_metadata"), table(s, d, "domains"), fixtures.as_of()),
        "crawl_closure_pages": lambda s, d: crawl.closure(table(s, d, "url_metadata").select("url"), table(s, d, "url_metadata"), table(s, d, "domains"), fixtures.as_of()),
        # literal inputs, for what no table holds
        "resolve_cases": lambda s, d: fixtures.link_cases(s).select("base", "href", resolve.resolve_udf("base", "href").alias("resolved"), resolve.resolve_same_site_udf("base", "href").alias("same_site")),
        "canonical_cases": lambda s, d: fixtures.canonical_cases(s).select("url", resolve.canonical_udf("url").alias("canonical")),
        "date_cases": lambda s, d: fixtures.date_texts(s).select("text", dates.parse_date(F.col("text"), fixtures.as_of(), "Asia/Ho_Chi_Minh").alias("instant")),
        "reply_cases": lambda s, d: fixtures.replies(s).select("n", pages.reply_selectors(F.col("reply")).alias("r")).select("n", "r.*"),
        "robots_gate": lambda s, d: robots.rules(fixtures.typed_bodies(s)).select("host", F.array_join("agents", ",").alias("agents"), "type", "pattern", "regex"),
        "article_cases": lambda s, d: pages.articles(fixtures.small_pages(s), fixtures.small_registry(s)).drop("url"),
        "sitemap_cases": lambda s, d: pages.more_sitemap_links(pages.page_facts(fixtures.small_pages(s), pages.WIDE_FACTS)),
        "header_cases": lambda s, d: pages.page_facts(fixtures.small_pages(s), ("header_links",)).select("id", F.explode("header_links").alias("url")),
        "frequency_cases": lambda s, d: pages.link_frequency(pages.page_facts(fixtures.small_pages(s), ("all_links",))),
        "parse_counter_cases": lambda s, d: pages.parse_counters(pages.articles(fixtures.small_pages(s), fixtures.small_registry(s))),
        "token_cases": lambda s, d: pages.token_reduction(pages.page_facts(fixtures.small_pages(s), ("html_chars", "kept_chars"))),
        "prompt_cases": lambda s, d: pages.prompts(fixtures.small_pages(s)).select("id", "domain", F.substring_index("prompt", "\n\n", -1).alias("kept"), "fits"),
        # store and search
        "store_counters": t(store.store_counters, "contents"),
        "content_upsert": t(lambda c: store.upserted(None, c.select("id", "url", "title", "content", "author", "publish_at", "received_at"), F.struct("received_at", "id")).select("id", "url", "title", F.md5("content").alias("content_md5"), "author", "publish_at", "is_insert"), "contents"),
        "content_merge": t(_merged, "contents"),
        "search_blank": t(lambda c: store.keyword_search(c, " - ").select("id"), "contents"),
        "embed_text": t(lambda c: c.select("id", F.md5(analysis.embedding_text(F.col("title"), F.col("content"))).alias("text_md5"), F.length(analysis.embedding_text(F.col("title"), F.col("content"))).alias("chars")), "contents"),
        "search_keyword": lambda s, d: store.keyword_search(_stored_instants(s, d), PHRASE).select("id", "url", "publish_at"),
        "search_keyword_page": lambda s, d: store.keyword_search(_stored_instants(s, d), PHRASE, page=2, size=10).select("id", "url", "publish_at"),
        "search_keyword_score": lambda s, d: store.keyword_search(_stored_instants(s, d), PHRASE, size=20, sort="score").select("id", "url", "score"),
        "search_indexed": lambda s, d: store.indexed_search(store.word_index(table(s, d, "contents")), table(s, d, "contents"), PHRASE, size=20, sort="score").select("id", "url", "score"),
        "search_semantic": lambda s, d: store.semantic_search(table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), _query_vector(s, d), size=10, vector="embedding").select("id", F.round("score", 6).alias("score")),
        "semantic_total": t(store.semantic_total, "contents"),
        # metrics
        "metric_samples": _events,
        "metric_last": lambda s, d: metrics.last_values(metrics.cumulative(_events(s, d))),
        "metric_rate": lambda s, d: metrics.rate(metrics.cumulative(_events(s, d))).select("metric", "ts", F.round("rate", 6).alias("rate")),
        "metric_topk": lambda s, d: metrics.top(_by_user(s, d)),
        "metric_sum": lambda s, d: metrics.total(metrics.cumulative(_events(s, d))),
        "token_reduction_models": lambda s, d: metrics.reduction(fixtures.token_counts(s)),
        "token_pivot": lambda s, d: metrics.token_pivot(fixtures.token_counts(s).withColumn("tokens", F.col("after")), ["small", "large"]),
        "model_matrix": lambda s, d: metrics.field_matrix(fixtures.answers(s)).select("content", "field", "expected", F.element_at("answers", "small").alias("small"), F.element_at("answers", "large").alias("large")),
    }
