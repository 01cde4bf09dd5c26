"""DataFrame to DataFrame operators of the crawl pipeline."""
