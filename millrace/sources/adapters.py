"""Network calls behind protocols, with stubs that need no network. Each is asked once per distinct key, never per row."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.fetching import PAGE_BYTES, ROBOTS_BYTES, decoded
from millrace.operators.pages import DEFAULT_SELECTORS, prompts

# Attempts at a failing call and the first wait between them, timeouts and the gap between requests of a client.
RETRIES, FIRST_DELAY_MS = 3, 1000
TIMEOUT_S, GAP_MS = 5.0, 200
FETCHED = "url string, status int, content_type string, content_length long, location string, body binary, error string, fetched_at timestamp"

T = TypeVar("T")


class Response:
    """What came back for a URL; ``length`` is the declared one, -1 if none was."""

    def __init__(self, status: int, content_type: str | None = None, body: bytes | None = None, length: int = -1, location: str | None = None) -> None:
        self.status, self.content_type, self.body, self.length, self.location = status, content_type, body, length, location


class TooLarge(Exception):
    """A body that is larger than its cap is not read."""

    def __init__(self, size: int) -> None:
        super().__init__(f"{size} bytes")
        self.size = size


class Fetcher(Protocol):
    def fetch(self, url: str, cap: int) -> Response:
        """The response for a URL; redirects aren't followed. Raises TooLarge beyond ``cap`` bytes."""


class SelectorProvider(Protocol):
    def selectors(self, host: str, text: str | None) -> dict[str, str | None] | None:
        """Selectors of a host's pages; None if the provider failed."""


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text; an empty one for a blank text, None for an error."""


def delays_ms(attempts: int = RETRIES) -> list[int]:
    """Waiting times between attempts: doubled each time."""
    return [FIRST_DELAY_MS * 2**k for k in range(attempts - 1)]


def tried(call: Callable[[], T], attempts: int = RETRIES, sleep: Callable[[float], None] = time.sleep, final: tuple[type[Exception], ...] = ()) -> T:
    """The result of ``call``, which is made again after its errors, but for ``final`` ones; the last error is raised."""
    for wait in [*delays_ms(attempts), None]:
        try:
            return call()
        except final:
            raise
        except Exception:
            if wait is None:
                raise
            sleep(wait / 1000)
    raise AssertionError


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


class HttpFetcher:
    """Requests by the standard library: timeouts, a gap between the starts of two requests of this client, redirects given back, and bodies over the cap refused, by their declared length or as they come."""

    def __init__(self, agent: str = "millrace/1.0", timeout_s: float = TIMEOUT_S, gap_ms: int = GAP_MS, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.agent, self.timeout_s, self.gap_s, self.sleep, self.clock = agent, timeout_s, gap_ms / 1000, sleep, clock
        self.last: float | None = None
        self.opener = urllib.request.build_opener(_NoRedirects)

    def _wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.gap_s:
            self.sleep(self.gap_s - (now - self.last))
        self.last = self.clock()

    def fetch(self, url: str, cap: int) -> Response:
        self._wait()
        request = urllib.request.Request(url, headers={"User-Agent": self.agent})
        try:
            with self.opener.open(request, timeout=self.timeout_s) as r:
                return self._read(r, r.status, cap)
        except urllib.error.HTTPError as e:  # statuses other than 2xx
            with e:
                return self._read(e, e.code, cap)

    @staticmethod
    def _read(r, status: int, cap: int) -> Response:  # noqa: ANN001
        declared = r.headers.get("Content-Length")
        length = int(declared) if declared and declared.isdigit() else -1
        if 200 <= status <= 299 and length > cap:
            raise TooLarge(length)
        body = r.read(cap + 1)
        if len(body) > cap:
            raise TooLarge(len(body))
        return Response(status, r.headers.get("Content-Type"), body, length, r.headers.get("Location"))


class DefaultSelectors:
    def selectors(self, host: str, text: str | None) -> dict[str, str | None]:
        return dict(DEFAULT_SELECTORS)


class HashEmbedder:
    """Deterministic unit vectors from the words of a text: texts that share words have similar ones."""

    def __init__(self, dimensions: int = 768) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for w in (text or "").lower().split():
                h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % self.dimensions] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else [])
        return out


class StoredPages:
    """A fetcher over pages in memory, for tests."""

    def __init__(self, pages: dict[str, tuple[int, str, bytes]]) -> None:
        self.pages = pages

    def fetch(self, url: str, cap: int) -> Response:
        status, kind, body = self.pages.get(url, (404, None, None))
        if body is not None and len(body) > cap:
            raise TooLarge(len(body))
        return Response(status, kind, body, -1 if body is None else len(body))


def fetched(urls: DataFrame, make: Callable[[], Fetcher], cap: int = PAGE_BYTES, attempts: int = 1) -> DataFrame:
    """FETCHED of distinct (url). A body over ``cap`` bytes is not kept, only its length; a fetch that fails after ``attempts`` has no status and its error. The fetcher is made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            rows = []
            for url in b["url"]:
                try:
                    r = tried(lambda u=url: client.fetch(u, cap), attempts, final=(TooLarge,))
                    row = (r.status, r.content_type, len(r.body) if r.length < 0 and r.body is not None else r.length, r.location, r.body, None)
                except TooLarge as e:
                    row = (200, None, e.size, None, None, "too_large")
                except Exception as e:  # noqa: BLE001 - one bad page must not end the task
                    row = (None, None, None, None, None, f"{type(e).__name__}: {e}")
                rows.append((url, *row, pd.Timestamp.now(tz="UTC")))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")])
            yield out.astype({"status": "Int32", "content_length": "Int64"})

    return urls.select("url").distinct().mapInPandas(run, FETCHED)


def robots_bodies(hosts: DataFrame, make: Callable[[], Fetcher]) -> DataFrame:
    """(host, content_type, body) of distinct (host): the robots.txt of each, up to ROBOTS_BYTES, for robots.rules(); hosts without one have no row."""
    asked = hosts.select("host").where("host is not null").distinct().withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/robots.txt")))
    found = decoded(fetched(asked, make, ROBOTS_BYTES).where("status = 200 and body is not null"), "body", "content_type", ROBOTS_BYTES)
    return asked.join(found, "url").select("host", "content_type", F.col("text").alias("body"))


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder], batch: int = 256) -> DataFrame:
    """``rows`` with ``embedding`` of a text column; null where the embedder fails."""

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in batches:
            texts = ["" if t is None else t for t in s]
            yield pd.Series([v for k in range(0, len(texts), batch) for v in client.embed(texts[k : k + batch])], dtype=object)

    return rows.withColumn("embedding", vector(F.col(text)))


def completed_registry(registry: DataFrame, missing: DataFrame, pages: DataFrame, make: Callable[[], SelectorProvider], attempts: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The selector registry with rows for hosts that it lacked: one question a host, with the HTML of its first page (by id) without noise.

    A provider that fails is asked again after a wait; after the last error, and for pages that are too long for it or
    missing, the default selectors are taken. ``is_default`` tells.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            rows = []
            for host, text in zip(b["domain"], b["prompt"]):
                try:
                    found = tried(lambda h=host, t=text: client.selectors(h, t), attempts, sleep) if text is not None else None
                except Exception:  # noqa: BLE001
                    found = None
                s = found or DEFAULT_SELECTORS
                rows.append((hashlib.sha256(host.encode()).hexdigest()[:24], host, *(s.get(k) for k in DEFAULT_SELECTORS), found is None or found == DEFAULT_SELECTORS))
            yield pd.DataFrame(rows, columns=["id", "domain", *DEFAULT_SELECTORS, "is_default"])

    questions = prompts(pages).where("fits").groupBy("domain").agg(F.min_by("prompt", "id").alias("prompt"))
    asked = missing.select("domain").distinct().join(questions, "domain", "left")
    answered = asked.mapInPandas(ask, "id string, domain string, title string, content string, author string, publish_at string, is_default boolean")
    return registry.withColumn("is_default", F.lit(False)).unionByName(answered)
