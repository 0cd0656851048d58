"""Bounded crawls on the driver through an injected fetcher: what they find is handed to DataFrames."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lexmill.sources import html as H
from lexmill.sources.ports import Fetcher, ProviderError


@dataclass
class Crawl:
    """Limits of a crawl and what it met."""

    most_pages: int = 80
    most_feeds: int = 30
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    cross_host: bool = False
    failed: list[tuple[str, str]] = field(default_factory=list)

    def wanted(self, url: str, label: str, host: str) -> bool:
        """Whether a link is followed."""
        hay = f"{url} {label}"
        return (self.cross_host or H.host_of(url) == host) and not any(re.search(p, hay) for p in self.exclude) and (not self.include or any(re.search(p, hay) for p in self.include))

    def pages(self, fetcher: Fetcher, starts: list[str]) -> Iterator[tuple[str, bytes, str]]:
        """Breadth first from the start pages: url, content, type. A page that fails is noted and the crawl goes on."""
        queue, seen, n, feeds = deque((u, H.host_of(u)) for u in starts), set(starts), 0, 0
        while queue and n < self.most_pages:
            url, host = queue.popleft()
            try:
                status, content, kind = fetcher.fetch(url)
            except ProviderError as e:
                self.failed.append((url, str(e)))
                continue
            if status >= 400:
                self.failed.append((url, str(status)))
                continue
            n += 1
            yield url, content, kind
            text = content.decode("utf-8", "replace")
            if "xml" in kind:
                feeds += 1
                found = [(u.replace("&amp;", "&"), "") for u in re.findall(r"<(?:\w+:)?(?:loc|link)>\s*([^<\s]+)", text)] if feeds <= self.most_feeds else []
            else:
                found = [(H.urldefrag(H.urljoin(url, h))[0], label) for h, label in H.read(text).links] if "html" in kind else []
            for u, label in found:
                if u not in seen and u.startswith("http") and self.wanted(u, label, host):
                    seen.add(u)
                    queue.append((u, host))


def first_good(fetcher: Fetcher, urls: list[str], reject: Callable[[bytes], str | None]) -> tuple[str | None, bytes | None, list[tuple[str, str]]]:
    """The first address whose content is accepted, and why the ones before it were not."""
    bad = []
    for u in urls:
        try:
            status, content, _ = fetcher.fetch(u)
        except ProviderError as e:
            bad.append((u, str(e)))
            continue
        reason = str(status) if status >= 400 else reject(content)
        if reason is None:
            return u, content, bad
        bad.append((u, reason))
    return None, None, bad


def to_table(spark: SparkSession, pages: Iterator[tuple[str, bytes, str]]) -> DataFrame:
    """url, content, kind of a bounded crawl."""
    return spark.createDataFrame([(u, bytearray(c), k) for u, c, k in pages], "url string, content binary, kind string")
