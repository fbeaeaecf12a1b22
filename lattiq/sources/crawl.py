"""Article search as Python data sources, and page crawls; what fetches is pluggable, so tests run without a network."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str], "str | None"]  # a URL's body, or None


class ArticleSource(DataSource):
    """``spark.read.format("articles").option("queries", json list)...``; option ``fixture``: a JSON text
    {query: [{pmid, title, text}]} that stands for the network; ``retmax``; ``delay`` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return "query string, pmid string, title string, text string"

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader(self.options)


class ArticleReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in json.loads(self.options.get("queries", "[]"))]

    def read(self, partition: InputPartition):
        query, most = partition.value, int(self.options.get("retmax", "20"))
        if "fixture" in self.options:
            found = json.loads(self.options["fixture"]).get(query, [])
        else:
            found = fetch(self.options["endpoint"], query, most)
            time.sleep(float(self.options.get("delay", "0.34")))
        for a in found[:most]:
            yield (query, a["pmid"], a.get("title"), a.get("text"))


def fetch(endpoint: str, query: str, most: int) -> list[dict]:
    url = f"{endpoint}?{urllib.parse.urlencode({'term': query, 'retmax': most, 'retmode': 'json'})}"
    with urllib.request.urlopen(url, timeout=30) as r:
        return json.load(r)["articles"]


def address(endpoint: str, **params) -> str:
    return f"{endpoint}?{urllib.parse.urlencode(params)}"


def download(url: str) -> str | None:
    """The body of a URL, None where it is not to be had."""
    try:
        with urllib.request.urlopen(url, timeout=60) as r:
            return r.read().decode("utf-8", "replace") if r.status == 200 else None
    except OSError:
        return None


def parse_ids(body: str | None) -> list[str]:
    """Identifiers of a search answer {esearchresult: {idlist}}; none of an answer that is no such JSON."""
    try:
        return [str(i) for i in json.loads(body or "")["esearchresult"]["idlist"]]
    except (ValueError, KeyError, TypeError):
        return []


def parse_articles(body: str | None) -> list[tuple[str, str, str]]:
    """(pmid, title, text) of the PubmedArticle elements that have an identifier and a title.

    The parts of an abstract are joined by spaces, each after its label; marked-up words inside stay."""
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return []
    found = []
    for article in root.iter("PubmedArticle"):
        pmid, title = article.find(".//PMID"), article.find(".//ArticleTitle")
        if pmid is not None and title is not None:
            parts = [(a.get("Label"), "".join(a.itertext())) for a in article.iter("AbstractText")]
            found.append((pmid.text, "".join(title.itertext()).strip(), " ".join(f"{k}: {v}" if k else v for k, v in parts).strip()))
    return found


class AbstractSource(DataSource):
    """``spark.read.format("abstracts")``: each of ``queries`` (a JSON list) is searched at ``search`` and its hits are
    fetched at ``fetch`` as XML, ``batch`` a request; options ``retmax``, ``delay`` seconds after a request, ``key``,
    and ``fixture``, a JSON text {url: body} that stands for the network. A query is a partition."""

    @classmethod
    def name(cls) -> str:
        return "abstracts"

    def schema(self) -> str:
        return "query string, pmid string, title string, text string"

    def reader(self, schema) -> DataSourceReader:
        return AbstractReader(self.options)


class AbstractReader(ArticleReader):
    def read(self, partition: InputPartition):
        o = self.options
        key = {"api_key": o["key"]} if o.get("key") else {}
        ids = parse_ids(self.get(address(o["search"], db="pubmed", term=partition.value, retmax=o.get("retmax", "20"), sort="relevance", retmode="json", **key)))
        batch = int(o.get("batch", "100"))
        for k in range(0, len(ids), batch):
            for article in parse_articles(self.get(address(o["fetch"], db="pubmed", id=",".join(ids[k : k + batch]), retmode="xml", **key))):
                yield (partition.value, *article)

    def get(self, url: str) -> str | None:
        if "fixture" in self.options:
            return json.loads(self.options["fixture"]).get(url)
        body = download(url)
        time.sleep(float(self.options.get("delay", "0.34")))
        return body


Page = tuple[str, str, str]  # url, title, payload


def book_pages(term: str, at: Mapping[str, str], get: Fetch, most: int = 3) -> Iterator[Page]:
    """Chapters of a collection of books whose title has a word of the term, of over three letters; each chapter once."""
    ids = parse_ids(get(address(at["search"], db="books", term=f"{term}[title] AND {at['collection']}[book]", retmode="json")))
    body = get(address(at["summary"], db="books", id=",".join(ids), retmode="json")) if ids else None
    try:
        found = json.loads(body or "{}").get("result", {})
    except ValueError:
        found = {}
    words, seen = [w for w in term.lower().split() if len(w) > 3], set()
    for i in ids:
        item = found.get(i) or {}
        chapter, title = item.get("chapteraccessionid") or item.get("accessionid"), item.get("title") or ""
        if chapter and chapter not in seen and any(w in title.lower() for w in words):
            seen.add(chapter)
            url = f"{at['page']}/{chapter}/"
            if payload := get(url):
                yield url, title, payload
                if (most := most - 1) == 0:
                    return


def topic_pages(term: str, at: Mapping[str, str], get: Fetch) -> Iterator[Page]:
    """The answer of a topic search in XML, if it lists a document."""
    url = address(at["search"], db="healthTopics", term=term, retmax=3)
    body = get(url)
    try:
        if body and ET.fromstring(body).find(".//document") is not None:
            yield url, term, body
    except ET.ParseError:
        return


def encyclopedia_pages(term: str, at: Mapping[str, str], get: Fetch) -> Iterator[Page]:
    """The article of that title, redirects followed, as the interface's JSON with its revision."""
    url = address(at["search"], action="query", format="json", titles=term, prop="extracts|info|revisions", explaintext=1, rvprop="ids|timestamp", redirects=1)
    body = get(url)
    try:
        page = next(iter(json.loads(body or "")["query"]["pages"].values()))
    except (ValueError, KeyError, TypeError, AttributeError, StopIteration):
        return
    if "missing" not in page and page.get("pageid", 0) > 0:
        yield url, page.get("title"), body


SITES = {"book": book_pages, "topic": topic_pages, "encyclopedia": encyclopedia_pages}


def crawl_pages(targets: DataFrame, endpoints: Mapping[str, Mapping[str, str]], get: Fetch = download, delay: float = 0.0) -> DataFrame:
    """(d, kind, term, url, title, payload, sha256, fetched_at, status) of targets (d, kind, term): raw payloads and
    where they come from. A target without a page has one row with status ``none``; kinds are those of ``SITES``.

    Use few partitions where a site limits its requests: ``delay`` holds for each task. Append the result with
    ``stores.append_new`` by (d, kind, url); ``pending`` gives the targets that a manifest lacks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples(index=False):
                pages = list(SITES[t.kind](t.term, endpoints[t.kind], get)) or [(None, None, None)]
                now = datetime.now(timezone.utc).isoformat(timespec="seconds")
                rows = [(t.d, t.kind, t.term, *p, p[2] and hashlib.sha256(p[2].encode()).hexdigest(), now, "ok" if p[0] else "none") for p in pages]
                yield pd.DataFrame(rows, columns=["d", "kind", "term", "url", "title", "payload", "sha256", "fetched_at", "status"])
                time.sleep(delay)

    kind = targets.schema["d"].dataType.simpleString()
    texts = ", ".join(f"{c} string" for c in ("kind", "term", "url", "title", "payload", "sha256", "fetched_at", "status"))
    return targets.select("d", "kind", "term").mapInPandas(run, f"d {kind}, {texts}")


def pending(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Targets (d, kind, ...) that the manifest does not have, found or not: a crawl goes on where it stopped."""
    return targets.join(manifest.select("d", "kind").distinct(), ["d", "kind"], "left_anti")
