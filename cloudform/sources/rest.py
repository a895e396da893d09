"""Pages of a REST endpoint as a Spark data source: one partition for each set of parameters, each record as JSON text."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import safe_url

RETRIED = (429, 500, 502, 503, 504)


def _open(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def fetch(url: str, *, tries: int = 8, most: float = 60, timeout: float = 30, most_total: float = 900, sleep: Callable[[float], None] = time.sleep, get: Callable[[str, float], bytes] = _open) -> dict:
    """The JSON object at url. Limits, server errors and network errors are tried again after a growing pause.

    A Retry-After in seconds is kept up to `most`, and all pauses together up to `most_total`. Errors name the url
    without its keys and addresses.
    """
    waited = 0.0
    for i in range(tries):
        pause, why = min(most, 2.0**i), ""
        try:
            return json.loads(get(url, timeout))
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED:
                raise RuntimeError(f"status {e.code} of {safe_url(url)}") from None
            after = (e.headers or {}).get("Retry-After", "")
            pause, why = min(most, float(after)) if str(after).isdigit() else pause, f"status {e.code}"
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            why = type(e).__name__
        if waited + pause > most_total:
            raise RuntimeError(f"{why} of {safe_url(url)} after {waited:.0f} s of pauses")
        if i < tries - 1:
            waited += pause
            sleep(pause)
    raise RuntimeError(f"{why} of {safe_url(url)} after {tries} tries")


def address(url: str, params: dict) -> str:
    return f"{url}?{urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})}"


def composed(where: dict | None = None, *, select: list[str] | None = None, sample: int | None = None, seed: int | None = None, group_by: str | None = None, year: int | None = None, years: tuple[int, int] | None = None, size: int | None = None) -> dict:
    """Parameters of a request: a filter (lists are alternatives, booleans lower case, None left out), columns, a seeded sample
    or a grouping, which exclude each other."""
    if sample and group_by:
        raise ValueError("a sample or a grouping, not both")
    terms = {k: "|".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v for k, v in (where or {}).items() if v is not None and v != []}
    if year is not None:
        terms["publication_year"] = year
    elif years:
        terms["publication_year"] = f"{years[0]}-{years[1]}"
    out = {"filter": ",".join(f"{k}:{v}" for k, v in terms.items()) or None, "select": ",".join(select) if select else None, "sample": sample, "seed": seed if sample else None, "group_by": group_by, "per-page": size}
    return {k: v for k, v in out.items() if v is not None}


def sampled(url: str, params: dict, n: int, *, size: int = 200, results: str = "results", **how) -> Iterator[dict]:
    """Records of a seeded sample page by page by number, until n have come or a page is short."""
    came, page = 0, 1
    while came < n:
        found = (fetch(address(url, params | {"per-page": size, "page": page}), **how).get(results) or [])[: n - came]
        yield from found
        came, page = came + len(found), page + 1
        if len(found) < size:
            return


def count(url: str, params: dict, **how) -> int:
    """How many records match, from a request for a single one."""
    return int(fetch(address(url, params | {"per-page": 1}), **how)["meta"]["count"])


def pages(url: str, params: dict, *, size: int = 200, rate: float = 5, results: str = "results", limit: int | None = None, sleep: Callable[[float], None] = time.sleep, **how) -> Iterator[dict]:
    """Records page by page until the cursor ends, a page is empty or `limit` records have come; at most `rate` requests a second."""
    cursor, came = "*", 0
    while cursor and (limit is None or came < limit):
        began = time.monotonic()
        body = fetch(address(url, params | {"per-page": size, "cursor": cursor}), sleep=sleep, **how)
        found = body.get(results) or []
        yield from found if limit is None else found[: limit - came]
        came += len(found)
        cursor = (body.get("meta") or {}).get("next_cursor") if found else None
        if cursor:
            sleep(max(0.0, 1 / rate - (time.monotonic() - began)))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(i) for i in range(len(json.loads(self.options["params"])))]

    def read(self, partition):
        o = self.options
        params = json.loads(o["params"])
        limit = int(o["limit"]) if "limit" in o else None
        some = pages(o["url"], params[partition.value], size=int(o.get("size", 200)), rate=float(o.get("rate", 5)) / len(params), results=o.get("results", "results"), limit=limit)
        yield from ((partition.value, json.dumps(r)) for r in some)


class PagedSource(DataSource):
    """Options: url, params (a JSON list of objects, one for each partition), size, rate, results, limit (by partition).

    The rate is dealt evenly over the partitions, so all tasks together keep to it. A task that is lost reads its
    partition again from the first page.
    """

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return "part int, record string"

    def reader(self, schema):
        return PagedReader(self.options)


def read_pages(spark: SparkSession, url: str, params: list[dict], **options):
    """(part, record): part is the place in params, record one result as JSON text for from_json."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(url=url, params=json.dumps(params), **options).load()
