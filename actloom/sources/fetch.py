"""Fetching over an injected getter, in Arrow batches; no network is used here."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.functions.urls import SUPPORTED_TYPES, extension, failure_class, media_type, type_allowed

#: Parameters of a fetch: the largest body, seconds to connect and to read, and redirects followed.
MOST_BYTES = 10 * 1024 * 1024
TIMEOUTS = (5.0, 30.0)
MOST_REDIRECTS = 20
RESULT = "url string, http_status int, content_type string, content string, final_url string, redirect_chain array<string>, error string"
COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


class Permanent(ValueError):
    """A failure that another attempt would meet again: a broken URL, a certificate that is refused, too many redirects, too large a body."""


@dataclass
class Response:
    """One answer of a server: where it leads for a redirect, else its body in parts, of the length it states."""

    status: int
    content_type: str | None = None
    parts: Iterable[bytes] = field(default_factory=list)
    length: int | None = None
    location: str | None = None


Getter = Callable[[str, tuple[float, float]], Response]


def body_of(response: Response, most: int) -> bytes:
    """The body, read no further than the limit; one over it, or stated to be, is a permanent failure."""
    if response.length is not None and response.length > most:
        raise Permanent("oversize")
    held, size = [], 0
    for part in response.parts:
        size += len(part)
        if size > most:
            raise Permanent("oversize")
        held.append(part)
    return b"".join(held)


def followed(getter: Getter, url: str, most: int, timeouts: tuple[float, float] = TIMEOUTS) -> tuple[Response, bytes, str, list[str]]:
    """The answer after redirects, its body, its URL, and the URLs passed before it."""
    chain: list[str] = []
    while True:
        response = getter(url, timeouts)
        if response.location is None:
            return response, body_of(response, most) if response.status < 400 else b"", url, chain
        if len(chain) == MOST_REDIRECTS or response.location in (*chain, url):
            raise Permanent("too many redirects")
        chain.append(url)
        url = response.location


def fetch(targets: DataFrame, getter: Getter, url: str = "normalized_url", most: int = MOST_BYTES, allowed: list[str] | None = None) -> DataFrame:
    """Fetched pages with their decision: `fetched`, `failed_transient`, `failed_permanent` or `skipped_unsupported`.

    What the getter raises is transient, ValueErrors are permanent. Bytes that
    are no UTF-8 become U+FFFD. A NULL URL is a permanent failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u in pdf["url"]:
                try:
                    if not u:
                        raise Permanent("no URL")
                    response, body, final, chain = followed(getter, u, most)
                    rows.append((u, response.status, response.content_type, body.decode("utf-8", "replace"), final, chain, None))
                except ValueError as e:
                    rows.append((u, None, None, None, None, None, f"permanent: {e}"))
                except Exception as e:  # noqa: BLE001 - any failure of a getter is a row
                    rows.append((u, None, None, None, None, None, f"transient: {e}"))
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"http_status": "Int32"})

    pages = targets.select(F.col(url).alias("url")).mapInPandas(run, RESULT)
    failed = F.coalesce(failure_class(F.col("http_status")), F.when(F.col("error").startswith("transient"), "transient").when(F.col("error").isNotNull(), "permanent"))
    usable = F.coalesce(media_type(F.col("content_type")).isin(*SUPPORTED_TYPES), F.lit(False)) & type_allowed(F.col("content_type"), allowed or [])
    return pages.withColumn("status", F.when(failed.isNotNull(), F.concat(F.lit("failed_"), failed)).when(~usable, "skipped_unsupported").otherwise("fetched")).withColumn("extension", extension(F.col("content_type")))
