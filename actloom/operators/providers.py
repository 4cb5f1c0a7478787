"""Providers of models: resolution of their settings, and clients over an injected transport.

No network is used here: a transport is a function that takes a path and a
request body and gives the response body; what it raises is a failed request.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from actloom.operators.registry import Field, checked
from actloom.operators.vectors import embed

Transport = Callable[[str, dict], dict]
REMOTE = (Field("base_url", required=True), Field("api_key", default=""), Field("model", required=True))
#: Model types by provider type, each with its settings.
TYPES: dict[str, dict[str, tuple[Field, ...]]] = {
    "mock": {"embedding": (Field("mock_dim", "number", 4096, least=1),)},
    "ollama": {"embedding": REMOTE, "cross-encoder": REMOTE},
    "openai": {"embedding": REMOTE},
}
PROBE = "dimension probe"
# Names under which rerank servers give a score.
SCORES = ("relevance_score", "score")
#: Parameters of requests.
LEAST_BATCH, RETRIES, WAIT = 16, 2, 1.0


@dataclass(frozen=True)
class Target:
    provider: str
    model_type: str
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    mock_dim: int | None = None


def as_uuid(value: Column) -> Column:
    """A UUID in its usual form, in small letters; NULL for anything else."""
    hexed = F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"^(?:urn:)?(?:uuid:)?\{?|\}?$", ""), "-", ""))
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def target_of(snapshot: dict | None) -> Target:
    """The provider a run's snapshot names; settings stand in `config` or, in older runs, beside the type. ValueError for none or an unknown one."""
    own = snapshot or {}
    provider, model_type = own.get("provider_type", ""), own.get("model_type") or "embedding"
    fields = TYPES.get(provider, {}).get(model_type)
    if fields is None:
        raise ValueError(f"no provider for {model_type!r} of type {provider!r}")
    values = checked(fields, own.get("config") or own)
    return Target(provider, model_type, values.get("model") or "", values.get("base_url") or "", values.get("api_key") or "", values.get("mock_dim"))


def provider_id(value: object) -> str:
    """A provider's id from a request; ValueError for one that is missing or malformed."""
    if value in (None, ""):
        raise ValueError("a provider is required")
    try:
        return str(uuid.UUID(str(value)))
    except ValueError:
        raise ValueError(f"malformed provider id: {value!r}") from None


def reranker_of(key: object, providers: Callable[[str], dict | None]) -> Target:
    """The reranker a request selects: its id is well formed, it is known, and its model is a cross-encoder; ValueError else."""
    own = providers(provider_id(key))
    if own is None:
        raise ValueError("unknown reranker")
    if own.get("model_type") != "cross-encoder":
        raise ValueError(f"a reranker is a cross-encoder, not {own.get('model_type')!r}")
    return target_of(own)


def ordered(items: list[dict], n: int, value: Callable[[dict], object], partial: str) -> list:
    """Values of response items at the places their `index` names; ValueError unless each of n places has one."""
    out: list = [None] * n
    filled = set()
    for item in items:
        at = item.get("index")
        if isinstance(at, int) and not isinstance(at, bool) and 0 <= at < n:
            out[at] = value(item)
            filled.add(at)
    if len(filled) != n:
        raise ValueError(f"{partial}: {len(filled)} of {n}")
    return out


def score_of(item: dict) -> float:
    for name in SCORES:
        if name in item:
            return float(item[name])
    raise ValueError("a result without a score")


class Embedder:
    """Vectors of texts from a provider; `dim` is found once by embedding a probe."""

    def __init__(self, target: Target, send: Transport | None = None, wait: float = WAIT):
        self.target, self.send, self.wait = target, send, wait
        self._dim: int | None = target.mock_dim

    @property
    def dim(self) -> int:
        if self._dim is None:
            self._dim = len(self.encode([PROBE])[0])
        return self._dim

    def encode(self, texts: list[str], batch: int = 32) -> list[list[float]]:
        """One vector per text; blank texts are sent as one blank. A failed request is repeated; the last failure is raised."""
        if self.target.provider == "mock":
            return embed(texts, self.dim).tolist()
        out: list[list[float]] = []
        step = max(batch, LEAST_BATCH)
        for at in range(0, len(texts), step):
            out += self._sent([t if t and t.strip() else " " for t in texts[at : at + step]])
        return out

    def _sent(self, texts: list[str]) -> list[list[float]]:
        body = {"model": self.target.model, "input": texts}
        for left in range(RETRIES, -1, -1):
            try:
                found = self.send("api/embed" if self.target.provider == "ollama" else "embeddings", body)
                if self.target.provider == "ollama":
                    vectors = found["embeddings"]
                    if len(vectors) != len(texts):
                        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                    return vectors
                return ordered(found["data"], len(texts), lambda x: x["embedding"], "vectors are missing")
            except Exception:  # noqa: BLE001 - any failure of a request may pass
                if not left:
                    raise
                time.sleep(self.wait)
        return []


def rerank_scores(target: Target, send: Transport, query: str, texts: list[str]) -> list[float]:
    """A score per text, in their order; ValueError where the response leaves one out. No request for no text."""
    if not texts:
        return []
    found = send("rerank", {"model": target.model, "query": query, "documents": texts})
    return ordered(found.get("results", []), len(texts), score_of, "the ranking is partial")
