"""The JSON of remote embedding services, as expressions, and a provider over any transport."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.providers import EmbeddingProvider, ProviderError, Reply

REPLY = "struct<data:array<struct<embedding:array<double>>>,output_dimension:int,prompt_tokens:int,estimated_prompt_tokens:int,error:struct<message:string>>"
UNKNOWN = "Unknown API error"


def request_json(provider: str, model: str, text: Column) -> Column:
    """The request for one text; the service truncates what is too long."""
    strategy = F.struct(F.lit("truncate").alias("type"))
    return F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), text.alias("input"), strategy.alias("strategy")))


def parse_reply(reply: Column) -> Column:
    """(embedding, dimension, tokens, truncated, error) of a reply; what lacks a vector or its numbers is an error."""
    r = F.from_json(reply, REPLY)
    embedding = F.get(r["data"], F.lit(0))["embedding"]
    whole = embedding.isNotNull() & r["output_dimension"].isNotNull() & r["prompt_tokens"].isNotNull() & r["estimated_prompt_tokens"].isNotNull() & r["error"].isNull()
    return F.struct(
        F.when(whole, embedding).alias("embedding"),
        F.when(whole, r["output_dimension"]).alias("dimension"),
        F.when(whole, r["prompt_tokens"]).alias("tokens"),
        F.when(whole, F.greatest(r["estimated_prompt_tokens"] - r["prompt_tokens"], F.lit(0))).alias("truncated"),
        F.when(~whole | whole.isNull(), F.coalesce(r["error"]["message"], F.lit(UNKNOWN))).alias("error"),
    )


class JsonProvider(EmbeddingProvider):
    """A remote service through ``transport(request) -> reply``, which carries the
    service's address, key and timeouts; this library opens no connection."""

    def __init__(self, model: str, transport: Callable[[str], str] | None = None, service: str = "remote", **settings: object):
        super().__init__(model)
        if transport is None:
            raise ProviderError("a remote provider needs a transport")
        self.transport, self.service = transport, service

    def compute(self, texts: list[str]) -> list[Reply]:
        """A reply for each text.  A transport that raises is tried again by the caller; what the
        service refuses is a reason of that text alone."""
        out = []
        for text in texts:
            request = {"provider": self.service, "model": self.model, "input": text, "strategy": {"type": "truncate"}}
            said = json.loads(self.transport(json.dumps(request, ensure_ascii=False)))
            used, asked = said.get("prompt_tokens") or 0, said.get("estimated_prompt_tokens") or 0
            if said.get("data"):
                out.append(Reply(said["data"][0]["embedding"], used, max(asked - used, 0)))
            else:
                out.append(Reply(None, reason=(said.get("error") or {}).get("message", UNKNOWN)))
        return out
