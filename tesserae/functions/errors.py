"""What an error message of a model endpoint means."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of messages.
OVERFLOW = ("context length", "maximum context length", "exceeds context window", "token limit", "too many tokens", "reduce the length of the messages", "max tokens", "prompt too long", "input too long", "payload too large", "413")
AUTH = ("unauthorized", "invalid api key", "401", "403", "authentication", "permission denied")
NO_MODEL = ("no models loaded", "model_not_found", "model not found", "404")
UNSUPPORTED = (
    "404", "not found", "405", "method not allowed", "responses.create", "unknown parameter", "unexpected argument", "unrecognized field",
    "invalid request body", "schema validation", "unsupported field", "does not support reasoning", "unsupported parameter",
)


#: Classes in the order in which they are tried: any of the parts must be there, and all of the further ones.
RULES = (("model", NO_MODEL, ("model",)), ("auth", AUTH, ()), ("unsupported", UNSUPPORTED, ()), ("overflow", OVERFLOW, ()))


def error_class(c: Column) -> Column:
    """model, auth, unsupported, overflow or other: the first that applies. Null is other."""
    low, out = F.lower(c), F.lit("other")
    for name, parts, also in reversed(RULES):
        there = reduce(or_, map(low.contains, parts))
        out = F.when(reduce(and_, map(low.contains, also), there), name).otherwise(out)
    return out


def message_class(message: str) -> str:
    """error_class for one message."""
    m = message.lower()
    return next((name for name, parts, also in RULES if any(p in m for p in parts) and all(p in m for p in also)), "other")


ADVICE = {
    "model": "The endpoint answers but has no such model loaded: load one, name another, or run retrieval only.",
    "auth": "The endpoint refused the credentials: pass a valid key.",
    "unsupported": "The endpoint does not offer the call that was made: choose another model or interface, or run retrieval only.",
    "overflow": "The context is still too long after all attempts: ask for fewer passages.",
    "other": "The call to the model failed: check the endpoint, or run retrieval only.",
}


def advice(c: Column) -> Column:
    """A sentence of advice for an error message."""
    kinds = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return F.element_at(kinds, error_class(c))
