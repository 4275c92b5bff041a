"""Stable record identities: length-prefixed, null-safe preimages and their SHA-256."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the formats that identities and events are hashed from
IDENTITY_PREFIX = "dqm-id-v1|"
EVENT_PREFIX = "dqm-event-v1|"


def normalised(value: Column) -> Column:
    """A grain value as text, trimmed and lower-cased; null stays null."""
    return F.lower(F.trim(value.cast("string")))


def _length_prefixed(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("n|")).otherwise(F.concat(F.lit("s"), F.length(value).cast("string"), F.lit(":"), value, F.lit("|")))


def canonical_identity(pairs: Mapping[str, Column]) -> Column:
    """The preimage of an identity; lengths count code points."""
    parts = [F.lit(IDENTITY_PREFIX)]
    for key, value in pairs.items():
        parts += [F.lit(f"k{len(key)}:{key}|"), _length_prefixed(value)]
    return F.concat(*parts)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def identity_hash(pairs: Mapping[str, Column]) -> Column:
    return sha256_hex(canonical_identity(pairs))


def grain_of(columns: Sequence[str]) -> list[str]:
    """Grain names trimmed and lower-cased; refuses blanks, repeats and non-strings."""
    names = [c.strip().lower() for c in columns if isinstance(c, str)]
    if not names or len(names) != len(columns) or "" in names or len(set(names)) != len(names):
        raise ValueError("the grain must be a non-empty list of distinct column names")
    return names


def scheme_signature(grain: Sequence[str]) -> str:
    return IDENTITY_PREFIX + "".join(f"k{len(key)}:{key}|" for key in grain_of(grain))


def granularity_signature(grain: Sequence[str]) -> str:
    return json.dumps(grain_of(grain), separators=(",", ":"), ensure_ascii=False)


def canonical_signature(signature: str | None) -> str | None:
    """A legacy JSON grain signature in the canonical form; canonical ones stay, others are refused."""
    if signature is None or signature.startswith(IDENTITY_PREFIX):
        return signature
    grain = json.loads(signature)
    if not isinstance(grain, list):
        raise ValueError("a grain signature must be a JSON array")
    return scheme_signature(grain)


def event_id(*fields: Column) -> Column:
    """The id of an event, from check, occurrence, invocation and type."""
    return sha256_hex(F.concat(F.lit(EVENT_PREFIX), *[_length_prefixed(f) for f in fields]))


def occurrence_id(check_id: Column, identity: Column, first_invocation: Column) -> Column:
    return sha256_hex(F.concat_ws("|", check_id, identity, first_invocation))


def payload_digest(payload: Column) -> Column:
    return F.when(payload.isNotNull(), sha256_hex(payload))
