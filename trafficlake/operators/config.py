"""Configuration specs parsed on the driver (a handful of short strings, never data)."""

from __future__ import annotations

import posixpath

# Endpoint suffixes per API family and their operation labels.
ENDPOINTS = [
    ("openai", "/v1/chat/completions", "chat"),
    ("openai", "/v1/completions", "completion"),
    ("openai", "/v1/embeddings", "embeddings"),
    ("openai", "/v1/responses", "responses"),
    ("openai", "/v1/audio/speech", "speech"),
    ("openai", "/v1/images/generations", "image_generation"),
    ("openai", "/v1/models", "models"),
    ("cohere", "/v2/rerank", "rerank"),
    ("anthropic", "/v1/messages", "messages"),
]
# Default path prefixes.
DEFAULT_PREFIXES = {"openai": "/", "cohere": "/cohere", "anthropic": "/anthropic"}
# Fixed value: default header-to-attribute mapping of spans and access logs.
DEFAULT_SESSION_MAPPING = "agent-session-id:session.id"


def _pairs(spec: str, what: str) -> list[tuple[str, str]]:
    out = []
    for n, piece in enumerate(spec.split(","), start=1):
        left, sep, right = piece.strip().partition(":")
        if not piece.strip():
            raise ValueError(f"{what}: empty pair at position {n}")
        if not sep:
            raise ValueError(f"{what}: pair {piece.strip()!r} at position {n} has no ':'")
        out.append((left.strip(), right.strip()))
    return out


def parse_endpoint_prefixes(spec: str = "") -> dict[str, str]:
    """``openai:/,cohere:/cohere`` to a prefix per API family; unknown families are an error."""
    prefixes = dict(DEFAULT_PREFIXES)
    if spec:
        for family, prefix in _pairs(spec, "endpoint prefixes"):
            if family not in prefixes:
                raise ValueError(f"endpoint prefixes: unknown family {family!r}")
            prefixes[family] = prefix
    return prefixes


def endpoint_paths(spec: str = "", root: str = "/") -> dict[str, str]:
    """Full request path to operation label."""
    prefixes = parse_endpoint_prefixes(spec)
    out = {}
    for family, suffix, operation in ENDPOINTS:
        joined = "/".join([root, prefixes[family], suffix])
        out["/" + posixpath.normpath(joined).lstrip("/")] = operation
    return out


def parse_header_mapping(spec: str | None) -> dict[str, str]:
    """``header:attribute,...``; a blank pair or a blank side is an error."""
    if not spec:
        return {}
    mapping = {}
    for header, attribute in _pairs(spec, "header mapping"):
        if not header or not attribute:
            raise ValueError(f"header mapping: blank side in {header!r}:{attribute!r}")
        mapping[header] = attribute
    return mapping


def format_header_mapping(mapping: dict[str, str]) -> str:
    return ",".join(f"{h}:{mapping[h]}" for h in sorted(mapping))


def resolve_header_mappings(
    base: str | None = None, span: str | None = None, metrics: str | None = None, log: str | None = None
) -> dict[str, dict[str, str]]:
    """Merge the base mapping with the per-signal overrides.

    Spans and logs default to the session mapping unless given (an explicit empty string clears it);
    metrics have no default.
    """
    common = parse_header_mapping(base)
    chosen = {
        "span": DEFAULT_SESSION_MAPPING if span is None else span,
        "metrics": metrics or "",
        "log": DEFAULT_SESSION_MAPPING if log is None else log,
    }
    return {k: {**common, **parse_header_mapping(v)} for k, v in chosen.items()}
