"""The filter language: equality, membership and text clauses under must, should and must_not; and filters built of options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from ..functions.text import matches_all_tokens

#: Option name: column.
METADATA = {"asset_id": "asset_id", "equipment_model": "equipment_model", "component": "component", "doc_type": "doc_type", "doc_version": "version", "applicable_to": "applicability"}
CLOUD_METADATA = {k: v for k, v in METADATA.items() if k != "applicable_to"}


def equals(column: str, value: str) -> Column:
    """A null field equals nothing."""
    return F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def any_of(column: str, values: Sequence[str], *, array: bool = False) -> Column:
    """The field, or one element of an array field, is among the values; null and empty fields are not."""
    hit = F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])) if array else F.col(column).isin(*values)
    return F.coalesce(hit, F.lit(False))


def text(column: str, words: str) -> Column:
    return matches_all_tokens(F.col(column), F.lit(words))


def combine(must: Sequence[Column] = (), should: Sequence[Column] = (), must_not: Sequence[Column] = ()) -> Column:
    """All of ``must``, at least one of ``should`` if there are any, and none of ``must_not``."""
    parts = [*must, *([reduce(or_, should)] if should else []), *[~c for c in must_not]]
    return reduce(and_, parts) if parts else F.lit(True)


def metadata_filter(options: Mapping[str, object] | None, *, allowed: Mapping[str, str] = METADATA) -> Column:
    """The conjunction of the options given; unknown ones are errors, none or an empty ``applicable_to`` filter nothing."""
    options = options or {}
    if unknown := sorted(set(options) - set(allowed)):
        raise ValueError(f"unknown filter fields: {', '.join(unknown)} (allowed: {', '.join(allowed)})")
    must = []
    for name, value in options.items():
        if name == "applicable_to":
            if value:
                must.append(any_of(allowed[name], list(value), array=True))
        elif value is not None:
            must.append(equals(allowed[name], str(value)))
    return combine(must)


def selection_filter(target: Mapping[str, object], max_chunks: int) -> Column:
    """What a device may be given: trusted chunks in the target's scope that hold a job term, if it has any. No scope is refused."""
    scope = ("asset_id", "equipment_model", "component")
    if not isinstance(max_chunks, int) or isinstance(max_chunks, bool) or max_chunks <= 0:
        raise ValueError("max_chunks must be a positive integer")
    if unknown := sorted(set(target) - {*scope, "job_terms"}):
        raise ValueError(f"unknown target fields: {', '.join(unknown)}")
    if all(v is None for v in target.values()):
        raise ValueError("a target needs an asset, a model, a component or job terms: the whole store is never provisioned")
    terms = target.get("job_terms") or []
    if not isinstance(terms, (list, tuple)) or not all(isinstance(t, str) and t.strip() for t in terms):
        raise ValueError("job_terms must be non-blank strings")
    must = [equals("jev_status", "not_applicable")]
    for name in scope:
        value = target.get(name)
        if value is not None:
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"{name} must be a non-blank string")
            must.append(equals(name, value))
    return combine(must, [text("content", t) for t in terms])
