"""Curated export: what a device is given, in what order, up to its cap, and the transfer."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schemas import CHUNK
from ..sources.store import Collection
from .filters import selection_filter
from .validate import insist

DEVICE_CAP = 500


def term_hits(terms: list[str]) -> Column:
    """How many of a few literal terms the content contains, at most five."""
    if not terms:
        return F.lit(0)
    return F.least(F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower("content"), F.lower(t)))), F.lit(5))


def priority(terms: list[str]) -> Column:
    """Importance (0.5 if unknown) in tenths, then job terms, then the length of the version."""
    return F.coalesce(F.col("importance"), F.lit(0.5)) * 10 + term_hits(terms) + F.least(F.length(F.coalesce("version", F.lit(""))), F.lit(4)) * 0.05


def select_knowledge(chunks: DataFrame, target: Mapping[str, object], *, max_chunks: int = DEVICE_CAP) -> DataFrame:
    """The first ``max_chunks`` of a target's chunks by priority and id, with ``rank``. A top-k: nothing is sorted in whole."""
    rows = chunks.where(selection_filter(target, max_chunks))
    top = rows.withColumn("priority", F.round(priority(list(target.get("job_terms") or [])), 9)).orderBy(F.desc("priority"), "id").limit(max_chunks)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("priority"), "id")))


def summary(chunks: DataFrame, target: Mapping[str, object], *, max_chunks: int = DEVICE_CAP) -> DataFrame:
    """total_available, selected and truncated of a selection, in one row."""
    total = F.count("*").alias("total_available")
    return chunks.where(selection_filter(target, max_chunks)).agg(total).select("total_available", F.least("total_available", F.lit(max_chunks)).alias("selected"), (F.col("total_available") > max_chunks).alias("truncated"))


FORMAT = "fieldmark-package-1"


@dataclass(frozen=True)
class Package:
    """What a device is given: a header of one row (format, target, total_available, selected, truncated), and its items by rank."""

    header: DataFrame
    items: DataFrame


def build_package(chunks: DataFrame, target: Mapping[str, object], *, max_chunks: int = DEVICE_CAP) -> Package:
    """The package of a target; the same rows and target always give the same one."""
    told = json.dumps({k: v for k, v in target.items() if v is not None}, sort_keys=True)
    header = summary(chunks, target, max_chunks=max_chunks).select(F.lit(FORMAT).alias("format"), F.lit(told).alias("target"), "total_available", "selected", "truncated")
    return Package(header, select_knowledge(chunks, target, max_chunks=max_chunks))


def transfer(selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, documents) of a selection: chunk records with defaults, their vectors as they are, of which one that breaks its contract
    (no vector, say) raises; and how many of each document there are."""
    has = set(selected.columns)
    rows = selected.withColumns({"version": F.coalesce("version", F.lit("1")), "jev_status": F.coalesce(F.nullif("jev_status", F.lit("")), F.lit("not_applicable"))})
    rows = insist(rows.select(*[(F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK.fields], *[c for c in ("rank",) if c in has]), "chunk")
    return rows, rows.groupBy("document_id").agg(F.count("*").alias("transferred"), F.min("rank").alias("first_rank"))


def provision_device(chunks: DataFrame, target: Mapping[str, object], edge: Collection, *, max_chunks: int = DEVICE_CAP) -> dict[str, object]:
    """Select, package and transfer into the ``edge`` collection of chunks, where each document given replaces that of its id; giving the
    same again changes nothing. Nothing found is no error. The package's counts, and how many chunks and documents were transferred."""
    package = build_package(chunks, target, max_chunks=max_chunks)
    records, documents = transfer(package.items)
    report = package.header.first().asDict()
    if report["selected"]:
        edge.replace(records, "document_id")
    return {**report, **documents.agg(F.coalesce(F.sum("transferred"), F.lit(0)).alias("transferred"), F.count("*").alias("documents")).first().asDict()}
