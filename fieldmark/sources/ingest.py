"""Documents to chunk records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import MAX_CHARS, OVERLAP_CHARS, chunk_text
from ..functions.vector import Embedder, embed_with, hash_embed
from ..operators.validate import insist
from .store import Collection

_OPTIONAL = {"equipment_model": "string", "doc_type": "string", "applicability": "array<string>", "keywords": "array<string>"}


def ingest(documents: DataFrame, *, now: str, cloud: bool = False, provider: Embedder | None = None, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Chunk records of ``documents(document_id, text, asset_id, component, source[, version, ...])``; in the cloud they are stamped as
    trusted. Ids are hashes of document, version and place; vectors come from the provider, or else the hashing embedder."""
    has = set(documents.columns)
    chunks = documents.withColumn("__c", F.explode(F.transform(chunk_text(F.col("text"), max_chars, overlap_chars), lambda c, i: F.struct(i.alias("i"), c.alias("c")))))
    version = F.coalesce("version", F.lit("1")) if "version" in has else F.lit("1")
    rows = chunks.select(
        F.substring(F.sha2(F.concat_ws("\x00", "document_id", version, F.col("__c.i").cast("string")), 256), 1, 32).alias("id"), "document_id", version.alias("version"), F.col("__c.c").alias("content"), "asset_id", "component", "source", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
        *[(F.col(c) if c in has else F.lit(None).cast(t)).alias(c) for c, t in _OPTIONAL.items()], (F.lit("not_applicable") if cloud else F.lit(None).cast("string")).alias("jev_status"),
    )
    return embed_with(rows, "content", provider) if provider else rows.withColumn("embedding", hash_embed(F.col("content")))


def store_documents(documents: DataFrame, chunks: Collection, **options) -> None:
    """Ingest ``documents`` into a collection, in place of what it holds of each: one that is blank now has no chunks any more. Chunks that
    break their contract raise, and then nothing is written."""
    records = insist(ingest(documents, **options), "chunk")
    chunks.replace(records, "document_id", documents)
