"""Reversible replacement: numbered tokens per session, and encrypted values bound to their document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tokens(seen: DataFrame, *session: str) -> DataFrame:
    """seen(session..., ord, plaintext, entity_type) to a row per session and value with its token.

    A value keeps the type of its first sighting, whatever later ones say; the values of a type are
    numbered from 1 by first sighting. Null values have no token; ties in ord go to the smaller value.
    """
    first = F.min(F.struct("ord", "entity_type")).alias("f")
    values = seen.filter("plaintext is not null").groupBy(*session, "plaintext").agg(first)
    values = values.select(*session, "plaintext", F.col("f.entity_type").alias("entity_type"), F.col("f.ord").alias("first_ord"))
    number = F.row_number().over(Window.partitionBy(*session, "entity_type").orderBy("first_ord", "plaintext"))
    return values.withColumn("token", F.format_string("[%s_%d]", "entity_type", number))


def continued(seen: DataFrame, known: DataFrame, *session: str) -> DataFrame:
    """Tokens of new values only, numbered after those of `known`, an earlier result for the sessions."""
    joined = [*session, "plaintext"]
    fresh = tokens(seen.join(known.select(*joined), joined, "left_anti"), *session)
    last = known.groupBy(*session, "entity_type").agg(F.max(F.regexp_extract("token", r"_(\d+)\]$", 1).cast("long")).alias("last"))
    number = F.regexp_extract("token", r"_(\d+)\]$", 1).cast("long") + F.coalesce("last", F.lit(0))
    return fresh.join(last, [*session, "entity_type"], "left").withColumn("token", F.format_string("[%s_%d]", "entity_type", number)).drop("last")


def recovered(texts: DataFrame, vault: DataFrame, *session: str) -> DataFrame:
    """Values of tokens: texts(session..., token) with plaintext, null where the vault has none."""
    return texts.join(vault.select(*session, "token", "plaintext"), [*session, "token"], "left")


def encrypted(regions: DataFrame, key: bytes, value_col: str = "plaintext", doc_col: str = "doc_id") -> DataFrame:
    """The value column as ciphertext: AES in GCM mode, a fresh nonce per value, bound to the document's id.
    The key has 32 bytes. Only ciphertexts leave; null values stay null."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    value, doc = F.col(value_col).cast("string"), F.col(doc_col).cast("string")
    secret = F.when(value.isNotNull(), F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), doc))
    return regions.withColumn("ciphertext", secret).drop(value_col)


def decrypted(regions: DataFrame, key: bytes, doc_col: str = "doc_id") -> DataFrame:
    """The plaintext of encrypted regions; null where the key or the document's id is wrong."""
    doc = F.col(doc_col).cast("string")
    return regions.withColumn("plaintext", F.try_aes_decrypt("ciphertext", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), doc).cast("string")).drop("ciphertext")
