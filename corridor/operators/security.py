"""Payload encryption with rotating keys.

* Rotation bucket = ``timestamp div 300`` (a key per 5 minutes).
* Keys: PBKDF2-HMAC-SHA256 (100,000 rounds, 32 bytes) of
  ``<secret>_<bucket>`` with a 16-byte salt derived from the bucket and a
  salt seed.  Derivation runs on the executors (``mapInPandas`` over the
  distinct buckets), never on the driver; the key table holds one row per
  bucket and is joined like any dimension (AQE picks the strategy).
* Payloads: ``base64(aes_encrypt(to_json(payload), key, 'GCM'))`` — real
  AES-256-GCM — and ``try_aes_decrypt`` + ``from_json`` back; a failure
  (wrong key, damaged text) yields null instead of an exception.
* Fingerprint: first 16 hex digits of SHA-256 of the key.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROTATION_SECONDS = 300
PBKDF2_ROUNDS = 100_000
KEY_BYTES = 32
SALT_BYTES = 16


def rotation_bucket(seconds: str | Column = "timestamp") -> Column:
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(c / ROTATION_SECONDS).cast("long")


def derive_key(secret: str, bucket: int, salt_seed: str, rounds: int = PBKDF2_ROUNDS) -> bytes:
    salt = hashlib.sha256(f"{salt_seed}:{bucket}".encode()).digest()[:SALT_BYTES]
    return hashlib.pbkdf2_hmac("sha256", f"{secret}_{bucket}".encode(), salt, rounds, KEY_BYTES)


def key_table(df: DataFrame, secret: str, salt_seed: str, rounds: int = PBKDF2_ROUNDS,
              seconds: str = "timestamp") -> DataFrame:
    """One derived key per rotation bucket present in ``df``."""
    from ..session import cpu_partitions
    buckets = df.select(rotation_bucket(seconds).alias("rotation_bucket")).distinct()
    # PBKDF2 is CPU bound: spread the (small) bucket list round-robin over at
    # least one partition per core; an explicit count is kept by AQE
    buckets = buckets.repartition(cpu_partitions(df.sparkSession))

    def derive(it):
        for pdf in it:
            keys = [derive_key(secret, int(b), salt_seed, rounds) for b in pdf["rotation_bucket"]]
            yield pd.DataFrame({"rotation_bucket": pdf["rotation_bucket"], "key": keys})

    schema = T.StructType([T.StructField("rotation_bucket", T.LongType()), T.StructField("key", T.BinaryType())])
    keys = buckets.mapInPandas(derive, schema)
    return keys.withColumn("key_fingerprint", F.substring(F.sha2(F.col("key"), 256), 1, 16))


def encrypt(payload: Column, key: Column) -> Column:
    """JSON text of ``payload`` -> AES-256-GCM -> base64 text."""
    return F.base64(F.aes_encrypt(F.to_json(payload), key, F.lit("GCM")))


def decrypt(token: Column, key: Column, schema: T.DataType | str) -> Column:
    """base64 -> AES-GCM decrypt -> parsed payload; null on any failure."""
    raw = F.try_aes_decrypt(F.unbase64(token), key, F.lit("GCM"))
    return F.from_json(raw.cast("string"), schema)


def encrypted_payloads(readings: DataFrame, payload: Column, secret: str, salt_seed: str,
                       rounds: int = PBKDF2_ROUNDS) -> DataFrame:
    """Encrypt each row's payload with the key of its rotation bucket."""
    keys = key_table(readings, secret, salt_seed, rounds)
    r = readings.withColumn("rotation_bucket", rotation_bucket("timestamp"))
    return (r.join(keys, "rotation_bucket")
             .withColumn("token", encrypt(payload, F.col("key"))))
