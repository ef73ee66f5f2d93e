"""Pseudonymisation, encryption and row-level access.

* P1 HMAC-SHA256 is built from ``sha2`` over binary concatenations with the two key pads
  precomputed on the driver from the key parameter — a JVM expression, no Python UDF.
* P2/P3 use Spark's ``aes_encrypt``/``try_aes_decrypt`` in GCM mode, whose output layout
  (12-byte nonce, ciphertext, 16-byte tag) matches the studied system's.
* Keys are parameters and end up as literals in the plan; ``session.get_spark`` sets
  ``spark.sql.redaction.string.regex`` so that long hex literals are hidden from explained plans.
"""

from __future__ import annotations

import base64
import binascii
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadscope.functions import fixed

AUDIT_FIELDS = ["age", "weight_kg", "height_cm", "weekly_volume_hrs", "weekly_intensity_score", "sleep_hours",
                "hrv_ms", "soreness_score", "rest_days", "prior_injuries", "days_since_last_injury", "sport",
                "position"]


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(c: Column, key: str) -> Column:
    """Lower-case hex HMAC-SHA256 of the UTF-8 text in ``c``."""
    ipad, opad = _pads(key.encode("utf-8"))
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)


def pseudonymize(df: DataFrame, col: str, key: str, out: str = "athlete_pseudonym") -> DataFrame:
    """``PSN-`` + upper(first 12 hex chars of HMAC-SHA256(key, id))."""
    h = hmac_sha256_hex(F.col(col), key)
    return df.withColumn(out, F.concat(F.lit(fixed.PSEUDONYM_PREFIX),
                                       F.upper(F.substring(h, 1, fixed.PSEUDONYM_HEX_CHARS))))


def derive_aes_key(key_text: str) -> bytes:
    """Base64 text -> 32 bytes if it decodes to 32 bytes, else SHA-256 of the decoded bytes;
    text that is not base64 -> SHA-256 of its UTF-8 bytes."""
    try:
        raw = base64.b64decode(key_text, validate=True)
        return raw if len(raw) == 32 else hashlib.sha256(raw).digest()
    except (binascii.Error, ValueError):
        return hashlib.sha256(key_text.encode("utf-8")).digest()


def encrypt_struct(df: DataFrame, cols: list[str], key_text: str, out: str = "encrypted_biometrics") -> DataFrame:
    """base64(nonce || AES-256-GCM(JSON of the columns, NULLs kept) || tag)."""
    key = F.lit(derive_aes_key(key_text))
    payload = F.encode(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}), "UTF-8")
    return df.withColumn(out, F.base64(F.aes_encrypt(payload, key, F.lit("GCM"))))


def decrypt_struct(df: DataFrame, col: str, schema: T.StructType | str, key_text: str,
                   out: str = "decrypted") -> DataFrame:
    """NULL for short (< 13 bytes), malformed or tampered input; else the parsed struct."""
    key = F.lit(derive_aes_key(key_text))
    raw = F.try_to_binary(F.col(col), F.lit("base64"))
    plain = F.when(F.length(raw) >= 13, F.try_aes_decrypt(raw, key, F.lit("GCM")))
    return df.withColumn(out, F.from_json(F.decode(plain, "UTF-8"), schema))


def audit_rows(scored: DataFrame, key_text: str, hmac_key: str) -> DataFrame:
    """S9 row shape: record date, logged-at, pseudonym, encrypted biometrics, label."""
    p = pseudonymize(scored, "athlete_id", hmac_key)
    e = encrypt_struct(p, [c for c in AUDIT_FIELDS if c in scored.columns], key_text)
    return e.select(F.col("date").cast("string").alias("record_date"),
                    F.current_timestamp().alias("logged_at"), "athlete_pseudonym",
                    "encrypted_biometrics", "injury_risk_label")


# --------------------------------------------------------------------------- X3
def row_policy(df: DataFrame, role: str, athlete_id: str | None = None, sport: str | None = None) -> DataFrame:
    """X3 for one user: Athlete -> own id; Coach -> own sport; other roles -> all rows."""
    if role == "Athlete":
        return df.filter(F.col("athlete_id") == F.lit(athlete_id))
    if role == "Coach":
        return df.filter(F.col("sport") == F.lit(sport))
    return df


def visible_counts(records: DataFrame, users: DataFrame) -> DataFrame:
    """X3 for many users without materialising user x record pairs: records are
    pre-aggregated per athlete, per sport and in total, then joined to the users by role."""
    per_ath = records.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("n_ath"))
    per_sport = records.groupBy("sport").agg(F.count(F.lit(1)).alias("n_sport"))
    total = records.agg(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    # Only athletes have an id: the others would all meet in the join's null partition.
    athletes = users.where("athlete_id is not null").join(per_ath, "athlete_id", "left")
    others = users.where("athlete_id is null").withColumn("n_ath", F.lit(None).cast("bigint"))
    u = athletes.unionByName(others).join(per_sport, "sport", "left")
    n = (F.when(F.col("role") == "Athlete", F.coalesce("n_ath", F.lit(0)))
         .when(F.col("role") == "Coach", F.coalesce("n_sport", F.lit(0)))
         .otherwise(total))
    return u.select("username", "role", n.cast("bigint").alias("visible_records"))
