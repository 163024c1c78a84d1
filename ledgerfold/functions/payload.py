"""Column builders for raw payloads: hashes, strict JSON and base64, encryption at rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: With a length that 4 divides, this is padded base64.
BASE64 = r"^[A-Za-z0-9+/]*+={0,2}\z"
#: Fixed value: the tag before IV, ciphertext and authentication tag.
TAG = b"AES.GCM.V1"


def content_hash(raw: Column) -> Column:
    """SHA-256 of the exact bytes, 64 lower-case hex digits."""
    return F.sha2(raw, 256)


def json_text(raw: Column, key: str) -> Column:
    """The value of a key, if the payload is valid JSON and the value is a string; else null."""
    return variant_text(F.try_parse_json(raw.cast("string")), key)


def variant_text(body: Column, key: str) -> Column:
    """The value of a key of parsed JSON, if it is a string; else null."""
    value = F.try_variant_get(body, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def strict_base64(text: Column) -> Column:
    """The bytes; null unless the text is padded base64 without a stray character."""
    return F.when((F.length(text) % 4 == 0) & text.rlike(BASE64), F.try_to_binary(text, F.lit("base64")))


def base64_text(raw: Column) -> Column:
    """Padded base64 in one line (base64() may break lines, as mail does)."""
    return F.regexp_replace(F.base64(raw), r"\s", "")


def utf8(raw: Column) -> Column:
    """Bytes as text; malformed ones become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def encrypted(text: Column, key: Column) -> Column:
    """AES-GCM with a random IV, tagged; null stays null."""
    return F.concat(F.lit(TAG), F.aes_encrypt(text.cast("binary"), key, F.lit("GCM")))


def decrypted(stored: Column, key: Column) -> Column:
    body = F.substring(stored, len(TAG) + 1, 2**31 - 1)
    return F.when(F.substring(stored, 1, len(TAG)) == F.lit(TAG), F.aes_decrypt(body, key, F.lit("GCM")).cast("string"))
