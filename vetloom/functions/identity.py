"""Identity checks, keyed hashes and reversible protection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetloom.functions.text import squash

EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+"
TOKEN_SHAPE = r"^[a-f0-9]{64}"
SLUG_SHAPE = r"^[a-z0-9-]{3,60}"


def valid_token(col: Column) -> Column:
    return F.regexp_like(col, F.lit(TOKEN_SHAPE + r"\z"))


def valid_slug(col: Column) -> Column:
    return F.regexp_like(col, F.lit(SLUG_SHAPE + r"\z"))


def normalise_identity(first: Column, last: Column, email: Column, consent: Column) -> Column:
    """``struct<first, last, email, verdict>``; the verdict names the first rule that fails."""
    f, s, e = squash(first), squash(last), F.lower(F.trim(email))
    sized = F.length(f).between(2, 100) & F.length(s).between(2, 100)
    mail_ok = F.regexp_like(e, F.lit(EMAIL_SHAPE + r"\z")) & (F.length(e) <= 254)
    verdict = F.when(~(sized & mail_ok), "invalid").when(~consent, "no consent").otherwise("ok")
    return F.struct(f.alias("first"), s.alias("last"), e.alias("email"), verdict.alias("verdict"))


def hmac_pads(key: bytes) -> tuple[str, str]:
    """Inner and outer padded keys in hex."""
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def identity_hash(definition: Column, number: Column, key: bytes, version: str = "assessment-id-v1") -> Column:
    """HMAC-SHA256 in hex, scoped to one definition, from built-in expressions."""
    if len(key) < 32 or len(key) > 64:
        raise ValueError("the hash key must be 32 to 64 bytes")
    inner_pad, outer_pad = hmac_pads(key)
    message = F.encode(F.concat_ws(":", F.lit(version), definition.cast("string"), number), "UTF-8")
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), message), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)


def encrypt_identity(number: Column, key: bytes) -> Column:
    """Versioned text of the AES-GCM cipher text, with a fresh nonce for every row."""
    sealed = F.aes_encrypt(F.encode(number, "UTF-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))
    return F.concat(F.lit("v1."), F.base64(sealed))


def decrypt_identity(text: Column, key: bytes) -> Column:
    sealed = F.unbase64(F.substring(text, F.lit(4), F.length(text)))
    return F.decode(F.aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")), "UTF-8")
