"""Encryption of chunks: a key derived once on the driver, AES in an authenticated mode on the executors.

The mode (GCM) authenticates what it encrypts, which takes the place of a cipher in counter mode and a MAC of its own.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived_key(password: str, salt: bytes, size: int = 32) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=2048, r=8, p=1, dklen=size)


def password(variable: str = "BLOCKLOOM_PASSWORD", path: str | None = None) -> str:
    """The password from the environment, or the first line of a file, which is overwritten with zeros afterwards."""
    if path is None:
        found = os.environ.get(variable)
    else:
        with open(path, "r+b") as f:
            content = f.read()
            f.seek(0)
            f.write(bytes(len(content)))
        lines = content.decode().splitlines()
        found = lines[0] if lines else None
    if not found:
        raise ValueError("no password")
    return found


def sealed(data: Column, key: bytes, bound_to: Column) -> Column:
    """data encrypted; bound_to (such as the chunk's number) must be the same to open it."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), bound_to.cast("string").cast("binary"))


def opened(data: Column, key: bytes, bound_to: Column) -> Column:
    """data decrypted; raises if the key, the data or what it is bound to differ."""
    return F.aes_decrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), bound_to.cast("string").cast("binary"))


def opened_or_null(data: Column, key: bytes, bound_to: Column) -> Column:
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), bound_to.cast("string").cast("binary"))
