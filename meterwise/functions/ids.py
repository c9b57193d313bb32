"""Identifier expressions: name-based UUIDs and UUID text validation.

Everything is a built-in Spark expression (sha1, unhex, substring, translate), so
it runs inside whole-stage codegen and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 4122 namespace for ISO OIDs (6ba7b812-9dad-11d1-80b4-00c04fd430c8).
OID_NAMESPACE_HEX = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5_oid(name: Column) -> Column:
    """RFC 4122 version-5 UUID of ``name`` (UTF-8) in the OID namespace.

    SHA-1 over namespace bytes + name; the version nibble becomes 5 and the top two
    bits of byte 8 become ``10`` (variant), giving the usual 8-4-4-4-12 text form.
    """
    h = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


# Textual UUID layouts a standard UUID parser accepts (after trimming):
# 36 chars 8-4-4-4-12, the same behind "urn:uuid:" (any case), the same inside one
# wrapping character on each side (38 chars, e.g. braces), or 32 bare hex digits.
_HEX_DASHED = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
UUID_PATTERN = rf"^(?:{_HEX_DASHED}|[uU][rR][nN]:[uU][uU][iI][dD]:{_HEX_DASHED}|.{_HEX_DASHED}.|[0-9a-fA-F]{{32}})$"


def uuid_is_valid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_PATTERN), F.lit(False))


def canonical_uuid(text: Column) -> Column:
    """Lower-case 36-char form of a valid UUID text (null when invalid)."""
    core = F.when(F.length(text) == 45, F.substring(text, 10, 36)).when(
        F.length(text) == 38, F.substring(text, 2, 36)
    ).otherwise(text)
    hex32 = F.lower(F.regexp_replace(core, "-", ""))
    dashed = F.concat_ws(
        "-",
        F.substring(hex32, 1, 8),
        F.substring(hex32, 9, 4),
        F.substring(hex32, 13, 4),
        F.substring(hex32, 17, 4),
        F.substring(hex32, 21, 12),
    )
    return F.when(uuid_is_valid(text), dashed)
