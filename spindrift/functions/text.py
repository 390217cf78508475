"""Text columns with byte semantics.

Chunk offsets and overlaps count UTF-8 bytes and may cut inside a character, so
text that is being cut travels as upper-case hexadecimal (two digits a byte) and
turns back into text at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the trimming rule knows it: ASCII controls, space, U+0085 and the Z categories.
WHITE = r"[ \t\n\x0B\f\r\x{0085}\p{Z}]"
#: The same characters as UTF-8 in hexadecimal.
WHITE_HEX = "20|09|0A|0B|0C|0D|C285|C2A0|E19A80|E2808[0-9A]|E280A8|E280A9|E280AF|E2819F|E38080"
#: Their digits in reverse order, and the last bytes that they can have.
WHITE_HEX_REVERSED = "02|90|A0|B0|C0|D0|582C|0A2C|08A91E|[0-9A]8082E|8A082E|9A082E|FA082E|F9182E|08083E"
LAST_HEX = ["20", "09", "0A", "0B", "0C", "0D", "85", "A0", *[f"8{d}" for d in "0123456789A"], "A8", "A9", "AF", "9F"]


def trim_unicode(text: Column) -> Column:
    """Strip Unicode white space at both ends. Texts without any there are only looked at, not scanned."""
    led = F.when(F.left(text, F.lit(1)).rlike(WHITE), F.regexp_replace(text, f"^{WHITE}+", "")).otherwise(text)
    return let(led, lambda t: F.when(F.right(t, F.lit(1)).rlike(WHITE), F.regexp_replace(t, f"{WHITE}+$", "")).otherwise(t))


def to_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "utf-8"))


def from_hex(raw: Column) -> Column:
    """Text of hexadecimal bytes; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(F.unhex(raw).cast("string"))


def trim_hex(raw: Column) -> Column:
    """Strip white space at both ends of hexadecimal text; the end is handled reversed, so both patterns are anchored."""
    led = F.regexp_replace(raw, f"^({WHITE_HEX})+", "")
    return let(led, lambda t: F.when(F.right(t, F.lit(2)).isin(LAST_HEX), F.reverse(F.regexp_replace(F.reverse(t), f"^({WHITE_HEX_REVERSED})+", ""))).otherwise(t))


def hex_bytes(raw: Column) -> Column:
    """Byte length of hexadecimal text."""
    return (F.length(raw) / 2).cast("long")


def len4(raw: Column) -> Column:
    """Token estimate of hexadecimal text: a quarter of its bytes, rounded down."""
    return F.floor(F.length(raw) / 8).cast("long")


def token_estimate(text: Column) -> Column:
    """Token estimate of text: a quarter of its bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def split_literal(text: Column, separator: str) -> Column:
    """Split on a literal; trailing empty parts stay."""
    return F.split(text, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
