"""Keys of tables, columns, objects and links: packing, little-endian codecs and ranges."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data type tags.
TYPE_TAGS = {
    "int": 0, "bool": 1, "string": 2, "binary": 4, "mixed": 6, "timestamp": 8, "float": 9, "double": 10, "decimal": 11,
    "link": 12, "objectid": 15, "typedlink": 16, "uuid": 17, "list": 19, "set": 20, "dict": 21,
}
MAX_COLUMNS = 65535


def pack_column_key(index: Column, kind: Column, attributes: Column, tag: Column) -> Column:
    """index in 16 bits, type in 6, attributes in 8, tag above."""
    return (
        index.cast("long")
        .bitwiseOR(F.shiftleft(kind.cast("long"), 16))
        .bitwiseOR(F.shiftleft(attributes.cast("long"), 22))
        .bitwiseOR(F.shiftleft(tag.cast("long"), 30))
    )


def unpack_column_key(key: Column) -> dict[str, Column]:
    def bits(shift: int, width: int) -> Column:
        return F.shiftright(key, shift).bitwiseAND((1 << width) - 1)

    return {"index": bits(0, 16), "kind": bits(16, 6), "attributes": bits(22, 8), "tag": F.shiftright(key, 30)}


@dataclass(frozen=True)
class ObjectLink:
    """A link to an object of a given table; null if either key is 0."""

    table_key: int
    obj_key: int

    _FORMAT = "<IQ"

    @property
    def is_null(self) -> bool:
        return not (self.table_key and self.obj_key)

    def encode(self) -> bytes:
        return struct.pack(self._FORMAT, self.table_key, self.obj_key)

    @classmethod
    def decode(cls, data: bytes) -> ObjectLink:
        if len(data) != struct.calcsize(cls._FORMAT):
            raise ValueError("an object link has 12 bytes")
        return cls(*struct.unpack(cls._FORMAT, data))


@dataclass(frozen=True)
class TypedLink:
    """A link that also says what type it leads to."""

    table_key: int
    obj_key: int
    type_info: int

    _FORMAT = "<IQB"

    @property
    def is_null(self) -> bool:
        return not (self.table_key and self.obj_key)

    def encode(self) -> bytes:
        return struct.pack(self._FORMAT, self.table_key, self.obj_key, self.type_info)

    @classmethod
    def decode(cls, data: bytes) -> TypedLink:
        if len(data) != struct.calcsize(cls._FORMAT):
            raise ValueError("a typed link has 13 bytes")
        return cls(*struct.unpack(cls._FORMAT, data))


def encode_key(key: int, width: int) -> bytes:
    """A key in ``width`` bytes, the lowest first."""
    return key.to_bytes(width, "little")


def decode_key(data: bytes) -> int:
    return int.from_bytes(data, "little")


def encode_keys(keys: list[int], width: int = 8) -> bytes:
    return b"".join(encode_key(k, width) for k in keys)


def decode_keys(data: bytes, width: int = 8) -> list[int]:
    if len(data) % width:
        raise ValueError(f"length isn't a multiple of {width}")
    return [decode_key(data[i : i + width]) for i in range(0, len(data), width)]


def little_endian_hex(c: Column) -> Column:
    """A long as 16 hexadecimal digits, the lowest byte first."""
    padded = F.lpad(F.lower(F.hex(c.cast("long"))), 16, "0")
    return F.concat(*[F.substring(padded, i, 2) for i in range(15, 0, -2)])


def check_range(low: int, high: int, width: int = 8) -> None:
    """A range of keys must be ordered, not begin with 0 (unresolved), and fit its width."""
    if not 0 < low <= high < 1 << (8 * width - 1):
        raise ValueError(f"bad key range {low}..{high}")
