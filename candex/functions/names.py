"""Column functions on names and leading content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from candex.functions.numbers import _c

# Extensions of still pictures and stems of cover pictures, in priority order.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "gif"]

# Fixed values: (class, pattern, group of the set number, group of the part number) of disc file names.
DISC_NAME_RULES = [
    ("manager", r"(?i)^VIDEO_TS\.VOB\z", None, None),
    ("title", r"(?i)^VTS_(0[1-9]|[1-9][0-9])_([0-9])\.VOB\z", 1, 2),
    ("clip", r"(?i)^([0-9]{5})\.m2ts\z", 1, None),
]

# Size letter before the extension of a jacket picture, largest first.
JACKET_SIZES = ["L", "M", "S"]

# Leading bytes of the still pictures that are read.
PICTURE_SIGNATURES = [
    ("jpeg", b"\xff\xd8\xff"),
    ("png", b"\x89PNG\r\n\x1a\n"),
    ("gif", b"GIF87a"),
    ("gif", b"GIF89a"),
    ("bmp", b"BM"),
]

# Versions of disc structure files that are read, to follow their magic.
STRUCTURE_VERSIONS = ["0100", "0200", "0240", "0300"]

# Largest unsigned 64-bit value.
U64_MAX = (1 << 64) - 1


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(name) -> Column:
    """A name in lower case; only A-Z have one."""
    return F.translate(_c(name), _UPPER, _LOWER)


def _folded(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def split_ext(name) -> Column:
    """``struct(stem, ext)`` at the last dot; without a dot the extension is empty."""
    name = _c(name)
    dotted = F.contains(name, F.lit("."))
    return F.struct(
        F.when(dotted, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name).alias("stem"),
        F.when(dotted, F.regexp_extract(name, r"(?s)\.([^.]*)$", 1)).otherwise(F.lit("")).alias("ext"),
    )


def has_ext(name, exts) -> Column:
    """Whether the extension is one of ``exts``, whatever the case."""
    return fold(split_ext(name)["ext"]).isin([_folded(e) for e in exts])


def stem_in(name, names) -> Column:
    """Whether the part before the last dot is one of ``names``, whatever the case."""
    return fold(split_ext(name)["stem"]).isin([_folded(n) for n in names])


def dims_from_name(name) -> Column:
    """``struct(w, h, area)`` from the first ``WxH`` whose sides are both non-zero.

    Pairs with a zero side are passed over, a side beyond 64 bits ends the search; ``area`` is 0 without a
    pair or when the product is beyond 64 bits.
    """
    # The height is only looked at, not consumed: it may be the width of the next pair.
    pattern = F.lit(r"([0-9]+)[xX](?=([0-9]+))")
    pairs = F.arrays_zip(
        F.regexp_extract_all(_c(name), pattern, F.lit(1)).alias("w"),
        F.regexp_extract_all(_c(name), pattern, F.lit(2)).alias("h"),
    )

    def number(digits: Column) -> Column:
        value = digits.try_cast("decimal(38,0)")
        return F.when(value <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), value.cast("decimal(20,0)"))

    sides = F.transform(pairs, lambda p: F.struct(number(p["w"]).alias("w"), number(p["h"]).alias("h")))
    ends = F.filter(sides, lambda p: p["w"].isNull() | p["h"].isNull() | ((p["w"] > 0) & (p["h"] > 0)))
    first = F.get(ends, F.lit(0))
    fits = first["w"].isNotNull() & first["h"].isNotNull()
    area = F.try_multiply(first["w"].cast("decimal(38,0)"), first["h"].cast("decimal(38,0)"))
    area = F.when(fits & (area <= F.lit(str(U64_MAX)).cast("decimal(20,0)")), area)
    return F.struct(
        F.when(fits, first["w"]).alias("w"),
        F.when(fits, first["h"]).alias("h"),
        F.coalesce(area, F.lit(0)).cast("decimal(20,0)").alias("area"),
    )


def classify_name(name, rules=DISC_NAME_RULES) -> Column:
    """``struct(class, set, part)`` by the first matching rule, null when none matches."""
    name = _c(name)

    def number(pattern, group) -> Column:
        if group is None:
            return F.lit(0).cast("long")
        return F.regexp_extract(name, pattern, group).cast("long")

    out = None
    for kind, pattern, set_group, part_group in rules:
        value = F.struct(
            F.lit(kind).alias("class"),
            number(pattern, set_group).alias("set"),
            number(pattern, part_group).alias("part"),
        )
        out = F.when(name.rlike(pattern), value) if out is None else out.when(name.rlike(pattern), value)
    return out


def size_rank(name, pattern: str = r"(?is)^J.*(.)\.MP2\z", sizes=JACKET_SIZES) -> Column:
    """Rank of the size letter in a name, ``len(sizes)`` for other letters, null for other names."""
    name = _c(name)
    letter = F.translate(F.regexp_extract(name, pattern, 1), _LOWER, _UPPER)
    rank = reduce(
        lambda w, pair: w.when(letter == pair[1], pair[0]),
        list(enumerate(sizes))[1:],
        F.when(letter == sizes[0], 0),
    ).otherwise(len(sizes))
    return F.when(name.rlike(pattern), rank)


def clean_name(name, cut: str = ";", trim: str = ".") -> Column:
    """The name up to the first ``cut`` character, without trailing ``trim`` characters; empty gives null."""
    base = F.regexp_replace(_c(name), rf"(?s)[{cut}].*$", "")
    base = F.regexp_replace(base, rf"[{trim}]+\z", "")
    return F.when(base != "", base)


def sniff_signature(content, signatures=PICTURE_SIGNATURES) -> Column:
    """Kind of the first ``(kind, prefix[, versions])`` that the content starts with, else ``unknown``.

    With ``versions``, one of them must follow the prefix. Prefixes are text or bytes like the content.
    """
    content = _c(content)
    out = F.when(F.lit(False), F.lit(""))
    for kind, prefix, *rest in signatures:
        prefixes = [prefix + v for v in rest[0]] if rest else [prefix]
        starts = reduce(lambda a, b: a | b, [F.startswith(content, F.lit(p)) for p in prefixes])
        out = out.when(starts, F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def byte_sum(text, skip: int | None = None) -> Column:
    """Sum modulo 256 of the UTF-8 bytes; the byte at 0-based ``skip`` is left out."""
    digits = F.hex(F.encode(_c(text), "UTF-8"))
    if skip is not None:
        digits = F.concat(F.substring(digits, 1, 2 * skip), F.substring(digits, 2 * skip + 3, 2**31 - 1))
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    values = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("long"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v) % 256
