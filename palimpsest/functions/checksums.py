"""Checksums and strict parses, as column expressions inside codegen and as Python functions for the detector."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.kinds import SPACE

#: Bounds of an IBAN's length.
IBAN_LENGTH = (15, 34)


def digits_of(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def is_luhn(value: str) -> bool:
    if len(value) < 2 or not (value.isascii() and value.isdigit()):
        return False
    total = 0
    for i, c in enumerate(reversed(value)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_iban(value: str) -> bool:
    s = re.sub(f"[{SPACE}]", "", value).upper()
    if not IBAN_LENGTH[0] <= len(s) <= IBAN_LENGTH[1] or not re.fullmatch(r"[A-Z0-9]+", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def is_ip(value: str, version: int) -> bool:
    try:
        (ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address)(value)
    except ValueError:
        return False
    return True


def luhn(value: Column) -> Column:
    """True for two ASCII digits or more whose weighted sum is a multiple of ten."""
    ds = F.transform(F.split(F.reverse(value), ""), lambda c, i: F.expr("int(0)") + F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2))
    total = F.aggregate(ds, F.lit(0), lambda acc, d: acc + d - F.when(d > 9, 9).otherwise(0))
    return F.coalesce(F.when(value.rlike("^[0-9]{2,}$"), total % 10 == 0), F.lit(False))


def iban(value: Column) -> Column:
    """Length, alphabet and the remainder 1 modulo 97 after the first four characters have moved to the end."""
    s = F.upper(F.regexp_replace(value, f"[{SPACE}]", ""))
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.coalesce(F.when(s.rlike(f"^[A-Z0-9]{{{IBAN_LENGTH[0]},{IBAN_LENGTH[1]}}}$"), rest == 1), F.lit(False))


def ipv4(value: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.coalesce(value.rlike(f"^{octet}(\\.{octet}){{3}}$"), F.lit(False))
