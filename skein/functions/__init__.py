"""Column functions: digests, geometry, vectors, evidence tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence tiers, strongest first; a result is as weak as its weakest input (fixed values).
TIERS = ("OBSERVED", "DERIVED", "INFERRED", "GENERATED")
EARTH_M = 6_371_000.0


def sha256(col) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes or of a binary; null for null."""
    return F.sha2(col, 256)


def verified(data, expected) -> Column:
    """Whether data has the expected digest, in any case; a null on either side is not verified."""
    return F.coalesce(sha256(data) == F.lower(expected), F.lit(False))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres on a sphere between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), dlat * dlat + F.cos(a) * F.cos(b) * dlon * dlon)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tier_code(tier) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier)


def combine_tiers(*tiers) -> Column:
    """The weakest of the given tiers."""
    worst = tier_code(tiers[0]) if len(tiers) == 1 else F.greatest(*map(tier_code, tiers))
    return F.element_at(F.array(*map(F.lit, TIERS)), worst.cast("int"))


def device_key(imei) -> Column:
    """The first 14 digits of a device number; null if there are fewer, or one digit repeated."""
    digits = F.regexp_replace(imei, r"\D", "")
    key = F.substring(digits, 1, 14)
    return F.when((F.length(key) == 14) & ~key.rlike(r"^(\d)\1*$"), key)


def msisdn(number, country: str = "91") -> Column:
    """Digits of a phone number with its country code; ten digits get `country`, leading zeros go."""
    digits = F.regexp_replace(F.regexp_replace(number, r"\D", ""), r"^0+", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit(country), digits)).when(F.length(digits) > 10, digits)


def instant(text, zone, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm")) -> Column:
    """A time written in one of some formats in the zone of another column, as UTC; null if none fits."""
    return F.to_utc_timestamp(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)), zone)


def keccak256(col) -> Column:
    """Lowercase hex Keccak-256 (original padding) of a binary, by an Arrow-batched function: Spark has no such digest."""
    return F.pandas_udf(_keccak_series, "string")(col)


def _keccak_series(s):
    return s.map(lambda b: None if b is None else keccak(bytes(b)).hex())


_keccak_series.__annotations__ = {"s": __import__("pandas").Series, "return": __import__("pandas").Series}


def keccak(data: bytes) -> bytes:
    """Keccak-256 of the published sponge: rate 1088, padding 0x01; round constants and offsets made by their rules."""
    mask, lanes, rate = (1 << 64) - 1, [0] * 25, 136
    turn = lambda v, n: (v << n % 64 | v >> (64 - n % 64) % 64) & mask if n % 64 else v
    constants, lfsr = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if lfsr & 1:
                c |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        constants.append(c)
    block = data + b"\x01" + bytes(-(len(data) + 1) % rate)
    block = block[:-1] + bytes([block[-1] | 0x80])
    for at in range(0, len(block), rate):
        for i in range(rate // 8):
            lanes[i] ^= int.from_bytes(block[at + 8 * i : at + 8 * i + 8], "little")
        for c in constants:
            columns = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
            lanes = [v ^ columns[(i % 5 - 1) % 5] ^ turn(columns[(i % 5 + 1) % 5], 1) for i, v in enumerate(lanes)]
            x, y, moved, held = 1, 0, [0] * 25, lanes[1]
            moved[0] = lanes[0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                moved[x + 5 * y] = turn(held, (t + 1) * (t + 2) // 2)
                held = lanes[x + 5 * y]
            lanes = [moved[i] ^ (~moved[i - i % 5 + (i + 1) % 5] & mask & moved[i - i % 5 + (i + 2) % 5]) for i in range(25)]
            lanes[0] ^= c
    return b"".join(v.to_bytes(8, "little") for v in lanes)[:32]
