"""The integer kernel: exact, JVM-side column functions.

All of them work in BIGINT, with arithmetic shifts; none goes through DOUBLE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 8 * log2 of the three bits behind the leading one (fixed values).
LOG8_MANTISSA = (0, 1, 3, 4, 5, 6, 6, 7)


def big(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("bigint")


def div(a: Column, b: Column | int) -> Column:
    """Truncating integer division as BIGINT."""
    return F.call_function("div", big(a), big(b))


def shift_right(c: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", big(c), n if isinstance(n, Column) else F.lit(n))


def shift_left(c: Column | int, n: Column | int) -> Column:
    return F.call_function("shiftleft", big(c), n if isinstance(n, Column) else F.lit(n))


def clamp(c: Column, lo: Column | int, hi: Column | int) -> Column:
    return F.greatest(big(lo), F.least(big(hi), big(c)))


def value_bits(c: Column) -> Column:
    """Bits needed for a non-negative value, one at least."""
    return F.length(F.bin(big(c))).cast("int")


def value_range(bits: Column, signed: Column) -> tuple[Column, Column]:
    """Smallest and largest value of samples of so many bits."""
    half = shift_left(1, (bits - 1).cast("int"))
    return F.when(signed, -half).otherwise(big(0)), F.when(signed, half - 1).otherwise(shift_left(1, bits.cast("int")) - 1)


def ilog2_8(x: Column) -> Column:
    """8 * log2(x) from the leading one and the three bits behind it; 0 for 0."""
    x = big(x)
    e = value_bits(x) - 1
    m = F.when(e >= 3, shift_right(x, F.greatest(e - 3, F.lit(0)))).otherwise(shift_left(x, F.greatest(3 - e, F.lit(0)))).bitwiseAND(big(7))
    mantissa = F.element_at(F.array(*[F.lit(v) for v in LOG8_MANTISSA]), (m + 1).cast("int"))
    return F.when(x == 0, big(0)).otherwise(big(8 * e + mantissa))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def pwl(m: Column) -> Column:
    """Companding of a magnitude to 0..127: the least of its three segments."""
    m = big(m)
    return F.least(m, 32 + shift_right(m - 32, 2), 64 + shift_right(m - 160, 5), big(127))


def compand(d: Column, inv: Column) -> Column:
    """A neighbour's difference, scaled by the inverse activity and companded, with its sign."""
    q = pwl(shift_right(F.abs(big(d)) * big(inv), 16))
    return F.when(d < 0, -q).otherwise(q)


def near(d: Column, inv: Column) -> Column:
    """A left neighbour's difference in 1/256 of the activity, within 4096."""
    return clamp(shift_right(big(d) * big(inv), 12), -4096, 4096)


def head(out: list[Column], r: Column, a4: Column, nears: list[Column], shift: int, max_value: Column) -> tuple[Column, Column]:
    """Mean in 1/16 and log-scale in 1/8 octaves from the network's six outputs."""
    o = [big(c) for c in out]
    m = clamp(shift_left(o[0], 8) + reduce(lambda a, b: a + b, [o[i + 1] * big(nears[i]) for i in range(3)]), -(1 << 40), 1 << 40)
    mu16 = clamp(16 * big(r) + shift_right(big(a4) * m + (1 << (shift + 3)), shift + 4), 0, 16 * big(max_value))
    width = ilog2_8(256 + F.abs(big(nears[0]))) - 64
    return mu16, ilog2_8(a4) - 16 + shift_right(8 * o[4] + o[5] * width + (1 << (shift - 1)), shift)


def residual_plan(mu16: Column, log_scale8: Column) -> dict[str, Column]:
    """Predicted value, bypassed low bits and the contexts of token and sign."""
    predicted = shift_right(big(mu16) + 8, 4)
    frac = big(mu16) - 16 * predicted
    scale = big(log_scale8)
    k = clamp(shift_right(scale, 3) - 1, 0, 14)
    token_ctx = F.when(k == 0, clamp(shift_right(scale + 16, 1), 0, 15)).otherwise(16 + shift_right(scale.bitwiseAND(big(7)), 1))
    sign_ctx = shift_right(frac + 8, 2) * 17 + F.when(k == 0, token_ctx).otherwise(big(16))
    return {"predicted": predicted, "k": k, "token_ctx": token_ctx, "sign_ctx": sign_ctx}


def tokenise(v: Column, predicted: Column, k: Column) -> dict[str, Column]:
    """Token, bypassed bits and sign of a residual: what the entropy coder is given."""
    e = big(v) - big(predicted)
    m = F.abs(e)
    q = shift_right(m, k.cast("int"))
    token = F.least(q, big(14)) + F.when(q >= 30, 1).otherwise(0)
    x = F.greatest(q - 29, big(1))
    n = big(value_bits(x) - 1)
    return {
        "token": big(token),
        "escape_bits": F.when(q >= 30, n).otherwise(big(0)),
        "extra": F.when(q >= 30, x - shift_left(1, n.cast("int"))).when(q >= 14, q - 14).otherwise(big(0)),
        "low": m.bitwiseAND(shift_left(1, k.cast("int")) - 1),
        "negative": e < 0,
    }


def detokenise(predicted: Column, k: Column, t: dict[str, Column]) -> Column:
    """The value that tokenise() was given."""
    q = F.when(t["token"] == 15, shift_left(1, t["escape_bits"].cast("int")) + t["extra"] + 29).when(t["token"] == 14, 14 + t["extra"]).otherwise(t["token"])
    m = shift_left(q, k.cast("int")) + t["low"]
    return big(predicted) + F.when(t["negative"], -m).otherwise(m)
