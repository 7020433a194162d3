"""Probability laws as DataFrame expressions: log-gamma, exact hypergeometric draws, and the beta distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(x: Column) -> Column:
    """Of x > 0: Stirling's series eight steps on, and back by the product of these steps."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    steps = x * (x + 1)
    for i in range(2, 8):
        steps = steps * (x + i)
    return series - F.log(steps)


#: Tries of a draw. One is refused with a probability of 0.3 for large numbers and 0.8 at worst, so all of them are in one of
#: 10^9 draws at most; then the most likely value is taken.
TRIES = 100
#: How wide a draw's box is, in terms of the deviation, by the ratio of uniforms: it holds the whole region for every law here.
BOX, BOX_LEAST = 1.75, 1.1


def hypergeometric(total: Column, marked: Column, drawn: Column, seed: Column) -> Column:
    """How many of `marked` are among `drawn` ones of `total`, taken without replacement: an exact draw, the same for one seed (a
    string) in every run. By the ratio of uniforms under the law itself, so the work doesn't grow with the numbers. All long."""
    n, k, q = (c.cast("double") for c in (total, marked, drawn))
    rate = k / n
    middle = F.floor((q + 1) * (k + 1) / (n + 2)).cast("double")
    deviation = F.sqrt(F.greatest(F.lit(0.0), q * rate * (1 - rate) * (n - q) / F.greatest(F.lit(1.0), n - 1)) + 0.5)
    known = {"n": n, "k": k, "q": q, "least": F.greatest(F.lit(0.0), q + k - n), "most": F.least(q, k), "middle": middle, "centre": q * rate + 0.5, "width": BOX * deviation + BOX_LEAST}

    def weight(c: Column, x: Column) -> Column:
        return -(ln_gamma(x + 1) + ln_gamma(c.k - x + 1) + ln_gamma(c.q - x + 1) + ln_gamma(c.n - c.k - c.q + x + 1))

    def uniform(text: Column, at: int) -> Column:
        return (F.conv(F.substring(text, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)

    def first(c: Column, top: Column, tries: range) -> Column:
        texts = F.transform(F.sequence(F.lit(tries[0]), F.lit(tries[-1])), lambda i: F.sha2(F.concat_ws("|", c.seed, i.cast("string")), 256))
        points = F.transform(texts, lambda t: F.struct(uniform(t, 1).alias("u"), F.floor(c.centre + c.width * (uniform(t, 13) - 0.5) / uniform(t, 1)).cast("double").alias("x")))
        return F.get(F.filter(points, lambda p: (p.x >= c.least) & (p.x <= c.most) & (2 * F.log(p.u) <= weight(c, p.x) - top)), F.lit(0))["x"]

    def draw(c: Column) -> Column:
        # The later tries are made only where the first are all refused.
        return F.when(c.least >= c.most, c.least).otherwise(F.coalesce(first(c, c.top, range(1, 9)), first(c, c.top, range(9, TRIES + 1)), c.middle))

    # Arrays of one element, as what is worked out once for a draw, not at each try.
    once = F.transform(F.array(F.struct(*(v.alias(x) for x, v in known.items()), seed.alias("seed"))), lambda c: c.withField("top", weight(c, c.middle)))
    return F.transform(once, draw)[0].cast("long")


def hypergeometric_sql(total: str, marked: str, drawn: str, seed: str) -> str:
    """DuckDB's text of the same draw."""
    n, k, q = (f"({c})::DOUBLE" for c in (total, marked, drawn))
    least, most, middle = f"greatest(0, {q} + {k} - {n})", f"least({q}, {k})", f"floor(({q} + 1) * ({k} + 1) / ({n} + 2))"
    deviation = f"sqrt(greatest(0, {q} * ({k} / {n}) * (1 - {k} / {n}) * ({n} - {q}) / greatest(1, {n} - 1)) + 0.5)"

    def weight(x: str) -> str:
        return f"-(lgamma({x} + 1) + lgamma({k} - {x} + 1) + lgamma({q} - {x} + 1) + lgamma({n} - {k} - {q} + {x} + 1))"

    def uniform(at: int) -> str:
        return f"((concat('0x', t[{at}:{at + 11}])::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"

    points = f"list_transform(list_transform(generate_series(1, {TRIES}), lambda i: sha256(concat_ws('|', {seed}, i))), lambda t: {{u: {uniform(1)}, x: floor({q} * ({k} / {n}) + 0.5 + ({BOX} * {deviation} + {BOX_LEAST}) * ({uniform(13)} - 0.5) / {uniform(1)})}})"
    inside = f"list_filter({points}, lambda p: p.x >= {least} AND p.x <= {most})"
    taken = f"list_filter({inside}, lambda p: 2 * ln(p.u) <= {weight('p.x')} - ({weight(middle)}))"
    return f"(CASE WHEN {least} >= {most} THEN {least} ELSE coalesce({taken}[1].x, {middle}) END)::BIGINT"


def beta_at_most(x: float, a: Column, b: Column) -> Column:
    """The probability that a beta variable of a, b > 0 is at most x (0 < x < 1): the incomplete beta function's continued
    fraction from the side on which it converges, in steps that grow with the square root of a + b."""
    low = F.lit(x) < (a + 1) / (a + b + 2)
    # From the upper side, a and b change places.
    p, q = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a)
    z = F.when(low, x).otherwise(1 - x)
    steps = (60 + 6 * F.sqrt(a + b)).cast("int")

    def factor(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        return F.when(j % 2 == 0, even).otherwise(-(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)))

    def step(s: Column, t: Column) -> Column:
        c, d = 1 + t / s.c, 1 / (1 + t * s.d)
        return F.struct(c.alias("c"), d.alias("d"), (s.f * c * d).alias("f"))

    one = F.lit(1.0)
    fraction = F.aggregate(F.transform(F.sequence(F.lit(1), steps), factor), F.struct(one.alias("c"), F.lit(0.0).alias("d"), one.alias("f")), step, lambda s: s.f)
    tail = F.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * F.log(z) + q * F.log(1 - z)) / (p * fraction)
    return F.greatest(F.lit(0.0), F.least(one, F.when(low, tail).otherwise(1 - tail)))
