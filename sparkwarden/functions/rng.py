"""Random numbers that depend on keys alone: the same in any partitioning, on any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 867


def uniform_digits(tag: str, *keys: Column | str) -> Column:
    """The first 8 hexadecimal digits of the md5 of a tag and keys: texts that order as the numbers of ``uniform`` do, and cost less."""
    text = F.concat_ws("|", F.lit(str(SEED)), F.lit(tag), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.substring(F.md5(text), 1, 8)


def uniform(tag: str, *keys: Column | str) -> Column:
    """A number in [0, 1) from a tag and keys: the first 8 hexadecimal digits of an md5."""
    return F.conv(uniform_digits(tag, *keys), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(tag: str, *keys: str) -> str:
    """The same number as DuckDB SQL."""
    text = " || '|' || ".join([f"'{SEED}|{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def normal(tag: str, *keys: Column | str) -> Column:
    """A standard normal number from two uniform ones (Box-Muller)."""
    u, v = uniform(tag + ".a", *keys), uniform(tag + ".b", *keys)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-10)))) * F.cos(2 * F.lit(3.141592653589793) * v)


#: Tries of the gamma sampler; each is accepted with a chance of over 95 %.
TRIES = 6


def _digits(md5: Column, k: int) -> Column:
    """A number in [0, 1) from the k-th eight hexadecimal digits of an md5."""
    return F.conv(F.substring(md5, 8 * k + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _accepted(x: Column, u: Column, v: Column, d: Column) -> Column:
    """d * v if the try is accepted, else null."""
    fits = (v > 0) & (F.log(F.greatest(u, F.lit(1e-300))) < 0.5 * x * x + d - d * v + d * F.log(v))
    return F.when(fits, d * v)


def _normal_of(md5: Column) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(_digits(md5, 0), F.lit(1e-10)))) * F.cos(2 * F.lit(3.141592653589793) * _digits(md5, 1))


def _try(md5: Column, d: Column) -> Column:
    """A gamma draw of shape d + 1/3 by Marsaglia and Tsang's method from one md5, or null if it is rejected."""
    # arrays of one bind a name to a value within the expression
    bound = F.transform(F.array(md5), lambda m: F.struct(_normal_of(m).alias("x"), _digits(m, 2).alias("u")))
    return F.transform(bound, lambda s: _accepted(s["x"], s["u"], F.pow(1 + s["x"] / F.sqrt(9 * d), F.lit(3)), d))[0]


def _text(tag: str, i: Column, keys: tuple[str, ...]) -> Column:
    """The md5 of a tag, a number and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), F.lit(tag), i, *[F.col(k).cast("string") for k in keys]))


def _later(tag: str, d: Column, keys: tuple[str, ...]) -> Column:
    """The first accepted of the tries after the first, or the mode; evaluated only where the first was rejected."""
    more = F.transform(F.sequence(F.lit(1), F.lit(TRIES - 1)), lambda i: _try(_text(tag, i.cast("string"), keys), d))
    return F.coalesce(F.get(F.filter(more, lambda g: g.isNotNull()), F.lit(0)), d)


def with_beta_draw(df: DataFrame, a: Column, b: Column, tag: str, *keys: str, out: str = "draw") -> DataFrame:
    """df with a Beta(a, b) draw per row, from a tag and keys: a ratio of gamma draws whose shapes are raised by one and lowered again."""
    rows, gammas = df, []
    for name, shape in (("a", a), ("b", b)):
        rows = rows.withColumns({f"_d{name}": shape + F.lit(2.0) / 3, f"_s{name}": shape, f"_m{name}": _text(f"{tag}.{name}", F.lit("0"), keys)})
        m, d = F.col(f"_m{name}"), F.col(f"_d{name}")
        rows = rows.withColumns({f"_x{name}": _normal_of(m), f"_u{name}": _digits(m, 2)})
        rows = rows.withColumn(f"_v{name}", F.pow(1 + F.col(f"_x{name}") / F.sqrt(9 * d), F.lit(3)))
        rows = rows.withColumn(f"_g{name}", _accepted(F.col(f"_x{name}"), F.col(f"_u{name}"), F.col(f"_v{name}"), d))
        gammas.append(F.coalesce(f"_g{name}", _later(f"{tag}.{name}", F.col(f"_d{name}"), keys)) * F.pow(_digits(F.col(f"_m{name}"), 3), 1 / F.col(f"_s{name}")))
    rows = rows.withColumns({"_ga": gammas[0], "_gb": gammas[1]})
    return rows.withColumn(out, F.coalesce(F.try_divide(F.col("_ga"), F.col("_ga") + F.col("_gb")), F.lit(0.5))).select(*df.columns, out)


def beta_draw_sql(a: str, b: str, tag: str, *keys: str) -> str:
    """The same draw as DuckDB SQL."""

    def digits(m: str, k: int) -> str:
        return f"(CAST(('0x' || substr({m}, {8 * k + 1}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"

    def gamma(name: str, shape: str) -> str:
        text = " || '|' || ".join([f"'{SEED}|{tag}.{name}'", "CAST(i AS VARCHAR)", *[f"CAST({k} AS VARCHAR)" for k in keys]])
        d = f"(({shape}) + 2.0::DOUBLE / 3)"
        tries = f"list_transform(range({TRIES}), lambda i: md5({text}))"
        xs = f"list_transform({tries}, lambda m: {{'x': sqrt(-2 * ln(greatest({digits('m', 0)}, 1e-10))) * cos(2 * 3.141592653589793::DOUBLE * {digits('m', 1)}), 'u': {digits('m', 2)}}})"
        vs = f"list_transform({xs}, lambda s: {{'x': s.x, 'u': s.u, 'v': pow(1 + s.x / sqrt(9 * {d}), 3)}})"
        kept = f"list_filter({vs}, lambda s: s.v > 0 AND ln(greatest(s.u, 1e-300)) < 0.5 * s.x * s.x + {d} - {d} * s.v + {d} * ln(greatest(s.v, 1e-300)))"
        first = text.replace("CAST(i AS VARCHAR)", "'0'")
        return f"coalesce({d} * ({kept})[1].v, {d}) * pow({digits(f'md5({first})', 3)}, 1 / ({shape}))"

    return f"(SELECT coalesce(ga / nullif(ga + gb, 0), 0.5::DOUBLE) FROM (SELECT {gamma('a', a)} AS ga, {gamma('b', b)} AS gb))"
