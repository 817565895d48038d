import datetime as dt
import decimal
import math

T0 = dt.datetime(2024, 1, 1)


def at(**offset):
    """A timestamp some time after the test epoch."""
    return T0 + dt.timedelta(**offset)


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def normal(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value) + 0.0:.5f}".replace("-0.00000", "0.00000")
    return value.isoformat() if isinstance(value, dt.datetime) else str(value)


def normal_rows(names, data, floats):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        tuple(normal(float(r[i]) if names[i] in floats and r[i] is not None else r[i]) for i in order)
        for r in data
    )
