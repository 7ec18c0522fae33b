"""Small column helpers shared by the operators."""
from pyspark.sql import functions as F


def c(x):
    return F.col(x) if isinstance(x, str) else x


def py_round(x, n=0):
    """Half-even, as Python rounds."""
    return F.bround(c(x).cast("double"), n)


def ntz(x):
    return x.cast("timestamp_ntz")


def from_micros(us):
    """Wall clock from microseconds (session zone is UTC)."""
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def pct(part, total):
    return F.when(total > 0, py_round(F.lit(100.0) * part / total, 1)).otherwise(0.0)


def add_note(notes, note, marker):
    """Append `note` after ' | ' unless the marker is there already."""
    old = F.coalesce(c(notes), F.lit(""))
    joined = F.btrim(F.concat(F.rtrim(old), F.lit(" | "), note), F.lit(" |"))
    return F.when(old.contains(marker), c(notes)).otherwise(joined)


def exact_sum(x, scale=3):
    """Sum through decimals: the same result in whatever order partitions arrive."""
    return F.sum(c(x).cast(f"decimal(28,{scale})")).cast("double")


def let(x, fn):
    """Binds a value once: fn sees a variable instead of a copy of the expression, so plans stay small."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))
