"""Null-safe column functions. Undefined values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that stand for a missing value.
MISSING = ("", "na", "n/a", "nan", "none", "null")

# Half-open size bins (label, from, below); the last one has no end.
VOXEL_BINS = (
    ("tiny_<10", 0, 10), ("small_10-100", 10, 100), ("medium_100-1k", 100, 1000), ("large_1k-10k", 1000, 10000), ("huge_>=10k", 10000, None),
)
ML_BINS = (
    ("vsmall_<0.1mL", 0.0, 0.1), ("small_0.1-1mL", 0.1, 1.0), ("med_1-10mL", 1.0, 10.0), ("large_10-50mL", 10.0, 50.0),
    ("vlarge_>=50mL", 50.0, None),
)

# Commit subjects, by the first expression that is found.
SUBJECT_RULES = (
    ("correction", r"(?i)\b(correct|fix|invalidate|retract|repair|restore|regression)\w*"),
    ("negative", r"(?i)\b(abandon|fail|negative|no gain|regress|worse)\w*"),
    ("decision", r"(?i)\b(adopt|choose|deprecat|drop|replace|retire|select|ship|stop|switch)\w*"),
    ("result", r"(?i)\b(benchmark|complete|done|eval|result|score|summary|win)\w*"),
)
# Words that say nothing about a commit.
STOP_WORDS = ("add", "after", "and", "before", "for", "from", "into", "latest", "more", "next", "run", "the", "this", "update", "with")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(top: Column | str, bottom: Column | str, empty: float | None = None) -> Column:
    """top / bottom as double; ``empty`` where the bottom is 0."""
    bottom = _c(bottom).cast("double")
    return F.when(bottom == 0, F.lit(empty).cast("double")).otherwise(_c(top).cast("double") / F.nullif(bottom, F.lit(0.0)))


def harmonic(a: Column | str, b: Column | str) -> Column:
    """2ab / (a + b), 0 where both are 0."""
    return ratio(2 * _c(a) * _c(b), _c(a) + _c(b), 0.0)


f1 = harmonic


def finite(x: Column | str) -> Column:
    """NULL for NaN and infinities."""
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parse_float(x: Column | str) -> Column:
    """A number, or NULL for missing cells, other text, and what is not finite."""
    text = F.trim(_c(x))
    return F.when(F.lower(text).isin(*MISSING), None).otherwise(finite(text.try_cast("double")))


def require_amount(x: Column | str, case: Column | str, what: str = "value") -> Column:
    """parse_float() that fails, naming the case, for text that is neither missing nor a number of at least 0."""
    value, text = parse_float(x), F.trim(_c(x))
    bad = (value.isNull() & ~F.lower(F.coalesce(text, F.lit(""))).isin(*MISSING)) | (value < 0)
    return F.when(
        bad, F.raise_error(F.concat(F.lit(f"invalid {what} in case "), _c(case).cast("string"), F.lit(": "), text)).cast("double"),
    ).otherwise(value)


def parse_bool(x: Column | str) -> Column:
    text = F.lower(F.trim(_c(x)))
    return F.when(text.isin("true", "t", "yes", "y", "1", "1.0"), True).when(text.isin("false", "f", "no", "n", "0", "0.0"), False)


def category(x: Column | str) -> Column:
    """Trimmed; ``unknown`` where nothing is left."""
    return F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), F.lit("unknown"))


def range_bin(x: Column | str, bins: Sequence[tuple] = VOXEL_BINS) -> Column:
    """The label of the half-open bin that x is in; ``unknown`` for NULL and below all bins."""
    x = _c(x)
    out = F.when(x.isNull() | (x < bins[0][1]), "unknown")
    for label, low, high in bins:
        out = out.when((x >= low) & (x < high) if high is not None else x >= low, label)
    return out.otherwise("unknown")


def chronicity(days: Column | str, flag: Column | str, legacy: bool = False) -> Column:
    """struct(bin, source): by positive days, else (unless legacy) a flag of 1 means at least 180."""
    days, flag = _c(days), _c(flag)
    usable = days > 0
    rescued = (flag == 1) & F.lit(not legacy)
    name = F.when(usable & (days < 180), "lt180d").when(usable | rescued, "ge180d").otherwise("unknown")
    return F.struct(name.alias("bin"), F.when(usable, "days_post_stroke").when(rescued, "chronicity_flag").otherwise("").alias("source"))


def binarise(x: Column | str, cut: float = 0.5, inclusive: bool = True) -> Column:
    """x >= cut (or > cut); fails on NaN and infinities instead of calling them background."""
    x = _c(x)
    broken = F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(broken, F.raise_error(F.lit("not finite")).cast("boolean")).otherwise(x >= cut if inclusive else x > cut)


def config_name(threshold: Column | str, least: Column | str) -> Column:
    return F.format_string("thr%.2f_k%d", _c(threshold).cast("double"), _c(least).cast("int"))


def config_threshold(name: Column | str) -> Column:
    return F.regexp_extract(_c(name), r"^thr([0-9.]+)_k\d+$", 1).try_cast("double")


def config_least(name: Column | str) -> Column:
    return F.regexp_extract(_c(name), r"^thr[0-9.]+_k(\d+)$", 1).try_cast("int")


def short_threshold(x: Column | str) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", _c(x).cast("double")), r"\.?0+$", "")


def case_id(path: Column | str, pattern: str = r"([A-Z]+_\d{4})") -> Column:
    """The id in a path; the file name without suffixes where there is none."""
    found = F.regexp_extract(_c(path), pattern, 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\..*$", ""))


def subject_words(x: Column | str) -> Column:
    """Distinct lower-case words of more than two characters that are not stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " ")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def classify(x: Column | str, rules: Sequence[tuple[str, str]] = SUBJECT_RULES, otherwise: str = "artifact") -> Column:
    """The name of the first rule that is found."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(_c(x).rlike(pattern), name).otherwise(out)
    return out


def top_level(files: Column | str) -> Column:
    """First parts of paths, distinct, without empty ones."""
    return F.array_distinct(F.filter(F.transform(_c(files), lambda f: F.split(f, "/")[0]), lambda p: p != ""))


def voxel_ml(x: Column | str, y: Column | str, z: Column | str) -> Column:
    return _c(x).cast("double") * _c(y) * _c(z) / 1000.0


def least_voxels(mm3: float, voxel_mm3: Column | str) -> Column:
    return F.ceil(F.lit(float(mm3)) / F.greatest(_c(voxel_mm3).cast("double"), F.lit(1e-9))).cast("bigint")


def anisotropy(x: Column | str, y: Column | str, z: Column | str) -> Column:
    return ratio(F.greatest(_c(x), _c(y), _c(z)), F.least(_c(x), _c(y), _c(z)))


def isotropic(x: Column | str, y: Column | str, z: Column | str, tolerance: float = 0.01) -> Column:
    return F.greatest(_c(x), _c(y), _c(z)) - F.least(_c(x), _c(y), _c(z)) < tolerance


def close(a: Column | str, b: Column | str, tolerance: float = 1e-9) -> Column:
    return F.abs(_c(a) - _c(b)) <= tolerance


def shape_text(shape: Column | str) -> Column:
    return F.array_join(F.transform(_c(shape), lambda n: n.cast("string")), "x")


def orientation(axes: Column | str) -> Column:
    """Letters of the directions of a 3 x 3 array of axis vectors (one for each voxel axis): L/R, P/A, I/S by the largest entry."""

    def letter(v: Column) -> Column:
        a = F.transform(v, F.abs)
        k = F.array_position(a, F.array_max(a)).cast("int")
        up = F.element_at(v, k) > 0
        return F.when(
            k == 1, F.when(up, "R").otherwise("L"),
        ).when(k == 2, F.when(up, "A").otherwise("P")).otherwise(F.when(up, "S").otherwise("I"))

    return F.array_join(F.transform(_c(axes), letter), "")


def determinant_sign(axes: Column | str) -> Column:
    m = lambda i, j: F.element_at(F.element_at(_c(axes), i + 1), j + 1)
    d = m(0, 0) * (
        m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)
    ) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    return F.signum(d).cast("int")


def same_grid(shape_a, shape_b, affine_a, affine_b, absolute: float = 1e-3, relative: float = 1e-5) -> Column:
    """Equal shapes, and affines (flat arrays) that agree within absolute + relative * |b|."""
    near = F.forall(F.zip_with(_c(affine_a), _c(affine_b), lambda a, b: F.abs(a - b) <= absolute + relative * F.abs(b)), lambda x: x)
    return (_c(shape_a) == _c(shape_b)) & near


def hash16(x: Column | str) -> Column:
    return F.substring(F.sha2(_c(x), 256), 1, 16)


def utc_day(x: Column | str) -> Column:
    return F.date_format(_c(x), "d MMM yyyy")


def markdown(x: Column | str) -> Column:
    return F.replace(F.replace(_c(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def number_text(x: Column | str, digits: int = 4, missing: str = "—") -> Column:
    x = _c(x).cast("double")
    return F.when(x.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", x))


def nested(document: Column | str, path: str) -> Column:
    """A number at a dotted path of a JSON text; NULL where the path ends early or holds no finite number."""
    return finite(F.get_json_object(_c(document), f"$.{path}").try_cast("double"))
