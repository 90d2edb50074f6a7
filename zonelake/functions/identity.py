"""Anonymous references, credentials in urls, and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REF = r"^pr_[0-9a-f]{16}$"
_CREDENTIALS = r"([A-Za-z][A-Za-z0-9+.-]*://)([^/\s]+)@"
MASK = "***"


def person_ref(salt: Column, track: Column) -> Column:
    return F.concat(F.lit("pr_"), F.substring(F.sha2(F.concat(salt, F.lit(":"), track.cast("string")), 256), 1, 16))


def global_ref(salt: Column, number: Column) -> Column:
    return F.concat(F.lit("gp_"), F.substring(F.sha2(F.concat(salt, F.lit(":g:"), number.cast("string")), 256), 1, 16))


def looks_anonymous(ref: Column) -> Column:
    return F.coalesce(ref.rlike(_REF), F.lit(False))


def mask_credentials(url: Column) -> Column:
    """Hides user and password up to the last @ before a slash, keeping whether there was a password."""
    with_password = F.regexp_replace(url, r"([A-Za-z][A-Za-z0-9+.-]*://)([^/:@\s]*):([^/\s]*)@", f"$1{MASK}:{MASK}@")
    return F.regexp_replace(with_password, r"([A-Za-z][A-Za-z0-9+.-]*://)(?!\*\*\*:\*\*\*@)([^/\s]+)@", f"$1{MASK}@")


def contains_credentials(url: Column) -> Column:
    found = url.rlike(_CREDENTIALS) & ~F.coalesce(mask_credentials(url) == url, F.lit(False))
    return F.coalesce(found, F.lit(False))


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different sizes are an error."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double"))
    return checked.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def bank_similarity(mean_a: Column, mean_b: Column, bank_a: Column, bank_b: Column) -> Column:
    """The better of the means' similarity and 0.9 of that of the best pair of views."""
    best = F.array_max(F.flatten(F.transform(bank_a, lambda x: F.transform(bank_b, lambda y: dot(x, y)))))
    return F.greatest(dot(mean_a, mean_b), F.lit(0.9) * best)
