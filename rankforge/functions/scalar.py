"""Column functions with the audit's exact text, hash and number semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_zero(x: Column) -> Column:
    return F.when(finite(x), x).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log2_ratio(numerator: Column, denominator: Column) -> Column:
    return F.log2(numerator + 1.0) - F.log2(denominator + 1.0)


def robust_z(x: Column, low: Column, middle: Column, high: Column) -> Column:
    """(x - median) / IQR, an IQR of zero counting as one."""
    spread = high - low
    return (x - middle) / F.when(spread == 0, 1.0).otherwise(spread)


def concordant(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def geometric_mean(a: Column, b: Column) -> Column:
    return F.sqrt(F.abs(a * b))


# case

#: Characters that fold otherwise than they turn to lower case, from Unicode's own rule.
_FOLDS = {c: f for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (f := c.casefold()) != c.lower()}
_FOLDS = {c.lower(): f for c, f in _FOLDS.items()}


def casefold(x: Column) -> Column:
    """Full case folding: lower case, then what that leaves apart (sharp s and ss, both small sigmas, ligatures)."""
    one = {c: f for c, f in _FOLDS.items() if len(c) == len(f) == 1}
    low = F.translate(F.lower(x), "".join(one), "".join(one.values()))
    several = {c: f for c, f in _FOLDS.items() if c not in one}
    spelt = reduce(lambda t, cf: F.replace(t, F.lit(cf[0]), F.lit(cf[1])), several.items(), low)
    return F.when(low.rlike("[" + "".join(c for c in several if len(c) == 1) + "]"), spelt).otherwise(low)


def stripped(x: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


# hashing


def prefix_fold(key: Column, folds: int) -> Column:
    """First 8 bytes of SHA-256, big-endian, modulo the number of folds."""
    high = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % F.lit(folds)).cast("int")


def salted_fold(key: Column, salt: str, modulus: int) -> Column:
    """All 256 bits of SHA-256 of "salt|key" modulo `modulus`, eight hex digits at a time."""
    digest = F.sha2(F.concat(F.lit(f"{salt}|"), key), 256)
    out = F.lit(0).cast("long")
    for at in range(1, 65, 8):
        out = (out * F.lit((1 << 32) % modulus) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % F.lit(modulus)
    return out.cast("int")


def order_digest(key: Column, seed: int) -> Column:
    """Hex SHA-256 of "seed|key": a random-looking order that only depends on the key."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def draw_index(replicate: Column, position: Column, n: Column, seed: int) -> Column:
    """A reproducible draw from 0..n-1."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), position.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def uniform(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) from the key."""
    return F.conv(F.substring(order_digest(key, seed), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


# text


def contains_any(x: Column, terms: tuple[str, ...]) -> Column:
    text = F.lower(F.trim(F.coalesce(x, F.lit("unknown"))))
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


#: Spellings of treatment and response in the source data.
SPELLINGS = {
    "": "unknown",
    "nan": "unknown",
    "na": "unknown",
    "n/a": "unknown",
    "none": "unknown",
    "treatment.naive": "pre",
    "treatment_naive": "pre",
    "pretreatment": "pre",
    "baseline": "pre",
    "post.treatment": "post",
    "post_treatment": "post",
    "non-responder": "non_responder",
    "nonresponder": "non_responder",
    "non responder": "non_responder",
    "responder": "responder",
}


def clean_label(x: Column) -> Column:
    """Lower case, known spellings unified, everything but letters and digits to single underscores."""
    text = F.lower(F.trim(F.coalesce(x, F.lit("unknown"))))
    known = F.create_map(*[F.lit(v) for pair in SPELLINGS.items() for v in pair])
    return F.trim(F.regexp_replace(F.coalesce(known[text], text), r"[^a-z0-9]+", "_"), F.lit("_"))


def compartment(x: Column) -> Column:
    """Broad cell compartment of a label; the order of the rules matters."""
    v = clean_label(x)
    has = lambda *terms: reduce(lambda a, b: a | b, (F.contains(v, F.lit(t)) for t in terms))
    return (
        F.when(v == "unknown", v).when(has("cd8"), "cd8_t").when(has("cd4", "treg"), "cd4_t").when(has("nk"), "nk")
        .when(v.startswith("t_") | (v == "t") | has("t_cell"), "t_other").when(has("b_cell") | v.startswith("b_") | (v == "b"), "b")
        .when(has("mono", "macro", "myeloid", "dc", "dendritic"), "myeloid").when(has("tumor", "malignant", "melanoma", "epithelial"), "tumour")
        .when(has("fibro", "strom", "endo", "pericyte"), "stromal").otherwise(v)
    )


def response(x: Column) -> Column:
    """Responder, Non-responder or NULL; only unambiguous labels map."""
    text = F.trim(F.regexp_replace(F.upper(F.trim(x)), r"[^A-Z0-9]+", " "))
    return (
        F.when(text.isin("NR", "N", "NO"), "Non-responder").when(text.isin("R", "Y", "YES"), "Responder")
        .when(text.rlike(r"NON ?RESP|NO RESPONSE|PROGRESSIVE DISEASE|\bPD\b|PROGRESSOR"), "Non-responder")
        .when(text.rlike(r"COMPLETE RESPONSE|PARTIAL RESPONSE|\bCR\b|\bPR\b|\bRESPONDER\b"), "Responder")
    )


def sample_id(x: Column) -> Column:
    """P013.post.03 -> P13.post.3; P07 -> P7.pre; anything else trimmed."""
    text = F.trim(x)
    full = r"(?i)^P0*(\d+)\.(pre|post)\.0*(\d+)$"
    bare = r"(?i)^P0*(\d+)$"
    number = lambda pattern, group: F.regexp_extract(text, pattern, group)
    return (
        F.when(text.rlike(full), F.concat_ws(".", F.concat(F.lit("P"), number(full, 1)), F.lower(number(full, 2)), number(full, 3)))
        .when(text.rlike(bare), F.concat(F.lit("P"), number(bare, 1), F.lit(".pre")))
        .otherwise(text)
    )


def patient_id(x: Column) -> Column:
    text = F.trim(x)
    pattern = r"(?i)^P0*(\d+)$"
    return F.when(text.rlike(pattern), F.concat(F.lit("P"), F.regexp_extract(text, pattern, 1))).otherwise(text)


def site(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.trim(x)), F.lit("tumour"), F.lit("tumor")), r"\s+", " "))


def sample_key(x: Column) -> Column:
    """Lower case, pre/post unified, separators to single dots."""
    text = F.lower(F.trim(x))
    for long, short in (("pretreatment", "pre"), ("pre-treatment", "pre"), ("posttreatment", "post"), ("post-treatment", "post")):
        text = F.replace(text, F.lit(long), F.lit(short))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[_\-/\s]+", "."), r"\.+", "."), F.lit("."))


def add_months_capped(day: Column, months: int) -> Column:
    """Months later, on the same day of the month but the 28th at most."""
    shifted = F.add_months(F.trunc(day, "month"), months)
    return F.date_add(shifted, F.least(F.day(day), F.lit(28)) - 1)


def close(a: Column, b: Column, tolerance: float = 5e-7) -> Column:
    return F.abs(a - b) <= tolerance


#: The nine context views, as column and terms; None keeps every row.
TREATMENT, RESPONSE, COMPARTMENT = "treatment_state", "response_state", "cell_compartment"
VIEW_TERMS = {
    "pretreatment": (TREATMENT, ("pre", "naive", "baseline", "untreated", "t0"), ()),
    "on_or_post_treatment": (TREATMENT, ("on", "post", "treated", "t1", "t2"), ()),
    "responder": (RESPONSE, ("responder", "response", "cr", "pr"), ("non", "no response", "resistant")),
    "nonresponder": (RESPONSE, ("non", "no response", "resistant", "progress", "pd"), ()),
    "immune": (COMPARTMENT, ("immune", "t cell", "b cell", "myeloid", "nk", "lymph"), ()),
    "malignant": (COMPARTMENT, ("malignant", "tumour", "tumor", "cancer"), ()),
}


def views() -> dict[str, Column]:
    """The nine views as boolean columns; terms match as substrings, which is deliberate.

    "unknown" holds "nk" and so is immune, "untreated" holds "treated", and
    "progress" holds "pr".
    """
    disease = F.lower(F.trim(F.coalesce(F.col("disease"), F.lit("unknown"))))
    out = {"all": F.lit(True), "melanoma": disease == "melanoma", "nsclc": disease == "nsclc"}
    for name, (column, terms, unless) in VIEW_TERMS.items():
        out[name] = contains_any(F.col(column), terms)
        if unless:
            out[name] = out[name] & ~contains_any(F.col(column), unless)
    return out


#: The audit's feature columns, with the context filled in.
FEATURES = ("mean_expression_{context}", "differential_expression_{context}", "cell_type_specificity_{context}", "network_centrality", "druggable_class")
POPULARITY = "publication_count_pre_cutoff"


def feature_columns(context: str, popularity: bool = True) -> list[str]:
    """The supervised features of the context `id` or `ood`."""
    if context not in ("id", "ood"):
        raise ValueError(f"unknown context {context!r}")
    return [f.format(context=context) for f in FEATURES] + [POPULARITY] * popularity
