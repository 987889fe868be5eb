"""Business rules as native Column expressions.

Every function returns a ``pyspark.sql.Column`` built from built-in
functions, so the rules stay inside whole-stage codegen and Catalyst can push
or fold them.  No Python UDF is involved anywhere in this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's values for right results.
# ---------------------------------------------------------------------------

# Purchase urgency → category; anything else (or null) is "Programado".
URGENCY_CATEGORY = {"alta": "Critico", "media": "Programado", "baja": "No critico"}
URGENCY_DEFAULT = "Programado"

# Lead-time bins, right-closed: (0,7] (7,14] (14,100]; outside → null.
LEAD_TIME_BINS = [(0, 7, "Corto (<=7d)"), (7, 14, "Medio (8-14d)"), (14, 100, "Largo (>14d)")]

# Quote risk bins, right-closed: (-1,10] (10,25] (25,100]; outside → null.
RISK_BINS = [(-1, 10, "Bajo"), (10, 25, "Medio"), (25, 100, "Alto")]

# Churn segments on the unrounded probability.
SEGMENT_HIGH = 0.60
SEGMENT_MEDIUM = 0.35
RETENTION_ACTION = {
    "ALTO": "Contacto prioritario + oferta de retención",
    "MEDIO": "Campaña de fidelización automatizada",
    "BAJO": "Monitoreo estándar",
}
AT_RISK_THRESHOLD = 0.5

# Age generalisation: upper bounds (exclusive) and labels; the rest is 65+.
AGE_BANDS = [(25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"), (65, "55-64")]
AGE_BAND_TOP = "65+"

# Supplier RUT format (format only, no check digit).
RUT_PATTERN = r"^\d{1,2}\.\d{3}\.\d{3}[-][0-9Kk]$"
# Python's \d matches every Unicode decimal digit; Java and RE2 spell that \p{Nd}
RUT_PATTERN_ENGINE = RUT_PATTERN.replace(r"\d", r"\p{Nd}")

# Price ranges per product keyword, in priority order: the first keyword found
# (case-insensitive substring) decides; no keyword → valid.
PRICE_RANGES = [
    ("Laptops", 100000, 150000000),
    ("Resmas", 100, 10000000),
    ("Toner", 1000, 50000000),
    ("Sillas", 10000, 100000000),
    ("Servidor", 100000, 100000000),
    ("Escritorios", 10000, 100000000),
    ("Licencias", 5000, 100000000),
    ("Cables", 100, 10000000),
    ("Monitores", 50000, 100000000),
    ("Extinguidores", 1000, 20000000),
    ("Router", 10000, 50000000),
    ("Papel", 100, 1000000),
    ("Camaras", 10000, 50000000),
    ("Antivirus", 5000, 50000000),
    ("Mesas", 50000, 100000000),
]

# Pseudonym: first 16 hex characters of SHA-256("<salt>:<value>").
PSEUDONYM_HEX_CHARS = 16
# The salt is configuration (a secret in production): ``cauce.privacy.salt``
# in the session conf; jobs refuse to run without one.
SALT_CONF = "cauce.privacy.salt"


def salt_from(spark) -> str:
    """The pseudonymisation salt configured on the session."""
    salt = spark.conf.get(SALT_CONF, None)
    if not salt:
        raise ValueError(f"{SALT_CONF} is not set: pseudonyms need a secret salt")
    return salt

# Numeric text accepted by the validators (Python float() grammar without
# underscores, inf or nan; see SURVEY §8 T3), applied after whitespace is
# stripped and non-ASCII decimal digits are folded to ASCII.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Strict ISO date text (yyyy-MM-dd with two-digit month and day).
ISO_DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"


def _unicode_tables():
    """Built from a rule (the Unicode database), not listed: Python's
    ``str.strip``/``float`` treat every ``isspace()`` character as whitespace
    and every decimal digit (category Nd) as a digit; Java's and RE2's
    ``\\s``/``\\d`` are ASCII only.  Basic Multilingual Plane only."""
    import unicodedata
    ws, d_from, d_to = [], [], []
    for cp in range(0x10000):
        ch = chr(cp)
        if ch.isspace():
            ws.append(cp)
        elif cp >= 0x80 and unicodedata.decimal(ch, None) is not None:
            d_from.append(ch)
            d_to.append(str(unicodedata.decimal(ch)))
    return ws, "".join(d_from), "".join(d_to)


_WS_CODEPOINTS, DIGITS_FROM, DIGITS_TO = _unicode_tables()
WS_CHARS = "".join(chr(cp) for cp in _WS_CODEPOINTS)  # trimmed by strip_ws


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Text helpers
# ---------------------------------------------------------------------------

def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace as Python ``str.strip`` does
    (all Unicode whitespace, not only spaces)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def numeric_form(c) -> Column:
    """Stripped text with non-ASCII decimal digits folded to ASCII."""
    return F.translate(strip_ws(_c(c).cast("string")), DIGITS_FROM, DIGITS_TO)


def is_blank(c) -> Column:
    return _c(c).isNull() | (F.length(strip_ws(c)) == 0)


def to_double(c) -> Column:
    """Text → double when it matches the numeric grammar; otherwise null."""
    t = numeric_form(c)
    return F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))


def is_numeric_text(c) -> Column:
    """Python ``float(x)`` succeeds: a null (NaN) value passes, as in the reference."""
    return _c(c).isNull() | numeric_form(c).rlike(NUMERIC_TEXT)


def to_iso_date(c) -> Column:
    """Strict ``yyyy-MM-dd`` text → date, other formats → null."""
    txt = _c(c).cast("string")
    return F.when(txt.rlike(ISO_DATE_TEXT), F.try_to_date(txt, "yyyy-MM-dd"))


def is_iso_date(c) -> Column:
    return F.coalesce(to_iso_date(c).isNotNull(), F.lit(False))


# ---------------------------------------------------------------------------
# Procurement rules
# ---------------------------------------------------------------------------

def urgency_category(c) -> Column:
    m = F.create_map(*[F.lit(x) for kv in URGENCY_CATEGORY.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(_c(c))), F.lit(URGENCY_DEFAULT))


def _right_closed_bins(c, bins) -> Column:
    x = _c(c)
    expr = None
    for lo, hi, label in bins:
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def lead_time_bucket(c) -> Column:
    return _right_closed_bins(c, LEAD_TIME_BINS)


def risk_level(c) -> Column:
    return _right_closed_bins(c, RISK_BINS)


def savings_pct(budget, best) -> Column:
    """round((budget-best)/budget*100, 2); null when unmatched or budget is 0."""
    return F.round(F.try_divide(_c(budget) - _c(best), _c(budget)) * 100, 2)


def rut_is_valid(c) -> Column:
    return F.coalesce(strip_ws(c).rlike(RUT_PATTERN_ENGINE), F.lit(False))


def price_in_range(price, product) -> Column:
    """First matching keyword decides the inclusive range; no keyword → true."""
    p = _c(price)
    name = F.lower(_c(product).cast("string"))
    expr = None
    for kw, lo, hi in PRICE_RANGES:
        cond = F.coalesce(name.contains(kw.lower()), F.lit(False))
        ok = F.coalesce((p >= lo) & (p <= hi), F.lit(False))
        expr = F.when(cond, ok) if expr is None else expr.when(cond, ok)
    return expr.otherwise(F.lit(True))


def price_rule_table(spark):
    """The keyword ranges as a small DataFrame (15 rows) for the join form."""
    rows = [(i, kw.lower(), float(lo), float(hi)) for i, (kw, lo, hi) in enumerate(PRICE_RANGES)]
    return spark.createDataFrame(rows, "prioridad int, clave string, precio_min double, precio_max double")


# ---------------------------------------------------------------------------
# Churn rules
# ---------------------------------------------------------------------------

def risk_segment(prob) -> Column:
    p = _c(prob)
    return (F.when(p >= SEGMENT_HIGH, "ALTO")
            .when(p >= SEGMENT_MEDIUM, "MEDIO")
            .when(p.isNotNull(), "BAJO"))


def retention_action(segment) -> Column:
    m = F.create_map(*[F.lit(x) for kv in RETENTION_ACTION.items() for x in kv])
    return F.element_at(m, _c(segment))


def at_risk_flag(prob) -> Column:
    return _c(prob) >= AT_RISK_THRESHOLD


# ---------------------------------------------------------------------------
# Privacy rules
# ---------------------------------------------------------------------------

def pseudonym(c, salt: str) -> Column:
    """First 16 hex of sha256('salt:value'); null stays null."""
    txt = F.concat(F.lit(f"{salt}:"), _c(c).cast("string"))
    return F.substring(F.sha2(txt, 256), 1, PSEUDONYM_HEX_CHARS)


def age_band(c) -> Column:
    """Generalised age; a null age stays null."""
    x = _c(c)
    expr = None
    for upper, label in AGE_BANDS:
        expr = F.when(x < upper, label) if expr is None else expr.when(x < upper, label)
    return expr.when(x.isNotNull(), AGE_BAND_TOP)


# ---------------------------------------------------------------------------
# Documented rules (strategy document; not coded in the reference)
# ---------------------------------------------------------------------------

# FIXED VALUES — documented rule parameters.
AGE_CLAMP = (0, 120)
BINARY_VALUES = (0, 1)
LATIN_TEXT = r"^[a-zA-Z0-9\s\.,!\?\-\(\)áéíóúÁÉÍÓÚñÑ]+$"
FALLBACK_COMPLAINTS = 5


def clamp_age(c) -> Column:
    lo, hi = AGE_CLAMP
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def is_binary(c) -> Column:
    return F.coalesce(_c(c).isin(*BINARY_VALUES), F.lit(False))


def is_latin_text(c) -> Column:
    return F.coalesce(_c(c).rlike(LATIN_TEXT), F.lit(False))


def fallback_segment(complaints) -> Column:
    """Segment without a model: more than 5 complaints → ALTO, else BAJO."""
    x = _c(complaints)
    return F.when(x > FALLBACK_COMPLAINTS, F.lit("ALTO")).when(x.isNotNull(), F.lit("BAJO"))
