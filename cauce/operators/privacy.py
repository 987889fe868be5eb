"""Privacy operators: salted pseudonyms, generalised ages, role views, audit.

The salt comes from the caller (configuration / secret).  It becomes a literal
of the plan, so plans with pseudonyms must not be logged where the salt is a
secret (SURVEY §8 T14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.functions import rules as R

# FIXED VALUES — role permissions: see sensitive columns, see scoring, export.
ROLES = {
    "admin": {"ver_sensibles": True, "ver_scoring": True, "exportar": True},
    "analista": {"ver_sensibles": False, "ver_scoring": True, "exportar": True},
    "retencion": {"ver_sensibles": False, "ver_scoring": True, "exportar": False},
    "auditor": {"ver_sensibles": False, "ver_scoring": False, "exportar": False},
}
SENSITIVE_COLUMNS = ["edad"]
SCORING_COLUMNS = ["prob_abandono", "segmento_riesgo", "accion_retencion"]


def pseudonymize(df: DataFrame, cols, salt: str, suffix: str = "") -> DataFrame:
    """Replace (or, with ``suffix``, add) each column by its salted pseudonym."""
    return df.withColumns({f"{c}{suffix}": R.pseudonym(c, salt) for c in cols})


def add_rut_hash(suppliers: DataFrame, salt: str, drop_original: bool = False) -> DataFrame:
    """Suppliers gain ``rut_hash``; ``rut`` is kept unless ``drop_original``."""
    if "rut" not in suppliers.columns:
        return suppliers
    out = suppliers.withColumn("rut_hash", R.pseudonym("rut", salt))
    return out.drop("rut") if drop_original else out


def sensitive_columns(df: DataFrame) -> list[str]:
    """Columns flagged ``{"sensible": true}`` in their metadata, plus the
    known sensitive names."""
    flagged = [f.name for f in df.schema.fields if (f.metadata or {}).get("sensible")]
    return [c for c in df.columns if c in flagged or c in SENSITIVE_COLUMNS]


def role_view(df: DataFrame, role: str) -> DataFrame:
    """The frame as a role may see it: generalised age without 'ver_sensibles',
    no scoring columns without 'ver_scoring'.  Unknown role → PermissionError."""
    if role not in ROLES:
        raise PermissionError(f"Rol desconocido: {role}")
    perms = ROLES[role]
    out = df
    if not perms["ver_sensibles"]:
        out = out.withColumns({c: R.age_band(c) for c in sensitive_columns(out)})
    if not perms["ver_scoring"]:
        out = out.drop(*[c for c in SCORING_COLUMNS if c in out.columns])
    return out


def can_export(role: str) -> bool:
    return ROLES.get(role, {}).get("exportar", False)


AUDIT_SCHEMA = "ts timestamp, accion string, modulo string, tabla string, filas long, extra string"


def audit_record(spark: SparkSession, accion: str, modulo: str, tabla: str, filas, extra: str | None = None
                 ) -> DataFrame:
    """One audit row; ``filas`` may be an int or a scalar Column (e.g. a count)."""
    n = filas if not isinstance(filas, int) else F.lit(filas)
    return spark.range(1).select(
        F.current_timestamp().alias("ts"), F.lit(accion).alias("accion"), F.lit(modulo).alias("modulo"),
        F.lit(tabla).alias("tabla"), n.cast("long").alias("filas"), F.lit(extra).cast("string").alias("extra"))
