"""Sales cleaning, rule validation, quarantine and load preparation.

clean → validate (one boolean column per rule) → readable rejection reasons →
split into valid / rejected → tag lineage → project onto the target tables →
pre-load check.  One flagged DataFrame feeds both outputs, so a caller that
writes both should persist it once (see ``cauce.plans.jobs.run_sales``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce.functions import rules as R

RAW_COLUMNS = ["id", "fecha", "producto", "cantidad", "precio", "ciudad"]

# FIXED VALUES — rule columns, in the order their messages are listed.
RULES = [
    "val_fecha", "val_cantidad_tipo", "val_precio_tipo", "val_cantidad_negocio",
    "val_precio_negocio", "val_descuento", "val_producto", "val_ciudad",
]
# FIXED VALUES — rejection messages and the valid-row text.
MESSAGES = {
    "val_fecha": "Fecha inválida",
    "val_cantidad_tipo": "Cantidad no numérica",
    "val_precio_tipo": "Precio no numérico",
    "val_cantidad_negocio": "Cantidad fuera de rango lógico",
    "val_precio_negocio": "Precio inválido o menor/igual a 0",
    "val_descuento": "Descuento fuera de rango 0-100",
    "val_producto": "Producto vacío o nulo",
    "val_ciudad": "Ciudad vacía o nula",
}
# FIXED VALUES — the valid-row text, the separator of messages, the quantity limit, the source tag.
VALID_TEXT = "Registro válido"
MESSAGE_SEPARATOR = " | "
QUANTITY_MAX = 500
SOURCE_TAG = "python_notebook"

# FIXED VALUES — target table layouts (load step) and their required columns.
CLEAN_COLUMNS = ["id", "fecha", "producto", "cantidad", "precio", "ciudad", "total",
                 "estado_calidad", "fuente"]
ERROR_COLUMNS = ["id", "fecha", "producto", "cantidad", "precio", "ciudad", "estado_calidad",
                 "fuente", "observacion"]
CLEAN_REQUIRED = ["id", "fecha", "producto", "cantidad", "precio", "ciudad", "estado_calidad"]
ERROR_REQUIRED = ["id", "estado_calidad", "observacion"]


# ---------------------------------------------------------------------------
# cleaning (notebook 1)
# ---------------------------------------------------------------------------

def clean_sales(raw: DataFrame, cols=RAW_COLUMNS) -> DataFrame:
    """Dedup whole rows → drop rows with a null → parse numbers and ISO dates,
    dropping rows that fail → ``total = cantidad * precio``.

    ``dropDuplicates`` is an aggregate with map-side partial aggregation, so a
    heavily duplicated row collapses before the shuffle.
    """
    df = raw.select(*cols).dropDuplicates().na.drop("any")
    df = (df.withColumn("precio", R.to_double("precio"))
            .withColumn("cantidad", R.to_double("cantidad"))
            .withColumn("fecha", R.to_iso_date("fecha"))
            .na.drop("any"))
    return df.withColumn("total", F.col("cantidad") * F.col("precio"))


def cleaned_text(raw: DataFrame, cols=RAW_COLUMNS) -> DataFrame:
    """The rows that :func:`clean_sales` keeps, with their fields still as text and
    the other columns (the discount) of the delivery: what validation takes."""
    keep = [c for c in raw.columns if c in cols or c == "descuento"]
    rows = raw.select(*keep).dropDuplicates().na.drop("any", subset=list(cols))
    parses = R.to_double("precio").isNotNull() & R.to_double("cantidad").isNotNull() & R.to_iso_date("fecha").isNotNull()
    return rows.filter(parses)


# ---------------------------------------------------------------------------
# validation (notebook 2)
# ---------------------------------------------------------------------------

def with_discount(df: DataFrame) -> DataFrame:
    """Add ``descuento`` as null when absent; an existing column is kept."""
    if "descuento" in df.columns:
        return df
    return df.withColumn("descuento", F.lit(None).cast("double"))


_HELPERS = ["_nq", "_nq_ok", "_np", "_np_ok"]


def _with_parsed(df: DataFrame) -> DataFrame:
    """Normalised amount text and its grammar match, computed once per row
    (the rules below read them several times, partly inside conditionals
    where common-subexpression elimination does not reach)."""
    df = df.withColumns({"_nq": R.numeric_form("cantidad"), "_np": R.numeric_form("precio")})
    return df.withColumns({"_nq_ok": F.col("_nq").rlike(R.NUMERIC_TEXT),
                           "_np_ok": F.col("_np").rlike(R.NUMERIC_TEXT)})


def rule_columns(df: DataFrame) -> dict:
    """Column expression of each rule (True = passes); expects ``_with_parsed``."""
    qty = F.when(F.col("_nq_ok"), F.col("_nq").try_cast("double"))
    price = F.when(F.col("_np_ok"), F.col("_np").try_cast("double"))
    numeric = dict(df.dtypes).get("descuento") in ("double", "float", "int", "bigint", "smallint")
    disc_v = F.col("descuento").cast("double") if numeric else R.to_double("descuento")
    disc_v = F.when(~F.isnan(disc_v), disc_v)
    return {
        "val_fecha": R.is_iso_date("fecha"),
        "val_cantidad_tipo": F.col("cantidad").isNull() | F.col("_nq_ok"),
        "val_precio_tipo": F.col("precio").isNull() | F.col("_np_ok"),
        "val_cantidad_negocio": F.coalesce((qty > 0) & (qty <= QUANTITY_MAX), F.lit(False)),
        "val_precio_negocio": F.coalesce((price > 0) & ~F.isnan(price), F.lit(False)),
        "val_descuento": F.col("descuento").isNull()
        | F.coalesce((disc_v >= 0) & (disc_v <= 100), F.lit(False)),
        "val_producto": ~R.is_blank("producto"),
        "val_ciudad": ~R.is_blank("ciudad"),
    }


def observations(flags: dict | None = None) -> F.Column:
    """Rejection reasons joined by ' | ' in rule order; range messages only
    when the type check passed; 'Registro válido' when none apply."""
    c = flags or {r: F.col(r) for r in RULES}
    parts = []
    for r in RULES:
        fails = ~c[r]
        if r == "val_cantidad_negocio":
            fails = c["val_cantidad_tipo"] & ~c[r]
        if r == "val_precio_negocio":
            fails = c["val_precio_tipo"] & ~c[r]
        parts.append(F.when(fails, F.lit(MESSAGES[r])))
    joined = F.concat_ws(MESSAGE_SEPARATOR, *parts)
    return F.when(joined == "", F.lit(VALID_TEXT)).otherwise(joined)


def validate_sales(df: DataFrame, keep_parsed: bool = False) -> DataFrame:
    """Add the 8 rule flags, ``registro_valido`` and ``observaciones``.

    ``keep_parsed`` also keeps the parsed amounts (``_cantidad_num``,
    ``_precio_num``) so the load projection does not parse them again.
    """
    df = _with_parsed(with_discount(df))
    flags = rule_columns(df)
    df = df.withColumns(flags)
    df = df.withColumn("registro_valido", reduce(lambda a, b: a & b, [F.col(r) for r in RULES]))
    df = df.withColumn("observaciones", observations())
    if keep_parsed:
        df = df.withColumns({"_cantidad_num": F.when(F.col("_nq_ok"), F.col("_nq").try_cast("double")),
                             "_precio_num": F.when(F.col("_np_ok"), F.col("_np").try_cast("double"))})
    return df.drop(*_HELPERS)


def split_quarantine(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) from one flagged DataFrame."""
    return flagged.filter(F.col("registro_valido")), flagged.filter(~F.col("registro_valido"))


def tag_valid(valid: DataFrame, source: str = SOURCE_TAG) -> DataFrame:
    """Lineage tags and typed amounts for accepted rows."""
    parsed = "_cantidad_num" in valid.columns
    qty = F.col("_cantidad_num") if parsed else R.to_double("cantidad")
    price = F.col("_precio_num") if parsed else R.to_double("precio")
    return (valid.withColumn("estado_calidad", F.lit("valido"))
                 .withColumn("fuente", F.lit(source))
                 .withColumn("cantidad", qty).withColumn("precio", price)
                 .withColumn("total", qty * price))


def tag_rejected(rejected: DataFrame, source: str = SOURCE_TAG) -> DataFrame:
    return (rejected.withColumn("estado_calidad", F.lit("error"))
                    .withColumn("fuente", F.lit(source))
                    .withColumn("observacion", F.col("observaciones")))


def project_clean(valid_tagged: DataFrame) -> DataFrame:
    """Rows for ``ventas_clean``: amounts as decimal(18,2) (the table's NUMERIC).

    ``id`` stays bigint (an int key would overflow on large sources)."""
    dec = "decimal(18,2)"
    return valid_tagged.select(
        "id", F.col("fecha").cast("string").alias("fecha"),
        "producto",
        F.col("cantidad").cast(dec).alias("cantidad"), F.col("precio").cast(dec).alias("precio"),
        "ciudad",
        (F.col("cantidad").cast(dec) * F.col("precio").cast(dec)).cast(dec).alias("total"),
        "estado_calidad", "fuente")


def project_rejected(rejected_tagged: DataFrame) -> DataFrame:
    """Rows for ``ventas_error``: original text kept."""
    return rejected_tagged.select(
        "id",
        *[F.col(c).cast("string").alias(c) for c in ["fecha", "producto", "cantidad", "precio", "ciudad"]],
        "estado_calidad", "fuente", "observacion")


def load_ready_errors(df: DataFrame, required) -> DataFrame:
    """Pre-load check: one error text per missing column or column with nulls.

    Missing columns are known at plan time; null counts come from a single
    ``count_if`` aggregate over the whole frame (one pass, one output row),
    unpivoted into ``(columna, error)`` rows.  An empty result means ready.
    """
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    parts = []
    if missing:
        parts.append(spark.createDataFrame(
            [(c, f"Falta la columna obligatoria: {c}") for c in missing], "columna string, error string"))
    if present:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
        stacked = counts.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("columna"), F.col(c).alias("nulos")) for c in present])).alias("s"))
        parts.append(stacked.filter(F.col("s.nulos") > 0).select(
            F.col("s.columna").alias("columna"),
            F.concat(F.lit("La columna "), F.col("s.columna"), F.lit(" contiene valores nulos")).alias("error")))
    if not parts:
        return spark.createDataFrame([], "columna string, error string")
    return reduce(DataFrame.unionByName, parts)


def valid_counts(flagged: DataFrame) -> DataFrame:
    """Valid / invalid / total rows and the failures per rule, in one pass."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("registro_valido")).alias("validos"),
            F.count_if(~F.col("registro_valido")).alias("invalidos")]
    aggs += [F.count_if(~F.col(r)).alias(f"fallas_{r}") for r in RULES]
    return flagged.agg(*aggs)
