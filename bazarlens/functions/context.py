"""Text and JSON expressions for the customer context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazarlens.fixed_values import (
    HEADING_CATALOG,
    HEADING_PROFILE,
    HEADING_STATUS,
    LOYAL_ACTIVE,
    LOYAL_AT_RISK,
    PERSONAS,
    SLEEPING_HIGH_VALUE,
)


def history_text(frequency: Column, monetary: Column, recency: Column, medium_from: float, high_from: float) -> Column:
    """Purchase history as one sentence."""
    kind = F.when(
        frequency >= 2, F.concat(F.lit("cliente recurrente ("), frequency.cast("string"), F.lit(" compras)"))
    ).otherwise(F.concat(F.lit("comprador de primera vez ("), frequency.cast("string"), F.lit(" compra)")))
    level = F.when(monetary >= high_from, "alto").when(monetary >= medium_from, "medio").otherwise("bajo")
    return F.concat(
        kind,
        F.lit(", gasto acumulado "),
        level,
        F.lit(" de R$"),
        # Cents first: a sum of doubles may miss a half by its last digit.
        F.bround(F.round(monetary, 2), 0).cast("long").cast("string"),
        F.lit(", inactivo hace "),
        recency.cast("string"),
        F.lit(" dias."),
    )


def order_status_text(recency: Column, recent_days: int) -> Column:
    recent = F.when(recency <= recent_days, "Hay un pedido reciente en el sistema.").otherwise(
        "Sin pedidos recientes en el sistema."
    )
    return F.concat(F.lit("Ultimo pedido hace "), recency.cast("string"), F.lit(" dias. "), recent)


def scenario_route(segment: Column, complaint: Column) -> Column:
    """Persona by fixed rules; the default branch is ours."""
    return (
        F.when(complaint.isNotNull() | (segment == LOYAL_AT_RISK), "Marco")
        .when(segment == SLEEPING_HIGH_VALUE, "VIP")
        .when(segment == LOYAL_ACTIVE, "Luna")
        .otherwise("Luna")
    )


def profile_json() -> Column:
    """The profile as compact JSON; ``to_json`` leaves null fields out."""
    complaint = F.when(
        F.col("queja_categoria").isNotNull(),
        F.struct(F.col("queja_categoria").alias("categoria"), F.col("queja_detalle").alias("detalle_original")),
    )
    return F.to_json(
        F.struct(
            "edad",
            "genero",
            F.col("segmento").alias("segmento_crm"),
            "historial_compras",
            complaint.alias("experiencia_negativa_previa"),
        )
    )


def json_string(text: Column) -> Column:
    """One quoted and escaped JSON string."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - F.lit(2))


def _field(name: str, value: Column, indent: int) -> Column:
    return F.concat(F.lit(" " * indent + f'"{name}": '), value)


def profile_block() -> Column:
    """The profile as JSON indented by two blanks; unknown fields left out."""
    complaint = F.concat(
        F.lit("{\n"),
        _field("categoria", json_string(F.col("queja_categoria")), 4),
        F.lit(",\n"),
        _field("detalle_original", json_string(F.col("queja_detalle")), 4),
        F.lit("\n  }"),
    )
    lines = F.array(
        F.when(F.col("edad").isNotNull(), _field("edad", F.col("edad").cast("string"), 2)),
        F.when(F.col("genero").isNotNull(), _field("genero", json_string(F.col("genero")), 2)),
        F.when(F.col("segmento").isNotNull(), _field("segmento_crm", json_string(F.col("segmento")), 2)),
        _field("historial_compras", json_string(F.col("historial_compras")), 2),
        F.when(F.col("queja_categoria").isNotNull(), _field("experiencia_negativa_previa", complaint, 2)),
    )
    return F.concat(F.lit("{\n"), F.array_join(F.array_compact(lines), ",\n"), F.lit("\n}"))


def catalog_block() -> Column:
    """One product of the catalogue as indented JSON."""
    tags = F.concat(
        F.lit("[\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit(" " * 6), json_string(t))), ",\n"), F.lit("\n    ]")
    )
    prices = F.concat(
        F.lit("{\n"),
        _field("minimo", F.col("rango_precios.minimo").cast("string"), 6),
        F.lit(",\n"),
        _field("maximo", F.col("rango_precios.maximo").cast("string"), 6),
        F.lit("\n    }"),
    )
    fields = [
        _field("id", json_string(F.col("id")), 4),
        _field("nombre", json_string(F.col("nombre")), 4),
        _field("categoria", json_string(F.col("categoria")), 4),
        _field("descripcion", json_string(F.col("descripcion")), 4),
        _field("precio_promedio_R$", F.col("precio_promedio_real").cast("string"), 4),
        _field("rango_precios_R$", prices, 4),
        _field("unidades_vendidas", F.col("unidades_vendidas").cast("string"), 4),
        _field("tags", tags, 4),
    ]
    return F.concat(F.lit("  {\n"), F.array_join(F.array(*fields), ",\n"), F.lit("\n  }"))


def prompt_text(persona: Column, profile: Column, catalog: Column, status: Column) -> Column:
    """Persona text with profile, catalogue and order status put in."""

    def choose(part: str) -> Column:
        names = list(PERSONAS)
        choice = F.when(persona == names[0], PERSONAS[names[0]][part])
        for name in names[1:]:
            choice = choice.when(persona == name, PERSONAS[name][part])
        return choice

    gap = F.lit("\n\n")
    return F.concat(
        choose("opening"), gap,
        F.lit(HEADING_PROFILE + "\n"), profile, gap,
        F.lit(HEADING_CATALOG + "\n"), catalog, gap,
        F.lit(HEADING_STATUS + "\n"), status, gap,
        choose("closing"),
    )
