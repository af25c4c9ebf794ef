"""What people read instead of facet values, and the groups that values are shown in: lookups in short fixed tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schema import AI_PROVIDERS

# Labels of values, short names of institutions, and groups of values by facet.
LABELS = {
    "ai-tecnica": "IA técnica",
    "ai-negocio": "IA de negocio",
    "pmo": "PMO y proyectos",
    "finanzas": "Finanzas y evaluación",
    "gerencia": "Gerencia y liderazgo",
    "derecho": "Derecho y contratos",
    "sostenibilidad": "Sostenibilidad y energía",
    "datos": "Datos y estadística",
    "salud": "Salud y bienestar",
    "ciencias": "Ingeniería y ciencias",
    "humanidades": "Humanidades y sociales",
    "institucion": "Universidades y organismos",
    "proveedor-ia": "Proveedores de IA",
    "certificado gratuito": "Certificado gratuito",
    "badge gratuito": "Badge gratuito",
    "declaracion de logro": "Declaración de logro",
    "certificado pagado verificable": "Certificado pagado verificable",
    "certificado pagado": "Certificado pagado",
    "VERIFICADO": "Verificado",
    "PENDIENTE": "Pendiente",
    "REVERIFICAR": "Por reverificar",
    "NO_DISPONIBLE": "No disponible",
    "MANUAL_REVIEW_REQUIRED": "Revisión manual",
    "introductorio": "Introductorio",
    "intermedio": "Intermedio",
    "avanzado": "Avanzado",
    "US": "Estados Unidos",
    "GB": "Reino Unido",
    "DE": "Alemania",
    "CA": "Canadá",
    "CH": "Suiza",
    "AU": "Australia",
    "FR": "Francia",
    "CN": "China",
}
SHORT = {
    "Massachusetts Institute of Technology": "MIT",
    "University of California, Berkeley": "UC Berkeley",
    "Banco Interamericano de Desarrollo": "BID",
    "Hasso Plattner Institute": "Hasso Plattner",
    "Harvard University": "Harvard",
    "The Open University": "Open University",
}
GROUPS = {
    "domain": {
        "Inteligencia artificial": ["ai-tecnica", "ai-negocio"],
        "Gestión y negocio": ["pmo", "finanzas", "gerencia", "derecho"],
        "Ciencia y sociedad": ["datos", "ciencias", "sostenibilidad", "salud", "humanidades"],
    },
    "credentialType": {
        "Gratuitas": ["certificado gratuito", "badge gratuito", "declaracion de logro"],
        "De pago": ["certificado pagado verificable", "certificado pagado"],
    },
    "verificationStatus": {
        "Confirmado": ["VERIFICADO"],
        "Requiere revisión": ["PENDIENTE", "REVERIFICAR", "MANUAL_REVIEW_REQUIRED"],
        "Retirado": ["NO_DISPONIBLE"],
    },
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def label(facet: Column, value: Column) -> Column:
    """The label of a facet's value; the value itself where there is none."""
    return F.coalesce(F.when(facet == "institution", _lookup(SHORT, value)).otherwise(_lookup(LABELS, value)), value)


def group(facet: Column, value: Column) -> Column:
    """The group that a value is shown in; null for facets without groups."""
    by_value = {f"{name}|{v}": g for name, groups in GROUPS.items() for g, values in groups.items() for v in values}
    providers = F.when(value.isin(AI_PROVIDERS), LABELS["proveedor-ia"]).otherwise(LABELS["institucion"])
    return F.when(facet == "institution", providers).otherwise(_lookup(by_value, F.concat_ws("|", facet, value)))


def labelled(facets: DataFrame) -> DataFrame:
    """facets (facet, value, and more) with label and group_label."""
    facet, value = F.col("facet"), F.col("value")
    return facets.withColumns({"label": label(facet, value), "group_label": group(facet, value)})
