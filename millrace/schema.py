"""The catalog's one schema, its closed lists and its ranks. Values are data and stay as they are."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

_KINDS = {
    "string": StringType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "boolean": BooleanType(),
    "array<string>": ArrayType(StringType()),
}
# The fields of a record.
_FIELDS = """id string, title string, institution string, institution_country string, provider_type string, platform string,
    course_code string, domain string, topics array<string>, level string, language array<string>,
    subtitles array<string>, duration_weeks double, hours_per_week double, pace string, cost_access string,
    credential_type string, credential_free boolean, credential_price_usd double, credential_issuer string,
    credential_verifiable boolean, url_official string, url_credential_info string, url_syllabus string,
    prerequisites string, relevance_ppp_infra int, verification_status string, last_verified string,
    source_of_truth string, notes string, status string, enrollment_open boolean, start_date string, end_date string,
    access_mode string, discovered_at string, updated_at string, content_hash string,
    certificate_requirements string, financial_aid_available boolean, official_institution_url string"""
CATALOG = StructType([StructField(n, _KINDS[k]) for n, k in (x.split() for x in _FIELDS.split(","))])

# What the catalog's records may say.
REQUIRED = "id title institution domain url_official verification_status source_of_truth".split()
CREDENTIAL_RANKS = {
    "certificado gratuito": 0,
    "badge gratuito": 1,
    "declaracion de logro": 2,
    "certificado pagado verificable": 3,
    "certificado pagado": 4,
}
ENUMS = {
    "domain": "ai-tecnica ai-negocio pmo finanzas gerencia derecho sostenibilidad datos salud ciencias humanidades".split(),
    "provider_type": ["institucion", "proveedor-ia"],
    "level": ["introductorio", "intermedio", "avanzado"],
    "pace": ["autoadministrado", "cohorte", "programado"],
    "cost_access": ["gratis", "audit gratuito", "pagado"],
    "credential_type": list(CREDENTIAL_RANKS),
    "verification_status": ["VERIFICADO", "PENDIENTE", "REVERIFICAR", "NO_DISPONIBLE", "MANUAL_REVIEW_REQUIRED"],
    "status": ["activo", "archivado", "no disponible", "desconocido"],
    "access_mode": ["permanente", "cohorte", "archivo"],
}
URL_FIELDS = "url_official url_credential_info url_syllabus source_of_truth official_institution_url".split()
DATE_FIELDS = "last_verified start_date end_date discovered_at updated_at".split()
LIST_FIELDS = "topics language subtitles".split()
CANONICAL_FIELDS = "url_official url_credential_info url_syllabus source_of_truth".split()
WATCHED = """title url_official credential_type credential_free credential_price_usd verification_status
status last_verified""".split()
AI_PROVIDERS = ["Anthropic", "OpenAI", "Google", "xAI", "DeepSeek", "Meta", "Mistral AI"]
FACETS = {
    "providerType": "provider_type",
    "domain": "domain",
    "institution": "institution",
    "country": "institution_country",
    "platform": "platform",
    "level": "level",
    "credentialType": "credential_type",
    "verificationStatus": "verification_status",
}
