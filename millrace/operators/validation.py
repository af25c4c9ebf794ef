"""Coherence rules over catalog records: each rule is an expression that gives an issue or null.

Records may be typed (schema.CATALOG) or raw (untyped(): every field a variant), where wrong types are
issues too. Issues have level, id, field, message, in the order of records and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import MAX_AGE_DAYS, is_iso_date, is_stale
from millrace.functions.urls import is_http_url
from millrace.operators.tables import materialize
from millrace.schema import CATALOG, DATE_FIELDS, ENUMS, LIST_FIELDS, REQUIRED, URL_FIELDS

# What the issues say, here and in the rules below.
NO_ID = "(sin id)"
PAID = ("certificado pagado", "certificado pagado verificable")
#: When there is an issue, its level, its field, and what it says.
Rule = tuple[Column, str, str | None, Column]


def _issue(when: Column, level: str, field: str | None, *message: str | Column) -> Rule:
    return when, level, field, F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])


def _found(number: int, rule: Rule) -> Column:
    """The issue, or null."""
    when, level, field, message = rule
    said = {"rule": F.lit(number), "level": F.lit(level), "field": F.lit(field).cast("string"), "message": message}
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*[c.alias(n) for n, c in said.items()]))


class _Fields:
    """How rules look at a record's fields, typed or raw."""

    def __init__(self, columns: list[str], raw: bool):
        self.columns, self.raw = columns, raw

    def kind(self, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.col(name)), F.lit("VOID"))

    def missing(self, name: str) -> Column:
        if name not in self.columns:
            return F.lit(True)
        return self.kind(name) == "VOID" if self.raw else F.col(name).isNull()

    def text(self, name: str) -> Column:
        """The field if it is a text, else null."""
        if name not in self.columns:
            return F.lit(None).cast("string")
        if self.raw:
            return F.when(self.kind(name) == "STRING", F.try_variant_get(F.col(name), "$", "string"))
        return F.col(name).cast("string") if dict(self.kinds)[name] == "string" else F.lit(None).cast("string")

    kinds: list[tuple[str, str]] = [(f.name, f.dataType.simpleString()) for f in CATALOG]

    def shown(self, name: str) -> Column:
        return F.coalesce(F.try_variant_get(F.col(name), "$", "string"), F.lit("")) if self.raw else F.col(name).cast("string")

    def number(self, name: str) -> Column:
        if self.raw:
            return F.when(self.kind(name).rlike("BIGINT|DOUBLE|DECIMAL|FLOAT|INT"), F.try_variant_get(F.col(name), "$", "double"))
        return F.col(name).cast("double")

    def flag(self, name: str) -> Column:
        return F.when(self.kind(name) == "BOOLEAN", F.try_variant_get(F.col(name), "$", "boolean")) if self.raw else F.col(name)

    def is_list(self, name: str) -> Column:
        return F.startswith(self.kind(name), F.lit("ARRAY")) if self.raw else F.lit(True)

    def size(self, name: str) -> Column:
        return F.size(F.try_variant_get(F.col(name), "$", "array<variant>")) if self.raw else F.size(name)


def rules(f: _Fields, as_of: str, max_age: int = MAX_AGE_DAYS) -> list[Rule]:
    here = lambda names: [n for n in names if n in f.columns]
    out = [_issue(f.missing(n) | (f.text(n) == ""), "error", n, "Campo obligatorio ausente.") for n in REQUIRED]
    ident = f.text("id")
    out.append(_issue((ident != "") & ~ident.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "error", "id", "El id debe ser kebab-case sin acentos."))
    out += [_issue(F.trim(f.text(n)) == "", "error", n, "String vacío: usar null.") for n in f.columns if f.raw or dict(f.kinds).get(n) == "string"]
    for n in here(ENUMS):
        known = F.coalesce(f.text(n).isin(ENUMS[n]), F.lit(False))
        out.append(_issue(~f.missing(n) & ~known, "error", n, "Valor fuera de la lista permitida: ", f.shown(n)))
    for n in here(URL_FIELDS):
        out.append(_issue(~f.missing(n) & ~is_http_url(f.text(n)), "error", n, "URL inválida: ", f.shown(n)))
    for n in here(DATE_FIELDS):
        valid = F.coalesce(is_iso_date(f.text(n)), F.lit(False))
        out.append(_issue(~f.missing(n) & ~valid, "error", n, "Fecha inválida (se espera YYYY-MM-DD): ", f.shown(n)))
    n, relevance = "relevance_ppp_infra", f.number("relevance_ppp_infra")
    whole = F.coalesce((relevance == F.floor(relevance)) & relevance.between(0, 3), F.lit(False))
    out.append(_issue(~f.missing(n) & ~whole, "error", n, "Debe ser un entero entre 0 y 3."))
    no_notes = f.missing("notes") | (f.text("notes") == "")
    out.append(_issue(whole & (relevance > 0) & no_notes, "warn", "notes", "Relevancia mayor que 0 sin justificación en notes."))
    n, price = "credential_price_usd", f.number("credential_price_usd")
    valid = F.coalesce((price >= 0) & (price < float("inf")), F.lit(False))
    out.append(_issue(~f.missing(n) & ~valid, "error", n, "Precio inválido."))
    free = f.flag("credential_free")
    out.append(_issue(free & (price > 0), "error", n, "Incoherencia: credential_free es true pero el precio es mayor que cero."))
    undated = f.missing("last_verified") | (f.text("last_verified") == "")
    out.append(_issue((price > 0) & undated, "warn", n, "Precio sin fecha de verificación: los precios son volátiles."))
    kind = f.text("credential_type")
    out.append(_issue((kind == "certificado gratuito") & ~free, "error", "credential_free", "Incoherencia: el tipo es certificado gratuito pero credential_free es false."))
    out.append(_issue(kind.isin(*PAID) & free, "error", "credential_free", "Incoherencia: el tipo es certificado pagado pero credential_free es true."))
    out.append(_issue((f.text("cost_access") == "audit gratuito") & free, "warn", "cost_access", "Audit gratuito con credencial gratuita: confirmar contra fuente oficial."))
    verified = f.text("verification_status") == "VERIFICADO"
    out.append(_issue(verified & undated, "error", "last_verified", "VERIFICADO exige fecha de verificación."))
    out.append(
        _issue(verified & ~undated & is_stale(f.text("last_verified"), as_of, max_age), "warn", "last_verified", f"Verificación vencida (más de {max_age} días): corresponde REVERIFICAR.")
    )
    out.append(_issue(verified & (f.missing("source_of_truth") | (f.text("source_of_truth") == "")), "error", "source_of_truth", "VERIFICADO exige fuente de verdad."))
    for n in here(LIST_FIELDS):
        out.append(_issue(~f.missing(n) & ~f.is_list(n), "error", n, "Debe ser un arreglo o null."))
        out.append(_issue(~f.missing(n) & f.is_list(n) & (f.size(n) == 0), "error", n, "Arreglo vacío: usar null."))
    return out


def untyped(json_lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw records of JSON texts: pos, is_object, and each field as a variant; other columns must include pos."""
    record = F.try_parse_json(F.col(column))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(record), F.lit("OBJECT")), F.lit(False))
    fields = [F.try_variant_get(record, f"$.{n}", "variant").alias(n) for n in CATALOG.names]
    return json_lines.select("pos", is_object.alias("is_object"), *fields)


def record_issues(records: DataFrame, as_of: str, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    """pos, rule, level, id, field, message of the rules on single records (pos and fields, typed or raw)."""
    raw = "is_object" in records.columns
    f = _Fields([n for n in records.columns if n in CATALOG.names], raw)
    # what holds is kept before the issues are parted into rows
    found = F.array_compact(F.array(*[_found(i, rule) for i, rule in enumerate(rules(f, as_of, max_age))]))
    if raw:
        alone = _issue(F.lit(True), "error", None, "El registro no es un objeto.")
        found = F.when(F.col("is_object"), found).otherwise(F.array(_found(0, alone)))
    ident = F.when(F.coalesce(f.shown("id"), F.lit("")) == "", NO_ID).otherwise(f.shown("id")) if raw else F.coalesce("id", F.lit(NO_ID))
    return records.select("pos", ident.alias("id"), F.inline(found)).select("pos", "rule", "level", "id", "field", "message")


def duplicate_issues(records: DataFrame) -> DataFrame:
    """pos, rule, level, id, field, message of ids and addresses (compared as they are) used before. The first
    user of each is found by aggregation and joined back, so a hot value is no group of one task."""
    text = _Fields(records.columns, "is_object" in records.columns).text
    used = F.array(F.struct(F.lit("id").alias("field"), F.col("id").alias("value")), F.struct(F.lit("url_official").alias("field"), F.col("url").alias("value")))
    uses = materialize(records.select("pos", text("id").alias("id"), text("url_official").alias("url")).select("pos", "id", F.inline(used)).where("value != ''"))
    first = uses.groupBy("field", "value").agg(F.min(F.struct("pos", "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = uses.join(first, ["field", "value"]).where("pos > first.pos")
    by_id = F.col("field") == "id"
    owner = F.coalesce(F.nullif(F.col("first.id"), F.lit("")), F.lit(NO_ID))
    message = F.when(by_id, "ID duplicado en el catálogo.").otherwise(F.concat(F.lit("URL repetida: ya usada por "), owner, F.lit(". Revisar posible duplicado.")))
    return again.select(
        "pos", F.when(by_id, 1000).otherwise(1001).alias("rule"), F.when(by_id, "error").otherwise("warn").alias("level"), F.coalesce(F.col("id"), F.lit(NO_ID)).alias("id"), "field", message.alias("message")
    )


def validate(records: DataFrame, as_of: str, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    """All issues of records (pos, and fields), in order of pos and rule."""
    # a sort looks for its ranges first: what is written is not worked out twice
    return materialize(record_issues(records, as_of, max_age).unionByName(duplicate_issues(records))).orderBy("pos", "rule")


def summary(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count("*").alias("total"))


def grouped(issues: DataFrame) -> DataFrame:
    """id and its issues in order; ids in order of their first issue."""
    each = F.array_sort(F.collect_list(F.struct("pos", "rule", "level", "field", "message")))
    return issues.groupBy("id").agg(each.alias("issues")).orderBy(F.col("issues")[0].pos, F.col("issues")[0].rule)


