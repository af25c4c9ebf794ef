"""Exports: CSV, Markdown and JSON of records; Markdown reports. Lines are columns, so any number of rows can
be written; a single document is put together only on request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lifecycle import discover
from millrace.operators.links import summary as link_summary

# The columns of the exports and their headings; also what the reports below say.
CSV_COLUMNS = {
    "id": "ID",
    "title": "Título",
    "institution": "Institución",
    "institution_country": "País",
    "platform": "Plataforma",
    "course_code": "Código",
    "domain": "Dominio",
    "level": "Nivel",
    "duration_weeks": "Semanas",
    "hours_per_week": "Horas/semana",
    "pace": "Modalidad",
    "cost_access": "Acceso",
    "credential_type": "Credencial",
    "credential_free": "Credencial gratuita",
    "credential_price_usd": "Precio USD",
    "credential_verifiable": "Verificable",
    "relevance_ppp_infra": "Relevancia",
    "verification_status": "Verificación",
    "last_verified": "Última verificación",
    "url_official": "URL curso",
    "source_of_truth": "Fuente de verdad",
}
MD_HEADINGS = ["ID", "Título", "Institución", "Credencial", "Precio USD", "Verificación", "URL"]
BOM = "﻿"


def number_text(c: Column) -> Column:
    """A number as short as it can be: 12, not 12.0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def cell(c: Column, kind: str) -> Column:
    if kind == "boolean":
        c = F.when(c, "sí").when(~c, "no")
    elif kind.startswith("array"):
        c = F.array_join(c, ", ", "")
    elif kind in ("double", "float"):
        c = number_text(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_cell(text: Column) -> Column:
    """Quoted; what a spreadsheet would take for a formula gets an apostrophe."""
    safe = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    kinds = dict(df.dtypes)
    names = columns or list(CSV_COLUMNS)
    return F.concat_ws(";", *[csv_cell(cell(F.col(n), kinds[n])) for n in names])


def csv_header() -> str:
    return ";".join(f'"{x}"' for x in CSV_COLUMNS.values())


def md_cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def md_line() -> Column:
    url = F.when(F.coalesce("url_official", F.lit("")) != "", F.concat(F.lit("[abrir]("), F.col("url_official"), F.lit(")"))).otherwise("")
    cells = [
        md_cell(F.col("id")),
        md_cell(F.col("title")),
        md_cell(F.col("institution")),
        md_cell(F.coalesce("credential_type", F.lit("sin credencial"))),
        F.coalesce(number_text(F.col("credential_price_usd")), F.lit("")),
        md_cell(F.col("verification_status")),
        url,
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def write_csv(df: DataFrame, path: str) -> None:
    """Files of lines that end in carriage return and line feed, each with byte order mark and header."""
    kinds = dict(df.dtypes)
    names = {n: h for n, h in CSV_COLUMNS.items() if n in kinds}
    cells = [cell(F.col(n), kinds[n]) for n in names]
    safe = [F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c).alias(h) for c, h in zip(cells, names.values())]
    safe[0] = safe[0].alias(BOM + next(iter(names.values())))
    df.select(*safe).write.options(sep=";", quoteAll=True, header=True, escape='"', lineSep="\r\n", emptyValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Files of a record a line, nulls too; sources/catalog reads them back under a name that ends in .jsonl."""
    df.write.option("ignoreNullFields", False).json(path)


#: Rows of a single document; more go through write_csv, write_json or a written md_line().
DOCUMENT_ROWS = 50_000


def document(df: DataFrame, kind: str) -> str:
    """One csv, md or json document of the rows in their order; for results of a search, which are bounded: more
    than DOCUMENT_ROWS are an error, and no more than that come to the driver."""

    def rows(c: Column) -> list[str]:
        found = [r[0] for r in df.select(c).limit(DOCUMENT_ROWS + 1).collect()]
        if len(found) > DOCUMENT_ROWS:
            raise ValueError(f"more than {DOCUMENT_ROWS} rows are no single document: use write_csv or write_json")
        return found

    if kind == "csv":
        return BOM + "".join(f"{x}\r\n" for x in [csv_header(), *rows(csv_line(df))])
    if kind == "md":
        head = [f"| {' | '.join(MD_HEADINGS)} |", "|" + "|".join("---" for _ in MD_HEADINGS) + "|"]
        return "".join(f"{x}\n" for x in [*head, *rows(md_line())])
    if kind == "json":
        import json

        found = rows(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        return json.dumps([json.loads(x) for x in found], ensure_ascii=False, indent=2) + "\n"
    raise ValueError(kind)


def _report(spark: SparkSession, heads: list[str], sections: list[tuple[list[str], DataFrame]], nothing: str) -> DataFrame:
    """seq, line: the heads, then each section's heads and rows (place, line) if it has rows, or what is said if none has."""
    parts, rows = [], [("0", f"{i:06d}", x) for i, x in enumerate(heads)]
    for k, (titles, lines) in enumerate(sections, 1):
        if not lines.isEmpty():
            rows += [(f"{k}", f" {i}", x) for i, x in enumerate(titles)] + [(f"{k}~", "", "")]
            parts.append(lines.select(F.lit(f"{k}").alias("section"), F.concat(F.lit("!"), "place").alias("place"), "line"))
    if not parts:
        rows.append(("9", "", nothing))
    every = spark.createDataFrame(rows, "section string, place string, line string")
    return reduce(DataFrame.unionByName, parts, every).orderBy("section", "place").select(F.concat_ws(" ", "section", "place").alias("seq"), "line")


def _row(*cells: str | Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cells]), F.lit(" |"))


def diff_report(changes: DataFrame, day: str, total: int, compared: str) -> DataFrame:
    """seq, line of the Markdown report of lifecycle.diff() rows."""
    n = {r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    heads = [
        "# Reporte de cambios del catálogo", "", f"Fecha: {day}", f"Instantánea comparada: {compared}", "",
        f"- Cursos actuales: {total}", f"- Altas: {n.get('added', 0)}", f"- Bajas: {n.get('removed', 0)}", f"- Campos modificados: {n.get('changed', 0)}", "",
    ]
    said = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    ids = lambda change: changes.where(F.col("change") == change).select(F.col("id").alias("place"), _row("id").alias("line"))
    fields = changes.where("change = 'changed'").select(F.concat_ws(" ", "id", "field").alias("place"), _row("id", "field", said("old"), said("new")).alias("line"))
    sections = [
        (["## Cursos nuevos", "", "| ID |", "|---|"], ids("added")),
        (["## Cursos eliminados", "", "| ID |", "|---|"], ids("removed")),
        (["## Cambios en campos sensibles", "", "| ID | Campo | Antes | Ahora |", "|---|---|---|---|"], fields),
    ]
    return _report(changes.sparkSession, heads, sections, "Sin cambios respecto de la instantánea anterior.")


def link_report(results: DataFrame, day: str) -> DataFrame:
    """seq, line of the Markdown report of links.outcome() rows: totals, then the broken, then those that lead elsewhere."""
    n = link_summary(results).first()
    heads = ["# Reporte de enlaces", "", f"Fecha: {day}", "", f"- Enlaces verificados: {n.checked}", f"- Con problemas: {n.broken}", f"- Con redirección: {n.redirected}", ""]
    place = F.concat_ws(" ", "id", "field").alias("place")
    status = F.coalesce(F.col("status").cast("string"), F.col("error"))
    broken = results.where("not ok").select(place, _row("id", "id", "field", status, "url").alias("line"))
    moved = results.where("ok and redirect is not null").select(place, _row("id", "field", "url", "redirect").alias("line"))
    sections = [
        (["## Enlaces con problemas", "", "| ID | Curso | Campo | Estado | URL |", "|---|---|---|---|---|"], broken),
        (["## Redirecciones detectadas", "", "| ID | Campo | URL original | Destino |", "|---|---|---|---|"], moved),
    ]
    return _report(results.sparkSession, heads, sections, "Todos los enlaces respondieron correctamente y sin redirecciones.")


def discovery_report(now: DataFrame, before: DataFrame, day: str) -> DataFrame:
    """generated_at, total_now, total_before, new and gone: one row of counts; the addresses are lifecycle.discover()'s."""
    counts = discover(now, before).agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "gone").alias("gone"))
    total = lambda df: df.agg(F.count_distinct("url")).scalar()
    return counts.select(F.lit(day).alias("generated_at"), total(now).alias("total_now"), total(before).alias("total_before"), "new", "gone")


def bucket_counts(rows: DataFrame, column: str = "bucket") -> DataFrame:
    """bucket and n, the larger first: of verified candidates, audited records, or derived states."""
    return rows.groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket")


def issue_report(issues: DataFrame, total: int) -> DataFrame:
    """seq, line of the issues of validation.validate(), by record in order of its first issue, then their number."""
    first = issues.groupBy("id").agg(F.min(F.struct("pos", "rule")).alias("at"), F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    mark = F.when(F.col("level") == "error", "ERROR").otherwise("aviso")
    field = F.coalesce(F.concat(F.lit(" ["), "field", F.lit("]")), F.lit(""))
    heads = first.select("at", F.lit(0).alias("k"), F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(-1).alias("rule")).alias("sub"), F.col("id").alias("line"))
    lines = issues.join(first.select("id", "at"), "id").select(
        "at", F.lit(1).alias("k"), F.struct(F.col("pos").cast("long").alias("pos"), "rule").alias("sub"), F.concat(F.lit("  "), mark, field, F.lit(": "), "message").alias("line")
    )
    n = first.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("e"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("w"))
    last = n.select(F.lit(None).cast(heads.schema["at"].dataType).alias("at"), F.lit(2).alias("k"), F.lit(None).cast(heads.schema["sub"].dataType).alias("sub"), F.format_string(f"Validación: {total} cursos · %d errores · %d avisos", "e", "w").alias("line"))
    every = heads.unionByName(lines).unionByName(last)
    return every.orderBy(F.col("at").asc_nulls_last(), "k", "sub").select("line")
