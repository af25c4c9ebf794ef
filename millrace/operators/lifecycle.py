"""Life of the catalog: normalising, extraction, verification, deprecation, incorporation, discovery, diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.classify import access, access_price
from millrace.functions.html import course_parts, course_record, page_text
from millrace.functions.text import clean, make_id
from millrace.functions.urls import canonical_or_raw, is_course_material, is_http_url, is_index_page
from millrace.operators.ranking import catalog_order
from millrace.schema import AI_PROVIDERS, CANONICAL_FIELDS, CATALOG, LIST_FIELDS, WATCHED

# States and the sentences of notes and reasons, here and in the functions below.
GONE, PENDING = "NO_DISPONIBLE", "PENDIENTE"
NOTE = "[DEPRECADO"
PAID_REASON = "Acceso de pago: fuera del alcance del catálogo"


def normalise(records: DataFrame) -> DataFrame:
    """Texts cleaned, addresses canonical, lists without blanks (null if none), ids filled in."""
    new: dict[str, Column] = {}
    for name, kind in records.dtypes:
        c = F.col(name)
        if kind == "string":
            c = clean(c)
            new[name] = canonical_or_raw(c) if name in CANONICAL_FIELDS else c
        elif kind == "array<string>" and name in LIST_FIELDS:
            items = F.filter(F.transform(c, clean), lambda x: x.isNotNull())
            new[name] = F.when(F.size(items) > 0, items)
    out = records.withColumns(new)
    parts = [F.col(n) if n in out.columns else F.lit(None).cast("string") for n in ("institution", "course_code", "title")]
    ident = F.coalesce(F.col("id"), make_id(*parts)) if "id" in out.columns else make_id(*parts)
    return out.withColumn("id", ident)


def extract(pages: DataFrame, as_of: str) -> DataFrame:
    """Candidates of fetched pages (url, ok, body, reason, and source_institution, source_id, adapter,
    discovered_at of the crawl), with outcome: extracted, failed or paid."""
    kept = ["url", "ok", "reason", "source_institution", "source_id", "adapter", "discovered_at"]
    parts = pages.select(*kept, "body", *course_parts(F.col("body")))
    record = course_record(*[F.col(c) for c in ("body", "url", "blocks", "entity", "text")])
    said = parts.select(*kept, *record, access(F.col("text")).alias("cost_access"))
    outcome = F.when(~F.coalesce("ok", F.lit(False)), "failed").when(F.col("cost_access") == "pagado", "paid").otherwise("extracted")
    named = said.withColumns(
        {
            "institution": F.coalesce("source_institution", "institution"),
            "outcome": outcome,
            "reason": F.when(outcome == "paid", PAID_REASON).otherwise(F.col("reason")),
            "discovered_at": F.coalesce("discovered_at", F.lit(as_of)),
            "extracted_at": F.lit(as_of),
        }
    )
    return normalise(named)


def verification_bucket(match: Column) -> Column:
    """Where a candidate goes: match is exact, ambiguous or none."""
    incomplete = F.coalesce(F.col("title"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("institution"), F.lit("")).eqNullSafe("") | ~is_http_url(F.col("url_official"))
    ident = F.coalesce("id", make_id(F.col("institution"), F.col("course_code"), F.col("title")))
    return (
        F.when(match == "exact", "duplicates")
        .when(match == "ambiguous", "ambiguous")
        .when(incomplete, "incomplete")
        .when(is_index_page(F.col("url_official"), F.col("title")) | is_course_material(F.col("title")), "index_pages")
        .when(ident.isNull(), "incomplete")
        .otherwise("accepted")
    )


def pending_record(candidates: DataFrame, as_of: str) -> DataFrame:
    """Accepted candidates as catalog records that wait for a person."""
    said = lambda name: F.coalesce(F.col("evidence")[name], F.lit(False))
    notes = F.concat(
        F.lit(
            "Candidato descubierto automaticamente. Requiere verificacion humana contra fuente oficial de titulo, "
            "institucion, modalidad de acceso y credencial antes de pasar a VERIFICADO. Indicios detectados en la pagina: gratuidad "
        ),
        F.when(said("mentions_free"), "mencionada").otherwise("no mencionada"),
        F.lit(", certificado "),
        F.when(said("mentions_certificate"), "mencionado").otherwise("no mencionado"),
        F.lit(". Los indicios NO son evidencia suficiente por si solos."),
    )
    given = {
        "id": F.coalesce("id", make_id(F.col("institution"), F.col("course_code"), F.col("title"))),
        "provider_type": F.when(F.col("institution").isin(AI_PROVIDERS), "proveedor-ia").otherwise("institucion"),
        "verification_status": F.lit(PENDING),
        "source_of_truth": F.col("url_official"),
        "notes": notes,
        "status": F.lit("desconocido"),
        "discovered_at": F.coalesce("discovered_at", F.lit(as_of)),
        "updated_at": F.lit(as_of),
    }
    kept = "title institution course_code level language cost_access url_official".split()
    return candidates.select(
        *[given.get(f.name, F.col(f.name) if f.name in kept else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOG]
    )


def is_gone(status: Column) -> Column:
    return F.coalesce(status == GONE, F.lit(False))


def gone_note(as_of: str, reason: Column, misses: Column, notes: Column) -> Column:
    parts = [
        F.lit(f"{NOTE} {as_of}]"),
        F.when(reason.isNotNull() & (reason != ""), F.concat(F.lit("Motivo: "), reason, F.lit("."))).otherwise("Motivo no especificado."),
        F.when(misses > 0, F.concat(F.lit("Confirmado tras "), misses.cast("string"), F.lit(" verificaciones fallidas consecutivas."))),
        F.lit("Los datos se conservan tal como fueron verificados por ultima vez."),
        F.nullif(notes, F.lit("")),
    ]
    return F.concat_ws(" ", *parts)


def restored_note(as_of: str, notes: Column) -> Column:
    """Without the first note of being gone: its mark and the next three sentences."""
    mark = r"\[DEPRECADO[^\]]*\][^.]*\.[^.]*\.[^.]*\.\s*"
    whole = F.coalesce(notes, F.lit(""))
    found = F.regexp_extract(whole, mark, 0)
    at = F.instr(whole, found)
    rest = F.when(found == "", whole).otherwise(F.concat(F.left(whole, at - 1), F.substring(whole, at + F.length(found), F.length(whole))))
    rest = F.trim(rest)
    head = f"[RESTAURADO {as_of}] El curso volvio a responder"
    return F.when(rest != "", F.concat(F.lit(head + ". "), rest)).otherwise(head + " tras haber sido marcado como no disponible.")


def apply_retired(catalog: DataFrame, retired: DataFrame, as_of: str) -> DataFrame:
    """catalog with a column action (gone, restored or null). retired: url, missing_count, reason, pos; of
    equal addresses the last counts. Records are never dropped."""
    one = retired.groupBy(canonical_or_raw(F.col("url")).alias("__key")).agg(F.max_by(F.struct("reason", "missing_count"), "pos").alias("__r"))
    joined = catalog.join(one, canonical_or_raw(F.col("url_official")) == F.col("__key"), "left")
    hit, was = F.col("__r").isNotNull(), is_gone(F.col("verification_status"))
    gone, back = hit & ~was, ~hit & was
    reason = F.coalesce(F.col("__r.reason"), F.lit("La URL dejo de responder"))
    new = {
        "action": F.when(gone, "gone").when(back, "restored"),
        "notes": F.when(gone, gone_note(as_of, reason, F.col("__r.missing_count"), F.col("notes"))).when(back, restored_note(as_of, F.col("notes"))).otherwise(F.col("notes")),
        "verification_status": F.when(gone, GONE).when(back, "REVERIFICAR").otherwise(F.col("verification_status")),
        "status": F.when(gone, "no disponible").when(back, "desconocido").otherwise(F.col("status")),
        "enrollment_open": F.when(gone, F.lit(False)).when(~back, F.col("enrollment_open")),
        "updated_at": F.when(gone | back, F.lit(as_of)).otherwise(F.col("updated_at")),
    }
    kept = [c for c in catalog.columns if c not in new]
    return joined.select(*[F.col(c) for c in kept], *[c.alias(n) for n, c in new.items()])


def incorporate(catalog: DataFrame, accepted: DataFrame) -> DataFrame:
    """catalog and the accepted records whose ids it lacks, these pending, in catalog order."""
    fresh = accepted.join(catalog.select("id"), "id", "left_anti").withColumn("verification_status", F.lit(PENDING))
    return catalog.unionByName(fresh.select(*catalog.columns)).orderBy(*catalog_order())


def discover(now: DataFrame, before: DataFrame, key: str = "url") -> DataFrame:
    """key and change: new or gone."""
    new = now.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(before.select(key).distinct().join(now.select(key), key, "left_anti").withColumn("change", F.lit("gone")))


def fingerprints(candidates: DataFrame, as_of: str) -> DataFrame:
    return candidates.select("url", "source", F.left(F.sha2("url", 256), F.lit(16)).alias("hash"), F.lit(as_of).alias("seen_at"))


def last_of(df: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """One row a key, the last."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def diff(before: DataFrame, after: DataFrame, watched: list[str] = WATCHED, key: str = "id") -> DataFrame:
    """key, change (added, removed, changed), field, old, new of two snapshots with one row a key."""
    a = before.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in watched]).alias("a"))
    b = after.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in watched]).alias("b"))
    both = a.join(b, key, "full_outer")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col("a")[c].alias("old"), F.col("b")[c].alias("new")) for c in watched])
    changed = F.filter(fields, lambda x: ~x.old.eqNullSafe(x.new))
    whole = lambda name: F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    rows = F.when(F.col("a").isNull() | F.col("b").isNull(), whole("")).otherwise(changed)
    return both.select(key, change.alias("change"), F.inline(rows))


def audit(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """id, title, url, bucket (free, paid, undetermined), price, reason of the records without known access.
    pages: url, ok, body, reason."""
    todo = catalog.where("cost_access is null").select("id", "title", F.col("url_official").alias("url"))
    joined = todo.join(pages, "url", "left")
    text = page_text(F.col("body"))
    found = F.when(F.col("ok"), access(text))
    bucket = F.when(found == "pagado", "paid").when(found == "gratis", "free").otherwise("undetermined")
    reason = F.when(~F.coalesce("ok", F.lit(False)), F.col("reason")).when(bucket == "undetermined", "evidencia insuficiente o contradictoria")
    return joined.select("id", "title", "url", bucket.alias("bucket"), F.when(F.col("ok"), access_price(text)).alias("price"), reason.alias("reason"))


def unavailable(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """institution and reason of the disabled sources that have no record."""
    off = sources.where("enabled = false and institution != ''")
    return off.join(catalog.select("institution").distinct(), "institution", "left_anti").select("institution", F.col("notes").alias("reason"))
