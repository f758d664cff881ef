"""Raw call records (JSON text with loose types) → the fixed, typed record.

The JSON is parsed once into a VARIANT; each of the 29 keys becomes one typed column. Everything is a
per-row expression, so the job needs no shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lists as L, refdata as R, variants as V

RAW = "r_"


def open_record(calls: DataFrame, payload: str = "payload") -> DataFrame:
    """One VARIANT column per record key; the record may be wrapped in a ``bando`` object or not."""
    parsed = calls.withColumn("_v", F.try_parse_json(payload))
    inner = V.part(F.col("_v"), "bando")
    wrapped = parsed.withColumn("wrapped", F.coalesce(V.is_object(inner), F.lit(False)))
    record = wrapped.withColumn("_b", F.when(F.col("wrapped"), inner).otherwise(F.col("_v")))
    # what parses and begins with a brace is an object
    is_record = F.col("_v").isNotNull() & F.col(payload).rlike(r"\A[ \t\r\n]*\{")
    return record.select(
        *calls.columns, "wrapped", F.coalesce(is_record, F.lit(False)).alias("payload_ok"), *[_field(key).alias(RAW + key) for key in R.RECORD_KEYS],
        V.part(F.col("_b"), R.KEY_ALIASES["dimensione_impresa"]).alias(RAW + "dimensione"),
    )


def _field(key: str) -> Column:
    """A record's field, or its older name where that says something. Sizes under the older name are read apart."""
    value = V.part(F.col("_b"), key)
    if key not in R.KEY_ALIASES or key == "dimensione_impresa":
        return value
    older = V.part(F.col("_b"), R.KEY_ALIASES[key])
    return F.when(V.truthy(older), older).otherwise(value)


def source(value: Column) -> Column:
    page = V.number(V.part(value, "pagina"))
    return F.struct(
        V.trimmed(V.part(value, "campo")).alias("campo"),
        F.when(page >= 1, page.try_cast("int")).alias("pagina"),
        V.trimmed(V.part(value, "testo")).alias("testo"),
        V.one_of(V.part(value, "certezza"), R.CERTAINTY).alias("certezza"),
    )


def sources(values: Column) -> Column:
    """Evidence entries with a text or a field name, each (field, page, text) once."""
    objects = F.filter(values, V.is_object)
    told = F.filter(F.transform(objects, source), lambda s: s["testo"].isNotNull() | s["campo"].isNotNull())
    return L.distinct_by(told, L.source_signature)


def instrument(value: Column) -> Column:
    fields = [V.one_of(V.part(value, "tipo"), R.AID_TYPES).alias("tipo")]
    for name in R.INSTRUMENT_NUMBERS:
        read = V.months if name in ("durata_mesi", "preammortamento_mesi") else V.number
        fields.append(read(V.part(value, name)).alias(name))
    evidence, single = V.part(value, "fonti"), V.part(value, "fonte")
    listed = F.when(V.is_list(evidence), V.items(evidence)).when(
        V.is_object(single), F.array(single)
    ).otherwise(V.no_items())
    return F.struct(
        *fields,
        V.percent_bands(V.part(value, "percentuali_per_dimensione")).alias("percentuali_per_dimensione"),
        V.nullable_boolean(V.part(value, "rimborso_richiesto")).alias("rimborso_richiesto"),
        V.trimmed(V.part(value, "tasso_descrizione")).alias("tasso_descrizione"),
        V.trimmed(V.part(value, "descrizione")).alias("descrizione"),
        V.all_texts(V.part(value, "condizioni")).alias("condizioni"),
        sources(listed).alias("fonti"),
    )


def instruments(value: Column) -> Column:
    known = F.filter(
        V.items(value), lambda v: V.is_object(v) & V.one_of(V.part(v, "tipo"), R.AID_TYPES).isNotNull()
    )
    return F.transform(known, instrument)


def entities(value: Column) -> Column:
    named = F.filter(
        V.items(value), lambda v: V.is_object(v) & V.trimmed(V.part(v, "nome")).isNotNull()
    )
    cleaned = F.transform(
        named,
        lambda v: F.struct(
            V.trimmed(V.part(v, "nome")).alias("nome"),
            V.one_of(V.part(v, "ruolo"), R.ENTITY_ROLES).alias("ruolo"),
            sources(V.items(V.part(v, "fonti"))).alias("fonti"),
        ),
    )
    return L.merge_entities(cleaned)


def phrases(value: Column) -> Column:
    texts = F.filter(F.transform(V.items(value), V.text), lambda t: F.regexp_replace(t, r"(?U)\s+", "") != "")
    return L.merge_phrases(texts)


def exclusions(value: Column) -> Column:
    """Structured exclusions; null when the value is no object."""
    entry = F.struct(
        V.trimmed(V.part(value, "lista_testuale")).alias("lista_testuale"),
        *[phrases(V.part(value, name)).alias(name) for name in R.NOTE_LISTS],
    )
    return F.when(V.is_object(value), entry)


_PYTHON_NAMES = ("number", "float", "boolean", "bool", "list", "list", "object", "dict")


def type_errors() -> Column:
    """Text fields that came as something else (opened record)."""
    names = F.create_map(*[F.lit(x) for x in _PYTHON_NAMES])

    def one(key: str) -> Column:
        value = F.col(RAW + key)
        found = F.when(F.schema_of_variant(value) == "BIGINT", F.lit("int")).otherwise(F.try_element_at(names, V.kind(value)))
        return F.when(V.kind(value) != "text", F.concat(F.lit(
            f"Tipo non valido per 'bando.{key}': atteso (<class 'str'>, <class 'NoneType'>), ricevuto "), found))

    return F.array_compact(F.array(*[one(k) for k in (
        "titolo", "ente", "data_pubblicazione", "data_scadenza", "link_fonte_ufficiale", "url_documento_origine")]))


@functools.cache
def typed_columns() -> dict[str, Column]:
    """The typed record's columns over an opened record. They are many, so they are built once."""
    raw = lambda key: F.col(RAW + key)
    size, age, coverage = raw("dimensione_impresa"), raw("anzianita_impresa"), raw("copertura_estrazione")
    columns: dict[str, Column] = {}
    for key in ("titolo", "ente", "data_pubblicazione", "data_scadenza", "link_fonte_ufficiale", "url_documento_origine"):
        columns[key] = V.text(raw(key))
    for key in ("codici_ateco_ammessi", "regioni_ammesse", "forme_giuridiche_ammesse"):
        columns[key] = V.texts(raw(key))
    for key in ("attivita_ammesse", "spese_ammissibili"):
        columns[key] = phrases(raw(key))
    for key in R.NUMERIC_FIELDS:
        columns[key] = V.number(raw(key))
    columns["ateco_aperto_a_tutti"] = V.boolean(raw("ateco_aperto_a_tutti"))
    # the older name holds an object, a list or a text with commas
    older = raw("dimensione")
    named = F.when(V.is_text(older), F.transform(F.split(V.raw_text(older), ","), lambda x: F.trim(x))).when(V.is_list(older), V.all_texts(older))
    columns["dimensione_impresa"] = F.struct(*[
        F.when(V.truthy(older), F.coalesce(F.array_contains(F.transform(named, lambda x: F.lower(x)), s), V.is_object(older) & V.truthy(V.part(older, s)), F.lit(False)))
        .otherwise(V.is_object(size) & V.truthy(V.part(size, s)))
        .alias(s)
        for s in R.SIZES
    ])
    columns["percentuale_fondo_perduto"] = V.percent_bands(raw("percentuale_fondo_perduto"))
    columns["modalita_presentazione"] = V.one_of(raw("modalita_presentazione"), R.SUBMISSION_MODES)
    columns["tipo_agevolazione"] = V.some_of(raw("tipo_agevolazione"), R.AID_TYPES)
    columns["cumulabilita"] = V.trimmed(raw("cumulabilita"))
    columns["note_text"] = V.trimmed(raw("note_esclusioni"))
    columns["note_esclusioni"] = exclusions(raw("note_esclusioni"))
    columns["anzianita_impresa"] = F.struct(*[
        F.when(V.is_object(age), V.whole(V.part(age, name))).alias(name)
        for name in ("mesi_minimi_dalla_costituzione", "mesi_massimi_dalla_costituzione")
    ])
    columns["agevolazioni"] = instruments(raw("agevolazioni"))
    columns["fonti"] = sources(V.items(raw("fonti")))
    columns["enti_coinvolti"] = entities(raw("enti_coinvolti"))
    columns["copertura_estrazione"] = F.struct(
        *[V.whole(V.part(coverage, n)).alias(n) for n in ("caratteri_totali", "caratteri_analizzati", "numero_blocchi")],
        V.nullable_boolean(V.part(coverage, "completa")).alias("completa"),
    )
    return columns


def typed(opened: DataFrame) -> DataFrame:
    """The typed record before its fields are reconciled with each other."""
    keep = [c for c in opened.columns if not c.startswith(RAW)]
    return opened.select(
        *keep,
        F.col(RAW + "fonti").isNotNull().alias("has_sources"),
        *[c.alias(name) for name, c in typed_columns().items()],
    )


def reconcile(record: DataFrame) -> DataFrame:
    """Excluded sectors close the call; structured instruments rule the older flat fields."""
    note = F.col("note_esclusioni")
    closed = F.coalesce((F.size(note["sezioni_ateco_escluse"]) > 0) | (F.size(note["attivita_vietate"]) > 0), F.lit(False))
    aid, bands = F.col("agevolazioni"), F.col("percentuale_fondo_perduto")
    has_aid = F.size(aid) > 0
    types = F.array_distinct(F.transform(aid, lambda a: a["tipo"]))
    grants = F.filter(aid, lambda a: a["tipo"].isin(*R.NON_REPAYABLE))
    loans_only = has_aid & (F.size(grants) == 0)
    amounts = F.filter(F.transform(grants, lambda a: a["importo_max"]), lambda x: x.isNotNull())
    single = F.get(grants, F.lit(0))
    empty = F.lit(True)
    single_has_bands = F.lit(False)
    for band in R.PERCENT_BANDS:
        empty = empty & bands[band].isNull()
        single_has_bands = single_has_bands | single["percentuali_per_dimensione"][band].isNotNull()
    fill = has_aid & ~loans_only & empty & (F.size(grants) == 1)
    none = F.struct(*[F.lit(None).cast("double").alias(b) for b in R.PERCENT_BANDS])
    only_default = F.struct(
        *[F.lit(None).cast("double").alias(b) for b in R.PERCENT_BANDS[:-1]], single["percentuale"].alias("default")
    )
    return record.withColumns(
        {
            "ateco_aperto_a_tutti": F.col("ateco_aperto_a_tutti") & ~closed,
            "tipo_agevolazione": F.when(has_aid, types).otherwise(F.col("tipo_agevolazione")),
            "contributo_max": F.when(loans_only, F.lit(None)).otherwise(
                F.coalesce("contributo_max", F.when(has_aid & (F.size(amounts) == 1), F.get(amounts, F.lit(0))))
            ),
            "percentuale_fondo_perduto": F.when(loans_only, none)
            .when(fill & single_has_bands, single["percentuali_per_dimensione"])
            .when(fill & single["percentuale"].isNotNull(), only_default)
            .otherwise(bands),
        }
    )


def raw_conflicts() -> Column:
    """Conflicts in the record as it came, which normalisation is about to settle (opened record)."""
    given = F.filter(
        F.transform(V.items(F.col("r_agevolazioni")), lambda v: V.text(V.part(v, "tipo"))), lambda t: t.isin(*R.AID_TYPES)
    )
    flat = F.array_distinct(F.transform(V.items(F.col("r_tipo_agevolazione")), lambda v: F.to_json(v)))
    structured = F.array_distinct(F.transform(given, lambda t: F.concat(F.lit('"'), t, F.lit('"'))))
    differ = (F.size(F.array_except(structured, flat)) > 0) | (F.size(F.array_except(flat, structured)) > 0)
    grants = F.exists(given, lambda t: t.isin(*R.NON_REPAYABLE))
    has_amount = F.coalesce(F.schema_of_variant(F.col("r_contributo_max")) != "VOID", F.lit(False))
    active = F.col("wrapped") & (F.size(structured) > 0)
    return F.array_compact(F.array(
        F.when(active & differ, F.lit("Coerenza agevolazioni: tipo_agevolazione è stato riallineato automaticamente ad agevolazioni[].tipo")),
        F.when(active & ~grants & has_amount, F.lit(
            "Coerenza agevolazioni: contributo_max conteneva il massimale del prestito ed è stato azzerato automaticamente")),
    ))


def normalise(calls: DataFrame, payload: str = "payload") -> DataFrame:
    opened = open_record(calls, payload)
    return reconcile(typed(opened.withColumns({"raw_warnings": raw_conflicts(), "type_errors": type_errors()})))


def to_calls(record: DataFrame) -> DataFrame:
    """Normalised records as the call table the matcher reads."""
    size = F.col("dimensione_impresa")
    admitted = F.array_compact(F.array(*[F.when(size[s], F.lit(s)) for s in R.SIZES]))
    none = F.array().cast("array<string>")
    return record.select(
        "call_id",
        F.col("titolo").alias("title"),
        F.col("ente").alias("issuer"),
        F.col("data_scadenza").alias("deadline"),
        F.col("ateco_aperto_a_tutti").alias("open_to_all"),
        F.col("codici_ateco_ammessi").alias("sector_codes"),
        F.col("attivita_ammesse").alias("activities"),
        F.col("regioni_ammesse").alias("regions"),
        admitted.alias("sizes"),
        F.col("fatturato_max").alias("revenue_max"),
        F.col("contributo_max").alias("contribution_max"),
        F.col("spesa_minima_ammissibile").alias("min_spend"),
        F.coalesce(F.col("note_esclusioni")["sezioni_ateco_escluse"], none).alias("excluded_sections"),
        F.col("forme_giuridiche_ammesse").alias("legal_forms"),
        F.col("anzianita_impresa")["mesi_minimi_dalla_costituzione"].alias("min_age_months"),
        F.col("anzianita_impresa")["mesi_massimi_dalla_costituzione"].alias("max_age_months"),
        F.col("numero_dipendenti_min").try_cast("int").alias("employees_min"),
        F.col("numero_dipendenti_max").try_cast("int").alias("employees_max"),
        *(["payload_ok"] if "payload_ok" in record.columns else []),
    )


def clean_reply(reply: Column) -> Column:
    """JSON object text out of a service reply: code fences and prose around it go; else null."""
    edges = r"(?s)^\s+|\s+$"

    def unfenced(body: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*\n?", ""), r"(?:^|\n)```[^\n]*$", "")
        return F.regexp_replace(F.when(body.startswith("```"), inner).otherwise(body), edges, "")

    def block(bare: Column) -> Column:
        cut = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
        return F.when(bare.startswith("{"), bare).otherwise(cut)

    # every step is evaluated once; what parses and begins with a brace is an object
    text = L.bind(L.bind(F.trim(F.regexp_replace(reply, edges, "")), unfenced), block)
    return L.bind(text, lambda t: F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t))
