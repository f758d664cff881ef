import datetime
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from fundlens.functions import refdata as R, text as X
from fundlens.operators import chunks, evidence, normalise, sheet, validate

DAY = datetime.date(2026, 6, 1)
LOAN = "finanziamento_agevolato"


def records(spark, *bodies, wrap=True):
    rows = [(i, json.dumps({"bando": b} if wrap else b)) for i, b in enumerate(bodies)]
    return normalise.normalise(stored(spark, spark.createDataFrame(rows, "call_id bigint, payload string")))


def stored(spark, df):
    """Rows read from files, as in production; literal rows would be folded by the optimizer one by one."""
    path = tempfile.mkdtemp(prefix="spark-rows-")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def one(spark, body, text):
    rows = spark.createDataFrame([(0, json.dumps({"bando": body}), text)], "call_id bigint, payload string, text string")
    return normalise.normalise(stored(spark, rows))


def test_wrapped_and_flat_records_are_the_same(spark):
    body = {"titolo": "Uno", "codici_ateco_ammessi": [" 62.01", "62.01", 5, ""], "percentuale_fondo_perduto": "60%", "dimensione_impresa": {"micro": 1}}
    for wrap in (True, False):
        r = records(spark, body, wrap=wrap).first()
        assert (r.titolo, r.codici_ateco_ammessi, r.percentuale_fondo_perduto.default, r.dimensione_impresa.micro, r.dimensione_impresa.grande) == ("Uno", ["62.01"], 60.0, True, False)


def test_older_names_constrain_like_newer_ones(spark):
    old = [{"regioni": ["Molise"], "codici_ateco": ["62.01"], "regioni_ammesse": ["Lazio"], "dimensione": d} for d in ("micro, Media", ["micro", "media"], {"micro": True, "media": 1})]
    for r in records(spark, *old).collect():
        sizes = r.dimensione_impresa
        assert (r.regioni_ammesse, r.codici_ateco_ammessi, sizes.micro, sizes.piccola, sizes.media, sizes.grande) == (["Molise"], ["62.01"], True, False, True, False)
    r = records(spark, {"regioni": [], "regioni_ammesse": ["Lazio"], "dimensione": "", "dimensione_impresa": {"grande": True}}).first()
    assert (r.regioni_ammesse, r.dimensione_impresa.grande) == (["Lazio"], True)


def test_loan_ceiling_is_no_contribution(spark):
    r = records(spark, {"contributo_max": 25000, "tipo_agevolazione": ["fondo_perduto"], "agevolazioni": [{"tipo": LOAN, "importo_max": "€ 25.000", "durata_mesi": "72"}]}).first()
    assert r.contributo_max is None and r.tipo_agevolazione == [LOAN]
    assert (r.agevolazioni[0].importo_max, r.agevolazioni[0].durata_mesi) == (25000.0, 72.0)


def test_single_grant_fills_the_flat_fields(spark):
    r = records(spark, {"agevolazioni": [{"tipo": "fondo_perduto", "importo_max": 10000, "percentuale": 50}]}).first()
    assert (r.contributo_max, r.percentuale_fondo_perduto.default) == (10000.0, 50.0)


def test_excluded_sectors_close_the_call(spark):
    r = records(spark, {"ateco_aperto_a_tutti": True, "note_esclusioni": {"attivita_vietate": ["tabacco"]}}).first()
    assert r.ateco_aperto_a_tutti is False


def test_malformed_payload_gives_an_empty_record(spark):
    r = normalise.normalise(spark.createDataFrame([(1, "{non json")], "call_id bigint, payload string")).first()
    assert r.titolo is None and r.agevolazioni == [] and r.ateco_aperto_a_tutti is False


def test_unreadable_records_admit_nobody(spark, sf):
    from fundlens.operators import eligibility, matching, profiles
    from fundlens.sources import tables

    rows = spark.createDataFrame([(1, "{non json"), (2, '{"bando": {"titolo": "t"}}'), (3, "[1]")], "call_id bigint, payload string")
    calls = profiles.prepare_calls(normalise.to_calls(normalise.normalise(rows)))
    firms = profiles.prepare_companies(tables.companies(spark, sf).limit(7), DAY)
    met = matching.candidates(calls, firms).select("call_id", eligibility.is_eligible().alias("e"), eligibility.status_label(eligibility.is_eligible(), F.lit("ok")).alias("label")).distinct().collect()
    assert {(r.call_id, r.e, r.label) for r in met} == {(1, None, "Verifica non riuscita"), (2, True, "Ammissibile sui dati disponibili"), (3, None, "Verifica non riuscita")}
    assert {r.call_id for r in eligibility.eligible_pairs(calls, firms).select("call_id").distinct().collect()} == {2}


def test_economic_details(spark):
    text = ("--- PAGINA 2 ---\nCondizioni del prestito. importo massimo: 48.000,00 euro, importo minimo: 8.000,00 euro. "
            "tasso di interesse: zero; preammortamento: 6 (facoltativo); periodo di rimborso del prestito: 60 mesi.")
    r = evidence.reconcile_economics(one(spark, {"tipo_agevolazione": [LOAN]}, text), "text").first()
    (loan,) = r.agevolazioni
    assert (loan.tipo, loan.importo_min, loan.importo_max, loan.durata_mesi, loan.preammortamento_mesi, loan.tasso_interesse_percentuale, loan.rimborso_richiesto) == (
        LOAN, 8000.0, 48000.0, 60.0, 6.0, 0.0, True)
    assert {s.pagina for s in loan.fonti} == {2}


def test_stated_durations_overrule_recorded_ones(spark):
    text = "--- PAGINA 9 ---\nPer il prestito vale una durata di ammortamento fino a 10 semestri, con pre-ammortamento pari a 1 semestre."
    r = evidence.reconcile_economics(one(spark, {"agevolazioni": [{"tipo": LOAN, "durata_mesi": 20, "preammortamento_mesi": 2}]}, text), "text").first()
    assert (r.agevolazioni[0].durata_mesi, r.agevolazioni[0].preammortamento_mesi) == (60.0, 6.0)


def test_instalment_date_is_no_grace_period(spark):
    r = evidence.reconcile_economics(one(spark, {"agevolazioni": [{"tipo": LOAN}]}, "Prima rata di preammortamento: scade il 15/03 dell'anno dopo."), "text").first()
    assert r.agevolazioni[0].preammortamento_mesi is None


def test_rebate_and_cumulation(spark):
    text = ("--- PAGINA 3 ---\nChi paga in orario ottiene un Abbuono delle ultime 8 rate mensili. --- PAGINA 11 ---\nNon aver beneficiato di altri sostegni pubblici per la stessa spesa, "
            "salvo che siano rispettati i limiti di cumulo applicabili.")
    done = evidence.reconcile_economics(one(spark, {"agevolazioni": [{"tipo": LOAN}]}, text), "text")
    r = done.withColumn("w", evidence.economic_warnings(F.col("text"))).first()
    assert r.agevolazioni[0].abbuono_rate == 8.0 and "limiti di cumulo" in r.cumulabilita and r.w == []
    bare = evidence.reconcile_economics(one(spark, {}, "In più c'è un Abbuono delle ultime 4 rate mensili."), "text")
    assert "abbuono" in bare.select(evidence.economic_warnings(F.col("text"))).first()[0][0]


def test_cumulation_clauses_are_those_of_the_plain_pattern(spark):
    """The pattern is tried only around its core: same clauses in long texts, beyond the reach, at both ends and in odd characters."""
    import random

    rng = random.Random(2)
    words = ["aiuti", "limiti di cumulo", "LIMITE  DI CUMULO", "non cumulabile", "non è compatibile", "cumulo", "compatibile", "non aver beneficiato di altri sostegni pubblici", ".", "è", "\U0001f600", "x" * 90]
    texts = [" ".join(rng.choices(words, [20, 1, 1, 1, 1, 3, 3, 1, 4, 3, 3, 3], k=rng.randrange(1, 120))) for _ in range(300)]
    texts += ["non cumulabile.", "a" * 219 + " non cumulabile.", "a" * 500 + " non cumulabile", None, "", "a" * 60_000 + " cumulo"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.squash(F.col("t")).alias("c"))
    got = rows.select(evidence.cumulation_clause(F.col("c")).alias("a"), X.capture(F.col("c"), R.CUMULATION_PATTERN, 0).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is not None for r in got) > 50


def test_strings_before_patterns_lose_no_match(spark):
    """Patterns take a dotless i, a Kelvin sign and a long s; the strings looked for first have none of these letters."""
    with pytest.raises(ValueError):
        X.mentions(F.col("t"), "importo")
    odd = "\u0130mporto MA\u017f\u017fIMO: 7.000 euro. Ta\u017fso d\u0131 intere\u017f\u017fe zero. PREST\u0131TO con DURATA di 5 anni. Preammortamento di 6 mesi. ABBUONO ultime 3 rate. \u017fez. K e\u017fcluse."
    r = evidence.reconcile_economics(one(spark, {"agevolazioni": [{"tipo": LOAN}]}, odd), "text").first()
    loan = r.agevolazioni[0]
    assert (loan.importo_max, loan.tasso_interesse_percentuale, loan.durata_mesi, loan.preammortamento_mesi, loan.abbuono_rate) == (7000.0, 0.0, 60.0, 6.0, 3.0)
    cited = spark.createDataFrame([(odd,)], "t string").select(evidence.cited_sections(F.col("t"), F.lower("t")).alias("a"), evidence.cited_sections(F.col("t")).alias("b")).first()
    assert cited.a == cited.b and len(cited.a) == 1


def sections(spark, text, listed):
    rows = spark.createDataFrame([(text, listed, [])], "text string, sections array<string>, fonti array<struct<campo:string,pagina:int,testo:string,certezza:string>>")
    return evidence.reconcile_sections(rows, "text", "sections", "fonti").first()


def test_sections_come_from_the_text_only(spark):
    r = sections(spark, "--- PAGINA 5 ---\nNon ammesse, perché escluse: costruzioni (Sez. F ATECO) e istruzione (Sezione P ATECO).", [])
    assert r.kept_sections == ["Sez. F", "Sez. P"] and r.added_sections == ["F", "P"] and {s.pagina for s in r.fonti} == {5}
    r = sections(spark, "--- PAGINA 7 ---\nResta escluso chi insegna.", ["Sez. F", "Sez. P"])
    assert r.kept_sections == [] and r.removed_sections == ["Sez. F", "Sez. P"]
    r = sections(spark, None, ["K"])
    assert r.kept_sections == ["K"]


def issuer(spark, quote, text):
    body = {"ente": "Regione Molise", "fonti": [{"campo": "ente", "pagina": 2, "testo": quote}]}
    return evidence.repair_issuer_source(one(spark, body, text), "text").withColumn("w", evidence.issuer_warning(F.col("ente"), F.col("fonti"))).first()


def test_issuer_sources(spark):
    assert issuer(spark, "Fondo per le imprese della Regione Molise", None).w is None
    assert "non supporta" in issuer(spark, "Le pratiche sono istruite da Credito Esempio S.p.A.", None).w
    fixed = issuer(spark, "Gestore: Credito Esempio S.p.A.", "--- PAGINA 1 ---\nBOLLETTINO UFFICIALE DELLA REGIONE MOLISE. AVVISO PUBBLICO PER LE IMPRESE.")
    assert fixed.w is None and "sostituita" in fixed.issuer_notice and [s.pagina for s in fixed.fonti] == [1]
    kept = issuer(spark, "Gestore: Credito Esempio S.p.A.", "--- PAGINA 2 ---\nPossono partecipare imprese con sede nella Regione Molise.")
    assert kept.issuer_notice is None and kept.w is not None


def test_validation_decides_on_review(spark):
    full = {"titolo": "t", "ente": "e", "data_pubblicazione": "2026-01-01", "data_scadenza": "31/12/2026", "codici_ateco_ammessi": ["62.01"], "contributo_max": 5, "regioni_ammesse": ["Lazio"],
            "dimensione_impresa": {"micro": True}, "fatturato_max": 1, "tipo_agevolazione": ["fondo_perduto"], "cumulabilita": "sì", "spese_ammissibili": ["x1"], "numero_dipendenti_min": 1}
    rows = records(spark, full, {**full, "titolo": " "}, {"titolo": "t"}).withColumn("text", F.lit(None).cast("string"))
    r = {x.call_id: x for x in validate.validate(rows, "text", DAY).collect()}
    assert (r[0].needs_review, r[0].gaps, r[0].errors, r[0].data_scadenza) == (False, [], [], "2026-12-31")
    assert r[1].gaps == ["titolo"] and r[1].needs_review
    assert r[2].null_percentage > 50 and any(w.startswith("RF-007") for w in r[2].warnings)


def test_rolling_window_needs_no_deadline(spark):
    rows = one(spark, {"titolo": "t", "contributo_max": 1, "codici_ateco_ammessi": ["62.01"]}, "Misura a sportello continuo")
    assert rows.select(validate.critical_gaps(F.col("text"))).first()[0] == []
    assert rows.select(validate.critical_gaps()).first()[0] == ["data_scadenza"]


def text_sheet(spark, body):
    return sheet.render(records(spark, body), DAY).first().sheet


def test_sheet(spark):
    s = text_sheet(spark, {
        "titolo": "Bando Test", "ente": "Ministero", "data_scadenza": "2026-06-11", "modalita_presentazione": "sportello", "regioni_ammesse": ["Lazio"], "attivita_ammesse": ["ricerca applicata"],
        "dimensione_impresa": {"micro": True, "media": True}, "spesa_minima_ammissibile": 10000, "forme_giuridiche_ammesse": ["srl"], "anzianita_impresa": {"mesi_minimi_dalla_costituzione": 12},
        "percentuale_fondo_perduto": {"micro": 60, "piccola": 50, "media": 2.75}, "contributo_max": 1234567, "cumulabilita": "regime de minimis",
        "note_esclusioni": {"lista_testuale": "Escluse le imprese agricole", "sezioni_ateco_escluse": ["A"], "attivita_vietate": ["Gioco d'azzardo"]},
        "enti_coinvolti": [{"nome": "BNL", "ruolo": "gestore"}, {"nome": "Portale", "ruolo": "piattaforma"}], "link_fonte_ufficiale": "https://example.org/home", "url_documento_origine": "https://example.org/b.pdf"})
    assert s.startswith("# Bando Test\n\n## Panoramica\n\n- **Ente promotore:** Ministero\n- **Scadenza:** 11 giugno 2026 — 10 giorni (urgenza alta)\n- **Presentazione:** Sportello (a esaurimento fondi)\n\n"
                        "## Soggetti coinvolti\n\n- **Gestore:** BNL\n\n## Beneficiari e interventi\n\n- **Territorio:** Lazio\n### Interventi ammessi\n\n- ricerca applicata\n- **Dimensioni impresa:** micro, media\n\n"
                        "## Requisiti principali\n\n- **Investimento minimo:** € 10.000\n- **Anzianità minima:** 12 mesi\n- **Forme giuridiche:** S.r.l.\n\n"
                        "## Contributi e agevolazioni\n\n**Contributo massimo:** € 1.234.567\n\n**Fondo perduto per fascia:** Micro 60%; Piccola 50%; Media 2.75%\n\n**Cumulabilità:** Soggetta alle regole de minimis\n\n"
                        "## Esclusioni\n\n### Sezioni ATECO\n\n- Sez. A – Agricoltura, silvicoltura e pesca\n\n### Attività vietate\n\n- Gioco d'azzardo\n\n"
                        "## Documento di origine\n\n[https://example.org/b.pdf](https://example.org/b.pdf)\n\n---\n\n*Dati estratti automaticamente tramite AI")
    assert "example.org/home" not in s and "Escluse le imprese agricole" not in s


def test_sheet_of_instruments_and_of_nothing(spark):
    s = text_sheet(spark, {"agevolazioni": [{"tipo": LOAN, "importo_max": 25000, "tasso_interesse_percentuale": 0, "durata_mesi": 72, "rimborso_richiesto": True, "condizioni": ["a", "b", "c"]}]})
    assert "**Finanziamento agevolato**\n- Importo massimo del finanziamento: € 25.000\n- Tasso: 0%\n- Durata: 72 mesi\n- Rimborso richiesto: sì\n- Condizione: a\n- Condizione: b\n\n---" in s
    assert text_sheet(spark, {}) == "*Scheda non disponibile — dati bando insufficienti.*"
    assert "SCADUTO" in text_sheet(spark, {"titolo": "t", "data_scadenza": "2026-05-31"})


def test_chunks_cover_the_text(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (0, 1, 99, 100, 101, 1000, 3777)] + ["x" * 950]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = chunks.split(docs, "doc_id", "text", 100, 20).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.chunk, r.start, r.stop, r.text) for r in rows if r.doc_id == i)
        assert mine[0][1] == 0 and mine[-1][2] == len(t)
        assert all(t[a:b] == body and b - a <= 100 for _, a, b, body in mine)
        assert all(nxt[1] <= prev[2] and nxt[1] > prev[1] for prev, nxt in zip(mine, mine[1:]))


def test_partial_records_merge_in_chunk_order(spark):
    parts = records(
        spark,
        {"titolo": "", "data_scadenza": "2026-01-01", "codici_ateco_ammessi": ["62.01"], "agevolazioni": [{"tipo": "voucher", "importo_max": 10}], "dimensione_impresa": {"micro": True}, "anzianita_impresa": {}},
        {"titolo": "Due", "data_scadenza": "2026-05-01", "codici_ateco_ammessi": ["63.11", "62.01"], "agevolazioni": [{"tipo": "voucher", "importo_max": 20, "percentuale": 5}, {"tipo": "garanzia"}],
         "dimensione_impresa": {"media": True}, "anzianita_impresa": {"mesi_minimi_dalla_costituzione": 3}, "percentuale_fondo_perduto": 40, "ateco_aperto_a_tutti": True},
    ).withColumns({"doc_id": F.lit(7).cast("bigint"), "chunk": F.col("call_id").cast("int")})
    r = chunks.merge_partials(parts, "doc_id").first()
    assert (r.titolo, r.data_scadenza, r.codici_ateco_ammessi) == ("Due", "2026-05-01", ["62.01", "63.11"])
    assert [(a.tipo, a.importo_max, a.percentuale) for a in r.agevolazioni] == [("voucher", 10.0, 5.0), ("garanzia", None, None)]
    assert (r.dimensione_impresa.micro, r.dimensione_impresa.media, r.percentuale_fondo_perduto.default) == (True, True, 40.0)
    # The first chunk's age and openness stand, even where they say nothing.
    assert r.anzianita_impresa.mesi_minimi_dalla_costituzione is None and r.ateco_aperto_a_tutti is False


def test_loose_values_read_their_input_a_few_times(spark):
    """Expressions repeat what they mention, so a number that mentions its variant often is parsed often."""
    from fundlens.functions import numbers, variants

    value = F.col("zz")
    assert [str(c).count("zz") <= n for c, n in ((numbers.parse_loose(value), 6), (variants.number(value), 9), (variants.percent_bands(value), 45))] == [True] * 3


def test_loose_numbers_of_odd_texts(spark):
    from fundlens.functions import numbers

    texts = ["€ 1.500.000", "2.500,50", "1.000", "1.2.3", "1.5", "60 %", "5\n", "5\r\n", "5 ", "1,2,3", ".5", "5.", ".", "", "NaN", "1d", "1e5", None]
    rows = stored(spark, spark.createDataFrame(list(enumerate(texts)), "i int, t string"))
    got = [r.n for r in rows.select("i", numbers.parse_loose(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [1500000.0, 2500.5, 1000.0, 123.0, 1.5, 60.0, 5.0, 5.0, None, None, 0.5, 5.0, None, None, None, None, 100000.0, None]


def test_replies_are_spread_and_cleaned(spark, sf):
    """A small file of replies runs on all cores; each step of the cleaning is evaluated once."""
    from fundlens.sources import tables

    assert tables.call_replies(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert str(normalise.clean_reply(F.col("zz"))).count("zz") == 1
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Ecco: {"a": 1} Fine.', "[1]", ' \n{"a": 1}\n', "{", "nessun dato", '"{}"', "", None]
    rows = stored(spark, spark.createDataFrame(list(enumerate(texts)), "i int, t string"))
    got = [r.j for r in rows.select("i", normalise.clean_reply(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == ['{"a": 1}'] * 3 + [None, '{"a": 1}', None, None, "{}", None, None]
