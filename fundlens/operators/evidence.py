"""Facts recovered from and checked against the raw text of a call.

All operators are per-row expressions over the whole text: match positions come from one split and one
extract per pattern, so nothing is shuffled and no document leaves the JVM.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, lists as L, numbers as N, refdata as R, text as X

SOURCE_TYPE = "struct<campo:string,pagina:int,testo:string,certezza:string>"


def rolling_window(text: Column, lowered: Column | None = None) -> Column:
    """Does the text describe a call without a fixed deadline? lowered: the text in lower case, if it is at hand."""
    named = F.lit(True) if lowered is None else X.mentions(lowered, "portello", "aur", "permanente")
    return F.coalesce(named & X.matches(text, "(?:" + R.ROLLING_WINDOW_PATTERN + ")"), F.lit(False))


def relevance(title: Column, text: Column, header_chars: int | None = None) -> Column:
    """Reason why a document is a staff selection and no call; null when it may be a call.

    The whole text is read; ``header_chars`` limits the check to that many characters at its start
    (``refdata.RELEVANCE_HEADER_CHARS`` is the customary limit).
    """
    head = lambda t: F.lower(X.squash(X.folded(F.coalesce(t, F.lit("")))))
    heads = F.struct(head(title).alias("t"), head(text if header_chars is None else F.substring(text, 1, header_chars)).alias("h"))
    return L.bind(heads, lambda s: _staff_reason(s["t"], s["h"]))


def _staff_reason(t: Column, h: Column) -> Column:
    has = lambda where, pattern: where.rlike("(?U)" + pattern)
    selection = (has(t, R.SELECTION_PATTERN) & has(t, R.PERSONNEL_PATTERN)) | (
        has(t, r"\bgraduatoria\b") & has(t, R.RANKING_PATTERN)
    )
    header = (
        (has(h, r"\bconcorso pubblico\b") & has(h, R.PERSONNEL_PATTERN))
        | (has(h, R.SELECTION_PATTERN) & has(h, R.RECRUITMENT_PATTERN))
        | (has(h, r"\bgraduatoria\b") & has(h, R.RANKING_PATTERN))
    )
    return (
        F.when(has(t, R.TITLE_COMPETITION_PATTERN), "Il documento è un concorso pubblico per il reclutamento di personale.")
        .when(selection, "Il documento riguarda una selezione o graduatoria per personale.")
        .when(header, "Il documento riguarda un concorso o una selezione di personale.")
    )


# --- pages ---

def page_marks(text: Column) -> Column:
    """Page markers as array<struct<start,stop,page>>."""
    return F.transform(
        X.spans(text, R.PAGE_MARKER_PATTERN),
        lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"),
            F.regexp_extract(s["hit"], r"(\d+)", 1).try_cast("int").alias("page"),
        ),
    )


def page_at(marks: Column, position: Column) -> Column:
    """Page of a position: the last marker that has fully appeared by then."""
    before = F.filter(marks, lambda m: m["stop"] <= position + 1)
    return F.try_element_at(F.transform(before, lambda m: m["page"]), F.lit(-1))


def page_segments(text: Column) -> Column:
    """array<struct<page,text>>; a text without markers is one segment without a page."""
    marks = page_marks(text)

    def cut(all_: Column) -> Column:
        ends = F.concat(F.transform(F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0))), lambda m: m["start"]), F.array(F.length(text)))
        return F.transform(
            all_, lambda m, i: F.struct(m["page"].alias("page"), X.piece(text, m["stop"], F.get(ends, i)).alias("text"))
        )

    whole = F.array(F.struct(F.lit(None).cast("int").alias("page"), text.alias("text")))
    return F.when(X.matches(text, R.PAGE_MARKER_PATTERN), L.bind(marks, cut)).otherwise(whole)


def snippet(text: Column, start: Column, stop: Column, radius: int) -> Column:
    return X.squash(X.piece(text, start - radius, stop + radius))


def _source(field: str, page: Column, quote: Column, certainty: str = "alta") -> Column:
    return F.struct(F.lit(field).alias("campo"), page.alias("pagina"), quote.alias("testo"), F.lit(certainty).alias("certezza"))


# --- deadline ---

def _dates_in(text: Column) -> Column:
    """All dates with their positions, pattern by pattern."""
    numeric, dotted, iso, spelled = R.DATE_PATTERNS
    months = F.create_map(*[F.lit(x) for i, m in enumerate(R.MONTHS, 1) for x in (m, i)])

    def read(pattern: str, order: tuple[int, int, int]) -> Column:
        def one(span: Column) -> Column:
            parts = [F.regexp_extract(span["hit"], "(?iU)" + pattern, g) for g in order]
            month = F.try_element_at(months, F.lower(parts[1])) if pattern == spelled else parts[1].cast("int")
            day = F.try_to_date(F.concat_ws("-", parts[0], month.cast("string"), parts[2].cast("int").cast("string")), "yyyy-M-d")
            return F.struct(span["start"].alias("at"), day.alias("day"))

        return F.transform(X.spans(text, pattern), one)

    found = F.concat(
        read(numeric, (3, 2, 1)), read(dotted, (3, 2, 1)), read(iso, (1, 2, 3)), read(spelled, (3, 2, 1))
    )
    return F.filter(found, lambda d: d["day"].isNotNull())


def _keywords_in(text: Column) -> Column:
    lowered = F.lower(text)

    def places(word: str, weight: int) -> Column:
        return F.transform(
            X.spans(lowered, r"\Q" + word + r"\E"), lambda s: F.struct(s["start"].alias("at"), F.lit(weight).alias("weight"))
        )

    return F.concat(*[places(word, weight) for word, weight in R.DEADLINE_KEYWORDS])


def infer_deadline(text: Column, as_of: datetime.date, lowered: Column | None = None) -> Column:
    """The date nearest to the weightiest deadline keyword, as ISO text; none for rolling windows, for
    texts without a keyword near a date, and for dates long gone."""

    def best(words: Column, found: Column) -> Column:
        def near(word: Column, i: Column) -> Column:
            close = F.filter(found, lambda d: F.abs(d["at"] - word["at"]) <= R.DEADLINE_RADIUS)
            return F.array_max(F.transform(close, lambda d, j: F.struct(
                (word["weight"] * 1000 - F.abs(d["at"] - word["at"])).alias("score"), (-i).alias("i"), (-j).alias("j"), d["day"].alias("day"))))

        return F.array_max(F.transform(words, near))["day"]

    day = L.bind(F.struct(_keywords_in(text).alias("w"), _dates_in(text).alias("d")), lambda s: best(s["w"], s["d"]))
    has_date = text.rlike(r"\d{4}")
    kept = F.when(has_date & ~rolling_window(text, lowered), day)
    fresh = F.datediff(dates.day(as_of), kept) <= R.DEADLINE_MAX_AGE_DAYS
    return F.when(fresh, F.date_format(kept, "yyyy-MM-dd"))


# --- excluded sections ---

def cited_sections(text: Column, lowered: Column | None = None) -> Column:
    """Sections cited in the text: array<struct<letter,start,stop,excluded>>. lowered: the text in lower case, if it is at hand."""

    def one(s: Column) -> Column:
        letter = F.upper(F.regexp_extract(s["hit"], "(?iU)" + R.SECTION_CITATION_PATTERN, 1))
        around = X.piece(text, s["start"] - R.EXCLUSION_RADIUS, s["stop"] + R.EXCLUSION_RADIUS)
        return F.struct(letter.alias("letter"), s["start"].alias("start"), s["stop"].alias("stop"),
                        X.matches(around, "(?:" + R.EXCLUSION_PATTERN + ")").alias("excluded"))

    spans = X.spans(text, R.SECTION_CITATION_PATTERN)
    if lowered is not None:
        spans = F.when(X.mentions(lowered, "ez"), spans).otherwise(F.array().cast("array<struct<start:int,stop:int,hit:string>>"))
    return F.transform(spans, one)


def section_of_text(value: Column) -> Column:
    letter = F.regexp_extract(F.upper(value), "(?U)" + R.SECTION_LETTER_PATTERN, 1)
    return F.when(letter != "", letter)


def reconcile_sections(rows: DataFrame, text: str, sections: str, sources: str | None = None, lowered: Column | None = None) -> DataFrame:
    """Keeps only sections the text cites, adds those it excludes; warns about both.

    Adds ``kept_sections``, ``removed_sections``, ``added_sections`` and, with ``sources``, the new evidence.
    """
    t = F.col(text)
    cited = rows.withColumn("_cited", F.when(t != "", cited_sections(t, lowered)))
    anywhere = F.transform("_cited", lambda c: c["letter"])
    excluded = L.distinct_by(F.filter("_cited", lambda c: c["excluded"]), lambda c: c["letter"])
    cited = cited.withColumns({"_any": anywhere, "_out": excluded})
    listed = F.coalesce(F.col(sections), F.array().cast("array<string>"))
    lettered = F.filter(
        F.transform(listed, lambda v: F.struct(v.alias("v"), section_of_text(v).alias("l"))), lambda e: e["l"].isNotNull()
    )
    kept = F.array_distinct(F.transform(F.filter(lettered, lambda e: F.array_contains(F.col("_any"), e["l"])), lambda e: e["l"]))
    removed = F.transform(F.filter(lettered, lambda e: ~F.array_contains(F.col("_any"), e["l"])), lambda e: e["v"])
    added = F.array_except(F.transform("_out", lambda c: c["letter"]), kept)
    has_text = F.coalesce(t != "", F.lit(False))
    none = F.array().cast("array<string>")
    named = lambda letters: F.transform(letters, lambda x: F.concat(F.lit("Sez. "), x))
    out = cited.withColumns(
        {
            "kept_sections": F.when(has_text, named(F.concat(kept, added))).otherwise(listed),
            "removed_sections": F.when(has_text, removed).otherwise(none),
            "added_sections": F.when(has_text, added).otherwise(none),
        }
    )
    if sources:
        field = "note_esclusioni.sezioni_ateco_escluse"
        known = F.transform(F.filter(sources, lambda s: s["campo"] == field), lambda s: section_of_text(s["testo"]))
        fresh = F.filter("_out", lambda c: ~F.coalesce(F.array_contains(known, c["letter"]), F.lit(False)))
        marks = page_marks(t)
        new = F.transform(fresh, lambda c: _source(field, page_at(marks, c["start"]), snippet(t, c["start"], c["stop"], 220)))
        out = out.withColumn(sources, F.when(has_text & (F.size("_out") > 0), F.concat(F.col(sources), new)).otherwise(F.col(sources)))
    return out.drop("_cited", "_any", "_out")


def section_warnings() -> Column:
    removed = F.concat(F.lit("Coerenza ATECO: rimosse sezioni non citate esplicitamente nel testo: "), F.array_join("removed_sections", ", "))
    names = F.transform("added_sections", lambda x: F.concat(F.lit("Sez. "), x))
    added = F.concat(F.lit("Coerenza ATECO: recuperate dal testo sezioni escluse esplicite: "), F.array_join(names, ", "))
    return F.array_compact(F.array(F.when(F.size("removed_sections") > 0, removed), F.when(F.size("added_sections") > 0, added)))


# --- economic details ---

def _first_of(text: Column, patterns: tuple[str, ...], with_unit: tuple[bool, ...]) -> Column:
    """Months stated by the pattern that matches earliest, else null."""
    tries = []
    for i, (pattern, unit) in enumerate(zip(patterns, with_unit)):
        regex = "(?iU)" + pattern
        amount = F.regexp_extract(text, regex, 1)
        months = N.parse_loose(amount) * N.unit_months(F.regexp_extract(text, regex, 2)) if unit else N.parse_loose(amount)
        at = F.regexp_instr(text, F.lit(regex))
        tries.append(F.when(text.rlike(regex), F.struct(at.alias("at"), F.lit(i).alias("i"), months.alias("months"))))
    return F.array_min(F.array_compact(F.array(*tries)))["months"]


#: Strings of which a text that a pattern matches holds one.
AMOUNT_PARTS, DURATION_PARTS, GRACE_PARTS, REBATE_PARTS, CUMULATION_PARTS = ("mporto",), ("durata", "odo"), ("ammortamento",), ("abbuon",), ("cumul",)


def economic_facts(text: Column, lowered: Column | None = None) -> dict[str, Column]:
    """What the text itself states: amounts, durations in months, rate, rebate instalments, cumulation clause.

    lowered: the text in lower case, if it is at hand; patterns are tried only where it holds what they need.
    """
    low = F.lower(text) if lowered is None else lowered
    rate = F.when(X.mentions(low, "ntere"), X.capture(text, R.RATE_PATTERN, 1))
    amount = lambda pattern: F.when(X.mentions(low, *AMOUNT_PARTS), N.parse_italian(X.capture(text, pattern, 1)))
    may_cumulate = X.mentions(low, "cumul", "compat", "benef") & X.matches(text, r"(?:di\s+cumulo|non\s+cumulabil|compatibil|aver\s+beneficiato)")
    return {
        "text_amount_min": amount(R.AMOUNT_MIN_PATTERN),
        "text_amount_max": amount(R.AMOUNT_MAX_PATTERN),
        "text_duration": F.when(X.mentions(low, *DURATION_PARTS) & X.matches(text, "durata|periodo"), _first_of(text, R.DURATION_TEXT_PATTERNS, (True, True, True))),
        "text_grace": F.when(X.mentions(low, *GRACE_PARTS), _first_of(text, R.GRACE_TEXT_PATTERNS, (True, False))),
        "text_rate": F.when(F.lower(rate) == "zero", F.lit(0.0)).otherwise(N.parse_italian(F.trim(F.replace(rate, F.lit("%"), F.lit(""))))),
        "text_rebate": F.when(X.mentions(low, *REBATE_PARTS), X.capture(text, R.REBATE_PATTERN, 1).cast("double")),
        "text_cumulation": F.when(may_cumulate, X.squash(cumulation_clause(X.squash(text)))),
    }


def cumulation_clause(compact: Column) -> Column:
    """The first clause of a text without runs of blanks.

    No clause begins more than a fixed number of characters before the first core, so the pattern, which looks far ahead
    from every character, is not tried on what lies before.
    """

    def near(c: Column) -> Column:
        parts = F.split(c, "(?iU)" + R.CUMULATION_CORE_PATTERN, 2)
        return L.bind(parts, lambda p: F.when(F.size(p) > 1, F.substring(c, F.greatest(F.length(F.get(p, F.lit(0))) - R.CUMULATION_BEFORE, F.lit(0)) + 1, F.length(c))))

    return L.bind(L.bind(compact, near), lambda c: X.capture(c, R.CUMULATION_PATTERN, 0))


def reconcile_economics(rows: DataFrame, text: str, lowered: Column | None = None) -> DataFrame:
    """Fills the loan instrument and the cumulation clause from explicit wording in the text.

    A loan named only by the flat type list gets an instrument; stated durations overrule recorded ones. lowered: the text
    in lower case, if it is at hand.
    """
    if lowered is None:
        return reconcile_economics(rows.withColumn("_low", F.lower(text)), text, F.col("_low")).drop("_low")
    t = F.col(text)
    has_text = F.coalesce(t != "", F.lit(False))
    facts = {name: F.when(has_text, c) for name, c in economic_facts(t, lowered).items()}
    known = rows.withColumns(facts)
    loan = "finanziamento_agevolato"
    aid = F.col("agevolazioni")
    place = F.array_position(F.transform(aid, lambda a: a["tipo"]), loan)
    missing = has_text & (place == 0) & F.array_contains("tipo_agevolazione", loan)
    # One rebuilt instrument with the same fields as the recorded ones.
    fields = known.schema["agevolazioni"].dataType.elementType.fields
    empty = F.struct(*[
        (F.lit(loan) if f.name == "tipo"
         else F.struct(*[F.lit(None).cast("double").alias(b) for b in R.PERCENT_BANDS]) if f.name == "percentuali_per_dimensione"
         else F.array().cast(f.dataType) if f.name in ("condizioni", "fonti")
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields
    ])
    known = known.withColumn("agevolazioni", F.when(missing, F.concat(aid, F.array(empty))).otherwise(aid))
    place = F.array_position(F.transform("agevolazioni", lambda a: a["tipo"]), loan)
    rules = {
        "importo_min": lambda a: F.coalesce(a["importo_min"], F.col("text_amount_min")),
        "importo_max": lambda a: F.coalesce(a["importo_max"], F.col("text_amount_max")),
        "tasso_interesse_percentuale": lambda a: F.coalesce(a["tasso_interesse_percentuale"], F.col("text_rate")),
        "durata_mesi": lambda a: F.coalesce(F.col("text_duration"), a["durata_mesi"]),
        "preammortamento_mesi": lambda a: F.coalesce(F.col("text_grace"), a["preammortamento_mesi"]),
        "abbuono_rate": lambda a: F.coalesce(a["abbuono_rate"], F.col("text_rebate")),
        "rimborso_richiesto": lambda a: F.lit(True),
        "fonti": lambda a: F.concat(a["fonti"], loan_sources(t, a, lowered)),
    }

    def filled(a: Column) -> Column:
        return F.struct(*[(rules[f.name](a) if f.name in rules else a[f.name]).alias(f.name) for f in fields])

    clause = F.col("text_cumulation")
    current = F.lower(F.coalesce("cumulabilita", F.lit("")))
    replace = clause.isNotNull() & (
        (F.trim(current) == "")
        | (current.contains("de minimis") & ~current.contains("medesimo investimento") & F.lower(clause).contains("medesimo investimento"))
    )
    marks = page_marks(t)
    place_of_clause = F.greatest(F.regexp_instr(t, F.lit("(?iU)" + R.CUMULATION_PLACE_PATTERN)) - 1, F.lit(0))
    evidence = F.array(_source("cumulabilita", page_at(marks, place_of_clause), clause))
    return known.withColumns(
        {
            "agevolazioni": F.when(
                has_text & (place > 0), F.transform("agevolazioni", lambda a, i: F.when(i + 1 == place, filled(a)).otherwise(a))
            ).otherwise(F.col("agevolazioni")),
            "cumulabilita": F.when(replace, clause).otherwise(F.col("cumulabilita")),
            "fonti": F.when(replace, F.concat("fonti", evidence)).otherwise(F.col("fonti")),
        }
    )


def loan_sources(text: Column, loan: Column, lowered: Column | None = None) -> Column:
    """Evidence for the loan details taken from the text. lowered: the text in lower case, if it is at hand."""
    marks = page_marks(text)
    low = F.lower(text) if lowered is None else lowered

    def quote(field: str, patterns: tuple[str, ...], radius: int, parts: tuple[str, ...], used: Column) -> Column:
        starts = []
        for i, p in enumerate(patterns):
            at = F.regexp_instr(text, F.lit("(?iU)" + p)) - 1
            hit = F.regexp_extract(text, "(?iU)" + p, 0)
            starts.append(F.when(X.matches(text, p), F.struct(at.alias("at"), F.lit(i).alias("i"), F.length(hit).alias("n"))))
        first = F.array_min(F.array_compact(F.array(*starts)))
        entry = L.bind(first, lambda m: F.when(m.isNotNull(), _source(
            f"agevolazioni[].{field}", page_at(marks, m["at"]), snippet(text, m["at"], m["at"] + m["n"], radius))))
        return F.when(used & X.mentions(low, *parts), entry)

    candidates = F.array_compact(F.array(
        quote("importo_min", (R.AMOUNT_MIN_PATTERN,), 80, AMOUNT_PARTS, loan["importo_min"].isNull()),
        quote("importo_max", (R.AMOUNT_MAX_PATTERN,), 80, AMOUNT_PARTS, loan["importo_max"].isNull()),
        quote("durata_mesi", R.DURATION_TEXT_PATTERNS, 80, DURATION_PARTS, F.col("text_duration").isNotNull()),
        quote("preammortamento_mesi", R.GRACE_TEXT_PATTERNS, 80, GRACE_PARTS, F.col("text_grace").isNotNull()),
        quote("abbuono_rate", (R.REBATE_PATTERN,), 100, REBATE_PARTS, loan["abbuono_rate"].isNull()),
    ))
    known = F.transform(loan["fonti"], L.source_signature)
    return F.filter(candidates, lambda s: ~F.array_contains(known, L.source_signature(s)))


def economic_warnings(text: Column, lowered: Column | None = None) -> Column:
    """Details the text states and the reconciled record still lacks. lowered: the text in lower case, if it is at hand."""
    if lowered is None:
        return L.bind(F.lower(text), lambda low: economic_warnings(text, low))
    has_rebate = F.exists("agevolazioni", lambda a: a["abbuono_rate"].isNotNull())
    rebate = ~has_rebate & X.mentions(lowered, *REBATE_PARTS) & X.matches(text, R.REBATE_PATTERN)
    cumulation = (F.coalesce("cumulabilita", F.lit("")) == "") & X.mentions(lowered, *CUMULATION_PARTS) & X.matches(text, R.CUMULATION_WORD_PATTERN)
    return F.array_compact(F.array(
        F.when(rebate, F.lit("Completezza economica: il testo cita un abbuono ma il campo è vuoto")),
        F.when(cumulation, F.lit("Completezza economica: il testo cita il cumulo ma il campo è vuoto")),
    ))


# --- issuer ---

def issuer_tokens(value: Column) -> Column:
    words = F.regexp_extract_all(X.fold_accents(F.lower(value)), F.lit("([a-z0-9]+)"), F.lit(1))
    told = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*R.ENTITY_STOPWORDS))
    return F.array_distinct(F.transform(told, lambda w: F.substring(w, 1, 6)))


def issuer_warning(issuer: Column, sources: Column) -> Column:
    """Warning when no quoted source supports the issuer, else null."""
    own = F.filter(sources, lambda s: s["campo"] == "ente")
    expected = issuer_tokens(issuer)
    backed = L.bind(expected, lambda e: (F.size(e) > 0) & F.exists(
        own, lambda s: s["testo"].isNotNull() & (F.size(F.array_except(e, issuer_tokens(s["testo"]))) == 0)))
    return F.when(F.trim(issuer) != "", F.when(
        F.size(own) == 0, F.lit("Coerenza fonti: manca una fonte testuale per il campo ente")
    ).when(~backed, F.concat(F.lit("Coerenza fonti: la fonte associata a ente non supporta il valore estratto “"), issuer, F.lit("”"))))


def issuer_candidate(issuer: Column, text: Column, lowered: Column | None = None) -> Column:
    """Best page snippet naming the issuer in a promoting context: struct<score,page,snippet> or null. lowered: the text in lower case, if it is at hand."""

    def named(expected: Column) -> Column:
        # a page that covers the tokens holds each of them, and so does the text; most texts end here
        holds = L.bind(X.folded(F.lower(text) if lowered is None else lowered), lambda t: F.forall(expected, lambda w: t.contains(w)))
        return F.when(holds, _best_snippet(issuer, expected, text))

    return L.bind(issuer_tokens(issuer), named)


def _best_snippet(issuer: Column, expected: Column, text: Column) -> Column:
    words = F.filter(
        F.regexp_extract_all(issuer, F.lit("([A-Za-zÀ-ÿ0-9]+)"), F.lit(1)),
        lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*R.ENTITY_STOPWORDS),
    )
    anchor = F.lower(F.coalesce(F.try_element_at(words, F.lit(-1)), issuer))
    context = "(?iU)(?:" + R.ENTITY_CONTEXT_PATTERN + ")"

    def candidate(segment: Column, i: Column) -> Column:
        def scored(s: Column) -> Column:
            return L.bind(F.size(F.regexp_extract_all(s["snippet"], F.lit(context), F.lit(0))), lambda hits: weighed(s, hits))

        def weighed(s: Column, hits: Column) -> Column:
            score = (
                F.lit(10)
                + F.when(F.lower(s["snippet"]).contains(F.lower(issuer)), 5).otherwise(0)
                + hits * 2
                - F.when(X.matches(s["snippet"], "(?:" + R.ENTITY_NEGATIVE_PATTERN + ")"), 8).otherwise(0)
                + F.when(s["page"] == 1, 2).otherwise(0)
            )
            return F.when(s["ok"] & (hits > 0), F.struct(
                score.alias("score"), (-i).alias("order"), s["page"].alias("page"), s["snippet"].alias("snippet")))

        compact = X.squash(segment["text"])

        def located(c: Column) -> Column:
            center = F.greatest(F.position(anchor, F.lower(c)) - 1, F.lit(0))
            covered = F.size(F.array_except(expected, issuer_tokens(c))) == 0
            return F.struct(segment["page"].alias("page"), X.piece(c, center - 320, center + 520).alias("snippet"), ((c != "") & covered).alias("ok"))

        return L.bind(L.bind(compact, located), scored)

    found = F.array_max(F.array_compact(F.transform(page_segments(text), candidate)))
    return F.when(F.size(expected) > 0, found)


def repair_issuer_source(rows: DataFrame, text: str, lowered: Column | None = None) -> DataFrame:
    """Replaces unsupported issuer sources by strong evidence from the text; adds ``issuer_page``."""
    t, issuer = F.col(text), F.col("ente")
    needed = F.coalesce(t != "", F.lit(False)) & issuer_warning(issuer, F.col("fonti")).isNotNull()
    found = rows.withColumn("_c", F.when(needed, issuer_candidate(issuer, t, lowered)))
    others = F.filter("fonti", lambda s: F.coalesce(s["campo"] != "ente", F.lit(True)))
    quote = F.array(_source("ente", F.col("_c")["page"], F.col("_c")["snippet"], "media"))
    note = F.concat(F.lit("Fonte ente: citazione incoerente sostituita con evidenza contestuale a pagina "),
                    F.coalesce(F.col("_c")["page"].cast("string"), F.lit("None")))
    return found.withColumns({
        "fonti": F.when(F.col("_c").isNotNull(), F.concat(others, quote)).otherwise(F.col("fonti")),
        "issuer_notice": F.when(F.col("_c").isNotNull(), note),
    }).drop("_c")


def neutralise_delimiters(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + R.DELIMITER_PATTERN, R.DELIMITER_REPLACEMENT.replace("[", r"\[").replace("]", r"\]"))
