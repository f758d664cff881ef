"""Reference lists and tables whose content is part of the observable results."""

# Score weights and partial scores.
WEIGHT_REGION = 30
WEIGHT_SECTOR = 40
WEIGHT_SIZE = 20
WEIGHT_REVENUE = 10
ACTIVITY_UNCERTAIN = 15
ACTIVITY_PARTIAL = 15
ACTIVITY_GOOD = 30

# Company size classes and the regions that mean "no territorial limit".
SIZES = ("micro", "piccola", "media", "grande")
ANY_REGION = ("tutte", "tutta italia")

# Review states.
PENDING = "da_revisionare"
VALIDATED = "validato"

# EU size limits (class, min employees, max employees, max revenue).
EU_SIZE_LIMITS = (
    ("micro", None, 9, 2_000_000),
    ("piccola", None, 49, 10_000_000),
    ("media", None, 249, 50_000_000),
    ("grande", 250, None, None),
)

# Sector sections with first division, last division and label.
SECTIONS = (
    ("A", 1, 3, "Agricoltura, silvicoltura e pesca"),
    ("B", 5, 9, "Estrazione di minerali"),
    ("C", 10, 33, "Attività manifatturiere"),
    ("D", 35, 35, "Energia elettrica e gas"),
    ("E", 36, 39, "Acqua, reti fognarie e rifiuti"),
    ("F", 41, 43, "Costruzioni"),
    ("G", 45, 47, "Commercio"),
    ("H", 49, 53, "Trasporto e magazzinaggio"),
    ("I", 55, 56, "Alloggio e ristorazione"),
    ("J", 58, 63, "Servizi di informazione e comunicazione"),
    ("K", 64, 66, "Attività finanziarie e assicurative"),
    ("L", 68, 68, "Attività immobiliari"),
    ("M", 69, 75, "Attività professionali, scientifiche e tecniche"),
    ("N", 77, 82, "Servizi di supporto alle imprese"),
    ("O", 84, 84, "Amministrazione pubblica"),
    ("P", 85, 85, "Istruzione"),
    ("Q", 86, 88, "Sanità e assistenza sociale"),
    ("R", 90, 93, "Attività artistiche, sportive e di intrattenimento"),
    ("S", 94, 96, "Altre attività di servizi"),
    ("T", 97, 98, "Attività di famiglie e convivenze"),
    ("U", 99, 99, "Organizzazioni extraterritoriali"),
)
SECTION_LETTER_PATTERN = r"\b([A-U])\b"

# Legal-form keys per category.
LEGAL_FORM_KEYS = {
    "società di capitali": (
        "srls", "srl", "spa", "sapa", "responsabilitalimitata", "perazioni", "societadicapitali",
    ),
    "società di persone": (
        "snc", "sas", "ss", "nomecollettivo", "accomanditasemplice", "societasemplice", "societadipersone",
    ),
    "ditte individuali": (
        "dittaindividuale", "imprenditoreindividuale", "impresaindividuale", "ditteindividuali",
        "imprenditoriindividuali", "impreseindividuali",
    ),
    "cooperative": (
        "societacooperativa", "cooperativa", "cooperative", "coop", "scarl", "scrl", "scpa",
    ),
    "associazioni ed enti no-profit": (
        "associazione", "fondazione", "onlus", "ets", "aps", "odv", "associazionientinoprofit",
    ),
    "liberi professionisti": (
        "liberoprofessionista", "studioprofessionale", "studioassociato", "liberiprofessionisti",
    ),
}
REGISTRY_MARKER = "registroimprese"

# Accented letters folded in legal-form keys.
LEGAL_FORM_ACCENTS = ("àèéìòùÀÈÉÌÒÙ", "aeeiouAEEIOU")

# Italian month names.
MONTHS = (
    "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
)

# Deadline keywords with weights, search radius and age limit.
DEADLINE_KEYWORDS = (
    ("scadenza presentazione", 10),
    ("termine di presentazione", 10),
    ("termine per la presentazione", 10),
    ("entro e non oltre", 9),
    ("data limite", 8),
    ("scadenza", 7),
    ("entro il", 5),
    ("fino al", 5),
    ("entro", 3),
)
DEADLINE_RADIUS = 400
DEADLINE_MAX_AGE_DAYS = 180
DATE_PATTERNS = (
    r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b",
    r"\b(\d{2})\.(\d{2})\.(\d{4})\b",
    r"\b(\d{4})-(\d{2})-(\d{2})\b",
    r"\b(\d{1,2})°?\s+(gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s+(\d{4})\b",
)
ROLLING_WINDOW_PATTERN = (
    r"sportello\s+continuo|fino\s+ad\s+esaurimento|esaurimento\s+delle?\s+risorse"
    r"|esaurimento\s+fondi|misura\s+permanente|a\s+sportello"
)

# Enumerations of the call record.
SUBMISSION_MODES = ("sportello", "click_day", "graduatoria", "mista")
AID_TYPES = ("fondo_perduto", "finanziamento_agevolato", "garanzia", "credito_imposta", "voucher")
NON_REPAYABLE = ("fondo_perduto", "voucher", "credito_imposta")
CERTAINTY = ("alta", "media", "bassa")
ENTITY_ROLES = ("promotore", "gestore", "ente_attuatore", "intermediario_finanziario", "piattaforma", "altro")
ROLE_PRIORITY = (
    ("promotore", 6), ("ente_attuatore", 5), ("gestore", 4),
    ("intermediario_finanziario", 3), ("piattaforma", 2), ("altro", 1),
)
TRUE_WORDS = ("true", "sì", "si", "yes", "1")
PERCENT_BANDS = ("micro", "piccola", "media", "default")
NUMERIC_FIELDS = (
    "contributo_max", "fatturato_max", "spesa_minima_ammissibile", "spesa_massima_ammissibile",
    "numero_dipendenti_min", "numero_dipendenti_max",
)
INSTRUMENT_NUMBERS = (
    "importo_min", "importo_max", "percentuale", "tasso_interesse_percentuale",
    "durata_mesi", "preammortamento_mesi", "abbuono_rate",
)

# Keys of the call record, in record order.
#: Older names of record keys; where one says something, it goes first.
KEY_ALIASES = {"regioni_ammesse": "regioni", "codici_ateco_ammessi": "codici_ateco", "dimensione_impresa": "dimensione"}
RECORD_KEYS = (
    "titolo", "ente", "data_pubblicazione", "data_scadenza", "codici_ateco_ammessi", "attivita_ammesse",
    "ateco_aperto_a_tutti", "regioni_ammesse", "dimensione_impresa", "fatturato_max",
    "numero_dipendenti_min", "numero_dipendenti_max", "contributo_max", "percentuale_fondo_perduto",
    "modalita_presentazione", "tipo_agevolazione", "cumulabilita", "spese_ammissibili",
    "link_fonte_ufficiale", "url_documento_origine", "note_esclusioni", "spesa_minima_ammissibile",
    "spesa_massima_ammissibile", "anzianita_impresa", "forme_giuridiche_ammesse", "agevolazioni",
    "fonti", "enti_coinvolti", "copertura_estrazione",
)
NOT_COUNTED_KEYS = ("agevolazioni", "fonti", "enti_coinvolti", "copertura_estrazione", "url_documento_origine")
NOTE_LISTS = (
    "sezioni_ateco_escluse", "attivita_vietate", "soggetti_esclusi", "spese_non_ammissibili", "altre_esclusioni",
)

# Months per time unit.
UNIT_MONTHS = (
    ("mese", 1), ("mesi", 1), ("trimestre", 3), ("trimestri", 3),
    ("semestre", 6), ("semestri", 6), ("anno", 12), ("anni", 12),
)
DURATION_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(mesi?|trimestr[ei]|semestr[ei]|ann[oi])\b"

# Words ignored and words unified when phrases are compared.
PHRASE_STOPWORDS = (
    "a", "ad", "al", "alla", "alle", "allo", "anche", "che", "con", "da", "dal", "dalla", "delle", "dei",
    "del", "di", "e", "ed", "gli", "i", "il", "in", "la", "le", "lo", "nei", "nel", "nella", "o", "per",
    "su", "un", "una", "investimenti", "investimento", "attivita", "impianti", "connessi", "connesse",
    "legati", "legate",
)
PHRASE_SYNONYMS = (
    ("fabbricazione", "produzione"), ("commercializzazione", "commercio"),
    ("smaltimento", "smaltire"), ("smantellamento", "smantellare"),
)

# Evidence patterns and word lists.
PAGE_MARKER_PATTERN = r"---\s*PAGINA\s+(\d+)\s*---"
SECTION_CITATION_PATTERN = r"\b(?:sez(?:ione)?\.?\s*(?:ateco\s*)?|sezione\s+ateco\s+)([A-U])\b"
EXCLUSION_PATTERN = r"esclus|non\s+ammiss|vietat|non\s+possono|non\s+pu[oò]"
EXCLUSION_RADIUS = 800
ENTITY_STOPWORDS = (
    "spa", "srl", "societa", "ente", "del", "della", "delle", "degli", "dei", "di", "e", "per",
    "il", "la", "le", "lo", "un", "una",
)
ENTITY_CONTEXT_PATTERN = (
    r"bollettino\s+ufficiale|programma\s+region|autorit[aà]|amministrazione|promoss|adottat|approvat"
    r"|finanziat|ente\s+(?:promotore|concedente)"
)
ENTITY_NEGATIVE_PATTERN = (
    r"gestore|gestione\s+(?:è\s+)?affidata|responsabile\s+del\s+procedimento|trattamento\s+dei\s+dati"
)
REBATE_PATTERN = r"abbuon\w*\s+(?:delle\s+)?ultime\s+(\d{1,3})\s+rate"
CUMULATION_PATTERN = (
    r"(?:non\s+aver\s+beneficiato\s+di\s+altri\s+sostegni\s+pubblici[^.]{0,500}"
    r"|[^.]{0,220}(?:limiti?\s+di\s+cumulo|non\s+cumulabil|non\s+[èe]\s+compatibil)[^.]{0,320})\."
)
# What every cumulation clause holds, and how many characters of the clause may come before it.
CUMULATION_CORE_PATTERN = r"(?:non\s+aver\s+beneficiato\s+di\s+altri\s+sostegni\s+pubblici|limiti?\s+di\s+cumulo|non\s+cumulabil|non\s+[èe]\s+compatibil)"
CUMULATION_BEFORE = 220
CUMULATION_WORD_PATTERN = r"\bcumul\w*\b"
CUMULATION_PLACE_PATTERN = r"\b(?:cumulo|cumulabil\w*|medesimo\s+investimento)\b"
ITALIAN_NUMBER = r"(\d+(?:\.\d{3})*(?:,\d+)?)"
AMOUNT_MIN_PATTERN = r"\bimporto\s+minimo\s*:?\s*(?:€\s*)?" + ITALIAN_NUMBER + r"\s*(?:euro|€)?"
AMOUNT_MAX_PATTERN = r"\bimporto\s+massimo\s*:?\s*(?:€\s*)?" + ITALIAN_NUMBER + r"\s*(?:euro|€)?"
RATE_PATTERN = r"\btasso\s+di\s+interesse\s*:?\s*(zero|" + ITALIAN_NUMBER + r"\s*%)"
AMOUNT_UNIT = r"(\d+(?:[.,]\d+)?)\s*(mesi?|trimestr[ei]|semestr[ei]|ann[oi])\b"
DURATION_TEXT_PATTERNS = (
    r"\b(?:finanziamento|prestito|mutuo)\b[^.;\n]{0,120}?\bdurata(?:\s+di\s+ammortamento)?\b[^\d.;\n]{0,40}?"
    + AMOUNT_UNIT,
    r"\bperiodo\s+di\s+(?:rimborso|ammortamento)(?:\s+del\s+(?:prestito|finanziamento|mutuo))?\b"
    r"[^\d.;\n]{0,40}?" + AMOUNT_UNIT,
    r"\bdurata\s*:\s*" + AMOUNT_UNIT,
)
GRACE_TEXT_PATTERNS = (
    r"\bpre[\s\-‐‑‒–—]?ammortamento\b[^\d.;\n]{0,40}?" + AMOUNT_UNIT,
    r"\bpre[\s\-‐‑‒–—]?ammortamento\s*:\s*(\d+(?:[.,]\d+)?)(?!\s*[/\\-]\s*\d)",
)
DELIMITER_PATTERN = r"</\s*bando_text\s*>"
DELIMITER_REPLACEMENT = "[TAG_RIMOSSO]"

# Relevance patterns.
TITLE_COMPETITION_PATTERN = (
    r"\bconcorso pubblico\b|\bconcorso per (?:titoli|esami|titoli ed esami)\b|\bbando di concorso\b"
)
PERSONNEL_PATTERN = r"(?:assunzion\w*|reclutament\w*|personale|posti? di lavoro)"
RECRUITMENT_PATTERN = r"(?:assunzion\w*|reclutament\w*)"
SELECTION_PATTERN = r"(?:selezione pubblica|procedura selettiva)"
RANKING_PATTERN = r"(?:concorso|idone[io]|vincitor\w*|selezione (?:di |del )?personale)"
RELEVANCE_HEADER_CHARS = 3000

# Size limits of documents and chunks.
MIN_TEXT_CHARS = 50
MAX_TEXT_CHARS = 250_000
MAX_FILE_BYTES = 10_000_000
CHUNK_CHARS = 60_000
CHUNK_OVERLAP = 2_000

# Admission window in seconds and hits per window.
ADMISSION_WINDOW_SECONDS = 3600
ADMISSION_MAX_HITS = 10

# Number of cards per page.
PAGE_SIZE = 9

# Expense labels with the needles that select them, umbrella terms, and the VAT word.
EXPENSE_RULES = (
    ("Arredi", ("arred",)),
    ("Impianti", ("impiant",)),
    ("Macchinari", ("macchinar",)),
    ("Attrezzature", ("attrezzatur",)),
    ("Mezzi targati", ("mezzitargat", "veicol", "automezz")),
    ("Hardware", ("hardware",)),
    ("Software", ("software", "licenzeinformatic")),
    ("Brevetti", ("brevett",)),
    ("Certificazioni di qualità", ("certificaz", "sistemadiqualita")),
    ("Realizzazione sito web", ("sitoweb", "sitointernet", "portaleweb")),
    ("Adeguamento funzionale sede operativa", ("adeguamentofunzional",)),
    ("Ristrutturazione sede operativa", ("ristrutturazion",)),
    ("Ricerca e sviluppo", ("ricercaesviluppo",)),
    ("Consulenze specialistiche", ("consulenz",)),
    ("Formazione", ("formazion",)),
    ("Personale", ("costidelpersonale", "spesedipersonale")),
    ("Imposta di bollo", ("impostadibollo", "bollodovut")),
    ("Servizi di accompagnamento alla realizzazione", ("servizidiaccompagnamento",)),
)
UMBRELLA_EXPENSES = (
    "investimentimaterialieimmateriali", "altrespeseconnesse", "altrespeseconnesseallarealizzazionedelprogetto",
)

# Ban labels; a rule applies when every group has a needle in the key.
BAN_RULES = (
    ("Gioco d'azzardo", (("giocodazzardo", "casedagioco", "casadagioco"),)),
    ("Pornografia e commercio sessuale", (("pornograf", "commerciosessual"),)),
    ("Armi e munizioni", (("armi", "munizion"),)),
    ("Energia nucleare", (("nuclear",),)),
    ("Pesca e acquacoltura", (("pesc", "acquacoltur"),)),
    ("Attività agricole primarie", (("produzioneprimaria",), ("agricol", "prodottiagricoli"))),
    ("Sviluppo immobiliare speculativo", (("sviluppoimmobiliar",), ("speculat", "unicoscopo", "rivendit", "rilocazion"))),
    ("Attività di esportazione e reti di distribuzione", (("esportazion", "retedidistribuzion"),)),
    ("Violazioni dei diritti umani", (("dirittiuman", "dirittiindividual"),)),
    ("Clonazione e modificazione genetica umana", (("clonazion", "patrimoniogenetico", "embrion"),)),
    ("Sperimentazione animale", (("animalivivi",), ("sperimental", "scientific"))),
    ("Combustibili fossili ed estrazione mineraria", (("combustibilifossil", "estrazionemineraria"),)),
    ("Smaltimento dei rifiuti in discarica", (("discaric",),)),
    ("Trattamento meccanico-biologico dei rifiuti", (("trattamentomeccanicobiologico", "tmb"),)),
    ("Incenerimento dei rifiuti", (("inceneritor",),)),
    ("Infrastrutture aeroportuali", (("infrastruttureaeroportual",),)),
)
TOBACCO_LABELS = ("Tabacco (salvo bar tabacchi)", "Tabacco")

# Labels of the sheet.
MODE_LABELS = (
    ("sportello", "Sportello (a esaurimento fondi)"), ("click_day", "Click day"),
    ("graduatoria", "Graduatoria a valutazione"), ("mista", "Mista (sportello + graduatoria)"),
)
AID_LABELS = (
    ("fondo_perduto", "Fondo perduto"), ("finanziamento_agevolato", "Finanziamento agevolato"), ("garanzia", "Garanzia"),
    ("credito_imposta", "Credito d'imposta"), ("voucher", "Voucher"),
)
ROLE_LABELS = (
    ("promotore", "Promotore"), ("gestore", "Gestore"), ("ente_attuatore", "Ente attuatore"),
    ("intermediario_finanziario", "Intermediario finanziario"), ("piattaforma", "Piattaforma"), ("altro", "Altro soggetto"),
)
SHEET_UNAVAILABLE = "*Scheda non disponibile — dati bando insufficienti.*"
SHEET_DISCLAIMER = (
    "*Dati estratti automaticamente tramite AI e potenzialmente incompleti o imprecisi. "
    "Verificare sempre scadenze, importi e requisiti sulla fonte ufficiale prima di qualsiasi utilizzo.*"
)
FALLBACK_PREFIX_PATTERN = r"^(?:spese?|costi?|investimenti?)\s+(?:ammissibili\s+)?(?:per|di|in)\s+"

# IPv4 networks that are not public, as address and prefix length.
CLOSED_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
