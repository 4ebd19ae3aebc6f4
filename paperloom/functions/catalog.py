"""Fixed values that results depend on: classes, roles, categories, areas, lists of names and patterns."""

from __future__ import annotations

# Categories of files by extension.
CATEGORIES = {
    "pdf": ["pdf"],
    "word": ["doc", "docx"],
    "excel": ["xls", "xlsx", "xlsm"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "tiff"],
    "heic": ["heic", "heif"],
    "text": ["txt", "csv"],
    "rtf": ["rtf"],
    "p7m": ["p7m"],
    "email": ["msg"],
    "eml": ["eml"],
    "html": ["html", "htm"],
    "xml": ["xml"],
    "odt": ["odt"],
    "ods": ["ods"],
    "pptx": ["pptx", "ppt"],
    "zip": ["zip"],
}
SKIPPED_EXTENSIONS = "vcf exe dll bat cmd msi com sys ini log tmp bak lnk url db sqlite mdb mp3 mp4 avi mov wav flac psd ai sketch dmg iso tar gz rar 7z".split()
#: What the first profile has besides.
CATEGORIES_V1 = {"mpp": ["mpp"], "cam": ["cam"], "unsupported": ["dwg", "dwl", "dwl2", "css", "svg", "download", "crdownload", "dsf2"]}
#: The six groups of the command line, in reading order.
CATEGORIES_CLI = {
    "pdf": ["pdf"],
    "word": ["doc", "docx"],
    "excel": ["xls", "xlsx"],
    "images": ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif"],
    "text": ["txt", "csv"],
}

# Document classes with area, cap of characters and default role.
CLASSES = [
    ("VISURA", "DOCUMENTAZIONE LEGALE E SOCIETARIA", 30000, "CORE"),
    ("STATUTO", "DOCUMENTAZIONE LEGALE E SOCIETARIA", 25000, "CORE"),
    ("DVR", "SICUREZZA SUL LAVORO", 25000, "CORE"),
    ("POS", "SICUREZZA SUL LAVORO", 20000, "CORE"),
    ("BILANCIO", "REGOLARITÀ CONTRIBUTIVA E FISCALE", 25000, "CORE"),
    ("CCNL", "GESTIONE RISORSE UMANE", 20000, "CORE"),
    ("ATTESTATO", "FORMAZIONE E ADDESTRAMENTO", 8000, "AGGREGABLE"),
    ("CERTIFICATO_ISO", "ALTRO", 18000, "CORE"),
    ("CONTRATTO", "GESTIONE FORNITORI E APPALTI", 15000, "CORE"),
    ("FATTURA", "REGOLARITÀ CONTRIBUTIVA E FISCALE", 8000, "AGGREGABLE"),
    ("IDENTITA", "GESTIONE RISORSE UMANE", 5000, "SUPPORT"),
    ("SOA", "DOCUMENTAZIONE LEGALE E SOCIETARIA", 18000, "CORE"),
    ("ALTRO", "ALTRO", 12000, "SUPPORT"),
]
ROLES = ["CORE", "AGGREGABLE", "SUPPORT", "NOISE"]

# Names of files that are always core evidence, first match wins; a mark or the end of the name bounds them.
_EDGE, _END = r"(?:^|[\W_])", r"(?:[\W_]|$)"
WHITELIST = [
    f"(?i){_EDGE}(?:DVR|DUVRI|POS|PSC|PiMUS){_END}",
    f"(?i){_EDGE}visura{_END}",
    f"(?i){_EDGE}statuto{_END}",
    f"(?i){_EDGE}SOA{_END}",
    f"(?i){_EDGE}CCIAA{_END}",
    f"(?i){_EDGE}REA{_END}",
    rf"(?i){_EDGE}ISO[\s_-]?\d{{4,5}}{_END}",
    rf"(?i){_EDGE}certificat[oa][\s_-]+(?:qualit[aà]|ambient|sicur|energet|ESG|sostenibilit[aà])",
    rf"(?i){_EDGE}bilancio[\s_-]+(?:sostenibilit[aà]|ESG|carbon|esercizio)",
    rf"(?i){_EDGE}(?:GHG|emissioni|inventario[\s_-]+emissioni){_END}",
    rf"(?i){_EDGE}(?:non[\s_-]?conformit|NC[\s_-]\d|azione[\s_-]+correttiv)",
    rf"(?i){_EDGE}nomina[\s_-]+(?:RSPP|RLS|medico|energy[\s_-]?manager|preposto)",
    rf"(?i){_EDGE}(?:infortun|near[\s_-]?miss){_END}",
    rf"(?i){_EDGE}(?:CIG|CUP)[\s_:-]?[A-Z0-9]{{6,}}{_END}",
    f"(?i){_EDGE}mansionario{_END}",
    f"(?i){_EDGE}organigramma{_END}",
    rf"(?i){_EDGE}registro[\s_-]+(?:infortun|emissioni|formazione)",
    rf"(?i){_EDGE}politica[\s_-]+(?:per[\s_-]+la[\s_-]+)?(?:qualit[aà]|sicurezza|ambiente)",
    f"{_EDGE}(?:ESRS|GRI|CSRD|EASI){_END}",
    rf"(?i){_EDGE}contratto[\s_-]+(?:di[\s_-]+)?(?:appalto|sublocazione|servizio)",
    rf"(?i){_EDGE}giudizio[\s_-]+di[\s_-]+idoneit[aà]",
    rf"(?i){_EDGE}dichiarazione[\s_-]+conformit[aà]",
    rf"(?i){_EDGE}audit[\s_-]+intern",
    rf"(?i){_EDGE}riesame[\s_-]+della[\s_-]+direzione",
]

# The 18 areas of evidence, and the 10 of reports, in order.
AREAS = [
    "01 · CONTESTO E PARTI INTERESSATE",
    "02 · LEADERSHIP E IMPEGNO",
    "03 · PIANIFICAZIONE",
    "04 · RISORSE",
    "05 · OPERATIVITÀ",
    "06 · VALUTAZIONE DELLE PRESTAZIONI",
    "07 · MIGLIORAMENTO",
    "08 · DOCUMENTAZIONE LEGALE E SOCIETARIA",
    "09 · RISORSE UMANE E LAVORO",
    "10 · SALUTE E SICUREZZA SUL LAVORO",
    "11 · AMBIENTE ED ENERGIA",
    "12 · CLIMA E CARBONIO",
    "13 · ESG E RENDICONTAZIONE",
    "14 · SICUREZZA DELLE INFORMAZIONI",
    "15 · ANTICORRUZIONE E COMPLIANCE",
    "16 · PARITÀ DI GENERE E DIVERSITY",
    "17 · SICUREZZA STRADALE",
    "18 · ALTRI",
]
REPORT_AREAS = [
    "DOCUMENTAZIONE LEGALE E SOCIETARIA",
    "REGOLARITÀ CONTRIBUTIVA E FISCALE",
    "SICUREZZA SUL LAVORO",
    "SORVEGLIANZA SANITARIA",
    "FORMAZIONE E ADDESTRAMENTO",
    "GESTIONE RISORSE UMANE",
    "GESTIONE MEZZI E ATTREZZATURE",
    "GESTIONE FORNITORI E APPALTI",
    "GESTIONE AMBIENTALE E RIFIUTI",
    "ALTRO",
]

# Words in a file's name or head that raise its cap of characters, first match wins.
CHAR_CAPS = [
    (["visura", "camerale", "cciaa", "rea", "registro imprese"], 30000),
    (["dvr", "valutazione rischi", "valutazione dei rischi"], 25000),
    (["statuto", "atto costitutivo", "atto notarile"], 25000),
    (["bilancio", "esg", "sostenibilita", "gri", "esrs", "csrd"], 25000),
    (["analisi energetica", "iso 50001", "enpi", "see "], 20000),
    (["ghg", "inventario emissioni", "iso 14064", "carbon"], 20000),
    (["iso 9001", "iso 14001", "iso 45001", "iso 27001", "iso 37001", "iso 39001", "soa ", "rating legalita"], 18000),
]
CHAR_CAP_DEFAULT = 12000

# Legal forms at the end of a company's name, removed one after another.
LEGAL_FORMS = [
    r"\s+S\.?r\.?l\.?\s*$",
    r"\s+S\.?p\.?A\.?\s*$",
    r"\s+S\.?a\.?s\.?\s*$",
    r"\s+S\.?n\.?c\.?\s*$",
    r"\s+S\.?c\.?a\.?r\.?l\.?\s*$",
    r"\s+S\.?c\.?r\.?l\.?\s*$",
    r"\s+Scarl\s*$",
    r"\s+società\s+cooperativa\s*$",
    r"\s+cooperativa\s*$",
    r"\s+Ltd\.?\s*$",
    r"\s+LLC\s*$",
    r"\s+Inc\.?\s*$",
    r"\s+GmbH\s*$",
    r"\s+S\.?r\.?l\.?s\.?\s*$",
]
# Legal forms anywhere in a name, for the key that groups its variants.
KEY_FORMS = [
    r"\bsocieta?\s+consortile\s+per\s+azioni\b",
    r"\bsocieta?\s+consortile\s+a\s*r\s*l\b",
    r"\bsocieta?\s+consortile\b",
    r"\bsoc\s+cons\s+r\s*l\b",
    r"\bsoc\s+cons\b",
    r"\bsocieta\b",
    r"\ba\s*r\s*l\b",
    r"\bs\s*c\s*a\s*r\s*l\b",
    r"\bs\s*c\s*p\s*a\b",
    r"\bs\s*p\s*a\b",
    r"\bs\s*r\s*l\b",
    r"\bs\s*n\s*c\b",
    r"\bs\s*a\s*s\b",
]
KEY_WORDS = "srl spa scpa scarl snc sas consortile cons soc rl s c p a r l n".split()
PLACEHOLDER_NAMES = [
    "",
    "n.d.",
    "n/a",
    "none",
    "null",
    "azienda non identificata",
    "[ragione sociale",
    "ragione sociale",
    "nome azienda",
    "ragione_sociale",
    "[ragione sociale — regola inderogabile]",
]
# What kinds of documents say about the source of a company's name.
SOURCE_SCORES = [
    ("visura|camerale|cciaa|registro imprese", 100),
    ("statuto|atto costitutivo|atto notarile", 80),
    ("attestazione soa|certificato iso|rating legalit", 60),
    ("fattura|bilancio", 30),
    (r"\bdvr\b|curriculum|cv |attestato.{0,30}formazione|registro.{0,5}presenze", -50),
]
# Names of archives that name no company.
GENERIC_ARCHIVES = [
    "allegati", "documenti", "files", "doc", "docs", "archive", "archivio", "cartella", "folder", "zip", "upload", "pratica",
    "materiale", "materiali", "tutto", "vari", "misc", "allegato", "folder upload", "cartella selezionata", "new folder",
    "documenti audit", "audit", "report", "relazione", "evidenze", "pratiche",
]

# Fewest words of a clause, and those below which it gets a warning, by norm; others have 80 and 150.
CLAUSE_WORDS = [
    ("ISO 9001", 100, 150),
    ("ISO 14001", 100, 150),
    ("ISO 45001", 100, 150),
    ("ISO 14064", 100, 150),
    ("ESG", 100, 150),
    ("PAS 24000", 100, 150),
    ("ISO 27001", 100, 175),
    ("ISO 37001", 100, 175),
    ("ISO 39001", 100, 175),
    ("ISO 50001", 100, 175),
    ("ISO 50001 ESQ", 100, 175),
    ("ISO 50001 CERTIS", 100, 175),
    ("ISO/IEC 27001", 100, 175),
    ("ISO/IEC 27001:2022", 100, 175),
]
CLAUSE_WORDS_DEFAULT = (80, 150)

# Standards that have a template.
STANDARDS = [
    "ISO 9001", "ISO 9001:2015", "ISO 14001", "ISO 14001:2015", "ISO 45001", "ISO 45001:2018", "ISO 14064", "ISO 14064-1",
    "ISO 14064-1:2018", "ESG", "EASI", "Modello EASI ESG", "PAS 24000", "PAS24000", "ISO 27001", "ISO 27001:2022",
    "ISO/IEC 27001", "ISO/IEC 27001:2022", "ISO 37001", "ISO 37001:2016", "ISO 39001", "ISO 39001:2012", "ISO 50001",
    "ISO 50001:2018", "ISO 50001 ESQ", "ISO 50001 CERTIS",
]

# Types of progress events; those that are never dropped; kinds of model calls.
EVENT_TYPES = "session.start phase.start phase.tick phase.end file.start file.warn file.degrade file.done llm.token error heartbeat done".split()
PROTECTED_EVENTS = "session.start phase.start phase.end error heartbeat done file.warn file.degrade".split()
CALL_KINDS = "classify analyze ocr embedding other".split()
USD_TO_EUR = 0.93

# Provider profiles as (key, model, most files, most characters, multiplier of caps, workers).
PROFILES = [("small", "m-small", 4, 50000, 1.0, 7), ("large", "m-large", 10, 100000, 2.5, 4)]

# Personal identifiers, replaced in this order, and the mark that replaces them.
PERSONAL = [
    r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b",
    r"(?i)\b(?:data\s+di\s+nascita|nato\s+il)\s*[:\-]?\s*\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b",
    r"(?i)\bnat[oa]\s+(?:il|a)\s+[^\n;,]{1,60}",
]
PERSONAL_MARK = "[dato privacy rimosso]"

# Markers of partial output, as (kind, pattern of a line): blanks and tabs only, so that none runs over a line's end.
MARKERS = [
    ("meta_azienda", r"(?m)^[ \t]*azienda[ \t]*:[ \t]*$"),
    ("meta_indice", r"(?m)^[ \t]*indice[ \t]*:[ \t]*$"),
    ("category", r"(?m)^#{2,6}[ \t]*(\d{1,2}[ \t]*[·\-—][ \t]*[A-ZÀ-Ú][^\n]+)$"),
    ("document", r"(?mi)^#{2,6}[ \t]*(?:scheda[ \t]+)?doc(?:umento)?[ \t]*(?:n\.?|nr\.?)?[ \t]*(\d+)\b"),
    ("doc_titolo", r"(?m)^[ \t]*titolo[ \t]*:[ \t]*['\"]?([^'\"\n]+?)['\"]?[ \t]*$"),
    ("doc_tipo", r"(?m)^[ \t]*tipo[ \t]*:[ \t]*['\"]?([^'\"\n]+?)['\"]?[ \t]*$"),
]
