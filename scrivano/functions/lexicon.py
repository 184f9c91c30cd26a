"""Patterns and word lists of the domain, in Java regex syntax, and renderings for RE2 where SQL checks need one.

Java needs (?U) for Unicode word boundaries and (?d) so that only LF ends a line; RE2 has ASCII boundaries only.
"""

from __future__ import annotations

# ---- fixed values: patterns and word lists that results depend on --------------------------------------------------
TITLE_NUMBER = r"^\s*(\d+(\.\d+){0,4})\s+(.+?)\s*$"
BULLET = r"^\s*([-•\*]|\(?[a-zA-Z0-9]+\)|[0-9]+\.)\s+"
DEONTIC_WORDS = "deve|devono|è tenuto|è obbligato|obbligatorio|entro"
SEQUENCE_WORDS = "prima|poi|successivamente|infine|entro"
IMPERATIVE_WORDS = (
    "rimuovere|pulire|lavare|risciacquare|asciugare|verificare|controllare|"
    "compilare|inserire|registrare|inviare|consegnare|firmare|archiviare|"
    "posizionare|chiudere|aprire|bloccare|sbloccare|selezionare|premere|"
    "assicurarsi|accertarsi|misurare|pesare|etichettare|smaltire|sanificare"
)
TITLE_KEYWORDS = (
    r"art\.?\s*\d+|capo\s+[ivxlc]+|sezione\s+[ivxlc]+|paragrafo\s+\d+|"
    r"oggetto|finalit[àa]|scopo|ambito|definizioni|glossario|acronimi|"
    r"modalit[àa]|procedura|procedure|requisiti|documentazione|allegati|"
    r"responsabilit[àa]|competenze|istruzioni|fasi|passaggi|termini|"
    r"verifiche|controlli|sanzioni|modulistica"
)
BARE_ATTACHMENT = r"^\s*ALLEGATO\s+[A-Z0-9]+\s*$"
COPULA_WORDS = "è|sono|deve|devono|può|possono|viene|vengono"
TITLE_HINT_WORDS = r"procedur|modalità|istruzioni|iter|compiti|attivit|verific"
TITLE_HINT_GUIDED = TITLE_HINT_WORDS + r"|come\s+fare"
DEF_TERM = r"[A-Z][A-Z0-9/._-]{1,30}"
DEF_COLON = rf"^\s*({DEF_TERM})\s*[:=]\s*(.+)\s*$"
DEF_DASH = rf"^\s*({DEF_TERM})\s*[–\-]\s*(.+)\s*$"
DEF_MEANS = rf"^\s*per\s+({DEF_TERM})\s+si\s+intende\s+(.+)\s*$"
DEF_ACRONYM = rf"\b(acronimo|sigla)\b.*\b({DEF_TERM})\b.*\b(significa|sta per|indica)\b"
DEF_HINTS = ("si intende", "definizion", "glossario", "acronim")
DEF_BAD_TERM = r"^(art\.?|capo|sezione|paragrafo|oggetto|scopo|ambito|definizioni|glossario|acronimi|allegato)$"
CONTINUATION = r"^\s*(?:[,;:\)\]]|\w|\/|-)"
TERM_PATTERNS = (
    r"^\s*([A-Z][A-Z0-9\/\-\._ ]{1,40})\s*[:\-]\s*(.{10,250})\s*$",
    r"(?i)\bper\s+[\"']?(.{2,60}?)[\"']?\s+si\s+intende\s+(.{10,250})",
    r"^\s*([A-Za-zÀ-ÖØ-öø-ÿ0-9\/\-\._ ]{2,60})\s*=\s*(.{10,250})\s*$",
    r"^\s*([A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9\/\-\._ ]{1,60})\s*[:\-]\s*(.{5,1200})\s*$",
)
STOP_TERMS = ("art", "articolo", "comma", "capitolo", "sezione", "allegato", "tabella")
ROLE_WORDS = "ufficio|responsabile|comune|regione|richiedente|utente|cittadino|operatore|sportello|dirigente|procedimento"
ROLE_HINT_WORDS = "ufficio|responsabile|dirigente|sportello|operatore|richiedente|utente|cittadino|ente|comune|regione|amministrazione|titolare|impresa|azienda"
AGENT_CANON = {
    "operator": "Operatore", "operatore": "Operatore", "citizen": "Cittadino", "cittadino": "Cittadino",
    "utente": "Richiedente", "user": "Richiedente", "applicant": "Richiedente", "richiedente": "Richiedente",
}
AGENT_BANNED = ("operator", "citizen", "user", "applicant", "clerk")
DEFAULT_AGENT = "Operatore"
PALETTE = ("#FFB3BA", "#BAFFC9", "#BAE1FF", "#FFFFBA", "#E0BBE4", "#957DAD", "#D291BC", "#FEC8D8", "#A2D9FF", "#B0E3AA")
SUPPORT_WORDS = "\ndefinizioni requisiti prerequisiti responsabilità ruoli\nobbligatorio deve devono entro eccezione esclusione documento"
DEFINITION_QUERIES = (
    "definizioni glossario acronimi si intende",
    "per X si intende",
    "acronimo significa",
    "sigla significa",
    "ruolo responsabile ufficio sportello operatore richiedente",
)
SECTION_FLAGS = (
    ("DEONTIC", "deve|devono|necessario|obbligatorio"),
    ("SEQUENCE", "prima|poi|successivamente|infine"),
    ("ADMIN_LEXICON", "domanda|istanza|richiesta|autorizzazione|documentazione"),
)
EVENT_TAGS = {
    "event_timer": "@timer", "event_intermediate": "@intermediate", "event_message": "@message",
    "event_signal": "@signal", "event_conditional": "@conditional", "event_link": "@link",
}
GATEWAY_PREFIX = {"gateway_exclusive": "", "gateway_parallel": "@parallel ", "gateway_inclusive": "@inclusive ", "gateway_event": "@event "}
TRUNCATED = "\n...[TRUNCATED]..."
# -------------------------------------------------------------------------------------------------------------------


def words(alternatives: str) -> str:
    """Whole words, any case, Java."""
    return rf"(?iuU)\b({alternatives})\b"


def keyword_line(alternatives: str = TITLE_KEYWORDS) -> str:
    return rf"(?iuU)^\s*({alternatives})\b"


def re2_words(alternatives: str) -> str:
    """The same for RE2, whose word boundaries know ASCII only."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({alternatives})($|[^\p{{L}}\p{{N}}_])"


def re2_keyword_line(alternatives: str = TITLE_KEYWORDS) -> str:
    return rf"(?i)^\s*({alternatives})($|[^\p{{L}}\p{{N}}_])"
