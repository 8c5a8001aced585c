"""What each recogniser looks for. All patterns here are fixed values; the order is that in which spans are emitted."""

from __future__ import annotations

from palimpsest.functions.kinds import SPACE

#: Between the groups of a written identifier.
GAP = " \u00a0\u202f"
#: Between the groups of a phone number.
PHONE_GAP = f"[{GAP}\\t.\\-]"

EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9\-]+)*\.[a-z]{2,}\b"
IBAN = rf"(?i)\b[a-z]{{2}}\d{{2}}(?:[{GAP}]?[a-z0-9]{{4}}){{2,7}}(?:[{GAP}]?[a-z0-9]{{1,3}})?\b"
CARD = rf"\b\d(?:[{GAP}\-]?\d){{12,18}}\b"
SIRET = rf"\b\d{{3}}[{GAP}]?\d{{3}}[{GAP}]?\d{{3}}[{GAP}]?\d{{5}}\b"
SIREN = rf"\b\d{{3}}[{GAP}]?\d{{3}}[{GAP}]?\d{{3}}\b"
PHONE = rf"(?:\+\d{{1,3}}{PHONE_GAP}?)?(?:\(\d{{1,4}}\){PHONE_GAP}?)?\d(?:{PHONE_GAP}?\d){{6,14}}"
IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
IPV6 = r"(?i)\b(?:[a-f0-9]{0,4}:){2,7}[a-f0-9]{0,4}\b"

TYPE_FIRST = "rue|avenue|av\\.|boulevard|bd\\.?|chemin|place|impasse|all[ée]e|route|quai|cours|square|villa|passage|voie|sentier|via|viale|piazza|piazzale|corso|strada|calle|avenida|avda\\.?|plaza|paseo|carrera|rua|travessa|pra[çc]a"
TYPE_LAST = "street|road|avenue|lane|drive|way|court|close|crescent|terrace|square|boulevard|stra[ßs]se|weg|gasse|platz|allee|straat|laan|plein|gatan|gata|vej|vei"
TYPE_ABBREVIATED = "st|rd|ave|ln|dr|ct|blvd|str"
TYPE_COMPOUND = "stra[ßs]e|str\\.|weg|gasse|platz|allee|straat|laan|plein|gatan|vej"
_S = f"[{SPACE}]"
STREET = "|".join(
    (
        rf"\b\d{{1,4}}{_S}*(?i:bis|ter|quater)?,?{_S}+(?i:{TYPE_FIRST})\b[^\r\n,;.]{{2,60}}",
        rf"\b\d{{1,4}}[a-zA-Z]?,?{_S}+(?:\p{{Lu}}[\p{{L}}'’\-]*{_S}+){{1,4}}(?:(?i:{TYPE_LAST})\b|(?i:{TYPE_ABBREVIATED})\.)",
        rf"\b\p{{Lu}}[\p{{L}}\-]{{2,}}(?i:{TYPE_COMPOUND}){_S}+\d{{1,4}}[a-zA-Z]?\b",
        rf"\b\d{{1,4}}[a-zA-Z]?,?{_S}+\p{{Lu}}[\p{{L}}\-]{{2,}}(?i:{TYPE_COMPOUND})\b",
    )
)
_CAPITAL = "[A-ZÀ-ÖØ-Þ]"
_PLACE = rf"{_CAPITAL}[\p{{L}}'’\-]+(?:[ \-]{_CAPITAL}?[\p{{L}}'’\-]+){{0,3}}\b"
POSTCODE = "|".join(
    (
        rf"\b\d{{5}}{_S}+{_PLACE}",
        rf"\b\d{{4}}{_S}?[A-Z]{{2}}{_S}+{_PLACE}",
        rf"\b[A-Z]{{1,2}}\d[A-Z\d]?{_S}?\d[A-Z]{{2}}\b",
        rf"\b[A-Z]\d[A-Z]{_S}?\d[A-Z]\d\b",
        rf"\b{_CAPITAL}[\p{{L}}'’\-]+(?: {_CAPITAL}[\p{{L}}'’\-]+){{0,2}},{_S}?[A-Z]{{2}}{_S}+\d{{5}}(?:-\d{{4}})?\b",
    )
)

#: Recogniser, kind and pattern, in the order of emission.
ORDER = (
    ("email", "email", EMAIL),
    ("iban", "iban", IBAN),
    ("card", "credit_card", CARD),
    ("siret", "siret", SIRET),
    ("siren", "siren", SIREN),
    ("phone", "phone", PHONE),
    ("ipv4", "ip_address", IPV4),
    ("ipv6", "ip_address", IPV6),
    ("street", "address", STREET),
    ("postcode", "address", POSTCODE),
)
