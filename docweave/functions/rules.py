"""Rule tables of the document-extraction operators.

Fixed values: patterns, weights, thresholds, names and codes that results depend on, in order of precedence.
Patterns are for Java; \\b, \\s and \\d mean ASCII unless a pattern says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A weighted pattern; an anchor is enough to trust a type on its own. Weights are tenths of a point."""

    label: str
    pattern: str
    weight: int
    anchor: bool = False


@dataclass(frozen=True)
class Signature:
    """Rules of a document type. high is the score of full confidence, least the score to be taken at all."""

    kind: str
    high: int
    rules: tuple[Rule, ...]
    against: tuple[str, ...] = ()
    least: int = 30


_STATE_FILING = r"\b(?:SECRETARY\s+OF\s+STATE|DIVISION\s+OF\s+CORPORATIONS)\b"
_SUBSCRIBERS = r"\b(?:SUBSCRIBERS?|SUBSCRIBED)\s+(?:TO|BY|HERETO)\b"
_OBJECTS = r"\bOBJECTS?\s+(?:FOR\s+WHICH|OF)\s+THE\s+COMPANY\b"
_REGISTRAR = r"\b(?:REGISTRAR|REGISTRAR[ -]GENERAL)\b"
_MEMORANDUM = r"\bMEMORANDUM\s+OF\s+ASSOCIATION\b"
_ARTICLES = r"\bARTICLES\s+OF\s+ASSOCIATION\b"
_CAC_NUMBER = r"\b(?:RC|BN|IT|LLP|LP)\s*(?:NO\.?|NUMBER)?\s*[:#-]?\s*\d{4,12}\b"

SIGNATURES = (
    Signature("ARTICLES_OF_INCORPORATION", 100, (
        Rule("articles of incorporation", r"\bARTICLES\s+OF\s+INCORPORATION\b", 90, True),
        Rule("incorporator", r"\bINCORPORATORS?\b", 15),
        Rule("corporation formation", r"\bFORM(?:ED|ATION)\s+(?:AS\s+)?A\s+CORPORATION\b", 20),
        Rule("state filing", _STATE_FILING, 10),
    )),
    Signature("ARTICLES_OF_ORGANIZATION", 100, (
        Rule("articles of organization", r"\bARTICLES\s+OF\s+ORGANIZATION\b", 90, True),
        Rule("limited liability company", r"\bLIMITED\s+LIABILITY\s+COMPANY\b|\bLLC\b", 15),
        Rule("organizer", r"\bORGANIZERS?\b", 10),
        Rule("state filing", _STATE_FILING, 10),
    )),
    Signature("TAX_REGISTRATION_CERTIFICATE", 100, (
        Rule("tax registration certificate", r"\b(?:TAX|VAT)\s+REGISTRATION\s+CERTIFICATE\b", 90, True),
        Rule("taxpayer certificate", r"\bCERTIFICATE\s+OF\s+TAXPAYER\s+REGISTRATION\b", 80, True),
        Rule("tax identifier", r"\b(?:TAX\s+IDENTIFICATION\s+NUMBER|TIN|VAT\s+NUMBER)\b", 20),
        Rule("tax authority", r"\b(?:REVENUE\s+SERVICE|TAX\s+AUTHORITY|INTERNAL\s+REVENUE)\b", 15),
    )),
    Signature("BUSINESS_REGISTRATION_CERTIFICATE", 100, (
        Rule("business registration certificate", r"\bBUSINESS\s+REGISTRATION\s+CERTIFICATE\b", 90, True),
        Rule("business name certificate", r"\bCERTIFICATE\s+OF\s+BUSINESS\s+NAME\s+REGISTRATION\b", 80, True),
        Rule("business registry", r"\bBUSINESS\s+(?:REGISTRY|REGISTER)\b", 20),
        Rule("trading name", r"\b(?:TRADING\s+NAME|DOING\s+BUSINESS\s+AS|DBA)\b", 10),
    )),
    Signature("CERTIFICATE_OF_FORMATION", 100, (
        Rule("certificate of formation", r"\bCERTIFICATE\s+OF\s+FORMATION\b", 90, True),
        Rule("formation filing", r"\b(?:DATE\s+OF\s+FORMATION|FORMATION\s+DATE)\b", 20),
        Rule("state registry", _STATE_FILING, 15),
    )),
    Signature("CERTIFICATE_OF_GOOD_STANDING", 100, (
        Rule("certificate of good standing", r"\bCERTIFICATE\s+OF\s+GOOD\s+STANDING\b", 90, True),
        Rule("certificate of existence", r"\bCERTIFICATE\s+OF\s+(?:LEGAL\s+)?EXISTENCE\b", 80, True),
        Rule("good standing", r"\b(?:IN\s+)?GOOD\s+STANDING\b", 20),
        Rule("registry certification", r"\b(?:REGISTRAR|SECRETARY\s+OF\s+STATE)\b", 10),
    )),
    Signature("CAC_CERTIFICATE", 130, (
        Rule("Corporate Affairs Commission", r"\bCORPORATE\s+AFFAIRS\s+COMMISSION\b", 50, True),
        Rule("CAC certificate", r"\bCAC\b.{0,60}\bCERTIFICATE\b|\bCERTIFICATE\b.{0,60}\bCAC\b", 40, True),
        Rule("CAMA", r"\b(?:CAMA|COMPANIES\s+AND\s+ALLIED\s+MATTERS\s+ACT)\b", 20),
        Rule("CAC identifier", _CAC_NUMBER, 15),
    ), least=50),
    Signature("CERTIFICATE_OF_CHANGE_OF_NAME", 100, (
        Rule("certificate of change of name", r"\bCERTIFICATE\s+OF\s+(?:CHANGE|CHANGE\s+OF)\s+NAME\b", 90, True),
        Rule("change of name", r"\bCHANGE\s+OF\s+(?:COMPANY\s+)?NAME\b", 40, True),
        Rule("formerly known as", r"\bFORMERLY\s+KNOWN\s+AS\b", 30),
        Rule("new company name", r"\bNEW\s+(?:COMPANY\s+)?NAME\b", 20),
        Rule("registrar certification", _REGISTRAR, 10),
    )),
    Signature("CERTIFICATE_OF_INCORPORATION", 110, (
        Rule("certificate of incorporation", r"\bCERTIFICATE\s+OF\s+INCORPORATION\b", 80, True),
        Rule("incorporated under law", r"\bINCORPORATED\s+(?:UNDER|PURSUANT\s+TO)\b", 30, True),
        Rule("this is to certify", r"\b(?:THIS\s+IS\s+TO|I\s+HEREBY)\s+CERTIF(?:Y|IES)\b", 20),
        Rule("date of incorporation", r"\bDATE\s+OF\s+INCORPORATION\b", 20),
        Rule("company registration number", r"\b(?:COMPANY|REGISTRATION)\s+(?:NO|NUMBER)\b", 15),
        Rule("registrar seal", r"\b(?:REGISTRAR|OFFICIAL\s+SEAL)\b", 10),
    ), (r"\bSTATUS\s+REPORT\b", r"\bMEMORANDUM\s+AND\s+ARTICLES\b")),
    Signature("CERTIFICATE_OF_REGISTRATION", 100, (
        Rule("certificate of registration", r"\bCERTIFICATE\s+OF\s+REGISTRATION\b", 80, True),
        Rule("business name registration", r"\bREGISTRATION\s+OF\s+(?:A\s+)?BUSINESS\s+NAME\b", 40, True),
        Rule("registered as", r"\b(?:HAS\s+BEEN|IS\s+HEREBY)\s+REGISTERED\b", 25),
        Rule("business registration number", r"\b(?:BN|BUSINESS\s+NUMBER|REGISTRATION\s+NUMBER)\b", 15),
        Rule("registrar certification", _REGISTRAR, 10),
    ), (r"\bCERTIFICATE\s+OF\s+INCORPORATION\b",)),
    Signature("COMPANY_STATUS_REPORT", 80, (
        Rule("company status report", r"\b(?:COMPANY|ENTITY|BUSINESS)?\s*STATUS\s+REPORT\b", 80, True),
        Rule("company profile", r"\b(?:COMPANY|ENTITY)\s+PROFILE\b", 40, True),
        Rule("general details section", r"\b(?:COMPANY|GENERAL|REGISTRATION)\s+DETAILS\b", 20),
        Rule("company status", r"\b(?:COMPANY|REGISTRATION)\s+STATUS\b", 20),
        Rule("registered address", r"\bREGISTERED\s+(?:OFFICE\s+)?ADDRESS\b", 15),
        Rule("directors section", r"\b(?:PARTICULARS\s+OF\s+)?DIRECTORS\b", 15),
        Rule("shareholders section", r"\b(?:SHAREHOLDERS|SHARE\s+CAPITAL|RETURN\s+OF\s+ALLOTMENT)\b", 15),
        Rule("current record language", r"\b(?:CURRENT\s+STATUS|AS\s+AT|ANNUAL\s+RETURNS)\b", 10),
    )),
    Signature("MEMORANDUM_AND_ARTICLES_OF_ASSOCIATION", 120, (
        Rule("memorandum and articles headings", f"(?=.*{_MEMORANDUM})(?=.*{_ARTICLES})", 50, True),
        Rule("memorandum and articles of association", r"\bMEMORANDUM\s+(?:AND|&)\s+ARTICLES\s+OF\s+ASSOCIATION\b", 90, True),
        Rule("MEMART", r"\bMEMART\b", 70, True),
        Rule("memorandum of association", _MEMORANDUM, 35),
        Rule("articles of association", _ARTICLES, 35),
        Rule("company objects", _OBJECTS, 15),
        Rule("subscriber statement", _SUBSCRIBERS, 10),
        Rule("share capital clause", r"\bSHARE\s+CAPITAL\s+OF\s+THE\s+COMPANY\b", 10),
    )),
    Signature("MEMORANDUM_OF_ASSOCIATION", 90, (
        Rule("memorandum of association", _MEMORANDUM, 70, True),
        Rule("company objects", _OBJECTS, 20),
        Rule("registered office clause", r"\bREGISTERED\s+OFFICE\s+OF\s+THE\s+COMPANY\b", 10),
        Rule("subscriber statement", _SUBSCRIBERS, 10),
    ), (_ARTICLES,)),
    Signature("ARTICLES_OF_ASSOCIATION", 90, (
        Rule("articles of association", _ARTICLES, 70, True),
        Rule("company constitution", r"\b(?:COMPANY\s+)?CONSTITUTION\b", 50, True),
        Rule("model articles", r"\bMODEL\s+ARTICLES\b", 20),
        Rule("interpretation article", r"\bINTERPRETATION\b.{0,80}\bARTICLES\b", 10),
        Rule("directors powers", r"\bPOWERS?\s+OF\s+(?:THE\s+)?DIRECTORS\b", 10),
    ), (_MEMORANDUM,)),
    Signature("COMPANY_REGISTRY_EXTRACT", 90, (
        Rule("company registry extract", r"\b(?:COMPANY|BUSINESS|ENTITY)\s+REGISTRY\s+EXTRACT\b", 80, True),
        Rule("register extract", r"\b(?:REGISTER|REGISTRY)\s+EXTRACT\b", 50, True),
        Rule("company search report", r"\b(?:COMPANY|ENTITY)\s+SEARCH\s+(?:REPORT|RESULT)\b", 40, True),
        Rule("registered particulars", r"\bREGISTERED\s+PARTICULARS\b", 20),
    ), (r"\bCERTIFIED\s+(?:TRUE\s+COPY|EXTRACT)\b",)),
    Signature("CERTIFIED_REGISTRY_EXTRACT", 100, (
        Rule("certified registry extract", r"\bCERTIFIED\s+(?:TRUE\s+COPY|EXTRACT)\b", 60, True),
        Rule("registry extract", r"\b(?:REGISTRY|REGISTER)\s+EXTRACT\b", 50, True),
        Rule("company search report", r"\b(?:COMPANY|OFFICIAL)\s+SEARCH\s+(?:REPORT|RESULT)\b", 40, True),
        Rule("extracted from register", r"\bEXTRACT(?:ED)?\s+FROM\s+THE\s+REGISTER\b", 30),
        Rule("registered particulars", r"\bREGISTERED\s+PARTICULARS\b", 20),
    ), (r"\bSTATUS\s+REPORT\b",)),
)

UNKNOWN_DOCUMENT = "UNKNOWN_BUSINESS_DOCUMENT"
COMBINED = "MEMORANDUM_AND_ARTICLES_OF_ASSOCIATION"
COMBINED_TERMS = ("memorandum and articles headings", "memorandum and articles of association")
COMBINED_PARTS = ("MEMORANDUM_OF_ASSOCIATION", "ARTICLES_OF_ASSOCIATION")
COMPANY_CONTEXT = (
    r"\b(?:COMPANY|BUSINESS|CORPORATION|INCORPORATED|LIMITED|LTD|PLC|LLC|REGISTRAR|REGISTRY|ASSOCIATION)\b"
)
JOINED_PHRASES = (
    "CERTIFICATE OF INCORPORATION", "CERTIFICATE OF REGISTRATION", "BUSINESS REGISTRATION CERTIFICATE",
    "TAX REGISTRATION CERTIFICATE", "ARTICLES OF INCORPORATION", "ARTICLES OF ORGANIZATION", "CERTIFICATE OF FORMATION",
    "CERTIFICATE OF GOOD STANDING", "REGISTRY EXTRACT", "STATUS REPORT", "MEMORANDUM AND ARTICLES",
    "MEMORANDUM & ARTICLES", "ARTICLES OF ASSOCIATION", "MEMORANDUM OF ASSOCIATION",
)

#: code, name, patterns with weights in tenths.
LANGUAGES = (
    ("en", "English", (
        (r"\bCERTIFICATE\s+OF\b", 30), (r"\b(?:BUSINESS|TAX)\s+REGISTRATION\s+CERTIFICATE\b", 30),
        (r"\bTHIS\s+IS\s+TO\s+CERTIFY\b", 30), (r"\bREGISTERED\s+OFFICE\b", 20),
        (r"\bCOMPANY\s+(?:NUMBER|STATUS|NAME)\b", 15), (r"\bCOMPANY\s+STATUS\s+REPORT\b", 30),
        (r"\bSTATUS\s+REPORT\b", 25), (r"\bPERSONS?\s+WITH\s+SIGNIFICANT\s+CONTROL\b", 20),
        (r"\bPERSONSWITHSIGNIFICANTCONTROL\b", 20), (r"\bROLE\s+TYPE\s+DIRECTOR\b", 20),
        (r"\bDIRECTOR'?S?\s*DETAILS\b", 15), (r"\b(?:GENERAL|COMPANY|REGISTRATION)\s+DETAILS\b", 15),
        (r"\bARTICLES\s+OF\b", 20),
    )),
    ("fr", "French", (
        (r"\bCERTIFICAT\s+(?:DE|D['’])", 30), (r"\bSOCI[ÉE]T[ÉE]\b", 20), (r"\bSI[ÈE]GE\s+SOCIAL\b", 25),
        (r"\bREGISTRE\s+(?:DU\s+COMMERCE|DES\s+SOCI[ÉE]T[ÉE]S)\b", 30),
        (r"\bDATE\s+DE\s+(?:CR[ÉE]ATION|CONSTITUTION)\b", 20),
    )),
    ("pt", "Portuguese", (
        (r"\bCERTID[ÃA]O\s+DE\b", 30), (r"\bSOCIEDADE\b", 20), (r"\bSEDE\s+SOCIAL\b", 25),
        (r"\bREGISTO\s+COMERCIAL\b|\bREGISTRO\s+COMERCIAL\b", 30), (r"\bDATA\s+DE\s+CONSTITUI[ÇC][ÃA]O\b", 20),
    )),
    ("es", "Spanish", (
        (r"\bCERTIFICADO\s+DE\b", 30), (r"\bSOCIEDAD\b", 20), (r"\bDOMICILIO\s+SOCIAL\b", 25),
        (r"\bREGISTRO\s+MERCANTIL\b", 30), (r"\bFECHA\s+DE\s+CONSTITUCI[ÓO]N\b", 20),
    )),
    ("de", "German", (
        (r"\bGR[ÜU]NDUNGSURKUNDE\b|\bURKUNDE\b", 30), (r"\bGESELLSCHAFT\b", 20), (r"\bHANDELSREGISTER\b", 30),
        (r"\bSITZ\s+DER\s+GESELLSCHAFT\b", 25),
    )),
    ("nl", "Dutch", (
        (r"\bOPRICHTINGSAKTE\b|\bAKTE\s+VAN\s+OPRICHTING\b", 30), (r"\bVENNOOTSCHAP\b", 20),
        (r"\bHANDELSREGISTER\b", 30), (r"\bSTATUTAIRE\s+ZETEL\b", 25),
    )),
)

US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii",
    "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
US_SPECIAL_REGISTRIES = {
    "DE": "Delaware Division of Corporations",
    "DC": "District of Columbia Department of Licensing and Consumer Protection",
    "FL": "Florida Division of Corporations",
    "MA": "Massachusetts Secretary of the Commonwealth",
    "NY": "New York Department of State, Division of Corporations",
}

#: Kinds of labels that company documents have; see business_text_score().
COMPANY_LABELS = (
    r"\b(?:COMPANY|ENTITY|BUSINESS)\s+(?:NAME|NUMBER|STATUS|TYPE)\b",
    r"\b(?:REGISTERED\s+OFFICE|PRINCIPAL\s+PLACE\s+OF\s+BUSINESS)\b",
    r"\b(?:DIRECTORS?|SHAREHOLDERS?|BENEFICIAL\s+OWNERS?|SHARE\s+CAPITAL)\b",
    r"\b(?:REGISTRATION|INCORPORATION|FORMATION)\s+DATE\b",
)
