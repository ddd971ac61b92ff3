"""Document texts rendered from the star-schema tables, as SQL that Spark and DuckDB both run.

Every view has doc_id and text; templates are lines with {expressions}. Rendering is input, not an operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docweave.session import spread


def _line(template: str) -> str:
    parts = re.split(r"\{([^{}]+)\}", template)
    out = [f"CAST({p} AS STRING)" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p]
    return out[0] if len(out) == 1 else f"concat({', '.join(out)})" if out else "''"


def _text(lines: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(_line(x.strip()) for x in lines.strip().split("\n")) + ")"


def _cases(key: str, templates: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(templates))
    return f"CASE {key} % {len(templates)} {whens} END"


_DAY = "lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')"
_BUSINESS = (
    f"""FEDERAL REPUBLIC OF NIGERIA
    CORPORATE AFFAIRS COMMISSION
    CERTIFICATE OF INCORPORATION
    This is to certify that CUSTOMER {{c_custkey}} GLOBAL SERVICES LIMITED is hereby incorporated under the Companies and Allied Matters Act
    RC {{1000000 + c_custkey}}
    Company Name: CUSTOMER {{c_custkey}} GLOBAL SERVICES LIMITED
    Date of Incorporation: {{{_DAY}}} March 2020
    Date of Issue: 2020-04-{{{_DAY}}}
    Company Type: Private Company Limited by Shares
    Company Status: Active
    Registered Address: {{c_custkey}} Broad Street, Lagos
    Tax Identification Number: {{10000000 + c_custkey}}-0001
    Certificate Number: CAC/2020/ABC{{c_custkey}}""",
    """STATE OF DELAWARE
    DIVISION OF CORPORATIONS
    ARTICLES OF ORGANIZATION
    Limited Liability Company
    Entity Name: CUSTOMER {c_custkey} VENTURES LLC
    Entity ID: {7000000 + c_custkey}
    Filing Number: FN-{c_custkey}-2021
    Date of Formation: 04/{lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')}/2021
    EIN: 12-{lpad(CAST(c_custkey AS STRING), 7, '0')}
    Organizer: Alex Example""",
    """COMPANY STATUS REPORT
    General Details
    Company Name: CUSTOMER {c_custkey} HOLDINGS PLC
    Company Status: {CASE WHEN c_custkey % 5 = 0 THEN 'In liquidation' ELSE 'ACTIVE' END}
    Registered Office Address: {c_custkey} Marina Road
    Particulars of Directors
    Annual returns as at 2023-01-{lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')}""",
    """MEMORANDUM AND ARTICLES OF ASSOCIATION
    of CUSTOMER {c_custkey} FOODS LTD
    MEMORANDUM OF ASSOCIATION
    ARTICLES OF ASSOCIATION
    OBJECTS OF THE COMPANY
    1. To sell food and to trade
    2. To own farms
    SHARE CAPITAL OF THE COMPANY
    Authorised Share Capital: NGN {c_custkey * 1000} divided into {c_custkey * 1000} ordinary shares""",
    """REGISTRY EXTRACT
    Registry Identifier: XY-{c_custkey}
    Custom Sector Code: QX-{c_custkey % 40}
    Local Filing Category: MERCHANT-A
    SECRETARY OF STATE OF ELSEWHERE""",
    """CERTIFICAT DE CONSTITUTION
    Société: CLIENT {c_custkey} SARL
    Siège social: {c_custkey} rue de la Paix
    Registre du commerce
    Date de création: {lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')}/02/2019""",
    """COMPANIES HOUSE
    Certificate of Good Standing
    The Registrar of Companies for England and Wales certifies
    Company Number: {CAST(10000000 + c_custkey AS STRING)}
    Company Name: CUSTOMER {c_custkey} TRADING PLC
    Companies Act 2006, United Kingdom""",
    """Gesellschaft {c_custkey} GmbH
    Handelsregister, Sitz der Gesellschaft Berlin
    Gründungsurkunde""",
    """TAX REGISTRATION CERTIFICATE
    Republic of Kenya
    KRA PIN: A{lpad(CAST(c_custkey AS STRING), 9, '0')}Z
    Tax Authority
    Business Registration Service, PVT-{lpad(CAST(c_custkey AS STRING), 7, '0')}""",
    """Just a plain letter number {c_custkey} about nothing""",
    """CERTIFICATEOFREGISTRATION of a business name
    Republic of Ghana – Registrar-General's Department
    has been registered, Registrar General
    BN-{100000 + c_custkey}
    Business Number: BN{200000 + c_custkey}""",
    """CORPORATION DOCUMENT
    New York Department of State, Division of Corporations
    State of Florida Secretary of State
    Certificate of Change of Name formerly known as OLD {c_custkey} INC
    United States of America""",
    """CERTIFIED TRUE COPY
    Business Registry Extract, extracted from the register
    Republic of South Africa CIPC
    Enterprise {CAST(2000 + c_custkey % 20 AS STRING)}/{CAST(100000 + c_custkey AS STRING)}/07
    Status: STRUCK OFF""",
)

def _digits(expr: str) -> str:
    """The check digit of a zone value whose n characters are given as (position, numeric SQL) terms."""
    return f"CAST(({expr}) % 10 AS STRING)"


def _sum(text: str, start: int, size: int) -> str:
    """Weighted digits of a digit string that begins at a position of the checked value."""
    return " + ".join(f"{(7, 3, 1)[(start + i) % 3]} * CAST(substr({text}, {i + 1}, 1) AS INT)" for i in range(size))


_NUM = "lpad(CAST(c_custkey AS STRING), 8, '0')"
_PERSONAL = "lpad(CAST(10000000000 + c_custkey * 7919 AS STRING), 11, '0')"
_BORN = "concat(lpad(CAST(c_custkey % 99 AS STRING), 2, '0'), lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0'), lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'))"
_EXPIRY = "concat(lpad(CAST(25 + c_custkey % 20 AS STRING), 2, '0'), '0', CAST(c_custkey % 9 + 1 AS STRING), '15')"
_WORD = "translate(CAST(c_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')"
_STATE_OF = "CASE c_custkey % 3 WHEN 0 THEN 'NGA' WHEN 1 THEN 'GHA' ELSE 'UTO' END"

def _passports() -> str:
    """Two zone lines a customer with right check digits; some are then spoilt."""
    base = f"""SELECT c_custkey AS doc_id, {_NUM} AS num, {_BORN} AS born, {_EXPIRY} AS expiry, {_PERSONAL} AS personal,
      {_STATE_OF} AS nat, CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' ELSE '<' END AS sex,
      rpad(concat('P<', CASE WHEN c_custkey % 6 = 3 THEN 'N6A' ELSE {_STATE_OF} END, 'SUR', {_WORD}, '<<GIVEN',
             CASE WHEN c_custkey % 2 = 0 THEN '<' ELSE '' END, 'X', {_WORD}), 44, '<') AS l1 FROM customer"""
    checked = f"""SELECT *, {_digits(f"70 + {_sum('num', 1, 8)}")} AS d1, {_digits(_sum('born', 0, 6))} AS d2,
      {_digits(_sum('expiry', 0, 6))} AS d3, {_digits(_sum('personal', 0, 11))} AS d4 FROM ({base}) b"""
    # The composite runs over number + digit, birth + digit, expiry + digit + personal number + filler + digit.
    composite = " + ".join(
        ["70", _sum("num", 1, 8), _sum("d1", 9, 1), _sum("born", 10, 6), _sum("d2", 16, 1), _sum("expiry", 17, 6),
         _sum("d3", 23, 1), _sum("personal", 24, 11), _sum("d4", 38, 1)]
    )
    lines = f"""SELECT doc_id, l1, concat('A', num, d1, nat, born, d2, sex, expiry, d3, personal, '<<<', d4, {_digits(composite)}) AS l2
      FROM ({checked}) c"""
    return f"""SELECT doc_id, concat_ws(chr(10), 'PASSPORT', l1, CASE WHEN doc_id % 7 = 0 THEN concat(substr(l2, 1, 15), '9', substr(l2, 17))
      WHEN doc_id % 11 = 0 THEN replace(l2, '0', 'O') WHEN doc_id % 13 = 0 THEN concat(substr(l2, 1, 4), 'O', substr(l2, 6)) ELSE l2 END) AS text
      FROM ({lines}) l"""


_REGISTERS = (
    f"""DIRECTORS
    Alex {{{_WORD}}}    ACTIVE    {{c_custkey}} SHARES
    Morgan Sample    INACTIVE    50 SHARES
    Victoria Street Central
    SHAREHOLDERS
    Alex {{{_WORD}}}
    Shares: 75
    Percentage: 12.5%
    Sample Holdings Limited
    GENERAL DETAILS""",
    f"""DIRECTOR'S DETAILS
    1. ROLE TYPE DIRECTOR
    SURNAME Example
    FIRSTNAME Ada{{{_WORD}}}
    OTHERNAME NIL
    STATUS ACTIVE
    2.F ROLE TYPE SECRETARYCOMPANY
    COMPANY NAME Example Services {{{_WORD}}} Limited
    STATUS CEASED
    3. ROLE TYPE SHAREHOLDER
    SURNAME Holder
    FIRSTNAME Chi
    TOTALNUMBEROFSHARES {{c_custkey}}
    SHAREPERCENTAGE 25%""",
    """ARTICLES OF ASSOCIATION
    DIRECTORS
    Directors' General Authority
    Subject to the articles, the directors are responsible for management of the company.
    DIRECTORS
    Corporate Affairs Commission
    Model articles for private companies limited by shares""",
    f"""Secretary: Robin {{{_WORD}}} Sample
    Director: Robin {{{_WORD}}} Sample
    TRUSTEES
    Kim Public | ACTIVE
    Contact: someone@example.org""",
)
_NIN = (
    f"""NATIONAL IDENTITY MANAGEMENT SYSTEM
    Tracking ID: S7Y0{{c_custkey}}AB12
    NIN: {{10000000000 + c_custkey}}
    Surname: SAMPLE{{{_WORD}}}
    First Name: HOLDER
    Middle Name: PERSON
    Gender: M
    Address: {{c_custkey}} Example Street, Garden Area""",
    f"""FEDERAL REPUBLIC OF NIGERIA
    DIGITAL NIN
    SURNAME/NOM
    TESTER{{{_WORD}}}
    GIVEN NAMES/PRENOMS
    ADA
    DATE OF BIRTH
    01JAN1990
    SEX/SEXE
    F
    05 MAR 2021
    NATIONAL IDENTIFICATION NUMBER (NIN)
    {{lpad(CAST(c_custkey AS STRING), 4, '1')}} 567 8901""",
    """Some letter {c_custkey}
    without a number""",
    f"""NIN SLIP
    BEFORE{{{_WORD}}} Surname: Given Name: ADA
    {{20000000000 + c_custkey}} NIN: DOB: {{c_custkey % 28 + 1}}-02-1991 Sex: FEMALE""",
)
_DATA_PAGE = (
    f"""PASSPORT PASSEPORT
    SURNAME / NOM
    SAMPLE{{{_WORD}}}
    GIVEN NAMES / PRENOMS
    ADA TESTER
    DATE OF ISSUE
    {{c_custkey % 28 + 1}} JAN/JAN {{20 + c_custkey % 5}}""",
    """SURNAME
    X1
    DATE OF ISSUE DELIVRANCE 15 FEB 2019
    16 FEB 98""",
    """nothing {c_custkey} here""",
)
_CLAUSES = (
    """Authorized share capital USD {c_custkey * 2} divided into {c_custkey} ordinary shares of USD 1 each and {c_custkey} preference shares of USD 1 each""",
    """Issued share capital $ {c_custkey} divided into 1 share of ${c_custkey} each""",
    """Authorized capital USD 1000. Issued share capital EUR 600. Paid-up share capital USD {c_custkey}.""",
    """Total Share Capital 1,000,{lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')}""",
    """no capital {c_custkey}""",
)
_LICENSE = """DRIVER'S LICENCE
    {CASE WHEN c_custkey % 5 = 0 THEN 'REF' ELSE 'LICENSE NO' END}: ABC-{100000 + c_custkey}
    FULL NAME: SAMPLE, {translate(CAST(c_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')} HOLDER
    DOB: {c_custkey % 28 + 1}/{c_custkey % 12 + 1}/19{lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0')}
    ISSUE DATE: 01-02-2020
    {CASE WHEN c_custkey % 3 = 0 THEN 'EXPIRES' ELSE 'EXPIRY DATE' END} 01-02-2025
    CLASS: {CASE c_custkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C1' ELSE 'D' END}
    SEX: {CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'FEMALE' ELSE 'X' END}
    ADDRESS: {c_custkey} SAMPLE STREET, LAGOS."""
_VOTER = """REPUBLIC OF GHANA
    {CASE WHEN c_custkey % 2 = 0 THEN 'VOTER ID' ELSE 'CARD NO' END}: {CASE WHEN c_custkey % 5 = 0 THEN '12' ELSE 'GH' END}{1000000 + c_custkey}
    NAME: AMA {translate(CAST(c_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')}
    {CASE WHEN c_custkey % 5 = 1 THEN 'BORN' ELSE 'DATE OF BIRTH' END} {c_custkey % 28 + 1}-{c_custkey % 12 + 1}-1990
    GENDER {CASE c_custkey % 2 WHEN 0 THEN 'M' ELSE 'FEMALE' END}
    POLLING STATION: SCHOOL {c_custkey % 50}, ACCRA"""
_NIGERIAN = """FEDERAL REPUBLIC OF NIGERIA
    {CASE WHEN c_custkey % 3 = 0 THEN 'CODE: 24-03-07-012' ELSE 'NO SUCH' END}
    {CASE WHEN c_custkey % 4 = 0 THEN 'NUMBER' ELSE 'VIN:' END} 90F5 B0C2 {lpad(CAST(c_custkey AS STRING), 8, '0')}
    DELIM: {CASE WHEN c_custkey % 2 = 0 THEN 'LAGOSI MAINLAND' ELSE 'CROSSRIVER' END}
    {CASE WHEN c_custkey % 2 = 0 THEN 'WARD' ELSE 'CALABAR' END}
    DOE{translate(CAST(c_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')}{CASE WHEN c_custkey % 5 = 0 THEN '. 1' ELSE '.' END}SAMPLEHOLDER{translate(CAST(c_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')}
    DATEOFBIRTH GENDER
    {lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')}{CASE WHEN c_custkey % 2 = 0 THEN '121990 M' ELSE '/12/1990 FEMALE' END}
    OCCUPATION TRADER
    ADDRESS {c_custkey}SAMPLESTREET.LAGOS"""
_STATEMENT = (
    """TIME PERIOD: ACCOUNT NUMBER BANK NAME
    01/08/2025 to {c_custkey % 28 + 1}/11/2025 {10000000 + c_custkey} Wema Bank CURRENCY
    Hello SAMPLE PERSON,
    Opening Balance: NGN {c_custkey}.00
    Balance as at November 18, 2025: {c_custkey},038.60""",
    """UNITED BANK FOR AFRICA
    Bank Statement
    SAMPLECUSTOMERHOLDER
    {c_custkey}SAMPLESTREETLAGOS
    Account Number: {2000000000 + c_custkey}
    Account Name: SAMPLECUSTOMER
    01-Jan-2025 to 31-Mar-2025
    Opening Balance 1,{100 + c_custkey % 900}.25
    Closing Balance {200 + c_custkey}.75""",
    """Some other bank, UBA transfer
    Account No: 12345xxxx{c_custkey % 10}9
    no balances here""",
)

#: name: (SQL, tables it reads).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "business_texts": (
        f"""SELECT c_custkey AS doc_id, {_cases('c_custkey', _BUSINESS)} AS text,
        CASE c_custkey % 4 WHEN 0 THEN 'Nigeria' WHEN 1 THEN 'US' WHEN 2 THEN 'fra' END AS hint FROM customer""",
        ("customer",),
    ),
    "passports": (_passports(), ("customer",)),
    "registers": (f"SELECT c_custkey AS doc_id, {_cases('c_custkey', _REGISTERS)} AS text FROM customer", ("customer",)),
    "nin_documents": (f"SELECT c_custkey AS doc_id, {_cases('c_custkey', _NIN)} AS text FROM customer", ("customer",)),
    "data_pages": (f"SELECT c_custkey AS doc_id, {_cases('c_custkey', _DATA_PAGE)} AS text FROM customer", ("customer",)),
    "capital_clauses": (
        f"SELECT c_custkey AS doc_id, {_cases('c_custkey', _CLAUSES)} AS text, CASE c_custkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'CAN' END AS country_code"
        " FROM customer",
        ("customer",),
    ),
    "licenses": (
        f"SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'NGA' WHEN 1 THEN 'GHA' ELSE 'KEN' END AS country,"
        f" {_text(_LICENSE)} AS text FROM customer",
        ("customer",),
    ),
    "ghana_voters": (f"SELECT c_custkey AS doc_id, {_text(_VOTER)} AS text FROM customer", ("customer",)),
    "nigeria_voters": (f"SELECT c_custkey AS doc_id, {_text(_NIGERIAN)} AS text FROM customer", ("customer",)),
    "statements": (f"SELECT c_custkey AS doc_id, {_cases('c_custkey', _STATEMENT)} AS text FROM customer", ("customer",)),
    "boxes": (
        "SELECT l_orderkey AS doc_id, CAST(l_linenumber * 9 + l_partkey % 7 AS DOUBLE) AS y, CAST(l_partkey % 1000 AS DOUBLE) AS x,"
        " CAST(8 + l_quantity % 12 AS DOUBLE) AS h, concat(l_returnflag, CAST(l_partkey AS STRING)) AS text FROM lineitem",
        ("lineitem",),
    ),
    "page_candidates": (
        f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE {_text(_VOTER)} END AS embedded,
        CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'CODE: 12-34-56-789 REPUBLIC'
             WHEN c_custkey % 3 = 1 THEN {_text(_VOTER + chr(10) + "MORE {c_name} words here")} ELSE {_text(_VOTER)} END AS rendered,
        CAST(c_custkey % 100 AS DOUBLE) / 100 AS ocr_confidence FROM customer""",
        ("customer",),
    ),
    "doc_pages": (
        "SELECT l_orderkey AS doc_id, l_linenumber AS page_number, repeat(concat(l_returnflag, CAST(l_partkey AS STRING), ' '),"
        " CAST(l_quantity AS INT)) AS text FROM lineitem",
        ("lineitem",),
    ),
    "uploads": (
        """SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.PNG' WHEN 2 THEN 'c.jpg' WHEN 3 THEN 'd.xyz'
        WHEN 4 THEN '' ELSE 'plain' END AS filename, unhex(CASE c_custkey % 8 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '89504E470D0A1A0A00'
        WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '424D0000' WHEN 4 THEN '5249464600000000574542500000' WHEN 5 THEN '' WHEN 6 THEN '49492A0008' ELSE '00112233' END)
        AS content FROM customer""",
        ("customer",),
    ),
    "raw_values": (
        """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN concat('Company Name:  ACME ', c_name, ' Limited.') WHEN 1 THEN concat('ALPHA ', c_name, ' LTD is hereby incorporated today')
        WHEN 2 THEN '  ,;' ELSE concat('Beta', chr(10), 'Gamma ', c_name) END AS name, concat(' rc / ', CAST(c_custkey AS STRING), ' -x#') AS ident,
        CASE c_custkey % 9 WHEN 0 THEN 'Public company limited by shares' WHEN 1 THEN 'LIMITEDLIABILITYCOMPANY' WHEN 2 THEN 'Acme Ltd/Gte' WHEN 3 THEN 'Acme plc'
        WHEN 4 THEN 'a private company' WHEN 5 THEN 'partnership' WHEN 6 THEN 'Foo Limited' WHEN 7 THEN 'Foo Inc.' ELSE 'none' END AS kind,
        CASE c_custkey % 7 WHEN 0 THEN 'In Liquidation' WHEN 1 THEN 'struck-off' WHEN 2 THEN 'INACTIVE' WHEN 3 THEN 'active' WHEN 4 THEN 'Registered' WHEN 5 THEN 'not active' ELSE '?' END AS status,
        CASE c_custkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN ' F ' WHEN 2 THEN 'other' ELSE '' END AS sex, CAST(c_custkey % 101 AS DOUBLE) / 100 AS score,
        CASE c_custkey % 6 WHEN 0 THEN '$' WHEN 1 THEN 'US $' WHEN 2 THEN 'NGN' WHEN 3 THEN 'naira' WHEN 4 THEN '€' ELSE 'x' END AS money,
        CASE c_custkey % 5 WHEN 0 THEN 'USA' WHEN 1 THEN 'CAN' WHEN 2 THEN 'AUS' ELSE 'NGA' END AS country,
        CASE c_custkey % 4 WHEN 0 THEN '1,234.50' WHEN 1 THEN concat('00', CAST(c_custkey AS STRING)) WHEN 2 THEN 'abc' ELSE '12.' END AS amount FROM customer""",
        ("customer",),
    ),
    "raw_dates": (
        """SELECT doc_id, a, b, y, form, country, CASE form WHEN 0 THEN concat_ws('-', CAST(y AS STRING), CAST(b AS STRING), CAST(a AS STRING))
        WHEN 1 THEN concat('Dated this ', CAST(a AS STRING), 'th day of ', mon, ', ', CAST(y AS STRING)) WHEN 2 THEN concat('Friday, ', mon, ' ', CAST(a AS STRING), ' ', CAST(y AS STRING))
        ELSE concat_ws('/', CAST(a AS STRING), CAST(b AS STRING), CAST(y AS STRING)) END AS raw
        FROM (SELECT c_custkey AS doc_id, c_custkey % 31 + 1 AS a, c_custkey % 13 + 1 AS b, 1950 + c_custkey % 90 AS y, c_custkey % 4 AS form,
        CASE c_custkey % 3 WHEN 0 THEN 'USA' ELSE 'NGA' END AS country,
        CASE c_custkey % 13 + 1 WHEN 1 THEN 'January' WHEN 2 THEN 'FEB' WHEN 3 THEN 'mar' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul'
        WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sept' WHEN 10 THEN 'October' WHEN 11 THEN 'Nov' WHEN 12 THEN 'DECEMBER' ELSE 'Foo' END AS mon FROM customer) q""",
        ("customer",),
    ),
    "candidates": (
        """SELECT l_orderkey AS doc_id, concat('f', CAST(l_linenumber AS STRING)) AS field, CASE WHEN p = 1 AND k % 3 = 0 THEN concat('Other ', CAST(k AS STRING)) WHEN p = 1 THEN concat('va.', CAST(k AS STRING))
        WHEN p = 2 AND k % 4 = 0 THEN concat('THIRD-', CAST(k AS STRING)) ELSE concat('VA ', CAST(k AS STRING)) END AS value,
        CASE WHEN p = 0 THEN 0.8 WHEN p = 1 THEN 0.6 + (k % 40) / 100.0 WHEN k % 7 = 0 THEN NULL ELSE 0.7 + (k % 30) / 100.0 END * CAST(1 AS DOUBLE) AS confidence, p AS parser
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber) q
        CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 AS p UNION ALL SELECT 2 AS p) r WHERE p = 0 OR (p = 1 AND k % 5 <> 0) OR (p = 2 AND k % 2 = 0)""",
        ("lineitem",),
    ),
    "authorities": (
        """SELECT c_custkey AS doc_id, 'issuing_authority' AS field, CASE WHEN p = 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'Delaware Secretary of State' WHEN 1 THEN 'Corporate Affairs Commission'
        WHEN 2 THEN 'Registrar of Companies' ELSE NULL END ELSE CASE c_custkey % 3 WHEN 0 THEN 'Delaware Division of Corporations' WHEN 1 THEN 'CORPORATE AFFAIRS COMMISSION.' ELSE 'Companies Registry' END END AS value,
        CASE WHEN p = 0 THEN 0.8 ELSE 0.7 + (c_custkey % 23) / 100.0 END * CAST(1 AS DOUBLE) AS confidence, p AS parser
        FROM customer CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 AS p) r""",
        ("customer",),
    ),
    "scores": (
        """SELECT c_custkey AS doc_id, CAST(c_custkey % 101 AS DOUBLE) / 100 AS a, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 11 AS DOUBLE) / 10 END AS b,
        CAST(c_custkey % 5 AS DOUBLE) / 5 AS c, CAST(c_custkey % 3 AS DOUBLE) / 3 AS d, c_custkey % 9 AS n FROM customer""",
        ("customer",),
    ),
    "receipts": (
        """SELECT doc_id, form, k, d, CASE form
        WHEN 0 THEN concat_ws(chr(10), 'Provider: IKEJA ELECTRIC', concat('Meter Number: ', CAST(10000000000 + k AS STRING)), concat('Service Address: ', CAST(k AS STRING), ' Sample Street , Lagos'),
          'Meter Type: PREPAID', concat('Token: 1234-5678-9012-3456-', lpad(CAST(k % 10000 AS STRING), 4, '0')), concat('Units Purchased: ', CAST(k % 50 AS STRING), '.5 kWh'),
          concat('Amount Paid: NGN ', CAST(1000 + k % 1000 AS STRING), '.00'), concat('Transaction Date: ', CAST(d AS STRING), ' 19:05:49'))
        WHEN 1 THEN concat_ws(chr(10), 'Biller', 'Abuja Electricity Distribution', concat('Beneficiary ID: ', CAST(20000000000 + k AS STRING)), concat('Meter Token ', CAST(k AS STRING), 'TT'),
          'Address:', concat('Plot', CAST(k AS STRING), ' Sample'), 'Road Kubwa', concat('Date: ', CAST(day(d) AS STRING), '/', CAST(month(d) AS STRING), '/', CAST(year(d) AS STRING)))
        WHEN 2 THEN concat_ws(chr(10), 'EKO ELECTRICITY', concat(CAST(k AS STRING), ' Marina Road'), 'Current charges and arrears', concat('Due date ', CAST(d AS STRING)))
        ELSE 'nothing to see' END AS text
        FROM (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS form, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders) q""",
        ("orders",),
    ),
    "joined_names": (
        f"""SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN concat('EDWARD', 'SAMPLE', {_WORD}) WHEN 1 THEN concat('Edward', 'Sample', {_WORD}, 'x')
        WHEN 2 THEN concat('SAMPLE', {_WORD}, 'SAMPLE', {_WORD}) WHEN 3 THEN concat('MICHAELEBUBE', 'QQQ', {_WORD}, 'EMMANUEL') WHEN 4 THEN concat('ada', {_WORD}, '  lee') ELSE NULL END AS name,
        CASE c_custkey % 3 WHEN 0 THEN 'AbujaElectricityDistributionPrepaid' WHEN 1 THEN 'IKEJA ELECTRIC' ELSE 'ABUJAELECTRICITY  plc' END AS provider FROM customer""",
        ("customer",),
    ),
    "provider_names": (
        "SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'Ikeja Electric plc' WHEN 1 THEN 'ABUJA ELECTRICTY' WHEN 2 THEN 'Kano Elektricity'"
        " WHEN 3 THEN 'something else' ELSE '' END AS name FROM customer",
        ("customer",),
    ),
    "customers_as_images": (
        "SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'FFFFFF' WHEN 1 THEN 'F0F0F0' ELSE '2060A0' END AS light,"
        " CASE c_custkey % 2 WHEN 0 THEN '101010' ELSE 'FAFAFA' END AS dark FROM customer",
        ("customer",),
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    frames = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in tables}
    for t in tables:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **frames)


def with_view(name: str, sql: str) -> str:
    """DuckDB SQL over a view, given as a common table."""
    return f"WITH {name} AS ({VIEWS[name][0]}),\n{sql.strip()}"
