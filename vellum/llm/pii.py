"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod 97 for bank accounts, variety of characters for secrets), and words close
before a span adjust its score, up or down.  The base kinds are kept whatever
their score; the others from ``THRESHOLD`` on.

The matches of a pattern come from ``regexp_extract_all`` and the text between
them from ``split``; running lengths of the two give the offsets.  The patterns
are written so that the engine never rescans a run of characters: possessive
runs that start only where a run, or the search after a match, starts.  That
gives the leftmost matches of the plain patterns in linear time.

Cases: a null or empty text has no spans; null ids are kept; repeated rows give
repeated results; an empty table gives an empty one; other columns are not read.
Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, each with its pattern.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A place where an account may start, and as much text as the longest one and its end can take.
IBAN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,31}))"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])(?<!\+[0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
# Keys and tokens: long runs with a digit that no name or path goes on into; private keys.
SECRET = (
    r"-----BEGIN (?:[A-Z]{1,20} ){0,3}?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]{1,20} ){0,3}?PRIVATE KEY-----)?+"
    r"|(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}+"
)
# Heads of keys that services give out.
ISSUED = r"^(?:-----BEGIN|(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_|github_pat_|glpat-|sk[-_]|xox[abprs]-|AIza|eyJ)"

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "local_phone", "secret")
BASE_KINDS = KINDS[:4]
# The score of a span by its pattern and checksum alone.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3, "secret": 0.3}
# Words that make a kind likelier within the window before a span.
CONTEXT = {
    "email": "mail|e-mail|email|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|kreditkarte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono|whatsapp",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "national_id": "ssn|social|security|id|identity|tax",
    "local_phone": "phone|tel|call|mobile|fax|telefon|telefono|whatsapp",
    "secret": "token|secret|key|apikey|api_key|access_key|secret_key|private_key|access_token|password|passwd|pwd|passphrase|auth|authorization|bearer|credential|credentials",
}
# Words that make any kind less likely there.
AGAINST = "order|invoice|isbn|version|page|sha|sha1|sha256|md5|checksum|commit|hash|tracking|article|example"
CONTEXT_BONUS, CONTEXT_MALUS = 0.4, 0.3
# The lengths of accounts by country; those of other codes have 15 to 34 characters.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()
#: Code points before a span in which context words count.
WINDOW = 40
#: Spans beyond the base kinds are kept from this score on.
THRESHOLD = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid_ip(match: Column) -> Column:
    # A part is at most 255 when, without leading zeros, it is short and small.
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255)
    return F.forall(F.split(match, r"\."), part)


def _valid_card(match: Column) -> Column:
    d = _digits(match)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def _valid_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _valid_iban(match: Column) -> Column:
    """Remainder 1 modulo 97 of the account with its head moved to the end and A..Z as 10..35."""
    s = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97))
    return F.length(s).between(15, 34) & (rest == 1)


def _account(run: Column) -> Column:
    """The account that ``run`` starts with, or an empty string: of its country's length, else the longest valid one."""
    lengths = F.expr("map(" + ", ".join(f"'{c[:2]}', {c[2:]}" for c in IBAN_LENGTHS) + ")")
    own = F.try_element_at(lengths, F.substring(run, 1, 2))
    tried = F.when(own.isNull(), F.sequence(F.lit(34), F.lit(15), F.lit(-1))).otherwise(F.array(own))
    head = lambda n: F.call_function("regexp_extract", run, F.concat(F.lit(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){"), (n - 4).cast("string"), F.lit(r"}(?![A-Za-z0-9])")), F.lit(0))
    return F.coalesce(F.get(F.filter(F.transform(tried, head), _valid_iban), F.lit(0)), F.lit(""))


def _account_spans(text: Column) -> Column:
    """Valid accounts, the leftmost of those that overlap, whatever capitals and digits stand around them."""
    # The matches are empty; after a first character none is at the start, where split would leave it out.
    whole = F.concat(F.lit("\n"), text)
    accounts = F.transform(F.regexp_extract_all(whole, F.lit(IBAN), F.lit(1)), _account)
    gaps = F.transform(F.split(whole, IBAN, -1), F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(accounts)), accounts, lambda g, a: F.struct(g.alias("gap"), a.alias("match")))
    return F.aggregate(
        steps,
        F.expr("named_struct('at', -1, 'end', 0, 'spans', cast(array() as array<struct<start:int,end:int,match:string>>))"),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"]).alias("at"),
            F.when((x["match"] != "") & (acc["at"] + x["gap"] >= acc["end"]), acc["at"] + x["gap"] + F.length(x["match"])).otherwise(acc["end"]).alias("end"),
            F.when(
                (x["match"] != "") & (acc["at"] + x["gap"] >= acc["end"]),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("match")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def _valid_secret(match: Column) -> Column:
    """Of a known issuer, or with letters, digits and many different characters."""
    varied = match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= 10)
    return match.rlike(ISSUED) | varied


def _always(_: Column) -> Column:
    return F.lit(True)


#: kind: pattern, confirmation, a cheap test without which a text has no match.
RULES = {
    "email": (EMAIL, _always, lambda t: t.contains("@")),
    "ip": (IP, _valid_ip, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (CARD, _valid_card, lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    "phone": (PHONE, _valid_phone, lambda t: t.contains("+")),
    "iban": (IBAN, _valid_iban, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}")),
    "national_id": (NATIONAL_ID, _always, lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]")),
    "local_phone": (LOCAL_PHONE, _always, lambda t: t.rlike(r"[0-9][.-][0-9]{4}")),
    "secret": (SECRET, _valid_secret, lambda t: t.rlike(r"[A-Za-z0-9+/_-]{20}|-----BEGIN ")),
}
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"


def _match_spans(text: Column, pattern: str, confirm) -> Column:
    """The confirmed matches of a pattern, in order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # Each gap's length goes with the match after it; the last gap has none.
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    empty = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int,match:string>>))")
    return F.aggregate(
        steps,
        empty,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["match"])).alias("at"),
            F.when(
                confirm(x["match"]),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("match")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def kind_spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order."""
    pattern, confirm, cheap = RULES[kind]
    placed = _account_spans(text) if kind == "iban" else _match_spans(text, pattern, confirm)
    spoken = lambda s, names: before(s).rlike(rf"(?<![a-z])(?:{names})(?![a-z])")
    own = (lambda s: F.when(s["match"].rlike(ISSUED), 0.9).otherwise(SCORES[kind])) if kind == "secret" else (lambda s: F.lit(SCORES[kind]))
    score = lambda s: own(s) + F.when(spoken(s, CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0) - F.when(spoken(s, AGAINST), CONTEXT_MALUS).otherwise(0.0)
    before = lambda s: F.lower(F.substring(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW))))
    scored = F.transform(
        placed,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind_no"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), score(s))).alias("score"),
        ),
    )
    if kind not in BASE_KINDS:
        scored = F.filter(scored, lambda s: s["score"] >= THRESHOLD)
    return F.when(cheap(text), scored).otherwise(F.expr(f"cast(array() as {SPAN})"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every whole text: ``doc_id, text, <kind>_spans..., found``.

    ``found`` has every span by start, then kind.  A narrow plan: no shuffle.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base.select("doc_id", "text", *[kind_spans(F.col("text"), k).alias(f"{k}_spans") for k in KINDS])
    return out.withColumn("found", F.array_sort(F.concat(*[F.col(f"{k}_spans") for k in KINDS])))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_column(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``[KIND]`` of its first span.

    Pieces are cut from a fixed-width encoding, so the work is linear in the text.
    """
    start = F.expr("named_struct('at', 0, 'parts', cast(array() as array<struct<lo:int,hi:int,mark:string>>))")
    cut = F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= acc["at"]) | (F.size(acc["parts"]) == 0),
                F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("lo"), s["start"].alias("hi"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark")))),
            ).otherwise(acc["parts"]).alias("parts"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(_assemble(F.encode(text, "UTF-32"), F.length(text), cut))


def _assemble(wide: Column, length: Column, cut: Column) -> Column:
    piece = lambda a, b: F.decode(F.substring(wide, a * 4 + 1, (b - a) * 4), "UTF-32")
    head = F.array_join(F.transform(cut["parts"], lambda p: F.concat(piece(p["lo"], p["hi"]), p["mark"])), "")
    return F.concat(head, piece(cut["at"], length))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*[kind_spans(text, k) for k in KINDS]))
    names = docs.columns
    return docs.withColumn("_vellum_spans", spans).select(
        *[(F.when(F.col(c).isNotNull(), redact_column(text, F.col("_vellum_spans"))).alias(c) if c == text_col else F.col(f"`{c}`")) for c in names]
    )
