"""Recognising personal data and secrets: names, patterns and checksums."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values

# Name parts that mark an attribute as personal.
PERSONAL_TOKENS = (
    "email", "mail", "phone", "mobile", "tel", "msisdn", "address", "street", "city", "zip", "postcode", "postal",
    "ssn", "iban", "bic", "card", "pan", "cvv", "dob", "birth", "birthday", "ip", "ipaddress", "firstname",
    "lastname", "fullname", "surname", "username", "user", "login", "customer", "person", "name", "account",
    "passport", "gender", "geo", "lat", "lon", "latitude", "longitude",
)
# Name parts that mark an attribute as secret.
SECRET_TOKENS = (
    "password", "passwd", "pwd", "secret", "token", "cookie", "session", "authorization", "auth", "apikey", "key",
    "credential", "credentials", "signature",
)
# First parts of semantic-convention names, scanned but never replaced by name.
CONVENTION_NAMESPACES = (
    "service", "telemetry", "otel", "http", "url", "server", "client", "network", "net", "db", "rpc", "messaging",
    "faas", "cloud", "aws", "gcp", "azure", "az", "k8s", "container", "host", "os", "process", "deployment", "code",
    "exception", "error", "thread", "span", "peer", "event", "graphql", "feature_flag", "browser", "device",
    "user_agent", "xray", "appinsights", "engine", "test", "flow",
)
# Detector labels and patterns, in the order they run.
PATTERNS = (
    ("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}"),
    ("credential", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret)\b"
                   r"\s*[=:]\s*\"?[^\s\",;&]+"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b"),
    ("card", r"\b(?:[0-9][ -]?){12,18}[0-9]\b"),
    ("ipv6", r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,6}:(?:[0-9a-f]{1,4}:?){1,6}\b"),
    ("ipv4", r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b"),
    ("phone", r"(?:\+|\b00)?[0-9][0-9 ().-]{6,18}[0-9]\b"),
)
# Dates, which look like phone numbers.
DATE_PATTERN = r"^\d{4}[-./]\d{2}[-./]\d{2}|^\d{2}[-./]\d{2}[-./]\d{4}"
# Text without any of these matches none of the patterns above.
MAYBE_PERSONAL = r"[0-9@:=]|eyJ|AKIA|ASIA|(?i:bearer)"

PATTERN = dict(PATTERNS)


@dataclass
class MaskingConfig:
    """What may pass and what must not; ``enabled=False`` lets all pass. Texts are
    whole unless ``max_string_len`` is given."""

    enabled: bool = True
    allow_keys: list[str] = field(default_factory=list)
    deny_tokens: list[str] = field(default_factory=list)
    extra_patterns: dict[str, str] = field(default_factory=dict)
    max_string_len: int | None = None


# ------------------------------------------------------------ names

def name_tokens(name: Column) -> Column:
    """Lowercase parts of a name, split at separators and at camelCase."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: t != "")


def sanitize(name: Column) -> Column:
    """A label: lowercase letters, digits and inner underscores."""
    label = F.regexp_replace(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]", "_")), r"\A_+|_+\z", "")
    return F.when(label == "", F.lit("value")).otherwise(label)


def _words(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def treatment(key: Column, config: MaskingConfig) -> Column:
    """``replaced``, ``allowed`` or ``scanned``: secrets first, then the allow
    list, then conventional namespaces, then personal names."""
    tokens = name_tokens(key)
    denied = (*PERSONAL_TOKENS, *[t.lower() for t in config.deny_tokens])
    allowed = F.lower(key).isin(*[k.lower() for k in config.allow_keys]) if config.allow_keys else F.lit(False)
    namespace = F.lower(F.substring_index(key, ".", 1))
    return (
        F.when(F.arrays_overlap(tokens, _words(SECRET_TOKENS)), "replaced")
        .when(allowed, "allowed")
        .when(key.contains(".") & namespace.isin(*CONVENTION_NAMESPACES), "scanned")
        .when(F.arrays_overlap(tokens, _words(denied)), "replaced")
        .otherwise("scanned"))


# ------------------------------------------------------------ checks as columns

def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the 13 to 19 digits of a text pass the card checksum."""
    digits = F.reverse(_digits(text))
    doubled = F.transform(F.split(digits, ""), lambda d, i: F.when(
        i % 2 == 1, d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)).otherwise(d.try_cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def iban_valid(text: Column) -> Column:
    """Whether 15 to 34 letters and digits leave remainder 1 modulo 97."""
    compact = F.upper(F.regexp_replace(text, r"\s", ""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(
        (acc * F.when(value(c) >= 10, 100).otherwise(10) + value(c)) % 97))
    return F.length(compact).between(15, 34) & compact.rlike(r"\A[0-9A-Z]*\z") & (rest == 1)


def phone_plausible(text: Column) -> Column:
    """Eight to fifteen digits, international or separated, and not a date."""
    return (F.length(_digits(text)).between(8, 15) & (text.startswith("+") | text.startswith("00") | text.rlike(r"[ ().-]"))
            & ~text.rlike(DATE_PATTERN))


CHECKS: dict[str, Callable[[Column], Column]] = {"iban": iban_valid, "card": luhn, "phone": phone_plausible}


def detected(text: Column, label: str) -> Column:
    """All texts one detector accepts, in order, as a column of arrays."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + PATTERN[label]), F.lit(0))
    return F.filter(found, CHECKS[label]) if label in CHECKS else found


def replaced(text: Column, label: str) -> Column:
    """The text with every match of an unchecked detector replaced by its label."""
    return F.regexp_replace(text, "(?U)" + PATTERN[label], f"<{label}>")


# ------------------------------------------------------------ the full scan

def _luhn_text(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    total = sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
    return 13 <= len(digits) <= 19 and total % 10 == 0


def _iban_text(text: str) -> bool:
    compact = "".join(text.split())
    if not (15 <= len(compact) <= 34 and compact.isascii() and compact.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _phone_text(text: str) -> bool:
    count = sum(c in "0123456789" for c in text)
    shaped = text.startswith(("+", "00")) or any(c in " ().-" for c in text)
    return 8 <= count <= 15 and shaped and not re.match(DATE_PATTERN, text)


_TEXT_CHECKS = {"iban": _iban_text, "card": _luhn_text, "phone": _phone_text}

# A pseudonym before it has a number: its value in hex between two private-use
# characters, so that later detectors see the shape of a finished token.
_MARK, _END = "", ""
PLACEHOLDER = re.compile(f"<([^<>#]*)#{_MARK}([0-9a-f]*){_END}>")


def placeholder(label: str, value: str) -> str:
    return f"<{label}#{_MARK}{value.encode('utf-8', 'surrogatepass').hex()}{_END}>"


def _inside_token(text: str, at: int) -> bool:
    """Whether a position follows an open ``<`` of something like a token."""
    opened = text.rfind("<", 0, at)
    if opened < 0 or text.find("#", opened) < 0:
        return False
    closed = text.rfind(">", 0, at)
    return opened > closed if closed >= 0 else text.find(">", opened) >= 0


def label_of(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "_", re.sub(r"[A-Z]", lambda m: m[0].lower(), name)).strip("_") or "value"


def compile_detectors(extra: dict[str, str]) -> list[tuple[str, re.Pattern, Callable | None]]:
    out = [(label, re.compile(pattern), _TEXT_CHECKS.get(label)) for label, pattern in PATTERNS]
    for name, pattern in sorted(extra.items()):
        try:
            out.append((label_of(name), re.compile(pattern.replace(r"\z", r"\Z")), None))
        except re.error:
            continue
    return out


def scan_text(text: str, detectors) -> tuple[str, list[tuple[str, str]]]:
    """The text with placeholders for what the detectors found, each working on
    what the one before left, and the finds in the order they were made."""
    found: list[tuple[str, str]] = []
    for label, pattern, check in detectors:
        def swap(match: re.Match) -> str:
            if (check and not check(match[0])) or _inside_token(match.string, match.start()):
                return match[0]
            found.append((label, match[0]))
            return placeholder(label, match[0])

        text = pattern.sub(swap, text)
    return text, found
